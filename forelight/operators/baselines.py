"""Persistence fan and index-only fair value: what a forecast has to beat."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.mathx import DECILES, FAN_Q_COLS, norm_cdf, persist_ref, price_bucket

MIN_FAN_N, MIN_FAN_CELLS, POOLED = 30, 60, -1
DQ = tuple(f"dq{10 * k}" for k in range(1, 10))


def persistence_fan(frame: DataFrame, lo: dt.datetime | None = None, hi: dt.datetime | None = None, strict: bool = False) -> DataFrame:
    """Exact deciles of mid[i+h] - reference[i] by (k_ctx, h) and price level, context ends in
    [lo, hi). ``strict`` also keeps the targets before hi."""
    f = frame.selectExpr("idx", "ts", "k", "mid_close", f"{persist_ref('mid_close', 'k')} AS ref")
    src = f
    if lo is not None:
        src = src.where(F.expr(f"ts >= TIMESTAMP_NTZ'{lo}'"))
    if hi is not None:
        src = src.where(F.expr(f"ts < TIMESTAMP_NTZ'{hi}'"))
    src = src.where("ref IS NOT NULL").selectExpr("idx", "k AS k_ctx", "ref", f"{price_bucket('ref')} AS bucket", "explode(sequence(1, 15 - (k + 1) % 15)) AS h")
    target = f.selectExpr("idx AS target", "ts AS target_ts", "mid_close AS then_mid")
    d = src.join(target, F.col("idx") + F.col("h") == F.col("target")).where("then_mid IS NOT NULL")
    if strict and hi is not None:
        d = d.where(F.expr(f"target_ts < TIMESTAMP_NTZ'{hi}'"))
    d = d.selectExpr("k_ctx", "h", "bucket", "then_mid - ref AS d")
    qs = F.expr(f"percentile(d, array({', '.join(f'{q!r}e0' for q in DECILES)}), c)")
    # Equal moves are counted first: prices have a grid, so the percentiles read few rows, whatever there is.
    d = d.groupBy("k_ctx", "h", "bucket", "d").agg(F.count("*").alias("c"))
    both = d.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.lit(POOLED))))
    fan = both.groupBy("k_ctx", "h", "bucket").agg(F.sum("c").alias("n"), qs.alias("q"))
    return fan.select("k_ctx", "h", "bucket", "n", *[F.col("q")[j].alias(c) for j, c in enumerate(DQ)])


def fan_cells(fan: DataFrame) -> DataFrame:
    return fan.where(f"bucket = {POOLED} AND n >= {MIN_FAN_N}").agg(F.count("*").alias("cells"))


def fit_fan(frame: DataFrame, eval_start: dt.datetime, lookback_days: int = 30, stored: DataFrame | None = None) -> tuple[DataFrame | None, dict]:
    """The fan and where it came from: a stored one, history before the evaluation, the head of
    the evaluation itself, or none (a point mass at the reference)."""
    if stored is not None:
        return stored, {"fan_mode": "file"}
    span = dt.timedelta(days=lookback_days)
    for mode, lo, hi in (("pre_period", eval_start - span, eval_start), ("in_sample_head", eval_start, eval_start + span)):
        fan = persistence_fan(frame, lo, hi)
        if fan_cells(fan).first()[0] >= MIN_FAN_CELLS:
            return fan, {"fan_mode": mode, "fan_range": [lo.isoformat(), hi.isoformat()]}
    return None, {"fan_mode": "point"}


def apply_fan(rows: DataFrame, fan: DataFrame | None) -> DataFrame:
    """Adds persist and the sorted, clipped fan: the level's cell, else the pooled cell, else a
    point mass. ``rows`` needs last_mid, k_ctx, h. A fan has at most 120 x 11 cells: 15 starts,
    15 steps, 10 levels and the pool, so it is broadcast."""
    rows = rows.withColumn("persist", F.expr(persist_ref("last_mid", "k_ctx")))
    if fan is None:
        return rows.withColumns({c: F.expr("greatest(0e0, least(1e0, persist))") for c in FAN_Q_COLS})
    # Deciles are put in order in the fan, a few cells, not in every row: adding a number and clipping keep it.
    use = fan.where(f"n >= {MIN_FAN_N}").withColumn("q_", F.sort_array(F.array(*DQ))).select("k_ctx", "h", "bucket", *[F.col("q_")[j].alias(c) for j, c in enumerate(DQ)])
    level = use.where(f"bucket <> {POOLED}").selectExpr("k_ctx", "h", "bucket AS level_", *[f"{c} AS l_{c}" for c in DQ])
    pool = use.where(f"bucket = {POOLED}").selectExpr("k_ctx", "h", *[f"{c} AS p_{c}" for c in DQ])
    rows = rows.withColumn("level_", F.expr(price_bucket("persist")))
    rows = rows.join(F.broadcast(level), ["k_ctx", "h", "level_"], "left").join(F.broadcast(pool), ["k_ctx", "h"], "left")
    rows = rows.withColumns({c: F.expr(f"greatest(0e0, least(1e0, persist + coalesce(l_{d}, p_{d}, 0e0)))") for c, d in zip(FAN_Q_COLS, DQ, strict=True)})
    return rows.drop("level_", *[f"{a}_{c}" for a in "lp" for c in DQ])


def fair_z(brti_close: str = "brti_close", strike: str = "strike", sigma: str = "sigma_1m", m: str = "m") -> str:
    h = f"((14 - {m}) + 1e0 / 3e0)"
    return f"(CASE WHEN {sigma} > 0 AND {brti_close} > 0 AND {strike} > 0 THEN greatest(-8e0, least(8e0, ln({brti_close} / {strike}) / ({sigma} * sqrt({h})))) ELSE 0e0 END)"


def fair_now(brti_close: str = "brti_close", strike: str = "strike", sigma: str = "sigma_1m", m: str = "m") -> str:
    """Index-only fair value at an origin; every undefined case is 0.5."""
    return norm_cdf(fair_z(brti_close, strike, sigma, m))
