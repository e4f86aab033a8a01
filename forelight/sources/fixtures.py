"""Ticks and quote candles derived from the driver's ``events`` table.

Each event yields eight ticks, one per pseudo-second, with a 91-second hole in every
10,007 seconds; candles follow from the minute bars and carry one of each defect that
the quality rules must catch. Everything is a projection or an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
COPIES, HOLE_EVERY, HOLE_FROM, HOLE_TO = 8, 10_007, 600, 690


def ticks(spark: SparkSession, sf_dir: str, loud: bool = False) -> DataFrame:
    """ts, value at one a second; ``loud`` adds a far-off tick half a second after each."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    n = events.count()
    s = f"event_id + copy * {n}L"
    out = events.select("event_id", "value", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    out = out.selectExpr(f"{s} AS s", "100000e0 + value AS value").where(f"s % {HOLE_EVERY} < {HOLE_FROM} OR s % {HOLE_EVERY} > {HOLE_TO}")
    one = out.selectExpr(f"{EPOCH} + s * INTERVAL '1' SECOND AS ts", "value")
    if not loud:
        return one
    return one.unionByName(out.selectExpr(f"{EPOCH} + s * INTERVAL '1' SECOND + INTERVAL '0.5' SECOND AS ts", "value + 5000e0 AS value"))


def candles(bars: DataFrame, shift_minutes: int = 0) -> DataFrame:
    """End-labelled quote candles from minute bars. A shift mislabels them on purpose."""
    sec = f"timestampdiff(SECOND, {EPOCH}, ts)"
    b = bars.selectExpr("ts", "mean", "n_ticks", "is_gap", f"CAST({sec} div 900 AS INT) AS w", f"CAST(({sec} div 60) % 15 AS INT) AS k")
    firsts = bars.selectExpr("timestampadd(MINUTE, 1, ts) AS next_ts", "mean AS before")
    opening = b.where("k = 0").join(firsts, F.col("ts") == F.col("next_ts"), "left").select("w", F.col("before").alias("strike"))
    b = b.join(opening, "w", "left").where("NOT is_gap")
    b = b.selectExpr(
        "*",
        "CASE WHEN k = 14 THEN CASE WHEN mean > strike THEN 0.999e0 ELSE 0.001e0 END ELSE greatest(0.02e0, least(0.98e0, round((mean - 100030e0) / 40e0, 3))) END AS mid",
        "w % 13 = 5 AND k < 14 AS wide", "(w * 15 + k) % 20 = 0 AS idle",
    ).where("NOT (w % 17 = 4 AND k IN (3, 4)) AND NOT (w % 19 = 6 AND k = 14)")
    bid = "CASE WHEN wide THEN 0.4e0 WHEN k = 14 THEN greatest(0e0, mid - 0.001e0) ELSE mid - 0.005e0 END"
    ask = "CASE WHEN wide THEN 1e0 WHEN k = 14 THEN least(1e0, mid + 0.001e0) ELSE mid + 0.005e0 END"
    b = b.selectExpr("*", f"{bid} AS bid", f"{ask} AS ask")
    move = {"open": -0.001, "high": 0.002, "low": -0.002, "close": 0.0}
    quotes = [f"{side} + {d!r}e0 AS yes_{side}_{name}" for side in ("bid", "ask") for name, d in move.items()]
    trades = [f"CASE WHEN NOT idle THEN mid + {d!r}e0 END AS price_{name}" for name, d in (*move.items(), ("mean", 0.0))]
    return b.selectExpr(
        f"timestampadd(MINUTE, {1 + shift_minutes}, ts) AS ts", "concat('W', CAST(w AS STRING)) AS ticker", "CASE WHEN w % 11 <> 3 THEN strike END AS floor_strike",
        *quotes, *trades, "CASE WHEN idle THEN 0e0 ELSE CAST(n_ticks * (w % 7 + 1) AS DOUBLE) END AS volume", "CAST(1000 + n_ticks AS DOUBLE) AS open_interest",
    )
