"""Forecast fan-out: from ok origins to one row per origin and step, with baselines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.mathx import Q_COLS, decile_mean, m_group, norm_of_tail, norm_tail
from ..session import cut, ship
from .baselines import apply_fan, fair_z
from .covariates import CELLS, batches_of, tensor_rows, with_paths
from .select import quantiles

STEP, WIDTH = 0.001, 0.01
#: steps a model with known-future covariates forecasts at a time
PATCH = 64


def valid_steps(frame: DataFrame, origins: DataFrame) -> DataFrame:
    """(i, h, k, last_mid, actual) of every ok origin's steps that have a quote."""
    steps = origins.where("ok").selectExpr("i", "m", "last_mid", "explode(sequence(1, n_steps)) AS h")
    target = frame.where("target_valid").selectExpr("idx AS target", "mid_close AS actual")
    return steps.join(target, F.col("i") + F.col("h") == F.col("target")).selectExpr("i", "h", "m + h - 1 AS k", "last_mid", "actual")


def drift_forecast(frame: DataFrame, origins: DataFrame, step: float = STEP, width: float = WIDTH) -> DataFrame:
    """A closed-form forecaster in expressions: median = last + step * h, evenly spread deciles."""
    mid = f"(last_mid + {step!r}e0 * h)"
    qs = [f"greatest(0e0, least(1e0, {mid} + {width!r}e0 * {j - 4})) AS {c}" for j, c in enumerate(Q_COLS)]
    return valid_steps(frame, origins).selectExpr("i", "h", "k", f"greatest(0e0, least(1e0, {mid})) AS median", *qs, "actual")


Predict = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def check_prediction(median: np.ndarray, q: np.ndarray, n: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Shapes, then deciles clipped to [0, 1] and sorted; a tenth leading column (the mean) goes."""
    median, q = np.asarray(median, np.float64), np.asarray(q, np.float64)
    if q.ndim == 3 and q.shape[-1] == 10:
        q = q[..., 1:]
    if median.shape != (n, horizon) or q.shape != (n, horizon, 9):
        raise ValueError(f"a forecaster returned {median.shape} and {q.shape} for {n} rows and {horizon} steps")
    return np.clip(median, 0, 1), np.sort(np.clip(q, 0, 1), axis=-1)


def model_forecast(frame: DataFrame, origins: DataFrame, contexts: DataFrame, predict: Predict, horizon: int = 64) -> DataFrame:
    """Any forecaster ``predict(targets (n, C), horizon) -> (n, horizon), (n, horizon, 9 or 10)``, run
    on Arrow batches of ``contexts`` (i, target array); only valid steps are kept."""
    ship(frame.sparkSession)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                med, q = check_prediction(*predict(np.stack(pdf["target"].to_list()), horizon), len(pdf), horizon)
                n = min(15, horizon)
                out = {"i": np.repeat(pdf["i"].to_numpy(), n), "h": np.tile(np.arange(1, n + 1, dtype=np.int32), len(pdf)), "median": med[:, :n].ravel()}
                yield pd.DataFrame(out | {c: q[:, :n, j].ravel() for j, c in enumerate(Q_COLS)})

    kind = "i long, h int, median double, " + ", ".join(f"{c} double" for c in Q_COLS)
    made = contexts.join(origins.where("ok").select("i"), "i", "left_semi").select("i", "target").mapInPandas(run, kind)
    return valid_steps(frame, origins).drop("last_mid").join(made, ["i", "h"]).select("i", "h", "k", "median", *Q_COLS, "actual")


CovariatePredict = Callable[..., tuple[np.ndarray, np.ndarray]]


def checked_predict(predict: CovariatePredict, targets: np.ndarray, horizon: int, past_only: np.ndarray | None = None, past_future: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``predict(targets (n, C), steps, past_only (n, K, C) or None, past_future (n, W, C + steps) or
    None)``, with the widths of what goes in and comes out checked. A model that sees known-future
    covariates is asked for whole patches of ``PATCH`` steps; what is over is cut."""
    n, context = targets.shape
    steps = horizon if past_future is None else -(-horizon // PATCH) * PATCH
    if past_only is not None and (past_only.ndim != 3 or past_only.shape[0] != n or past_only.shape[2] != context):
        raise ValueError(f"past_only must be ({n}, K, {context}), not {past_only.shape}")
    if past_future is not None and (past_future.ndim != 3 or past_future.shape[0] != n or past_future.shape[2] != context + steps):
        raise ValueError(f"past_future must be ({n}, W, {context} + {steps}), not {past_future.shape}")
    if not n:
        return np.zeros((0, horizon)), np.zeros((0, horizon, 9))
    median, q = (np.asarray(x)[:, :horizon] for x in predict(targets, steps, past_only, past_future))
    return check_prediction(median, q, n, horizon)


def covariate_forecast(frame: DataFrame, origins: DataFrame, predict: CovariatePredict, context: int = 1024, name: str = "full", horizon: int = 64, cells: int = CELLS) -> DataFrame:
    """Forecasts of any model that reads the target and the covariates of preset ``name``: i, h, k,
    median, q10..q90, actual of every valid step, and n_flat of the origin.

    A task gets its block of rows once; the windows are cut, sanitised, given to ``predict`` in batches
    of ``cells`` numbers and dropped there, so C times the rows never travel."""
    ship(frame.sparkSession)
    rows, spec = tensor_rows(frame, origins, context, name, -(-horizon // PATCH) * PATCH)
    schema = pa.schema([("i", pa.int64()), ("h", pa.int32()), ("k", pa.int32()), ("median", pa.float64()), *((c, pa.float64()) for c in Q_COLS), ("actual", pa.float64()), ("n_flat", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for b in batches_of(with_paths(table), spec, cells):
            median, q = checked_predict(predict, b["targets"], horizon, b["past"], b["future"])
            r, s = np.nonzero(b["valid"][:, :horizon])
            out = {"i": b["i"][r], "h": (s + 1).astype(np.int32), "k": b["step_k"][r, s], "median": median[r, s]}
            out |= {c: q[r, s, j] for j, c in enumerate(Q_COLS)} | {"actual": b["target"][r, s], "n_flat": b["n_flat"][r].astype(np.int32)}
            parts.append(pa.table(out, schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    kind = f"i long, h int, k int, median double, {', '.join(f'{c} double' for c in Q_COLS)}, actual double, n_flat int"
    return rows.groupBy("block").applyInArrow(run, kind)


def windows(frame: DataFrame) -> DataFrame:
    first = lambda c: F.expr(f"min_by({c}, ts)").alias(c)
    return frame.groupBy("t0").agg(first("win_ticker").alias("ticker"), first("outcome_price"), first("outcome_brti"), first("strike_imputed"))


def assemble(long: DataFrame, frame: DataFrame, origins: DataFrame, fan: DataFrame | None, run_id: str = "run") -> DataFrame:
    """Forecast rows with their origin, window and baselines. Volatility terciles are cut over all
    rows at exact thirds (right-closed), which are selected digit by digit."""
    o = origins.where("ok").select("i", "t0", "date", "hour", "m", "k_ctx", "origin_ts", "strike", "last_mid", "last_bid", "last_ask", "last_spread", "brti_close", "sigma_1m", "quote_ok", "n_ctx_gaps")
    df = cut(long.join(o, "i").join(windows(frame), "t0", "left"))
    low, high = ("NULL" if c is None else f"{c!r}D" for c in quantiles(df, "sigma_1m", (1 / 3, 2 / 3)))
    df = df.selectExpr(
        "*", f"'{run_id}' AS run_id", "k = 14 AS is_settlement", "timestampadd(MINUTE, k, t0) AS bar_ts", "timestampadd(MINUTE, k + 1, t0) AS candle_ts", f"{m_group('m')} AS m_group",
        f"CASE WHEN sigma_1m <= {low} THEN 0 WHEN sigma_1m <= {high} THEN 1 ELSE 2 END AS vol_bucket",
    )
    return add_baselines(df, fan)


def add_baselines(df: DataFrame, fan: DataFrame | None) -> DataFrame:
    """``df`` with rw_p, mean_fc and the fan. The score and its tail are columns first: written out in
    place, the score is worked out some twenty times a row."""
    df = df.drop("rw_p", "persist", "mean_fc").withColumn("z_", F.expr(fair_z())).withColumn("tail_", F.expr(norm_tail("z_")))
    return apply_fan(df.withColumns({"rw_p": F.expr(norm_of_tail("z_", "tail_")), "mean_fc": F.expr(decile_mean(Q_COLS))}).drop("z_", "tail_"), fan)
