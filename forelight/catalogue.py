"""Every query of the engine by name, with its SQL twin."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .functions.mathx import FAN_Q_COLS, Q_COLS, rounded
from .operators import audit, bars as B, baselines, bootstrap, covariates, forecast, frame as FR, metrics, origins as O, runs, signals, splits
from .plans import oracle as S
from .session import cut, shared_dir
from .sources import fixtures, manifest, store, wire
from .streaming import bars as stream

VOL, RV, CONTEXT, GAP = 60, 30, 32, 0.1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BAR_COLS = {"ts": None, "open": 4, "high": 4, "low": 4, "close": 4, "mean": 4, "std": 4, "rv_1s": 12, "ret_l10": 10, "ret_l30": 10, "n_ticks": None, "n_raw_ticks": None, "is_gap": None, "is_full": None}
ORIGIN_COLS = {"i": None, "m": None, "n_steps": None, "k_ctx": None, "n_ctx_gaps": None, "strike": 4, "origin_ts": None, "drop_reason": None, "last_mid": 6, "last_bid": 6, "last_ask": 6, "last_spread": 6, "brti_close": 4, "sigma_1m": 10, "quote_ok": None, "t0": None, "ok": None, "date": None, "hour": None}
COUNTS = {"n", "n_windows", "n_days", "dir_n", "settle_n"}
METRICS = {c: None if c in COUNTS else 7 for c in metrics.METRIC_COLUMNS}
FAN_COLS = {"k_ctx": None, "h": None, "bucket": None, "n": None, **dict.fromkeys(baselines.DQ, 7)}


def minute_bars(spark: SparkSession, sf: str, loud: bool = False) -> DataFrame:
    return B.to_bars(fixtures.ticks(spark, sf, loud), "1m")


def minute_frame(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """The frame once, materialised: most queries read it several times."""
    bars = cut(minute_bars(spark, sf))
    return cut(FR.build_frame(bars, fixtures.candles(bars, shift), VOL, RV))


def all_origins(frame: DataFrame, **over) -> DataFrame:
    return O.make_origins(frame, O.OriginSpec(context=CONTEXT, max_gap_frac=GAP, **over))


def assembled(spark: SparkSession, sf: str) -> DataFrame:
    frame = minute_frame(spark, sf)
    o = cut(all_origins(frame))
    return forecast.assemble(forecast.drift_forecast(frame, o), frame, o, cut(baselines.persistence_fan(frame)))


def add(name: str, columns: dict[str, int | None], steps=None, source: str | None = None, tail: str = ""):
    """Register a query; its twin selects the same columns from ``source`` after ``steps``."""

    def keep(build):
        QUERIES[name] = lambda spark, sf: rounded(build(spark, sf), columns)
        if steps is not None:
            ORACLE[name] = S.chain(steps, S.final(source, columns, tail))
        return build

    return keep


# ---- bars -------------------------------------------------------------------------------------
for _freq, _s in B.FREQ_SECONDS.items():
    add(f"bars_{_freq}", BAR_COLS, S.bars(_s), "bars")(lambda spark, sf, f=_freq: B.to_bars(fixtures.ticks(spark, sf), f))

add("bars_1m_loud", BAR_COLS, S.bars(60, loud=True), "bars")(lambda spark, sf: minute_bars(spark, sf, loud=True))
_NATIVE = {"ts": None, "open": 6, "high": 6, "low": 6, "close": 6, "mean": 6, "std": 6, "n_ticks": None, "is_gap": None}
add("bars_native_15m", _NATIVE, S.NATIVE_15M, "bars")(lambda spark, sf: B.to_bars(spark.read.parquet(f"{sf}/events.parquet"), "15m", every_tick=True))

_RUNS = [
    *S.bars(60), "g0 AS (SELECT ts, g // 60 - row_number() OVER (ORDER BY g) AS island FROM bars WHERE is_gap)",
    "runs AS (SELECT min(ts) AS start, count(*) AS length FROM g0 GROUP BY island)",
]
_DENSITY = [
    *S.bars(60, loud=True),
    "den AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(n_raw_ticks) AS BIGINT) AS raw, CAST(sum(n_ticks) AS BIGINT) AS sec, sum(n_raw_ticks) / sum(n_ticks) AS ratio, sum(n_raw_ticks) / sum(n_ticks) < 1.5 AS once_per_second FROM bars GROUP BY 1)",
]
add("gap_runs", {"start": None, "length": None}, _RUNS, "runs")(lambda spark, sf: audit.gap_runs(minute_bars(spark, sf)))
add("tick_density", {"day": None, "raw": None, "sec": None, "ratio": 7, "once_per_second": None}, _DENSITY, "den")(lambda spark, sf: audit.tick_density(minute_bars(spark, sf, loud=True)))
add("tick_histogram", {"n_ticks": None, "bars": None}, [*S.bars(60), "hist AS (SELECT n_ticks, count(*) AS bars FROM bars GROUP BY 1)"], "hist")(lambda spark, sf: audit.tick_histogram(minute_bars(spark, sf)))
_AUDIT = [
    *_RUNS,
    """aud AS (SELECT count(*) AS n_bars, count(*) FILTER (WHERE is_gap) AS n_gaps, count(*) FILTER (WHERE NOT is_full) AS n_not_full, count(*) - count(rv_1s) AS n_no_rv, min(ts) AS first_ts, max(ts) AS last_ts,
  (SELECT coalesce(max(length), 0) FROM runs) AS largest_gap_bars, (SELECT count(*) FROM (SELECT CAST(ts AS DATE), sum(n_raw_ticks) / sum(n_ticks) AS r FROM bars GROUP BY 1) WHERE r < 1.5) AS days_once_per_second,
  (SELECT count(*) FROM (SELECT CAST(ts AS DATE), sum(n_raw_ticks) / sum(n_ticks) AS r FROM bars GROUP BY 1) WHERE r >= 1.5) AS days_sub_second FROM bars)""",
]
add("bars_audit", dict.fromkeys(("n_bars", "n_gaps", "n_not_full", "n_no_rv", "first_ts", "last_ts", "largest_gap_bars", "days_once_per_second", "days_sub_second")), _AUDIT, "aud")(lambda spark, sf: audit.describe_bars(cut(minute_bars(spark, sf))))

# ---- frame ------------------------------------------------------------------------------------
_KEY = {"ts": None, "idx": None, "k": None}
_QUOTES = dict.fromkeys([f"yes_{s}_{x}" for s in ("bid", "ask") for x in ("open", "high", "low", "close")] + [f"trade_{x}" for x in ("open", "high", "low", "close", "mean")] + ["volume", "open_interest"], 6)
_FRAME = {
    "relabel_candles": {"ts": None, "ticker": None, "floor_strike": 4, **_QUOTES},
    "frame_core": {**_KEY, "t0": None, "date": None, "hour": None, "minute_of_day": None, "has_candle": None, "brti_close": 4, "brti_mean": 4, "n_ticks": None, "n_raw_ticks": None, "brti_is_gap": None, "brti_is_full": None},
    "frame_strike": {**_KEY, "strike": 4, "strike_from_brti": 4, "strike_imputed": None, "win_ticker": None},
    "frame_features": {**_KEY, "mid_close": 6, "mid_open": 6, "mid_high": 6, "mid_low": 6, "spread": 6, "ret_1m": 10, "moneyness": 10, "log_volume": 7, "log_oi": 7, "mid_ret_1m": 6, "sigma_1m": 10, "sigma_rv": 10, "vol_ratio": 7, "trade_close_imp": 6, "trade_mean_imp": 6, "target_valid": None, "is_settlement": None, "quote_ok": None},
    "frame_fair_value": {**_KEY, "rw_z": 6, "rw_z_rv": 6, "rw_p": 7, "rw_p_rv": 7, "rw_gap_rv": 7, "ret_l10_std": 6, "ret_l30_std": 6},
    "frame_outcomes": {**_KEY, "outcome_price": None, "outcome_brti": None},
}
for _name, _cols in _FRAME.items():
    if _name == "relabel_candles":
        continue
    add(_name, _cols, S.frame(), "frame")(lambda spark, sf: minute_frame(spark, sf))
add("relabel_candles", _FRAME["relabel_candles"], S.frame(), "frame", "WHERE has_candle")(lambda spark, sf: FR.relabel(fixtures.candles(minute_bars(spark, sf))).withColumnRenamed("bar_ts", "ts"))

_AUDIT_COLS = {"n_windows": None, "n_complete_windows": None, "n_windows_strike_imputed": None, "strike_err_p50": 4, "strike_err_p99": 4, "outcome_disagreement": 7, "n_rows": None, "n_rows_with_candle": None, "n_rows_no_sigma_rv": None, "n_rows_quote_degenerate": None}


def _frame_audit(shift: int) -> list[str]:
    return [
        *S.frame(shift=shift),
        "wn AS (SELECT t0, count(*) AS n, arg_min(strike_imputed, ts) AS si, arg_min(outcome_price, ts) AS op, arg_min(outcome_brti, ts) AS ob, abs(arg_min(floor_strike, ts) FILTER (WHERE floor_strike IS NOT NULL) - arg_min(strike_from_brti, ts)) AS e FROM frame WHERE has_candle GROUP BY t0)",
        """fad AS (SELECT count(*) AS n_windows, count(*) FILTER (WHERE n = 15) AS n_complete_windows, count(*) FILTER (WHERE si) AS n_windows_strike_imputed, quantile_disc(e, 0.5) AS strike_err_p50, quantile_disc(e, 0.99) AS strike_err_p99,
  avg(CASE WHEN op IS NOT NULL AND ob IS NOT NULL THEN CASE WHEN op <> ob THEN 1e0 ELSE 0e0 END END) AS outcome_disagreement, (SELECT count(*) FROM frame) AS n_rows, (SELECT count(*) FROM frame WHERE has_candle) AS n_rows_with_candle,
  (SELECT count(*) FROM frame WHERE sigma_rv IS NULL) AS n_rows_no_sigma_rv, (SELECT count(*) FROM frame WHERE has_candle AND target_valid AND NOT quote_ok) AS n_rows_quote_degenerate FROM wn)""",
    ]


add("frame_audit", _AUDIT_COLS, _frame_audit(0), "fad")(lambda spark, sf: audit.describe_frame(minute_frame(spark, sf)))
add("frame_audit_misaligned", _AUDIT_COLS, _frame_audit(1), "fad")(lambda spark, sf: audit.describe_frame(minute_frame(spark, sf, shift=1)))

# ---- origins ----------------------------------------------------------------------------------
add("origins_all", ORIGIN_COLS, S.origins(), "origins")(lambda spark, sf: all_origins(minute_frame(spark, sf)))
add("origins_quote_ok", ORIGIN_COLS, S.origins(quote=True), "origins")(lambda spark, sf: all_origins(minute_frame(spark, sf), require_quote_ok=True))
add("drop_report", {"drop_reason": None, "n": None}, [*S.origins(), "dr AS (SELECT drop_reason, count(*) AS n FROM origins WHERE NOT ok GROUP BY 1)"], "dr")(lambda spark, sf: O.drop_report(all_origins(minute_frame(spark, sf))))
add("origins_selected", ORIGIN_COLS, S.origins(), "origins", "WHERE m IN (0, 1, 2, 3, 4, 14) AND t0 >= TIMESTAMP '2024-01-01' AND t0 < TIMESTAMP '2024-01-02'")(
    lambda spark, sf: O.select_origins(all_origins(minute_frame(spark, sf)), minutes="0-4,14", start=dt.date(2024, 1, 1), end=dt.date(2024, 1, 1))
)
add("origins_stride_cap", ORIGIN_COLS, [*S.origins(), "st AS (SELECT * FROM origins WHERE (epoch_us(t0) // 900000000) % 2 = 0)", "kp AS (SELECT DISTINCT t0 FROM st WHERE ok ORDER BY t0 LIMIT 10)"], "st", "WHERE t0 IN (SELECT t0 FROM kp)")(
    lambda spark, sf: O.select_origins(all_origins(minute_frame(spark, sf)), stride_windows=2, max_windows=10)
)

# ---- baselines and forecasts ------------------------------------------------------------------
_HI = dt.datetime(2024, 1, 1, 12)
add("fan_fit", FAN_COLS, [*S.frame(), *S.fan()], "fan")(lambda spark, sf: baselines.persistence_fan(minute_frame(spark, sf)))
add("fan_fit_until", FAN_COLS, [*S.frame(), *S.fan(str(_HI))], "fan")(lambda spark, sf: baselines.persistence_fan(minute_frame(spark, sf), hi=_HI))
add("fan_fit_strict", FAN_COLS, [*S.frame(), *S.fan(str(_HI), strict=True)], "fan")(lambda spark, sf: baselines.persistence_fan(minute_frame(spark, sf), hi=_HI, strict=True))
add("fan_cells", {"cells": None}, [*S.frame(), *S.fan(), "cl AS (SELECT count(*) AS cells FROM fan WHERE bucket = -1 AND n >= 30)"], "cl")(lambda spark, sf: baselines.fan_cells(baselines.persistence_fan(minute_frame(spark, sf))))
_LONG = {"i": None, "h": None, "k": None, "median": 6, **dict.fromkeys(Q_COLS, 6), "actual": 6}


def _long(spark, sf):
    frame = minute_frame(spark, sf)
    return forecast.drift_forecast(frame, cut(all_origins(frame)))


add("forecast_stub_long", _LONG, S.forecasts(), "longf")(_long)
_ROW = {"i": None, "m": None, "h": None}
add("forecast_assembled", {**_ROW, "k": None, "t0": None, "date": None, "hour": None, "k_ctx": None, "median": 6, "actual": 6, "mean_fc": 6, "persist": 6, "rw_p": 7, "is_settlement": None, "m_group": None, "ticker": None, "outcome_price": None, "outcome_brti": None, "strike_imputed": None, "quote_ok": None, "n_ctx_gaps": None}, S.forecasts(), "fc")(assembled)
add("fan_apply", {**_ROW, **dict.fromkeys(FAN_Q_COLS, 7)}, S.forecasts(), "fc")(assembled)
add("vol_tercile", {**_ROW, "vol_bucket": None}, S.forecasts(), "fc")(assembled)
add("rw_fair_now", {"i": None, "m": None, "fair": 7}, [*S.origins(), f"fn AS (SELECT i, m, {baselines.fair_now()} AS fair FROM origins WHERE ok)"], "fn")(
    lambda spark, sf: all_origins(minute_frame(spark, sf)).where("ok").withColumn("fair", F.expr(baselines.fair_now()))
)
_FILTERED = [*S.metrics("", "quote_ok")]
add("rescore_quote_ok", METRICS, _FILTERED, "mm")(lambda spark, sf: metrics.metrics_by(assembled(spark, sf).where("quote_ok"), []))



def _model_long(spark, sf):
    """A forecaster from outside, run on Arrow batches of contexts: the drift of the closed form."""
    import numpy as np

    def predict(x, horizon):
        mid = x[:, -1:] + forecast.STEP * np.arange(1, horizon + 1)
        return mid, mid[:, :, None] + forecast.WIDTH * (np.arange(9) - 4)

    frame = minute_frame(spark, sf)
    o = cut(all_origins(frame))
    return forecast.model_forecast(frame, o, o.where("ok").selectExpr("i", "array(last_mid) AS target"), predict, horizon=16)


add("forecast_model_long", _LONG, S.forecasts(), "longf")(_model_long)


def _stored(spark, sf, quote_ok=False):
    """A run written to the shared folder, and its tables when scored anew from there."""
    frame = minute_frame(spark, sf)
    o, fan = cut(all_origins(frame)), cut(baselines.persistence_fan(frame))
    here = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    runs.store_run(forecast.assemble(forecast.drift_forecast(frame, o), frame, o, fan), fan, {"context": CONTEXT, "max_gap_frac": GAP}, f"{here}/first")
    return here, runs.rescore(spark, f"{here}/first", f"{here}/again", require_quote_ok=quote_ok)


add("run_rescored", METRICS, _FILTERED, "mm")(lambda spark, sf: _stored(spark, sf, True)[1]["metrics_overall"])
add("run_summary", {"line": None})(lambda spark, sf: spark.read.text(f"{_stored(spark, sf)[0]}/again/summary").withColumnRenamed("value", "line"))
add("error_by_h", {"h": None, "rmse_c": 7, "rmse_c_persist": 7, "mae_c": 7, "mae_c_persist": 7, "lo": 7, "hi": 7})(lambda spark, sf: runs.error_by_h(assembled(spark, sf)))

_EVAL = dt.date(2024, 1, 1)


def _backtest(spark, sf):
    """A whole run by its settings, written to the shared folder."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    config = Config({"origins": {"context": CONTEXT, "max_gap_frac": GAP, "minutes": "0-9"}, "run": {"start": str(_EVAL), "end": str(_EVAL), "stride_windows": 2, "bootstrap_days": 100}}, {})
    return path, runs.backtest_of(config, minute_frame(spark, sf), forecast.drift_forecast, path)


_RUN = [*S.origins(), f"ro AS (SELECT * FROM origins WHERE m <= 9 AND t0 >= TIMESTAMP '{_EVAL}' AND t0 < TIMESTAMP '{_EVAL}' + INTERVAL 1 DAY AND (epoch_us(t0) // 900000000) % 2 = 0)"]
add("run_drops", {"drop_reason": None, "n": None}, [*_RUN, "rdr AS (SELECT drop_reason, count(*) AS n FROM ro WHERE NOT ok GROUP BY 1)"], "rdr")(lambda spark, sf: _backtest(spark, sf)[1]["drops"])


def _fan_policy(spark, sf):
    """Where the fan comes from for evaluations that start at three times, and its pooled cells."""
    frame, out = minute_frame(spark, sf), None
    for at in (_T0, _T1, dt.datetime(2023, 6, 1)):
        fan, info = baselines.fit_fan(frame, at)
        cells = spark.range(1).selectExpr("0L AS cells") if fan is None else baselines.fan_cells(fan)
        t = cells.selectExpr(f"TIMESTAMP_NTZ'{at}' AS eval_start", f"'{info['fan_mode']}' AS mode", "cells")
        out = t if out is None else out.unionByName(t)
    return out


def _fan_policy_sql() -> list[str]:
    steps, parts = [*S.frame()], []
    pooled = lambda name, low, high: f"{name} AS (SELECT count(*) AS cells FROM (SELECT a.k, b.idx - a.idx AS h FROM frame a JOIN frame b ON b.idx - a.idx BETWEEN 1 AND 15 WHERE b.idx - a.idx <= 15 - (a.k + 1) % 15 AND b.mid_close IS NOT NULL AND (a.k = 14 OR a.mid_close IS NOT NULL) AND a.ts >= {low} AND a.ts < {high} GROUP BY ALL HAVING count(*) >= {baselines.MIN_FAN_N}))"
    for n, at in enumerate((_T0, _T1, dt.datetime(2023, 6, 1))):
        t = f"TIMESTAMP '{at}'"
        steps += [pooled(f"pre{n}", f"{t} - INTERVAL 30 DAY", t), pooled(f"own{n}", t, f"{t} + INTERVAL 30 DAY")]
        good = [f"(SELECT cells FROM {x}{n}) >= {baselines.MIN_FAN_CELLS}" for x in ("pre", "own")]
        parts.append(f"SELECT {t} AS eval_start, CASE WHEN {good[0]} THEN 'pre_period' WHEN {good[1]} THEN 'in_sample_head' ELSE 'point' END AS mode, CASE WHEN {good[0]} THEN (SELECT cells FROM pre{n}) WHEN {good[1]} THEN (SELECT cells FROM own{n}) ELSE 0 END AS cells")
    return [*steps, "fpo AS (" + " UNION ALL ".join(parts) + ")"]


# ---- scores -----------------------------------------------------------------------------------
for _name, _by in {"overall": "", "by_h": "h", "by_m": "m", "by_mh": "m, h", "by_mgroup": "m_group", "by_hour": "hour", "by_vol": "vol_bucket"}.items():
    _keys = [x for x in _by.split(", ") if x]
    add(f"metrics_{_name}", {**dict.fromkeys(_keys), **METRICS}, S.metrics(_by), "mm")(lambda spark, sf, keys=_keys: metrics.metrics_by(assembled(spark, sf), keys))
add("metrics_not_settlement", METRICS, S.metrics("", "NOT is_settlement"), "mm")(lambda spark, sf: metrics.metrics_by(assembled(spark, sf).where("NOT is_settlement"), []))
_CAL = {"bin_lo": None, "bin_hi": None, "n": None, "p_mean": 7, "freq_up": 7, "gap": 7, "se": 7}
for _src, _col in metrics.SOURCES.items():
    add(f"calibration_{_src}", _CAL, [*S.scored(), *S.calibration(_col)], "cal")(lambda spark, sf, c=_col: metrics.calibration(metrics.scored(assembled(spark, sf)), c))
add("settlement_calibration", {**_CAL, "source": None}, [*S.scored(), *(x for s, c in metrics.SOURCES.items() for x in S.calibration(c, name=f"cal_{s}")), "sall AS (" + " UNION ALL ".join(f"SELECT *, '{s}' AS source FROM cal_{s}" for s in metrics.SOURCES) + ")"], "sall")(lambda spark, sf: metrics.settlement_calibration(assembled(spark, sf)))
add("settlement_scores", {c: METRICS[c] for c in METRICS if c.startswith("settle_")}, S.metrics(""), "mm")(lambda spark, sf: metrics.metrics_by(assembled(spark, sf), []))
add("ece", {"ece": 7}, [*S.scored(), *S.calibration("mean_fc"), "ee AS (SELECT sum(n * abs(gap)) / sum(n) AS ece FROM cal)"], "ee")(lambda spark, sf: metrics.ece(metrics.scored(assembled(spark, sf)), "mean_fc"))
add("pit_ks", {"h": None, "pit_ks": 7}, S.metrics("h"), "mm")(lambda spark, sf: metrics.pit_ks(metrics.scored(assembled(spark, sf)), ["h"]))
add("pit_histogram", {"bin": None, "n": None}, [*S.scored(), "ph AS (SELECT least(floor(u * 20), 19) AS bin, count(*) AS n FROM sc GROUP BY 1)"], "ph")(lambda spark, sf: metrics.pit_histogram(assembled(spark, sf)))
add("skill_grid", {"m": None, "h": None, "skill_mse": 7}, S.metrics("m, h"), "mm")(lambda spark, sf: metrics.skill_grid(assembled(spark, sf)))
_COVER = "cv AS (" + " UNION ALL ".join(f"SELECT m_group, avg(CASE WHEN actual >= q{lo} AND actual <= q{hi} THEN 1e0 ELSE 0e0 END) AS coverage, count(*) AS n, {nom}e0 AS nominal FROM fc GROUP BY 1" for lo, hi, nom in ((10, 90, 0.8), (20, 80, 0.6), (30, 70, 0.4), (40, 60, 0.2))) + ")"
add("coverage_by_mgroup", {"m_group": None, "coverage": 7, "n": None, "nominal": 1}, [*S.forecasts(), _COVER], "cv")(lambda spark, sf: metrics.coverage_by(assembled(spark, sf)))
_SUMS = "ds AS (SELECT date, h, " + ", ".join(f"sum({c}) AS {c}" for c in ("se", "se_p", "ae", "ae_p", "pb", "pb_f")) + ", CAST(count(*) AS DOUBLE) AS one FROM sc GROUP BY date, h)"
add("day_sufficient_stats", {"date": None, "h": None, **dict.fromkeys(("se", "se_p", "ae", "ae_p", "pb", "pb_f", "one"), 6)}, [*S.scored(), _SUMS], "ds")(lambda spark, sf: metrics.day_statistics(assembled(spark, sf), "h"))
add("trajectories", {"t0": None, "m": None, "h": None, "q10": 6, "median": 6, "q90": 6, "actual": 6}, [*S.forecasts(), "tw AS (SELECT DISTINCT t0 FROM fc WHERE m IN (0, 5, 10) AND (epoch_us(t0) // 900000000) % 7 = 0 ORDER BY t0 LIMIT 12)"], "fc", "WHERE m IN (0, 5, 10) AND t0 IN (SELECT t0 FROM tw)")(lambda spark, sf: metrics.trajectories(assembled(spark, sf)))


def _bootstrap(spark, sf):
    f = assembled(spark, sf)
    return bootstrap.bootstrap_by(f, "h").unionByName(bootstrap.bootstrap_by(f, "m_group"))


add("bootstrap", {"by": None, "key": None, "stat": None, "lo": 7, "hi": 7, "n_days": None})(_bootstrap)

# ---- splits -----------------------------------------------------------------------------------
_T0, _T1, _T2, _T3 = (dt.datetime(2024, 1, 1, *x) for x in ((0, 0), (12, 0), (17, 0), (23, 0)))
_GAP = dt.timedelta(minutes=15)
BOUNDS = splits.Bounds((_T0, _T1 - _GAP), (_T1, _T2 - _GAP), (_T2, _T3))
_CASES = " ".join(f"WHEN i + 1 >= {int((lo - _T0).total_seconds() // 60)} AND i + n_steps < {int((hi - _T0).total_seconds() // 60)} THEN '{n}'" for n, (lo, hi) in (("train", BOUNDS.train), ("val", BOUNDS.val), ("test", BOUNDS.test)))
add("split_assign", {"i": None, "n_steps": None, "split": None}, [*S.origins(), f"sp AS (SELECT *, CASE {_CASES} END AS split FROM origins WHERE ok)"], "sp")(lambda spark, sf: splits.assign_splits(all_origins(minute_frame(spark, sf)).where("ok"), _T0, BOUNDS))


def _split_bounds(spark, sf):
    low, high = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    b = splits.split_bounds(low, high)
    return spark.range(3).selectExpr("element_at(array('train', 'val', 'test'), CAST(id AS INT) + 1) AS split", *[f"CAST(element_at(array({', '.join(repr(str(getattr(b, s)[j])) for s in splits.SPLITS)}), CAST(id AS INT) + 1) AS TIMESTAMP_NTZ) AS {name}" for j, name in enumerate(("lo", "hi"))])


_AT = lambda share: f"CAST(CAST(min(ts) + (max(ts) - min(ts)) * {share} + INTERVAL 12 HOUR AS DATE) AS TIMESTAMP)"
_SB = f"sb AS (SELECT min(ts) AS a, max(ts) AS z, {_AT('0.85e0')} AS t, {_AT('0.7e0')} AS v FROM events)"
_SB2 = "sx AS (SELECT 'train' AS split, a AS lo, v - INTERVAL 15 MINUTE AS hi FROM sb UNION ALL SELECT 'val', v, t - INTERVAL 15 MINUTE FROM sb UNION ALL SELECT 'test', t, z FROM sb)"
add("split_bounds", {"split": None, "lo": None, "hi": None}, [_SB, _SB2], "sx")(_split_bounds)


def _split_eval(spark, sf):
    frame = minute_frame(spark, sf)
    o = cut(all_origins(frame))
    s = splits.assign_splits(o.where("ok"), _T0, BOUNDS).select("i", "split")
    return splits.split_scores(assembled(spark, sf).join(s, "i"))


add("split_eval", {"split": None, "n": None, "pinball_c": 7, "pinball_c_fan": 7, "mae_c": 7, "scaled_loss": 7}, [*S.scored(), f"se_ AS (SELECT CASE {_CASES} END AS split, count(*) AS n, 100e0 * avg(pb) AS pinball_c, 100e0 * avg(pb_f) AS pinball_c_fan, 100e0 * avg(ae) AS mae_c, avg(pb / greatest(fan_q90 - fan_q10, 0.01e0)) AS scaled_loss FROM sc GROUP BY 1)"], "se_", "WHERE split IS NOT NULL")(_split_eval)
add("subsample", {"i": None, "m": None}, [*S.origins(), "sr AS (SELECT i, m, row_number() OVER (PARTITION BY m ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY m) AS n FROM origins WHERE ok)", "pk AS (SELECT DISTINCT m, CASE WHEN n <= 7 THEN j ELSE round_even(j * (n - 1) / 6e0, 0) END AS r FROM sr, range(greatest(7, n)) q(j) WHERE n <= 7 OR j < 7)"], "sr", "WHERE EXISTS (SELECT 1 FROM pk WHERE pk.m = sr.m AND pk.r = sr.r)")(
    lambda spark, sf: splits.subsample(all_origins(minute_frame(spark, sf)).where("ok"), "i", 7, "m")
)

_TRAIN = [*S.origins(), f"tr AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS number, count(*) OVER () AS n FROM (SELECT i, CASE {_CASES} END AS split FROM origins WHERE ok) WHERE split = 'train')"]


def _epochs(spark, sf):
    s = splits.assign_splits(all_origins(minute_frame(spark, sf)).where("ok"), _T0, BOUNDS).where("split = 'train'").select("i")
    return splits.epochs(s, "i", 0, 2, 64, seed=11, start=100)


_PLACE = splits.shuffled_place("number", "n", 11, "epoch", lambda start, rounds, step: f"list_reduce(list_prepend(CAST({start} AS BIGINT), range(1, {rounds + 1})), lambda a, r: {step})", "//")
add("epoch_batches", {"i": None, "epoch": None, "place": None, "batch": None}, [*_TRAIN, f"ep AS (SELECT i, epoch, epoch * n + {_PLACE} AS place FROM tr, range(3) q(epoch))", "eb AS (SELECT *, place // 64 AS batch FROM ep WHERE place >= 100)"], "eb")(_epochs)

# ---- covariates -------------------------------------------------------------------------------
add("calendar_features", {"idx": None, **dict.fromkeys(covariates.CALENDAR, 8)}, [*S.frame(), f"cf AS (SELECT idx, {S.calendar()} FROM frame)"], "cf")(lambda spark, sf: minute_frame(spark, sf).selectExpr("idx", *[f"{e} AS {c}" for c, e in covariates.calendar_exprs().items()]))
for _p in ("full", "full_rv"):
    _cols = {c: 6 for c in covariates.PRESETS[_p][0]}
    add(f"po_covariates_{_p}", {"idx": None, **_cols}, [*S.frame(), f"pc AS (SELECT idx, {S.past_covariates(_p)} FROM frame)"], "pc")(lambda spark, sf, p=_p: covariates.past_covariates(minute_frame(spark, sf), p))
_Z = "(CASE WHEN sigma_1m > 0 AND brti_close > 0 AND strike > 0 THEN greatest(-8e0, least(8e0, ln(brti_close / strike) / (sigma_1m * sqrt(CASE WHEN kf >= 14 THEN 1e-4 ELSE (13 - kf) + 1e0 / 3e0 END)))) ELSE 0e0 END)"
add("fair_path", {"i": None, "step": None, "fair": 7}, [*S.origins(), "fs AS (SELECT i, step, brti_close, strike, sigma_1m, (k_ctx + least(step, n_steps)) % 15 AS kf FROM origins, range(1, 65) q(step) WHERE ok)", f"fp AS (SELECT i, step, {S.norm_cdf(_Z)} AS fair FROM fs)"], "fp")(lambda spark, sf: covariates.fair_path(all_origins(minute_frame(spark, sf))))
_INTERP = [
    *S.frame(), "cx AS (SELECT a.idx AS i, b.idx - a.idx + 31 AS pos, b.mid_close AS raw FROM frame a JOIN frame b ON b.idx BETWEEN a.idx - 31 AND a.idx WHERE a.idx >= 31)",
    """cy AS (SELECT *, last_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(raw IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, first_value(raw IGNORE NULLS) OVER f AS v1
  FROM cx WINDOW b AS (PARTITION BY i ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY i ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "cz AS (SELECT i, pos, CASE WHEN raw IS NOT NULL THEN raw WHEN p0 IS NULL AND p1 IS NULL THEN 0e0 WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END AS value FROM cy)",
]
add("interp_context", {"i": None, "pos": None, "value": 6}, _INTERP, "cz")(lambda spark, sf: covariates.interp_context(minute_frame(spark, sf), "mid_close", CONTEXT))


_SUM = "aggregate({}, 0e0, (a, x) -> a + CASE WHEN isnan(x) THEN 0e0 ELSE CAST(x AS DOUBLE) END)"


def _of_tensors(spark, sf, make=covariates.tensors):
    frame = minute_frame(spark, sf)
    return make(frame, all_origins(frame), CONTEXT)


_CELLS = [*S.origins(), *S.tensor_cells(CONTEXT)]
_SHAPES = f"tz AS (SELECT i, {CONTEXT} AS context, {len(covariates.PRESETS['full'][0])} AS n_past, {len(covariates.CALENDAR) + 1} AS n_future, {CONTEXT + 64} AS width, CAST(sum(flats) AS INTEGER) AS n_flat, sum(CASE WHEN name = 'target' THEN total END) AS target_sum FROM cell_sums GROUP BY i)"
add("tensors_c32", {"i": None, "context": None, "n_past": None, "n_future": None, "width": None, "n_flat": None, "target_sum": 3}, [*_CELLS, _SHAPES], "tz")(
    lambda spark, sf: _of_tensors(spark, sf).selectExpr("i", "size(target) AS context", "size(past) AS n_past", "size(future) AS n_future", "size(future[0]) AS width", "n_flat", f"{_SUM.format('target')} AS target_sum")
)
add("tensor_sums", {"i": None, "name": None, "total": 3}, _CELLS, "cell_sums")(
    lambda spark, sf: _of_tensors(spark, sf, covariates.tensor_sums)
)


def _blend(targets, steps, past, future):
    """Half the last price, some of the fair value ahead and of the ask, spread by the last spread."""
    import numpy as np

    names = covariates.PRESETS["full"][0]
    at = lambda c: past[:, names.index(c), -1:].astype(np.float64)
    mid = 0.5 * targets[:, -1:].astype(np.float64) + 0.3 * future[:, -1, targets.shape[1] :].astype(np.float64) + 0.2 * at("yes_ask_close")
    return mid, mid[:, :, None] + 0.25 * at("spread")[:, :, None] * (np.arange(9) - 4)


def _covariate_long(spark, sf):
    frame = minute_frame(spark, sf)
    return forecast.covariate_forecast(frame, cut(all_origins(frame)), _blend, CONTEXT, horizon=15)


_AT = lambda n, c, pos: f"JOIN cells {n} ON {n}.i = l.i AND {n}.name = '{c}' AND {n}.pos = {pos}"
_MID = "(0.5e0 * CAST(t.x AS DOUBLE) + 0.3e0 * CAST(f.x AS DOUBLE) + 0.2e0 * CAST(a.x AS DOUBLE))"
_UNIT = lambda e: f"greatest(0e0, least(1e0, {e}))"
_BLEND = f"bl AS (SELECT l.i, l.h, l.k, l.actual, {_UNIT(_MID)} AS median, list_sort([{', '.join(_UNIT(f'{_MID} + 0.25e0 * CAST(s.x AS DOUBLE) * {j - 4}') for j in range(9))}]) AS q_ FROM longf l {_AT('t', 'target', CONTEXT - 1)} {_AT('a', 'yes_ask_close', CONTEXT - 1)} {_AT('s', 'spread', CONTEXT - 1)} {_AT('f', 'rw_fair_path', f'{CONTEXT - 1} + l.h')})"
_BLENDED = [*S.forecasts(), *S.tensor_cells(CONTEXT), _BLEND, f"bq AS (SELECT i, h, k, actual, median, {', '.join(f'q_[{j + 1}] AS {c}' for j, c in enumerate(Q_COLS))} FROM bl)"]
add("forecast_covariates_long", _LONG, _BLENDED, "bq")(_covariate_long)

# ---- signals ----------------------------------------------------------------------------------
_V, _T = "2024-01-01 10:00:00", "2024-01-01 16:00:00"
_signal = lambda spark, sf: cut(signals.signal_frame(minute_frame(spark, sf), _V, _T))
add("vol_forecast_quality", {"split": None, "sigma": None, "corr_log": 5, "qlike_rv": 5, "qlike_r2": 5, "n": None}, [*S.signals(_V, _T), f"vq AS ({S.vol_quality()})"], "vq")(lambda spark, sf: signals.vol_quality(_signal(spark, sf)))
add("ols_gap", {"h": None, "gap": None, "split": None, "slope": 6, "skill": 6, "n": None}, [*S.signals(_V, _T), f"og AS ({S.ols()})"], "og")(lambda spark, sf: signals.ols_gap(_signal(spark, sf)))
add("trade_sim", {"h": None, "threshold": 2, "split": None, "trades": None, "gross_c": 6, "net_c": 6, "pnl_c": 6, "hit": 6}, [*S.signals(_V, _T), f"ts_ AS ({S.trades()})"], "ts_")(lambda spark, sf: signals.trade_sim(_signal(spark, sf)))
add("ols_days", {"h": None, "gap": None, "split": None, "date": None, "n": None, "se": 7, "se_0": 7}, [*S.signals(_V, _T), f"od AS ({S.ols_days()})"], "od")(lambda spark, sf: signals.ols_days(_signal(spark, sf)))
add("trade_days", {"h": None, "threshold": 2, "split": None, "date": None, "trades": None, "pnl": 6}, [*S.signals(_V, _T), f"td AS ({S.trade_days()})"], "td")(lambda spark, sf: signals.trade_days(_signal(spark, sf)))
_CI = {"stat": None, "lo": 6, "hi": 6, "n_days": None}
add("ols_intervals", {"h": None, "gap": None, "split": None, **_CI})(lambda spark, sf: signals.ols_intervals(_signal(spark, sf)))
add("trade_intervals", {"h": None, "threshold": 2, "split": None, **_CI})(lambda spark, sf: signals.trade_intervals(_signal(spark, sf)))
add("gbt_importances", {"place": None, "feature": None, "share": 4})(lambda spark, sf: signals.gbt_importances(_signal(spark, sf)))
add("gbt_signal", {"split": None, "n": None, "skill": 4})(lambda spark, sf: signals.gbt_signal(_signal(spark, sf)))
add("gbt_comparison", {"h": None, "features": None, "split": None, "n": None, "skill": 4, "lo": 4, "hi": 4, "n_days": None})(lambda spark, sf: signals.gbt_comparison(_signal(spark, sf)))
_RECAL = [*S.signals(_V, _T), *S.recalibration()]
add("recal_days", {"features": None, "split": None, "date": None, "n": None, "se": 6, "se_0": 6}, [*_RECAL, "rdy AS (SELECT features, split, date, count(*) AS n, sum(power(p - y, 2)) AS se, sum(power(mid_close - y, 2)) AS se_0 FROM rcd GROUP BY ALL)"], "rdy")(lambda spark, sf: signals.recalibration_days(_signal(spark, sf)))
add("recal_intervals", {"features": None, "split": None, **_CI})(lambda spark, sf: signals.recalibration_intervals(_signal(spark, sf)))
add("logit_recal", {"features": None, "split": None, "n": None, "bss": 4}, [*_RECAL, "rcb AS (SELECT features, split, count(*) AS n, 1e0 - sum(power(p - y, 2)) / sum(power(mid_close - y, 2)) AS bss FROM rcd GROUP BY ALL)"], "rcb")(lambda spark, sf: signals.logit_recalibration(_signal(spark, sf)))

add("fan_policy", {"eval_start": None, "mode": None, "cells": None}, _fan_policy_sql(), "fpo")(_fan_policy)

# ---- streaming and ingestion ------------------------------------------------------------------
_STREAM = [
    "sb AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, ts, value FROM events)",
    "sw AS (SELECT b AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, avg(value) AS mean, count(*) AS n_ticks FROM sb GROUP BY b)",
    "sc AS (SELECT * FROM sw WHERE ts + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)",
]
add("stream_bars_15m", {"ts": None, "open": 6, "high": 6, "low": 6, "close": 6, "mean": 6, "n_ticks": None}, _STREAM, "sc")(lambda spark, sf: stream.bars_of_available(spark, sf))


_CLOSED = [*S.bars(60), "sf_ AS (SELECT * FROM bars WHERE g + 60 <= (SELECT max(s) FROM ticks) - 600)"]
add("stream_bars_full_1m", BAR_COLS, _CLOSED, "sf_")(lambda spark, sf: stream.full_bars_of_available(spark, fixtures.ticks(spark, sf)))


def _streams(spark, sf):
    """The events as recorded streams, a file a day, in the shared folder."""
    path = f"{shared_dir(spark)}/streams-{uuid.uuid4().hex}"
    wire.record(spark.read.parquet(f"{sf}/events.parquet").select("ts", "value"), path)
    return path


_DAYS = ["rd AS (SELECT ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06')"]
add("recorded_days", {"ts": None, "value": 6}, _DAYS, "rd")(lambda spark, sf: wire.recorded(spark, _streams(spark, sf), start=dt.date(2024, 1, 3), end=dt.date(2024, 1, 5)))
add("recorded_predicate", {"ts": None, "value": 6}, ["rp AS (SELECT ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-05')"], "rp")(
    lambda spark, sf: wire.recorded_source(spark, _streams(spark, sf)).where("ts >= TIMESTAMP_NTZ'2024-01-03 06:00:00' AND ts < TIMESTAMP_NTZ'2024-01-05 00:00:00'")
)


def _ingested(spark, sf):
    """The days of the events fetched from their streams; every fifth fails, every third breaks off."""
    import os

    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "value")
    path, here = _streams(spark, sf), f"{shared_dir(spark)}/ingested-{uuid.uuid4().hex}"

    def open_stream(day: str):
        from pyarrow import fs

        if int(day[-2:]) % 5 == 0:
            raise ConnectionError("no route")
        files, top = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for f in files.get_file_info(fs.FileSelector(f"{top}/date={day}")):
            if not os.path.basename(f.path).startswith(("_", ".")):
                with files.open_input_stream(f.path) as lines:
                    text = lines.read().decode().splitlines()
                yield from text[: len(text) // 2] if int(day[-2:]) % 3 == 0 else text

    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    report = manifest.ingest(spark, open_stream, manifest.candidate_days(spark, str(low.date()), str(high)), str(high), f"{here}/ticks", f"{here}/manifest", manifest.Retry(attempts=1))
    stored = store.read_days(spark, f"{here}/ticks").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("stored"))
    return report.select("day", "ok", "state").join(stored, "day", "left").join(manifest.load(spark, f"{here}/manifest").select("day", "complete"), "day", "left")


_INGESTED = [
    "dy AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)",
    """dz AS (SELECT CAST(g AS DATE) AS day, coalesce(n, 0) AS n, CASE WHEN day(g) % 5 = 0 THEN 'failed' WHEN day(g) % 3 = 0 OR n IS NULL THEN 'broken' ELSE 'whole' END AS state
  FROM (SELECT unnest(generate_series((SELECT min(day) FROM dy), (SELECT max(day) FROM dy), INTERVAL 1 DAY)) AS g) LEFT JOIN dy ON dy.day = CAST(g AS DATE))""",
    "di AS (SELECT day, state = 'whole' AS ok, state, CASE WHEN state = 'whole' THEN n END AS stored, CASE WHEN state = 'failed' THEN NULL ELSE state = 'whole' AND day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) END AS complete FROM dz)",
]
add("ingested_days", {"day": None, "ok": None, "state": None, "stored": None, "complete": None}, _INGESTED, "di")(_ingested)


def _sse(spark, sf):
    """Events written as stream lines and read back through the frame parser and typed rows."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    no = "event_id * 4"
    lines = e.selectExpr("to_date(ts) AS file", f"explode(array(named_struct('no', {no}, 'line', ': keep-alive'), named_struct('no', {no} + 1, 'line', concat('data: {{\"ts\": \"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z\",')), named_struct('no', {no} + 2, 'line', concat('data: \"value\": ', CAST(value AS STRING), '}}')), named_struct('no', {no} + 3, 'line', ''))) AS x".replace("{{", "{").replace("}}", "}"))
    frames = wire.event_frames(lines.select("file", "x.no", "x.line"))
    return wire.rows_of_json(frames.where("event = 'message'"), "data", wire.TICKS)


add("sse_parse", {"ts": None, "value": 6}, ["ep AS (SELECT ts, value FROM events)"], "ep")(_sse)


def _plan(spark, sf):
    days = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"))
    have = days.where("day(day) % 3 <> 0").selectExpr("day", "rows", "day(day) % 5 <> 0 AS complete", "day(day) % 7 <> 0 AS file_exists")
    last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0]
    return manifest.plan_days(manifest.candidate_days(spark, "2024-01-01", str(last)), have, str(last))


_PLAN = [
    "dd AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS DATE) AS day)",
    "hv AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE day(ts) % 3 <> 0 AND day(ts) % 5 <> 0 AND day(ts) % 7 <> 0)",
    "pl AS (SELECT day FROM dd WHERE day NOT IN (SELECT day FROM hv) OR day = (SELECT CAST(max(ts) AS DATE) FROM events))",
]
add("manifest_plan", {"day": None}, _PLAN, "pl")(_plan)
add("table_bounds", {"n": None, "first_ts": None, "last_ts": None}, ["tb AS (SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events)"], "tb")(lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
