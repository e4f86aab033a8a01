"""Stored runs: forecasts, baselines and every score table on disk, a text summary, scoring anew.

A run is a folder: ``forecasts`` (zstd), ``baselines`` (the fan), ``drops``, one folder a table,
``meta`` and ``metrics`` (JSON lines) and ``summary`` (text). Everything is written by
Spark, so a run may live wherever Spark writes.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..session import cut
from . import bootstrap, metrics
from .baselines import fit_fan
from .forecast import add_baselines, assemble
from .origins import OriginSpec, drop_report, make_origins, select_origins

GROUPINGS = {"overall": [], "by_h": ["h"], "by_m": ["m"], "by_mh": ["m", "h"], "by_mgroup": ["m_group"], "by_hour": ["hour"], "by_vol": ["vol_bucket"]}
HEADLINES = ("n", "n_windows", "rmse_c", "rmse_c_persist", "skill_mse", "mae_c", "skill_mae", "pinball_c", "skill_pinball", "cover80", "width80_c", "pit_ks", "dir_acc")
SETTLED = ("settle_n", "settle_brier", "settle_brier_persist", "settle_brier_rw", "settle_bss_persist", "settle_logloss", "settle_ece")


def score_tables(forecasts: DataFrame, n_boot: int = 1000, seed: int = 0) -> tuple[dict[str, DataFrame], dict]:
    """Every table of a run, and its span, from three readings of the forecasts."""
    sets = metrics.ScoreSets(forecasts, {**GROUPINGS, "not_settlement": []}, {"not_settlement": "NOT is_settlement"})
    out = {f"metrics_{name}": sets.metrics(name) for name in sets.sets}
    out["bootstrap"] = bootstrap.bootstrap_sums(sets.day_sums("by_h"), "h", n_boot, seed).unionByName(bootstrap.bootstrap_sums(sets.day_sums("by_mgroup"), "m_group", n_boot, seed))
    out["settlement_calibration"] = sets.calibrations("overall")
    return out, sets.span("overall")


def error_by_h(forecasts: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Error against steps ahead, with the day-block interval of the mean absolute error."""
    sets = metrics.ScoreSets(forecasts, {"by_h": ["h"]})
    ends = bootstrap.bootstrap_sums(sets.day_sums("by_h"), "h", n_boot, seed).where("stat = 'mae_c'").selectExpr("CAST(key AS INT) AS h", "lo", "hi")
    return sets.metrics("by_h").select("h", "rmse_c", "rmse_c_persist", "mae_c", "mae_c_persist").join(ends, "h", "left")


def _text(spark: SparkSession, lines: Iterable[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def _number(x) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    return f"{x:.4f}" if isinstance(x, float) else str(x)


def layout(rows: list[dict], columns: Iterable[str]) -> list[str]:
    """Rows as right-aligned text columns."""
    columns = list(columns)
    cells = [columns] + [[_number(r.get(c)) for c in columns] for r in rows]
    wide = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return ["  ".join(x.rjust(w) for x, w in zip(r, wide, strict=True)) for r in cells]


def summary(tables: dict[str, DataFrame], info: dict) -> list[str]:
    """Lines of a report. Only tables of a few rows (hours, minutes, steps) reach the driver."""
    rows = lambda name, *by: [r.asDict() for r in (tables[name].orderBy(*by) if by else tables[name]).collect()]
    parts: list[tuple[str, list[str]]] = [("run", [f"{k}: {info[k]}" for k in sorted(info)]), ("overall", layout(rows("metrics_overall"), HEADLINES)), ("without settlement", layout(rows("metrics_not_settlement"), HEADLINES))]
    for title, name, key in (("by steps ahead", "by_h", "h"), ("by minute of origin", "by_m", "m"), ("by hour", "by_hour", "hour"), ("by volatility, calm first", "by_vol", "vol_bucket")):
        parts.append((title, layout(rows(f"metrics_{name}", key), (key, *HEADLINES))))
    grid: dict[int, dict] = {}
    for r in rows("metrics_by_mh", "m", "h"):
        grid.setdefault(r["m"], {"m": r["m"]})[f"h={r['h']}"] = r["skill_mse"]
    steps = sorted({c for r in grid.values() for c in r if c != "m"}, key=lambda c: int(c[2:]))
    parts.append(("skill_mse, minutes by steps", layout(list(grid.values()), ("m", *steps))))
    parts.append(("settlement, as a probability", layout(rows("metrics_overall"), SETTLED)))
    parts.append(("settlement by minute of origin", layout(rows("metrics_by_m", "m"), ("m", *SETTLED))))
    wide: dict[str, dict] = {}
    for r in rows("bootstrap", "by", "key", "stat"):
        wide.setdefault(f"{r['by']}={r['key']}", {"group": f"{r['by']}={r['key']}"}).update({f"{r['stat']}_lo": r["lo"], f"{r['stat']}_hi": r["hi"]})
    ends = [f"{r.name}_{e}" for r in bootstrap.RATIOS for e in ("lo", "hi")]
    parts.append(("95 % day-block intervals; one that holds 0 shows no edge", layout(list(wide.values()), ("group", *ends))))
    return [line for title, lines in parts for line in (f"== {title} ==", *lines, "")]


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``: a reader finds either whole, and what breaks off in
    between is ``path`` with ``.old`` behind it, which ``load_run`` knows."""
    (to, fs), (made, _), (old, _) = (_place(spark, x) for x in (path, new, f"{path}.old"))
    fs.delete(old, True)
    if fs.exists(to):
        fs.rename(to, old)
    if not fs.rename(made, to):
        raise OSError(f"{new} can't be renamed to {path}")
    fs.delete(old, True)


def store_run(forecasts: DataFrame, fan: DataFrame | None, config: dict, path: str, n_boot: int = 1000, seed: int = 0, drops: DataFrame | None = None, provenance: dict | None = None) -> dict[str, DataFrame]:
    """Write the run and return its tables, read back. Everything is written beside ``path`` and takes its
    place when it is whole. ``drops``: why origins were dropped; ``provenance``: where the fan is from."""
    spark, new = forecasts.sparkSession, f"{path}.new"
    at, fs = _place(spark, new)
    fs.delete(at, True)
    forecasts.write.option("compression", "zstd").parquet(f"{new}/forecasts")
    if fan is not None:
        fan.write.parquet(f"{new}/baselines")
    forecasts = spark.read.parquet(f"{new}/forecasts")
    tables = {}
    scores, span = score_tables(forecasts, n_boot, seed)
    for name, table in (scores | ({} if drops is None else {"drops": drops})).items():
        table.write.parquet(f"{new}/{name}")
        tables[name] = spark.read.parquet(f"{new}/{name}")
    info = {"config": config, "has_fan": fan is not None, "n_boot": n_boot, "seed": seed, "provenance": provenance or {}, "tables": sorted(tables)}
    _text(spark, [json.dumps(info, default=str)], f"{new}/meta")
    for name in ("overall", "by_h", "by_m"):
        tables[f"metrics_{name}"].coalesce(1).write.mode("overwrite").json(f"{new}/metrics/{name}")
    _text(spark, summary(tables, config | (provenance or {}) | span), f"{new}/summary")
    publish(spark, new, path)
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}


def run_backtest(frame: DataFrame, forecast: Callable[[DataFrame, DataFrame], DataFrame], spec: OriginSpec, path: str, start: dt.date | None = None, end: dt.date | None = None, fan: DataFrame | None = None, lookback_days: int = 30, stride_windows: int = 1, max_windows: int | None = None, n_boot: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    """From a frame to a stored run: origins by ``spec`` from ``start`` to ``end``, the fan by ``fit_fan``'s
    policy (``fan``, or history before the evaluation, or its own head, or none), ``forecast`` (a function
    of frame and origins), scores, the drop report and where the fan came from."""
    origins = cut(select_origins(make_origins(frame, spec), spec.minutes, start, end, stride_windows, max_windows))
    first = origins.where("ok").agg(F.min("t0")).first()[0]
    if first is None:
        raise ValueError("no origin can be evaluated: " + ", ".join(f"{r['drop_reason']} {r['n']}" for r in drop_report(origins).collect()))
    fitted, where_from = fit_fan(frame, first, lookback_days, fan)
    fitted = None if fitted is None else cut(fitted)
    config = {"context": spec.context, "horizon": spec.horizon, "max_gap_frac": spec.max_gap_frac, "require_quote_ok": spec.require_quote_ok, "start": start, "end": end, "lookback_days": lookback_days, "stride_windows": stride_windows, "max_windows": max_windows}
    forecasts = assemble(forecast(frame, origins), frame, origins, fitted)
    return store_run(forecasts, fitted, config, path, n_boot, seed, drop_report(origins), where_from)


def backtest_of(config: Config, frame: DataFrame, forecast: Callable[[DataFrame, DataFrame], DataFrame], path: str, fan: DataFrame | None = None) -> dict[str, DataFrame]:
    """``run_backtest`` with its settings from a configuration: sections origins and run."""
    day = lambda key: None if (x := config.pick(None, "run", key)) is None else dt.date.fromisoformat(str(x))
    number = lambda key, default: int(config.pick(None, "run", key, default))
    most = config.pick(None, "run", "max_windows")
    return run_backtest(frame, forecast, config.fill("origins", OriginSpec), path, day("start"), day("end"), fan, number("fan_lookback_days", 30), number("stride_windows", 1), None if most is None else int(most), number("bootstrap_days", 1000), number("seed", 0))


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, dict]:
    """Forecasts, fan and meta of a stored run."""
    at, fs = _place(spark, path)
    path = path if fs.exists(at) else f"{path}.old"
    info = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    fan = spark.read.parquet(f"{path}/baselines") if info["has_fan"] else None
    if fan is not None and "bucket" not in fan.columns:
        raise ValueError(f"the fan of {path} has no price buckets: run it anew or give another fan")
    return spark.read.parquet(f"{path}/forecasts"), fan, info


def rescore(spark: SparkSession, path: str, out: str, require_quote_ok: bool = False, fan: DataFrame | None = None, n_boot: int | None = None) -> dict[str, DataFrame]:
    """Score a stored run anew, without its model: baselines are always derived again, from its own fan
    or another; origins without a usable quote may be left out."""
    forecasts, own, info = load_run(spark, path)
    if require_quote_ok:
        forecasts = forecasts.where("quote_ok")
    config = info["config"] | {"require_quote_ok": require_quote_ok, "fan": "own" if fan is None else "given"}
    fan = own if fan is None else fan
    stale = [c for c in forecasts.columns if c in ("persist", "rw_p", "mean_fc") or c.startswith("fan_q")]
    drops = spark.read.parquet(f"{path}/drops") if "drops" in info.get("tables", ()) else None
    told = info.get("provenance") if fan is own else {"fan_mode": "file"}
    return store_run(add_baselines(forecasts.drop(*stale), fan), None if fan is None else cut(fan), config, out, n_boot or info["n_boot"], info["seed"], drops, told)
