"""Stored bars and frames by day, of which only days are built whose sources changed.

Sources and results are folders ``date=YYYY-MM-DD``. A record keeps, for every stored day, a digest of all
that it was made of: number, bytes and last change of its source files, those of the days it looks
back on, and whether it is the first or last day of the grid. A day whose digest differs is built
anew, in one write that replaces just the folders of such days; the record follows the data, so a
build that breaks off is taken up by the next one. Days are listed on the driver, a row each.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bars import BAR_COLUMNS, FREQ_SECONDS, ON_SECOND, aggregate, flagged
from ..operators.frame import RV_SLOW, build_frame
from ..operators.grid import ZERO, at_second
from .store import BARS_VERSION, FRAME_VERSION, drop_days, read_candles, read_days
from .wire import CANDLES

DAY_S = 86_400


def fingerprints(spark: SparkSession, path: str) -> dict[str, str]:
    """Of each day folder below ``path``: files, bytes, latest change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {}
    if not fs.exists(at):
        return {}
    files = fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        place = f.getPath().toString()
        name = place.rsplit("/", 1)[1]
        if "/date=" in place and not name.startswith(("_", ".")):
            day = out.setdefault(place.split("/date=")[1][:10], [0, 0, 0])
            day[:] = day[0] + 1, day[1] + f.getLen(), max(day[2], f.getModificationTime())
    return {d: ":".join(map(str, x)) for d, x in out.items()}


def _days(first: str, last: str) -> list[str]:
    a, z = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    return [str(a + dt.timedelta(days=i)) for i in range((z - a).days + 1)]


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:24]


def _record(spark: SparkSession, path: str, key: str) -> dict[str, str]:
    """What each stored day was made of; nothing if it was for another key."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/record")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.schema("day string, made_of string, key string").json(f"{path}/record").collect()
    return {r["day"]: r["made_of"] for r in rows if r["key"] == key}


def _keep(spark: SparkSession, path: str, key: str, made_of: dict[str, str]) -> None:
    spark.createDataFrame([(d, m, key) for d, m in sorted(made_of.items())], "day string, made_of string, key string").coalesce(1).write.mode("overwrite").json(f"{path}/record")


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(f"{path}/days")


def _update(spark: SparkSession, path: str, key: str, made_of: dict[str, str], build) -> list[str]:
    """Build the days whose digest is new, drop those that are no more; the days that were built."""
    have = _record(spark, path, key)
    due = [d for d in sorted(made_of) if have.get(d) != made_of[d]]
    gone = sorted(set(have) - set(made_of))
    if due:
        # until the new record stands, the days under way have none
        _keep(spark, path, key, {d: m for d, m in have.items() if d not in due})
        build(due)
    if gone:
        drop_days(spark, f"{path}/days", gone)
    if due or gone:
        _keep(spark, path, key, made_of)
    return due


def update_bars(spark: SparkSession, ticks_path: str, path: str, freq: str = "1m") -> list[str]:
    """Bring stored bars up to a tick store; the days that were built. The grid runs from the first tick's
    interval to the last one's, days without ticks between them included."""
    size, source = FREQ_SECONDS[freq], fingerprints(spark, ticks_path)
    if not source:
        raise ValueError(f"no day in {ticks_path}")
    days = _days(min(source), max(source))
    made_of = {d: _digest(source.get(d), d == days[0], d == days[-1]) for d in days}

    def build(due: list[str]) -> None:
        second = f"(timestampdiff(SECOND, {ZERO}, ts) div {size}) * {size}"
        ends = read_days(spark, ticks_path, columns=("ts", "date")).where(F.col("date").isin(dt.date.fromisoformat(days[0]), dt.date.fromisoformat(days[-1])))
        low, high = ends.agg(F.expr(f"min({second})"), F.expr(f"max({second})")).first()
        ticks = read_days(spark, ticks_path, columns=("ts", "value", "date")).where(F.col("date").isin([dt.date.fromisoformat(d) for d in due]))
        if ticks.agg(F.count("*").alias("n"), F.count_if(F.expr(ON_SECOND)).alias("whole")).where("n > 0 AND whole = 0").count():
            raise ValueError("there are ticks, but none on a whole second: once-per-second bars can't be built")
        spans = [(int((dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).total_seconds()),) for d in due]
        grid = spark.createDataFrame(spans, "day_s long").selectExpr(f"explode(sequence(greatest({low}L, day_s), least({high}L, day_s + {DAY_S - size}), {size}L)) AS s").selectExpr(f"{at_second('s')} AS ts")
        bars = flagged(grid.join(aggregate(ticks, freq), "ts", "left"), freq).select(*BAR_COLUMNS)
        _replace(bars.withColumn("date", F.to_date("ts")).repartition("date").sortWithinPartitions("ts"), path)

    return _update(spark, path, f"bars {BARS_VERSION} {freq}", made_of, build)


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/days").select(*BAR_COLUMNS)


def update_frame(spark: SparkSession, bars_path: str, candles_path: str, path: str, vol_lookback: int = 240, rv_lookback: int = 30) -> list[str]:
    """Bring a stored frame up to stored bars and a candle day store; the days that were built. A day is made
    of its own bars and candles, the next day's candles (the first of which closes its last minute), and the
    bars it looks back on: so many rows, and further until a day that holds a tick."""
    bars, candles = fingerprints(spark, f"{bars_path}/days"), fingerprints(spark, candles_path)
    if not bars:
        raise ValueError(f"no bars in {bars_path}")
    back = -(-(max(vol_lookback, rv_lookback, RV_SLOW) + 2) // (DAY_S // 60))
    days = sorted(bars)
    live = {str(r[0]) for r in stored_bars(spark, bars_path).where("NOT is_gap").select(F.to_date("ts")).distinct().collect()}

    def halo(k: int) -> int:
        """The first day that day ``k`` looks back on."""
        k = max(0, k - back)
        while k > 0 and days[k] not in live:
            k -= 1
        return max(0, k - 1) if days[k] in live else 0

    after = lambda d: str(dt.date.fromisoformat(d) + dt.timedelta(days=1))
    made_of = {d: _digest(days[0], [bars[x] for x in days[halo(k) : k + 1]], [candles.get(x) for x in (*days[halo(k) : k + 1], after(d))]) for k, d in enumerate(days)}
    first = stored_bars(spark, bars_path).where(F.to_date("ts") == F.lit(dt.date.fromisoformat(days[0]))).agg(F.min("ts")).first()[0]

    def build(due: list[str]) -> None:
        place = {d: k for k, d in enumerate(days)}
        runs: list[list[str]] = []
        for d in due:
            if runs and place[d] == place[runs[-1][-1]] + 1:
                runs[-1].append(d)
            else:
                runs.append([d])
        whole = None
        for run in runs:
            low, a, z = (dt.date.fromisoformat(x) for x in (days[halo(place[run[0]])], run[0], run[-1]))
            b = spark.read.parquet(f"{bars_path}/days").where(F.col("date").between(low, z)).select(*BAR_COLUMNS)
            c = read_candles(spark, candles_path, low, dt.date.fromisoformat(after(run[-1]))) if candles else spark.createDataFrame([], CANDLES.schema)
            c = c.where(F.expr("timestampadd(MINUTE, -1, ts)") <= F.lit(dt.datetime.combine(z, dt.time(23, 59, 59))))
            start = max(first, dt.datetime.combine(low, dt.time()))
            offset = int((start - first).total_seconds()) // 60
            f = build_frame(b, c, vol_lookback, rv_lookback).withColumn("idx", F.col("idx") + offset).where(F.col("date").between(a, z))
            whole = f if whole is None else whole.unionByName(f)
        _replace(whole.repartition("date").sortWithinPartitions("idx"), path)

    return _update(spark, path, f"frame {FRAME_VERSION} {vol_lookback},{rv_lookback}", made_of, build)


def stored_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/days")
