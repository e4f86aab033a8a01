"""Parquet stores: one file a UTC day, guarded caches with a metadata sidecar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bars import BAR_COLUMNS, FREQ_SECONDS, to_bars
from ..operators.frame import build_frame
from .wire import CANDLES

BARS_VERSION, FRAME_VERSION = 4, 2


def partial_of(path: str) -> str:
    """The folder of days that broke off, beside a store."""
    return f"{path.rstrip('/')}.partial"


def read_days(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, columns=("ts", "value"), strict: bool = False, partial: bool = False) -> DataFrame:
    """Day folders ``date=YYYY-MM-DD`` within [start, end]: only those partitions are read. With
    ``strict`` a range without any day is an error, decided on the folders' names alone. ``partial``
    also reads what days had that broke off."""
    df = spark.read.parquet(path)
    if partial and newest(spark, partial_of(path)):
        df = df.unionByName(spark.read.parquet(partial_of(path)))
    if start:
        df = df.where(F.col("date") >= F.lit(start))
    if end:
        df = df.where(F.col("date") <= F.lit(end))
    if strict and df.select("date").limit(1).isEmpty():
        raise ValueError(f"no day from {start or 'the first'} to {end or 'the last'} in {path}")
    return df.select(*columns)


def write_days(df: DataFrame, path: str, time: str = "ts") -> None:
    """Replace just the days that ``df`` holds; a day without rows is never deleted."""
    df.withColumn("date", F.to_date(time)).repartition("date").sortWithinPartitions(time).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(path)


def drop_days(spark: SparkSession, path: str, days: list[str]) -> None:
    """Delete the folders of these days, where they are there."""
    for day in days:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={day}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_candles(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The candles of a day store."""
    return read_days(spark, path, start, end, columns=tuple(CANDLES.columns))


def newest(spark: SparkSession, path: str) -> int:
    """The latest change of any file below ``path``, in milliseconds; 0 if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0
    files, last = fs.listFiles(at, True), 0
    while files.hasNext():
        last = max(last, files.next().getModificationTime())
    return last


META = "version int, key string, source_ms bigint"


def _meta(spark: SparkSession, path: str):
    """The sidecar, or None where there is none."""
    return spark.read.schema(META).json(f"{path}/meta").first() if newest(spark, f"{path}/meta") else None


def _store(df: DataFrame, path: str, name: str, version: int, key: str, source_ms: int) -> None:
    """Data first, then the sidecar that makes them valid: a write that breaks off leaves them stale."""
    spark = df.sparkSession
    spark.createDataFrame([(-1, key, -1)], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    spark.createDataFrame([(version, key, source_ms)], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def _fresh(spark: SparkSession, path: str, version: int, key: str, source_ms: int) -> bool:
    meta = _meta(spark, path)
    return meta is not None and (meta["version"], meta["key"]) == (version, key) and meta["source_ms"] >= source_ms


def write_bars(bars: DataFrame, path: str, freq: str, source_ms: int = 0) -> None:
    _store(bars, path, "bars", BARS_VERSION, freq, source_ms)


def build_bars(spark: SparkSession, ticks_path: str, path: str, freq: str = "1m", force: bool = False) -> DataFrame:
    """Bars of a tick store, built where they are absent, of another version, or older than any tick file."""
    source = newest(spark, ticks_path)
    if force or not _fresh(spark, path, BARS_VERSION, freq, source):
        write_bars(to_bars(read_days(spark, ticks_path, strict=True), freq), path, freq, source)
    return load_bars(spark, path, freq)


def build_frame_store(spark: SparkSession, bars_path: str, candles_path: str, path: str, vol_lookback: int = 240, rv_lookback: int = 30, force: bool = False) -> DataFrame:
    """The minute frame of stored bars and candles, built where it is absent, of another version, of
    other look-backs, or older than its sources."""
    key, source = f"{vol_lookback},{rv_lookback}", max(newest(spark, bars_path), newest(spark, candles_path))
    if force or not _fresh(spark, path, FRAME_VERSION, key, source):
        candles = spark.read.parquet(candles_path)
        _store(build_frame(load_bars(spark, bars_path, "1m"), candles.select(*[c for c in CANDLES.columns if c in candles.columns]), vol_lookback, rv_lookback), path, "frame", FRAME_VERSION, key, source)
    return load_frame(spark, path, vol_lookback, rv_lookback)


def load_frame(spark: SparkSession, path: str, vol_lookback: int = 240, rv_lookback: int = 30) -> DataFrame:
    meta = _meta(spark, path)
    if meta is None or (meta["version"], meta["key"]) != (FRAME_VERSION, f"{vol_lookback},{rv_lookback}"):
        raise ValueError(f"the stored frame is {meta}, not version {FRAME_VERSION} with look-backs {vol_lookback}, {rv_lookback}: build it anew")
    return spark.read.parquet(f"{path}/frame")


def load_bars(spark: SparkSession, path: str, freq: str) -> DataFrame:
    """Stored bars, after version, columns and grid have been checked."""
    meta = _meta(spark, path)
    if meta is None or (meta["version"], meta["key"]) != (BARS_VERSION, freq):
        raise ValueError(f"stored bars are {meta}, not version {BARS_VERSION} at {freq}: build them anew")
    bars = spark.read.parquet(f"{path}/bars")
    if tuple(bars.columns) != BAR_COLUMNS:
        raise ValueError("stored bars have other columns")
    low, high, n, several = bars.agg(F.min("ts"), F.max("ts"), F.count("*"), F.count("*") - F.count_distinct("ts")).first()
    if n and (several or (high - low).total_seconds() != (n - 1) * FREQ_SECONDS[freq]):
        raise ValueError("stored bars have holes or repeated labels")
    return bars
