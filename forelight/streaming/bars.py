"""Bars from a stream of ticks, closed by a watermark: as a windowed aggregate (prices and counts), or
in full by a processor with keyed state (returns, tails, gaps)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import BAR_COLUMNS, MAX_RETURN_GAP_S, TAIL_TOLERANCE_S
from ..operators.grid import ZERO, complete
from ..session import shared_dir, ship

FIELDS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_bars(ticks: DataFrame, every: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close, mean, count by tumbling window. Watermarks need an instant, so the
    zone-less time is read in the session's zone (UTC). Later ticks than the watermark are dropped."""
    t = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    bars = t.groupBy(F.window("at", every).alias("w")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.avg("value").alias("mean"), F.count("*").alias("n_ticks"))
    return bars.select(F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "mean", "n_ticks")


def read_ticks(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def run_to_table(bars: DataFrame, table_path: str, checkpoint: str):
    """Append finished bars to Parquet; restarts go on from the checkpoint."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars_of_available(spark: SparkSession, sf_dir: str, every: str = "15 minutes") -> DataFrame:
    """All bars that the watermark closes over the files that are there now."""
    here = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    stream = spark.readStream.schema(FIELDS).option("pathGlobFilter", "events.parquet" if single else "*.parquet").parquet(sf_dir if single else source)
    run_to_table(stream_bars(stream, every), f"{here}/bars", f"{here}/state").awaitTermination()
    return spark.read.parquet(f"{here}/bars")


BAR_FIELDS = "series string, ts timestamp_ntz, open double, high double, low double, close double, mean double, std double, rv_1s double, ret_l10 double, ret_l30 double, n_ticks long, n_raw_ticks long, is_gap boolean, is_full boolean"
#: seconds of ticks that one entry of a processor's state holds, ticks it gathers before they go there
SPAN_S, GATHERED = 3600, 1 << 20
_PRICES = ("open", "high", "low", "close", "mean", "std", "rv_1s", "ret_l10", "ret_l30")


def bars_of(us: np.ndarray, value: np.ndarray, seconds: int, before: tuple[int, float] | None) -> tuple[pd.DataFrame, tuple[int, float] | None]:
    """The bars of all intervals that hold these ticks (microseconds, values; any order) by label, and the
    last tick on a whole second. ``before``: that of an earlier interval. A return belongs to its later
    tick, spans a minute at most and never crosses a UTC day; ticks of one time are taken by value."""
    order = np.lexsort((value, us))
    us, value = us[order], value[order]
    labels, raw = np.unique(us // (seconds * 1_000_000), return_counts=True)
    out = pd.DataFrame({"label": labels} | {c: np.full(len(labels), np.nan) for c in _PRICES} | {"n_ticks": 0, "n_raw_ticks": raw})
    on = us % 1_000_000 == 0
    at, v = us[on] // 1_000_000, value[on]
    if len(v):
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(v > 0, np.log(np.where(v > 0, v, 1.0)), np.nan)
            t, x = (at[:1], logs[:1] * np.nan) if before is None else (np.array([before[0]]), np.log([before[1] if before[1] > 0 else np.nan]))
        t, r = np.r_[t, at], np.diff(np.r_[x, logs])
        known = (np.diff(t) <= MAX_RETURN_GAP_S) & (t[1:] // 86_400 == t[:-1] // 86_400) & ~np.isnan(r)
        mine, first, n = np.unique(at // seconds, return_index=True, return_counts=True)
        last, off, place = first + n - 1, at % seconds, np.arange(len(v))
        mean = np.add.reduceat(v, first) / n
        n_r = np.add.reduceat(known.astype(np.int64), first)
        moved = np.add.reduceat(np.where(known, r * r, 0.0), first)

        def tail(back: int) -> np.ndarray:
            mark = seconds - 1 - back
            early = np.maximum.reduceat(np.where((off <= mark) & (off > mark - TAIL_TOLERANCE_S), place, -1), first)
            return np.where((off[last] >= seconds - TAIL_TOLERANCE_S) & (early >= 0), logs[last] - logs[early], np.nan)

        std = np.sqrt(np.add.reduceat((v - np.repeat(mean, n)) ** 2, first) / n)
        rv = np.where(n_r >= max(seconds // 2, 1), moved * seconds / np.maximum(n_r, 1), np.nan)
        prices = (v[first], np.maximum.reduceat(v, first), np.minimum.reduceat(v, first), v[last], mean, std, rv, tail(10), tail(30))
        rows = np.searchsorted(labels, mine)
        for c, x in zip((*_PRICES, "n_ticks"), (*prices, n), strict=True):
            out.loc[rows, c] = x
        before = int(at[-1]), float(v[-1])
    return out, before


class BarProcessor(StatefulProcessor):
    """State of a key, which is a series, or a series' day: the ticks of its open intervals, an entry an
    hour; the next interval to hand on; the last tick on a whole second. Intervals leave when the watermark
    has passed their end: a timer stands at the end of the next one. Those of a series leave with the empty
    ones between them; a day hands on what holds ticks, and its state goes once the watermark has passed it."""

    def __init__(self, seconds: int, days: bool = False):
        self.seconds, self.days = seconds, days
        self.each = max(1, SPAN_S // seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "span long", "ticks binary")
        self.next = handle.getValueState("next", "label long")
        self.last = handle.getValueState("last", "sec long, value double")

    def _keep(self, both: np.ndarray) -> int:
        """Adds ticks to the state; returns the first one's label."""
        spans = both[:, 0] // (self.seconds * 1_000_000 * self.each)
        order = np.argsort(spans, kind="stable")
        both, spans = both[order], spans[order]
        for part in np.split(both, np.flatnonzero(np.diff(spans)) + 1):
            span = int(part[0, 0] // (self.seconds * 1_000_000 * self.each))
            have = self.open.getValue((span,))
            self.open.updateValue((span,), ((have[0] if have else b"") + part.tobytes(),))
        return int(both[:, 0].min() // (self.seconds * 1_000_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, parts, size = [], [], 0
        for pdf in rows:
            both = np.empty((len(pdf), 2), np.int64)
            both[:, 0], both[:, 1] = pdf["us"].to_numpy(np.int64), pdf["value"].to_numpy(np.float64).view(np.int64)
            parts, size = [*parts, both], size + len(both)
            if size > GATHERED:
                first.append(self._keep(np.concatenate(parts)))
                parts, size = [], 0
        if size:
            first.append(self._keep(np.concatenate(parts)))
        due = self.next.get()
        if first and (due is None or min(first) < due[0]):
            self.next.update((min(first),))
            self.handle.registerTimer((min(first) + 1) * self.seconds * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // 1000 // self.seconds  # labels under this have ended
        due, last, left = self.next.get(), self.last.get(), None
        if due is None or due[0] >= closed:
            if self.days and due is None and closed * self.seconds >= (key[1] + 1) * 86_400:
                self.last.clear()
            yield pd.DataFrame()
            return
        end = min(closed, (key[1] + 1) * 86_400 // self.seconds) if self.days else closed
        for span in range(due[0] // self.each, (end - 1) // self.each + 1):
            low, high = max(due[0], span * self.each), min(end, (span + 1) * self.each)
            got = self.open.getValue((span,))
            both = np.frombuffer(got[0], np.int64).reshape(-1, 2) if got else np.empty((0, 2), np.int64)
            ended = both[:, 0] < high * self.seconds * 1_000_000
            bars, last = bars_of(both[ended, 0], np.ascontiguousarray(both[ended, 1]).view(np.float64), self.seconds, last)
            if got and ended.all():
                self.open.removeKey((span,))
            elif got:
                self.open.updateValue((span,), (both[~ended].tobytes(),))
                left = int(both[~ended, 0].min() // (self.seconds * 1_000_000))
            if not self.days:
                bars = bars.set_index("label").reindex(range(low, high)).fillna({"n_ticks": 0, "n_raw_ticks": 0}).rename_axis("label").reset_index()
            if len(bars):
                yield self._frame(key[0], bars)
        if last is not None:
            self.last.update(last)
        if not self.days:
            left = end
        elif left is None:  # of the spans after those read
            rest = [int(k[0]) for k in self.open.keys()]
            left = min(rest) * self.each if rest else None
        if left is not None:
            self.next.update((left,))
            self.handle.registerTimer((left + 1) * self.seconds * 1000)
            return
        self.next.clear()
        if closed * self.seconds >= (key[1] + 1) * 86_400:
            self.last.clear()
        else:
            self.handle.registerTimer((key[1] + 1) * 86_400_000)

    def _frame(self, series: str, bars: pd.DataFrame) -> pd.DataFrame:
        n = bars["n_ticks"].astype(np.int64)
        told = {"series": series, "ts": pd.to_datetime(bars["label"] * self.seconds, unit="s"), "n_ticks": n, "n_raw_ticks": bars["n_raw_ticks"].astype(np.int64), "is_gap": n == 0, "is_full": n == self.seconds}
        return bars.assign(**told)[["series", *BAR_COLUMNS]]

    def close(self) -> None:
        pass


def full_stream_bars(ticks: DataFrame, seconds: int = 60, late: str = "10 minutes", series: str | None = None, days: bool = False) -> DataFrame:
    """Every column of the batch bars, from a stream of ticks (ts, value, and a column that names the
    series where there are several), gaps between a series' first and last interval included. A series
    is one key: as many run at once as there are. With ``days`` a series' UTC day is one, as no bar or
    return crosses midnight, and only bars that hold ticks are handed on: ``complete`` adds the gaps. Needs
    the RocksDB state store (see ``stateful``)."""
    ship(ticks.sparkSession)
    name = (F.col(series) if series else F.lit("")).cast("string").alias("series")
    t = ticks.where("ts IS NOT NULL AND value IS NOT NULL").select(name, F.col("ts").cast("timestamp").alias("at"), F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"), "value", *([F.unix_date(F.to_date("ts")).alias("day")] if days else []))
    return t.withWatermark("at", late).groupBy("series", *(["day"] if days else [])).transformWithStateInPandas(BarProcessor(seconds, days), BAR_FIELDS, "Append", "EventTime")


def stateful(spark: SparkSession) -> None:
    """Let this session's stateful processors keep their state in RocksDB, which they need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def full_bars_of_available(spark: SparkSession, ticks: DataFrame, seconds: int = 60, late: str = "10 minutes", files: int | None = None) -> DataFrame:
    """All bars that the watermark closes over ``ticks`` (ts, value), streamed from the shared folder by day
    (in ``files`` files in the order of time, or as they are dealt), on the grid from the first tick's
    interval to the last one that is closed."""
    here = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = ticks.select("ts", "value")
    (rows.repartitionByRange(files, "ts") if files else rows).write.parquet(f"{here}/ticks")
    stateful(spark)
    kind = "ts timestamp_ntz, value double"
    stream = spark.readStream.schema(kind).parquet(f"{here}/ticks")
    run_to_table(full_stream_bars(stream, seconds, late, days=True), f"{here}/bars", f"{here}/state").awaitTermination()
    bars = spark.read.schema(BAR_FIELDS).parquet(f"{here}/bars").select(*BAR_COLUMNS)
    label = lambda t: f"timestampdiff(SECOND, {ZERO}, {t}) div {seconds} * {seconds}"
    low, closed = spark.read.schema(kind).parquet(f"{here}/ticks").where("value IS NOT NULL").agg(F.expr(label("min(ts)")), F.expr(label(f"(max(ts) - INTERVAL '{late}')"))).first()
    if low is None or low >= closed:
        return bars
    whole = complete(bars, seconds, low, closed - seconds)
    empty = {"n_ticks": F.lit(0), "n_raw_ticks": F.lit(0), "is_gap": F.lit(True), "is_full": F.lit(False)}
    return whole.withColumns({c: F.coalesce(c, x) for c, x in empty.items()}).select(*BAR_COLUMNS)
