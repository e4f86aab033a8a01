"""Incremental ingestion: which days to fetch, and the record of what was fetched."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, ship
from .store import drop_days, partial_of, write_days
from .wire import TICKS, TableSpec, check_meta, parse_events, typed_row

FIELDS = "day date, rows bigint, complete boolean, file_exists boolean"
VERSION = 2


def candidate_days(spark: SparkSession, first: str, last_ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Days from the first tick, or ``start``, to the snapshot's last tick, or ``end``."""
    low = f"greatest(DATE'{first}', DATE'{start or first}')"
    high = f"least(to_date(TIMESTAMP_NTZ'{last_ts}'), DATE'{end or '9999-12-31'}')"
    return spark.range(1).selectExpr(f"explode(CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE array() END) AS day")


def plan_days(days: DataFrame, manifest: DataFrame, last_ts: str, force: bool = False) -> DataFrame:
    """Days to fetch: those without a complete record and file, and the still growing last one."""
    done = manifest.where("complete AND (file_exists OR rows = 0)").select("day")
    tail = F.col("day") == F.expr(f"to_date(TIMESTAMP_NTZ'{last_ts}')")
    if force:
        return days
    return days.join(done.withColumn("done", F.lit(True)), "day", "left").where(tail | F.col("done").isNull()).select("day")


def reconcile(fetched: DataFrame, reported: DataFrame) -> DataFrame:
    """day, rows, told, ok: parsed rows against the count that closed each day's stream."""
    got = fetched.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"))
    return reported.join(got, "day", "left").select("day", F.coalesce("rows", F.lit(0)).alias("rows"), "told", (F.coalesce("rows", F.lit(0)) == F.col("told")).alias("ok"))


def migrate(records: DataFrame) -> DataFrame:
    """Records of any version as the present one: absent columns get their defaults."""
    have = set(records.columns)
    default = {"complete": "rows IS NOT NULL", "file_exists": "rows > 0"}
    return records.selectExpr("day", "rows", *[c if c in have else f"{e} AS {c}" for c, e in default.items()])


def merge(manifest: DataFrame, news: DataFrame) -> DataFrame:
    """The newer record of each day."""
    old = manifest.withColumn("age", F.lit(1))
    return old.unionByName(news.withColumn("age", F.lit(0))).groupBy("day").agg(*[F.min_by(c, "age").alias(c) for c in ("rows", "complete", "file_exists")])


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def save(manifest: DataFrame, path: str) -> None:
    """Written beside the old one, which is then replaced by renaming: a reader sees either whole, and
    what breaks off in between is taken up by ``load``."""
    spark = manifest.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    manifest.withColumn("version", F.lit(VERSION)).coalesce(1).write.mode("overwrite").json(new)
    (at, fs), (to_new, _), (to_old, _) = _fs(spark, path), _fs(spark, new), _fs(spark, old)
    fs.delete(to_old, True)
    if fs.exists(at):
        fs.rename(at, to_old)
    if not fs.rename(to_new, at):
        raise OSError(f"{new} can't be renamed to {path}")
    fs.delete(to_old, True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored records as the present version; none where nothing is stored."""
    for place in (path, f"{path}.old"):
        at, fs = _fs(spark, place)
        if fs.exists(at):
            return migrate(spark.read.json(place).withColumn("day", F.col("day").cast("date")))
    return spark.createDataFrame([], FIELDS)


@dataclass
class Retry:
    """Waits for rate limits (a server's own wait, or a ladder with a fifth of spread) and doubles on
    passing failures; the two are counted apart. A rejected token is renewed once. A stream that breaks,
    or that is not ``whole``, keeps what it had after the last attempt; every other failure is raised."""

    attempts: int = 5
    ladder: tuple[float, ...] = (5, 15, 30, 60, 120)
    first_wait: float = 1.0
    sleep: Callable[[float], None] = time.sleep
    throttled: int = 5
    renew: Callable[[], None] | None = None

    def fetch(self, stream: Callable[[], Iterator], whole: Callable[[list], bool] = lambda rows: True) -> tuple[list, bool]:
        failed = limited = 0
        renewed = False
        while True:
            kept: list = []
            try:
                for row in stream():
                    kept.append(row)
                if whole(kept):
                    return kept, True
                error: Exception | None = None
            except RateLimited as e:
                limited += 1
                if limited >= self.throttled:
                    raise
                self.sleep(e.after if e.after is not None else self.ladder[min(limited, len(self.ladder)) - 1] * random.uniform(0.8, 1.2))
                continue
            except Rejected:
                if renewed or self.renew is None:
                    raise
                renewed = True
                self.renew()
                continue
            except BrokenStream:
                error = None
            except ConnectionError as e:
                error = e
            failed += 1
            if failed >= self.attempts:
                if error:
                    raise error
                return kept, False
            self.sleep(self.first_wait * 2 ** (failed - 1))


class RateLimited(Exception):
    def __init__(self, after: float | None = None):
        super().__init__("rate limited")
        self.after = after


class Rejected(Exception):
    """The server does not take the token."""


class BrokenStream(Exception):
    """The stream ended before its closing event."""


#: rows of a stream that a task passes on at a time
AT_ONCE = 50_000


def fetched(spec: TableSpec = TICKS) -> str:
    return f"day date, {spec.schema}, told bigint, whole boolean, failure string"


def fetch(plan: DataFrame, open_stream: Callable[[str], Iterator[str]], retry: Retry | None = None, spec: TableSpec = TICKS, key: str | None = None, contain: bool = False) -> DataFrame:
    """The streams of the planned days: one row each row of the table, and one that closes each day, with
    the count that the stream told (null if it broke off) and whether it came whole. ``open_stream``
    takes a day and yields the lines of its event stream; each day is one task's, with retries. With
    ``contain`` a day that fails is a closing row with the failure instead of the end of the job."""
    retry = retry or Retry()
    columns = list(spec.columns)

    def whole(rows: list) -> bool:
        return bool(rows) and rows[-1][0] is None and rows[-1][1] == len(rows) - 1

    def run(batches):
        for pdf in batches:
            for day in pdf["day"]:
                rows, told, good, failure = [], None, False, None
                try:
                    rows, good = retry.fetch(lambda day=day: day_rows(open_stream(str(day)), str(day), spec, key), whole)
                except Exception as e:  # the day's failure is its result
                    if not contain:
                        raise
                    failure = f"{type(e).__name__}: {e}"
                if rows and rows[-1][0] is None:
                    told = rows.pop()[1]
                for at in range(0, len(rows), AT_ONCE):
                    out = pd.DataFrame(rows[at : at + AT_ONCE], columns=columns)
                    out.insert(0, "day", day)
                    yield out.assign(told=pd.array([None] * len(out), "Int64"), whole=pd.array([None] * len(out), "boolean"), failure=None)
                last = {"day": [day], **{c: [None] for c in columns}, "told": pd.array([told], "Int64"), "whole": pd.array([good], "boolean"), "failure": [failure]}
                yield pd.DataFrame(last)

    ship(plan.sparkSession)
    return plan.select("day").repartition("day").mapInPandas(run, fetched(spec))


def day_rows(lines: Iterator[str], day: str, spec: TableSpec = TICKS, key: str | None = None) -> Iterator[tuple]:
    """The typed rows of a day's stream, then (None, told count). The stream must be of the right table (and
    key, if one is given) with all its columns, and hold only this day; one that does not close is broken."""
    for event, data in parse_events(lines):
        if event == "meta":
            check_meta(json.loads(data), day, spec, key)
        elif event == "done":
            yield None, int(json.loads(data)["rows"])
            return
        elif event == "error":
            raise BrokenStream(f"{day}: {data}")
        elif event in ("message", "row"):
            row = typed_row(json.loads(data), spec)
            if row[0] is None or row[0].strftime("%Y-%m-%d") != day:
                raise ValueError(f"{day}: a row of {row[0]}")
            yield row
    raise BrokenStream(day)


def ingest(spark: SparkSession, open_stream: Callable[[str], Iterator[str]], days: DataFrame, last_ts: str, store: str, record: str, retry: Retry | None = None, force: bool = False, spec: TableSpec = TICKS, key: str | None = None) -> DataFrame:
    """Fetch the days that are due, store them, and keep the record. Returns the report: day, rows, told,
    ok, failure, state.

    A day is ``whole`` (its rows are as many as its stream told), ``empty``, ``broken`` (it broke off, or
    closed with another count) or ``failed``. Whole days go to the store; what a broken day had goes to
    ``partial_of(store)``, where readers find it only if they ask, until the day comes whole. A failed day
    changes neither store nor record. All but whole and empty days stay due, and so does a day that the
    snapshot ``last_ts`` does not close. A stored day is never deleted because its stream is empty."""
    manifest = cut(load(spark, record))
    got = cut(fetch(plan_days(days, manifest, last_ts, force), open_stream, retry, spec, key, contain=True))
    closing = F.col("whole").isNotNull()
    counts = got.groupBy("day").agg(F.count_if(~closing).alias("rows"), F.max("told").alias("told"), F.bool_and("whole").alias("whole"), F.max("failure").alias("failure"))
    state = F.expr("CASE WHEN failure IS NOT NULL THEN 'failed' WHEN NOT coalesce(whole AND rows = told, false) THEN 'broken' WHEN rows = 0 THEN 'empty' ELSE 'whole' END")
    report = cut(counts.withColumn("state", state).selectExpr("day", "rows", "told", "state IN ('whole', 'empty') AS ok", "failure", "state"))
    rows = got.where(~closing).drop("told", "whole", "failure")
    for wanted, place in (("whole", store), ("broken", partial_of(store))):
        some = rows.join(F.broadcast(report.where(F.col("state") == wanted).select("day")), "day", "left_semi").drop("day")  # days
        if not some.isEmpty():
            write_days(some, place)
    drop_days(spark, partial_of(store), [str(r[0]) for r in report.where("state = 'whole'").select("day").collect()])
    sealed = F.expr(f"timestampadd(DAY, 1, CAST(day AS TIMESTAMP_NTZ)) <= TIMESTAMP_NTZ'{last_ts}'")
    before = manifest.select("day", F.col("file_exists").alias("had"))
    news = report.where("state <> 'failed'").join(before, "day", "left").select("day", "rows", (F.col("ok") & sealed).alias("complete"), F.expr("state = 'whole' OR coalesce(had, false)").alias("file_exists"))
    save(cut(merge(manifest, news)), record)
    return report
