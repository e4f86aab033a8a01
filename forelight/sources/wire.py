"""Recorded event streams: server-sent events to typed rows, as parser and as data source."""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..session import ship

QUOTE_NUMBERS = tuple(f"{side}_{x}" for side in ("yes_bid", "yes_ask") for x in ("open", "high", "low", "close")) + tuple(f"price_{x}" for x in ("open", "high", "low", "close", "mean"))


@dataclass(frozen=True)
class TableSpec:
    """A wire table: its name and its columns with their types; ts comes first."""

    name: str
    columns: dict[str, str] = field(hash=False)

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.columns.items())


TICKS = TableSpec("ticks", {"ts": "timestamp_ntz", "value": "double"})
CANDLES = TableSpec("candles", {"ts": "timestamp_ntz", "ticker": "string", "floor_strike": "double", **dict.fromkeys(QUOTE_NUMBERS, "double"), "volume": "double", "open_interest": "double"})


def parse_time(text: str | None) -> dt.datetime | None:
    """RFC 3339 to zone-less UTC; fractions are cut to microseconds."""
    if not text:
        return None
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d+))?(?:[Zz]|([+-]\d\d:?\d\d))?", text.strip())
    if not m:
        raise ValueError(f"no RFC 3339 time: {text!r}")
    at = dt.datetime.fromisoformat(f"{m[1]}T{m[2]}") + dt.timedelta(microseconds=int((m[3] or "0")[:6].ljust(6, "0")))
    if m[4]:
        sign, hours, minutes = (1 if m[4][0] == "+" else -1), int(m[4][1:3]), int(m[4][-2:])
        at -= sign * dt.timedelta(hours=hours, minutes=minutes)
    return at


def format_time(at: dt.datetime) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def parse_frames(lines: Iterable[str]) -> Iterator[tuple[str, str, str | None, int | None]]:
    """(event, data, id, retry): a blank line ends an event, ':' starts a comment, data lines join, the
    last of other fields counts; an event needs a name or data, and one that no blank line ends is
    dropped."""
    seen: dict[str, list[str]] = {}
    for line in map(lambda x: x.rstrip("\r\n"), lines):
        if line and not line.startswith(":"):
            name, _, value = line.partition(":")
            seen.setdefault(name, []).append(value.removeprefix(" "))
        elif not line:
            last = {k: v[-1] for k, v in seen.items()}
            if "event" in seen or "data" in seen:
                wait = last.get("retry", "")
                yield last.get("event") or "message", "\n".join(seen.get("data", ())), last.get("id"), int(wait) if wait.isdigit() else None
            seen = {}


def parse_events(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(event, data) of each frame."""
    return (frame[:2] for frame in parse_frames(lines))


def typed_row(raw: dict, spec: TableSpec) -> tuple:
    """Known columns in order; numbers from numbers or text, NaN and null are null."""
    out: list = []
    for c, kind in spec.columns.items():
        v = raw.get(c)
        if v is not None and kind == "timestamp_ntz":
            v = parse_time(v)
        elif v is not None and kind == "double":
            v = float(v)
            v = None if v != v else v
        out.append(v)
    return tuple(out)


def check_meta(meta: dict, place: str, spec: TableSpec, key: str | None = None) -> None:
    """The contract that opens a stream: its table, its key (if one is asked for) and all columns."""
    wrong = {k: meta[k] for k, want in (("table", spec.name), ("key", key)) if want is not None and k in meta and meta[k] != want}
    missing = set(spec.columns) - set(meta["columns"])
    if wrong or missing:
        raise ValueError(f"{place}: another stream than asked for: {wrong or ''} lacks {sorted(missing)}")


def stream_rows(lines: Iterable[str], day: str, spec: TableSpec, strict: bool = True, key: str | None = None) -> Iterator[tuple]:
    """The typed rows of a recorded stream. ``strict`` rejects rows outside ``day`` and a stream that does
    not close, or closes with another count."""
    rows, closed = 0, False
    for event, data in parse_events(lines):
        if event == "meta":
            check_meta(json.loads(data), day, spec, key)
        elif event == "done":
            closed = True
            if strict and json.loads(data)["rows"] != rows:
                raise ValueError(f"{day} closes with {data}, {rows} rows were read")
        elif event in ("message", "row"):
            row = typed_row(json.loads(data), spec)
            if strict and (row[0] is None or row[0].strftime("%Y-%m-%d") != day):
                raise ValueError(f"{day} holds {row[0]}")
            rows += 1
            yield row
    if strict and not closed:
        raise ValueError(f"{day} breaks off after {rows} rows")


@dataclass
class DayFile(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


_DAY = re.compile(r"(?:^|/|date=)(\d{4}-\d\d-\d\d)(?=[./]|$)")


def day_of(path: str) -> str | None:
    """The day that a recorded file is named after: ``2024-01-01.sse`` or a folder ``date=2024-01-01``."""
    found = _DAY.findall(path)
    return found[-1] if found else None


class EventStreamSource(DataSource):
    """``spark.read.format("recorded_events").option("path", folder).option("table", "ticks")``: recorded
    streams, a file a day (see ``day_of``), one partition each, in any file system that Arrow opens
    (local, S3, GCS, HDFS). ``from`` and ``to`` (dates) leave files out; ``strict`` rejects rows outside their
    file's day and streams whose closing count differs. With ``prune`` predicates that compare ts with a time
    are pushed down: only files of days that can hold such rows become partitions. Spark asks for a setting
    then, which ``recorded_source`` makes."""

    @classmethod
    def name(cls) -> str:
        return "recorded_events"

    def spec(self) -> TableSpec:
        return {"ticks": TICKS, "candles": CANDLES}[self.options.get("table", "ticks")]

    def schema(self) -> str:
        return self.spec().schema

    def reader(self, schema):
        prunes = self.options.get("prune", "false").lower() == "true"
        return (PruningReader if prunes else EventStreamReader)(self.options, self.spec())


class EventStreamReader(DataSourceReader):
    def __init__(self, options, spec: TableSpec):
        self.options, self.spec = dict(options), spec
        self.low, self.high = self.options.get("from", "0000"), self.options.get("to", "9999")

    def _files(self):
        from pyarrow import fs

        top = self.options["path"]
        return fs.FileSystem.from_uri(top) if "://" in top or top.startswith("file:") else (fs.LocalFileSystem(), top)

    def partitions(self):
        from pyarrow import fs

        files, top = self._files()
        found = files.get_file_info(fs.FileSelector(top, recursive=True))
        named = sorted((day_of(f.path), f.path) for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")) and day_of(f.path))
        return [DayFile(path) for day, path in named if self.low <= day <= self.high]

    def read(self, partition: DayFile):
        strict = self.options.get("strict", "true").lower() == "true"
        files, _ = self._files()
        with files.open_input_stream(partition.path) as f:
            yield from stream_rows(io.TextIOWrapper(f, "utf-8"), day_of(partition.path), self.spec, strict, self.options.get("key"))


class PruningReader(EventStreamReader):
    def pushFilters(self, filters):
        """Take note of the days that predicates on ts leave; Spark still applies every one to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("ts",) and isinstance(f.value, dt.datetime):
                day = f.value.strftime("%Y-%m-%d")
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, day)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    midnight = f.value == f.value.replace(hour=0, minute=0, second=0, microsecond=0)
                    last = f.value - dt.timedelta(days=1) if isinstance(f, LessThan) and midnight else f.value
                    self.high = min(self.high, last.strftime("%Y-%m-%d"))
            yield f


def recorded_source(spark, path: str, table: str = "ticks") -> DataFrame:
    """Recorded streams whose predicates on ts prune files. Lets this session push filters to Python sources."""
    ship(spark)
    spark.dataSource.register(EventStreamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("recorded_events").option("path", path).option("table", table).option("prune", "true").load()


def recorded(spark, path: str, spec: TableSpec = TICKS, start: dt.date | None = None, end: dt.date | None = None, strict: bool = True) -> DataFrame:
    """The rows of recorded streams in folders ``date=YYYY-MM-DD`` of any file system that Spark reads, days
    from ``start`` to ``end``: Spark lists the folders, leaves those of other days out and reads the files;
    a task parses a day's stream, which it holds as bytes."""
    ship(spark)
    files = spark.read.format("binaryFile").option("basePath", path).load(path).select("date", "path", "content")
    if start:
        files = files.where(F.col("date") >= F.lit(start))
    if end:
        files = files.where(F.col("date") <= F.lit(end))

    def parse(batches):
        for batch in batches:
            for day, content in zip(batch.column("date").to_pylist(), batch.column("content"), strict=True):
                lines = io.TextIOWrapper(pa.BufferReader(content.as_buffer()), "utf-8")
                rows = stream_rows(lines, str(day), spec, strict)
                while some := list(islice(rows, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*some, strict=True), spec.columns.values(), strict=True)], list(spec.columns))

    return files.repartition("date", "path").mapInArrow(parse, spec.schema)


_ARROW = {"timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "string": pa.string()}


def record(rows: DataFrame, path: str, spec: TableSpec = TICKS) -> None:
    """Write rows as recorded streams, a file a day, in the layout that ``recorded`` and the data source read."""
    fields = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in spec.columns.items()]
    columns = json.dumps({"table": spec.name, "columns": list(spec.columns)})
    day = rows.select(F.to_date("ts").alias("date"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("data"), "ts")
    body = day.select("date", F.lit(1).alias("part"), "ts", F.concat(F.lit("data: "), F.col("data"), F.lit("\n")).alias("value"))
    ends = day.groupBy("date").agg(F.count("*").alias("n")).select("date", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(f"event: meta\ndata: {columns}\n").alias("value")), F.struct(F.lit(2).alias("part"), F.concat(F.lit('event: done\ndata: {"rows": '), F.col("n").cast("string"), F.lit("}\n")).alias("value")))).alias("x")).select("date", "x.part", F.lit(None).cast("timestamp_ntz").alias("ts"), "x.value")
    body.unionByName(ends).repartition("date").sortWithinPartitions("date", "part", "ts").select("date", "value").write.mode("overwrite").partitionBy("date").text(path)


def rows_of_json(df: DataFrame, column: str, spec: TableSpec) -> DataFrame:
    """JSON lines to typed rows with Spark's own parser; unknown fields go, NaN is null."""
    wire = ", ".join(f"{c} {'string' if t == 'timestamp_ntz' else t}" for c, t in spec.columns.items())
    j = df.select(F.from_json(F.col(column), wire, {"allowNonNumericNumbers": "true"}).alias("j")).select("j.*")
    at = {c: F.to_timestamp(F.col(c)).cast("timestamp_ntz") for c, t in spec.columns.items() if t == "timestamp_ntz"}
    return j.select(*[at[c].alias(c) if c in at else F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in spec.columns.items()])


def event_frames(lines: DataFrame) -> DataFrame:
    """Recorded stream lines (file, no, line) to frames (file, no, event, data, id, retry) in SQL, by the
    rules of ``parse_frames``; a frame number is the count of blank lines before a line. A file, which
    is a day's stream, is ordered in one task."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("no")
    t = lines.withColumn("line", F.regexp_replace("line", "[\r\n]+$", "")).withColumn("frame", F.coalesce(F.sum((F.col("line") == "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("colon", F.instr("line", ":")).withColumn("name", F.expr("CASE WHEN colon = 0 THEN line ELSE substring(line, 1, colon - 1) END"))
    t = t.withColumn("value", F.expr("CASE WHEN colon = 0 THEN '' WHEN substring(line, colon + 1, 1) = ' ' THEN substring(line, colon + 2) ELSE substring(line, colon + 1) END"))
    is_ = lambda name: F.col("name") == name
    last = lambda name: F.max_by(F.when(is_(name), F.col("value")), F.when(is_(name), F.col("no")))
    g = t.groupBy("file", "frame").agg(
        F.max("no").alias("no"), F.count_if(F.col("line") == "").alias("closed"), F.coalesce(F.nullif(last("event"), F.lit("")), F.lit("message")).alias("event"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(is_("data"), F.struct("no", F.col("value").alias("d"))))), lambda x: x["d"]), "\n").alias("data"),
        last("id").alias("id"), last("retry").alias("retry"), F.count_if(is_("data") | is_("event")).alias("parts"),
    )
    retry = F.when(F.col("retry").rlike("^[0-9]+$"), F.col("retry").cast("bigint"))
    return g.where("closed > 0 AND parts > 0").select("file", "no", "event", "data", "id", retry.alias("retry"))
