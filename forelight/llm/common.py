"""Pieces that several operators of this package share."""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forelight.session import cut, ensure_checkpoint_dir
from forelight.session import ship as _ship

__all__ = ["cut", "ensure_checkpoint_dir", "ship", "documents", "table", "split_words", "ASCII_LOWER", "sha256_hex", "scratch_dir", "delete", "Tables", "trim", "keep_memory", "lookup", "join_uneven"]

#: bytes -> bytes with A-Z lower-cased; all other bytes stay
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and let batches of texts for Python workers hold 16 MB at
    most, unless the session asks for another size itself."""
    _ship(spark)
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(1 << 24))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Intermediate tables written to the shared folder and read back: their lineage is cut and
    their true sizes are known to the planner. ``drop`` deletes one that is read no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]  # ids stay unique while held
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, self.paths[id(df)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """UTF-8 words of ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly these six."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(ASCII_LOWER) if lower else raw).split()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def trim() -> None:
    """Return a Python worker's freed memory to the system; called at the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep_memory() -> None:
    """Let this worker reuse large arrays' memory instead of mapping it anew each time; ``trim``
    still returns what is free."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):
        pass


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], how: str, limit: int, salts: int = 32) -> DataFrame:
    """``rows`` joined with ``small``, a checkpointed table that has each key once. Up to ``limit`` rows
    of it are broadcast; a larger one meets rows dealt by key and salt, so that no key is one task's."""
    if small.count() <= limit:
        return rows.join(F.broadcast(small), keys, how)
    if how in ("left_semi", "left_anti"):
        columns = [F.col(f"`{c}`") for c in rows.columns]
        found = lookup(rows, small.select(*keys).withColumn("found__", F.lit(True)), keys, "left", limit, salts)
        return found.where(F.col("found__").isNotNull() if how == "left_semi" else F.col("found__").isNull()).select(*columns)
    # a salt from the row itself: a task that runs again deals alike
    salted = rows.withColumn("salt__", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int"))
    every = small.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(every, [*keys, "salt__"], how).drop("salt__")


def join_uneven(rows: DataFrame, big: DataFrame, key: str, weight: str, hot: int, limit: int) -> DataFrame:
    """``rows`` joined with ``big``, a checkpointed table that has each key of ``rows`` once, with the
    number of its rows. Keys of over ``hot`` rows are broadcast, so none of them goes to one task;
    the others meet by a shuffle."""
    few = cut(big.where(F.col(weight) > hot))
    if few.count() > limit:
        return lookup(rows, big, [key], "inner", 0)
    told = rows.join(F.broadcast(few.withColumn("hot__", F.lit(True))), key, "left")
    cold = told.where("hot__ is null").select(*[F.col(f"`{c}`") for c in rows.columns]).join(big.where(F.col(weight) <= hot), key)
    return told.where("hot__ is not null").drop("hot__").unionByName(cold)
