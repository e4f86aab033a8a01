"""Whitening of embeddings: principal components by hierarchical merging of singular values.

Entries become whole numbers x = floor(1024 * entry) + 100000. A *summary* of any set of vectors is
their number n, their exact sums S and the rows diag(s) Vt of the singular value decomposition of
the centred vectors, all of them, so that rows.T @ rows is the scatter matrix. Two summaries merge
losslessly: the decomposition of both sets of rows and one more row,
sqrt(n1 * n2 / (n1 + n2)) * (mean1 - mean2), which corrects for the two means. Each task merges its
batches, then groups of up to ``FAN`` summaries merge, until one is left: at most dims rows of dims numbers,
whatever the number of vectors. Singular values are taken of centred data, never of products, which
keeps double precision.

The whitened vectors are summarised by the same merging to measure how far their covariance is from
the identity.

Defined results: vectors that are null, or hold null or non-finite entries, give no rows; the fit
list has the length that most vectors have (ties: the longer), vectors of other lengths have no
components and give no rows; empty vectors have no components. Components without variance cannot
be whitened and are not returned, so fewer than ``COMPONENTS`` come back where vectors span less, and
none for a single vector. Entries beyond 64 bits stop at their limits; a deviation beyond 64 bits is
null. Repeated rows are each returned; a null vec_id is an id. An empty table gives an empty result.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Tables, ship

#: fixed by the contract
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: summaries merged by one task, and the bytes of those at most
FAN, MERGED = 64, 1 << 25
#: vectors decomposed at once
BATCH = 4096
#: variances below this share of the largest, a dimension, are rounding
ROUNDING = 2.0**-50
_LONG = 9.2e18

_SUMMARY = "n long, sums string, rows binary"


class Summary:
    """n, exact sums (Python integers or floats), and rows (k x dims) whose product with themselves is the scatter."""

    def __init__(self, n: int, sums: list, rows: np.ndarray):
        self.n, self.sums, self.rows = n, sums, rows

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """``x``: whole numbers, centred exactly before anything is multiplied; or floats."""
        n = len(x)
        if x.dtype == np.float64:
            sums = [math.fsum(c) for c in x.T.tolist()]
            centred = x - np.array([s / n for s in sums])
        else:
            sums = [int(s) for s in x.astype(object).sum(axis=0)] if _wide(x, n) else x.sum(axis=0).tolist()
            centred = _centred(x, n, sums) / n
        return cls(n, sums, _triangle(centred))

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        # exact where sums are whole numbers
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)], np.float64)
        row = math.sqrt(self.n / n * other.n) * gap
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], _triangle(np.vstack([self.rows, other.rows, row[None]])))

    def pack(self) -> tuple[int, str, bytes]:
        return self.n, repr(self.sums), np.ascontiguousarray(self.rows).tobytes()

    @classmethod
    def unpack(cls, n: int, sums: str, rows: bytes) -> Summary:
        sums = ast.literal_eval(sums)
        return cls(n, sums, np.frombuffer(rows, np.float64).reshape(-1, len(sums)))


def _wide(x: np.ndarray, n: int) -> bool:
    """Whether n times the numbers could leave 62 bits."""
    return bool(len(x)) and x.size > 0 and float(np.abs(x.astype(np.float64)).max()) * n >= 2.0**61


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where they hold it, else in Python integers."""
    if _wide(x, n) or any(abs(s) >= 1 << 61 for s in sums):
        return (x.astype(object) * n - np.array(sums, dtype=object)).astype(object)
    return x * n - np.array(sums, np.int64)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """diag(s) Vt of ``rows``: no more rows than columns, with the same scatter."""
    rows = np.asarray(rows, np.float64)
    if not rows.size:
        return np.zeros((0, rows.shape[1]))
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def quantised(vectors: np.ndarray) -> np.ndarray:
    whole = np.floor(vectors.astype(np.float64) * SCALE)
    return np.clip(whole, -_LONG, _LONG).astype(np.int64) + SHIFT


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summaries(column: str, dims: int, whole: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(column)[start : start + BATCH], dims)
                part = Summary.of(quantised(x) if whole else x.astype(np.float64))
                total = part if total is None else total.merge(part)
        if total is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("n", "sums", "rows"), total.pack(), strict=True))], pa.schema([("n", pa.int64()), ("sums", pa.string()), ("rows", pa.binary())]))

    return task


def _merge(table: pa.Table) -> pa.Table:
    total = None
    for row in table.to_pylist():
        part = Summary.unpack(row["n"], row["sums"], row["rows"])
        total = part if total is None else total.merge(part)
    return pa.Table.from_pylist([{"slot": table["slot"][0].as_py(), **dict(zip(("n", "sums", "rows"), total.pack(), strict=True))}], pa.schema([("n", pa.int64()), ("sums", pa.string()), ("rows", pa.binary()), ("slot", pa.int64())]))


def summary(vectors: DataFrame, column: str, dims: int, whole: bool, tables: Tables) -> Summary | None:
    """The summary of all vectors: one a task, then up to ``FAN`` at a time, as many as ``MERGED`` bytes
    hold, by their number: whatever the partitions, each level has that many times fewer. What reaches
    the driver is one summary: dims rows of dims numbers at most."""
    fan = max(2, min(FAN, MERGED // (8 * dims * dims)))
    level = tables.put(vectors.select(column).mapInArrow(_summaries(column, dims, whole), _SUMMARY).withColumn("slot", F.spark_partition_id().cast("long")))
    while level.count() > 1:
        above = level.withColumn("slot", F.expr(f"slot div {fan}"))
        level = tables.put(above.groupBy("slot").applyInArrow(_merge, f"{_SUMMARY}, slot long"))
    row = level.first()
    return row and Summary.unpack(row["n"], row["sums"], bytes(row["rows"]))


def components(fit: Summary, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(k x dims unit vectors, k variances, falling; the trace of the covariance), without those whose
    variance is rounding."""
    if not fit.rows.size:
        return np.zeros((0, len(fit.sums))), np.zeros(0), 0.0
    _, s, vt = np.linalg.svd(fit.rows, full_matrices=False)
    e = s**2 / fit.n
    good = int((e[:most] > e[0] * (len(fit.sums) * ROUNDING) ** 2).sum()) if e[0] > 0 else 0
    return vt[:good], e[:good], float(e.sum())


def _whiten(n: int, sums: list, axes: np.ndarray, e: np.ndarray):
    per = axes.T / np.sqrt(e)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                gap = _centred(quantised(_matrix(part.column("x__"), len(sums))), n, sums)
                if gap.dtype == object or float(np.abs(gap).max(initial=0)) ** 2 * len(sums) >= 2.0**62:
                    far = [sum(v * v for v in row) for row in gap.astype(object).tolist()]
                    far = [v if v < 1 << 63 else None for v in far]
                else:
                    far = (gap * gap).sum(axis=1).tolist()
                white = (gap.astype(np.float64) / n) @ per
                flat = pa.array(white.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, white.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(far, pa.int64()), lists], ["vec_id", "deviation", "white"])

    return task


def whitened_vectors(embeddings: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, Summary | None, np.ndarray, np.ndarray, float, float]:
    """(vec_id, deviation, white) of every vector of the fit list; its summary; the components, their
    variances, the trace; the identity error."""
    spark = embeddings.sparkSession
    ship(spark)
    tables = Tables(spark)
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("x__", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = embeddings.select("vec_id", vector.alias("x__")).where(F.col("x__").isNotNull()).where(fine)
    lengths = given.groupBy(F.size("x__").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    shape = f"vec_id {dict(embeddings.dtypes)['vec_id']}, deviation long, white array<double>"
    nothing = spark.createDataFrame([], shape)
    if lengths is None or not lengths["dims"]:
        return nothing, None, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0
    dims = lengths["dims"]
    given = given.where(F.size("x__") == dims)
    fit = summary(given, "x__", dims, True, tables)
    axes, e, trace = components(fit, most)
    if not len(e):
        return nothing, fit, axes, e, trace, 0.0
    out = tables.put(given.mapInArrow(_whiten(fit.n, fit.sums, axes, e), shape))
    again = summary(out, "white", len(e), False, tables)
    error = float(np.abs(again.rows.T @ again.rows / again.n - np.eye(len(e))).max())
    return out, fit, axes, e, trace, error


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and
    component."""
    out, fit, _, e, trace, error = whitened_vectors(embeddings, most)
    explained = F.array(*[F.lit(float(v / trace)) for v in e]) if len(e) else F.array().cast("array<double>")
    rows = out.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"), explained.alias("share"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation", "whitened", F.element_at("share", F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
