"""Sharding along a Hilbert curve, in DataFrame operations only.

Four metadata dimensions - language, source, size and doc_id - are quantised to three bits each,
by rank: a value's code is the eighth of all rows that come before it, so codes are as even as
the values allow, whatever their range, and the range of values of a run of rows is narrow. Codes
need the seven values at the ends of the eighths: distinct values are counted, dealt by range,
and summed up from range to range. Rows are ordered by the index of their cell on the
four-dimensional Hilbert curve and cut into runs of equal row counts (law ``rows``), so each
file covers a compact box of every dimension and file statistics prune on any of them.

A global rank needs no global sort: the cells (4096 at most) are counted, crowded
cells are split by a hash of doc_id and text, the counts of the resulting buckets are
summed up in curve order, and rows are numbered inside their bucket. A source, a text, a
doc_id or a repeated row that holds a third of all rows is spread over as many buckets as its
count asks for: rows alike are counted first, and each gets a number and with it a hash of its own.

Defined results: a null text has size 1 and the checksum of the empty text; null
metadata come before all values; doc_ids are ranked in their own order, numbers or strings; null
ones come first in their bucket; repeated rows get different slots; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

BITS, DIMS = 3, 4
#: buckets that crowded cells add, about, and rows that a bucket may have at least and at most
BUCKETS, LEAST, MOST = 1024, 1000, 1_000_000
#: repeated rows that one task writes
COPIES = 1 << 16


def size_column(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def eighths(df: DataFrame, column: str, total: int, parts: int = 1 << BITS) -> list:
    """The values at which the first, second ... of ``parts`` equal shares of all rows end, nulls first: the
    least that so many rows do not exceed. Ranges of the distinct values are summed up on their own and
    moved by the ranges before; what reaches the driver are these values."""
    order = F.col(column).asc_nulls_first()
    counts = cut(df.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sums = counts.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = [-(-total * j // parts) for j in range(1, parts)]
    told = counts.join(F.broadcast(before), "part").withColumn("upto", upto)  # a row a range
    here = told.where(F.exists(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: (e <= F.col("upto")) & (e > F.col("upto") - F.col("n")))).select(column, "n", "upto").collect()
    return [next(r[column] for r in here if r["upto"] >= e > r["upto"] - r["n"]) for e in ends]


def quantised(df: DataFrame) -> DataFrame:
    """x0..x3, each below 2**BITS: the ranks of lang, source, size and doc_id."""
    total = df.count()
    for i, c in enumerate(("lang", "source", "size", "doc_id")):
        code = F.lit(0)
        for end in eighths(df, c, total) if total else ():
            over = F.col(c).isNotNull() if end is None else F.coalesce(F.col(c) > F.lit(end), F.lit(False))
            code = code + over.cast("int")
        df = df.withColumn(f"x{i}", code)
    return df


def curve_index(df: DataFrame, dims: int = DIMS, bits: int = BITS, name: str = "h") -> DataFrame:
    """Replaces x0..x{dims-1} by their index on the Hilbert curve: the axes are turned
    into the transposed index level by level, then its bits are interleaved. Every
    step is one projection, so expressions stay small."""
    x = [f"x{i}" for i in range(dims)]
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(dims):
            set_ = F.col(x[i]).bitwiseAND(F.lit(q)) != 0
            if i == 0:
                df = df.withColumn(x[0], F.when(set_, F.col(x[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(x[0])))
            else:
                t = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(p))
                df = df.withColumns({x[0]: F.col(x[0]).bitwiseXOR(F.when(set_, F.lit(p)).otherwise(t)), x[i]: F.when(set_, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(t))})
    for i in range(1, dims):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    t = F.lit(0)
    for level in range(bits - 1, 0, -1):
        t = t.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("t_", t)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("t_")) for c in x})
    index = F.lit(0)
    for level in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(F.col(c), level).bitwiseAND(F.lit(1))
    return df.withColumn(name, index.cast("int")).drop("t_", *x)


def hilbert_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, lang, source of every row."""
    narrow = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), size_column(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    # The text is read once; what follows reads only this narrow table, each row once with its copies.
    alike = ["doc_id", "size", "text_crc32", "lang", "source"]
    counted = cut(narrow.groupBy(*alike).agg(F.count("*").alias("m")))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    pieces = counted.where(F.col("m") > COPIES).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPIES}")))).repartition(*alike, "piece")
    some = F.explode(F.sequence(F.expr(f"piece * {COPIES}"), F.expr(f"least(m, (piece + 1) * {COPIES}) - 1")))
    each = counted.where(F.col("m") <= COPIES).select(*alike, copy.alias("copy")).unionByName(pieces.select(*alike, some.alias("copy")))
    tie = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"), F.when(F.col("copy") > 0, F.concat(F.lit(":"), F.col("copy").cast("string"))).otherwise(F.lit(""))).cast("binary"))
    rows = cut(curve_index(quantised(cut(each))).select(*alike, "h", "copy", F.substring(tie, 1, 8).alias("tie")))
    cells = rows.groupBy("h").agg(F.count("*").alias("n"))
    total = rows.count()
    target = max(LEAST, min(MOST, -(-total // BUCKETS)))
    # At most 2**(BITS * DIMS) cells: a proven bound.
    cells = cells.select("h", F.ceil(F.col("n") / target).cast("int").alias("parts"))
    part = F.floor(F.coalesce(F.conv(F.col("tie"), 16, 10).cast("long"), F.lit(0)) * F.col("parts") / F.lit(1 << 32)).cast("int")
    dealt = rows.join(F.broadcast(cells), "h").withColumn("part", part).drop("parts")
    # At most cells + BUCKETS rows, or one for MOST rows.
    upto = Window.orderBy("h", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("h", "part").agg(F.count("*").alias("n")).select("h", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("h", "part").orderBy("tie", F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "copy")
    ranked = dealt.join(F.broadcast(offsets), ["h", "part"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    n = max(1, total)
    shard = F.expr(f"cast((rank * {shards}) div {n} as int)")
    start = F.expr(f"((shard * {n}L) + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "lang", "source")


def write_shards(rows: DataFrame, path: str, files_per_shard: int = 1, shards: int = 8) -> None:
    """Write rows that carry shard and slot, in slot order, each shard in its own folder, in files
    that are runs of the curve: their statistics on lang, source, size and doc_id are narrow."""
    rows.repartitionByRange(files_per_shard * shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
