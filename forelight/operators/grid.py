"""Complete time grids, and row frames over them without a global sort.

On a complete grid "h rows later" is "h intervals later", so a row's number is
arithmetic. Frames that reach back L rows run inside blocks of rows; each block also
gets the last L rows of the block before (its halo), so blocks are independent tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

ZERO = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
BLOCK = 3_600
#: rows of the frames that longer ones are put together from
PART = 15


def at_second(seconds: str) -> str:
    """The time so many seconds after ZERO; no 32-bit number is in between."""
    return f"({ZERO} + make_dt_interval(CAST(({seconds}) div 86400 AS INT), 0, 0, CAST(({seconds}) % 86400 AS DECIMAL(18, 6))))"


def bucket(ts: str, seconds: int) -> str:
    return at_second(f"(timestampdiff(SECOND, {ZERO}, {ts}) div {seconds}) * {seconds}")


def complete(bars: DataFrame, seconds: int, low: int | None, high: int | None) -> DataFrame:
    """One row for each interval from label ``low`` to ``high`` (seconds after ZERO): the grid is a
    distributed range."""
    spark = bars.sparkSession
    if low is None:
        return bars
    steps = (high - low) // seconds + 1
    grid = spark.range(0, steps).selectExpr(f"{at_second(f'{low} + id * {seconds}')} AS ts")
    return grid.join(bars, "ts", "left")


def blocked(df: DataFrame, back: int, index: str = "idx", size: int = BLOCK, ahead: int = 0) -> DataFrame:
    """Rows with their block, and copies (halo): of the last ``back`` rows of a block for the next one,
    of its first ``ahead`` rows for the one before."""
    size = max(size, back, ahead)
    own = F.floor(F.col(index) / size).cast("long")
    blocks = F.when(F.col(index) % size >= size - back, F.array(own, own + 1)).otherwise(F.array(own))
    if ahead:
        blocks = F.when((F.col(index) % size < ahead) & (own > 0), F.array_append(blocks, own - 1)).otherwise(blocks)
    return df.withColumn("block", F.explode(blocks)).withColumn("halo", own != F.col("block"))


def block_window(index: str = "idx"):
    return Window.partitionBy("block").orderBy(index)


def unblocked(df: DataFrame) -> DataFrame:
    return df.where("NOT halo").drop("block", "halo")


def carry_last(rows: DataFrame, column: str, back: int, index: str = "idx", size: int = BLOCK) -> DataFrame:
    """``block`` of ``blocked(rows, back)`` and the last non-null value of ``column`` before its halo starts."""
    size = max(size, back)
    ends = rows.groupBy(F.floor((F.col(index) + back) / size).cast("long").alias("block")).agg(F.expr(f"max_by({column}, {index}) FILTER (WHERE {column} IS NOT NULL)").alias("end"))
    # one row a block
    return ends.select("block", F.last("end", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))


def rolling_sums(b: DataFrame, column: str, sizes: Sequence[int], part: int = PART) -> DataFrame:
    """``b``, rows in blocks, with n_<size> and s_<size>: count and sum (0 of none) of ``column`` in the last
    so many rows. Frames of ``part`` rows are summed first, longer ones put together from them: a row
    costs ``part`` values and a few sums, not every value of every frame."""
    w = block_window()
    frame = lambda size: w.rowsBetween(-(size - 1), 0)
    whole = [s for s in sizes if s % part == 0]
    agg = lambda size: {"n_": F.count(column).over(frame(size)), "s_": F.coalesce(F.sum(column).over(frame(size)), F.lit(0e0))}
    b = b.withColumns({f"{c}part": e for c, e in agg(part).items()} | {f"{c}{s}": e for s in sizes if s % part for c, e in agg(s).items()})
    at = range(part, max(whole, default=0), part)
    b = b.withColumns({f"{c}at{k}": F.coalesce(F.lag(f"{c}part", k).over(w), F.lit(0)) for c in ("n_", "s_") for k in at})
    b = b.withColumns({f"{c}{s}": F.expr(" + ".join([f"{c}part", *(f"{c}at{k}" for k in at if k < s)])) for c in ("n_", "s_") for s in whole})
    return b.drop(*[f"{c}{x}" for c in ("n_", "s_") for x in ("part", *(f"at{k}" for k in at))])
