"""Exact quantiles of any column by radix selection: no group, buffer or sort of all values.

A double maps to a 64-bit integer in the same order. A histogram of its leading 16 bits shows which
bins hold the wanted ranks; only those are looked into, by the next 16 bits, until a bin's values
are all equal or the bits are used up: at most four aggregates whose states are bins. What reaches the
driver are the few bins asked for."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

#: bits looked at in one pass; a pass has at most 2**DIGIT bins for each of the last one's that is refined
DIGIT = 16


def ordered_key(x: str) -> str:
    """A finite double as a 64-bit integer in the same order, equal just where the numbers are: exponent
    and mantissa side by side, so a logarithm that is off by one at a power of two changes nothing."""
    size = f"abs({x})"
    exponent = f"greatest(-1022e0, least(1023e0, floor(log2({size}))))"
    bits = f"((CAST({exponent} AS BIGINT) + 1022) * 4503599627370496 + CAST(floor({size} / power(2e0, {exponent}) * 4503599627370496e0) AS BIGINT))"
    return f"(CASE WHEN {x} = 0 THEN 0L WHEN {x} > 0 THEN {bits} ELSE -{bits} END)"


def ranked_values(values: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """The values at the given ranks (from 0) among the non-null ones. ``values`` is read once a pass."""
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).withColumn("key", F.expr(ordered_key("x")))
    wanted = {r: (None, r) for r in ranks}  # rank -> the bin it is in, the rank there
    found: dict[int, float] = {}
    shift = 64
    while wanted:
        shift -= DIGIT
        inside = rows if shift + DIGIT == 64 else rows.withColumn("above", F.shiftright("key", shift + DIGIT)).where(F.col("above").isin(sorted({p for p, _ in wanted.values()})))
        above = F.lit(None).cast("long") if shift + DIGIT == 64 else F.col("above")
        bins = inside.groupBy(above.alias("above"), F.shiftright("key", shift).alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        bins = bins.withColumn("upto", F.sum("c").over(Window.partitionBy("above").orderBy("bin")))
        asked = F.lit(False)
        for p, r in wanted.values():
            asked = asked | (F.col("above").eqNullSafe(F.lit(p)) & (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r))
        here = bins.where(asked).collect()  # no more than ranks
        for rank, (p, r) in list(wanted.items()):
            b = next(b for b in here if b["above"] == p and b["upto"] > r >= b["upto"] - b["c"])
            if b["low"] == b["high"] or shift == 0:
                found[rank] = b["low"]
                del wanted[rank]
            else:
                wanted[rank] = (b["bin"], r - (b["upto"] - b["c"]))
    return [found[r] for r in ranks]


def quantiles(values: DataFrame, column: str, shares: Sequence[float], interpolate: bool = True) -> list[float | None]:
    """Quantiles of the non-null values: between the neighbours of share * (n - 1), or (without
    ``interpolate``) the value of the nearest rank, the least that share of all do not exceed. None
    where there is no value."""
    n = values.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    if not interpolate:
        return ranked_values(values, column, [max(0, math.ceil(q * n) - 1) for q in shares])
    at = [(math.floor(q * (n - 1)), math.ceil(q * (n - 1)), q * (n - 1)) for q in shares]
    ranks = sorted({r for low, high, _ in at for r in (low, high)})
    value = dict(zip(ranks, ranked_values(values, column, ranks), strict=True))
    return [value[a] if a == b or value[a] == value[b] else (b - x) * value[a] + (x - a) * value[b] for a, b, x in at]
