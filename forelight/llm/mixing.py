"""Mixing sources to target weights by balanced sampling with the cube method.

Sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share ``SHARE`` of all
sizes (words). A target stops at ``MOST`` times its source's size; what is over is shared again by
weight. Each document is taken ``target / source size`` times: whole times surely, and once more
with the probability that is left, such that each source's taken words and taken documents come
near what these probabilities say.

That is the cube method: three documents with open probabilities have one direction in which
neither the words nor the documents expected change. They move along it, one way or the other at
random, until a probability is 0 or 1; the next document takes that one's place. Blocks of about
``BLOCK`` documents do so on their own, the longest texts first, and leave two open documents each.
These meet in blocks again, until one block a source is left: the landing, in which the documents'
number is let go first, and the last open document is decided alone. A document of over 1 / ``LONG``
of its source's target hardly moves against short ones: it would stay open to the end and be missed,
or too much, as a whole. Such documents go first, each along the direction in which all others of its
block make up for its words and for itself by a little.

All random numbers are hashes of what the documents hold, so reruns agree, however rows are dealt to
files and tasks. Rows alike in doc_id, source and text are one unit of m rows: together they are taken
m times the ratio, so a group of copies of any size is one document of the cube.

Defined results: null, empty and blank texts have size 0 and are taken 0 words; their copies still
balance documents. A null source is a source, the last; a source of size 0 has target 0 and none of
its documents is taken. Null ids are ids. An empty table gives an empty result, an all-blank one
targets of 0. Further columns are ignored, or carried by ``mixed``.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Tables, cut, lookup, ship

#: fixed by the contract: weights of sources, share of all sizes (a fraction), most times a source
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
MOST = 2
#: documents a block
BLOCK = 4096
#: documents longer than 1 / LONG of their source's target are decided first
LONG = 1000
#: sources that are broadcast
BROADCAST_ROWS = 20_000
#: copies of one unit that one task writes
COPIES = 1 << 16
#: probabilities this near 0 or 1 have arrived
NEAR = 1e-9


def words_column(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 in code point order, null last: ranges are numbered on their
    own and moved by the rows before them. No more rows than ranges meet in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    parted = cut(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parted.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parted.join(F.broadcast(before), "part").select(*sources.columns, (F.col("before") + inside - 1).alias("place"))


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: what is under ``MOST`` times its size shares by
    weight what the others, at that limit, leave. One aggregate a round, until nobody new is over."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    told = cut(numbered(sources).select("source", "source_size", weight.alias("weight")))
    total = told.agg(F.sum("source_size")).first()[0] or 0
    top = F.col("source_size") * MOST
    over, wanted, weights = F.lit(False), 0, 0
    while True:
        # in 1 / SHARE[1] words, so that all sums are whole numbers
        full, open_, count = told.agg(F.coalesce(F.sum(F.when(over, top)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count(F.when(over, 1))).first()
        if (full, open_) == (wanted, weights):
            break
        wanted, weights = full, open_
        left = SHARE[0] * total - SHARE[1] * full
        share = F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(20,0)")
        over = over | (share >= (top * SHARE[1]).cast("decimal(30,0)") * F.lit(max(open_, 1)).cast("decimal(12,0)"))
    left = SHARE[0] * total - SHARE[1] * wanted
    shared = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(SHARE[1] * max(weights, 1)))
    return told.select("source", "source_size", F.when(over, top.cast("double")).otherwise(shared).alias("target"))


def flight(size: list[int], p: list[float], rng: random.Random, landing: bool, long: float = math.inf) -> list[float]:
    """Probabilities after the flight over documents given the longest first: all but two (with
    ``landing``: all) are 0 or 1, and neither their sum nor that of size * p has changed, but for the two
    documents of a landing. Documents over ``long`` words are decided first, where the others can."""
    p = _decide_long(np.array(size, np.float64), np.array(p, np.float64), rng, sum(s > long for s in size)).tolist()
    open_ = []
    for i in range(len(p)):
        if 0 < p[i] < 1:
            open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            step = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            _move(p, open_, step if any(step) else (1, -1, 0), rng)
    while landing and open_:
        a, b = size[open_[0]], size[open_[-1]]
        step = (1,) if len(open_) == 1 else (b, -a) if a and b else (0, 1) if a else (1, 0)
        _move(p, open_, step, rng)
    return p


def _decide_long(size: np.ndarray, p: np.ndarray, rng: random.Random, first: int) -> np.ndarray:
    """Decide the first documents one by one: each moves along the direction in which all open documents
    after it make up for its words and for itself, each by as much as its probability is open."""
    for i in range(first):
        while 0 < p[i] < 1:
            free = np.where((p > 0) & (p < 1), p * (1 - p), 0.0)
            free[: i + 1] = 0
            weight = free.sum()
            if not weight:
                break
            middle = (free * size).sum() / weight
            spread = (free * (size - middle) ** 2).sum()
            if spread <= NEAR * size[i] ** 2:
                break  # the others are alike: they cannot make up for both
            step = -free * (1 / weight + (size[i] - middle) / spread * (size - middle))
            step[i] = 1
            moves = step != 0
            room = np.where(step > 0, (1 - p), p)[moves] / np.abs(step[moves])
            back = np.where(step > 0, p, (1 - p))[moves] / np.abs(step[moves])
            ahead, back = room.min(), back.min()
            p = p + (ahead if rng.random() * (ahead + back) < back else -back) * step
            p[p < NEAR], p[p > 1 - NEAR] = 0, 1
    return p


def _move(p: list[float], open_: list[int], step: tuple, rng: random.Random) -> None:
    """Move the open probabilities along ``step`` or against it until one arrives; the two ways are taken
    with the chances that keep each probability's mean."""
    ahead = min(((1 - p[i]) if s > 0 else p[i]) / abs(s) for i, s in zip(open_, step, strict=True) if s)
    back = min((p[i] if s > 0 else (1 - p[i])) / abs(s) for i, s in zip(open_, step, strict=True) if s)
    way = ahead if rng.random() * (ahead + back) < back else -back
    for i, s in zip(open_, step, strict=True):
        p[i] += way * s
        if p[i] < NEAR or p[i] > 1 - NEAR:
            p[i] = float(round(p[i]))
    open_[:] = [i for i in open_ if 0 < p[i] < 1]


def _fly(seed: int, landing: bool):
    """Blocks of open documents: the longest first, so that what stays open at the end is short."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "u1", "u2"], ascending=[False, True, True])
        rng = random.Random(f"{seed}:{rows['source_key'].iat[0]}:{rows['block'].iat[0]}")
        return rows.assign(p=flight(rows["size"].tolist(), rows["p"].tolist(), rng, landing, rows["target"].iat[0] / LONG))

    return block


def _name(k: int, content: list[str]) -> Column:
    """One half of a unit's name: a hash of all that its rows have in common."""
    return F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in ("doc_id", "source", "text", *content)))


def _units(docs: DataFrame, known: list[str]) -> DataFrame:
    """One row for all rows alike in ``known`` and in u1, u2 (hashes of their content): how many they are."""
    return docs.groupBy(*known, "u1", "u2").agg(F.count("*").alias("m"))


def allocation(docs: DataFrame, content: list[str], seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Units of alike rows with doc_id, source, size, source_size, target, u1, u2, m (rows), base and more:
    each of the m rows is taken ``base`` times, and ``more`` of them once more. ``content``: the columns
    in which rows of a unit are alike, besides doc_id, source and text."""
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_column(F.col("text")).alias("size"), *(_name(k, content).alias(f"u{k}") for k in (1, 2)))
    units = tables.put(_units(narrow, ["doc_id", "source", "size"]))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    key = F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))
    aims = tables.put(targets(sources.select("source", "source_size")).withColumn("source_key", key))
    counts = sources.select(key.alias("source_key"), "units")
    small = tables.put(aims.join(counts, "source_key").drop("source"))
    told = lookup(units.withColumn("source_key", key), small, ["source_key"], "inner", BROADCAST_ROWS)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    told = told.withColumn("ratio", ratio).withColumn("base", F.least(F.floor("ratio"), F.lit(MOST)).cast("long"))
    share = (F.col("ratio") - F.col("base")) * F.col("m")
    told = tables.put(told.withColumn("sure", F.floor(share + NEAR).cast("long")).withColumn("p", F.greatest(F.lit(0.0), share - F.col("sure"))).drop("ratio"))

    here = ["source_key", "target", "u1", "u2", "size", "p", "block"]
    shape = "source_key string, target double, u1 long, u2 long, size long, p double, block long"
    dealt = lambda rows, n, turn: rows.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), F.lit(seed), "u1", "u2"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col(n) / block))))
    open_ = told.where(f"p > {NEAR} and p < {1 - NEAR}")
    rows, turn, settled = dealt(open_, "units", 0).select(*here), 0, None
    most = small.agg(F.max("units")).first()[0] or 0
    while True:
        landing = most <= block
        flown = tables.put(rows.groupBy("source_key", "block").applyInPandas(_fly(seed + turn, landing), shape))
        landed = flown.where("p = 0 or p = 1")
        settled = landed if settled is None else settled.unionByName(landed)
        if landing:
            break
        turn += 1
        left = flown.where("p > 0 and p < 1")
        counts = tables.put(left.groupBy("source_key").agg(F.count("*").alias("left")))
        most = counts.agg(F.max("left")).first()[0] or 0
        joined = lookup(left.drop("block"), counts, ["source_key"], "inner", BROADCAST_ROWS)
        rows = dealt(joined, "left", turn).select(*here)
    extra = settled.where("p = 1").select("source_key", "u1", "u2", F.lit(1).cast("long").alias("extra"))
    out = told.join(extra, ["source_key", "u1", "u2"], "left")
    rounded = F.when(F.col("p") >= 1 - NEAR, 1).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "u1", "u2", "m", "base", (F.col("sure") + F.coalesce("extra", rounded)).alias("more"))


def _each(units: DataFrame) -> DataFrame:
    """A row for each of a unit's m rows, with ``copies``, how often it is taken. Units of very many rows
    are cut into pieces that go to different tasks."""
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    few = units.where(F.col("m") <= COPIES).withColumn("k", k)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPIES}")))
    pieces = units.where(F.col("m") > COPIES).withColumn("piece", piece).repartition("u1", "u2", "piece")
    some = F.explode(F.sequence(F.expr(f"piece * {COPIES} + 1"), F.expr(f"least(m, (piece + 1) * {COPIES})")))
    many = pieces.withColumn("k", some).drop("piece")
    return few.unionByName(many).withColumn("copies", F.col("base") + (F.col("k") <= F.col("more")).cast("long")).drop("k")


def mix_documents(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document."""
    rows = _each(allocation(docs.select("doc_id", "source", "text"), [], seed, block))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def mixed(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns. The rows of a unit
    are alike in every column, so its first stands for all."""
    content = sorted(set(docs.columns) - {"doc_id", "source", "text"})
    units = allocation(docs, content, seed, block)
    counted = cut(units.select("u1", "u2", "m", (F.col("m") * F.col("base") + F.col("more")).alias("copies")).where("copies > 0"))
    # the document travels as one value, so that no name of its columns can clash
    named = docs.select(F.struct("*").alias("doc"), *(_name(k, content).alias(f"u{k}") for k in (1, 2)))
    found = named.join(counted, ["u1", "u2"])
    whole = found.where("m = 1").unionByName(found.where("m > 1").dropDuplicates(["u1", "u2"]))
    return whole.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
