"""Removal of lines that are boilerplate across sites.

A line is the text between line ends without blanks at its ends; blank lines never
count. A site is the ``source`` of a document. Per line hash (128 bits) a HyperLogLog
sketch of its sites is built, partially on each task and merged by aggregation. Lines
whose estimate is clearly at or over ``min_sites`` are boilerplate; lines within the
sketch's error band around it get an exact distinct count.

A document loses its boilerplate lines, whatever their share of it. Copies of a whole
document on many sites spread its lines too; with ``whole_copies`` (off by default) such
lines are told apart by where they stand: a line most of whose documents consist mostly
of spread lines owes its spread to copies and stays, for near-duplicate removal to keep
one of them, while a menu or a licence, most of whose documents have text of their own,
goes from all documents, short ones too.

Defined results: null and empty texts have no lines and stay as they are; a null
source is no site; texts without a removed line stay byte for byte; repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, lookup, ship, trim

MIN_SITES = 10
SKETCH_BITS = 10
#: boilerplate lines that go to the texts (16 bytes each); more are joined by a shuffle
BROADCAST_LINES = 1_000_000
BLANKS = " \t\r\v\f"


def _hashes(*cols: Column) -> list[Column]:
    return [F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)]


def _lines(docs: DataFrame, *keep: Column) -> DataFrame:
    at = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    at = at.withColumn("line", F.trim("line", F.lit(BLANKS)))
    l1, l2 = _hashes(F.col("line"))
    return at.select(*[c for c in at.columns if c != "line"], l1.alias("l1"), l2.alias("l2"), (F.col("line") != "").alias("full"), F.size(F.split("line", r"[\x20\x09-\x0D]+")).alias("words"))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes l1, l2 of the lines on at least ``min_sites`` sites."""
    pairs = _lines(docs, F.col("source").cast("string").alias("site")).where("full and site is not null").select("l1", "l2", "site")
    spread = pairs.groupBy("l1", "l2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
    band = 3 * 1.04 / (1 << SKETCH_BITS) ** 0.5
    seen = cut(spread.where(F.col("sites") >= F.lit(min_sites * (1 - band))))
    clear = seen.where(F.col("sites") >= F.lit(min_sites * (1 + band))).select("l1", "l2")
    near = seen.where(F.col("sites") < F.lit(min_sites * (1 + band))).select("l1", "l2")
    # Lines in the band are few; one row for each of them and site is counted, so a frequent line is no hot key.
    near = cut(near)
    exact = lookup(pairs, near, ["l1", "l2"], "left_semi", BROADCAST_LINES).distinct().groupBy("l1", "l2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("l1", "l2")
    return clear.unionByName(exact)


def _hits(shared):
    """Which of a text's lines, given as their two hashes, are in the shared table (sorted by the first)."""

    @F.pandas_udf("array<boolean>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        one, two, most = shared.value
        for first, second in batches:
            sizes = [0 if x is None else len(x) for x in first]
            a, b = (np.concatenate([np.asarray(x, np.int64) for x in xs if x is not None] or [np.zeros(0, np.int64)]) for xs in (first, second))
            at, found = np.searchsorted(one, a), np.zeros(len(a), bool)
            for k in range(most):  # lines that share the first hash; 1 but for chance
                near = np.minimum(at + k, len(one) - 1)
                found |= (one[near] == a) & (two[near] == b)
            ends = np.cumsum([0, *sizes])
            yield pd.Series([None if x is None else found[ends[i] : ends[i + 1]].tolist() for i, x in enumerate(first)], dtype=object)
        trim()

    return run


def _share(lines: DataFrame):
    """The lines l1, l2, at most ``BROADCAST_LINES``, as arrays on all workers."""
    told = lines.select("l1", "l2").toArrow()
    one, two = (told[c].to_numpy() for c in ("l1", "l2"))
    order = np.argsort(one, kind="stable")
    one = one[order]
    most = int(np.unique(one, return_counts=True)[1].max()) if len(one) else 0
    return lines.sparkSession.sparkContext.broadcast((one if len(one) else np.zeros(1, np.int64), two[order] if len(one) else np.ones(1, np.int64), most))


def _marked(docs: DataFrame, shared, *keep: Column) -> DataFrame:
    """``keep``, lines (trimmed, as the text has them), l1s, l2s and hits of every document, where it stands:
    only hashes of lines go to Python, and nothing is shuffled."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    hashed = docs.select(*keep, lines.alias("lines")).withColumns({"l1s": F.transform("lines", lambda x: _hashes(x)[0]), "l2s": F.transform("lines", lambda x: _hashes(x)[1])})
    return hashed.withColumn("found", _hits(shared)("l1s", "l2s")).withColumn("hits", F.zip_with("found", "lines", lambda h, x: h & (x != ""))).drop("found")


def _borne_by_copies(docs: DataFrame, shared) -> DataFrame:
    """l1, l2 of the spread lines most of whose documents consist mostly of such lines; each document once."""
    key = _hashes(F.col("doc_id"), F.col("text"))
    words = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"[\x20\x09-\x0D]+")))
    m = _marked(docs, shared, key[0].alias("k1"), key[1].alias("k2")).where(F.exists("hits", lambda h: h))
    counts = F.zip_with("hits", "lines", lambda h, x: F.struct(h.alias("h"), words(x).alias("w")))
    m = m.withColumn("counts", counts)
    total = lambda keep: F.aggregate(F.filter("counts", keep), F.lit(0), lambda a, x: a + x["w"])
    hit = F.array_distinct(F.transform(F.filter(F.arrays_zip("l1s", "l2s", "hits"), lambda x: x["hits"]), lambda x: F.struct(x["l1s"].alias("l1"), x["l2s"].alias("l2"))))
    each = m.select("k1", "k2", (2 * total(lambda x: x["h"]) > total(lambda x: F.lit(True))).alias("mostly"), F.explode(hit).alias("l")).distinct()
    return each.groupBy("l.l1", "l.l2").agg(F.avg(F.col("mostly").cast("int")).alias("share")).where("share > 0.5").select("l1", "l2")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, report: bool = False, whole_copies: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; same rows and columns. ``report`` adds
    n_lines, n_boilerplate (lines on enough sites) and n_removed. ``whole_copies``: see above.

    The spread lines go to the texts, which stay where they are; only where there are more than
    ``BROADCAST_LINES`` are lines and texts joined by a shuffle."""
    ship(docs.sparkSession)
    lines = cut(boilerplate_lines(docs, min_sites))
    if lines.count() > BROADCAST_LINES:
        return _remove_by_shuffle(docs, lines, report, whole_copies)
    spread = _share(lines)
    going = spread
    if whole_copies:
        going = _share(cut(lines.join(F.broadcast(cut(_borne_by_copies(docs, spread))), ["l1", "l2"], "left_anti")))  # fewer than lines
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = _marked(docs, going, row)
    removed = F.coalesce(F.size(F.filter("hits", lambda h: h)), F.lit(0)).cast("long")
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(F.split("row.text", "\n").alias("line"), F.col("hits").alias("hit")), lambda x: ~x["hit"]), lambda x: x["line"]), "\n")
    text = F.when(removed > 0, kept).otherwise(F.col("row.text"))
    out = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if report:
        told = F.col("hits") if not whole_copies else F.zip_with(_hits(spread)("l1s", "l2s"), "lines", lambda h, x: h & (x != ""))
        full = F.coalesce(F.size(F.filter("lines", lambda x: x != "")), F.lit(0))
        out += [full.cast("long").alias("n_lines"), F.coalesce(F.size(F.filter(told, lambda h: h)), F.lit(0)).cast("long").alias("n_boilerplate"), removed.alias("n_removed")]
    return both.select(*out)


def _remove_by_shuffle(docs: DataFrame, lines: DataFrame, report: bool, whole_copies: bool) -> DataFrame:
    columns = docs.columns
    lines = lines.withColumn("hit", F.lit(True))
    key = _hashes(F.col("doc_id"), F.col("text"))
    told = lookup(_lines(docs, key[0].alias("k1"), key[1].alias("k2")), lines, ["l1", "l2"], "left", BROADCAST_LINES)
    hit = F.coalesce(F.col("hit") & F.col("full"), F.lit(False))
    words = F.when(F.col("full"), F.col("words")).otherwise(0)
    at = [F.col("pos"), hit.alias("hit")] + [F.when(hit, F.col(x)).alias(x) for x in ("l1", "l2") if whole_copies]
    flagged = (
        told.groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set(F.struct(*at))).alias("at"), F.sum(words).alias("all_words"), F.sum(F.when(hit, words).otherwise(0)).alias("hit_words"))
        .where("hit_words > 0")
        .withColumn("n_hit", F.size(F.filter("at", lambda x: x["hit"])).cast("long"))
    )
    if whole_copies:
        flagged = cut(flagged.withColumn("mostly", 2 * F.col("hit_words") > F.col("all_words")))
        of_line = flagged.select("mostly", F.explode(F.array_distinct(F.transform(F.filter("at", lambda x: x["hit"]), lambda x: F.struct(x["l1"].alias("l1"), x["l2"].alias("l2"))))).alias("l")).groupBy("l.l1", "l.l2")
        borne = cut(of_line.agg(F.avg(F.col("mostly").cast("int")).alias("share")).where("share > 0.5").select("l1", "l2")).withColumn("stays", F.lit(True))
        spots = lookup(flagged.select("k1", "k2", "n_hit", F.explode("at").alias("x")).select("k1", "k2", "n_hit", "x.*"), borne, ["l1", "l2"], "left", BROADCAST_LINES)
        spot = F.struct("pos", (F.col("hit") & F.col("stays").isNull()).alias("hit"))
        flagged = spots.groupBy("k1", "k2").agg(F.max("n_hit").alias("n_hit"), F.sort_array(F.collect_set(spot)).alias("at"))
    flagged = flagged.select("k1", "k2", "n_hit", F.transform("at", lambda x: x["hit"]).alias("hits"))
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key[0].alias("k1"), key[1].alias("k2")).join(flagged.hint("shuffle_hash"), ["k1", "k2"], "left")
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(F.split("row.text", "\n").alias("line"), F.col("hits").alias("hit")), lambda x: ~x["hit"]), lambda x: x["line"]), "\n")
    removed = F.coalesce(F.size(F.filter("hits", lambda h: h)), F.lit(0)).cast("long")
    text = F.when(removed > 0, kept).otherwise(F.col("row.text"))
    out = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]
    if report:
        full = F.coalesce(F.size(F.filter(F.split("row.text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)), F.lit(0))
        out += [full.cast("long").alias("n_lines"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_boilerplate"), removed.alias("n_removed")]
    return both.select(*out)
