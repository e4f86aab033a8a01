"""Quality rules from tokeniser fertility.

Each text is encoded with a public vocabulary that falls back to bytes. Measured are
characters per token, the share of tokens that are bytes of a non-ASCII character, and
the entropy of its tokens against the most that so many tokens can have. The bands of
accepted values belong to a language and a length class (powers of two of the token
count): the quartiles of all documents of that group, from counts of rounded values,
widened by ``REACH`` times their distance. Groups with few documents take the bands of the whole language, then
those of all documents.

The base rules come first: under 10 words, or over a fifth of the words inside
repeated 5-word windows, fail.

Defined results: null and empty texts have no words and fail the base rules; a null
language is a language of its own; repeated documents each get their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import sp_bpe
from .common import cut, lookup, ship

REACH = 4.0
#: documents that a group needs for bands of its own
GROUP = 200
MEASURES = ("chars_per_token", "fallback_share", "entropy_share")
#: least half-width of a band, where quartiles coincide
SLACK = {"chars_per_token": 0.25, "fallback_share": 0.02, "entropy_share": 0.02}
#: places that each measure is rounded to for the quartiles, and the value from which it counts as that value
STEPS = {"chars_per_token": 256, "fallback_share": 4096, "entropy_share": 4096}
MOST = {"chars_per_token": 64.0, "fallback_share": 1.0, "entropy_share": 1.0}
#: groups whose bands are broadcast (about 100 bytes each); more are joined by a salted shuffle
BROADCAST_GROUPS = 100_000
_SYMBOLS = b"#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy_share double"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list, n: int = 5) -> int:
    """Words inside n-word windows that occur twice or more."""
    grams = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    first: dict = {}
    twice = bytearray(len(grams))
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            twice[i] = twice[j] = 1
    total = upto = 0
    for i in np.flatnonzero(np.frombuffer(twice, np.uint8)).tolist():
        total += i + n - max(i, upto)
        upto = i + n
    return total


def fertility(text: str, ids: np.ndarray, m: sp_bpe.PieceModel) -> tuple[int, float, float, float]:
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 1.0
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / n
    most = np.log2(n) if n > 1 else 1.0
    entropy = float(-(share * np.log2(share)).sum()) / most if n > 1 else 1.0
    return n, len(text) / n, float(m.high_byte[ids].mean()), entropy


def measured(path: str, text: Column) -> Column:
    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sp_bpe.model(path)
        if not hasattr(m, "high_byte"):
            m.high_byte = np.array([m.byte_of.get(i, 0) >= 128 for i in range(len(m.pieces))])
        try:
            for texts in batches:
                texts = [t if isinstance(t, str) else "" for t in texts]
                rows = [(*base_counts(t), *fertility(t, np.frombuffer(raw, "<u4"), m)) for t, raw in zip(texts, m.encode_all(texts), strict=True)]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
        finally:
            m.rest()

    return run(text)


def _bands(counts: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Bands by ``keys`` from counts of rounded values (c, v, n): exact nearest-rank quartiles
    whatever the order of merging; a group's values have STEPS places at most."""
    per = counts.groupBy(*keys, "c", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "c")
    ranked = per.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "all": F.sum("n").over(w)}).where(F.col("all") >= (GROUP if keys else 1))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("v")))
    ends = ranked.groupBy(*keys, "c").agg(at(0.25).alias("a"), at(0.75).alias("b"))
    bounds = []
    for i, c in enumerate(MEASURES):
        step = 1 / STEPS[c]
        a, b = (F.max(F.when(F.col("c") == i, F.col(x))) * step for x in "ab")
        reach = F.greatest(REACH * (b - a), F.lit(SLACK[c]))
        bounds.append(F.struct((a - reach).alias("low"), (b + reach).alias("high")).alias(f"{c}_{tag}"))
    return ends.groupBy(*keys).agg(*bounds)


def quality(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, the base counts, the measures, base_failed, kept."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang_"), measured(path, F.col("text")).alias("r")).select("doc_id", "lang_", "r.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    length = F.least(F.lit(16), F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")))).cast("int")
    rows = cut(rows.withColumns({"base_failed": failed, "length_": length}))
    fit = rows.where(~F.col("base_failed"))
    each = [F.struct(F.lit(i).alias("c"), F.round(F.least(F.col(c), F.lit(MOST[c])) * STEPS[c]).cast("int").alias("v")) for i, c in enumerate(MEASURES)]
    counts = fit.select("lang_", "length_", F.explode(F.array(*each)).alias("x")).groupBy("lang_", "length_", "x.c", "x.v").agg(F.count("*").alias("n"))
    counts = cut(counts)
    # Languages times 17 length classes: few, but nothing bounds the languages, so sizes are checked.
    out = rows
    for keys, tag in ((["lang_", "length_"], "a"), (["lang_"], "b")):
        out = lookup(out, cut(_bands(counts, keys, tag)), keys, "left", BROADCAST_GROUPS)
    out = out.join(F.broadcast(_bands(counts, [], "c")), F.lit(True), "left")  # one row
    good = ~F.col("base_failed")
    for c in MEASURES:
        band = F.coalesce(f"{c}_a", f"{c}_b", f"{c}_c")
        side = F.col(c) <= band["high"] if c == "fallback_share" else (F.col(c) >= band["low"]) if c == "entropy_share" else F.col(c).between(band["low"], band["high"])
        good = good & F.coalesce(side, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", good.alias("kept"), "n_tokens", *MEASURES)
