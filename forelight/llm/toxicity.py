"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct words (runs of letters and digits, A-Z lower-cased)
and the beginnings of its longer words, hashed to 2**18 buckets. Over a bounded sample
of labelled rows the machine learns a weight and a vector for every bucket that occurs,
so that pairs of terms count beyond their sum, also of terms that say little alone.
No bucket is screened: penalties, fitted along with all others, keep the weights of those
without evidence at or near zero. Weights are fitted by sparse Adagrad steps in numpy in
one executor task.

Only rows with crc32(doc_id as text) mod 3 other than 1 are learnt from.

Defined results: null and empty texts have no terms and get the score of a text
without features; rows whose label or doc_id is null teach nothing; a doc_id with
several labels teaches each; repeated documents each get their own row and teach once; without any
labelled row, or with one class only, every score is the share of toxic labels (0 if
there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, lookup, ship, trim
from .decontam import normalise

BUCKET_BITS = 18
#: documented bounds: labelled ids to learn from, terms of all their texts, length of the buckets' vectors
MAX_ROWS, MAX_TERMS, FACTORS = 20_000, 12_000_000, 8
EPOCHS, BATCH, RATE, RATE_V, ALONE = 30, 256, 0.3, 0.01, 10  # vectors move after ALONE epochs
PREFIX = 4
#: a weight's penalty, in standard errors of its gradient were the bucket unrelated to the labels;
#: it grows with the square of DOUBT at most, where the bucket alone has less than CLEAR standard
#: errors or less than ODDS log odds (words that merely come with long texts), and excludes none
SPARSE, DOUBT, CLEAR, ODDS = 0.3, 4.0, 3.5, 1.5
#: penalties on half the squares of vectors, by that standard error and by its square
DECAY, DECAY_OFTEN = 10.0, 0.3
THRESHOLD = 0.7
HOLD_MODULUS, HOLD = 3, 1


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's terms."""
    words = set(normalise(text))
    words |= {b"^" + w[:PREFIX] for w in words if len(w) > PREFIX}
    if not words:
        return np.empty(0, np.int32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(h & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_MODULUS == HOLD, F.lit(False))


def _row_sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of x over runs of its rows; an empty run gives 0."""
    out = np.zeros((len(sizes), *x.shape[1:]), x.dtype)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[full], axis=0)
    return out


def forward(cols: np.ndarray, sizes: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of rows whose features are the next sizes[i] of cols, and their sums of vectors."""
    some = v[cols]
    s = _row_sums(some, sizes)
    each = w[cols] - 0.5 * np.einsum("ij,ij->i", some, some)
    return w0 + _row_sums(each, sizes) + 0.5 * (s * s).sum(axis=1), s


def fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """All buckets that occur and the machine's weights."""
    y = labels.astype(np.float32)
    share = float(y.mean()) if len(y) else 0.0
    out = {"buckets": np.empty(0, np.int32), "w0": 0.0, "w": np.empty(0, np.float32), "v": np.empty((0, FACTORS), np.float32), "share": share}
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    if not 0 < share < 1 or not sizes.sum():
        return out
    seen = np.zeros(1 << BUCKET_BITS, bool)
    for r in rows:
        seen[r] = True
    buckets = np.flatnonzero(seen).astype(np.int32)
    place = np.cumsum(seen, dtype=np.int32) - 1
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    parts, often = [], np.zeros(len(buckets), np.float32)
    for k in range(0, len(order), BATCH):
        some = order[k : k + BATCH]
        cols = place[np.concatenate([rows[i] for i in some])]
        by = np.argsort(cols, kind="stable").astype(np.int32)
        first = np.flatnonzero(np.r_[True, np.diff(cols[by]) != 0][: len(cols)]).astype(np.int32)
        touched = cols[by][first]
        often[touched] += 1
        parts.append((cols, sizes[some], y[some], np.repeat(np.arange(len(some), dtype=np.int16), sizes[some])[by], first, touched))
    w0, w, v = np.float32(np.log(share / (1 - share))), np.zeros(len(buckets), np.float32), rng.normal(0, 0.02, (len(buckets), FACTORS)).astype(np.float32)
    a, b = np.zeros(len(buckets), np.int32), np.zeros(len(buckets), np.int32)
    for r, t in zip(rows, y, strict=True):
        (a if t > 0 else b)[place[r]] += 1
    pos, neg = y.sum(), len(y) - y.sum()
    odds = np.abs(np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (neg - b + 0.5))) + 1e-6
    error = np.sqrt(1 / (a + 0.5) + 1 / (pos - a + 0.5) + 1 / (b + 0.5) + 1 / (neg - b + 0.5))
    doubt = np.minimum(DOUBT, np.maximum(1, CLEAR * error / odds) * np.maximum(1, ODDS / odds))
    chance = np.sqrt((a + b) * share * (1 - share))
    # each batch that holds a bucket takes its part of the penalties
    sparse = (SPARSE * chance * doubt**2 / often).astype(np.float32)
    decay = ((DECAY * chance + DECAY_OFTEN * chance**2) / often).astype(np.float32)
    # Sums of squared gradients start at 1: a bucket of few rows takes small steps.
    q0, qw, qv = np.float32(1), np.ones_like(w), np.ones_like(v)
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(parts)):
            cols, n, truth, row, first, touched = parts[k]
            score, s = forward(cols, n, w0, w, v)
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - truth).astype(np.float32)
            q0 += g.sum() ** 2
            w0 -= RATE * g.sum() / np.sqrt(q0)
            if not len(touched):
                continue
            sums = np.add.reduceat(np.column_stack([g, g[:, None] * s])[row], first, axis=0)
            qw[touched] += sums[:, 0] ** 2
            pace = RATE / np.sqrt(qw[touched])
            new = w[touched] - pace * sums[:, 0]
            w[touched] = np.sign(new) * np.maximum(np.abs(new) - pace * sparse[touched], 0)
            if epoch < ALONE:
                continue
            held = v[touched]
            dv = sums[:, 1:] - held * sums[:, :1]
            qv[touched] += dv * dv
            pace = RATE_V / np.sqrt(qv[touched])
            v[touched] = (held - pace * dv) / (1 + pace * decay[touched][:, None])
    return out | {"buckets": buckets, "w0": float(w0), "w": w, "v": v}


def score_rows(rows: list[np.ndarray], model: dict) -> np.ndarray:
    best = model["buckets"]
    if not len(best):
        return np.full(len(rows), model["share"])
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[best] = np.arange(len(best), dtype=np.int32)
    out = np.empty(len(rows))
    for k in range(0, len(rows), 128):
        known = [c[c >= 0] for c in (place[r] for r in rows[k : k + 128])]
        out[k : k + 128] = forward(np.concatenate(known), np.fromiter(map(len, known), np.int64, len(known)), model["w0"], model["w"], model["v"])[0]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> dict:
    """Fit on about ``max_rows`` labelled training ids and ``max_terms`` terms of theirs at most, chosen by hashes."""
    spark = docs.sparkSession
    ship(spark)
    told = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out(F.col("id"))).distinct()
    place = lambda *c: F.pmod(F.xxhash64(F.lit(3), *c), F.lit(1_000_000))
    share = lambda most, n: F.lit(int(1_000_000 * min(1.0, most / max(1, n))))
    told = cut(told.where(place("id") < share(max_rows, told.count())))

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([terms(t if isinstance(t, str) else None).astype("<i4").tobytes() for t in texts], dtype=object)
        trim()

    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    # about max_rows ids at most, so they go to the texts; rows alike in all teach once
    rows = cut(lookup(texts, told, ["id"], "inner", 2 * MAX_ROWS).select("id", "toxic", packed("body").alias("terms")).distinct())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("terms")), F.lit(0))).first()[0] // 4
    if total > max_terms:
        rows = rows.where(place("id", "terms") < share(max_terms, total))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        trim()
        pdf = pdf.sort_values(["id", "toxic", "terms"], kind="stable")
        m = fit([np.frombuffer(r, "<i4") for r in pdf["terms"]], pdf["toxic"].to_numpy())
        return pd.DataFrame({"buckets": [m["buckets"].astype("<i4").tobytes()], "w0": [m["w0"]], "w": [m["w"].astype("<f4").tobytes()], "v": [m["v"].astype("<f4").tobytes()], "share": [m["share"]]})

    found = rows.groupBy(F.lit("all").alias("all")).applyInPandas(learn, "buckets binary, w0 double, w binary, v binary, share double").first()
    if found is None:
        return {"buckets": np.empty(0, np.int32), "share": 0.0}
    return {"buckets": np.frombuffer(found["buckets"], "<i4"), "w0": found["w0"], "w": np.frombuffer(found["w"], "<f4"), "v": np.frombuffer(found["v"], "<f4").reshape(-1, FACTORS), "share": found["share"]}


def toxicity(model: dict, docs: DataFrame) -> Column:
    """Score of column ``text`` of ``docs``; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_rows([terms(t if isinstance(t, str) else None) for t in texts], shared.value), dtype="float64")
        trim()

    return scored(F.col("text"))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    model = train(docs, labels, max_rows)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without those predicted toxic; same columns."""
    return docs.where(toxicity(train(docs, labels, max_rows), docs) < THRESHOLD)
