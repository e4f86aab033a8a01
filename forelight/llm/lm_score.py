"""Document log-likelihood from a gated recurrent language model.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end mark a
text. All training texts are counted. The most frequent words and the end mark are
symbols of the recurrent model, 1024 or twice the square root of the number of distinct
words where that is more; every other word belongs to one of 32 classes by its
last three bytes, and its probability is that of the class times its smoothed share of
the class, (c + 0.5) / (N_k + 0.5 (V_k + 1)), where all unseen words of a class share
one place. So the model is a distribution over the V counted words and the unseen.

After counting, every text is cut into words once more and kept as the numbers of its
symbols; training and scoring read those. The recurrent weights see every training text
once, in three rounds: texts are dealt by a hash to tasks of about TASK_TOKENS tokens, in
the order of that hash, whatever the files; each task learns from its texts by truncated
backpropagation from the round's common weights, and the results are averaged by tokens,
in two levels, so no task gathers one per task.

Counts of the 2**18 most frequent words go along with each task that cuts texts; all
other words are looked up by a join, so no vocabulary has to fit in one place.

Defined results: null and empty texts are the end mark alone; a null doc_id is not held
out; repeated documents each get their own row and each teach; without training texts
all weights stay as initialised and every word is unseen.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from . import gru
from .common import cut, keep_memory, ship, trim

SYMBOLS, RARE, NEAR = 1024, 32, 1 << 18
END = "\n"  # no word can hold it
ROUNDS = ((0, 1, 0.012), (1, 3, 0.008), (3, 8, 0.004))  # eighths of the texts, by hash; learning rate
CHUNK, SPREAD = 1 << 12, 64
#: tokens that a task learns from, about, and the most tasks of a round: beyond, tasks learn from more
TASK_TOKENS, MOST_TASKS = 2_000_000, 4096
TOKENS_AT_ONCE = 400_000
HOLD_MODULUS, HOLD = 5, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_MODULUS == HOLD, F.lit(False))


def symbols_of(distinct: int) -> int:
    """Symbols of the model for so many distinct words: they grow with the vocabulary."""
    return min(NEAR, max(SYMBOLS, 2 * math.isqrt(distinct)))


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % RARE


def rare_classes(words: pa.Array) -> np.ndarray:
    """The class of each of many words (binary); few last three bytes differ."""
    tails = pc.binary_slice(words, -3).dictionary_encode()
    return np.fromiter(map(rare_class, tails.dictionary.to_pylist()), np.int32, len(tails.dictionary))[tails.indices.to_numpy()]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts of a batch, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, at = lists.flatten(), lists.offsets.to_numpy()
    held = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty piece
    return words.filter(held), np.diff(np.r_[0, np.cumsum(held.to_numpy(zero_copy_only=False))][at - at[0]])


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts (without end marks). Each task counts its batches first."""

    def counted(batches):
        some, size = [], 0
        for batch in batches:
            found = words_of(batch.column(0))[0].value_counts()
            some.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            size += len(found)
            if size > 300_000:
                yield from _added_counts(some)
                some, size = [], 0
        if some:
            yield from _added_counts(some)
        trim()

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added_counts(some: list[pa.Table]) -> list[pa.RecordBatch]:
    if len(some) > 1:
        some = [pa.concat_tables(some).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
    return some[0].to_batches()


class Vocabulary:
    """What a task needs of the counts: the near words by rank, and the sums of each class."""

    def __init__(self, spec: dict):
        words = spec["words"].encode("utf-8").split(b" ") if spec["words"] else []
        self.counts = spec["counts"]
        self.end, self.kind = spec["end"], spec["kind"]
        words.insert(self.end, END.encode())
        self.words = pa.array(words, pa.binary())
        self.n_symbols = min(spec["symbols"], len(words))
        self.symbol = np.arange(len(words), dtype=np.int32)
        self.symbol[self.n_symbols :] = self.n_symbols + rare_classes(self.words[self.n_symbols :])
        self.class_log = np.log10(spec["class_n"] + 0.5 * (spec["class_v"] + 1))
        self.base_log = float(np.log10(spec["n"] + 0.5 * (spec["v"] + 1)))
        self.count_log = np.log10(self.counts + 0.5)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: not near) and symbol of each word."""
        words = words.cast(pa.binary())
        ranks = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        symbols, far = self.symbol[ranks], ranks < 0
        symbols[far] = self.n_symbols + rare_classes(words.filter(pa.array(far)))
        return ranks, symbols


_HELD: dict = {}


def _vocabulary(shared) -> Vocabulary:
    spec = shared.value
    if _HELD.get("key") != spec["key"]:
        _HELD.update(key=spec["key"], vocabulary=Vocabulary(spec))
    return _HELD["vocabulary"]


def gather(docs: DataFrame) -> tuple[dict, DataFrame]:
    """Sums and near words of the training texts, and the checkpointed table of all counts."""
    spark = docs.sparkSession
    taught = docs.where(~held_out(F.col("doc_id")))
    counts = cut(count_words(taught))
    ends = taught.select("doc_id").count()
    klass = (F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % RARE).cast("int")
    sums = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy(klass.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    # The near words: those above a count that at most NEAR words reach. The count is read from
    # a histogram of sixteenths of an octave, so no task sends its own list of top words.
    octave = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    least, room = 1 << 20, NEAR
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["o"]):
        room -= r["c"]
        if room < 0:
            break
        least = r["o"]
    near = counts.where(octave >= least).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")
    words, n = near["word"].tolist(), near["n"].to_numpy(np.int64)
    end = int(np.searchsorted(-n, -ends))  # the end mark has its place by count
    symbols = symbols_of(sum(b for _, b in sums.values()))
    end = min(end, symbols - 1)
    class_n, class_v = np.zeros(RARE), np.zeros(RARE)
    for k, (a, b) in sums.items():
        class_n[k], class_v[k] = a, b
    for w, c in zip(words[: symbols - 1], n.tolist(), strict=False):
        class_n[rare_class(w.encode())] -= c
        class_v[rare_class(w.encode())] -= 1
    spec = {
        "key": uuid.uuid4().hex, "kind": "<u2" if symbols + RARE < 1 << 16 else "<u4", "symbols": symbols, "words": " ".join(words), "counts": np.insert(n, end, ends), "end": end, "class_n": class_n, "class_v": class_v,
        "n": int(sum(a for a, _ in sums.values())) + ends, "v": int(sum(b for _, b in sums.values())) + (ends > 0),
    }
    return spec, counts


def _layout(model: dict) -> tuple[gru.Layout, dict]:
    """The classes of the symbols, and the initial weights."""
    layout = gru.Layout(model["counts"].astype(np.float64), RARE, max(32, math.isqrt(model["symbols"])))
    return layout, gru.start(layout, np.concatenate([model["counts"], model["class_n"]]))


def encoded(docs: DataFrame, shared) -> DataFrame:
    """doc_id, held_out and per text: token numbers, the parts of both scores that the near words
    give, the remaining words in one string, and the symbols as little-endian 32-bit numbers (16-bit
    where that is enough)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_encoded(batch.column(2), _vocabulary(shared))], names=[*batch.schema.names[:2], *kinds])
        trim()

    kinds = {"n_tokens": "long", "known": "long", "base": "double", "inside": "double", "far": "string", "n_far": "long", "symbols": "binary"}
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = StructType([*rows.schema.fields[:2], *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])
    return rows.mapInArrow(run, kind)


def _encoded(texts: pa.Array, voc: Vocabulary) -> list[pa.Array]:
    """Every distinct word of the batch is looked up once; what it adds goes to its occurrences."""
    words, n = words_of(texts)
    distinct = words.dictionary_encode()
    at = distinct.indices.to_numpy()
    ranks, symbols = voc.look_up(distinct.dictionary)
    near, other = ranks >= 0, symbols >= voc.n_symbols
    log = np.where(near, voc.count_log[ranks], 0.0)
    # a word that is no symbol of the model has its share of its class
    inside = np.where(other, log - voc.class_log[np.where(other, symbols - voc.n_symbols, 0)], 0.0)
    known = near & (voc.counts[ranks] > 0)
    owner = np.repeat(np.arange(len(n)), n)
    added = lambda x: np.bincount(owner, x[at], len(n))
    is_far = ~near[at]
    n_far = np.bincount(owner[is_far], minlength=len(n))
    ends = np.cumsum(n + 1) - 1
    row = np.full(len(at) + len(n), voc.end, voc.kind)
    row[np.arange(len(at)) + owner] = symbols[at]
    far = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_far)], pa.int32()), words.filter(pa.array(is_far)))
    offsets = (np.r_[0, ends + 1] * row.itemsize).astype(np.int32)
    return [
        pa.array(n + 1, pa.int64()),
        pa.array(added(known).astype(np.int64) + int(voc.counts[voc.end] > 0)),
        pa.array(added(log) + voc.count_log[voc.end] - (n + 1) * voc.base_log, pa.float64()),
        pa.array(added(inside), pa.float64()),  # numpy counts without rows are integers
        pc.binary_join(far, " "),
        pa.array(n_far, pa.int64()),
        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(row)]),
    ]


def _learner(now, shared, rate: float):
    """A task's training: batches of symbols to weighted sums of weights, in chunks."""

    def learn(batches):
        keep_memory()
        model = shared.value
        layout, first = _layout(model)
        trainer = gru.Trainer(gru.unpack(now.value, first), layout, model["end"], rate)
        texts, size = [], 0
        for batch in batches:
            for raw in batch.column(0):
                texts.append(np.frombuffer(raw.as_buffer(), model["kind"]).astype(np.int32))
                size += len(texts[-1])
                if size > TOKENS_AT_ONCE:
                    trainer.learn(texts)
                    texts, size = [], 0
        trainer.learn(texts)
        if trainer.tokens:
            out = trainer.flat.astype("<f8") * trainer.tokens
            parts = [out[k : k + CHUNK].tobytes() for k in range(0, len(out), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(trainer.tokens)] * len(parts)), pa.array(parts, pa.binary())], names=["chunk", "tokens", "total"])

    return learn


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<f8") for x in pdf["total"])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].astype("int32"), "tokens": [pdf["tokens"].sum()], "total": [total.tobytes()]})


def train(rows: DataFrame, shared, model: dict) -> np.ndarray:
    """The recurrent weights after all rounds, flat."""
    sc = rows.sparkSession.sparkContext
    flat = gru.pack(_layout(model)[1])
    taught = rows.where("not held_out").select("n_tokens", "symbols", F.xxhash64(F.lit(5), "doc_id").alias("part"), F.xxhash64(F.lit(6), "doc_id", "symbols").alias("place"))
    eighth = F.pmod("part", F.lit(8)).cast("int")
    tokens = {r["e"]: r["n"] for r in taught.groupBy(eighth.alias("e")).agg(F.sum("n_tokens").alias("n")).collect()}
    kind = "chunk int, tokens double, total binary"
    for low, high, rate in ROUNDS:
        now = sc.broadcast(flat)
        tasks = min(MOST_TASKS, max(1, -(-sum(tokens.get(e, 0) for e in range(low, high)) // TASK_TOKENS)))
        # only symbols move, two or four bytes a token
        some = taught.where((eighth >= low) & (eighth < high)).select("symbols", "place").repartition(tasks, "place").sortWithinPartitions("place").select("symbols")
        some = some.mapInArrow(_learner(now, shared, rate), kind)
        some = some.groupBy("chunk", F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("spread")).applyInPandas(lambda x: _added(x), kind)
        found = some.groupBy("chunk").applyInPandas(lambda x: _added(x), kind).orderBy("chunk").collect()
        if found:
            flat = np.concatenate([np.frombuffer(r["total"], "<f8") / r["tokens"] for r in found]).astype(np.float32)
    return flat


def _scored(symbols: Column, shared, weights) -> Column:
    """log10 probability of each text's symbols."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep_memory()
        model = shared.value
        layout, first = _layout(model)
        p = gru.unpack(weights.value, first)
        for some in batches:
            yield pd.Series(gru.score_texts(p, layout, model["end"], [np.frombuffer(x, model["kind"]) for x in some]) / np.log(10), dtype="float64")
        trim()

    return run(symbols)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    spec, counts = gather(docs)
    rows = cut(encoded(docs, sc.broadcast(spec)).withColumn("uid", F.monotonically_increasing_id()))
    n = min(spec["symbols"], len(spec["counts"]))
    model = {k: spec[k] for k in ("symbols", "end", "class_n", "kind")} | {"counts": spec["counts"][:n]}
    shared = sc.broadcast(model)
    weights = sc.broadcast(train(rows, shared, model))
    far = rows.where("n_far > 0").select("uid", F.explode(F.split("far", " ")).alias("word"))
    seen = F.coalesce(F.col("n"), F.lit(0))
    added = far.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.log10(seen + F.lit(0.5).cast("double"))).alias("logs"), F.count_if(seen > 0).alias("more"))
    out = rows.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", (F.col("inside") + _scored(F.col("symbols"), shared, weights)).alias("inside")).join(added, "uid", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(spec["n"]).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("inside") + logs).alias("score"))
