"""Benchmark decontamination by one Aho-Corasick automaton.

Words are runs of ``[0-9a-z]`` and of characters beyond ASCII, after A-Z are
lower-cased. A window is 13 consecutive words of a benchmark text, or a whole shorter
text. Every window of 13 holds one of the pieces of 7 words that begin at the 0th, 7th,
14th ... word, so the automaton holds these pieces (and the shorter texts), written as
``" w1 w2 ... "``: about the size of the benchmark, not 13 times as much. A document is
normalised the same way and scanned once; around each piece that occurs, up to 6 words on
either side are compared, and 13 or more alike are a hit. Hits are word numbers, mapped
back to offsets in the original text.

Of a benchmark over ``BLOCK_CHARS`` only the pieces that occur in the documents enter the
automaton: hashes of the documents' runs of words are looked up in a bit table of all pieces, and
the pieces of which one was found are read from the benchmark. So any benchmark takes one scan by
one automaton, unless that much of it does occur: then what occurs is scanned for in parts, of
which only texts' names and what was found in them are written down.

Defined results: null and empty texts have no words (0 hits, not contaminated);
null benchmark texts have no windows; a benchmark row without ``item_id`` marks
words but is not listed among the items; equal benchmark rows count once;
repeated documents each get their own row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_LOWER, Tables, cut, lookup, sha256_hex, ship, trim
from .minhash import _mix

WINDOW, PIECE = 13, 7
#: characters of benchmark text in one automaton (32 bytes of memory each, about)
BLOCK_CHARS = 4_000_000
#: the bit table of all pieces has 2**MOST_BITS bits at most (32 MB)
MOST_BITS = 28
#: texts with hits that are broadcast
BROADCAST_ROWS = 20_000
#: contexts of one piece that are compared one by one; more are looked up by the words next to it
FEW = 16

_RUN = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_SPACE = bytes(b if _RUN.fullmatch(bytes([b])) else 32 for b in ASCII_LOWER)

RESULT = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start:int,stop:int>>"
)
EMPTY_SHA = sha256_hex(b"")


def normalise(text: str | None) -> list[bytes]:
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


class Pieces:
    """The automaton of a part of the benchmark, given as (item, text) or (item, text, the probes of
    those pieces that are wanted)."""

    def __init__(self, rows: list[tuple]):
        short: dict[str, set] = {}
        long: dict[str, dict] = {}
        for item, text, *found in rows:
            words, ids = normalise(text), () if item is None else (item,)
            occurs = None if not found else set(found[0])
            hashes = _word_hashes(words) if found else None
            if 0 < len(words) < WINDOW:
                if occurs is None or _probe(hashes[:PIECE]) in occurs:
                    short.setdefault(_key(words), set()).update(ids)
                continue
            for at in range(0, len(words) - PIECE + 1, PIECE):
                if occurs is not None and _probe(hashes[at : at + PIECE]) not in occurs:
                    continue
                context = tuple(words[max(0, at - WINDOW + PIECE) : at][::-1]), tuple(words[at + PIECE : at + WINDOW])
                long.setdefault(_key(words[at : at + PIECE]), {}).setdefault(context, set()).update(ids)
        self.automaton = ahocorasick.Automaton()
        for key in short.keys() | long.keys():
            self.automaton.add_word(key, (key.count(" ") - 1, short.get(key), self._by_neighbour(list(long.get(key, {}).items()))))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _by_neighbour(contexts: list) -> tuple[list, dict, dict]:
        if len(contexts) <= FEW:
            return contexts, {}, {}
        before: dict[bytes, list] = {}
        after: dict[bytes, list] = {}
        for x in contexts:
            (left, right), _ = x
            if left:
                before.setdefault(left[0], []).append(x)
            if right:
                after.setdefault(right[0], []).append(x)
        return [], before, after

    def scan(self, words: list[bytes], norm: str) -> tuple[list[tuple[int, int]], set]:
        """Word intervals [first, stop) inside hits, and the items hit."""
        spans, items = [], set()
        if not len(self.automaton):
            return spans, items
        at = seen = 0
        # A match ends at the space after its last word; spaces are counted once, left to right.
        for end, (n, ids, (contexts, before, after)) in self.automaton.iter(norm):
            seen += norm.count(" ", at, end + 1)
            at = end + 1
            first, stop = seen - 1 - n, seen - 1
            if ids is not None:
                spans.append((first, stop))
                items |= ids
            if before or after:  # 13 words hold a neighbour on one side at least
                contexts = [*(before.get(words[first - 1], ()) if first else ()), *(after.get(words[stop], ()) if stop < len(words) else ())]
            for (left, right), own in contexts:
                a, b = first, stop
                for w in left:
                    if a == 0 or words[a - 1] != w:
                        break
                    a -= 1
                for w in right:
                    if b == len(words) or words[b] != w:
                        break
                    b += 1
                if b - a >= WINDOW:
                    spans.append((a, b))
                    items |= own
        return spans, items


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _grams(hashes: np.ndarray, longest: int = PIECE) -> Iterator[np.ndarray]:
    """For n = 1, 2 ... up to ``longest``: a hash of every n words in a row."""
    run = _mix(hashes)
    for n in range(1, min(longest, len(hashes)) + 1):
        yield (_mix(run ^ np.uint64(n))).view(np.int64)
        run = _mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n:])


def _probe(hashes: np.ndarray) -> int:
    """The hash of one run of words."""
    *_, last = _grams(hashes)
    return int(last[0])


def _probes(text: str | None) -> list[tuple[int, int, int]]:
    """(hash, words, characters) of the beginnings of a benchmark text's pieces: of their first ``PIECE`` words."""
    words = normalise(text)
    hashes = _word_hashes(words)
    if 0 < len(words) < WINDOW:
        return [(_probe(hashes[:PIECE]), min(PIECE, len(words)), len(text))]
    return [(_probe(hashes[at : at + PIECE]), PIECE, sum(map(len, words[at : at + PIECE])) + PIECE) for at in range(0, len(words) - PIECE + 1, PIECE)]


def _key(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for first, stop in sorted(map(tuple, spans)):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return out


def original_spans(text: str, spans) -> list[dict]:
    """Word intervals as [start, stop) code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _RUN.finditer(raw.translate(ASCII_LOWER))]
    out, byte, chars = [], 0, 0
    for a, b in spans:
        ends = []
        for upto in (at[a][0], at[b - 1][1]):
            chars += len(raw[byte:upto].decode("utf-8", "surrogatepass"))
            byte = upto
            ends.append(chars)
        out.append({"start": ends[0], "stop": ends[1]})
    return out


def scanned(text: str | None, pieces) -> tuple[list, set]:
    words = normalise(text)
    if not words:
        return [], set()
    norm, spans, items = _key(words), [], set()
    for p in pieces:
        more, ids = p.scan(words, norm)
        spans += more
        items |= ids
    return merged(spans), items


def judge(text: str | None, spans, items) -> tuple:
    n, hit, ids = len(normalise(text)), sum(b - a for a, b in spans), sorted(items)
    return n, hit, len(ids), sha256_hex(",".join(ids).encode()) if ids else EMPTY_SHA, hit > 0 and 20 * hit >= n, ids, original_spans(text, spans) if spans else []


_BUILT: dict = {}


def _pieces(shared) -> Pieces:
    """Built once per worker; the key names this one broadcast, whatever its address."""
    if _BUILT.get("key") != shared.value["key"]:
        _BUILT.clear()
        _BUILT.update(key=shared.value["key"], pieces=Pieces(shared.value["rows"]))
    return _BUILT["pieces"]


def _told(benchmark: DataFrame) -> DataFrame:
    """Item and text of every benchmark row with a word; equal rows once."""
    told = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    return told.where(F.col("t").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).distinct()


def _share(spark, rows):
    return spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "rows": [tuple(r) for r in rows]})


COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]


def _judged(text: Column, shared: list) -> Column:
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            if len(shared) == 1:
                p = [_pieces(shared[0])]
                rows = [judge(t, *scanned(t, p)) for t in texts]
            else:  # one part after another, so memory stays that of one
                found = [([], set()) for _ in texts]
                for part in shared:
                    p = [Pieces(part.value["rows"])]
                    for (spans, items), t in zip(found, texts, strict=True):
                        more, ids = scanned(t, p)
                        spans += more
                        items |= ids
                rows = [judge(t, merged(spans), items) for t, (spans, items) in zip(texts, found, strict=True)]
            yield pd.DataFrame(rows, columns=COLUMNS)
        trim()

    return run(text)


def contamination(benchmark: DataFrame, text: Column, block_chars: int = BLOCK_CHARS) -> Column:
    """A struct column (see RESULT) that judges ``text`` against the whole benchmark, which the
    driver gathers: for benchmarks of a few parts. ``judged`` takes any."""
    spark = benchmark.sparkSession
    ship(spark)
    parts, size = [[]], 0
    for r in _told(benchmark).collect():
        if size and size + len(r["t"]) > block_chars:
            parts, size = [*parts, []], 0
        parts[-1].append(r)
        size += len(r["t"])
    return _judged(text, [_share(spark, p) for p in parts])


def _occurring(texts: DataFrame, told: DataFrame, tables: Tables) -> DataFrame:
    """i, t, found (probes), chars of the benchmark rows of which a piece may occur in ``texts`` (text)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t, *x) for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True) for x in _probes(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(("i", "t", "h", "n", "chars"), r, strict=True)) for r in rows], pa.schema([("i", pa.string()), ("t", pa.string()), ("h", pa.int64()), ("n", pa.int32()), ("chars", pa.int64())]))

    probes = tables.put(told.mapInArrow(pieces, "i string, t string, h long, n int, chars long"))
    count, shortest, longest = probes.agg(F.count_distinct("h"), F.min("n"), F.max("n")).first()
    bits = min(MOST_BITS, max(16, (16 * count - 1).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    # At most 2**(MOST_BITS - 6) rows reach the driver, and 2**(MOST_BITS - 3) bytes are broadcast.
    words = probes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))")).alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["at"].to_numpy()] = words["mask"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            hits = []
            for text in batch.column("text"):
                hashes = _word_hashes(normalise(text.as_py()))
                for n, h in enumerate(_grams(hashes, longest), 1):
                    if n >= shortest:
                        at = h.view(np.uint64) >> np.uint64(64 - bits)
                        hits.append(h[(known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64))], ["h"])
        trim()

    seen = texts.select("text").mapInArrow(runs, "h long").distinct()
    return tables.put(probes.join(seen, "h", "left_semi").groupBy("i", "t").agg(F.collect_set("h").alias("found"), F.sum("chars").alias("chars")))


STATE = "u1 long, u2 long, spans array<struct<a: int, b: int>>, items array<string>"
_STATE = pa.schema([("u1", pa.int64()), ("u2", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _finder(shared):
    """Of texts (u1, u2, text) those in which a part of the benchmark occurs, without the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = [_pieces(shared)]
        for batch in batches:
            out = []
            for u1, u2, text in zip(*(batch.column(c) for c in ("u1", "u2", "text")), strict=True):
                spans, items = scanned(text.as_py(), p)
                if spans:
                    out.append({"u1": u1.as_py(), "u2": u2.as_py(), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_pylist(out, _STATE)
        trim()

    return find


def _name(k: int) -> Column:
    """Half of a text's 128-bit name: equal texts have equal results."""
    return F.xxhash64(F.lit(k), F.col("text"))


def _judge_all(rows: DataFrame, benchmark: DataFrame, block_chars: int) -> DataFrame:
    """``rows`` (text, and whatever else but u1, u2 and judged) with a column ``judged`` (see RESULT)."""
    spark = benchmark.sparkSession
    told = _told(benchmark)
    if told.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] <= block_chars:
        return rows.withColumn("judged", contamination(benchmark, F.col("text"), block_chars))
    ship(spark)
    tables = Tables(spark)
    occurs = _occurring(rows, told, tables)
    size = occurs.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    if size <= block_chars:
        return rows.withColumn("judged", _judged(F.col("text"), [_share(spark, occurs.select("i", "t", "found").collect())]))
    parts = 2 * -(-size // block_chars)  # twice as many: a hash deals unevenly
    occurs = tables.put(occurs.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))))
    texts, states = rows.select(_name(1).alias("u1"), _name(2).alias("u2"), "text"), []
    for k in range(parts):
        shared = _share(spark, occurs.where(F.col("part") == k).select("i", "t", "found").collect())
        states.append(tables.put(texts.mapInArrow(_finder(shared), STATE).dropDuplicates(["u1", "u2"])))
    state = cut(reduce(DataFrame.unionByName, states).groupBy("u1", "u2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    tables.drop(*states)

    @F.pandas_udf(RESULT)
    def told_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans, items in batches:
            out = [judge(t if isinstance(t, str) else None, merged([] if x is None else [(y["a"], y["b"]) for y in x]), set() if i is None else set(i)) for t, x, i in zip(texts, spans, items, strict=True)]
            yield pd.DataFrame(out, columns=COLUMNS)

    found = lookup(rows.withColumns({"u1": _name(1), "u2": _name(2)}), state, ["u1", "u2"], "left", BROADCAST_ROWS)
    return found.withColumn("judged", told_of("text", "spans", "items")).select(*rows.columns, "judged")


def judged(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a column ``judged__`` (see RESULT), whatever the benchmark's size."""
    out = _judge_all(docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text")), benchmark, block_chars)
    return out.select("doc.*", F.col("judged").alias("judged__"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the contaminated ones; columns and order of columns unchanged, whatever their names."""
    out = _judge_all(docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text")), benchmark, block_chars)
    return out.where(~F.col("judged.contaminated")).select("doc.*")
