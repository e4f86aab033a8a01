"""Token counts by byte-pair merging with a heap and a linked list.

The text is cut by the vocabulary's pattern; in each part the lowest-ranked
adjacent pair is popped from a heap and joined in a linked list until none is
left. The count is the initial symbols minus the merges: no ids are emitted.
Strings of special tokens inside a text count as one token each, as the library
does by default. Counts of short parts are cached per worker, in bounded space.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated
documents each get their own row.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, functions as F

from .common import ship, trim

LIMIT = 512
#: parts in either half of a worker's cache, parts it keeps between tasks, and the longest part kept
CACHE, KEPT, CACHED_CHARS = 200_000, 40_000, 48
# Fixed value: the pattern that byte-level vocabularies cut text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def printable_bytes() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    visible Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._refuse_unknown(spec)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        number = {s: i for s, i in vocab.items()}
        self.rules = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbol = [number[c] for c in printable_bytes()]
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.parts = regex.compile(PATTERN)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @staticmethod
    def _refuse_unknown(spec: dict) -> None:
        """Settings of a vocabulary file that would change counts and are not provided are errors."""
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        wrong = [k for k, bad in {
            "normalizer": spec.get("normalizer"), "pre_tokenizer": cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space"),
            "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")),
            "added_tokens": any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }.items() if bad]
        if wrong:
            raise ValueError(f"counts are not provided for these settings of the vocabulary: {', '.join(wrong)}")

    def merges(self, raw: bytes) -> int:
        """How many merges the bytes of one part undergo."""
        rules = self.rules
        sym = [self.symbol[b] for b in raw]
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, sym[i], sym[i + 1], r[1]) for i in range(n - 1) if (r := rules.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged away meanwhile
            sym[i], sym[j] = joined, -1
            nxt[i] = k = nxt[j]
            done += 1
            if k < n:
                prv[k] = i
                if r := rules.get((joined, sym[k])):
                    heapq.heappush(heap, (r[0], i, joined, sym[k], r[1]))
            if (h := prv[i]) >= 0 and (r := rules.get((sym[h], joined))):
                heapq.heappush(heap, (r[0], h, sym[h], joined, r[1]))
        return done

    def _plain(self, text: str) -> int:
        """The cache has two halves: what is asked for moves to the younger one, which becomes the
        older one when it is full."""
        parts = self.parts.findall(text)
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        cache, old = self.young, self.old
        new = set(parts).difference(cache)
        long = []
        for part in new:
            n = old.get(part)
            if n is None:
                raw = part.encode("utf-8", "surrogatepass")
                n = len(raw) - self.merges(raw)
                if len(part) > CACHED_CHARS:
                    long.append(part)
            cache[part] = n
        total = sum(map(cache.__getitem__, parts))
        for part in long:
            del cache[part]
        return total

    def rest(self) -> None:
        """Between tasks a worker keeps the parts first met, which are the frequent ones."""
        self.young, self.old = dict(itertools.islice(self.young.items(), KEPT)), {}
        trim()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def token_count(path: str, text: Column) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = merger(path)
        try:
            for texts in batches:
                yield pd.Series([m.count(t if isinstance(t, str) else None) for t in texts], dtype="int64")
        finally:
            m.rest()

    return run(text)


def count_tokens(docs, path: str, limit: int = LIMIT):
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    ship(docs.sparkSession)
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(path, F.col("text")).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
