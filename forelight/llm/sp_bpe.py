"""SentencePiece BPE encoding and decoding by a table of last tokens.

A sequence of pieces is the merge-type encoding of its text exactly if every
piece encodes to itself and every adjacent pair encodes to that pair: merges
inside one piece never see more than the neighbour across their boundary, so
adding text elsewhere only interleaves steps. Each prefix of a text therefore
has one last piece. The encoder walks the text through an Aho-Corasick automaton
of the pieces, stores for each position the one matching piece that is compatible
with the last piece of the prefix before it, and reads the ids backwards.

Texts are cut first at places that no piece spans (a space after anything but a
space, a line end, and characters outside the vocabulary), so a repeated run is
encoded once while it stays in a bounded cache. New runs of a batch go through the
automaton side by side, position by position, in numpy; long ones go one by one.

Defined results: null and empty texts have the begin and end ids only and decode
to the empty string; repeated documents each get their own row.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import sha256_hex, ship, trim

SPACE = "▁"
#: runs in either half of a worker's cache, pairs in its compatibility table
CACHE, PAIRS = 60_000, 400_000
#: characters of text encoded together; runs longer than LONG go through the automaton alone
GROUP_CHARS, LONG = 300_000, 128
ROOT = 1 << 20
#: runs that a worker keeps between tasks
KEPT = 40_000


class IntTable:
    """Open addressing from non-negative 63-bit keys to small numbers, a whole array at a time."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while on.size:
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet; the table grows with its content."""
        self.used += len(keys)
        if 2 * self.used > 1 << self.bits:
            there = self.keys >= 0
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            self.bits = max(self.bits + 1, (2 * self.used).bit_length())
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._slots(keys)
        on = np.arange(len(keys))
        while on.size:
            free = on[self.keys[at[on]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            on = np.setdiff1d(on, won, assume_unique=True)
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)


class Automaton:
    """Aho-Corasick over pieces as arrays: goto edges in an IntTable, failure links, the
    piece that ends at a state, and the next state down the suffix chain that has one."""

    def __init__(self, pieces: dict[str, int]):
        edges: dict[int, int] = {}
        label, parent, piece = [0], [0], [-1]
        for text, number in pieces.items():
            s = 0
            for c in map(ord, text):
                t = edges.get(s << 21 | c)
                if t is None:
                    t = edges[s << 21 | c] = len(label)
                    label.append(c)
                    parent.append(s)
                    piece.append(-1)
                s = t
            piece[s] = number
        depth = [0] * len(label)
        for s in range(1, len(label)):
            depth[s] = depth[parent[s]] + 1
        fail, down = [0] * len(label), [0] * len(label)
        for s in sorted(range(1, len(label)), key=depth.__getitem__):
            if depth[s] > 1:
                f = fail[parent[s]]
                while f and f << 21 | label[s] not in edges:
                    f = fail[f]
                fail[s] = edges.get(f << 21 | label[s], 0)
            down[s] = fail[s] if piece[fail[s]] >= 0 else down[fail[s]]
        self.edges, self.fail_of, self.piece_of, self.down_of = edges, fail, piece, down
        self.table = IntTable(max(10, len(edges).bit_length() + 1))
        self.table.put(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.fail, self.piece, self.down = (np.asarray(x, np.int32) for x in (fail, piece, down))

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = self.table.get(state.astype(np.int64) << 21 | char)
        on = np.flatnonzero(out < 0)
        s = state[on]
        while on.size:
            over = s == 0
            out[on[over]] = 0
            on, s = on[~over], self.fail[s[~over]]
            t = self.table.get(s.astype(np.int64) << 21 | char[on])
            hit = t >= 0
            out[on[hit]] = t[hit]
            on, s = on[~hit], s[~hit]
        return out


class PieceModel:
    """What encoding needs of a .model file, read through the library's accessors."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = [0] * 256
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        self.is_byte = np.array([i in self.byte_of for i in range(n)])
        ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.byte_of}
        self.score = {p: sp.get_score(i) for p, i in ids.items()}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
            raise ValueError("this vocabulary has pieces across words; runs can't be cut at spaces")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.chars = {c for p in ids for c in p}
        # a piece that merges cannot reach never appears in an encoding
        self.automaton = Automaton({p: i for p, i in ids.items() if self.merge(p) == [p]})
        self.size = np.array([len(p) for p in self.pieces], np.int32)
        self.fits = IntTable(16)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.plain = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in (self.bos, self.eos) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def merge(self, text: str) -> list[str]:
        """The defining procedure: join the best-scored adjacent pair, leftmost first."""
        part, score = list(text), self.score
        end = len(part)
        nxt, prv = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(-score[p], i, p) for i in range(end - 1) if (p := part[i] + part[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i] if part[i] else end
            if j >= end or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, ""
            nxt[i] = nxt[j]
            if nxt[j] < end:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < end and (q := part[a] + part[b]) in score:
                    heapq.heappush(heap, (-score[q], a, q))
        return [p for p in part if p]

    def compatible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces, side by side, stays as it is."""
        keys = before.astype(np.int64) << 21 | piece
        found = self.fits.get(keys)
        new = np.unique(keys[found < 0])
        if new.size:
            pairs = [(self.pieces[k >> 21], self.pieces[k & 0x1FFFFF]) for k in new.tolist()]
            told = np.array([self.merge(x + y) == [x, y] for x, y in pairs], np.int32)
            if self.fits.used + new.size <= PAIRS:
                self.fits.put(new, told)
                found = self.fits.get(keys)
            else:
                on = np.flatnonzero(found < 0)
                found[on] = told[np.searchsorted(new, keys[on])]
                self.fits = IntTable(16)
        return found > 0

    def _side_by_side(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of known characters, coded; the longest run first."""
        size = np.array([len(r) for r in runs], np.int32)
        width = int(size[0])
        flat = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        starts = np.cumsum(size) - size
        last = np.full((len(runs), width + 1), -1, np.int32)
        last[:, 0] = ROOT
        a, state = self.automaton, np.zeros(len(runs), np.int32)
        for i in range(1, width + 1):
            live = int(np.searchsorted(-size, -i, side="right"))
            s = state[:live] = a.step(state[:live], flat[starts[:live] + i - 1])
            at = np.where(a.piece[s] >= 0, s, a.down[s])
            rows = np.flatnonzero(at)
            at = at[rows]
            while rows.size:
                piece = a.piece[at]
                before = last[rows, i - self.size[piece]]
                ok = before == ROOT
                ask = np.flatnonzero(~ok & (before >= 0))
                ok[ask] = self.compatible(before[ask], piece[ask])
                last[rows[ok], i] = piece[ok]
                at = a.down[at[~ok]]
                rows = rows[~ok][at > 0]
                at = at[at > 0]
        back, rows, at = [], np.arange(len(runs)), size.copy()
        while rows.size:
            piece = last[rows, at]
            back.append((rows, piece))
            at = at - self.size[piece]
            rows, at = rows[at > 0], at[at > 0]
        rows, ids = (np.concatenate(x[::-1]) for x in zip(*back, strict=True))
        order = np.argsort(rows, kind="stable")
        ends = (4 * np.cumsum(np.bincount(rows, minlength=len(runs)))).tolist()
        raw = ids[order].astype("<u4").tobytes()
        return [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def _alone(self, run: str) -> bytes:
        """The same walk for one long run."""
        a, known = self.automaton, {}
        last, s = [ROOT] + [-1] * len(run), 0
        for i, c in enumerate(map(ord, run), 1):
            while s and s << 21 | c not in a.edges:
                s = a.fail_of[s]
            s = a.edges.get(s << 21 | c, 0)
            at = s if a.piece_of[s] >= 0 else a.down_of[s]
            while at:
                piece = a.piece_of[at]
                before = last[i - len(self.pieces[piece])]
                ok = before == ROOT
                if not ok and before >= 0:
                    ok = known.get((before, piece))
                    if ok is None:
                        x, y = self.pieces[before], self.pieces[piece]
                        ok = known[before, piece] = self.merge(x + y) == [x, y]
                if ok:
                    last[i] = piece
                    break
                at = a.down_of[at]
        ids, at = [], len(run)
        while at:
            ids.append(last[at])
            at -= len(self.pieces[last[at]])
        return np.array(ids[::-1], "<u4").tobytes()

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        """Ids of each run as little-endian 32-bit numbers."""
        odd = set("".join(runs)).difference(self.chars)
        cut = {r: self._known_parts(r) for r in runs if not odd.isdisjoint(r)} if odd else {}
        parts = runs.difference(cut)
        parts.update(p for ps in cut.values() for p in ps if p not in odd)
        order = sorted(parts, key=len, reverse=True)
        coded = {p: self._alone(p) for p in itertools.takewhile(lambda p: len(p) > LONG, order)}
        for k in range(len(coded), len(order), 1 << 15):
            some = order[k : k + (1 << 15)]
            coded.update(zip(some, self._side_by_side(some), strict=True))
        if cut:
            coded |= {c: np.array([self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")], "<u4").tobytes() for c in odd}
            coded |= {r: b"".join(map(coded.__getitem__, ps)) for r, ps in cut.items()}
        return coded

    def _known_parts(self, run: str) -> list[str]:
        """Stretches of known characters, and unknown characters one by one."""
        out, known = [], ""
        for c in run:
            if c in self.chars:
                known += c
                continue
            out += [known, c] if known else [c]
            known = ""
        return [*out, known] if known else out

    def encode_group(self, texts: list[str]) -> list[bytes]:
        """The cache has two halves. What a group needs moves to the younger one; once that is
        full it becomes the older one, and what was there and not asked for meanwhile goes."""
        runs = [self.runs.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        asked = set(chain.from_iterable(runs))
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        asked.difference_update(self.young)
        known = asked.intersection(self.old)
        self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new = asked - known
        if new:
            self.young.update(self._learn(new))
        find = self.young.__getitem__
        out = [b"".join(map(find, r)) for r in runs]
        for r in new:
            if len(r) > LONG:
                del self.young[r]
        return out

    def rest(self) -> None:
        """Between tasks a worker keeps its tables and the runs first met, which are the frequent ones."""
        self.young, self.old = dict(itertools.islice(self.young.items(), KEPT)), {}
        trim()

    def encode_all(self, texts: list) -> list[bytes]:
        """Ids of each text without begin and end, as little-endian 32-bit numbers."""
        out: list[bytes] = []
        group, size = [], 0
        for t in texts:
            t = t if isinstance(t, str) else ""
            if group and size + len(t) > GROUP_CHARS:
                out += self.encode_group(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + (self.encode_group(group) if group else [])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces join to characters, a byte that is no part of one becomes
        U+FFFD, and the space before the first piece goes."""
        first = next((i for i in ids if i not in (self.bos, self.eos)), None)
        raw = b"".join(map(self.plain.__getitem__, ids))
        if first is not None and first not in self.byte_of and self.pieces[first][:1] == SPACE:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _patched(raw)


def _patched(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process and path."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encoded(path: str, text: Column, keep_ids: bool = False) -> Column:
    """Struct of n_tokens, ids_sha256, decoded_sha256 and, on request, the ids and the text."""
    more = ", ids array<int>, decoded string" if keep_ids else ""

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if keep_ids else 3]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (m.bos, m.eos))
        try:
            for texts in batches:
                rows = []
                for raw in m.encode_all(list(texts)):
                    raw = bos + raw + eos
                    ids = np.frombuffer(raw, "<u4").tolist()
                    decoded = m.decode(ids)
                    row = (len(ids), sha256_hex(raw), sha256_hex(decoded.encode("utf-8", "surrogatepass")))
                    rows.append((*row, ids, decoded) if keep_ids else row)
                del texts
                yield pd.DataFrame(rows, columns=names)
                del rows
                trim()
        finally:
            m.rest()

    return run(text)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id with the columns of ``encoded``."""
    ship(docs.sparkSession)
    return docs.select("doc_id", encoded(path, F.col("text"), keep_ids).alias("r")).select("doc_id", "r.*")
