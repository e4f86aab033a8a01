"""The prefix trie, the mix and the whitening against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelight.llm import mixing, prefix_trie, whitening
from forelight.llm.common import Tables

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- 11 ---------------------------------------------------------------------------------------
def rebuilt(rows, graft=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            content = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, content, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    if not graft:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]  # the sign of c stays with its remainder
    return out


def brute_trie(rows, graft=True):
    convs = rebuilt(rows, graft)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, owner = Counter(), {k: min(v) for k, v in members.items()}
    for k in members:
        if k:
            kids[k[:-1]] += 1
    saved, leaves = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(convs[c]) == len(k)))).encode()).hexdigest()
    return sorted((owner[k], len(k), owner[k[:-1]] if k else -99, len(v), kids[k], leaves[k], saved[k], ends(k)) for k, v in members.items())


def nodes(df):
    return sorted((r["conv_id"], r["depth"], -99 if r["parent_conv_id"] is None else r["parent_conv_id"], *tuple(r)[3:]) for r in df.collect())


def some_conversations(rng, n):
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.15:
            continue
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else ["user", "assistant"][t % 2], rng.choice(["a", "é b", "", None, f"own {c}"])))
    rows += [(40 + k, t, "user", f"step {t}") for k in range(30) for t in range(k)]  # each goes on where another ended
    rows += [(1000, None, "user", "first"), (1000, None, "user", "also"), (1000, 5, "user", "x"), (1000, 5, "user", "x"), (1000, 5, "user", "x"), (None, 1, "user", "nobody's")]
    rows += [(2000 + 3 * k, t, "user", f"copy {t}") for k in range(60) for t in range(3)]
    rows += [(9000 + 10 * k, t, "user", f"long {t}" if t < 70 + 9 * k else f"apart {k}") for k in range(4) for t in range(120)]
    rows += [(7001, t, "user", f"far {t}") for t in range(3)]  # its parent is absent
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "graft"), [(256, True), (4, True), (4, False)])
def test_trie(spark, monkeypatch, width, graft):
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    monkeypatch.setattr(prefix_trie, "LEAST_HOT", 8)
    rows = some_conversations(random.Random(11), 60)
    df = spark.createDataFrame(rows, CONV).repartition(5)
    for c in ("depth", "place", "n", "length", "content", "owner", "x1"):
        df = df.withColumn(c, F.lit("clash"))
    build = prefix_trie.regrafted_trie if graft else prefix_trie.conversation_trie
    assert nodes(build(df, width)) == brute_trie(rows, graft)


def test_tries_of_few_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie.regrafted_trie(empty).count() == 0
    assert prefix_trie.regrafted_trie(spark.createDataFrame([(None, 1, "a", "b")], CONV)).count() == 0
    for rows in ([(6, 0, None, None)], [(1, 0, "user", "x")], [(0, 0, "user", "x"), (0, 0, "user", "x")], [(1, 0, "user", "x"), (2, 0, "user", "x")]):
        assert nodes(prefix_trie.regrafted_trie(spark.createDataFrame(rows, CONV))) == brute_trie(rows)


def test_every_conversation_searches_its_chain(spark):
    """First owned depths against their definition, for arrays of any length."""
    rows = some_conversations(random.Random(12), 40)
    convs = rebuilt(rows, False)
    turns, lengths = prefix_trie.ordered_turns(spark.createDataFrame(rows, CONV))
    told = turns.join(lengths.withColumnRenamed("n", "length"), "conv_id")
    for width in (3, 256):
        prefixes = prefix_trie._prefixes(told, 120, width)
        owned = Tables(spark).put(prefixes.groupBy(*prefix_trie.KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")))
        got = {r["conv_id"]: (r["first"], r["up"]) for r in prefix_trie.chains(prefixes, owned, 120, width, 8).collect()}
        least = {}
        for c in sorted(convs, reverse=True):
            for d in range(1, len(convs[c]) + 1):
                least[tuple(convs[c][:d])] = c
        want = {}
        for c, t in convs.items():
            mine = [d for d in range(1, len(t) + 1) if least[tuple(t[:d])] == c]
            if mine:
                want[c] = (mine[0], least[tuple(t[: mine[0] - 1])] if mine[0] > 1 else None)
        assert got == want


# ---- 12 ---------------------------------------------------------------------------------------
def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, over = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        left = total - sum(2 * sizes[s] for s in over)
        open_ = sum(weight[s] for s in order if s not in over)
        share = {s: Fraction(2 * sizes[s]) if s in over else left * weight[s] / open_ for s in order}
        new = {s for s in order if s not in over and share[s] >= 2 * sizes[s]}
        if not new:
            return share
        over |= new


def count_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mix_rows(rng, n=3000):
    rows = [(k, "w " * int(2 ** rng.uniform(0, 9)), "en", rng.choice([f"s{i}" for i in range(12)] + [None, "big", "big", "big", "big"]), None) for k in range(n)]
    rows += [(5000, "a copy of it", "en", "big", None)] * 700 + [(None, "no id", "en", "s1", None)] * 3 + [(6000 + k, None if k % 2 else " \n", "en", "s2", None) for k in range(40)]
    rows += [(7000, None, "en", "blank", None), (7001, "x " * 30_000, "en", "s3", None), (7003, "x " * 20_000, "en", "big", None), (7002, "\u00a0 nbsp\u2003words", "en", "é", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [mixing.BLOCK, 50])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "COPIES", 100)
    rows = mix_rows(random.Random(12))
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "target", "base", "m", "p", "u1", "block", "taken"):
        df = df.withColumn(c, F.lit("clash"))
    got = mixing.mix_documents(df.repartition(7), block=block).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += count_words(text)
    want, taken, documents, expected = brute_targets(sizes), Counter(), Counter(), Counter()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, count_words(t)) for d, t, _, s, _ in rows)
    for r in got:
        ratio = want[r["source"]] / r["source_size"] if r["source_size"] else 0
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert r["taken"] in {int(ratio) * r["size"], -int(-ratio // 1) * r["size"]} and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        if r["size"]:
            documents[r["source"]] += r["taken"] / r["size"]
            expected[r["source"]] += ratio
    for s in sizes:
        # the others of s3, or those of a block of 50, cannot make up for so long a document
        far = {"s3": 30_000, "big": 20_000 if block == 50 else 0}.get(s, 0)
        assert abs(taken[s] - want[s]) <= far + 2 + (0.02 if block == 50 else 0.002) * sizes[s], (s, taken[s], float(want[s]))
        blank = sum(source == s and not count_words(t) for _, t, _, source, _ in rows)
        assert abs(documents[s] - expected[s]) <= 6 + blank or far, (s, documents[s], float(expected[s]))
    # the same for other files and tasks
    again = mixing.mix_documents(df.orderBy("n_chars", F.rand(3)).coalesce(2), block=block).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mixed_documents(spark):
    rows = mix_rows(random.Random(5), 300)
    df = spark.createDataFrame(rows, DOCS).withColumn("u1", F.lit("clash")).withColumn("doc", F.lit("clash"))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = Counter()
    for r in mixing.allocation(df, ["doc", "lang", "n_chars", "u1"]).where("size > 0").collect():
        want[r["doc_id"], r["source"]] += r["m"] * r["base"] + r["more"]
    got = Counter((r["doc_id"], r["source"]) for r in out.collect() if count_words(r["text"]))
    assert got == +want


def test_mixes_of_few_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = mixing.mix_documents(spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", None)], DOCS)).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in blank} == {(0, 0.0, 0)}
    one = mixing.mix_documents(spark.createDataFrame([(1, "a b", None, None, None)], DOCS)).first()
    assert one["target"] == 3.0 and one["taken"] in (2, 4)


def test_flight_keeps_totals():
    """Whatever has landed or is still open: words and documents expected stay, all but two are decided."""
    rng = random.Random(3)
    for n in (1, 2, 3, 40, 500):
        size, p = [rng.randint(0, 900) for _ in range(n)], [rng.uniform(0.01, 0.99) for _ in range(n)]
        q = mixing.flight(size, p, rng, False)
        assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
        assert sum(q) == pytest.approx(sum(p)) and sum(x * s for x, s in zip(q, size, strict=True)) == pytest.approx(sum(x * s for x, s in zip(p, size, strict=True)))
        assert set(mixing.flight(size, p, rng, True)) <= {0.0, 1.0}
        size.sort(reverse=True)
        q = mixing.flight([20_000, *size], [0.5, *p], rng, False, long=100)
        assert sum(x * s for x, s in zip(q, [20_000, *size], strict=True)) == pytest.approx(10_000 + sum(x * s for x, s in zip(p, size, strict=True))) and (n < 500 or q[0] in (0, 1))
    # each document keeps its probability
    size, p = [5, 3, 8, 1, 1, 0, 4], [0.1, 0.5, 0.3, 0.9, 0.45, 0.2, 0.6]
    mean = np.mean([mixing.flight(size, p, rng, True) for _ in range(8000)], axis=0)
    assert np.abs(mean - p).max() < 0.025


# ---- 13 ---------------------------------------------------------------------------------------
VECS = "vec_id long, embedding array<float>, label int"


def test_whitening(spark):
    rng = np.random.default_rng(13)
    mix = rng.normal(size=(24, 24)) * np.geomspace(1, 0.01, 24)
    v = (rng.normal(size=(3000, 24)) @ mix + rng.normal(size=24)).astype(np.float32)
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v)] + [(9000, v[0].tolist(), None)] * 500
    bad = [(1, None, 1), (2, [], 1), (3, [None] * 24, 1), (4, [float("nan")] * 24, 1), (5, [0.0] * 23 + [float("inf")], 1), (6, [1.0] * 7, 1)]
    df = spark.createDataFrame([*rows, *bad, (None, v[1].tolist(), 2)], VECS).repartition(37)
    for c in ("n", "white", "component", "x__", "dims"):
        df = df.withColumn(c, F.lit("clash"))
    got = whitening.whiten(df).collect()
    x = np.floor(np.array([*(r[1] for r in rows), v[1].tolist()], np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    ids = [r[0] for r in rows] + [None]
    far = dict(zip(ids, ((n * x - sums) ** 2).sum(axis=1).tolist(), strict=True))
    white = dict(zip(ids, centred @ axes[:, :8] / np.sqrt(e[:8]), strict=True))
    sign = {}
    for r in got:
        k = r["component"] - 1
        want = white[r["vec_id"]][k]
        if abs(want) > 0.1:
            sign.setdefault(k, np.sign(want * r["whitened"]))
        assert r["whitened"] * sign.get(k, np.sign(want * r["whitened"])) == pytest.approx(want, abs=1e-6)
        assert r["deviation"] == far[r["vec_id"]] and r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)


def test_whitening_of_few_vectors(spark):
    make = lambda *vs: spark.createDataFrame([(k, list(x), None) for k, x in enumerate(vs)], VECS)
    assert whitening.whiten(make()).count() == 0
    assert whitening.whiten(make((1.0, 2.0))).count() == 0 and whitening.whiten(make((1.0, 2.0), (1.0, 2.0))).count() == 0
    assert whitening.whiten(make(())).count() == 0
    line = whitening.whiten(make((0.0, 1.0), (1.0, 2.0), (2.0, 3.0))).collect()
    assert sorted((r["component"], round(abs(r["whitened"]), 6), r["explained"]) for r in line) == [(1, 0.0, 1.0), (1, 1.224745, 1.0), (1, 1.224745, 1.0)]
    huge = whitening.whiten(make((1e30, 0.0), (-1e30, 1.0), (3e20, 5.0))).collect()
    # the second dimension is lost in the rounding of the first
    assert len(huge) == 3 and all(np.isfinite(r["whitened"]) for r in huge) and {r["deviation"] for r in huge} == {None}


def test_merging_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(99_000, 101_000, (500, 10))
    parts = [whitening.Summary.of(p) for p in np.array_split(x, [1, 4, 90, 91, 300])]
    rng.shuffle(parts)
    total = whitening.Summary.unpack(*parts[0].pack())
    for p in parts[1:]:
        total = total.merge(whitening.Summary.unpack(*p.pack()))
    centred = x - x.mean(axis=0)
    assert total.sums == x.sum(axis=0).tolist() and total.n == 500 and total.rows.shape == (10, 10)
    assert np.allclose(total.rows.T @ total.rows, centred.T @ centred, rtol=1e-12, atol=1e-4)
