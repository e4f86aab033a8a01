"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelight.llm import bpe_count, decontam, fertility, hilbert, html_text, line_dedup, lm_score, minhash, sp_bpe, toxicity
from forelight.llm.components import components
from forelight.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000


def words(rng, n, base=40):
    return " ".join(rng.choice(WORDS[:base]) for _ in range(n))


WORDS = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "r")]


def make(spark, rows, extra=()):
    """Documents with awkward rows beside ``rows`` and columns whose names operators use."""
    rows = [(i, t, "en", f"src{i % 4}", None) for i, t in rows]
    rows += [(9001, None, "en", "a", None), (9002, "", None, None, None), (9003, " \n\t\n ", "en", "a", None), (9004, LONG, "de", "b", None), (9005, "same text here for two rows", "en", "a", 3), (9005, "same text here for two rows", "en", "a", 3), (None, "a row without an id", "en", "b", None)]
    df = spark.createDataFrame([*rows, *extra], DOCS)
    for c in ("n_words", "kept", "score", "component_id", "r1", "k1", "hit", "block", "rank", "h", "sid"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def collect(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# ---- 1 ----------------------------------------------------------------------------------------
def brute_contamination(text, items):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    w, hit, ids = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    ids |= {str(item)} - {"None"}
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), 20 * len(hit) >= len(w) and bool(hit)


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 200])
def test_decontamination(spark, block):
    rng = random.Random(1)
    items = [(k, words(rng, n)) for k, n in enumerate((30, 13, 14, 5, 1, 40))] + [(7, None), (8, ""), (0, words(rng, 20)), (None, words(rng, 15)), (10, "Ünï cödé tëxt"), (2, words(rng, 13))]
    texts = []
    for k in range(60):
        t = words(rng, rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 13))
            t += " " + ", ".join(v[a : a + rng.choice((13, 12, 20))]).upper() + "! " + words(rng, 5)
        texts.append((k, t))
    df = make(spark, texts, [(700, "x ünï CÖDÉ; tëxt y", "en", "a", None)])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = collect(df.select("doc_id", "text", decontam.contamination(bench, F.col("text"), block).alias("r")))
    for rows in got.values():
        for r in rows:
            x = r["r"]
            assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == brute_contamination(r["text"], items), r
            for s in x["spans"]:
                assert r["text"][s["start"] : s["stop"]].strip() == r["text"][s["start"] : s["stop"]]
    assert len(got[9005]) == 2
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not r["r"]["contaminated"] for x in got.values() for r in x)
    assert decontam.decontaminate(df, bench.limit(0)).count() == df.count() and decontam.decontaminate(empty(spark), bench).count() == 0
    # the same in passes, with what each part found written down
    want = sorted(((r["doc_id"] or -1, r["r"]) for rows in got.values() for r in rows), key=str)
    passes = decontam.judged(df.select("doc_id", "text"), bench, block).select("doc_id", "judged__").collect()
    assert sorted(((r["doc_id"] or -1, r["judged__"]) for r in passes), key=str) == want


def test_large_benchmarks_take_one_scan(spark, monkeypatch):
    """Only pieces that occur enter the automaton; clashing columns survive; parts change nothing."""
    rng = random.Random(14)
    many = [a + b for a in WORDS for b in ("", "x", "y")]
    text = lambda n: " ".join(rng.choice(many) for _ in range(n))
    items = [(k, text(rng.choice((3, 8, 13, 60)))) for k in range(400)] + [(k, "twice the same row of words") for k in (7, 7, 8)] + [(9, ""), (10, " ;; ")] * 50
    texts = []
    for k in range(80):
        v = rng.choice(items[:400])[1].split()
        texts.append((k, f"{text(20)} {' '.join(v[: rng.choice((5, 13, 20, 60))])} {text(4)}"))
    texts += [(90, "TWICE the same row, of words"), (91, None), (92, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for c in ("judged__", "state__", "judged", "u1", "spans", "doc"):
        df = df.withColumn(c, F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: brute_contamination(t, [x for x in items if x[1].strip(" ;")]) for k, t in texts}
    scans = []
    share = decontam._share
    monkeypatch.setattr(decontam, "_share", lambda spark, rows: scans.append(len(rows)) or share(spark, rows))
    for block, parts in ((decontam.BLOCK_CHARS, 1), (8_000, 1), (400, 2)):
        scans.clear()
        got = {r["doc_id"]: tuple(r["judged__"])[:5] for r in decontam.judged(df.drop("judged__"), bench, block).collect()}
        assert got == want and (len(scans) == 1) == (parts == 1) and (block != 8_000 or scans[0] < 150)
        kept = decontam.decontaminate(df, bench, block)
        assert kept.columns == df.columns
        rows = kept.collect()
        assert {r["doc_id"] for r in rows} == {k for k, x in want.items() if not x[4]} and all(r["judged__"] == r["state__"] == r["doc"] == "clash" for r in rows)


def test_benchmarks_of_one_session_are_kept_apart(spark):
    """Automata that workers keep belong to one benchmark, also where another has as many windows."""
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta")], "doc_id long, text string").coalesce(1)
    for item, hit in (("alpha beta", {1}), ("delta epsilon", {2}), ("alpha gamma", set()), ("beta gamma", {1})):
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        out = df.select("doc_id", decontam.contamination(bench, F.col("text")).alias("r")).where("r.n_hit > 0").collect()
        assert {r["doc_id"] for r in out} == hit


def test_templated_items(spark):
    """Many items share pieces of seven words; windows are still those of each item."""
    rng = random.Random(11)
    stem = words(rng, 9, 150)
    items = [(k, f"{words(rng, 3, 150)} {stem} {words(rng, 4, 150)}") for k in range(60)]
    texts = [(k, f"{words(rng, 5)} {items[k][1]} {words(rng, 5)}") for k in range(10)] + [(20, f"{words(rng, 5)} {stem} {words(rng, 5)}"), (21, items[3][1][4:]), (22, stem)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in df.select("doc_id", "text", decontam.contamination(bench, F.col("text")).alias("r")).collect():
        assert tuple(r["r"])[:5] == brute_contamination(r["text"], items)


# ---- 2 ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [line_dedup.BROADCAST_LINES, 0])
def test_line_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    rng = random.Random(2)
    boiler, rare = "All rights reserved by somebody.", "seen on three sites only"
    rows = []
    for k in range(48):
        lines = [words(rng, 12, 120) for _ in range(4)]
        if k % 2:
            lines.insert(rng.randint(0, 4), "  " + boiler + "\t")
        if k % 4 < 3:
            lines.insert(1, rare)
        rows.append((k, "\n".join(lines), "en", f"site{k % 16 if k % 2 else k % 3}", None))
    copies = "\n".join(words(rng, 12, 120) for _ in range(3))
    rows += [(100 + k, copies, "en", f"site{k}", None) for k in range(12)]
    rows += [(200 + k, f"{boiler}\n{words(rng, 2, 120)}", "en", f"site{k}", None) for k in range(3)]  # mostly boilerplate
    df = make(spark, [], rows)
    sites = defaultdict(set)
    for r in df.collect():
        for line in (r["text"] or "").split("\n"):
            if line.strip(" \t\r\v\f") and r["source"] is not None:
                sites[line.strip(" \t\r\v\f")].add(r["source"])
    for limit in (3, 8, 12):
        bad = {x for x, s in sites.items() if len(s) >= limit}
        spread = lambda text: [x.strip(" \t\r\v\f") in bad for x in (text or "").split("\n")]  # noqa: B023, E731
        stands = defaultdict(list)  # of each line on enough sites: whether its documents consist mostly of such lines
        for t in {(r["doc_id"], r["text"]): r["text"] or "" for r in df.collect()}.values():
            lines, hit = t.split("\n"), spread(t)
            mostly = 2 * sum(len(x.split()) for x, h in zip(lines, hit, strict=True) if h) > len(t.split())
            for x in {x.strip(" \t\r\v\f") for x, h in zip(lines, hit, strict=True) if h}:
                stands[x].append(mostly)
        for whole in (False, True):
            out = collect(line_dedup.remove_boilerplate(df, limit, report=True, whole_copies=whole))
            for r in df.collect():
                lines, hit = (r["text"] or "").split("\n"), spread(r["text"])
                goes = [h and not (whole and 2 * sum(stands[k]) > len(stands[k])) for h, k in zip(hit, (x.strip(" \t\r\v\f") for x in lines), strict=True)]
                want = "\n".join(x for x, h in zip(lines, goes, strict=True) if not h) if any(goes) else r["text"]
                assert all((o["text"], o["n_boilerplate"], o["n_removed"]) == (want, sum(hit), sum(goes)) for o in out[r["doc_id"]])
                assert len(out[r["doc_id"]]) == (2 if r["doc_id"] == 9005 else 1)
            if limit == 8:
                assert out[100][0]["text"] == (copies if whole else "") and boiler not in out[200][0]["text"]
    assert line_dedup.remove_boilerplate(df).columns == df.columns
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0


def test_texts_stay_where_they_are(spark):
    """No exchange in the plan that removes the lines."""
    rows = [(k, f"All rights reserved.\nown text {k}\n\nAll rights reserved.", "en", f"site{k % 12}", None) for k in range(60)]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOCS), report=True)
    assert {(r["text"], r["n_lines"], r["n_boilerplate"], r["n_removed"]) for r in out.collect()} == {(f"own text {k}\n", 3, 2, 2) for k in range(60)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# ---- 3 ----------------------------------------------------------------------------------------
def test_hilbert_curve_steps_to_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 3)):
        cells = spark.range(1 << (dims * bits)).selectExpr(*[f"CAST(shiftright(id, {bits * i}) & {(1 << bits) - 1} AS INT) AS x{i}" for i in range(dims)])
        kept = cells.select(*[F.col(f"x{i}").alias(f"y{i}") for i in range(dims)], *cells.columns)
        rows = sorted(hilbert.curve_index(kept, dims, bits).collect(), key=lambda r: r["h"])
        assert [r["h"] for r in rows] == list(range(1 << (dims * bits)))
        at = [[r[f"y{i}"] for i in range(dims)] for r in rows]
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(at, at[1:], strict=False))


def test_shards(spark, tmp_path):
    rng = random.Random(3)
    df = make(spark, [(k, words(rng, rng.randint(1, 60))) for k in range(300)] + [(k, "hot text") for k in range(300, 500)])
    out = hilbert.hilbert_shards(df).collect()
    assert len(out) == df.count() == 507
    count = Counter(r["shard"] for r in out)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == texts
    assert hilbert.hilbert_shards(empty(spark)).count() == 0
    hilbert.write_shards(hilbert.hilbert_shards(df), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 507


def test_files_prune(spark, tmp_path):
    """Predicates on any of the four dimensions touch far fewer files than in a random layout."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(33)
    langs, sites = ["de", "en", "es", "fr", "it", "pt", "ru", "zh"], [f"https://site{k:03}.example" for k in range(400)]
    rows = [(k, "x" * int(2 ** rng.uniform(3, 12)), rng.choice(langs), rng.choice(sites), None) for k in range(6000)]
    rng.shuffle(rows)
    out = hilbert.hilbert_shards(spark.createDataFrame(rows, DOCS))
    hilbert.write_shards(out, str(tmp_path / "curve"), files_per_shard=16)
    out.repartitionByRange(128, F.xxhash64("doc_id")).write.parquet(str(tmp_path / "random"))
    asked = [("lang", "es", "es"), ("source", sites[7], sites[7]), ("source", sites[390], sites[399]), ("size", 1500, 1600), ("size", 10, 12), ("doc_id", 700, 760)]

    def touched(folder):
        n, files = Counter(), glob.glob(f"{folder}/**/*.parquet", recursive=True)
        for f in files:
            group = pq.ParquetFile(f).metadata.row_group(0)
            stats = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
            for k, (c, low, high) in enumerate(asked):
                n[k] += stats[c].min <= high and stats[c].max >= low
        return [n[k] / len(files) for k in range(len(asked))]

    curve, rand = touched(tmp_path / "curve"), touched(tmp_path / "random")
    assert max(curve) < 0.5 and min(rand) > 0.5 and sum(curve) < 0.4 * sum(rand), (curve, rand)


def test_codes_are_ranks(spark):
    """One row far from all others takes nothing from the rest; doc_ids may be strings."""
    rows = [(k, "x" * (k % 97), f"l{k % 20:02}", f"https://site{k % 200:03}.example", None) for k in range(4000)]
    far = [*rows, (1 << 62, "x" * 5000, "zz", "ftp://else", None), (None, None, None, None, None)]
    size = hilbert.size_column(F.col("text")).alias("size")
    for some, kind in ((rows, "long"), (far, "long"), (far, "string")):
        df = spark.createDataFrame(some, DOCS).select(F.col("doc_id").cast(kind), "text", "lang", "source", size)
        got = hilbert.quantised(df).collect()
        for i, c in enumerate(("lang", "source", "size", "doc_id")):
            order = sorted(((r[c] is not None, r[c] if r[c] is not None else 0 if c in ("size", "doc_id") and kind == "long" else "") for r in got))
            below = {}
            for k, v in enumerate(order):
                below.setdefault(v, k)
            assert len({r[f"x{i}"] for r in got}) == 8
            for r in got:
                v = (r[c] is not None, r[c] if r[c] is not None else 0 if c in ("size", "doc_id") and kind == "long" else "")
                assert r[f"x{i}"] == below[v] * 8 // len(got), (c, r)
    out = hilbert.hilbert_shards(spark.createDataFrame(far, DOCS).withColumn("doc_id", F.col("doc_id").cast("string")))
    assert out.count() == len(far) and dict(out.dtypes)["doc_id"] == "string"


def test_repeated_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "COPIES", 100)
    monkeypatch.setattr(hilbert, "LEAST", 50)
    df = spark.createDataFrame([(5, "the same", "en", "a", None)] * 3000 + [(k, f"text {k}", "en", "a", None) for k in range(1000)], DOCS)
    out = hilbert.hilbert_shards(df)
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(s, k) for s in range(8) for k in range(500)]
    assert out.where("doc_id = 5").count() == 3001


def test_hot_and_missing_ids_are_split(spark):
    """Rows without doc_id, and copies of one, do not make one bucket."""
    df = spark.createDataFrame([(None if k % 2 else 5, f"text {k}", "en", "a", None) for k in range(6000)], DOCS)
    out = hilbert.hilbert_shards(df)
    assert sorted(r["slot"] for r in out.where("shard = 3").collect()) == list(range(750))
    parts = df.withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))).select(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string")).cast("binary")), 1, 8)).distinct()
    assert parts.count() > 5900


# ---- 4 ----------------------------------------------------------------------------------------
def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                up[max(top(i), top(j))] = min(top(i), top(j))
    group = defaultdict(list)
    for i in range(len(rows)):
        group[top(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in group.items()}
    return [(rows[i][0], len(sets[i]), least[top(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice((3, 30, 120)), 160).split()
        for _ in range(rng.choice((1, 2, 6, 40))):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w).title() if rng.random() < 0.3 else "\n".join(w)))
    rows += [(500 + k, rows[0][1]) for k in range(30)] + [(600, "One"), (601, "one"), (602, "ONE two")]
    df = make(spark, rows)
    got = minhash.near_duplicates(df)
    have = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect() if r["doc_id"] is not None)
    want = sorted(x for x in brute_groups([(r["doc_id"], r["text"]) for r in df.collect()]) if x[0] is not None)
    assert have == want
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in want if i == c} | {None}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_confirmation_brings_a_hub_once_to_each_part(spark, monkeypatch):
    """A hub of many members in parts of a few: exactly the links that the full sets have."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HOT", 5)
    rng = random.Random(41)
    base = words(rng, 60, 160).split()
    texts = [" ".join(rng.choice(WORDS) if rng.random() < 0.025 else w for w in base) for _ in range(70)] + ["alone", "alone too"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.cut(minhash.signatures(docs))
    sets = rows.select("sid", F.struct("r1", "r2").alias("owner"))
    sid = {r["doc_id"]: bytes(r["sid"]) for r in rows.collect()}
    asked = [(0, k) for k in range(1, 72)] + [(5, k) for k in range(6, 20)] + [(70, 71)]
    got = minhash._confirm(spark.createDataFrame([(sid[a], sid[b]) for a, b in asked], "a binary, b binary"), sets, docs)
    full = [minhash.shingles(t) for t in texts]
    want = {(sid[a], sid[b]) for a, b in asked if minhash.linked(full[a], full[b])}
    assert {(bytes(r["u"]), bytes(r["v"])) for r in got.collect()} == want and 10 < len(want) < len(asked)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text") and "PythonUDF" not in plan  # one text a row, streamed past its hub


def test_roots_of_trees(spark):
    rng = random.Random(9)
    up = {v: rng.randrange(max(0, v - 9), v) for v in range(1, 300) if v % 40}

    def root(v):
        return root(up[v]) if v in up else v

    got = {r["node"]: r["label"] for r in minhash._roots(spark.createDataFrame([(u, v) for v, u in up.items()], "u long, v long")).collect()}
    assert got == {v: root(v) for v in {*up, *up.values()}}
    assert minhash._roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_grow_with_further_links(spark):
    make = lambda rows: spark.createDataFrame(rows, "u long, v long")
    found = components(make([(1, 2), (2, 3), (10, 11), (20, 21)]))
    got = {r["node"]: r["label"] for r in minhash._joined(found, make([(3, 11), (21, 30), (40, 41)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 40: 40, 41: 40}
    assert minhash._joined(found, make([])) is found


def test_block_links_find_what_stars_missed():
    import pandas as pd

    rng = random.Random(5)
    base = words(rng, 100, 160).split()
    near = [" ".join(rng.choice(WORDS) if rng.random() < 0.02 else w for w in base) for _ in range(6)]
    block = pd.DataFrame({"sid": [bytes([i]) for i in range(6)], "label": [b"a", b"b", b"c", b"a", b"a", b"d"], "ask": [False, True, True, False, False, True], "text": near})
    out = block_pairs = {tuple(x) for x in minhash.block_links(block).itertuples(index=False)}
    s = [minhash.shingles(t) for t in near]
    for u, v in block_pairs:
        assert minhash.linked(s[u[0]], s[v[0]])
    for i in (1, 2, 5):
        labels = {block["label"][j] for j in (0, 3, 4) if minhash.linked(s[i], s[j])}
        assert {block["label"][v[0]] for u, v in out if u[0] == i} == labels


def test_odd_sketches_follow_similarity():
    rng = np.random.default_rng(0)
    for j in (0.95, 0.8, 0.5):
        d = []
        for _ in range(40):
            n = 400
            common = int(n * 2 * j / (1 + j))
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = x[:n], np.concatenate([x[:common], x[n : 2 * n - common]])
            o = minhash.odd_sketches(np.stack([minhash.samples(a), minhash.samples(b)])).view(np.uint64)
            d.append(int(np.bitwise_count(o[0] ^ o[1]).sum()))
        expect = minhash.BITS / 2 * (1 - (1 - 2 / minhash.BITS) ** (2 * minhash.SAMPLES * (1 - j)))
        assert abs(np.mean(d) - expect) < 6 and (j != 0.8 or max(d) <= minhash.MOST_BITS)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(3, 3), (5, 4)]
    rng.shuffle(edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(60)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def page_weights():
    return html_text.trained()


def test_blocks():
    page = "<!-- x --><head><title>T</title></head><body>loose &amp; text<p>one <b>two<br>three<p>four</p><script>var t='<p>no</p>';</script><ul><li><a href=x>five</a><li>six</ul></div>seven"
    assert [t for _, t, _ in html_text.blocks(page)] == ["loose & text", "one two three", "four", "five", "six", "seven"]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<script>only") == []


def test_held_out_layouts(page_weights):
    rng, right, total = random.Random(77), 0, 0
    for _ in range(150):
        page, truth = html_text.sample_page(rng)
        found = html_text.blocks(page)
        if len(found) == len(truth):
            right += int((html_text.Labeller(page_weights).label([html_text.features(found)])[0] == np.array(truth)).sum())
            total += len(truth)
    assert right / total > 0.98


def test_gradients_of_the_labeller():
    rng = random.Random(1)
    some = [html_text.sample_page(rng) for _ in range(6)]
    some = [(html_text.features(html_text.blocks(p)), np.array(t, float)) for p, t in some if len(html_text.blocks(p)) == len(t)][:3]
    m = html_text.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    xs, ys = zip(*some, strict=True)
    _, g = m.gradients(xs, ys)
    for k in m.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        o, e = m.p[k][i], 1e-3
        m.p[k][i] = o + e
        a = m.gradients(xs, ys)[0]
        m.p[k][i] = o - e
        b = m.gradients(xs, ys)[0]
        m.p[k][i] = o
        assert (a - b) / (2 * e) == pytest.approx(g[k][i], rel=1e-2, abs=1e-5)


def test_page_text(spark):
    article = "<article><h1>Head of it</h1><p>Some long enough text, with words. More &eacute; words\n  here.</p><p>Another paragraph of the article.</p></article>"
    page = f'<html><head><title>no</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">menu</a></li><li><a href="/b">items</a></li></ul></nav><div class="ad">Buy this.</div>{article}<footer>&copy; owner 2024</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", page), (4, "u", page), (None, "u", "<nav><a href=x>menu</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = collect(html_text.extract_pages(df), "page_id")
    want = "Head of it\nSome long enough text, with words. More é words here.\nAnother paragraph of the article."
    assert out[1][0]["text"] == want and out[1][0]["n_chars"] == len(want) and len(out[4]) == 2
    assert out[2][0]["text"] == out[3][0]["text"] == "" and out[2][0]["n_chars"] == 0
    assert html_text.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>no <b></title><meta charset=x><script>'<div>no'</script><body><p>One.</p><p>Two.</p>",
        "<html><head><title>no</title><p>One.</p><p>Two.</p></html>",
        "<head></head><p>One.<svg width=1 /></p><p>Two.</p>",
        "<p>One.<svg><path d=x /></svg></p><svg><p>Two.</p>",
        "<head-line><p>One.</p></head-line><style-guide>Two.</style-guide>",
        "<noscript><p>One.</p></noscript><object><p>Two.</p></object>",
        "<select><option>no</option></select><p>One<math><mi>.</mi></math></p><math/><p>Two.</p><script>no",
    ],
)
def test_skipped_elements_take_nothing_else(page):
    assert [text for _, text, _ in html_text.blocks(page)] == ["One.", "Two."]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<!-->visible</p><p>b</p>", ["avisible", "b"]),
        ("<p>a<!--->visible</p><!-- x --!><p>b<!-- > --></p><!-- no end <p>c", ["avisible", "b"]),
        ("<p data=it's>Hello. Don't stop</p><p title='a > b'>One</p><p x=\"1 > 0\">Two</p>", ["Hello. Don't stop", "One", "Two"]),
        ("<p a='>x</p>", ["x"]),
        ("<select><p>One.</p><select><option>no</option></select><p>Two.</p>", ["Two."]),
        ("</div></p><p>One.</div></section>Two.</p>", ["One.", "Two."]),
    ],
)
def test_hostile_markup(page, want):
    assert [text for _, text, _ in html_text.blocks(page)] == want


def test_path_sums_are_those_of_all_labels():
    page = "loose<div class='a b'><p>one</p><section id=c><p>two<ul><li>three<li>four</ul></section>five</div>"
    found = html_text.blocks(page)
    m = html_text.Labeller()
    x, _, _ = m.inputs([html_text.features(found)])
    for i, (path, _, _) in enumerate(found):
        labels = []
        while path is not None:
            labels += path.labels
            path = path.above
        want = sum(m.p["P"][html_text._hash(label, html_text.PATHS)] for label in labels) if labels else m.p["P"][0]
        assert np.allclose(x[i, 0, : html_text.SIZE], want, atol=1e-6)


@pytest.mark.parametrize("unit", ["<div class=x>a", "<select>a", "<svg><title>", "<p a='", "<a href=\"", "<!-- ", "</div>a", "<b x=\"y\"", "<textarea", "<div>"])
def test_pages_of_one_megabyte_of_anything(page_weights, unit):
    """Time and memory in proportion to the page, whatever it repeats."""
    import pickle
    import subprocess
    import sys
    import tempfile

    code = """
import pickle, resource, sys, time
from forelight.llm import html_text
weights = pickle.load(open(sys.argv[1], "rb"))
page = (sys.argv[2] * (1_000_000 // len(sys.argv[2])))
html_text.extract(["<p>warm</p>"], weights)
before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
html_text.extract([page], weights)
print(time.process_time() - t, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    with tempfile.NamedTemporaryFile(suffix=".pickle") as f:
        pickle.dump(page_weights, f)
        f.flush()
        out = subprocess.run([sys.executable, "-c", code, f.name, unit], capture_output=True, text=True, check=True, env=os.environ | {"OMP_NUM_THREADS": "1"}).stdout.split()
    assert float(out[0]) < 20 and int(out[1]) < 400, out


def test_long_page(page_weights):
    """A page of 100,000 blocks stays under 200 MB beside its own text, and keeps its article."""
    import subprocess
    import sys

    code = """
import pickle, resource, sys
from forelight.llm import html_text
weights = pickle.load(open(sys.argv[1], "rb"))
page = "<html><body><nav><a href=x>menu</a></nav><article>" + "".join(f"<p>Sentence number {i} of a very long article, with words.</p>" for i in range(100_000)) + "</article><footer>foot</footer>"
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before = peak()
text = html_text.extract([page, "<p>short</p>"], weights)[0]
print(peak() - before, text.count("\\n") + 1, "foot" in text, "menu" in text)
"""
    import pickle
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".pkl") as f:
        pickle.dump(page_weights, f)
        f.flush()
        out = subprocess.run([sys.executable, "-c", code, f.name], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    mb, lines, foot, menu = out.stdout.split()
    assert int(mb) < 200 and int(lines) >= 99_900 and foot == menu == "False", out.stdout + out.stderr


# ---- 6 ----------------------------------------------------------------------------------------
def test_language_model(spark):
    rng = random.Random(6)
    follow = {w: rng.sample(WORDS[:50], 2) for w in WORDS[:50]}

    def text():
        w = [rng.choice(WORDS[:50])]
        for _ in range(rng.randint(200, 400)):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w) + (f" rare{rng.randint(0, 400)}" if rng.random() < 0.5 else "")

    df = make(spark, [(k, text()) for k in range(400)])
    out = lm_score.score_documents(df).collect()
    rows = [(r["doc_id"], (r["text"] or "").lower().split()) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in rows if not held(i) for w in [*ws, "\n"])
    n, v = sum(c.values()), len(c)
    base = {(i, len(ws) + 1): sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, "\n"]) for i, ws in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r["train_tokens"] == n and r["held_out"] == held(r["doc_id"])
        assert r["base_score"] == pytest.approx(base[r["doc_id"], r["n_tokens"]], rel=1e-9)
    some = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)
    known = {(i, len(ws) + 1): sum(w in c for w in [*ws, "\n"]) for i, ws in rows}
    assert all(known[r["doc_id"], r["n_tokens"]] == r["n_known"] for r in out)
    assert lm_score.score_documents(empty(spark)).count() == 0


def test_language_model_of_short_texts(spark):
    """The model learns from texts of 20 to 60 words too."""
    rng = random.Random(6)
    follow = {w: rng.sample(WORDS[:50], 2) for w in WORDS[:50]}

    def text():
        w = [rng.choice(WORDS[:50])]
        for _ in range(rng.randint(20, 60)):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w) + (f" rare{rng.randint(0, 400)}" if rng.random() < 0.5 else "")

    some = [r for r in lm_score.score_documents(make(spark, [(k, text()) for k in range(400)])).collect() if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)


def test_size_of_the_language_model():
    """The symbols in context, their classes and the units are not cut, and grow with the words."""
    from forelight.llm import gru

    assert gru.HIDDEN >= 24 and gru.EMBED >= 24 and lm_score.RARE >= 32
    assert lm_score.symbols_of(100) == 1024 and lm_score.symbols_of(404_216) == 1270 and lm_score.symbols_of(100_000_000) == 20_000
    assert gru.Layout(1e6 / np.arange(1, 1025), lm_score.RARE).split > 16


def test_far_words_are_joined(spark, monkeypatch):
    """With a short near list most words go through the join, to the same base score."""
    rng = random.Random(8)
    df = spark.createDataFrame([(k, words(rng, 30, 150), "en", "a", None) for k in range(60)], DOCS)
    monkeypatch.setattr(lm_score, "ROUNDS", ())
    whole = {r["doc_id"]: r for r in lm_score.score_documents(df).collect()}
    monkeypatch.setattr(lm_score, "SYMBOLS", 16)
    monkeypatch.setattr(lm_score, "NEAR", 20)
    for r in lm_score.score_documents(df).collect():
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"]) and r["n_known"] == whole[r["doc_id"]]["n_known"]


def test_distinct_words_are_looked_up_once(monkeypatch):
    """A batch's words are looked up once each, however often they occur, and each text gets its own sums."""
    import pyarrow as pa

    near = ["ab", "\u00e9", "cd", "ef"]
    spec = {"key": "x", "kind": "<u2", "symbols": 3, "words": " ".join(near), "counts": np.array([9, 7, 5, 4, 2]), "end": 1,
            "class_n": np.arange(32.0) + 2, "class_v": np.arange(32.0) + 1, "n": 400, "v": 60}
    voc, asked = lm_score.Vocabulary(spec), []
    look_up = voc.look_up
    monkeypatch.setattr(voc, "look_up", lambda w: asked.append(len(w)) or look_up(w))
    texts = [None, "", " \t", "AB ab\x0bzz\x0cCD\r\nzz ", "\u00c9 \u00e9 a\u3000b x\x00y x\x1cy", "EF " * 50_000 + "far " * 3]
    got = list(zip(*[a.to_pylist() for a in lm_score._encoded(pa.array(texts, pa.string()), voc)], strict=True))
    rank = {w: i for i, w in enumerate(["ab", "\n", "\u00e9", "cd", "ef"])}
    klass = lambda w: zlib.crc32(w.encode()[-3:]) % 32
    words_in = [re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    for ws, (n, known, base, inside, far, n_far, symbols) in zip(words_in, got, strict=True):
        log = lambda w: math.log10(spec["counts"][rank[w]] + 0.5) if w in rank else 0
        unknown = [w for w in ws if w not in rank]
        assert (n, known, far, n_far) == (len(ws) + 1, len(ws) + 1 - len(unknown), " ".join(unknown), len(unknown))
        assert base == pytest.approx(sum(log(w) for w in [*ws, "\n"]) - n * math.log10(400 + 0.5 * 61))
        assert inside == pytest.approx(sum(log(w) - math.log10(2 + klass(w) + 0.5 * (klass(w) + 2)) for w in ws if rank.get(w, 3) >= 3))
        assert np.frombuffer(symbols, "<u2").tolist() == [rank[w] if rank.get(w, 3) < 3 else 3 + klass(w) for w in ws] + [1]
    assert asked == [len({w for ws in words_in for w in ws})]
    kinds = [x.type for x in lm_score._encoded(pa.array(texts, pa.string()), voc)]
    for blank in ([None, " "], []):  # a batch without words has the same columns
        assert [x.type for x in lm_score._encoded(pa.array(blank, pa.string()), voc)] == kinds


def test_model_is_a_distribution():
    from forelight.llm import gru

    layout = gru.Layout(np.array([50.0, 30, 20, 10, 5, 2]), 4, classes=3)
    p = gru.start(layout, np.ones(10))
    h = np.random.default_rng(0).normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    total = sum(np.exp(gru.log_probs(p, layout, h, np.array([s]))[0]) for s in range(10))
    assert total == pytest.approx(1, abs=1e-5)


def test_state_is_carried_over_windows():
    from forelight.llm import gru

    layout = gru.Layout(np.array([50.0, 30, 20, 10, 5, 2]), 4, classes=3)
    p = gru.start(layout, np.ones(10))
    r = np.random.default_rng(1)
    texts = [r.integers(0, 10, n).astype(np.int32) for n in (1, 5, 70, 200, 33)]
    a, b, c = (gru.score_texts(p, layout, 0, texts, lanes, w) for lanes, w in ((2, 7), (5, 64), (1, 1000)))
    assert np.allclose(a, b, rtol=1e-5) and np.allclose(b, c, rtol=1e-5)


def test_gradients_of_the_language_model():
    from forelight.llm import gru

    r = np.random.default_rng(1)
    layout = gru.Layout(np.array([50.0, 30, 20, 10, 5, 5, 2, 1]), 3, classes=3)
    p = {k: v.astype(np.float64) for k, v in gru.start(layout, np.ones(11)).items()}
    args = (r.integers(0, 11, (5, 4)), r.random((5, 4)) < 0.3, r.integers(0, 11, (5, 4)), r.random((5, 4)) < 0.8, r.normal(0, 0.5, (4, gru.HIDDEN)))
    _, g, _ = gru.gradients(p, layout, *args)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        o, e = p[k][i], 1e-2
        p[k][i] = o + e
        a = gru.gradients(p, layout, *args)[0]
        p[k][i] = o - e
        b = gru.gradients(p, layout, *args)[0]
        p[k][i] = o
        assert (a - b) / (2 * e) == pytest.approx(g[k][i], rel=3e-2, abs=2e-4)


# ---- 7 ----------------------------------------------------------------------------------------
def toxic_rows(rng, n):
    rows = []
    for k in range(n):
        bad = k % 5 == 0
        w = words(rng, rng.randint(5, 80), 150).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilex", "gruntix", "scornel"]))
        rows.append((k, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(random.Random(7), 900)
    df = make(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (9005, 0), (9005, 0)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).withColumn("text", F.lit("clash"))
    out = collect(toxicity.score_documents(df, labels))
    truth = {i: y for i, _, y in rows}
    held = [r for i, x in out.items() for r in x if r["held_out"] and i in truth]
    assert {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1} == {r["doc_id"] for r in held}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for x in out.values() for r in x) and len(out[9005]) == 2
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for x in out.values() for r in x)
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    assert {r["score"] for r in toxicity.score_documents(df, labels.limit(0)).collect()} == {0.0}


def test_pairs_of_terms_count():
    """A label that only the pair decides: the factors learn what a linear part can't."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(int)
    rows = [np.flatnonzero([a, b, True]).astype(np.int32) for a, b in x]
    m = toxicity.fit(rows[:2000], y[:2000])
    assert ((toxicity.score_rows(rows[2000:], m) > 0.5) == y[2000:]).mean() > 0.99


def test_pairs_among_many_group_terms_count():
    """Toxic is a group term with an insult; no term alone has log odds of 1.5."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        group, insult = (rng.random(2) < 0.5).tolist()
        some = [*(100 + rng.choice(2000, 20, replace=False)), *[10 + rng.integers(12)] * group, *[30 + rng.integers(12)] * insult]
        rows.append(np.unique(some).astype(np.int32))
        y.append(int(group and insult))
    y = np.array(y)
    has = np.array([[t in r for t in (*range(10, 22), *range(30, 42))] for r in rows[:3000]])
    a, b = has[y[:3000] > 0].mean(axis=0), has[y[:3000] == 0].mean(axis=0)
    assert (np.abs(np.log(a / (1 - a)) - np.log(b / (1 - b))) < 1.5).all()
    m = toxicity.fit(rows[:3000], y[:3000])
    assert ((toxicity.score_rows(rows[3000:], m) > 0.5) == y[3000:]).mean() > 0.97
    empty_rows = [np.empty(0, np.int32), np.array([77_777], np.int32)]
    assert np.ptp(toxicity.score_rows(empty_rows, m)) == 0 and toxicity.fit(empty_rows[:1] * 4, np.array([0, 1, 0, 1]))["share"] == 0.5




def test_the_factored_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(7)
    w0, w, v = 0.3, rng.normal(size=50), rng.normal(size=(50, toxicity.FACTORS))
    rows = [rng.choice(50, n, replace=False) for n in (0, 1, 2, 7, 30)]
    score, _ = toxicity.forward(np.concatenate(rows), np.array([len(r) for r in rows]), w0, w, v)
    for r, got in zip(rows, score, strict=True):
        want = w0 + sum(w[i] for i in r) + sum(float(v[i] @ v[j]) for a, i in enumerate(r) for j in r[:a])
        assert got == pytest.approx(want, rel=1e-9)


# ---- 8 ----------------------------------------------------------------------------------------
def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_fertility(spark):
    rng = random.Random(8)
    rows = [(k, words(rng, rng.randint(12, 200), 150)) for k in range(300)]
    rows += [(400, "x y z q # * | <a>\nx y z\n\nx y z"), (401, "a b c d e f g a b c d e h i j k l m n o p q r s t u v w"), (402, "one two three four five six " * 5), (403, "".join(chr(0x12000 + rng.randrange(900)) + " " for _ in range(150))), (404, "é ü " * 3 + words(rng, 30))]
    df = make(spark, rows)
    out = collect(fertility.quality(df, vocabulary("piece_bpe_32k.model")))
    for r in df.collect():
        for o in out[r["doc_id"]]:
            have = (o["n_words"], o["word_chars"], o["n_symbols"], o["n_dup_lines"], o["n_repeat_words"])
            assert have == brute_counts(r["text"])
            assert o["base_failed"] == (have[0] < 10 or 100 * have[4] > 20 * have[0]) and not (o["base_failed"] and o["kept"])
    assert sum(out[k][0]["kept"] for k in range(300)) >= 295 and not out[403][0]["kept"] and not out[403][0]["base_failed"]
    assert fertility.quality(empty(spark), vocabulary("piece_bpe_32k.model")).count() == 0


# ---- 9, 10 ------------------------------------------------------------------------------------
ALPHABET = list("ab cdeéthein \n\t\r▁日本𝄞ﬁ①　\xa0'!.0123ABĆ​\x00�  ") + ["  ", "the", " in", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "'s", "'RE", "ing "]


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", "a" * 1000, "日本" * 200, LONG[:5000]]


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib, m = sentencepiece.SentencePieceProcessor(model_file=path), sp_bpe.model(path)
    texts = fuzz(4000, 9)
    for t, raw in zip(texts, m.encode_all(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == lib.encode(t)
        assert m.decode([m.bos, *ids, m.eos]) == lib.decode([m.bos, *ids, m.eos])
    df = make(spark, list(enumerate(texts[:50])))
    out = collect(sp_bpe.encode_documents(df, path, keep_ids=True))
    for r in df.collect():
        want = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        for o in out[r["doc_id"]]:
            assert (o["n_tokens"], o["ids"], o["ids_sha256"]) == (len(want), want, hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
            assert o["decoded_sha256"] == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    assert sp_bpe.encode_documents(empty(spark), path).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    texts = fuzz(300, 11)
    want = sp_bpe.model(path).encode_all(texts)
    monkeypatch.setattr(sp_bpe, "CACHE", 3)
    monkeypatch.setattr(sp_bpe, "PAIRS", 50)
    monkeypatch.setattr(sp_bpe, "GROUP_CHARS", 100)
    monkeypatch.setattr(sp_bpe, "LONG", 6)
    assert sp_bpe.PieceModel(path).encode_all(texts) == want


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib, m = Tokenizer.from_file(path), bpe_count.merger(path)
    for t in fuzz(4000, 10):
        assert m.count(t) == len(lib.encode(t, add_special_tokens=False).ids)
    df = make(spark, list(enumerate(fuzz(40, 12))))
    out = collect(bpe_count.count_tokens(df, path))
    for r in df.collect():
        for o in out[r["doc_id"]]:
            n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
            assert (o["n_bytes"], o["n_tokens"], o["over_limit"]) == (len((r["text"] or "").encode()), n, n > 512)
    assert bpe_count.count_tokens(empty(spark), path).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="pre_tokenizer, added_tokens"):
        bpe_count.Merger(str(tmp_path / "v.json"))


# ---- the rest ---------------------------------------------------------------------------------
def test_nothing_else_imports_this_package():
    top = os.path.dirname(os.path.dirname(os.path.abspath(bpe_count.__file__)))
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"(from|import) .*\bllm\b", open(os.path.join(folder, n)).read()), n
