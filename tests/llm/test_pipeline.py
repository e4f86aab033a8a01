"""The pipeline's stages, one after another, on planted documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

WORDS = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "r")]


def text(rng, lines=4, n=15):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(n)) for _ in range(lines))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        t = text(rng)
        if k % 6 == 0:
            t = t.replace("\n", " vilex gruntix \n", 2) + " scornel vilex"
        labels.append((k, 1, int(k % 6 == 0)))
        rows.append((k, t, "en", f"s{k % 20}", len(t)))
    toxic = {k for k in range(600) if k % 6 == 0}
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    copies = text(rng, 6)
    rows += [(1000 + k, copies if k < 5 else copies.replace(copies.split()[k], "zzz", 1), "en", f"s{k}", 1) for k in range(10)]
    rows += [(2000 + k, text(rng, 2) + "\nThe same line on every one of these sites.\n" + text(rng, 2), "en", f"s{k % 20}", 1) for k in range(40)]
    rows += [(3000, text(rng, 1) + " " + item, "en", "s1", 1), (3001, None, "en", "s1", None), (3002, "", None, None, 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
        assert name == "sentencepiece" or docs.columns == columns
    everything = {r[0] for r in rows}
    assert len(kept["toxicity"] & toxic) <= 2 and everything - toxic <= kept["toxicity"]
    lines = spark.read.parquet(f"{sf}/stage1")
    assert kept["line_dedup"] == kept["toxicity"] and lines.where(F.col("text").contains("The same line on every")).isEmpty()
    assert kept["line_dedup"] - kept["near_dedup"] == set(range(1001, 1010))
    assert kept["near_dedup"] - kept["decontamination"] == {3000} and kept["sentencepiece"] == kept["decontamination"]
    assert {r[0] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == kept["sentencepiece"]


def test_awkward_tables(spark, tmp_path):
    """Empty tables, and columns whose names the stages use themselves, go through."""
    rng = random.Random(2)
    rows = [(k, text(rng) if k % 5 else None, "en", f"s{k % 3}", k) for k in range(40)] + [(None, text(rng), None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "hit", "row", "judged__", "state__", "k1", "r1", "sid", "salt", "rank"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, some in (("full", docs), ("none", docs.limit(0))):
        sf = str(tmp_path / name)
        some.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.count() == (42 if name == "full" else 0) and {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_batches_of_the_last_stage_are_small(spark, sf):
    """The last stage meets what the others left in workers and heaps; a session's own size stays."""
    before = spark.conf.getAll.get(corpus_pipeline.BATCH)
    try:
        for own, want in ((str(1 << 24), str(1 << 22)), ("777777", "777777")):
            spark.conf.set(corpus_pipeline.BATCH, own)
            docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
            corpus_pipeline.reject_toxic(spark, docs.selectExpr("doc_id", "text"), sf)
            corpus_pipeline.tokenise(spark, docs, sf)
            assert spark.conf.get(corpus_pipeline.BATCH) == want
    finally:
        spark.conf.unset(corpus_pipeline.BATCH) if before is None else spark.conf.set(corpus_pipeline.BATCH, before)
