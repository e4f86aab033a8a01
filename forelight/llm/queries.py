"""The queries of this package, one per operator, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_count, decontam, fertility, hilbert, html_text, line_dedup, lm_score, minhash, mixing, prefix_trie, sp_bpe, toxicity, whitening
from .common import documents, table


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary; workers read it from their own installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judged(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", *(f"judged__.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"), report=True)
    return out.select("doc_id", "n_lines", "n_boilerplate", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.encode_documents(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.regrafted_trie(table(spark, sf_dir, "conversations"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_page_text": op5_page_text,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_fertility": op8_fertility,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_mix_sources": op12_mix_sources,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc32(c: str) -> str:
    """CRC-32 of a string by a table of 256 steps, crc_t."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({c})) + 1), "
        f"lambda i: ('0x' || substr(hex(encode({c})), CAST(2 * i - 1 AS INTEGER), 2))::BIGINT)), "
        "lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])))"
    )


_CRC_STEPS = "range(0, 256)"
for _ in range(8):
    _CRC_STEPS = f"list_transform({_CRC_STEPS}, lambda c: (CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _hilbert_sql(bits: int = 3, dims: int = 4) -> str:
    """The sharding in SQL: CRC-32 bit by bit tables, then the curve one step a query."""
    crc, table_steps = _crc32, _CRC_STEPS
    bucketed = f"""
  SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32, lang, source) - 1 AS copy, lang AS b0, source AS b1, size AS b2, doc_id AS b3
  FROM (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table)"""
    codes = ", ".join(
        f"code{i} AS (SELECT b{i}, CAST((sum(count(*)) OVER (ORDER BY b{i} NULLS FIRST) - count(*)) * {1 << bits} // sum(count(*)) OVER () AS INTEGER) AS x{i} FROM bucketed GROUP BY b{i})" for i in range(dims)
    )
    sql = f"""
  SELECT doc_id, lang, source, size, text_crc32, copy, {", ".join(f"x{i}" for i in range(dims))}
  FROM bucketed b {" ".join(f"JOIN code{i} ON code{i}.b{i} IS NOT DISTINCT FROM b.b{i}" for i in range(dims))}"""
    x = [f"x{i}" for i in range(dims)]
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i, c in enumerate(x):
            if i == 0:
                new = f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END AS x0"
            else:
                new = f"CASE WHEN {c} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, xor(x0, {c}) & {p}) END AS x0, CASE WHEN {c} & {q} <> 0 THEN {c} ELSE xor({c}, xor(x0, {c}) & {p}) END AS {c}"
            sql = f"SELECT * REPLACE ({new}) FROM ({sql})"
    for a, b in zip(x, x[1:], strict=False):
        sql = f"SELECT * REPLACE (xor({b}, {a}) AS {b}) FROM ({sql})"
    t = "0"
    for level in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN {x[-1]} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    sql = f"SELECT *, {t} AS t FROM ({sql})"
    index = "0"
    for level in range(bits - 1, -1, -1):
        for c in x:
            index = f"({index} * 2 + ((xor({c}, t) >> {level}) & 1))"
    return f"""
WITH crc_table AS (SELECT {table_steps} AS crc_t),
bucketed AS ({bucketed}),
{codes},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY h, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR) || CASE WHEN copy > 0 THEN ':' || CAST(copy AS VARCHAR) ELSE '' END), 1, 8), doc_id, text_crc32, size, copy) - 1 AS rank, count(*) OVER () AS n
  FROM (SELECT doc_id, lang, source, size, text_crc32, copy, {index} AS h FROM ({sql})))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * 8 // n AS INTEGER) AS shard,
       CAST(rank - ((rank * 8 // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, lang, source
FROM ranked
"""


ORACLE: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, g.n, i FROM grams g JOIN windows v ON g.n = v.n AND g.gram = v.gram),
word_hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
item_hits AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word_hits USING (doc_id) LEFT JOIN item_hits USING (doc_id)
""",
    "op2_line_dedup": r"""
WITH line AS (
  SELECT doc_id, source, text, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, raw
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
spread AS (SELECT line FROM line WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
told AS (
  SELECT doc_id, pos, raw, line.line <> '' AS is_full, spread.line IS NOT NULL AS hit
  FROM line LEFT JOIN spread ON line.line = spread.line),
doc AS (
  SELECT doc_id, count(*) FILTER (WHERE is_full) AS n_lines, count(*) FILTER (WHERE hit) AS n_boilerplate,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hit) AS rest
  FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_boilerplate, 0) AS n_removed,
       sha256(CASE WHEN n_boilerplate > 0 THEN coalesce(rest, '') ELSE coalesce(d.text, '') END) AS text_sha256
FROM documents d LEFT JOIN doc USING (doc_id)
""",
    "op3_hilbert_shards": _hilbert_sql(),
    "op4_near_duplicates": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (WITH RECURSIVE r AS (SELECT x AS a, x AS b FROM edge UNION SELECT r.a, e.y FROM r JOIN edge e ON r.b = e.x) SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id
""",
    "op11_prefix_trie": f"""
WITH crc_table AS (SELECT {_CRC_STEPS} AS crc_t),
turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || t)) AS turns
  FROM turn GROUP BY conv_id),
told AS (SELECT conv_id, turns, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc_table),
built AS (
  SELECT c.conv_id, CASE WHEN p.conv_id IS NULL THEN c.turns[h + 1 :] ELSE list_concat(p.turns[1 : h], c.turns[h + 1 :]) END AS turns
  FROM told c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 5),
prefix AS (
  SELECT conv_id, turns[1 : d] AS k, d, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
node AS (
  SELECT k, min(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends
  FROM prefix GROUP BY k),
child AS (SELECT k[1 : d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
valued AS (
  SELECT node.*, coalesce(child.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(k[d].t)) END AS saved
  FROM node LEFT JOIN child USING (k)),
up AS (
  SELECT k[1 : a] AS k, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT k, saved, n_children, unnest(range(0, d + 1)) AS a FROM valued) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN up USING (k) LEFT JOIN node p ON v.d > 0 AND p.k = v.k[1 : v.d - 1]
""",
}
