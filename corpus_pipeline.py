"""The corpus pipeline: documents in, tokenised clean documents out.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and
returns the columns of ``documents`` (the last: token numbers and digests). ``run``
writes each stage as Parquet in the folder of spark.checkpoint.dir, reads it again, and
deletes it once the next stage is written.

Line dedup runs with ``whole_copies``: documents that are copies of each other reach the
near-duplicate stage whole, which keeps one of them.

Defined results: null, empty and blank texts are scored like any other by the first
stage, have no lines, no duplicates and no benchmark passages, and end with the begin
and end ids only; a null doc_id names no group unless all its rows lack one; rows alike in
doc_id and text share one fate; an empty table gives an empty result; without labels nothing is toxic; further
columns of the documents, whatever their names, are carried up to the last stage, which returns doc_id and
its own results only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from forelight.llm import decontam, line_dedup, minhash, sp_bpe, toxicity
from forelight.llm.common import delete, documents, scratch_dir, table
from forelight.llm.queries import vocabulary


BATCH, USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 24


def _lean(spark: SparkSession, share: int = 2) -> None:
    """Let batches for Python workers hold 8 MB at most (4 MB in the last stage, which meets all that the
    others left), unless the session asks for another size than the operators' own: workers and heaps of
    one stage are still there in the next."""
    if spark.conf.getAll.get(BATCH, str(USUAL)) in (str(USUAL), str(USUAL // 2), str(USUAL // 4)):
        spark.conf.set(BATCH, str(USUAL // share))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return line_dedup.remove_boilerplate(docs, whole_copies=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark, 4)
    return sp_bpe.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenise),
]

#: trained and iterative stages are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    top = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            delete(spark, done)
        done = path
    return docs
