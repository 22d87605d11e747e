"""A corpus pipeline made of the training-data operators.

Quality rules drop rejected documents, SimHash keeps one document of each near-duplicate class, decontamination drops
documents that repeat the benchmark, secret scans redact what they find, and SentencePiece encodes what is left. Each
stage works on all that its predecessor kept. All but the last return the columns of documents, whatever their names.

Null and empty texts have no words and are rejected by the quality rules; a stage that meets them nevertheless treats
nulls as empty texts. Rows with a null doc_id are documents like others. Of wholly repeated rows one is left after the
near duplicates. Texts of any length are read whole. Empty tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm import decontaminate, quality_rules, secret_scan, sentencepiece_bpe, simhash
from kbq.llm.common import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the base rules and the certified rules of their language keep. Nulls and texts under ten words go."""
    others = [c for c in docs.columns if c != "doc_id"]
    judged = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=tuple(others))
    named = {c: F.col(f"carry_{c}").alias(c) for c in others} | {"doc_id": F.col("doc_id")}
    return judged.where("kept").select(*[named[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that with the smallest doc_id. Texts without words are one class."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of which benchmark windows cover a twentieth or more. Texts without words stay; so does everything if there is no benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets in their texts replaced; null texts stay null."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each of docs: its number of tokens, their checksum, and a digest of the decoded text; null texts have no tokens."""
    return sentencepiece_bpe.round_trip(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secret scan", secrets), ("sentencepiece", encode)]

#: SQL cannot express the quality thresholds or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
