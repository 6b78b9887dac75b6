"""A training-corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.bpe import encode_decode
from auditlake.llm.common import read_table, shared_dir
from auditlake.llm.decontaminate import decontaminate
from auditlake.llm.jaccard import near_texts
from auditlake.llm.lines import dedup_lines
from auditlake.llm.toxicity import fit, score_toxicity
from auditlake.shipping import ship

#: SQL can't express the stages' models and hashes; tests hold them against brute force.
ORACLE_SQL = None


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id and text are those of a row (doc_id, text_h) of ``gone``."""
    gone = gone.select(F.col("doc_id").alias("k"), "text_h").distinct()
    same = docs["doc_id"].eqNullSafe(gone["k"]) & (F.xxhash64(docs["text"]) == gone["text_h"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go, each by its key and text."""
    ship(spark)
    scored = score_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return without(docs, scored.where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that lost lines and have no line with a word left. ``n_chars`` follows the text."""
    ship(spark)
    out = dedup_lines(docs).where("_n_removed = 0 or _n_worded > 0")
    chars = F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (key and text) of each group of near copies stays: the one with the smallest doc_id."""
    ship(spark)
    return without(docs, near_texts(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    ship(spark)
    return without(docs, decontaminate(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    ship(spark)
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and read again."""
    docs, where = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{number}")
        docs = spark.read.parquet(f"{where}/{number}")
    return docs
