"""The corpus pipeline; part of subpackage ``llm``.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination and
byte-level BPE, each over all that the stage before it kept. All stages but the
last return the columns of ``documents``, extra ones too, whatever their names.

Every stage takes null ids, null and empty texts, repeated rows and empty tables. A
null text counts as empty. Rows of the same id and text are one document to line and
near dedup; the first loses no lines to itself, the second keeps one of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import bpe, common, decontaminate, line_dedup, near_copies, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; an empty text has the score of the
    bias alone. Without labels of both kinds every document has the same score, the
    share of good labels, and one half without labels: then all stay."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; the documents stay, with n_chars of what is left."""
    found = line_dedup.dedup_lines(docs).select(docs.columns)
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id (null last), then
    of the least hash of the text. Texts without words are one group."""
    return near_copies.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; rows of one id are judged each by
    its own text. Without items all stay."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of them and of what they decode to; an
    empty text has no ids."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("byte_level_bpe", tokens),
]

#: The classifier is no SQL; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written once, as the later
    ones read it several times."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
