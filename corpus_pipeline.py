"""From raw documents to a mixed training corpus: five stages, each written and read again.

Every stage takes all that the one before kept. Columns beyond those of documents pass through unchanged, whatever their
names; an empty table stays empty. A null text counts as an empty one throughout and stays null where its row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, saved, table
from tallyspark.llm.op1_mixing import mix_sources, tempered_weights
from tallyspark.llm.op2_decontamination import decontaminate
from tallyspark.llm.op3_pii import surrogates
from tallyspark.llm.op7_quality import THRESHOLD, learn, scored
from tallyspark.llm.op9_neardup import deduplicate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier takes for bad ones: a score under the threshold. Equal texts have equal
    scores, so repeated rows go or stay together; null and empty texts are scored like others. Without usable labels all
    documents have one score, one half, and stay."""
    forest = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, forest).where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: that of the smallest doc_id, of rows that share it and the text
    the first by their other columns. Null ids come last. Null, empty and wordless texts are alike only if they are equal."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, repeated rows with them. Null and empty texts hold nothing; null,
    empty and very short items aren't looked for. An empty benchmark drops nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates, row for row; n_chars follows the text. Equal texts stay equal, null ones null."""
    return surrogates(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its place in the mixture of sources, row for row. A null source is one of its own; rows without
    a doc_id are ordered by a hash of their columns; rows alike in all are interchangeable."""
    return mix_sources(docs, tempered_weights(docs))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixing),
]

#: No SQL expresses trees fitted to data, alignment or keyed surrogates; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(*before)  # the stage that was read is no longer needed
        before = [docs]
    return docs
