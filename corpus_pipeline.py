"""A training-corpus pipeline of four stages, each written as Parquet and read again by the next.

quality: documents that the classifier rejects go. near_duplicates: one document of each group stays.
secrets: every reported span is replaced by a placeholder of its kind. packing: token sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm.common import stored
from tidewall.llm.neardup import one_of_each
from tidewall.llm.packing import pack_documents
from tidewall.llm.quality import score_quality
from tidewall.llm.secrets import mask_spans, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose quality score is at least the classifier's threshold; each is judged by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, keep=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: a row with the group's least id."""
    return one_of_each(docs, COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    masked = scan_secrets(docs, keep=("text", "lang", "source")).withColumn("text", mask_spans(F.col("text"), F.col("found")))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place there."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("secrets", secrets_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's rows stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning, similarity components and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
