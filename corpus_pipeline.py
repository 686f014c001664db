"""A corpus from raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame: documents
with the columns they came with, and at the end token ids.

Defined results, of every stage: columns besides doc_id, text, lang, source and
n_chars come through as they are, whatever their names (the last stage leaves
them); an empty table stays empty; long texts are taken whole; of repeated rows
each is judged by itself, but near-duplicate removal leaves one.  A null text is
empty: the quality rules drop it.  Null ids, languages and sources are values of
their own; near-duplicate removal keeps rows without an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcut.llm import runtime
from loomcut.llm.dedup_stage import keep_one_of_each
from loomcut.llm.mixing import mixed_documents
from loomcut.llm.quality_js import keep_good
from loomcut.llm.runtime import cut, table
from loomcut.llm.sentencepiece_sa import encode
from loomcut.llm.toxicity_nb import keep_civil

#: Bytes of rows that a worker gets at once, where the session has Spark's own default: an executor holds them several times.
BATCH_BYTES = 8 << 20
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def ship(spark: SparkSession) -> None:
    """What the stages' workers need, and batches that leave an executor room for what five stages have left in its memory."""
    runtime.ship(spark)
    if spark.conf.get(_SETTING).removesuffix("b") == str(_DEFAULT):
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the fixed rules or their histograms' distance reject."""
    ship(spark)
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a classifier, fitted to the labels of what came in, finds toxic."""
    ship(spark)
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 over 5-word shingles."""
    ship(spark)
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents so that the sources meet their target weights."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` of every row."""
    ship(spark)
    return encode(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("near-dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Classifier, sketches and suffix arrays have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
