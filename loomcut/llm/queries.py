"""The queries of the subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_scan import search
from .dedup_minhash import near_duplicates
from .html_paths import extract
from .license_join import scan
from .lm_hmm import lm_score
from .mixing import taken_words
from .oracles import SQL
from .quality_js import quality
from .runtime import table
from .sentencepiece_sa import encode
from .toxicity_nb import toxicity
from .warc_zip import round_trip


def op1_lm_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op2_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op7_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ann_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of ``op1``: folds, counts and base scores."""
    scored = lm_score(table(spark, sf_dir, "documents"), states=2, iterations=1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of ``op5``: the fixed rules."""
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of ``op10``: sizes and targets, and that the words taken come near them and within bounds."""
    mixed = taken_words(table(spark, sf_dir, "documents"))
    met = mixed.groupBy(F.col("source").alias("of")).agg(F.sum("taken").alias("sum"))
    near = F.abs(F.col("sum") - F.col("target")) <= 256 + 0.01 * F.col("target")
    bounds = (F.col("taken") >= 0) & (F.col("taken") <= 3 * F.col("size"))
    return mixed.join(met, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), near.alias("near_target"), bounds.alias("in_bounds"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {f.__name__: f for f in (lm_base_scores, quality_base_rules, mix_targets)}
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | more


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
