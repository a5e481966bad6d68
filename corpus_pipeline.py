"""A corpus pipeline of five stages, each calling one of the corpus operators; every stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, common, jaccard, langid, mixing, suffix

_MADE: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the scratch tables of the stage before, whose result has been written by now."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(spark, _MADE, keep=docs)
        with common.scope() as made:
            out = function(spark, docs, sf_dir)
        _MADE.extend(made)
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: null texts and texts without letters, and texts far from every profile."""
    found = langid.annotate(docs, langid.train(docs))
    lang, score = (F.col(c) for c in found.columns[-2:])
    return found.where((lang != "und") & (score >= 0.1)).select(*common.own_columns(docs))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates (five words, similarity 0.75): that of the smallest id, null ids last."""
    (row,) = common.fresh(docs, "_row")
    numbered = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), "doc_id").join(found, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    keep = ids.groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    return numbered.join(keep, row, "left_semi").select(*common.own_columns(docs))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 50 words or more that occurred before, and nothing else; n_chars stays that of the document as it came."""
    return suffix.remove_repeats(docs, min_words=50)


@_stage
def curriculum(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes, in training order."""
    return mixing.copies(docs)


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and the decoded text of every training row."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("curriculum_mix", curriculum),
    ("bpe_encode", encoded),
]

#: Language profiles, components and suffixes are not expressible in SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder, each stage's result written to the scratch folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
