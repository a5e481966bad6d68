"""One query for each operator, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import MIXTURE_SQL
from .topk import TOPK_SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import label_lines, train

    docs = _documents(spark, sf_dir)
    return label_lines(docs, train(docs, _labels(spark, sf_dir)))


def op2_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, predict, train

    docs = _documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    return kd_shards(_documents(spark, sf_dir), n_shards=24)


def op4_partition_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture, position

    out = mixture(_documents(spark, sf_dir)).withColumn("position", position(F.col("before").cast("double")))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(_documents(spark, sf_dir), min_words=35)


def op7_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import repeated_spans

    return repeated_spans(_documents(spark, sf_dir), min_words=50)


def op8_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), outputs=False)


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import score
    from .langid import held_out

    return score(_documents(spark, sf_dir), held_out(F.col("doc_id"), 7, 2))


def op10_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf": op1_line_crf,
    "op2_rank_profiles": op2_rank_profiles,
    "op3_kd_shards": op3_kd_shards,
    "op4_partition_jaccard": op4_partition_jaccard,
    "op5_curriculum_mix": op5_curriculum_mix,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sparse_suffixes": op7_sparse_suffixes,
    "op8_lexicon_bpe": op8_lexicon_bpe,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_kd_topk": op10_kd_topk,
}

ORACLES: dict[str, str] = {
    "op10_kd_topk": TOPK_SQL,
    "op5_curriculum_mix": f"""
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN target <= 0 THEN 0.0 WHEN ramp = 0 THEN least(1.0, before / target)
            ELSE (sqrt((1.0 - ramp) * (1.0 - ramp) + 4.0 * ramp * least(1.0, before / target)) - (1.0 - ramp)) / (2.0 * ramp) + 0.0 END AS position
FROM ({MIXTURE_SQL.replace("SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken", "SELECT doc_id, size, source_size, target, ramp, CAST(before AS DOUBLE) AS before, CAST(size * copies AS BIGINT) AS taken")})""",
}
