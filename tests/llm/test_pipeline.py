"""The pipeline's stages, each on its own input, and run() as a whole."""

from __future__ import annotations

from collections import Counter

import pytest

from tests.llm import corpus as K

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    rows = K.documents(60)
    table = spark.createDataFrame(rows, K.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs.collect()
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == table.columns
        if name == "language_id":
            assert Counter(r.text for r in after) == Counter(r.text for r in before if any(c.isalpha() for c in r.text or ""))
        if name == "jaccard_join":
            found = {(c, i) for i, _, c in K.components([tuple(r) for r in before]) if i is not None}
            assert sorted(r.doc_id for r in after) == sorted({c for c, _ in found})
        if name == "suffix_array_dedup":
            assert len(after) == len(before) and not any(any(c) for c in K.repeated_cover([r.text for r in after], 50))
        if name == "curriculum_mix":
            texts = Counter((r.doc_id, r.text) for r in after)
            assert set(texts) <= {(r.doc_id, r.text) for r in before} and max(texts.values()) <= 3
        if name == "bpe_encode":
            assert Counter((r.doc_id, r.decoded) for r in after) == Counter((r.doc_id, r.text or "") for r in before)
        before = after


def test_run(spark, tmp_path):
    rows = spark.createDataFrame(K.documents(30), K.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert not pipeline.run(spark, str(tmp_path)).isEmpty()
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").isEmpty()


def test_clashing_columns_come_out_unchanged(spark, tmp_path):
    """Every stage but the last returns the columns of its input, whatever their names, as they were; long texts pass."""
    rows = [(i, t, lang, source, n, 0.5, "x", i, i, "p", [i or 0]) for i, t, lang, source, n, *_ in K.documents(40)]
    rows.append((900, "many words of one long text " * 400_000, "en", "s1", 7, None, None, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _row long, _copy long, _position string, component_id array<long>"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    extra = lambda r: (r.doc_id, r.n_chars, r.score, r.lang_pred, r._row, r._copy, r._position, tuple(r.component_id or ()))
    was = {extra(r) for r in docs.collect()}
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            docs = spark.read.parquet(f"{tmp_path}/{i}")
            assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")] and {extra(r) for r in docs.collect()} <= was
    assert spark.read.parquet(f"{tmp_path}/{i}").where("doc_id = 900").count() >= 1
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).isEmpty()


def test_language_stage_keeps_what_is_near_a_profile(spark):
    """The threshold: texts far from every profile go, whatever their label."""
    rows = [(i, "the house of the street under the whole " * 20, "en") for i in range(8)] + [(8, "zqxj vkqz jxqv zzqx " * 30, None), (9, "123 456", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.language(spark, docs, "").collect()) == list(range(8))
