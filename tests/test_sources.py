"""Joins, the SQL endpoint, sinks, streams, and the entry points."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.operators import joins
from tidepanel.sources import catalog, sinks
from tidepanel.streaming import incremental


def test_asof(spark):
    panel = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 11.0), ("a", 9, 12.0), ("b", 5, 1.0)], "code string, date int, close double")
    events = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 7, None), ("c", 1, 3.0)], "code string, ann_date int, eps double")
    got = {(r.code, r.date): r.eps for r in joins.asof(panel, events, ["eps"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 2.0, ("a", 9): 2.0, ("b", 5): None}  # a null statement replaces nothing


def test_differences(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "code string, v double")
    new = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("d", 4.0), ("c", None)], "code string, v double")
    assert {r.code for r in joins.anchor_diff(old, new, "code", "v").collect()} == {"b", "d"}
    assert joins.anti_upsert(old, new, ["code"]).count() == 4


def test_endpoint(spark):
    spark.range(3000).createOrReplaceTempView("numbers")
    assert catalog.query(spark, "select * from numbers").count() == 1000
    assert catalog.query(spark, "with x as (select 1 as v) select v from x;").first().v == 1
    assert catalog.query(spark, "select ';drop table x' as v").count() == 1
    for bad in ("drop table numbers", "select 1; select 2", "insert into numbers select 1", "with x as (select 1) insert into numbers select * from x"):
        with pytest.raises(catalog.NotReadOnly):
            catalog.query(spark, bad)


def test_scalars(spark):
    row = spark.sql("select '12' a, '1234567' b, '1.50%' p, 'x' q, ' ' e").select(S.zero_filled(F.col("a")), S.zero_filled(F.col("b")), S.percent(F.col("p")), S.percent(F.col("q")), S.number(F.col("q")), S.market_suffix(F.lit("600000"))).first()
    assert tuple(row) == ("000012", "1234567", 0.015, None, None, "600000.SH")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.merge_into(rows, f"{tmp_path}/t", ["k"])
    sinks.merge_into(spark.createDataFrame([(2, "c")], "k int, v string"), f"{tmp_path}/t", ["k"])
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "a"), (2, "c")}
    sinks.write_meta({"n": 1}, f"{tmp_path}/meta.json")
    assert "| 1 | a |" in sinks.report("t", {"x": rows.orderBy("k")})


def test_streams(spark, tmp_path, panel):
    from tidepanel.sources.panels import rolling_base

    panel.select("code", "date", "turnover", "amount").coalesce(1).write.parquet(f"{tmp_path}/bars")
    stream = spark.readStream.schema(incremental.BARS).parquet(f"{tmp_path}/bars")
    got = incremental.run_to_memory(spark, incremental.rolling_base_stream(stream), "rolled")
    both = got.join(rolling_base(panel).select("code", "date", F.col("am20").alias("want")), ["code", "date"])
    assert both.where("abs(am20 - want) > 1e-3 or (am20 is null) != (want is null)").isEmpty() and both.count() == panel.count()
    q = incremental.upsert_stream(spark.readStream.schema(incremental.BARS).parquet(f"{tmp_path}/bars"), f"{tmp_path}/merged", ["code", "date"], f"{tmp_path}/cp")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/merged").count() == panel.count()


def test_entry_points():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and "weight_nav" in queries and len(queries) >= 80


def test_swaps_survive_a_crash(spark, tmp_path):
    """Whatever moment a swap stops at, the old or the new table is there afterwards."""
    import os

    path, rows = f"{tmp_path}/t", lambda n: spark.range(n).coalesce(1)
    sinks.swap(rows(3), path)
    sinks.swap(rows(4), path)
    assert spark.read.parquet(path).count() == 4 and not os.path.exists(f"{path}.old")
    rows(5).write.parquet(f"{path}.new")
    os.rename(path, f"{path}.old")  # a crash between the two renames
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 5
    os.rename(path, f"{path}.old2")
    sinks.recover(spark, path)  # only the old one is left
    assert spark.read.parquet(path).count() == 4


def test_first_and_last_rows_are_certain(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 1)], "k int, v string, o int").repartition(3)
    none = rows.limit(0)
    from tidepanel.operators import books

    assert [tuple(r) for r in books.insert_once(none, rows, ["k"]).collect()] == [(1, "a", 2)]
    assert [tuple(r) for r in books.insert_once(none, rows, ["k"], ["o"]).collect()] == [(1, "c", 1)]
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, v string, o int").parquet(f"{tmp_path}/in")
    incremental.upsert_stream(stream, f"{tmp_path}/out", ["k"], f"{tmp_path}/cp", ["o"]).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "b", 2)]


def test_funds_and_rules(spark):
    from tidepanel.operators import funds

    rows = [("1", "成长混合", "混合型-偏股"), ("1", "成长混合", "混合型-偏股"), ("2", "债券A", "债券型"), ("3", "科技ETF", "指数型"), ("4", None, "股票型"), ("5", "消费", None), ("6", "消费QDII", "QDII-股票")]
    table = spark.createDataFrame(rows, "code string, name string, type string")
    assert sorted(r.code for r in funds.fund_universe(table).collect()) == ["1", "4", "6"]
    assert [r.code for r in funds.fund_universe(table, keywords=["消费"]).collect()] == ["6"]
    fees = spark.createDataFrame([("1", 2, "大于等于7天，小于30天", 0.0075), ("1", 1, "小于7天", 0.015), ("1", 3, "大于等于30天", None), ("1", 4, " ", 0.1)], "code string, seq int, period string, rate double")
    got = funds.redemption_rules(fees).first().rules
    assert got == '[{"period":"小于7天","rate":0.015,"max_days_exclusive":7},{"period":"大于等于7天，小于30天","rate":0.0075,"min_days":7,"max_days_exclusive":30}]'


def test_stored_tables_follow_their_files(spark, tmp_path):
    from tidepanel.sources.store import precomputed

    path = f"{tmp_path}/x"
    spark.range(5).write.parquet(path)
    built = []
    count = lambda: precomputed(spark.read.parquet(path), "n", lambda df: built.append(1) or df.selectExpr("id * 2 as id")).count()
    assert (count(), count(), len(built)) == (5, 5, 1)
    spark.range(7).write.mode("overwrite").parquet(path)
    assert (count(), len(built)) == (7, 2)
