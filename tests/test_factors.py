"""Factors and window functions against pandas."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S
from tidepanel.functions.windows import avg_rank, pct_rank, quantile_bucket
from tidepanel.operators import factors as X
from tidepanel.operators import research
from tidepanel.sources import panels as P


def wide(df, column: str) -> pd.DataFrame:
    out = df.select("date", "code", column).toPandas().pivot(index="date", columns="code", values=column)
    return out.astype(float)


def close_to(a: pd.DataFrame, b: pd.DataFrame) -> None:
    # a division by 0 is null here
    np.testing.assert_allclose(a.to_numpy(float), b.replace([np.inf, -np.inf], np.nan).to_numpy(float), rtol=1e-8, atol=1e-10)


@pytest.fixture(scope="module")
def dense(panel):
    return X.with_factors(P.dense(P.rolling_base(panel)), ["mom20", "vol20", "ma_cross5_20", "mdd20", "sharpe20", "sortino20", "mom_accel", "nav_stability"]).cache()


def test_against_pandas(bars, dense):
    c = bars.pivot(index="date", columns="code", values="close")
    r = c.pct_change(fill_method=None)
    close_to(wide(dense, "mom20"), c.pct_change(20, fill_method=None))
    close_to(wide(dense, "vol20"), r.rolling(20).std())
    close_to(wide(dense, "ma_cross5_20"), c.rolling(5).mean() / c.rolling(20).mean() - 1)
    close_to(wide(dense, "mdd20"), c / c.rolling(20, min_periods=1).max() - 1)
    close_to(wide(dense, "sharpe20"), r.rolling(20).mean() / r.rolling(20).std())
    close_to(wide(dense, "sortino20"), r.rolling(20).mean() / r.clip(upper=0).rolling(20).std())
    close_to(wide(dense, "mom_accel"), c.pct_change(20, fill_method=None) - c.pct_change(60, fill_method=None))
    x = np.arange(60)
    close_to(wide(dense, "nav_stability"), c.rolling(60).apply(lambda y: np.corrcoef(x, y)[0, 1] ** 2, raw=True))
    am20 = bars.assign(m=bars.groupby("code").amount.transform(lambda x: x.rolling(20, min_periods=15).mean()))  # over the bars that a code has
    close_to(wide(dense, "am20"), am20.pivot(index="date", columns="code", values="m"))


def test_ranges_and_stops(bars, dense):
    rows = X.chandelier(X.with_adx(dense)).where("code <> '688163'")  # whose ranges over gaps pandas and SQL see differently
    bars = bars[bars.code != "688163"]
    h, l, c = (bars.pivot(index="date", columns="code", values=v) for v in ("high", "low", "close"))
    tr = np.maximum(h - l, np.maximum((h - c.shift()).abs(), (l - c.shift()).abs())).where(c.shift().notna(), h - l)
    close_to(wide(rows, "atr"), tr.rolling(14).mean())
    close_to(wide(rows, "stop"), h.rolling(22).max() - 3 * tr.rolling(22).mean())
    adx = wide(rows, "adx").to_numpy()
    assert ((adx[~np.isnan(adx)] >= 0) & (adx[~np.isnan(adx)] <= 100)).all()


def test_ranks_and_buckets(spark):
    x = [3.0, 1.0, 2.0, 2.0, None, 5.0, 4.0, 4.0, 4.0, 9.0, 7.0]
    df = spark.createDataFrame([("d", f"{i:02d}", v) for i, v in enumerate(x)], "date string, code string, x double")
    got = df.select("code", avg_rank("x").alias("r"), pct_rank("x").alias("p"), quantile_bucket("x", 4).alias("b")).orderBy("code").toPandas()
    s = pd.Series(x, dtype=float)
    np.testing.assert_allclose(got.r.astype(float), s.rank())
    np.testing.assert_allclose(got.p.astype(float), s.rank(pct=True))
    np.testing.assert_allclose(got.b.astype(float), pd.qcut(s.rank(method="first"), 4, labels=False))


def test_names():
    with pytest.raises(ValueError):
        X.ma_cross_by_name("ma_cross20_5")
    with pytest.raises(ValueError):
        X.ma_cross_by_name("nothing")


def test_adjustment_and_gaps(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 10.0, 1.0), ("a", "2024-01-02", 12.0, 2.0), ("b", "2024-01-02", 5.0, 1.0)], "code string, date string, close double, adj_factor double").withColumn("date", F.to_date("date"))
    q = {(r.code, str(r.date)): r.close for r in P.adjusted(rows, "qfq", prices=("close",)).collect()}
    assert q[("a", "2024-01-01")] == 5.0 and q[("a", "2024-01-02")] == 12.0
    assert P.adjusted(rows, "hfq", prices=("close",)).where("code = 'a' and close = 24").count() == 1
    with pytest.raises(ValueError):
        P.adjusted(rows, "other")
    d = P.dense(rows.select("code", "date", "close"))
    assert d.count() == 4 and d.where("close is null").count() == 1


def test_neutral_and_composite(spark):
    rows = spark.createDataFrame([("d", "a", 1.0, "x"), ("d", "b", 3.0, "x"), ("d", "c", 7.0, "y")], "date string, code string, score double, industry string")
    assert [r.v for r in rows.select("code", X.industry_neutral().alias("v")).orderBy("code").collect()] == [-1.0, 1.0, 0.0]
    up = {r.code: r.v for r in rows.select("code", X.composite({"score": 1.0}).alias("v")).collect()}
    down = {r.code: r.v for r in rows.select("code", X.composite({"score": 1.0}, {"score": True}).alias("v")).collect()}
    assert all(abs(up[c] + down[c] - 1) < 1e-12 for c in up)


def test_limit_flags(spark):
    """Each board's limit, and one-price boards by open and close alone."""
    moves = {"600001": 1.10, "300001": 1.10, "301002": 1.20, "688003": 1.20, "510300": 1.50, "159915": 1.10, "830001": 1.20, "430002": 1.30, "920003": 1.30, "000004": 0.90, "302001": 1.10}
    rows = [(c, "2024-01-01", 10.0, 10.0, 10.0) for c in moves] + [(c, "2024-01-02", 10.0 * x if i % 2 else 10.0, 10.0 * x, 10.0 * x) for i, (c, x) in enumerate(moves.items())]
    got = X.limit_flags(spark.createDataFrame(rows, "code string, date string, open double, close double, high double")).where("date > '2024-01-01'").collect()
    assert {r.code for r in got if r.limit_up} == {"600001", "301002", "688003", "430002", "920003", "302001"} and {r.code for r in got if r.limit_down} == {"000004"}
    odd = {c for i, c in enumerate(moves) if i % 2}
    assert {r.code for r in got if r.one_price_up} == {r.code for r in got if r.limit_up} & odd and {r.code for r in got if r.one_price_down} == {"000004"} & odd


def test_labels_rank_what_they_show(spark):
    """Returns that round to the same label tie, and ties go to the smaller code; halves are rounded as DuckDB does."""
    close = {"a": 1.1 + 3e-12, "b": 1.1, "c": 1.05}  # from 1.0
    rows = spark.createDataFrame([(d, c, 1.0 if d == 0 else x) for c, x in close.items() for d in (0, 1)], "date int, code string, close double")
    found = lambda digits: [(r.code, r.rank_1) for r in research.with_labels(rows, (1,), digits).where("ret_1 is not null").orderBy("rank_1").collect()]
    assert found(10) == [("c", 1), ("a", 2), ("b", 3)] and found(None) == [("c", 1), ("b", 2), ("a", 3)]
    x = [0.5, -0.5, 1.5, 2.675, -1e-12, 0.1234567890499999, 1.00000000005, 3e11, -7.25, 0.0]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(S.round_half_away(F.col("x"), 10)).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 10) + 0.0", [v]).fetchone()[0] for v in x]
    assert got == want
