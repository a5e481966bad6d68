"""Selection, execution, backtests, ledgers, risk."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.scalars import REDEMPTION_TIERS
from tidepanel.operators import books, evaluate, factors, ledger, selection
from tidepanel.operators import execution as E
from tidepanel.operators import portfolio as R
from tidepanel.plans import backtest, sweeps
from tidepanel.sources import panels as P


def scores(spark, values, industry=None):
    return spark.createDataFrame([("d", str(i), v, (industry or "?" * len(values))[i]) for i, v in enumerate(values)], "date string, code string, score double, industry string")


def test_selection(spark):
    pick = lambda df: [r.code for r in df.orderBy("rank").collect()]
    four = scores(spark, [0.2, 0.9, 0.3, 0.1])
    assert pick(selection.rank_select(four, 2)) == ["1", "2"]
    assert pick(selection.rank_select(four, top_pct=0.5)) == ["1", "2"]
    capped = selection.equal_weights(selection.rank_select(scores(spark, [0.9, 0.8, 0.7], "xxy"), 2, industry_cap=1))
    assert [(r.code, r.weight) for r in capped.orderBy("rank").collect()] == [("0", 0.5), ("2", 0.5)]
    tied = scores(spark, [1.0, 1.0, 1.0])
    assert pick(selection.rank_select(tied, 1)) == ["2"] and pick(selection.rank_select(tied, 1, ascending=True)) == ["0"]
    assert pick(selection.latest_signals(four, 1, compat=True)) == ["3"]
    legs = selection.long_short_legs(four, 1, 1)
    assert {(r.code, r.side) for r in legs.collect()} == {("1", 1), ("3", -1)}
    assert {(r.code, r.side) for r in selection.long_short_legs(four, 1, 1, compat=True).collect()} == {("1", 1), ("2", -1)}
    assert selection.long_short_legs(four, 3, 2).isEmpty()


def quotes():
    return {c: E.Quote(open=o, close=o, am20=1e6, turnover=1.0) for c, o in (("a", 10.0), ("b", 20.0))}


def test_execution():
    p = E.Profile(buy_cost=0.001, sell_cost=0.002)
    book = E.Book(0.0, {"a": 300})
    assert book.rebalance({"b": 1.0}, 6000.0, p, quotes()) == (["a"], ["b"])
    assert book.positions == {"b": 100} and book.cash > 0 and [f.side for f in book.fills] == ["sell", "buy"]
    book, q = E.Book(10_000.0), quotes()
    q["b"].limit_up = True
    assert book.rebalance({"b": 1.0}, 10_000.0, p, q) == ([], []) and book.rejections == [("b", "buy", E.LIMIT_UP)]
    etf = E.Book(1000.0)
    etf.rebalance({"510300": 1.0}, 1000.0, E.profile("etf", spread_bps=0.0, min_commission=0.0), {"510300": E.Quote(open=4.0, am20=1e6, turnover=1.0)})
    assert etf.positions == {"510300": 200}
    assert E.commission(10_000, 0.0003, 5.0) == 5.0 and E.commission(100_000, 0.0003, 5.0) == pytest.approx(30.0)
    with pytest.raises(ValueError):
        E.profile("house")


def test_held_names_are_bought_again():
    p, book = E.Profile(buy_cost=0.0), E.Book(10_000.0, {"a": 100})
    book.rebalance({"a": 0.5}, 11_000.0, p, quotes())
    assert book.positions["a"] == 600  # the whole budget again, on top of what was there


def test_orders_and_stops():
    p, book = E.Profile(), E.Book(100_000.0)
    assert book.order("a", 1000, p, E.Quote(open=10.0)) and book.positions == {"a": 1000}
    assert not book.order("a", 2000, p, E.Quote(open=10.0), limit=9.0)
    assert book.order("a", -500, p, E.Quote(open=10.0)) and book.positions == {"a": -500}
    flat = E.Book(0.0, {"a": 100})
    assert not flat.order("a", -100, p, E.Quote(open=10.0), allow_short=False) or flat.positions.get("a", 0) >= 0
    held = E.Book(0.0, {"a": 100, "b": 100})
    assert held.stop_out(p, {"a": E.Quote(close=9.0, stop=10.0), "b": E.Quote(close=11.0, stop=10.0)}, quotes()) == ["a"]


def test_funds_and_tiers():
    book = E.FundBook(10_000.0, 0.0015, {"000001": "A", "000002": "C"})
    a, c = book.subscribe("000001", 1000.0, 1.0, 0), book.subscribe("000002", 1000.0, 1.0, 0)
    assert a == 998.5 and c == 1000.0
    assert [E.redemption_fee_rate(d) for d in (0, 6, 7, 29, 30, 364, 365)] == [0.015, 0.015, 0.0075, 0.0075, 0.005, 0.005, 0.0]
    book.subscribe("000002", 500.0, 1.0, 20)
    assert book.redeem("000002", 1200.0, 1.0, 30) == pytest.approx(1000 * 0.005 + 200 * 0.0075)
    assert book.shares("000002") == 300.0 and REDEMPTION_TIERS[0] == (7, 0.015)


@pytest.fixture(scope="module")
def prepared(panel):
    rows = factors.open_to_open(factors.with_factors(P.dense(P.rolling_base(panel)), ["mom20"]).withColumn("score", F.col("mom20"))).cache()
    cal = selection.rebalance_days(P.calendar(panel))
    days = cal.where("is_exec").select(F.col("t_idx").alias("x"))
    chosen = selection.equal_weights(selection.rank_select(rows, 2)).withColumn("x", F.col("t_idx") + 1).join(days, "x", "left_semi")
    return rows, chosen.select(F.col("x").alias("t_idx"), "code", "weight").cache()


def test_weight_nav_equals_the_loop(prepared):
    rows, targets = prepared
    got = [r.nav for r in backtest.weight_nav(rows, targets).orderBy("t_idx").collect()]
    wide = rows.toPandas().pivot(index="t_idx", columns="code", values="open")
    by: dict[int, dict[str, float]] = {}
    for r in targets.collect():
        by.setdefault(r.t_idx, {})[r.code] = r.weight
    want = backtest.weight_loop({c: wide[c].tolist() for c in wide}, by, len(wide))
    np.testing.assert_allclose(got, want, rtol=1e-10)
    assert got[0] == 1.0


def test_stuck_names_stay():
    nav = backtest.weight_loop({"a": [1.0, 1.0, None, 2.0], "b": [1.0, 1.0, 1.0, 1.0]}, {1: {"a": 1.0}, 2: {"b": 1.0}}, 4, 0.0, 0.0)
    assert nav[-1] == pytest.approx(2.0)  # a has no open on day 2, so it isn't sold


def test_cash_backtest_conserves_money(spark, prepared):
    rows, targets = prepared
    q = rows.join(targets.withColumnRenamed("weight", "target"), ["t_idx", "code"], "left").select("t_idx", "date", "code", "open", "close", "am20", "turnover", F.lit(False).alias("limit_up"), F.lit(False).alias("limit_down"), F.lit(None).cast("double").alias("stop"), "target", F.lit(0.0).alias("cut"))
    out = backtest.run_scenarios(q, sweeps.scenario_table(spark, {"free": {"capital": 1e6, "costs": {"buy_cost": 0.0, "sell_cost": 0.0}}, "stock": {"capital": 1e6}})).toPandas()
    last = {k: g.sort_values("date").iloc[-1] for k, g in out.groupby("scenario_id")}
    assert last["stock"].nav < last["free"].nav and (out.cash > -1000).all() and out.groupby("scenario_id").nav.first().between(0.95, 1.05).all()
    events = backtest.run_scenarios(q, sweeps.scenario_table(spark, {n: {"strategy": n, "capital": 1e6, "top_n": 1, "window": 10} for n in backtest.STRATEGIES}), backtest.event_backtest).toPandas()
    assert events.nav.notna().all() and set(events.scenario_id) == set(backtest.STRATEGIES)


def test_metrics_and_ic(spark):
    nav = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 1.1, 0.99, 1.2])], "s int, date int, nav double")
    m = evaluate.nav_metrics(nav, ["s"]).first()
    r = np.diff([1.0, 1.1, 0.99, 1.2]) / np.array([1.0, 1.1, 0.99])
    assert m.total == pytest.approx(0.2) and m.max_drawdown == pytest.approx(-0.1) and m.win_rate == pytest.approx(2 / 3)
    assert m.sharpe == pytest.approx(r.mean() * 244 / (r.std(ddof=1) * np.sqrt(244))) and m.annual == pytest.approx(1.2 ** (244 / 3) - 1)
    assert evaluate.nav_metrics(nav.limit(1), ["s"]).first().total is None
    rng = np.random.default_rng(0)
    x = pd.DataFrame({"date": "d", "code": [f"{i:02d}" for i in range(30)], "factor": rng.normal(size=30), "fwd": rng.normal(size=30)})
    ic = evaluate.rank_ic(spark.createDataFrame(x)).first().ic
    assert ic == pytest.approx(np.corrcoef(x.factor.rank(), x.fwd.rank())[0, 1])
    assert evaluate.rank_ic(spark.createDataFrame(x.assign(factor=1.0))).isEmpty()


def test_ledger(spark):
    d = lambda df: df.withColumn("date", F.to_date("date"))
    prices = d(spark.createDataFrame([("2026-02-02", "x", 5.65), ("2026-03-02", "x", 6.55)], "date string, code string, close double"))
    trades = d(spark.createDataFrame([("2026-02-02", "x", "buy", 800.0, 6.10, 4.0, 1), ("2026-03-02", "x", "sell", 300.0, 6.55, 2.5, 2)], "date string, code string, action string, shares double, price double, fee double, seq int"))
    deposits = d(spark.createDataFrame([("2026-02-02", 5000.0)], "date string, amount double"))
    first = ledger.ledger_equity(prices, trades, deposits).orderBy("date").first()
    assert first.cash == pytest.approx(116.0) and first.market_value == pytest.approx(4520.0)
    left = ledger.ledger_positions(trades).first()
    assert left.shares == 500 and left.cost == pytest.approx(3050.0)
    assert [(r.shares) for r in ledger.fifo_matches(trades).collect()] == [300.0]


def test_risk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [1, 2, 3, 4]
    cov = R.shrunk(x)
    w = R.risk_parity(cov)
    shares = R.risk_shares(w, cov)
    np.testing.assert_allclose(shares, 0.25, atol=1e-6)
    assert np.isclose(w.sum(), 1) and (np.linalg.eigvalsh(R.shrunk(x, "ledoit_wolf")) > 0).all()
    best = R.max_diversification(np.diag([1.0, 4.0, 9.0]))
    np.testing.assert_allclose(best, np.array([1, 1 / 2, 1 / 3]) / (11 / 6), atol=1e-3)
    assert R.mean_variance(np.array([1.0, 0.0]), np.eye(2), 0.01)[0] > 0.99
    assert set(R.weights_from_returns(x, list("abcd"), "risk_parity", 0.5)) == set("abcd")
    np.testing.assert_allclose(R.projected(np.array([-1.0, 3.0, 1.0]), 0.6), [0, 0.6 / 0.85, 0.25 / 0.85])


def test_risk_parity_of_many_codes(spark):
    """More codes than dates: the weights of the matrix's method run to its end, equal shares of risk, and no matrix of all pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 60)) * np.linspace(0.01, 2, 60) + rng.normal(size=(20, 1))
    w = R.risk_parity_of_returns(x)
    np.testing.assert_allclose(w, R.risk_parity(R.shrunk(x), 20_000), rtol=1e-7)
    np.testing.assert_allclose(R.risk_shares(w, R.shrunk(x)), 1 / 60, rtol=1e-7)
    flat = np.where(np.arange(60) % 7 == 0, 0.0, x)  # prices that never move
    np.testing.assert_allclose(R.risk_parity_of_returns(flat), R.risk_parity(R.shrunk(flat), 20_000), rtol=1e-6)
    many = rng.normal(size=(10, 4000))
    tracemalloc.start()
    try:
        found = R.weights_from_returns(many, list(range(4000)))
        assert len(found) == 4000 and tracemalloc.get_traced_memory()[1] < 20e6  # the matrix has 128 MB
    finally:
        tracemalloc.stop()
    rows = [("y", d, c, r) for d, day in enumerate([[0.1, -0.2, 0.3], [0.2, 0.1, None], [0.0, 0.3, -0.1], [-0.1, 0.0, 0.2]]) for c, r in zip("abc", day)]
    got = {r.code: r.weight for r in R.optimised_weights(spark.createDataFrame([*rows, ("z", 0, "a", 0.1), ("y", 1, "n", None)], "by string, date int, code string, ret double"), "by", "risk_parity").collect()}
    want = R.weights_from_returns(np.array([[r for *_, r in rows[i : i + 3]] for i in (0, 6, 9)]), list("abc"))  # complete dates only, and no group of one date
    assert got == {c: pytest.approx(v) for c, v in want.items()}


def test_neutralised(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=40)
    pdf = pd.DataFrame({"date": pd.Timestamp("2024-01-01").date(), "code": [f"{i:02d}" for i in range(40)], "z": z, "score": 2 * z + 1})
    got = R.neutralised(spark.createDataFrame(pdf), "score", ["z"]).toPandas()
    assert np.abs(got.score).max() < 1e-9
    holes = pdf.assign(z=np.where(np.arange(40) == 3, np.nan, z), score=np.where(np.arange(40) == 5, np.nan, pdf.score))
    rows = spark.createDataFrame(holes).selectExpr("date", "code", "nanvl(z, null) z", "nanvl(score, null) score")
    found = R.neutralised(rows, "score", ["z"]).where("score is null").collect()
    assert {r.code for r in found} == {"03", "05"} and R.neutralised(rows.where("code < '04'"), "score", ["z"]).where("score is not null").isEmpty()


def test_risk_by_factor(spark):
    """Shares sum to one, and a market of one factor has them all."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8, 2))
    shares = R.factor_shares(np.full(8, 1 / 8), x, np.eye(2), np.full(8, 0.5), ["a", "b"])
    b = np.where(np.isfinite(x), x, 0).mean(axis=0).T @ np.full(8, 1 / 8)
    assert sum(shares.values()) == pytest.approx(1) and shares["specific"] == pytest.approx(0.5 / 8 / (b @ b + 0.5 / 8))
    assert R.factor_shares(np.zeros(8), x, np.eye(2), np.zeros(8), ["a", "b"]) == {"a": 0.0, "b": 0.0, "specific": 1.0}
    pdf = pd.DataFrame([("y", d, f"{c:02d}", float(m), float(e)) for d, m in enumerate(rng.normal(size=40)) for c, e in enumerate(rng.normal(size=12))], columns=["y", "date", "code", "ret", "e"])
    got = {r.factor: r.share for r in R.attributed_risk(spark.createDataFrame(pdf), "y", "ret", ["e"]).collect()}
    assert got["market"] > 0.99 and sum(got.values()) == pytest.approx(1)


def test_books(spark):
    assert len(books.registry()) == 31 and len(books.applicable("fund")) == 12 and len(books.FACTOR_CATALOG) == 22
    assert books.rebalance_due(None, "2024-01-05", "monthly") and not books.rebalance_due("2024-01-01", "2024-01-05", "weekly") and books.rebalance_due("2024-01-31", "2024-02-01", "monthly")
    assert books.rebalance_due("2024-01-31", "2024-03-01", "semiannual") and not books.rebalance_due("2024-03-01", "2024-03-29", "semiannual") and not books.rebalance_due("2024-03-01", "2024-04-01", "semiannual")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, books.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, books.insert_once(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sweeps.split_windows(list(range(10)), 3) == [(0, 2), (3, 5), (6, 9)]
