"""Registered queries over every row of small tables, against plain loops."""

from __future__ import annotations

import json
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.execution import Book, Quote
from tidepanel.operators.portfolio import weights_from_returns
from tidepanel.plans import backtest, reach, sweeps
from tidepanel.plans import more_queries as M
from tidepanel.plans import queries as Q

SUPPLIERS, WEEKS = 12, 60


@pytest.fixture(scope="module")
def lines() -> pd.DataFrame:
    """Twelve suppliers' lines on Tuesdays of sixty weeks, one order each."""
    rng = np.random.default_rng(5)
    n = SUPPLIERS * WEEKS * 2
    code, week = np.tile(np.arange(1, SUPPLIERS + 1), WEEKS * 2), np.repeat(np.arange(WEEKS * 2) % WEEKS, SUPPLIERS)
    shares = rng.integers(1, 50, n).astype(float)
    price = np.round((20 + code) * np.exp(0.1 * np.sin(week / 4 + code) + rng.normal(0, 0.02, n)), 2)
    return pd.DataFrame(
        {
            "l_orderkey": np.arange(1, n + 1), "l_partkey": 1, "l_suppkey": code, "l_linenumber": np.int32(1), "l_quantity": shares, "l_extendedprice": np.round(shares * price, 2), "l_discount": 0.0,
            "l_tax": 0.05, "l_returnflag": np.where(rng.random(n) < 0.4, "R", "N"), "l_linestatus": "O", "l_shipdate": (pd.Timestamp("1995-01-03") + pd.to_timedelta(week * 7, "D")).astype("datetime64[us]"),
        }
    )


@pytest.fixture(scope="module")
def folder(lines, tmp_path_factory) -> str:
    at = tmp_path_factory.mktemp("tables")
    lines.to_parquet(at / "lineitem.parquet")
    orders = pd.DataFrame({"o_orderkey": np.arange(1, 41), "o_custkey": np.arange(1, 41), "o_orderstatus": "O", "o_totalprice": np.arange(1, 41) * 100.0, "o_orderdate": pd.Timestamp("1995-01-03").as_unit("us"), "o_orderpriority": "1"})
    orders.to_parquet(at / "orders.parquet")
    return str(at)


def ordered(lines: pd.DataFrame):
    """(code, week, shares bought or sold, price, tax) in the order of trading."""
    for r in lines.sort_values(["l_shipdate", "l_orderkey"]).itertuples():
        yield f"{r.l_suppkey:06d}", (r.l_shipdate - pd.Timedelta(days=r.l_shipdate.weekday())).date(), r.l_quantity * (-1 if r.l_returnflag == "R" else 1), r.l_extendedprice / r.l_quantity, r.l_tax


# ---------------------------------------------------------------- ledgers
def test_ledgers_hold_every_trade(spark, lines, folder):
    held, cost, lots, owed, taken = defaultdict(float), defaultdict(float), defaultdict(deque), defaultdict(deque), defaultdict(float)
    cash, step = defaultdict(float), defaultdict(float)
    for code, week, n, price, tax in ordered(lines):
        cash[week] -= n * price + tax
        step[week, code] += n
        if n > 0:
            held[code], cost[code] = held[code] + n, cost[code] + n * price
            lots[code].append([week, n])
        else:
            sold = min(-n, held[code])
            cost[code] *= 1 - sold / held[code] if held[code] else 0.0
            held[code] -= sold
            owed[code].append([week, -n])
    for code in lots:  # running sums of purchases and sales, wherever they lie in time
        while lots[code] and owed[code]:
            (bought, x), (left, y) = lots[code][0], owed[code][0]
            n = min(x, y)
            taken[code, bought, left] += n
            for queue in (lots[code], owed[code]):
                queue[0][1] -= n
                if not queue[0][1]:
                    queue.popleft()
    got = {r.code: (r.shares, r.cost) for r in Q.ledger_positions(spark, folder).collect()}
    assert got == {c: (n, pytest.approx(cost[c], abs=1e-3)) for c, n in held.items() if n > 1e-9} and len({c for c, *_ in ordered(lines)}) == SUPPLIERS
    assert {(r.code, r.buy_date, r.sell_date): r.shares for r in Q.fifo_redeem(spark, folder).collect()} == taken
    fees = defaultdict(float)
    for (code, bought, left), n in taken.items():
        d = (left - bought).days
        fees[code] += n * next((rate for below, rate in ((7, 0.015), (30, 0.0075), (365, 0.005)) if d < below), 0.0)
    assert {r.code: r.fee for r in Q.fee_tiers(spark, folder).collect()} == {c: pytest.approx(x, abs=1e-5) for c, x in fees.items()}
    paid = sum(k * 100.0 for k in range(1, 41))
    close = lines.sort_values(["l_shipdate", "l_orderkey"])
    equity = {r.date: r for r in Q.ledger_equity(spark, folder).collect()}
    money, shares = paid, defaultdict(float)
    last = {(f"{r.l_suppkey:06d}", (r.l_shipdate - pd.Timedelta(days=1)).date()): r.l_extendedprice / r.l_quantity for r in close.itertuples()}
    weekly = {(r.code, r.date): r.close for r in Q.week(spark, folder).select("code", "date", "close").collect()}
    assert set(weekly) == set(last)
    for week in sorted(cash):
        money += cash[week]
        for code in held:
            shares[code] += step[week, code]
        worth = sum(n * weekly[code, week] for code, n in shares.items())
        r = equity[week]
        assert (r.cash, r.market_value, r.pnl) == pytest.approx((money, worth, money + worth - paid), abs=0.01)


# ---------------------------------------------------------------- simulations
@pytest.fixture(scope="module")
def wide(tmp_path_factory) -> str:
    """120 suppliers by 60 weeks; the smaller the amounts, the steeper the rise, so that the best codes are the smallest."""
    rng, n = np.random.default_rng(6), 120
    code, week = np.tile(np.arange(1, n + 1), WEEKS), np.repeat(np.arange(WEEKS), n)
    price = 20 * np.exp(code / n * 0.02 * week + 0.2 * np.sin(week / 3 + code) + rng.normal(0, 0.01, n * WEEKS))
    shares = np.where((code > 100) & (week % 5 > 0), 2.0, 500.0 - code)
    at = tmp_path_factory.mktemp("wide")
    pd.DataFrame(
        {
            "l_orderkey": np.arange(1, n * WEEKS + 1), "l_partkey": 1, "l_suppkey": code, "l_linenumber": np.int32(1), "l_quantity": shares, "l_extendedprice": np.round(shares * price, 2), "l_discount": 0.0, "l_tax": 0.0,
            "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": (pd.Timestamp("1995-01-03") + pd.to_timedelta(week * 7, "D")).astype("datetime64[us]"),
        }
    ).to_parquet(at / "lineitem.parquet")
    return str(at)


def test_simulations_cover_every_code(spark, wide):
    """Every code has its quotes and every target is among them; the queries give what a plain run over all codes gives."""
    rows, chosen = Q.quotes(spark, wide).toPandas(), Q.targets(spark, wide)[1]
    assert rows.code.nunique() == 120 and rows.target.notna().sum() == chosen.count() > 0
    held = Q.quotes(spark, wide, True).toPandas()
    assert set(rows[rows.target > 0].code) <= set(held.code) and held.target.notna().sum() == rows.target.notna().sum() and held.date.nunique() == WEEKS
    runs = [
        (Q.cash_backtest, backtest.cash_backtest, {"stock": {"capital": 1e7}, "etf": {"capital": 1e7, "asset": "etf", "stops": True}}),
        (Q.fund_backtest, backtest.fund_backtest, {"fund": {"capital": 1e6}}),
        (Q.event_backtest, backtest.event_backtest, {"cross": {"strategy": "golden_cross", "short": 3, "long": 8, "capital": 1e7}, "momentum": {"strategy": "long_short_momentum", "window": 8, "capital": 1e7, "short_rate": 0.086}, "parity": {"strategy": "risk_parity", "window": 10, "capital": 1e7}}),
    ]
    for query, simulate, scenarios in runs:
        got = {(r.scenario_id, r.date): (r.nav, r.n_fills) for r in query(spark, wide).collect()}
        want = pd.concat([simulate(rows.assign(scenario_id=k, params=json.dumps(v))) for k, v in scenarios.items()])
        assert got == {(r.scenario_id, r.date): (pytest.approx(r.nav, abs=1e-5), r.n_fills) for r in want.itertuples()}
        assert want.n_fills.sum() > 0
    assert all(isinstance(n, float) for n in backtest._held(Book(0.0, {"a": 2**53 + 1})).values())  # Arrow takes no such whole number as a double


def test_risk_parity_weighs_every_code(spark, wide):
    """Every code has a weight in every year, equal to the optimiser's over the whole universe."""
    got = {(r.year, r.code): r.weight for r in Q.risk_parity(spark, wide).collect()}
    rows = Q.dense_week(spark, wide).select("date", "code", "close").toPandas().pivot(index="date", columns="code", values="close").ffill()
    rets, want = rows.pct_change(fill_method=None).fillna(0.0), {}
    for year, x in rets.groupby([d.year for d in rets.index]):
        want |= {(year, c): w for c, w in weights_from_returns(x.to_numpy(), list(x.columns)).items()}
    assert len(got) == 240 and got == {k: pytest.approx(w, abs=2e-6) for k, w in want.items()}


def _context(book: Book, closes: dict, day: str = "2024-01-08", **more) -> backtest.Context:
    """A context whose codes all trade, but what `more` says of them; the day is a Monday."""
    before = {c: Quote(open=x[-1], close=x[-1], am20=1e6, turnover=1.0) for c, x in closes.items()}
    today = {c: Quote(open=x[-1]) for c, x in closes.items()}
    for c, changes in more.items():
        for k, v in changes.items():
            setattr(before[c], k, v)
            setattr(today[c], k, v)
    return backtest.Context(book, closes, before, today, pd.Timestamp(day))


def test_golden_cross_takes_the_widest():
    """More crosses than places go to the widest, whatever their names; crosses downwards are left, and their place is free the day after."""
    up, down = [3.0, 3.0, 2.0, 1.0], [1.0, 1.0, 2.0, 3.0]
    x = {"a": [*up, 3.0], "b": [*up, 9.0], "c": [*up, 5.0], "d": [*up, 99.0], "h": [*down, 0.5], "s": [9.0, 9.0]}
    cross = backtest.GoldenCross()
    cross.init({"short": 1, "long": 3, "top_n": 2})
    ctx = _context(Book(1.0), x, d={"turnover": 0.0})
    cross.on_bar(ctx, 1)
    assert ctx.orders == {"b": ("percent", 0.5, None), "c": ("percent", 0.5, None)}
    ctx = _context(Book(1.0, {"h": 100}), x, d={"open": None}, c={"open": None})
    cross.on_bar(ctx, 1)
    assert ctx.orders == {"h": ("percent", 0.0, None), "b": ("percent", 0.5, None)}
    cross.init({"short": 1, "long": 3, "top_n": 1})
    ctx = _context(Book(1.0), x, d={"close": None})
    cross.on_bar(ctx, 1)
    assert ctx.orders == {"b": ("percent", 0.5, None)}  # one place, at most half of the value


def test_risk_parity_and_long_short_on_mondays():
    rng = np.random.default_rng(1)
    x = {c: (10 * np.exp(np.cumsum(rng.normal(0.001 * i, 0.01 * (i + 1), 30)))).tolist() for i, c in enumerate("abcdefgh")}
    parity = backtest.RiskParity()
    parity.init({"window": 20, "top_n": 3, "max_weight": 0.9})
    ctx = _context(Book(1.0, {"a": 100}), x, f={"am20": 9e6}, g={"am20": 8e6}, c={"am20": 7e6})
    parity.on_bar(ctx, 1)
    want = weights_from_returns(np.array([np.diff(x[c][-21:]) / np.array(x[c][-21:-1]) for c in "fgc"]).T, list("fgc"), "risk_parity", 0.9)
    assert {c: o[1] for c, o in ctx.orders.items()} == {"a": 0.0, **{c: pytest.approx(w) for c, w in want.items()}}
    pairs = backtest.LongShortMomentum()
    pairs.init({"window": 20, "long_n": 2, "short_n": 1})
    ctx = _context(Book(1.0, {"zz": 5, "a": 7}), x)
    pairs.on_bar(ctx, 1)
    order = sorted(x, key=lambda c: x[c][-1] / x[c][-21])
    want = {"zz": ("shares", 0, None), "a": ("shares", 0, None)} | {c: ("percent", 0.25, None) for c in order[-2:]} | {order[0]: ("percent", -0.5, None)}
    assert ctx.orders == want
    for strategy in (parity, pairs):
        ctx = _context(Book(1.0, {"a": 100}), x, day="2024-01-09")
        strategy.on_bar(ctx, 1)
        assert not ctx.orders
    ctx = _context(Book(1.0), x, a={"limit_up": True}, b={"limit_down": True}, c={"open": None})
    assert [ctx.can_buy(c) for c in "abcd"] == [False, True, False, True] and [ctx.can_sell(c) for c in "abcd"] == [True, False, False, True]


@pytest.fixture(scope="module")
def ragged(spark):
    """90 codes by 80 weeks with gaps, bars without turnover, equal prices and equal amounts."""
    rng = np.random.default_rng(8)
    close = np.round(np.exp(np.cumsum(rng.normal(0, 0.05, (80, 90)), axis=0)) * 10, 1)
    close[:, 60:] = close[:, :30]
    close[:, 30:33] = 10.1
    close[40:] *= np.where(np.arange(90) % 30 == 4, 1.5, 1.0)
    open_ = np.where(rng.random((80, 90)) < 0.9, close, np.nan)
    close = np.where(rng.random((80, 90)) < 0.9, close, np.nan)
    t, c = np.divmod(np.arange(80 * 90), 90)
    rows = pd.DataFrame({"t_idx": t, "date": [d.date() for d in pd.Timestamp("1995-01-02") + pd.to_timedelta(t * 7, "D")], "code": [f"{i * 17 % 1000:03d}" for i in c], "open": open_.ravel(), "close": close.ravel(), "am20": np.where(c % 4 > 0, c // 8 * 100.0, np.nan), "turnover": (rng.random(80 * 90) < 0.9) * 1.0, "limit_up": c % 11 == t % 5, "limit_down": False})
    return spark.createDataFrame(rows).cache(), rows


RUNS = {
    "cross": {"strategy": "golden_cross", "short": 2, "long": 5, "top_n": 2}, "wide": {"strategy": "golden_cross", "short": 5, "long": 3, "top_n": 3}, "fold": {"strategy": "golden_cross", "short": 2, "long": 5, "start": "1995-09-04", "end": "1996-02-05", "warmup": 70},
    "pairs": {"strategy": "long_short_momentum", "window": 4, "long_n": 2, "short_n": 3}, "parity": {"strategy": "risk_parity", "window": 6, "top_n": 4}, "late": {"strategy": "long_short_momentum", "window": 4, "start": "1996-01-01"},
}


def test_reach_changes_no_run(spark, ragged):
    """Runs over the codes in reach are those over all codes, trade by trade; a strategy that says nothing keeps all."""
    quotes, rows = ragged
    scenarios = sweeps.scenario_table(spark, RUNS)
    kept = backtest.reached(quotes, scenarios).cache()
    codes = {r.scenario_id: r.n for r in kept.where("code <> ''").groupBy("scenario_id").agg(F.count_distinct("code").alias("n")).collect()}
    assert set(codes) == set(RUNS) and codes["parity"] < 40 and codes["fold"] < 60  # of 90
    columns = ["scenario_id", "date", "nav", "cash", "fills", "rejections"]
    got = {tuple(r[:2]): tuple(r[2:]) for r in backtest.run_scenarios(kept, scenarios, backtest.event_backtest).select(*columns).collect()}
    want = {tuple(r[:2]): tuple(r[2:]) for r in backtest.run_scenarios(quotes, scenarios, backtest.event_backtest).select(*columns).collect()}
    assert got == want and all(any(v[2] for k, v in want.items() if k[0] == name) for name in RUNS)
    every = backtest.reached(quotes, scenarios.limit(1), backtest.EventStrategy).where("code <> ''")
    assert every.count() == len(rows)
    none = backtest.reached(quotes.where("date < '1995-01-20'"), scenarios)
    assert none.select("date").distinct().count() == 3 and none.where("code <> '' and scenario_id = 'cross'").isEmpty()  # days stay without any code


def test_reach_in_blocks(ragged, monkeypatch):
    """Small blocks of whole codes find all that one block finds; sums are those of sum()."""
    rows = ragged[1].sort_values(["code", "date"])[["code", "date", "t_idx", "open", "close", "am20", "turnover"]]
    table = pa.Table.from_pandas(rows, preserve_index=False)
    run = reach._finder([(k, backtest.STRATEGIES[v["strategy"]], v) for k, v in RUNS.items()], pa.schema([("scenario_id", pa.string()), ("kind", pa.int32()), ("t_idx", pa.int64()), ("score", pa.float64()), ("code", pa.string()), ("larger", pa.bool_()), ("places", pa.int32())]))
    found = lambda size: {tuple(r.values()) for b in run(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()}
    whole = found(1 << 20)
    monkeypatch.setattr(reach, "BLOCK", 100)
    assert whole and whole <= found(7)
    x = rows.close.dropna().to_numpy() / 3
    bars = reach.Bars(np.arange(len(x)), x, x, x > 0, x)
    assert all(bars.sums(n)[i] == sum(x[i - n + 1 : i + 1].tolist()) for n in (1, 3, 8) for i in range(n - 1, 300))


def test_price_limits_act(spark, wide):
    """Moves of the close by the board's limit (10 % here, less the slack) are flagged in the quotes."""
    rows = Q.quotes(spark, wide).toPandas().sort_values(["code", "date"])
    move = rows.groupby("code").close.pct_change(fill_method=None)
    assert (rows.limit_up == (move >= 0.095)).all() and (rows.limit_down == (move <= -0.095)).all() and rows.limit_up.any() and rows.limit_down.any()


# ---------------------------------------------------------------- sweeps
def test_heatmap_of_a_grid(spark, wide):
    """Each fold is a run of its own: capital whole at its start, prices before it for the averages only."""
    rows = Q.quotes(spark, wide).toPandas()
    days, want = sorted(set(rows.date)), {}
    for name, params in sweeps.cross_grid([3, 5], [8, 13], capital=1e7).items():
        totals = []
        for lo, hi in sweeps.split_windows(days, 4):
            cut = rows[rows.date <= hi]
            nav = backtest.event_backtest(cut.assign(scenario_id=name, params=json.dumps({**params, "start": str(lo)}))).set_index("date").nav
            assert nav.index.min() == lo and nav.index.max() == hi and nav.iloc[0] == pytest.approx(1.0, abs=0.2)
            totals.append(nav.iloc[-1] / nav.iloc[0] - 1)
        want[name] = np.mean(totals)
    got = {f"{r.short}x{c}": r[c] for r in Q.cross_heatmap(spark, wide).collect() for c in ("8", "13")}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()} and any(want.values())


SWEPT = [Q.cross_heatmap, Q.walk_forward, M.rolling_train_test]


@pytest.mark.parametrize("query", SWEPT)
def test_sweeps_hold_the_codes_in_reach(spark, wide, monkeypatch, query):
    """No fold's run gets all codes, and each gets all days."""
    seen, run = [], backtest.run_scenarios
    monkeypatch.setattr(sweeps, "run_scenarios", lambda quotes, *more: seen.append(quotes) or run(quotes, *more))
    assert query(spark, wide).count() > 0
    rows = seen[0].groupBy("scenario_id").agg(F.count_distinct("code").alias("codes"), F.count_distinct("date").alias("days")).collect()
    assert len(seen) == 1 and len(rows) == 16 and all(r.codes < 80 and r.days == WEEKS for r in rows)  # of 120


def test_trades_account_for_the_cash(spark, wide):
    """Fills explain every change of cash, holdings and cash the value, and refused orders have a reason."""
    runs, quotes = M._runs(spark, wide)
    runs = runs.cache()
    cash = {(r.scenario_id, r.date): (r.cash, r.nav) for r in runs.collect()}
    moved: dict = defaultdict(float)
    for r in backtest.fills(runs).collect():
        moved[r.scenario_id, r.date] += (-r.amount if r.side == "buy" else r.amount) - r.fee
    for name in ("stock", "etf"):
        now = 1e7
        for day in sorted(d for k, d in cash if k == name):
            now += moved[name, day]
            assert cash[name, day][0] == pytest.approx(now, abs=0.01)
    share: dict = defaultdict(float)
    worth: dict = defaultdict(float)
    for r in backtest.holdings(runs, quotes).collect():
        share[r.scenario_id, r.date] += r.weight
        worth[r.scenario_id, r.date] += r.shares * r.price
    assert worth and all(cash[k][1] * 1e7 == pytest.approx(cash[k][0] + v, abs=0.01) and share[k] == pytest.approx(v / (cash[k][0] + v)) for k, v in worth.items())
    assert all(r.reason for r in backtest.rejections(runs).collect())


def test_paper_runs_write_each_day_once(spark, wide):
    assert {tuple(r) for r in M.paper_run(spark, wide).collect()} == {("cash", True, 0), ("events", True, 0)}


def test_paper_runs_hold_the_codes_in_reach(spark, wide, monkeypatch):
    """No run of a paper account gets all codes, each gets all days up to its last."""
    seen, run = [], backtest.run_scenarios
    for module in (backtest, M.paper):
        monkeypatch.setattr(module, "run_scenarios", lambda quotes, *more: seen.append(quotes) or run(quotes, *more))
    M.paper_run(spark, wide)
    found = [q.agg(F.count_distinct("code"), F.count_distinct("date")).first() for q in seen]
    assert len(found) == 8 and all(n < 100 for n, _ in found) and [d for _, d in found] == [30, WEEKS, WEEKS, WEEKS] * 2  # of 120 codes


def test_rolling_choice(spark):
    rows = [("a", 0, 0.1, 1.0), ("b", 0, 0.2, 2.0), ("a", 1, 0.3, 3.0), ("b", 1, -0.1, None), ("a", 2, 0.5, 1.0), ("b", 2, 0.4, 0.5)]
    found = sweeps.rolling_choice(spark.createDataFrame(rows, "scenario_id string, fold int, total double, sharpe double"))
    got, want = [(r.fold, r.scenario_id, r.train_sharpe, r.test_total, r.test_sharpe) for r in found.collect()], []
    for fold in (1, 2):
        sharpe, _, best = max((s, t, k) for k, f, t, s in rows if f == fold - 1 and s is not None)
        want += [(fold, best, sharpe, t, s) for k, f, t, s in rows if f == fold and k == best]
    assert got == want
