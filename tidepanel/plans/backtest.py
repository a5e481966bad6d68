"""Backtests: set-based weights, and cash, event and fund simulations as one grouped function for each scenario.

A scenario is a row of parameters.  Scenarios run side by side, one task each; within one, days follow
each other, as cash depends on what came before.  A scenario's group is one panel's rows between its
dates: one task holds the codes that are ever a target where targets are given, those in reach of an event
strategy that ranks codes (see reach), and every code where a strategy says nothing of its choice.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import ts
from ..operators.execution import Book, FundBook, Profile, Quote, profile
from ..operators.factors import limit_flags
from . import reach
from .reach import Bars, Choice


# ---------------------------------------------------------------- weights, set-based
def weight_nav(panel: DataFrame, targets: DataFrame, buy_cost: float = 0.0008, sell_cost: float = 0.0013) -> DataFrame:
    """date, t_idx, nav of target weights, all in windows.

    panel: dense, with t_idx and open_ff; targets: t_idx of the execution day, code, weight (summing to 1 a
    day).  Weights act from the day after; a day's value between executions is the weighted mean of the
    holdings' growth since; an execution day's return is less the costs of the moves from the drifted to
    the new weights.  The days before the first execution have nav 1.

    Each row carries its code's last execution along the code's own window, so the panel keeps the
    partitioning of its factors, and only the few rows that are held or bought go to their dates.
    """
    targets = targets.persist()  # a few rows for each execution day, read twice
    execs = F.broadcast(targets.select("t_idx").distinct().withColumn("is_exec", F.lit(True)))  # no more rows than dates
    rows = panel.select("code", "date", "t_idx", "open_ff").join(execs, "t_idx", "left").join(targets, ["t_idx", "code"], "left")
    mark = F.when(F.col("is_exec"), F.struct(F.col("t_idx").alias("e"), F.coalesce("weight", F.lit(0.0)).alias("w"), F.col("open_ff").alias("base")))
    held = F.last(mark, ignorenulls=True).over(ts().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("held", held).where("held.w > 0 or weight > 0")
    rows = rows.select("t_idx", "is_exec", F.coalesce("weight", F.lit(0.0)).alias("new"), F.col("held.e").alias("e"), F.coalesce("held.w", F.lit(0.0)).alias("w"), F.when(F.col("held.w") > 0, F.col("held.w") * F.coalesce(F.try_divide(F.col("open_ff"), F.col("held.base")), F.lit(1.0))).otherwise(0.0).alias("value"))
    by_day = Window.partitionBy("t_idx")
    move = F.when(F.col("is_exec"), F.col("new") - F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(by_day)), F.lit(0.0)))
    daily = rows.withColumn("move", move).groupBy("t_idx").agg(
        F.max("e").alias("e"), F.try_divide(F.sum("value"), F.sum("w")).alias("growth"), (F.sum(F.greatest("move", F.lit(0.0))) * buy_cost + F.sum(F.greatest(-F.col("move"), F.lit(0.0))) * sell_cost).alias("cost")
    )
    before = F.lag("growth").over(Window.partitionBy("e").orderBy("t_idx"))
    daily = daily.select("t_idx", (F.coalesce(F.col("growth") / F.when(F.col("e").isNotNull(), F.coalesce(before, F.lit(1.0))), F.lit(1.0)) - 1 - F.coalesce("cost", F.lit(0.0))).alias("ret"))
    days = panel.select("date", "t_idx").distinct().join(daily, "t_idx", "left")
    run = Window.orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("date", "t_idx", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(run)).alias("nav"))


def weight_loop(opens: dict[str, list[float | None]], targets: dict[int, dict[str, float]], n_days: int, buy_cost: float = 0.0008, sell_cost: float = 0.0013) -> list[float]:
    """weight_nav day by day, with stuck names: what is held and has no open on an execution day stays, and the rest shares what it leaves."""
    hold: dict[str, float] = {}
    last: dict[str, float] = {}
    nav, out = 1.0, []
    for t in range(n_days):
        r = {}
        for c, o in opens.items():
            px = o[t]
            r[c] = px / last[c] - 1 if px and px > 0 and c in last else 0.0
            if px and px > 0:
                last[c] = px
        total = sum(hold.values())
        raw = sum(r[c] * w for c, w in hold.items()) / total if total else 0.0
        hold = {c: w * (1 + r[c]) / (1 + raw) for c, w in hold.items()}
        if t in targets:
            stuck = {c: w for c, w in hold.items() if not (opens[c][t] and opens[c][t] > 0)}
            free = {c: w for c, w in targets[t].items() if c not in stuck}
            scale = (1 - sum(stuck.values())) / sum(free.values()) if free else 0.0
            new = stuck | {c: w * scale for c, w in free.items()}
            moves = {c: new.get(c, 0.0) - hold.get(c, 0.0) for c in {*new, *hold}}
            raw -= sum(max(m, 0) for m in moves.values()) * buy_cost + sum(max(-m, 0) for m in moves.values()) * sell_cost
            hold = new
        nav *= 1 + raw
        out.append(nav)
    return out


def long_short_returns(panel: DataFrame, legs: DataFrame, fee: float = 0.0, long: float = 1.0, short: float = 1.0) -> DataFrame:
    """date, t_idx, ret of legs: long * ret_long - short * ret_short - short * fee / 252.

    legs: t_idx of the execution day, code, side, weight (each leg to 1); legs hold until the next execution day.
    """
    legs = legs.persist()  # a few rows for each execution day, read twice
    execs = legs.select("t_idx").distinct().withColumn("next", F.lead("t_idx").over(Window.orderBy("t_idx")))
    held = legs.join(execs, "t_idx").select(F.col("t_idx").alias("e"), "next", "code", "side", "weight")
    rows = held.join(panel.select("code", "t_idx", "o2o"), "code").where((F.col("t_idx") > F.col("e")) & (F.col("t_idx") <= F.coalesce("next", F.lit(1 << 30))))
    leg = lambda s: F.try_divide(F.sum(F.when(F.col("side") == s, F.col("weight") * F.col("o2o"))), F.sum(F.when(F.col("side") == s, F.col("weight"))))
    daily = rows.groupBy("t_idx").agg((long * leg(1) - short * leg(-1) - short * fee / 252).alias("ret"))
    return panel.select("date", "t_idx").distinct().join(daily, "t_idx", "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def long_short_nav(panel: DataFrame, legs: DataFrame, fee: float = 0.0, long: float = 1.0, short: float = 1.0) -> DataFrame:
    """date, t_idx, nav of long_short_returns."""
    run = Window.orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    return long_short_returns(panel, legs, fee, long, short).select("date", "t_idx", F.exp(F.sum(F.log1p("ret")).over(run)).alias("nav"))


def benchmark_nav(panel: DataFrame) -> DataFrame:
    """date, t_idx, nav of the equal mean of open-to-open returns over codes with valid prices on both days."""
    ok = (F.lag("close").over(ts()) > 0) & (F.lag("open").over(ts()) > 0) & (F.col("open") > 0)
    rows = panel.withColumn("_r", F.when(ok, F.col("o2o"))).groupBy("date", "t_idx").agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("ret"))
    run = Window.orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("date", "t_idx", F.exp(F.sum(F.log1p("ret")).over(run)).alias("nav"))


# ---------------------------------------------------------------- day by day
MOST_SCENARIOS = 10_000
QUOTES = ["scenario_id", "params", "t_idx", "date", "code", "open", "close", "am20", "turnover", "limit_up", "limit_down", "stop", "target", "cut"]
NAV = (
    "scenario_id string, date date, nav double, cash double, positions map<string,double>, n_fills int, n_rejected int, "
    "fills array<struct<code: string, side: string, shares: double, price: double, amount: double, fee: double>>, rejections array<struct<code: string, side: string, reason: string>>"
)


def _days(pdf: pd.DataFrame):
    """(t_idx, date, {code: row}) in order."""
    pdf = pdf.sort_values(["t_idx", "code"])
    for (t, d), day in pdf.groupby(["t_idx", "date"], sort=True):
        yield int(t), d, {r["code"]: r for r in day.to_dict("records")}


def _clean(x) -> float | None:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


def _quotes(rows: dict[str, dict]) -> dict[str, Quote]:
    return {c: Quote(*[_clean(r.get(k)) for k in ("open", "close", "am20", "turnover")], bool(r.get("limit_up")), bool(r.get("limit_down")), _clean(r.get("stop"))) for c, r in rows.items()}


def _held(book: Book) -> dict[str, float]:
    """Positions as floats: Arrow rejects whole numbers that a double can't hold."""
    return {c: float(n) for c, n in book.positions.items()}


def _traded(fills: list, rejections: list) -> tuple:
    """The last four columns of a day."""
    return len(fills), len(rejections), [{"code": f.code, "side": f.side, "shares": float(f.shares), "price": float(f.price), "amount": float(f.amount), "fee": float(f.fee)} for f in fills], [{"code": c, "side": s, "reason": why} for c, s, why in rejections]


def _output(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["scenario_id", "date", "nav", "cash", "positions", "n_fills", "n_rejected", "fills", "rejections"])


def fills(runs: DataFrame) -> DataFrame:
    """scenario_id, date and each trade of the runs: code, side, shares, price, amount, fee."""
    return runs.select("scenario_id", "date", F.explode("fills").alias("f")).select("scenario_id", "date", "f.*")


def rejections(runs: DataFrame) -> DataFrame:
    """scenario_id, date and each order that was not filled: code, side, reason."""
    return runs.select("scenario_id", "date", F.explode("rejections").alias("r")).select("scenario_id", "date", "r.*")


def holdings(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """scenario_id, date, code, shares, price (the last known close) and weight of what each run holds at each day's end."""
    held = runs.select("scenario_id", "date", "nav", "cash", F.explode("positions").alias("code", "shares")).where("shares <> 0")
    # every code has a row on every date, so a close carries along the code's own window
    last = quotes.select("date", "code", F.last(F.when(F.col("close") > 0, F.col("close")), ignorenulls=True).over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("price"))
    rows = held.join(last, ["date", "code"], "left").withColumn("value", F.col("shares") * F.col("price"))
    total = F.sum("value").over(Window.partitionBy("scenario_id", "date")) + F.col("cash")
    return rows.select("scenario_id", "date", "code", "shares", "price", F.try_divide(F.col("value"), total).alias("weight"))


def _warming(params: dict, day) -> bool:
    """Is a day before `start`, if the run has one?  Prices count in the warm-up; nothing is traded or returned, so capital is whole at the start."""
    return str(day)[:10] < params.get("start", "")


def _profile(params: dict) -> Profile:
    return profile(params.get("asset", "stock"), **params.get("costs", {}))


def cash_backtest(pdf: pd.DataFrame) -> pd.DataFrame:
    """One scenario in cash: stops, then sales and purchases at the open of execution days, valued at the last close.

    `target` is the weight for an execution day (null: none that day), in the order of `rank` if there is
    one; `cut` the liquidity cut of the day before.
    """
    params = json.loads(pdf["params"].iloc[0])
    p, capital = _profile(params), float(params.get("capital", 1e6))
    book, last, before, out = Book(capital), {}, {}, []
    for t, day, rows in _days(pdf):
        quotes = _quotes(rows)
        if _warming(params, day):
            last |= {c: q.close for c, q in quotes.items() if q.close and q.close > 0}
            before = quotes
            continue
        n0, r0 = len(book.fills), len(book.rejections)
        if t and params.get("stops"):
            book.stop_out(p, before, quotes)
        target = {c: _clean(r.get("target")) for c, r in rows.items()}
        target = {c: w for c, w in target.items() if w is not None}
        if t and any(w > 0 for w in target.values()):
            ordered = dict(sorted(((c, w) for c, w in target.items() if w > 0), key=lambda x: (_clean(rows[x[0]].get("rank")) or 0, x[0])))
            cut = next((_clean(r.get("cut")) for r in rows.values() if _clean(r.get("cut")) is not None), None)
            book.rebalance(ordered, book.value(last.get), p, quotes, cut, params.get("max_weight"))
        last |= {c: q.close for c, q in quotes.items() if q.close and q.close > 0}
        out.append((pdf["scenario_id"].iloc[0], day, book.value(last.get) / capital, book.cash, _held(book), *_traded(book.fills[n0:], book.rejections[r0:])))
        before = quotes
    return _output(out)


class Context:
    """What an event strategy sees and asks for: closes up to the signal day, positions, who can trade at the next open, orders for it."""

    def __init__(self, book: Book, history: dict[str, list[float]], quotes: dict[str, Quote], today: dict[str, Quote] | None = None, day=None):
        self.book, self.history, self.quotes, self.today, self.day = book, history, quotes, quotes if today is None else today, day
        self.orders: dict[str, tuple[str, float, float | None]] = {}

    def codes(self) -> list[str]:
        return sorted(self.history)

    def position(self, code: str) -> float:
        return self.book.positions.get(code, 0)

    def last_close(self, code: str) -> float | None:
        return (self.closes(code, 1) or [None])[0]

    def position_value(self, code: str) -> float:
        return self.position(code) * (self.last_close(code) or 0.0)

    def value(self) -> float:
        return self.book.value(self.last_close)

    def closes(self, code: str, n: int) -> list[float]:
        return self.history.get(code, [])[-n:]

    def _opens(self, code: str) -> bool:
        q = self.today.get(code)
        return bool(q and q.open and q.open > 0)

    def is_tradable(self, code: str) -> bool:
        """A close and a turnover on the signal day, and an open on the day of execution."""
        q = self.quotes.get(code)
        return bool(q and q.close and q.close > 0 and q.turnover and q.turnover > 0 and self._opens(code))

    def tradable(self) -> list[str]:
        return [c for c in self.codes() if self.is_tradable(c)]

    def can_buy(self, code: str) -> bool:
        return self._opens(code) and not self.today[code].limit_up

    def can_sell(self, code: str) -> bool:
        return self._opens(code) and not self.today[code].limit_down

    def optimised(self, codes: list[str], window: int, cap: float, method: str = "risk_parity", **options) -> dict[str, float]:
        """Weights from the last `window` returns of those codes that have so many; none from fewer than two returns or codes."""
        import numpy as np

        from ..operators.portfolio import weights_from_returns

        known = [c for c in codes if len(self.closes(c, window + 1)) == window + 1]
        if not known or window < 2:
            return {}
        x = np.array([self.closes(c, window + 1) for c in known])
        return weights_from_returns((x[:, 1:] / x[:, :-1] - 1).T, known, method, cap, **options)

    def target_percent(self, code: str, share: float, limit: float | None = None) -> None:
        self.orders[code] = ("percent", max(-1.0, min(1.0, share)), limit)

    def target_shares(self, code: str, shares: float, limit: float | None = None) -> None:
        self.orders[code] = ("shares", shares, limit)

    def trade(self, code: str, delta: float, limit: float | None = None) -> None:
        self.orders[code] = ("shares", self.position(code) + delta, limit)


class EventStrategy:
    """Subclass and set orders in on_bar; the last order for a code wins.

    `choices`, a static function of params and Bars, says what on_bar can choose on each signal day, so that
    a run holds no other codes (reached); without it the run holds all.
    """

    choices: Callable[[dict, Bars], list[Choice]] | None = None

    def init(self, params: dict) -> None:
        self.params = params

    def on_bar(self, ctx: Context, t: int) -> None:
        raise NotImplementedError


class GoldenCross(EventStrategy):
    """Hold at most top_n codes: enter where the short average crosses the long one upwards, the widest cross first, leave where it crosses downwards.

    A place is free from the day after its holder was sold; a code gets an equal part, max_weight at most.
    """

    def on_bar(self, ctx: Context, t: int) -> None:
        a, b, k = self.params.get("short", 5), self.params.get("long", 20), self.params.get("top_n", 3)

        def spreads(code: str) -> tuple[float, float] | None:
            x = ctx.closes(code, b + 2)
            return (sum(x[-a - 1 : -1]) / a - sum(x[-b - 1 : -1]) / b, sum(x[-a:]) / a - sum(x[-b:]) / b) if len(x) == b + 2 else None

        for code in list(ctx.book.positions):
            if (s := spreads(code)) and s[1] < 0 <= s[0]:
                ctx.target_percent(code, 0.0)
        crosses = [(s[1], code) for code in ctx.tradable() if ctx.position(code) <= 0 and (s := spreads(code)) and s[0] <= 0 < s[1]]
        free = max(0, k - sum(n > 0 for n in ctx.book.positions.values()))
        for _, code in sorted(crosses, reverse=True)[:free]:
            ctx.target_percent(code, min(self.params.get("max_weight", 0.5), 1.0 / k))


    @staticmethod
    def choices(params: dict, bars: Bars) -> list[Choice]:
        """The top_n widest crosses: held codes among them leave no more places than there are others."""
        a, b, k = params.get("short", 5), params.get("long", 20), params.get("top_n", 3)
        now, was = (bars.sums(min(a, n)) / a - bars.sums(b) / b for n in (b + 2, b + 1))
        return [Choice(bars.tradable & (bars.nth > b) & (bars.before(was, 1) <= 0) & (now > 0), now, k, True)]


class RiskParity(EventStrategy):
    """On every `weekday` (0, Monday), weights of equal risk over the last `window` returns for the top_n tradable codes of largest am20."""

    @staticmethod
    def choices(params: dict, bars: Bars) -> list[Choice]:
        return [Choice(bars.tradable & (bars.weekday == params.get("weekday", 0)), np.nan_to_num(bars.am20), params.get("top_n", 5), False)]

    def on_bar(self, ctx: Context, t: int) -> None:
        if ctx.day.weekday() != self.params.get("weekday", 0):
            return
        codes = sorted(ctx.tradable(), key=lambda c: (-(ctx.quotes[c].am20 or 0.0), c))[: self.params.get("top_n", 5)]
        weights = ctx.optimised(codes, self.params.get("window", 60), self.params.get("max_weight", 0.4), self.params.get("method", "risk_parity"))
        for code in {*ctx.book.positions, *weights} if weights else ():
            ctx.target_percent(code, weights.get(code, 0.0))


class LongShortMomentum(EventStrategy):
    """On every `weekday` (0, Monday), leave everything, then long the long_n best and short the short_n worst by the change over `window` closes, each side to its part of the value."""

    @staticmethod
    def choices(params: dict, bars: Bars) -> list[Choice]:
        n = params.get("window", 20)
        move = bars.close / bars.before(bars.close, n) - 1
        ok = bars.tradable & (bars.weekday == params.get("weekday", 0)) & (bars.nth >= n)
        return [Choice(ok, move, params.get("long_n", 3), True), Choice(ok, -move, params.get("short_n", 3), False)]

    def on_bar(self, ctx: Context, t: int) -> None:
        p = self.params
        n, longs, shorts = p.get("window", 20), p.get("long_n", 3), p.get("short_n", 3)
        if ctx.day.weekday() != p.get("weekday", 0):
            return
        moves = sorted((x[-1] / x[0] - 1, c) for c in ctx.tradable() if len(x := ctx.closes(c, n + 1)) == n + 1)
        if len(moves) < longs + shorts:
            return
        for code in ctx.book.positions:
            ctx.target_shares(code, 0)
        for _, code in moves[len(moves) - longs :]:
            ctx.target_percent(code, p.get("long_notional", 0.5) / longs)
        for _, code in moves[:shorts]:
            ctx.target_percent(code, -p.get("short_notional", 0.5) / shorts)


STRATEGIES: dict[str, type[EventStrategy]] = {"golden_cross": GoldenCross, "risk_parity": RiskParity, "long_short_momentum": LongShortMomentum}


def event_backtest(pdf: pd.DataFrame, strategy: type[EventStrategy] | None = None) -> pd.DataFrame:
    """One scenario of an event strategy: it sees the day before, its orders fill at today's open, shorts pay a daily fee."""
    params = json.loads(pdf["params"].iloc[0])
    p, capital = _profile(params), float(params.get("capital", 1e6))
    user = (strategy or STRATEGIES[params["strategy"]])()
    user.init(params)
    book, last, history, before, out = Book(capital), {}, {}, {}, []
    for t, day, rows in _days(pdf):
        quotes = _quotes(rows)
        n0, r0 = len(book.fills), len(book.rejections)
        warming = _warming(params, day)
        if t and not warming:
            ctx = Context(book, history, before, quotes, day)
            user.on_bar(ctx, t)
            value = max(book.value(last.get), 1.0)
            want = []
            for code, (kind, x, limit) in ctx.orders.items():
                shares = x if kind == "shares" else int(value * x / last[code]) if last.get(code) else None
                if shares is not None:
                    want.append((shares - book.positions.get(code, 0) > 0, code, shares, limit))
            for _, code, shares, limit in sorted(want):  # sales first
                book.order(code, shares, p, quotes.get(code, Quote()), limit, params.get("shorts", True))
        book.cash -= sum(-n * (last.get(c) or 0.0) for c, n in book.positions.items() if n < 0) * params.get("short_rate", 0.0) / 252
        for c, q in quotes.items():
            if q.close and q.close > 0:
                last[c] = q.close
                history.setdefault(c, []).append(q.close)
        if warming:
            before = quotes
            continue
        out.append((pdf["scenario_id"].iloc[0], day, book.value(last.get) / capital, book.cash, _held(book), *_traded(book.fills[n0:], book.rejections[r0:])))
        before = quotes
    return _output(out)


def reached(quotes: DataFrame, scenarios: DataFrame, strategy: type[EventStrategy] | None = None) -> DataFrame:
    """The quotes that the event strategies of the scenarios can make use of, with scenario_id: their runs are those over all quotes.

    Quotes without price limits get them from their closes.
    """
    along = (lambda rows: rows) if "limit_up" in quotes.columns else (lambda rows: limit_flags(rows).drop("one_price_up", "one_price_down"))
    return reach.reached(quotes, scenarios, lambda params: strategy or STRATEGIES[params["strategy"]], along)


def fund_backtest(pdf: pd.DataFrame) -> pd.DataFrame:
    """One scenario of funds: subscriptions and first-in first-out redemptions at the day's value."""
    params = json.loads(pdf["params"].iloc[0])
    capital = float(params.get("capital", 1e6))
    book, last, out = FundBook(capital, params.get("buy_cost", 0.0015), params.get("share_classes", {})), {}, []
    for t, day, rows in _days(pdf):
        n0 = len(book.fills)
        navs = {c: r["close"] for c, r in rows.items() if _clean(r.get("close"))}
        if _warming(params, day):
            last |= navs
            continue
        value = book.cash + sum(book.shares(c) * last.get(c, 0.0) for c in book.lots)
        target = {c: w for c, r in rows.items() if (w := _clean(r.get("target"))) is not None}
        if t and any(w > 0 for w in target.values()):
            book.rebalance(target, value, navs, pd.Timestamp(day).toordinal(), params.get("max_weight"))
        last |= navs
        out.append((pdf["scenario_id"].iloc[0], day, (book.cash + sum(book.shares(c) * last.get(c, 0.0) for c in book.lots)) / capital, book.cash, {c: book.shares(c) for c in book.lots if book.shares(c) > 0}, *_traded(book.fills[n0:], [])))
    return _output(out)


def run_scenarios(quotes: DataFrame, scenarios: DataFrame, simulate: Callable[[pd.DataFrame], pd.DataFrame] = cash_backtest) -> DataFrame:
    """NAV rows of every scenario (scenario_id, params JSON) over the quotes; scenarios are a table of parameters, at most MOST_SCENARIOS, and go to the quotes by broadcast.

    Quotes with a scenario_id of their own are joined on it, else every scenario sees all of them.  A
    scenario with `start` and `end` (ISO dates) sees the days between, and `warmup` days (400) before.
    """
    if scenarios.limit(MOST_SCENARIOS + 1).count() > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} scenarios: run them in parts")
    rows = quotes.join(F.broadcast(scenarios), "scenario_id") if "scenario_id" in quotes.columns else quotes.crossJoin(F.broadcast(scenarios))
    field = lambda name: F.get_json_object("params", f"$.{name}")
    lo = F.date_sub(field("start").cast("date"), F.coalesce(field("warmup").cast("int"), F.lit(400)))
    rows = rows.where(F.coalesce(F.col("date") >= lo, F.lit(True)) & F.coalesce(F.col("date") <= field("end").cast("date"), F.lit(True)))
    return rows.groupBy("scenario_id").applyInPandas(lambda pdf: simulate(pdf), NAV)
