"""Order execution as plain state machines: no Spark here, so they test alone and ship into grouped functions.

Semantics that matter: sells come before buys; a held name that stays in the target is bought again up to
its whole budget and never trimmed; the minimum commission is not part of the sizing, so cash may end
slightly negative; price limits use the execution day's flags.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field, replace

from ..functions.scalars import REDEMPTION_TIERS

NO_PRICE, LIMIT_UP, LIMIT_DOWN, ILLIQUID, NO_TURNOVER, TOO_SMALL, TOO_DEAR, TOO_CHEAP, NO_SHORTS = "no price", "limit up", "limit down", "below liquidity cut", "no turnover", "less than a lot", "above limit price", "below limit price", "shorts not allowed"


@dataclass(frozen=True)
class Profile:
    """Costs and lots of an asset type."""

    name: str = "stock"
    lot: int = 100
    buy_cost: float = 0.0008
    sell_cost: float = 0.0013
    limits: bool = True
    spread_bps: float = 0.0
    min_commission: float = 0.0
    slippage_bps: float = 0.0
    participation: float = 0.0


# Lot, costs, spread and minimum commission of the asset types.
PROFILES = {
    "stock": Profile(),
    "etf": Profile("etf", 100, 0.0003, 0.0003, True, 2.0, 5.0),
    "fund": Profile("fund", 1, 0.0015, 0.0050, False),
}


def profile(kind: str, **changes) -> Profile:
    """The profile of an asset type or one of its aliases, with changes."""
    alias = {"a": "stock", "a_share": "stock", "stocks": "stock", "etfs": "etf", "funds": "fund", "otc": "fund"}
    kind = alias.get(kind.lower(), kind.lower())
    if kind not in PROFILES:
        raise ValueError(f"unknown asset type: {kind}")
    return replace(PROFILES[kind], **changes)


def commission(amount: float, rate: float, least: float) -> float:
    return max(amount * rate, least) if amount > 0 else 0.0


@dataclass
class Quote:
    """What execution knows of a code on a day."""

    open: float | None = None
    close: float | None = None
    am20: float | None = None
    turnover: float | None = None
    limit_up: bool = False
    limit_down: bool = False
    stop: float | None = None
    last: float | None = None  # last known close


@dataclass
class Fill:
    code: str
    side: str
    shares: float
    price: float
    amount: float
    fee: float


@dataclass
class Book:
    """Cash and whole positions."""

    cash: float
    positions: dict[str, float] = field(default_factory=dict)
    fills: list[Fill] = field(default_factory=list)
    rejections: list[tuple[str, str, str]] = field(default_factory=list)

    def value(self, price) -> float:
        return self.cash + sum(n * (price(c) or 0.0) for c, n in self.positions.items())

    def _sell(self, code: str, p: Profile, q: Quote, slip: float) -> None:
        n = self.positions.pop(code)
        px = q.open * (1 - slip)
        fee = commission(n * px, p.sell_cost, p.min_commission)
        self.cash += n * px - fee
        self.fills.append(Fill(code, "sell", n, px, n * px, fee))

    def stop_out(self, p: Profile, before: dict[str, Quote], today: dict[str, Quote]) -> list[str]:
        """Sell at today's open what closed below its stop the day before."""
        out = []
        for code in sorted(self.positions):
            q, b = today.get(code, Quote()), before.get(code, Quote())
            if b.close is None or b.stop is None or b.close >= b.stop or not q.open or (p.limits and q.limit_down):
                continue
            self._sell(code, p, q, (p.slippage_bps + p.spread_bps) / 1e4)
            out.append(code)
        return out

    def rebalance(self, target: dict[str, float], value: float, p: Profile, quotes: dict[str, Quote], cut: float | None = None, max_weight: float | None = None) -> tuple[list[str], list[str]]:
        """Sell what has no target, then buy the target in its order; the sold and the bought codes."""
        slip, sold, bought = (p.slippage_bps + p.spread_bps) / 1e4, [], []
        for code in sorted(c for c in self.positions if target.get(c, 0.0) <= 0):
            q = quotes.get(code, Quote())
            if not q.open or q.open <= 0:
                self.rejections.append((code, "sell", NO_PRICE))
            elif p.limits and q.limit_down:
                self.rejections.append((code, "sell", LIMIT_DOWN))
            else:
                self._sell(code, p, q, slip)
                sold.append(code)
        for code, share in target.items():
            if share <= 0:
                continue
            q = quotes.get(code, Quote())
            why = None
            if not q.open or q.open <= 0:
                why = NO_PRICE
            elif p.limits and q.limit_up:
                why = LIMIT_UP
            elif q.am20 is None or (cut is not None and q.am20 < cut):
                why = ILLIQUID
            elif not q.turnover or q.turnover <= 0:
                why = NO_TURNOVER
            if why:
                self.rejections.append((code, "buy", why))
                continue
            px = q.open * (1 + slip)
            gross = px * (1 + p.buy_cost)
            budget = value * (min(share, max_weight) if max_weight is not None else share)
            n = min(math.floor(math.floor(budget / gross) / p.lot), math.floor(math.floor(max(self.cash, 0.0) / gross) / p.lot))
            if p.participation > 0:
                n = min(n, math.floor(int(q.am20 * p.participation / gross) / p.lot))
            if n <= 0:
                self.rejections.append((code, "buy", TOO_SMALL))
                continue
            n *= p.lot
            fee = commission(n * px, p.buy_cost, p.min_commission)
            self.cash -= n * px + fee
            self.positions[code] = self.positions.get(code, 0) + n
            self.fills.append(Fill(code, "buy", n, px, n * px, fee))
            bought.append(code)
        return sold, bought

    def order(self, code: str, shares: float, p: Profile, q: Quote, limit: float | None = None, allow_short: bool = True) -> bool:
        """Trade towards a position of so many shares at today's open: sells are floored to lots, buys are bounded by cash and participation."""
        delta = shares - self.positions.get(code, 0)
        side = "buy" if delta > 0 else "sell"
        if delta == 0:
            return False
        if not q.open or q.open <= 0:
            self.rejections.append((code, side, NO_PRICE))
            return False
        px = q.open * (1 + (p.slippage_bps / 1e4 if delta > 0 else -p.slippage_bps / 1e4))
        if limit is not None and (px > limit if delta > 0 else px < limit):
            self.rejections.append((code, side, TOO_DEAR if delta > 0 else TOO_CHEAP))
            return False
        if p.limits and (q.limit_up if delta > 0 else q.limit_down):
            self.rejections.append((code, side, LIMIT_UP if delta > 0 else LIMIT_DOWN))
            return False
        n = int(abs(delta)) // p.lot
        if delta > 0:
            gross = px * (1 + p.buy_cost)
            n = min(n, int(max(self.cash, 0.0) // gross) // p.lot)
        elif not allow_short:
            n = min(n, int(max(self.positions.get(code, 0), 0)) // p.lot)
        if p.participation > 0 and q.am20:
            n = min(n, int(q.am20 * p.participation / px) // p.lot)
        if n <= 0:
            self.rejections.append((code, side, NO_SHORTS if delta < 0 and not allow_short else TOO_SMALL))
            return False
        n *= p.lot
        fee = commission(n * px, p.buy_cost if delta > 0 else p.sell_cost, p.min_commission)
        self.cash += (-n * px if delta > 0 else n * px) - fee
        left = self.positions.get(code, 0) + (n if delta > 0 else -n)
        self.positions.pop(code, None)
        if left:
            self.positions[code] = left
        self.fills.append(Fill(code, side, n, px, n * px, fee))
        return True


# ---------------------------------------------------------------- funds
def redemption_fee_rate(days: int, tiers=REDEMPTION_TIERS) -> float:
    return next((rate for below, rate in tiers if days < below), 0.0)


@dataclass
class FundBook:
    """Fund shares in lots of purchase: subscriptions in hundredths of a share, redemptions first in, first out."""

    cash: float
    buy_cost: float = 0.0015
    share_classes: dict[str, str] = field(default_factory=dict)
    lots: dict[str, deque] = field(default_factory=dict)
    fills: list[Fill] = field(default_factory=list)

    def shares(self, code: str) -> float:
        return sum(n for _, n in self.lots.get(code, ()))

    def subscribe(self, code: str, amount: float, nav: float, day: int) -> float:
        """Buy for an amount; class C pays no fee; shares are cut to hundredths and the remainder stays in cash."""
        amount = min(amount, self.cash)
        fee = 0.0 if self.share_classes.get(code, "A") == "C" else amount * self.buy_cost
        n = int((amount - fee) / nav * 100) / 100
        if n <= 0:
            return 0.0
        self.cash -= n * nav + fee
        self.lots.setdefault(code, deque()).append((day, n))
        self.fills.append(Fill(code, "buy", n, nav, n * nav, fee))
        return n

    def redeem(self, code: str, shares: float, nav: float, day: int) -> float:
        """Sell shares, oldest first, with the fee of each lot's holding days; shares beyond the lots pay none."""
        left, fee, held = shares, 0.0, self.lots.get(code, deque())
        while left > 1e-9 and held:
            bought, n = held[0]
            take = min(n, left)
            fee += take * nav * redemption_fee_rate(day - bought)
            left -= take
            if take >= n - 1e-12:
                held.popleft()
            else:
                held[0] = (bought, n - take)
        self.cash += shares * nav - fee
        self.fills.append(Fill(code, "sell", shares, nav, shares * nav, fee))
        return fee

    def rebalance(self, target: dict[str, float], value: float, navs: dict[str, float], day: int, max_weight: float | None = None) -> None:
        for code in sorted(c for c in self.lots if target.get(c, 0.0) <= 0 and self.shares(c) > 0 and navs.get(c)):
            self.redeem(code, self.shares(code), navs[code], day)
        for code, share in target.items():
            if share > 0 and navs.get(code):
                self.subscribe(code, value * (min(share, max_weight) if max_weight is not None else share), navs[code], day)
