"""Factors over a dense panel: one column each, all along time but the cross-sectional composites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import limit_ratio
from ..functions.windows import cs, ts, avg_rank, change, ffill, frame, pct_rank, ratio, rolling


def momentum(n: int, price: str = "close") -> Column:
    return change(price, n)


def with_returns(panel: DataFrame, price: str = "close") -> DataFrame:
    """ret: the one-step return, as a column of its own for windows over it."""
    return panel.withColumn("ret", change(price))


def volatility(n: int) -> Column:
    """Sample standard deviation of `ret`."""
    return rolling(F.stddev_samp, "ret", n)


def ma_cross(fast: int, slow: int, price: str = "close") -> Column:
    """The fast moving average over the slow one, less 1."""
    return ratio(rolling(F.avg, price, fast), rolling(F.avg, price, slow)) - 1


def ma_cross_by_name(name: str) -> Column:
    """ma_crossF_S for 1 <= F < S <= 500."""
    m = re.fullmatch(r"ma_cross(\d+)_(\d+)", name)
    if not m or not 1 <= int(m[1]) < int(m[2]) <= 500:
        raise ValueError(f"not a moving-average cross: {name}")
    return ma_cross(int(m[1]), int(m[2]))


def window_drawdown(n: int, price: str = "close") -> Column:
    """The price against the highest of the last n, less 1."""
    return ratio(F.col(price), F.max(price).over(frame(n))) - 1


def sharpe(n: int) -> Column:
    return ratio(rolling(F.avg, "ret", n), rolling(F.stddev_samp, "ret", n))


def sortino(n: int) -> Column:
    down = F.when(F.col("ret").isNotNull(), F.least(F.col("ret"), F.lit(0.0)))
    return ratio(rolling(F.avg, "ret", n), rolling(F.stddev_samp, down, n))


def nav_stability(n: int, price: str = "close") -> Column:
    """R squared of a straight line through the last n prices; null with a gap, or where the prices hardly move."""
    w = frame(n)
    moves = F.var_pop(price).over(w) * n >= 1e-12
    return F.when((F.count(price).over(w) == n) & moves, F.regr_r2(price, "t_idx").over(w))


def with_true_range(panel: DataFrame) -> DataFrame:
    """tr, and the directional moves up and down."""
    before = F.lag("close").over(ts())
    up = F.col("high") - F.lag("high").over(ts())
    down = F.lag("low").over(ts()) - F.col("low")
    return panel.withColumns(
        {
            "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
            "up_move": F.when(up.isNotNull() & down.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "down_move": F.when(up.isNotNull() & down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
        }
    )


def with_adx(panel: DataFrame, n: int = 14, min_periods: int | None = None) -> DataFrame:
    """atr and adx by rolling means."""
    rows = with_true_range(panel).withColumn("atr", rolling(F.avg, "tr", n, min_periods))
    plus, minus = (ratio(100 * rolling(F.avg, c, n, min_periods), F.col("atr")) for c in ("up_move", "down_move"))
    rows = rows.withColumns({"di_plus": plus, "di_minus": minus})
    rows = rows.withColumn("dx", ratio(100 * F.abs(F.col("di_plus") - F.col("di_minus")), F.col("di_plus") + F.col("di_minus")))
    return rows.withColumn("adx", rolling(F.avg, "dx", n, min_periods))


def chandelier(panel: DataFrame, n: int = 22, mult: float = 3.0, min_periods: int | None = None) -> DataFrame:
    """stop: the highest high of n less mult average true ranges."""
    rows = panel if "tr" in panel.columns else with_true_range(panel)
    return rows.withColumn("stop", rolling(F.max, "high", n, min_periods) - mult * rolling(F.avg, "tr", n, min_periods))


def open_to_open(panel: DataFrame) -> DataFrame:
    """open_ff (last positive open) and o2o, its one-step return, 0 where undefined."""
    rows = panel.withColumn("open_ff", ffill(F.when(F.col("open") > 0, F.col("open"))))
    return rows.withColumn("o2o", F.coalesce(change("open_ff"), F.lit(0.0)))


def limit_flags(panel: DataFrame, slack: float = 0.005) -> DataFrame:
    """limit_up and limit_down by the board's limit, and one-price boards: a limit day that closes no better than it opened."""
    ret, limit = change("close"), limit_ratio(F.col("code")) - slack
    rows = panel.withColumns({"limit_up": F.coalesce(ret >= limit, F.lit(False)), "limit_down": F.coalesce(ret <= -limit, F.lit(False))})
    up, down = (F.coalesce(c, F.lit(False)) for c in (F.col("open") >= F.col("close") - 1e-6, F.col("open") <= F.col("close") + 1e-6))
    return rows.withColumns({"one_price_up": F.col("limit_up") & up, "one_price_down": F.col("limit_down") & down})


def composite_stock() -> Column:
    """rank(am20) + rank(vol20) across codes."""
    return avg_rank("am20") + avg_rank("vol20")


def composite_fund() -> Column:
    """rank(vol20) - rank(mdd20) across codes: low is good."""
    return avg_rank("vol20") - avg_rank("mdd20")


def composite(weights: dict[str, float], low_is_good: dict[str, bool] | None = None) -> Column:
    """The weighted sum of percentile ranks; a factor whose low values are good counts 1 - rank; null if any is."""
    terms = [w * ((1 - pct_rank(f)) if (low_is_good or {}).get(f) else pct_rank(f)) for f, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def industry_neutral(score: str = "score", industry: str = "industry") -> Column:
    """The score less its industry's mean on the date."""
    return F.col(score) - F.avg(score).over(Window.partitionBy("date", industry))


def cross_signal(panel: DataFrame) -> DataFrame:
    """signal: 1 where ma_diff turns positive, -1 where it turns negative, else 0; null before it is known twice."""
    before = F.lag("ma_diff").over(ts())
    return panel.withColumn("signal", F.when((before <= 0) & (F.col("ma_diff") > 0), 1).when((before >= 0) & (F.col("ma_diff") < 0), -1).when(before.isNotNull() & F.col("ma_diff").isNotNull(), 0))


def with_cross_signal(panel: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """The crossings of two moving averages."""
    return cross_signal(panel.withColumn("ma_diff", rolling(F.avg, "close", short) - rolling(F.avg, "close", long)))


def liquidity_cut(q: float, amount: str = "am20") -> Column:
    """The q-quantile of am20 over all codes of the date, linear between values."""
    return F.percentile(amount, F.lit(q)).over(cs())


def factor(name: str) -> Column:
    """The factor of a name, over a dense panel with `ret`."""
    m = re.fullmatch(r"(mom|vol|mdd|sharpe|sortino)(\d+)", name)
    if m:
        return {"mom": momentum, "vol": volatility, "mdd": window_drawdown, "sharpe": sharpe, "sortino": sortino}[m[1]](int(m[2]))
    if name == "mom_accel":
        return momentum(20) - momentum(60)
    if name == "nav_stability":
        return nav_stability(60)
    return ma_cross_by_name(name)


def with_factors(panel: DataFrame, names: list[str], builder=None) -> DataFrame:
    """The named factors as columns; `builder`, a function of the panel, may add others first."""
    rows = with_returns(panel)
    if builder is not None:
        rows = builder(rows)
    new = {n: factor(n) for n in names if n not in rows.columns}
    return rows.withColumns(new) if new else rows
