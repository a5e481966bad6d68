"""Selection of codes on signal dates: masks, ranks, caps, weights, legs, and the rebalancing calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import cs
from .factors import liquidity_cut

MONTHLY, SEMIANNUAL, WEEKLY, DAILY = "monthly", "semiannual", "weekly", "daily"


def rebalance_days(calendar: DataFrame, freq: str = MONTHLY) -> DataFrame:
    """The calendar with is_exec: a trade day whose signal is the day before (t_idx - 1).

    monthly: the month changes; semiannual: it changes to March or September; weekly: Fridays only, so a
    week without one has no signal; daily: every day but the first.
    """
    before = F.lag("date").over(Window.orderBy("date"))
    turn = F.month("date") != F.month(before)
    due = {MONTHLY: turn, SEMIANNUAL: turn & F.month("date").isin(3, 9), WEEKLY: (F.weekday(before) == 4), DAILY: before.isNotNull()}[freq]
    return calendar.withColumn("is_exec", F.coalesce(due, F.lit(False)))


def tradable(q: float = 0.3, factor: str = "score", adx: float | None = None) -> Column:
    """Price, factor, turnover and am20 known, am20 at least its q-quantile, turnover positive, and a trend strong enough."""
    ok = (F.col("close") > 0) & F.col(factor).isNotNull() & (F.col("turnover") > 0) & (F.col("am20") >= liquidity_cut(q))
    return F.coalesce(ok & (F.col("adx") >= adx) if adx is not None else ok, F.lit(False))


def tradable_rows(rows: DataFrame, q: float = 0.3, factor: str = "score", adx: float | None = None) -> DataFrame:
    return rows.withColumn("_ok", tradable(q, factor, adx)).where("_ok").drop("_ok")


def affordable(capital: float, top_n: int, lot: int = 100) -> Column:
    return F.col("close") * lot <= capital / top_n


def board_excluded(code: Column) -> Column:
    return code.rlike("^(300|301|688|689)")


def recent(rows: DataFrame, days: int, date: str = "date") -> DataFrame:
    """The rows of the last `days` days before the latest date; all rows where that leaves none."""
    edge = F.broadcast(rows.agg(F.max(date).alias("_edge")))
    marked = rows.join(edge).withColumn("_in", F.coalesce(F.col(date) >= F.date_sub("_edge", days), F.lit(False)))
    some = F.broadcast(marked.agg(F.max("_in").alias("_some")))
    return marked.join(some).where(F.col("_in") | ~F.coalesce(F.col("_some"), F.lit(False))).drop("_edge", "_in", "_some")


def last_counts(rows: DataFrame, by: list[str], date: str = "date", limit: int = 30) -> DataFrame:
    """Rows by date and label, those of the latest dates first."""
    return rows.groupBy(date, *by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(date), *by).limit(limit)


def order_of(score: Column, ascending: bool) -> list[Column]:
    """The order of selection: ties go to the smaller code in ascending order, to the larger in descending order."""
    return [score.asc_nulls_last(), F.col("code").asc()] if ascending else [score.desc_nulls_last(), F.col("code").desc()]


def rank_select(rows: DataFrame, top_n: int | None = None, top_pct: float | None = None, ascending: bool = False, score: str = "score", industry_cap: int | None = None, min_positions: int = 1, max_positions: int | None = None) -> DataFrame:
    """The selected rows of each date with rank (from 1): the first top_n, or a share of the candidates rounded up, at most industry_cap for each industry."""
    rows = rows.where(F.col(score).isNotNull())
    order = order_of(F.col(score), ascending)
    if top_pct is not None:
        rows = rows.withColumn("_want", F.greatest(F.lit(min_positions), F.ceil(F.count(F.lit(1)).over(cs()) * F.lit(top_pct) - 1e-9)))
        if max_positions is not None:
            rows = rows.withColumn("_want", F.least("_want", F.lit(max_positions)))
    else:
        rows = rows.withColumn("_want", F.lit(top_n))
    if industry_cap is not None:
        in_industry = F.row_number().over(Window.partitionBy("date", "industry").orderBy(*order))
        rows = rows.withColumn("_i", in_industry).where(F.col("_i") <= industry_cap).drop("_i")
    rows = rows.withColumn("rank", F.row_number().over(cs().orderBy(*order)))
    if top_pct is None:
        return rows.where(F.col("rank") <= top_n).drop("_want")
    return rows.where(F.col("rank") <= F.col("_want")).drop("_want")


def equal_weights(rows: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return rows.withColumn("weight", scale / F.count(F.lit(1)).over(cs()))


def long_short_legs(rows: DataFrame, long_n: int, short_n: int, ascending: bool = False, score: str = "score", compat: bool = False) -> DataFrame:
    """The best long_n with side 1 and the weakest short_n with side -1, each leg in equal weights.

    A date with fewer than long_n + short_n candidates has no legs.  compat takes the shorts next to the
    longs instead of from the end.
    """
    rows = rows.where(F.col(score).isNotNull()).withColumns({"rank": F.row_number().over(cs().orderBy(*order_of(F.col(score), ascending))), "_n": F.count(F.lit(1)).over(cs())})
    rows = rows.where(F.col("_n") >= long_n + short_n)
    is_short = (F.col("rank") > long_n) & (F.col("rank") <= long_n + short_n) if compat else F.col("rank") > F.col("_n") - short_n
    side = F.when(F.col("rank") <= long_n, 1).when(is_short, -1)
    rows = rows.withColumn("side", side).where("side is not null")
    return rows.withColumn("weight", F.lit(1.0) / F.when(F.col("side") == 1, long_n).otherwise(short_n)).drop("_n")


def regime_scale(threshold: float, scale: float) -> Column:
    """scale on dates whose median adx is below the threshold, else 1."""
    return F.when(F.percentile("adx", F.lit(0.5)).over(cs()) < threshold, F.lit(scale)).otherwise(F.lit(1.0))


def latest_signals(rows: DataFrame, top_n: int = 10, ascending: bool = False, score: str = "score", compat: bool = False) -> DataFrame:
    """The first top_n of the last date; compat takes them from the other end."""
    last = F.broadcast(rows.where(F.col(score).isNotNull()).agg(F.max("date").alias("date")))
    return rank_select(rows.join(last, "date"), top_n, ascending=ascending != compat, score=score)


def leaders(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k highest and the k lowest of each date, with side `head` or `tail`."""
    high = rank_select(rows, k, ascending=False, score=score).withColumn("side", F.lit("head"))
    low = rank_select(rows, k, ascending=True, score=score).withColumn("side", F.lit("tail"))
    return high.unionByName(low)


def search(names: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Codes that start with the text first, then names that contain it."""
    t = F.lit(text.lower())
    kind = F.when(F.col("code").startswith(text), 0).when(F.contains(F.lower("name"), t), 1)
    return names.withColumn("hit", kind).where("hit is not null").orderBy("hit", "code").limit(limit)
