"""Panels: bars from trades and events, the trading calendar, dense panels, adjusted prices, windows with look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import zero_filled
from ..functions.windows import ffill, frame
from .store import precomputed


def _exact_sum(c: Column) -> Column:
    """A sum of amounts in cents that doesn't depend on the order of rows."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def bars(trades: DataFrame, code: Column, day: Column, price: Column, volume: Column, amount: Column, order: list[str]) -> DataFrame:
    """OHLC bars of trades: one row for each (date, code); `order` must tell any two trades of a bar apart."""
    rows = trades.select(code.alias("code"), day.alias("date"), price.alias("price"), volume.alias("volume"), amount.alias("amount"), F.struct(*order).alias("at"))
    return rows.groupBy("code", "date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        _exact_sum(F.col("volume")).alias("volume"),
        _exact_sum(F.col("amount")).alias("amount"),
    )


def weekly_bars(lineitem: DataFrame) -> DataFrame:
    """A panel of suppliers by week: the price of a line is its extended price over its quantity."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    out = bars(lineitem.where("l_quantity > 0"), zero_filled(F.col("l_suppkey")), F.date_trunc("week", "l_shipdate").cast("date"), price, F.col("l_quantity"), F.col("l_extendedprice"), order)
    return out.withColumn("turnover", F.col("volume") / 100.0)


def daily_bars(events: DataFrame) -> DataFrame:
    """A panel of users by day: the price is the event's value, the volume the number of events."""
    return bars(events, zero_filled(F.col("user_id")), F.col("ts").cast("date"), F.col("value"), F.lit(1), F.col("value"), ["ts", "event_id"])


def calendar(panel: DataFrame) -> DataFrame:
    """date and t_idx (from 0) of the dates of a panel; as many rows as there are dates."""
    from pyspark.sql.window import Window

    return panel.select("date").distinct().withColumn("t_idx", F.row_number().over(Window.orderBy("date")) - 1)


def dense(panel: DataFrame) -> DataFrame:
    """Every code on every date, missing bars as nulls, so that a row step is a calendar step.

    The calendar is as long as history, never as large as the panel, so it goes to the codes by broadcast.
    """
    grid = panel.select("code").distinct().crossJoin(F.broadcast(calendar(panel)))
    return grid.join(panel, ["code", "date"], "left")


def _exact_mean(c: str, n: int, min_periods: int) -> Column:
    """A rolling mean of decimal amounts: an exact sum and one division, the same on any engine."""
    w = frame(n)
    return F.when(F.count(c).over(w) >= min_periods, F.sum(F.col(c).cast("decimal(18,4)")).over(w).cast("double") / F.count(c).over(w))


def rolling_base(panel: DataFrame, n: int = 20, min_periods: int = 15) -> DataFrame:
    """turn20 and am20: rolling means over the bars that a code has."""
    return panel.withColumns({"turn20": _exact_mean("turnover", n, min_periods), "am20": _exact_mean("amount", n, min_periods)})


def with_lookback(panel: DataFrame, start: str, end: str, days: int, transform) -> DataFrame:
    """transform over [start - days, end], then only [start, end]: a date filter can't pass a window by itself, and the scan must not read all history."""
    lo = F.date_sub(F.lit(start).cast("date"), days)
    wide = panel.where((F.col("date") >= lo) & (F.col("date") <= F.lit(end).cast("date")))
    return transform(wide).where(F.col("date") >= F.lit(start).cast("date"))


def last_adjustment(panel: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The last adjustment factor of each code: from the snapshot, or the panel's own where the snapshot has none."""
    own = panel.where("adj_factor is not null").groupBy("code").agg(F.max_by("adj_factor", "date").alias("own_adj"))
    if snapshot is None:
        return own.withColumnRenamed("own_adj", "last_adj")
    return own.join(snapshot.select("code", "last_adj"), "code", "full").select("code", F.coalesce("last_adj", "own_adj").alias("last_adj"))


def adjusted(panel: DataFrame, basis: str = "qfq", snapshot: DataFrame | None = None, prices=("open", "high", "low", "close")) -> DataFrame:
    """Prices on a basis: raw, hfq (times the factor) or qfq (times the factor over the last one)."""
    if basis == "raw":
        return panel
    if basis == "hfq":
        return panel.withColumns({p: F.col(p) * F.col("adj_factor") for p in prices})
    if basis != "qfq":
        raise ValueError(f"unknown price basis: {basis}")
    rows = panel.join(last_adjustment(panel, snapshot), "code", "left")
    return rows.withColumns({p: F.col(p) * F.col("adj_factor") / F.col("last_adj") for p in prices}).drop("last_adj")


def nav_panel(nav: DataFrame) -> DataFrame:
    """A panel of net asset values: one price, turnover and amounts of 1, values filled forward over a dense calendar."""
    rows = dense(nav.select("code", "date", "nav")).withColumn("close", ffill("nav"))
    one = F.lit(1.0)
    return rows.where("close is not null").select("code", "date", "t_idx", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], *[one.alias(c) for c in ("volume", "amount", "turnover", "turn20", "am20")])


def valid_prices(panel: DataFrame) -> DataFrame:
    """The rows whose prices can be: positive open and close, high not below low."""
    ok = (F.col("close") > 0) & (F.col("open") > 0) & (F.col("high") >= F.col("low"))
    return panel.where(F.coalesce(ok, F.lit(False)))


def code_statistics(panel: DataFrame, price: str = "close") -> DataFrame:
    """code, n, first and last date, mean and last price."""
    return panel.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg(price).alias("mean"), F.max_by(price, "date").alias("latest"))


def last_change(panel: DataFrame, price: str = "close") -> DataFrame:
    """code, date, price and change of each code's last row over the one before it."""
    last = tail(panel.where(F.col(price).isNotNull()), 2)
    x = F.sort_array(F.collect_list(F.struct("date", price)))  # two rows at most
    rows = last.groupBy("code").agg(x.alias("x"))
    now, was = F.get("x", F.size("x") - 1), F.get("x", F.size("x") - 2)
    return rows.select("code", now["date"].alias("date"), now[price].alias(price), F.when(F.size("x") > 1, F.try_divide(now[price], was[price]) - 1).alias("change"))


def dedupe_last(rows: DataFrame, keys: list[str], recency: list[Column]) -> DataFrame:
    """The latest row of each key; unlike dropDuplicates, which keeps any."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in recency]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def tail(panel: DataFrame, days: int) -> DataFrame:
    """The last rows of each code."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return panel.withColumn("_n", n).where(F.col("_n") <= days).drop("_n")


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly bars of a data folder, precomputed and sorted by code and date."""
    return precomputed(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "bars", lambda rows: weekly_bars(rows).repartition("code").sortWithinPartitions("code", "date"))


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel of a data folder, with rolling base columns."""
    return rolling_base(bars_of(spark, sf_dir))


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense weekly panel of a data folder with ret and t_idx, precomputed from its bars, sorted by code and date."""
    from ..operators.factors import with_returns

    return precomputed(bars_of(spark, sf_dir), "dense", lambda rows: with_returns(dense(rolling_base(rows))).repartition("code").sortWithinPartitions("code", "date"))


__all__ = ["adjusted", "bars", "calendar", "daily_bars", "dedupe_last", "dense", "last_adjustment", "nav_panel", "rolling_base", "tail", "weekly_bars", "weekly_panel", "with_lookback"]
