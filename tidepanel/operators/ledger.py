"""Ledgers: equity by day, positions at average cost, first-in first-out redemption by interval overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ledger_equity(prices: DataFrame, trades: DataFrame, deposits: DataFrame) -> DataFrame:
    """date, cash, market_value, equity, pnl.

    prices: date, code, close (filled forward over a dense calendar); trades: date, code, action (buy or
    sell), shares, price, fee; deposits: date, amount.  What lies on no date of the prices is dropped.
    """
    days = prices.select("date").distinct()
    buy = F.col("action") == "buy"
    flow = F.when(buy, -(F.col("shares") * F.col("price") + F.col("fee"))).otherwise(F.col("shares") * F.col("price") - F.col("fee"))
    moves = trades.select("date", flow.alias("amount"), F.lit(0.0).alias("paid")).unionByName(deposits.select("date", F.col("amount").cast("double").alias("amount"), F.col("amount").cast("double").alias("paid")))
    by_day = days.join(moves.groupBy("date").agg(F.sum("amount").alias("amount"), F.sum("paid").alias("paid")), "date", "left")
    # a running sum over the calendar only: as many rows as there are dates
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cash = by_day.select("date", F.coalesce(F.sum("amount").over(w), F.lit(0.0)).alias("cash"), F.coalesce(F.sum("paid").over(w), F.lit(0.0)).alias("paid"))
    step = trades.groupBy("date", "code").agg(F.sum(F.when(buy, F.col("shares")).otherwise(-F.col("shares"))).alias("step"))
    by_code = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = prices.join(trades.select("code").distinct(), "code", "left_semi").join(step, ["date", "code"], "left").withColumn("held", F.coalesce(F.sum("step").over(by_code), F.lit(0.0)))
    worth = held.groupBy("date").agg(F.sum(F.col("held") * F.coalesce("close", F.lit(0.0))).alias("market_value"))
    rows = cash.join(worth, "date", "left").withColumn("market_value", F.coalesce("market_value", F.lit(0.0)))
    return rows.select("date", "cash", "market_value", (F.col("cash") + F.col("market_value")).alias("equity"), (F.col("cash") + F.col("market_value") - F.col("paid")).alias("pnl"))


def ledger_positions(trades: DataFrame) -> DataFrame:
    """code, shares, cost: average cost without fees; a sale relieves cost in proportion and never more than is held.

    Average cost depends on the order of trades, so each code's trades fold in order.
    """
    ordered = F.sort_array(F.collect_list(F.struct("date", "seq", F.when(F.col("action") == "buy", F.col("shares")).otherwise(-F.col("shares")).alias("n"), F.col("price").cast("double").alias("price"))))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("cost"))

    def step(acc, x):
        n = x["n"].cast("double")
        sold = F.least(-n, acc["n"])
        keep = F.when(acc["n"] > 0, 1 - sold / acc["n"]).otherwise(F.lit(0.0))
        return F.when(n > 0, F.struct((acc["n"] + n).alias("n"), (acc["cost"] + n * x["price"]).alias("cost"))).otherwise(F.struct((acc["n"] - sold).alias("n"), (acc["cost"] * keep).alias("cost")))

    out = trades.groupBy("code").agg(F.aggregate(ordered, start, step).alias("x"))
    return out.where("x.n > 1e-9").select("code", F.col("x.n").alias("shares"), F.col("x.cost").alias("cost"))


def fifo_matches(trades: DataFrame) -> DataFrame:
    """code, buy_date, sell_date, shares: which bought shares each sale takes, oldest first.

    Bought and sold shares of a code are intervals of running sums.  Between two neighbouring ends, of either
    kind, lie shares of one purchase and one sale: those whose ends come next.  So one window by code
    matches all, without a join; sales beyond what was bought match nothing.
    """
    run = Window.partitionBy("code", "action").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = trades.where("shares > 0").select("code", "action", "date", F.sum("shares").over(run).alias("end"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("code").orderBy("end", "action")), F.lit(0))
    # backwards, as a frame to the end of a partition would be computed anew for each row
    back = Window.partitionBy("code").orderBy(F.desc("end"), F.desc("action")).rowsBetween(Window.unboundedPreceding, 0)
    following = lambda action: F.last(F.when(F.col("action") == action, F.col("date")), ignorenulls=True).over(back)
    rows = ends.select("code", following("buy").alias("buy_date"), following("sell").alias("sell_date"), (F.col("end") - before).alias("shares"))
    return rows.where("shares > 0 and buy_date is not null and sell_date is not null")
