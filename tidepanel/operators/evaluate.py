"""Evaluation: NAV metrics, information coefficients, quantile groups, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import cs, avg_rank, forward_return, quantile_bucket

DAYS = 244


def nav_metrics(nav: DataFrame, by: list[str], days: int = DAYS) -> DataFrame:
    """total, annual, vol, sharpe, max_drawdown, calmar and win_rate of each series (by, date, nav); nulls below two points."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = nav.where("nav is not null").select(*by, "date", "nav", (F.try_divide(F.col("nav"), F.lag("nav").over(w)) - 1).alias("ret"), (F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("dd"))
    sums = rows.groupBy(*by).agg(
        F.count("ret").alias("n"), (F.try_divide(F.max_by("nav", "date"), F.min_by("nav", "date")) - 1).alias("total"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.min("dd").alias("max_drawdown"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("win_rate")
    )
    sums = sums.withColumns({"annual": F.pow(1 + F.col("total"), F.lit(float(days)) / F.nullif(F.col("n"), F.lit(0))) - 1, "vol": F.col("sd") * F.sqrt(F.lit(float(days)))})
    ok = F.col("n") >= 1
    out = {
        "total": F.col("total"),
        "annual": F.col("annual"),
        "vol": F.col("vol"),
        "sharpe": F.try_divide(F.col("mean") * days, F.col("vol")),
        "max_drawdown": F.col("max_drawdown"),
        "calmar": F.try_divide(F.col("annual"), F.abs("max_drawdown")),
        "win_rate": F.col("win_rate"),
    }
    return sums.select(*by, "n", *[F.when(ok, c).alias(k) for k, c in out.items()])


def drawdowns(nav: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("drawdown", F.try_divide(F.col("nav"), F.max("nav").over(w)) - 1)


def labelled(panel: DataFrame, factor: str, horizon: int, price: str = "close") -> DataFrame:
    """date, code, factor, fwd: rows that have both."""
    return panel.select("date", "code", F.col(factor).alias("factor"), forward_return(price, horizon).alias("fwd")).where("factor is not null and fwd is not null")


def rank_ic(rows: DataFrame, min_n: int = 10) -> DataFrame:
    """date, n, ic: the correlation of ranks on each date with enough rows and more than one value on both sides."""
    ranked = rows.select("date", avg_rank("factor").alias("rf"), avg_rank("fwd").alias("rr"))
    flat = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.min("rf").alias("f0"), F.max("rf").alias("f1"), F.min("rr").alias("r0"), F.max("rr").alias("r1"), F.covar_pop("rf", "rr").alias("cov"), F.stddev_pop("rf").alias("sf"), F.stddev_pop("rr").alias("sr"))
    return flat.where((F.col("n") >= min_n) & (F.col("f0") < F.col("f1")) & (F.col("r0") < F.col("r1"))).select("date", "n", (F.col("cov") / (F.col("sf") * F.col("sr"))).alias("ic"))


def ic_summary(ic: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    agg = ic.groupBy(*by).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"))
    return agg.select(*by, "n", "mean", "std", F.try_divide(F.col("mean"), F.col("std")).alias("icir"), F.try_divide(F.col("mean") * F.sqrt("n"), F.col("std")).alias("t"), "win_rate")


def group_returns(rows: DataFrame, groups: int = 5, min_n: int = 10) -> DataFrame:
    """date, bucket, n, ret: mean forward returns of the quantile groups of the factor."""
    enough = rows.withColumn("_n", F.count(F.lit(1)).over(cs())).where(F.col("_n") >= max(min_n, 2 * groups))
    return enough.withColumn("bucket", quantile_bucket("factor", groups)).groupBy("date", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("ret"))


def group_spread(by_date: DataFrame, horizon: int, days: int = DAYS) -> DataFrame:
    """The mean of each bucket, and of the top less the bottom one, per horizon and annualised."""
    means = by_date.groupBy("bucket").agg(F.avg("ret").alias("ret"))
    return means.agg(F.max_by("ret", "bucket").alias("top"), F.min_by("ret", "bucket").alias("bottom")).select("top", "bottom", (F.col("top") - F.col("bottom")).alias("spread"), ((F.col("top") - F.col("bottom")) * (days / horizon)).alias("annual_spread"))


def directed(summary: DataFrame, ascending: bool, *values: str) -> DataFrame:
    """Values of a factor's quality with the sign of its direction: a factor whose low values are good counts the other way round."""
    return summary.withColumns({v: F.col(v) * (-1.0 if ascending else 1.0) for v in values})


def alignment(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """n, mismatches and max_diff of a value over the keys that both tables have."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    diff = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(diff > tolerance).alias("mismatches"), F.max(diff).alias("max_diff"))


def turnover(by_bucket: DataFrame) -> DataFrame:
    """The share of a bucket's codes that were not in it on the date before (t_idx, code, bucket)."""
    before = by_bucket.select((F.col("t_idx") + 1).alias("t_idx"), "code", "bucket", F.lit(1).alias("_was"))
    return by_bucket.join(before, ["t_idx", "code", "bucket"], "left").groupBy("t_idx", "bucket").agg((1 - F.count("_was") / F.count(F.lit(1))).alias("turnover"))


def brinson(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """month, industry, allocation, selection, interaction from prices (date, code, close, industry) and weights (month, code, weight).

    A code's month return runs from the month's first to its last close; the benchmark weighs codes equally.
    """
    month = F.trunc("date", "month").alias("month")
    seen = panel.where("close > 0")
    edge = seen.select(month).distinct()
    moves = seen.groupBy(month, "code", "industry").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("ret"))
    rows = moves.join(weights, ["month", "code"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = F.count(F.lit(1)).over(Window.partitionBy("month"))
    per = rows.withColumn("_all", total).groupBy("month", "industry").agg(F.sum("weight").alias("cw"), (F.count(F.lit(1)) / F.first("_all")).alias("bw"), F.sum(F.col("weight") * F.col("ret")).alias("wr"), F.avg("ret").alias("bench"))
    per = per.withColumn("combo", F.when(F.col("cw") > 0, F.col("wr") / F.col("cw")).otherwise(0.0))
    held = per.groupBy("month").agg(F.sum("cw").alias("held")).where("held > 0")
    per = per.join(held.select("month"), "month", "left_semi").join(edge, "month", "left_semi")
    over, better = F.col("cw") - F.col("bw"), F.col("combo") - F.col("bench")
    return per.select("month", "industry", (over * F.col("bench")).alias("allocation"), (F.col("bw") * better).alias("selection"), (over * better).alias("interaction"))


def brinson_total(effects: DataFrame) -> DataFrame:
    names = ("allocation", "selection", "interaction")
    return effects.groupBy("industry").agg(*[F.sum(n).alias(n) for n in names], *[F.avg(n).alias(f"mean_{n}") for n in names])


def quality(panel: DataFrame, factor: str, horizon: int = 20, groups: int = 5, min_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The IC summary and the spread of a factor."""
    rows = labelled(panel, factor, horizon)
    return ic_summary(rank_ic(rows, min_n)), group_spread(group_returns(rows, groups, min_n), horizon)
