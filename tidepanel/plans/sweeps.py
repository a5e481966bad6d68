"""Parameter sweeps and walk-forward tests as scenario tables."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import nav_metrics
from .backtest import event_backtest, reached, run_scenarios


def split_windows(dates: list[date], folds: int) -> list[tuple[date, date]]:
    """Consecutive folds of nearly equal numbers of dates; the last takes the rest."""
    size = max(1, len(dates) // folds)
    edges = [i * size for i in range(folds)] + [len(dates)]
    return [(dates[a], dates[b - 1]) for a, b in zip(edges, edges[1:]) if b > a]


def scenario_table(spark: SparkSession, scenarios: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in scenarios.items()], "scenario_id string, params string")


def cross_grid(shorts: list[int], longs: list[int], **more) -> dict[str, dict]:
    """Scenarios of the golden cross for all short < long."""
    return {f"{a}x{b}": {"strategy": "golden_cross", "short": a, "long": b, **more} for a in shorts for b in longs if a < b}


def sweep(quotes: DataFrame, scenarios: dict[str, dict], folds: list[tuple[date, date]] | None = None, simulate=event_backtest) -> DataFrame:
    """Metrics of every scenario, by fold where there are any: scenario_id, fold, and nav_metrics.

    A fold is a run of its own: whole capital at its first day, prices before it as warm-up only.
    """
    runs = scenarios if not folds else {f"{k}@{i}": {**v, "start": str(lo), "end": str(hi)} for k, v in scenarios.items() for i, (lo, hi) in enumerate(folds)}
    table = scenario_table(quotes.sparkSession, runs)
    nav = run_scenarios(reached(quotes, table) if simulate is event_backtest else quotes, table, simulate)
    if folds:
        nav = nav.withColumns({"fold": F.substring_index("scenario_id", "@", -1).cast("int"), "scenario_id": F.regexp_replace("scenario_id", "@[0-9]+$", "")})
    else:
        nav = nav.withColumn("fold", F.lit(0))
    return nav_metrics(nav, ["scenario_id", "fold"])


def summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, deviation and range of totals and Sharpe ratios over folds, best first."""
    agg = metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("total").alias("mean_total"), F.median("total").alias("median_total"), F.stddev_samp("total").alias("std_total"), F.min("total").alias("min_total"), F.max("total").alias("max_total"), F.avg("sharpe").alias("mean_sharpe"), F.avg((F.col("total") > 0).cast("double")).alias("win_rate")
    )
    return agg.orderBy(F.desc_nulls_last("mean_sharpe"), F.desc_nulls_last("mean_total"), *by)


def heatmap(metrics: DataFrame, row: str, column: str, value: str) -> DataFrame:
    return metrics.groupBy(row).pivot(column).agg(F.avg(value)).orderBy(row)


def rolling_choice(metrics: DataFrame) -> DataFrame:
    """For each fold after the first: the scenario of the best Sharpe ratio in the fold before, and how it did in this one."""
    best = metrics.where("sharpe is not null").groupBy("fold").agg(F.max_by("scenario_id", F.struct("sharpe", "total", "scenario_id")).alias("scenario_id"), F.max("sharpe").alias("train_sharpe"))
    test = metrics.select(F.col("fold"), "scenario_id", F.col("total").alias("test_total"), F.col("sharpe").alias("test_sharpe"))
    return best.withColumn("fold", F.col("fold") + 1).join(test, ["fold", "scenario_id"]).orderBy("fold")
