"""Stateful books as tables: run archive, strategy pool, registry, paper accounts.

Tables are DataFrames in, DataFrames out; upserts are unions that keep the latest row of a key, as plain
parquet has no MERGE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.panels import dedupe_last


@dataclass(frozen=True)
class Strategy:
    name: str
    factor: str
    ascending: bool
    assets: tuple[str, ...]
    options: tuple[tuple[str, object], ...] = ()


def registry() -> list[Strategy]:
    """The named strategies: a factor, a direction, asset types and options."""
    both, every = ("stock", "etf"), ("stock", "etf", "fund")
    out = [
        Strategy("turnover_low", "turn20", True, both),
        Strategy("amount_high", "am20", False, both),
        Strategy("amount_low", "am20", True, both),
        Strategy("amount_low_one_per_industry", "am20", True, both, (("industry_cap", 1),)),
    ]
    for a, b in ((5, 10), (5, 20), (10, 30), (20, 60)):
        out += [Strategy(f"ma{a}_{b}_{'low' if up else 'high'}", f"ma_cross{a}_{b}", up, both) for up in (False, True)]
    out += [
        Strategy("ma20_30_high", "ma_cross20_30", False, both),
        Strategy("ma20_30_high_trending", "ma_cross20_30", False, both, (("adx_filter", 25.0),)),
        Strategy("composite_low", "composite", True, both),
        Strategy("mom20_long_short", "mom20", False, both, (("long_short", True), ("short_n", 3), ("short_cost_rate", 0.086))),
        Strategy("turnover_long_short", "turn20", True, both, (("long_short", True), ("short_n", 3), ("short_cost_rate", 0.086))),
        Strategy("mom20_high", "mom20", False, every),
        Strategy("mom20_low", "mom20", True, every),
        Strategy("mom60_high", "mom60", False, every),
        Strategy("mom60_half_year_top1", "mom60", False, every),
        Strategy("mom60_half_year_top3", "mom60", False, every),
        Strategy("vol20_low", "vol20", True, every),
        Strategy("pred_high", "pred", False, ("stock",)),
        Strategy("pred_low", "pred", True, ("stock",)),
    ]
    out += [Strategy(f"{f}_high", f, False, ("fund",)) for f in ("mdd20", "sharpe20", "sortino20", "mom_accel", "nav_stability")]
    return [*out, Strategy("fund_composite_low", "composite", True, ("fund",))]


def applicable(asset: str) -> list[Strategy]:
    return [s for s in registry() if asset in s.assets]


#: Factors for free combination, with the asset types that have them.
FACTOR_CATALOG: dict[str, tuple[str, ...]] = {
    **{f: ("stock", "etf") for f in ("turn20", "am20", "ma_cross5_10", "ma_cross5_20", "ma_cross10_30", "ma_cross20_30", "ma_cross20_60")},
    **{f: ("stock", "etf", "fund") for f in ("mom20", "mom60", "vol20", "composite")},
    **{f: ("fund",) for f in ("mdd20", "sharpe20", "sortino20", "mom_accel", "nav_stability")},
    **{f: ("stock",) for f in ("pb", "ep", "roe", "gross_margin", "rev_yoy", "np_yoy")},
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    both = old.withColumn("_r", F.lit(0)).unionByName(new.withColumn("_r", F.lit(1)))
    return dedupe_last(both, keys, [F.col("_r")]).drop("_r")


def first_rows(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The first row of each key by `order`, then by all other columns that can be compared, so that it is always the same one."""
    rest = [F.asc_nulls_last(c) for c in [*(order or []), *(x for x, kind in rows.dtypes if x not in keys and not kind.startswith("map"))]]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(rest or [F.lit(0)])))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def insert_once(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """old and those rows of new whose key it hasn't: of each key the first by `order`, then by all columns."""
    first = first_rows(new, keys, order)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def archive_row(runs: DataFrame) -> DataFrame:
    """Runs (run_id, kind, created_at, params struct, metrics struct) as archive rows with JSON text."""
    as_json = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"})
    return runs.select("run_id", "kind", "created_at", as_json("params").alias("params"), as_json("metrics").alias("metrics"))


def archive_list(archive: DataFrame, limit: int = 50, kind: str | None = None) -> DataFrame:
    rows = archive if kind is None else archive.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("created_at"), "run_id").limit(limit)


def archive_get(archive: DataFrame, run_id: str) -> DataFrame:
    """The run of an id, if there is one."""
    return archive.where(F.col("run_id") == run_id)


def archive_delete(archive: DataFrame, run_id: str) -> DataFrame:
    """The archive without a run."""
    return archive.where(~F.col("run_id").eqNullSafe(run_id))


def latest_runs(archive: DataFrame) -> DataFrame:
    """name, runs, params and metrics of the latest run of each strategy name in the archive's parameters."""
    named = archive.withColumn("name", F.coalesce(F.nullif(F.get_json_object("params", "$.strategy"), F.lit("")), F.get_json_object("params", "$.factor"), F.lit("")))
    last = lambda c: F.max_by(c, F.struct("created_at", "run_id")).alias(c)
    return named.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("runs"), last("params"), last("metrics"))


def pool(names: DataFrame, archive: DataFrame, trash: DataFrame) -> DataFrame:
    """Registered strategies with their runs, and archived ones that aren't registered, less those in the trash, in order of position, then name."""
    runs = latest_runs(archive)
    known = names.join(runs, "name", "left").withColumn("registered", F.lit(True))
    rest = runs.join(names.select("name"), "name", "left_anti").withColumn("registered", F.lit(False)).withColumn("position", F.lit(None).cast("long"))
    both = known.select("name", "position", "registered", F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), "params", "metrics").unionByName(rest.select("name", "position", "registered", F.col("runs").cast("long").alias("runs"), "params", "metrics"))
    return both.join(trash.select("name"), "name", "left_anti").orderBy(F.asc_nulls_last("position"), "name")


def reordered(names: DataFrame, order: list[str]) -> DataFrame:
    """Positions by the given order; others keep theirs behind it."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("name")) if order else F.lit(0)
    return names.withColumn("position", F.when(at > 0, at).otherwise(F.coalesce("position", F.lit(0)) + len(order) + 1).cast("long"))


def rebalance_due(last: str | None, today: str, freq: str) -> bool:
    """Is a paper account due?  Never traded: yes; daily: another day; weekly: another ISO week; monthly: another month; semiannual: another month that is March or September."""
    from datetime import date

    if last is None:
        return True
    a, b = date.fromisoformat(last), date.fromisoformat(today)
    return {"daily": a != b, "weekly": a.isocalendar()[:2] != b.isocalendar()[:2], "monthly": (a.year, a.month) != (b.year, b.month), "semiannual": (a.year, a.month) != (b.year, b.month) and b.month in (3, 9)}[freq]


def order_trades(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """Orders with their trade's price and shares where they have none of their own."""
    t = trades.groupBy("order_id").agg(F.sum("shares").alias("_n"), F.try_divide(F.sum(F.col("shares") * F.col("price")), F.sum("shares")).alias("_p"))
    return orders.join(t, "order_id", "left").withColumns({"shares": F.coalesce("shares", "_n"), "price": F.coalesce("price", "_p")}).drop("_n", "_p")


def positions_valued(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions with the code's last price and their value."""
    last = prices.where("close is not null").groupBy("code").agg(F.max_by("close", "date").alias("price"))
    return positions.join(last, "code", "left").withColumn("value", F.col("shares") * F.col("price"))


def run_number(archive: DataFrame) -> DataFrame:
    return archive.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("created_at", "run_id")))
