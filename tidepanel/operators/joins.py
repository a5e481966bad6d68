"""Joins of panels: point-in-time, year over year, incremental merges, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import zero_filled


def asof(panel: DataFrame, events: DataFrame, values: list[str], on: str = "code", time: str = "date", event_time: str = "ann_date") -> DataFrame:
    """Each panel row with the last known value of each column whose event time is not after it.

    The union of both sides goes through one window by key, so nothing is joined by range; a null value
    never replaces a known one, and events of the same day come before the panel's row.  Of a day's events
    the last in `seq` counts, or without such a column, and among equal ones, the largest value.
    """
    seq = F.col("seq") if "seq" in events.columns else F.lit(0)
    last = events.groupBy(on, event_time).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(seq, F.col(v)))).alias(v) for v in values])
    other = [c for c in panel.columns if c not in (on, time)]
    left = panel.select(on, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*other).alias("_row") if other else F.struct(F.lit(0).alias("_none")).alias("_row"), *[F.lit(None).cast(events.schema[v].dataType).alias(v) for v in values])
    right = last.select(on, F.col(event_time).cast(panel.schema[time].dataType).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *values)
    w = Window.partitionBy(on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = left.unionByName(right).withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    return filled.where("_side = 1").select(on, F.col("_t").alias(time), *[F.col(f"_row.{c}").alias(c) for c in other], *values)


def year_over_year(statements: DataFrame, value: str, keys: list[str], year: str = "year", limit: float = 10.0) -> DataFrame:
    """value over the same period of the year before, less 1; null at `limit` and beyond."""
    before = statements.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias("_before"))
    rows = statements.join(before, [*keys, year], "left")
    g = F.try_divide(F.col(value), F.col("_before")) - 1
    return rows.withColumn(f"{value}_yoy", F.when(F.abs(g) < limit, g)).drop("_before")


def anti_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key it doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def anchor_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value is different, missing or new: key, old_value, new_value."""
    a = old.select(F.col(key).alias("_a"), F.col(value).alias("old_value"))
    b = new.select(F.col(key).alias("_b"), F.col(value).alias("new_value"))
    rows = a.join(b, F.col("_a") == F.col("_b"), "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return rows.select(F.coalesce("_a", "_b").alias(key), "old_value", "new_value")


def incremental_panel(old: DataFrame, raw: DataFrame, affected: DataFrame, compute, tail_days: int = 45) -> DataFrame:
    """old without the affected codes, those recomputed in full, and the others' new dates, computed over a tail of raw dates."""
    keep = old.join(affected.select("code"), "code", "left_anti")
    edge = F.broadcast(keep.agg(F.max("date").alias("_edge")))
    fresh = compute(raw.join(affected.select("code"), "code", "left_semi"))
    rest = raw.join(affected.select("code"), "code", "left_anti").join(edge)
    recent = rest.where(F.col("_edge").isNull() | (F.col("date") >= F.date_sub("_edge", tail_days)))
    more = compute(recent.drop("_edge")).join(edge).where(F.col("_edge").isNull() | (F.col("date") > F.col("_edge"))).drop("_edge")
    return keep.unionByName(fresh.select(*old.columns)).unionByName(more.select(*old.columns))


def daily_rows(daily: DataFrame, basic: DataFrame, factor: DataFrame, keys: tuple[str, ...] = ("ts_code", "trade_date")) -> DataFrame:
    """Daily bars with the day's basic figures (but their close) and adjustment factor, null where those lack the key."""
    more = basic.select(*keys, *[c for c in basic.columns if c not in daily.columns and c != "close"])
    return daily.join(more, list(keys), "left").join(factor.select(*keys, "adj_factor"), list(keys), "left")


def reanchored(panel: DataFrame, old: DataFrame, new: DataFrame, rebuild) -> DataFrame:
    """The panel with the codes whose last adjustment factor (code, last_adj) has changed, or is new, rebuilt as a whole; the others as they are."""
    changed = anchor_diff(old, new, "code", "last_adj").select("code")
    return panel.join(changed, "code", "left_anti").unionByName(rebuild(changed).select(*panel.columns))


def with_scores(panel: DataFrame, scores: DataFrame, name: str = "pred") -> DataFrame:
    """The panel with external scores (date, code, score) as a factor: codes filled with zeros, of repeated keys the largest score; null where there is none."""
    if "score" not in scores.columns:
        raise ValueError("external scores need the columns date, code, score")
    own = scores.groupBy(F.col("date").cast("date").alias("date"), zero_filled(F.col("code")).alias("code")).agg(F.max("score").alias(name))
    return panel.join(own, ["date", "code"], "left")


def min_history(panel: DataFrame, start: str, days: int, n: int) -> DataFrame:
    """The rows of codes that have at least n bars before start - days."""
    old = panel.groupBy("code").agg(F.count_if(F.col("date") < F.date_sub(F.lit(start).cast("date"), days)).alias("_n")).where(F.col("_n") >= n)
    return panel.join(old.select("code"), "code", "left_semi")


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str, default: str = "") -> DataFrame:
    """A name looked up in a dimension table, or the default."""
    return rows.join(names.select(key, F.col(name).alias("_name")), key, "left").withColumn(name, F.coalesce("_name", F.lit(default))).drop("_name")
