"""Fund lists and fee rules: which funds a universe takes, and redemption rules read from the text of their periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of fund types that a universe keeps or drops, and of names that it drops (exchange-traded funds).
KEEP_TYPES, DROP_TYPES, DROP_NAMES = "股票|混合|指数|QDII", "债券|货币|理财|FOF|固收|商品|债", "ETF"
# The words of a period that bound the days held from above (exclusive) and from below.
BELOW, FROM = "小于", "大于等于"


def fund_universe(funds: DataFrame, keep: str = KEEP_TYPES, drop: str = DROP_TYPES, drop_names: str = DROP_NAMES, keywords: list[str] | None = None) -> DataFrame:
    """code, name, type of the funds whose type matches `keep` and not `drop`, and whose name lacks drop_names and has a keyword, if any are given.

    A null type or name matches nothing; of rows that repeat a code the least by name and type counts.
    """
    has = lambda c, pattern: F.coalesce(F.rlike(c, F.lit(pattern)), F.lit(False))
    ok = has("type", keep) & ~has("type", drop) & ~has("name", drop_names)
    if keywords:
        ok = ok & has("name", "|".join(keywords))
    return funds.where(ok).groupBy("code").agg(F.min(F.struct("name", "type")).alias("f")).select("code", "f.name", "f.type")


def period_rule(period: Column, rate: Column, below: str = BELOW, least: str = FROM) -> Column:
    """A struct of period, rate, min_days and max_days_exclusive: the first number where the text says `least`, the last where it says `below`; null without a period or a rate."""
    text = F.trim(period)
    days = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    rule = F.struct(
        text.alias("period"),
        rate.alias("rate"),
        F.when(F.contains(text, F.lit(least)), F.get(days, F.lit(0))).alias("min_days"),
        F.when(F.contains(text, F.lit(below)), F.get(days, F.size(days) - 1)).alias("max_days_exclusive"),
    )
    return F.when((text != "") & rate.isNotNull(), rule)


def redemption_rules(fees: DataFrame) -> DataFrame:
    """code and the JSON list of its rules (code, seq, period, rate), in order."""
    rows = fees.withColumn("rule", period_rule(F.col("period"), F.col("rate"))).where("rule is not null")
    return rows.groupBy("code").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("seq", "rule"))), lambda x: x["rule"])).alias("rules"))
