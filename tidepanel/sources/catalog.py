"""Table schemas, views, the read-only SQL endpoint, file statistics, coverage."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


PANEL = "date date, code string, open double, high double, low double, close double, turnover double, amount double, turn20 double, am20 double, volume double"
# The columns of the raw daily table.
_DAILY = "open high low close pre_close change pct_chg vol amount turnover_rate turnover_rate_f volume_ratio pe pe_ttm pb ps ps_ttm dv_ratio dv_ttm total_share float_share free_share total_mv circ_mv adj_factor"
SCHEMAS: dict[str, str] = {
    "panel": PANEL,
    "daily": "ts_code string, trade_date date, " + ", ".join(f"{c} double" for c in _DAILY.split()),
    "stock_basic": "ts_code string, symbol string, name string, area string, industry string, market string, list_date date, updated_at timestamp",
    "trade_cal": "exchange string, cal_date date, is_open bigint, pretrade_date date",
    "last_adj": "ts_code string, ref_date date, last_adj double",
    "universe": "code string, name string",
    "tech": "code string, name string, industry string",
    "index": "date date, code string, name string, open double, close double",
    "fina_indicator": "ts_code string, ann_date date, end_date date, bps double, eps double, roe_waa double, grossprofit_margin double",
    "income": "ts_code string, ann_date date, end_date date, revenue double, n_income_attr_p double",
    "fund_nav": "date date, code string, nav double",
    "pred": "date date, code string, score double",
    "articles": "code string, publish_time timestamp, source string, title string, label string, score double, media string, url string",
    "ledger_transactions": "date date, code string, name string, action string, shares double, price double, fee double, note string",
    "ledger_deposits": "date date, amount double, note string",
    "backtest_runs": "run_id string, kind string, created_at timestamp, params string, metrics string",
}


def read_table(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    """A table of the catalog with its declared schema; codes in CSV files stay strings."""
    reader = spark.read.schema(schema(SCHEMAS[name]))
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.parquet(path)


def register(spark: SparkSession, root: str, names: list[str] | Mapping[str, str]) -> list[str]:
    """Views over <root>/<name>.parquet (or the given paths)."""
    paths = dict(names) if isinstance(names, Mapping) else {n: f"{root}/{n}.parquet" for n in names}
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return list(paths)


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.tableType) for t in spark.catalog.listTables()], "name string, kind string")


class NotReadOnly(ValueError):
    """A statement that is no single SELECT."""


def guarded(sql: str) -> str:
    """The statement if it is one SELECT or WITH; strings and comments are no part of the test."""
    text = sql.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    if ";" in bare or not re.match(r"(?is)\s*(select|with)\b", bare):
        raise NotReadOnly("only a single SELECT is allowed")
    if re.search(r"(?i)\b(insert|update|delete|merge|create|drop|alter|truncate|load|refresh|cache|set|use)\b\s+(into|overwrite|table|view|database|schema|from|\w+\s*=)", bare):
        raise NotReadOnly("only a single SELECT is allowed")
    return text


def query(spark: SparkSession, sql: str, limit: int = 1000, as_text: bool = False, **args) -> DataFrame:
    """A read-only query with named parameters, cut to `limit` rows."""
    out = spark.sql(guarded(sql), args=args or None).limit(limit)
    return out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in out.columns]) if as_text else out


def panel_where(rows: DataFrame, start: str | None = None, end: str | None = None, codes: list[str] | None = None) -> DataFrame:
    """Filters that reach the scan."""
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows if codes is None else rows.where(F.col("code").isin(codes))


def load_panel(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, codes: list[str] | None = None, buffer_days: int = 40) -> DataFrame:
    """The precomputed panel where no dates are given, else the raw one from buffer_days before, with rolling columns, cut to the dates."""
    from .panels import rolling_base, with_lookback

    if start is None and end is None:
        return panel_where(read_table(spark, "panel", f"{root}/panel.parquet"), codes=codes)
    raw = panel_where(read_table(spark, "panel", f"{root}/panel.parquet").drop("turn20", "am20"), codes=codes)
    return with_lookback(raw, start or "1900-01-01", end or "9999-12-31", buffer_days, rolling_base)


def require_basis(rows: DataFrame, basis: str = "qfq", column: str = "price_basis") -> DataFrame:
    """The rows; reading one of another price basis is an error."""
    ok = F.assert_true(F.col(column).eqNullSafe(F.lit(basis)), F.lit(f"price basis must be {basis}"))
    return rows.where(F.isnull(ok))


def validate_panel(rows: DataFrame) -> DataFrame:
    """One row of counts: rows, codes, dates, rows with impossible prices, repeated keys."""
    bad = (F.col("close") <= 0) | (F.col("open") <= 0) | (F.col("high") < F.col("low"))
    keys = F.count_distinct(F.struct("date", "code"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("codes"), F.count_distinct("date").alias("dates"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_prices"), (F.count(F.lit(1)) - keys).alias("repeated"))


def freshness(rows: DataFrame, date_column: str) -> DataFrame:
    """Rows and last date; parquet footers answer it where aggregates are pushed down."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(date_column).alias("last"))


def coverage(rows: DataFrame, ok: str, fields: list[str]) -> DataFrame:
    """Rows, rows for which `ok` holds, and the share of values that are not blank in each field."""
    filled = lambda c: F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(ok)).alias("ok_rows"), *[F.round(100.0 * filled(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias(f"{c}_pct") for c in fields])


def sync_decision(local: DataFrame, calendar: DataFrame, today: str, max_lag: int = 1) -> DataFrame:
    """last, lag (open days behind) and action: `none` up to max_lag, `increment` up to 30 days, else `full`."""
    edge = local.agg(F.max("date").alias("last"))
    open_days = calendar.where((F.col("is_open") == 1) & (F.col("cal_date") <= F.lit(today).cast("date")))
    rows = open_days.crossJoin(F.broadcast(edge)).agg(F.max("last").alias("last"), F.count_if(F.col("last").isNull() | (F.col("cal_date") > F.col("last"))).alias("lag"))
    return rows.withColumn("action", F.when(F.col("last").isNull(), "full").when(F.col("lag") <= max_lag, "none").when(F.col("lag") <= 30, "increment").otherwise("full"))
