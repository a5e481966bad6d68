"""The registered queries: each pairs a plan over the driver's tables with the SQL that must give the same rows.

The weekly panel has suppliers as codes and weeks as dates (lineitem); the daily panel has users as codes
(events); nations stand for industries; orders serve as announcements and deposits.  Results that come
from sums of floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.windows import cs, change, ffill, forward_return, pct_rank, quantile_bucket, ratio, rolling, zscore
from ..operators import books, evaluate, factors, joins, ledger, research, selection
from ..sources import catalog, panels
from ..streaming import incremental
from . import backtest, sweeps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---------------------------------------------------------------- shared plans
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly_panel(spark, sf_dir)


def dense_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense weekly panel with ret."""
    return panels.dense_panel(spark, sf_dir)


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(S.zero_filled(F.col("s_suppkey")).alias("code"), F.col("n_name").alias("industry"))


def rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def significant(df: DataFrame, *names: str) -> DataFrame:
    """Nine significant digits, for values of any size."""
    return df.withColumns({n: F.format_string("%.8e", n).cast("double") for n in names})


def picked(df: DataFrame, *names: str) -> DataFrame:
    """date, code and rounded columns, of rows that have any of them."""
    return rounded(df.where(F.coalesce(*[F.col(n).cast("double") for n in names]).isNotNull()).select("date", "code", *names), *names)




# ---------------------------------------------------------------- shared SQL
CODE = "lpad(CAST({0} AS VARCHAR), greatest(6, length(CAST({0} AS VARCHAR)))::INTEGER, '0')"
WEEK = f"""
trades AS (
  SELECT {CODE.format('l_suppkey')} AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, *
  FROM lineitem WHERE l_quantity > 0),
bars AS (
  SELECT code, date,
    first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open,
    max(price) AS high, min(price) AS low,
    last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM trades GROUP BY code, date),
wk AS (
  SELECT *, volume / 100.0 AS turnover,
    CASE WHEN count(volume) OVER w20 >= 15 THEN CAST(sum(CAST(volume / 100.0 AS DECIMAL(18,4))) OVER w20 AS DOUBLE) / count(volume) OVER w20 END AS turn20,
    CASE WHEN count(amount) OVER w20 >= 15 THEN CAST(sum(CAST(amount AS DECIMAL(18,4))) OVER w20 AS DOUBLE) / count(amount) OVER w20 END AS am20
  FROM bars WINDOW w20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
DENSE = (
    WEEK
    + """,
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t_idx FROM (SELECT DISTINCT date FROM wk)),
dense0 AS (
  SELECT c.code, cal.date, cal.t_idx, wk.open, wk.high, wk.low, wk.close, wk.volume, wk.amount, wk.turnover, wk.turn20, wk.am20
  FROM (SELECT DISTINCT code FROM wk) c CROSS JOIN cal LEFT JOIN wk ON wk.code = c.code AND wk.date = cal.date),
dense AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM dense0)"""
)
INDUSTRY = f"ind AS (SELECT {CODE.format('s_suppkey')} AS code, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
TS = "PARTITION BY code ORDER BY date"


def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    """The SQL of rolling()."""
    w = f"OVER ({TS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {fn}({x}) {w} END"


def lagged(x: str, n: int) -> str:
    return f"{x} / nullif(lag({x}, {n}) OVER ({TS}), 0) - 1"


def rank_sql(x: str, by: str = "date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def pct_sql(x: str, by: str = "date") -> str:
    return f"({rank_sql(x, by)}) / count({x}) OVER (PARTITION BY {by})"


def factor_query(name: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of factor columns over the dense weekly panel."""
    sql = ", ".join(f"{expr} AS {c}" for c, (_, expr) in columns.items())
    out = ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in columns)
    oracle = f"WITH {DENSE}, f AS (SELECT date, code, {sql} FROM dense) SELECT date, code, {out} FROM f WHERE coalesce({', '.join(columns)}) IS NOT NULL"

    @register(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return picked(dense_week(spark, sf_dir).withColumns({c: e() for c, (e, _) in columns.items()}), *columns)


def cross_sql(a: int, b: int) -> str:
    return f"({roll('avg', 'close', a)}) / nullif({roll('avg', 'close', b)}, 0) - 1"


# ---------------------------------------------------------------- panels
@register("bars_weekly", f"WITH {WEEK} SELECT date, code, open, high, low, close, volume, amount, turnover FROM wk")
def bars_weekly(spark, sf_dir):
    return panels.weekly_bars(table(spark, sf_dir, "lineitem")).select("date", "code", "open", "high", "low", "close", "volume", "amount", "turnover")


DAY = f"""days AS (
  SELECT {CODE.format('user_id')} AS code, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM events GROUP BY 1, 2)"""


@register("bars_daily", f"WITH {DAY} SELECT date, code, open, high, low, close, volume, amount FROM days")
def bars_daily(spark, sf_dir):
    return panels.daily_bars(table(spark, sf_dir, "events")).select("date", "code", "open", "high", "low", "close", "volume", "amount")


@register("scaffold_ffill", f"WITH {DENSE} SELECT date, code, t_idx, last_value(close IGNORE NULLS) OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close_ff FROM dense0")
def scaffold_ffill(spark, sf_dir):
    rows = panels.dense(panels.bars_of(spark, sf_dir))
    return rows.select("date", "code", "t_idx", ffill("close").alias("close_ff"))


@register("turn20_am20", f"WITH {WEEK} SELECT date, code, turn20, am20 FROM wk WHERE turn20 IS NOT NULL")
def turn20_am20(spark, sf_dir):
    return week(spark, sf_dir).where("turn20 is not null").select("date", "code", "turn20", "am20")


@register("panel_lookback", f"WITH {WEEK} SELECT date, code, am20 FROM wk WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND am20 IS NOT NULL")
def panel_lookback(spark, sf_dir):
    rows = panels.with_lookback(panels.bars_of(spark, sf_dir), "1998-01-01", "1998-12-31", 3650, panels.rolling_base)
    return rows.where("am20 is not null").select("date", "code", "am20")


@register("panel_tail", f"WITH {WEEK} SELECT date, code, close FROM wk QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 5")
def panel_tail(spark, sf_dir):
    return panels.tail(panels.bars_of(spark, sf_dir), 5).select("date", "code", "close")


@register(
    "panel_info",
    f"""WITH {WEEK} SELECT count(*) AS n, count(DISTINCT code) AS codes, count(DISTINCT date) AS dates,
    count(*) FILTER (WHERE close <= 0 OR open <= 0 OR high < low) AS bad_prices, count(*) - count(DISTINCT (date, code)) AS repeated FROM wk""",
)
def panel_info(spark, sf_dir):
    return catalog.validate_panel(panels.bars_of(spark, sf_dir))


@register("table_freshness", "SELECT count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last FROM orders")
def table_freshness(spark, sf_dir):
    return catalog.freshness(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("last", F.col("last").cast("date"))


@register(
    "coverage_stats",
    """SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS ok_rows, round(100.0 * count(*) FILTER (WHERE trim(c_name) <> '') / count(*), 4) AS c_name_pct,
    round(100.0 * count(*) FILTER (WHERE trim(c_mktsegment) <> '') / count(*), 4) AS c_mktsegment_pct FROM customer""",
)
def coverage_stats(spark, sf_dir):
    return catalog.coverage(table(spark, sf_dir, "customer"), "c_acctbal > 0", ["c_name", "c_mktsegment"])


@register("sql_endpoint", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sql_endpoint(spark, sf_dir):
    catalog.register(spark, sf_dir, ["nation"])
    return catalog.query(spark, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = :region", as_text=True, region=1)


@register("universe_filter", f"WITH {WEEK}, {INDUSTRY} SELECT w.date, w.code, w.close FROM wk w SEMI JOIN (SELECT code FROM ind WHERE industry IN ('NATION_1', 'NATION_2', 'NATION_3')) u USING (code)")
def universe_filter(spark, sf_dir):
    chosen = industries(spark, sf_dir).where(F.col("industry").isin("NATION_1", "NATION_2", "NATION_3"))
    return panels.bars_of(spark, sf_dir).join(chosen, "code", "left_semi").select("date", "code", "close")


# ---------------------------------------------------------------- factors
factor_query("mom20_mom60", {"mom20": (lambda: factors.momentum(20), lagged("close", 20)), "mom60": (lambda: factors.momentum(60), lagged("close", 60))})
factor_query("vol20", {"vol20": (lambda: factors.volatility(20), roll("stddev_samp", "ret", 20))})
factor_query("ma_cross", {f"ma_cross{a}_{b}": (lambda a=a, b=b: factors.ma_cross(a, b), cross_sql(a, b)) for a, b in ((5, 10), (5, 20), (10, 30), (20, 30), (20, 60))})
factor_query("ma_cross_dynamic", {"ma_cross3_7": (lambda: factors.ma_cross_by_name("ma_cross3_7"), cross_sql(3, 7))})
factor_query("mdd", {f"mdd{n}": (lambda n=n: factors.window_drawdown(n), f"close / nullif(max(close) OVER ({TS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) - 1") for n in (20, 60)})
DOWN = "CASE WHEN ret IS NOT NULL THEN least(ret, 0.0) END"
factor_query(
    "sharpe_sortino",
    {
        "sharpe10": (lambda: factors.sharpe(10), f"({roll('avg', 'ret', 10)}) / nullif({roll('stddev_samp', 'ret', 10)}, 0)"),
        "sharpe20": (lambda: factors.sharpe(20), f"({roll('avg', 'ret', 20)}) / nullif({roll('stddev_samp', 'ret', 20)}, 0)"),
        "sortino10": (lambda: factors.sortino(10), f"({roll('avg', 'ret', 10)}) / nullif({roll('stddev_samp', DOWN, 10)}, 0)"),
    },
)
factor_query("mom_accel", {"mom_accel": (lambda: factors.momentum(20) - factors.momentum(60), f"({lagged('close', 20)}) - ({lagged('close', 60)})")})
R2 = f"OVER ({TS} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
factor_query("nav_stability", {"nav_stability": (lambda: factors.nav_stability(10), f"CASE WHEN count(close) {R2} = 10 AND var_pop(close) {R2} * 10 >= 1e-12 THEN regr_r2(close, t_idx) {R2} END")})
factor_query("ts_zscore", {"z": (lambda: ratio(F.col("close") - rolling(F.avg, "close", 20, 5), rolling(F.stddev_samp, "close", 20, 5)), f"(close - ({roll('avg', 'close', 20, 5)})) / nullif({roll('stddev_samp', 'close', 20, 5)}, 0)")})
factor_query("forward_returns", {f"fwd{h}": (lambda h=h: forward_return("close", h), f"lead(close, {h}) OVER ({TS}) / nullif(close, 0) - 1") for h in (1, 5, 20)})

TRUE_RANGE = f"""
moves AS (SELECT *, lag(close) OVER t AS c1, high - lag(high) OVER t AS up, lag(low) OVER t - low AS dn FROM dense WINDOW t AS ({TS})),
ranges AS (SELECT *, CASE WHEN high IS NOT NULL OR c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr,
  CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END END AS up_move,
  CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END END AS down_move FROM moves)"""


@register(
    "atr_adx",
    f"""WITH {DENSE}, {TRUE_RANGE},
a AS (SELECT *, {roll('avg', 'tr', 5, 3)} AS atr, {roll('avg', 'up_move', 5, 3)} AS um, {roll('avg', 'down_move', 5, 3)} AS dm FROM ranges),
d AS (SELECT *, abs(100 * um / nullif(atr, 0) - 100 * dm / nullif(atr, 0)) * 100 / nullif(100 * um / nullif(atr, 0) + 100 * dm / nullif(atr, 0), 0) AS dx FROM a)
SELECT date, code, round(atr, 6) + 0.0 AS atr, round(adx, 6) + 0.0 AS adx FROM (SELECT *, {roll('avg', 'dx', 5, 3)} AS adx FROM d) WHERE atr IS NOT NULL""",
)
def atr_adx(spark, sf_dir):
    rows = factors.with_adx(dense_week(spark, sf_dir), 5, 3)
    return rounded(rows.where("atr is not null").select("date", "code", "atr", "adx"), "atr", "adx", digits=6)


@register("chandelier", f"WITH {DENSE}, {TRUE_RANGE} SELECT date, code, round(stop, 7) + 0.0 AS stop FROM (SELECT *, ({roll('max', 'high', 7)}) - 3.0 * ({roll('avg', 'tr', 7)}) AS stop FROM ranges) WHERE stop IS NOT NULL")
def chandelier(spark, sf_dir):
    rows = factors.chandelier(dense_week(spark, sf_dir), 7, 3.0)
    return rounded(rows.where("stop is not null").select("date", "code", "stop"), "stop", digits=7)


# the boards' rule as stated: funds have no limit, growth boards 20 %, the third market 30 %, the main boards 10 %
LIMIT_SQL = "CASE WHEN regexp_matches(code, '^(5|15|16|18)') THEN 1.0 WHEN substr(code, 1, 3) IN ('300', '301', '688', '689') THEN 0.20 WHEN regexp_matches(code, '^([48]|920)') THEN 0.30 ELSE 0.10 END"


@register(
    "limit_flags",
    f"""WITH {DENSE}, m AS (SELECT *, {LIMIT_SQL} - 0.005 AS lim FROM dense),
    fl AS (SELECT date, code, coalesce(ret >= lim, false) AS limit_up, coalesce(ret <= -lim, false) AS limit_down, open, close FROM m)
    SELECT date, code, limit_up, limit_down, limit_up AND coalesce(open >= close - 1e-6, false) AS one_price_up, limit_down AND coalesce(open <= close + 1e-6, false) AS one_price_down FROM fl WHERE limit_up OR limit_down""",
)
def limit_flags(spark, sf_dir):
    rows = factors.limit_flags(dense_week(spark, sf_dir))
    return rows.where("limit_up or limit_down").select("date", "code", "limit_up", "limit_down", "one_price_up", "one_price_down")


@register("cs_rank_pct", f"WITH {DENSE} SELECT date, code, {rank_sql('volume')} AS rank, round({pct_sql('volume')}, 10) AS pct FROM dense WHERE volume IS NOT NULL")
def cs_rank_pct(spark, sf_dir):
    from ..functions.windows import avg_rank

    rows = panels.bars_of(spark, sf_dir)
    return rows.select("date", "code", avg_rank("volume").alias("rank"), F.round(pct_rank("volume"), 10).alias("pct"))


@register("cs_zscore", f"WITH {WEEK} SELECT date, code, round((amount - avg(amount) OVER d) / nullif(stddev_samp(amount) OVER d, 0), 6) + 0.0 AS z FROM wk WINDOW d AS (PARTITION BY date)")
def cs_zscore(spark, sf_dir):
    return rounded(panels.bars_of(spark, sf_dir).select("date", "code", zscore("amount").alias("z")), "z", digits=6)


SCORES = f"f AS (SELECT date, code, t_idx, close, open, turnover, am20, round({lagged('close', 5)}, 10) AS mom5, round({roll('stddev_samp', 'ret', 5, 3)}, 10) AS vol5, volume FROM dense)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with mom5 and vol5, rounded so that ranks agree between engines."""
    rows = dense_week(spark, sf_dir)
    return rows.withColumns({"mom5": F.round(factors.momentum(5), 10), "vol5": F.round(rolling(F.stddev_samp, "ret", 5, 3), 10)})


@register("composite_score", f"WITH {DENSE}, {SCORES} SELECT * FROM (SELECT date, code, round(1.0 * {pct_sql('mom5')} + 0.5 * (1 - {pct_sql('vol5')}), 8) + 0.0 AS score FROM f) WHERE score IS NOT NULL")
def composite_score(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("score", factors.composite({"mom5": 1.0, "vol5": 0.5}, {"vol5": True}))
    return rounded(rows.where("score is not null").select("date", "code", "score"), "score")


@register("composite_ranks", f"WITH {DENSE}, {SCORES} SELECT * FROM (SELECT date, code, ({rank_sql('am20')}) + ({rank_sql('vol5')}) AS score FROM f) WHERE score IS NOT NULL")
def composite_ranks(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("vol20", F.col("vol5")).withColumn("score", factors.composite_stock())
    return rows.where("score is not null").select("date", "code", "score")


@register("industry_neutral", f"WITH {DENSE}, f AS (SELECT date, code, {lagged('close', 5)} AS mom5 FROM dense), {INDUSTRY} SELECT date, code, round(mom5 - avg(mom5) OVER (PARTITION BY date, coalesce(industry, '?')), 8) + 0.0 AS score FROM f LEFT JOIN ind USING (code) WHERE mom5 IS NOT NULL")
def industry_neutral(spark, sf_dir):
    rows = joins.with_names(dense_week(spark, sf_dir).withColumn("mom5", factors.momentum(5)).where("mom5 is not null"), industries(spark, sf_dir), "code", "industry", "?")
    return rounded(rows.withColumn("score", factors.industry_neutral("mom5")).select("date", "code", "score"), "score")


@register("liquidity_cut", f"WITH {WEEK}, c AS (SELECT *, quantile_cont(am20, 0.3) OVER (PARTITION BY date) AS cut FROM wk) SELECT date, code, am20 FROM c WHERE am20 >= cut")
def liquidity_cut(spark, sf_dir):
    rows = week(spark, sf_dir).withColumn("cut", factors.liquidity_cut(0.3)).where("am20 >= cut")
    return rows.select("date", "code", "am20")


@register("quantile_buckets", f"WITH {WEEK}, r AS (SELECT date, code, volume, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY volume, code) AS p FROM wk) SELECT date, code, CAST(greatest(ceil((p - 1) * 5 / greatest(n - 1, 1)::DOUBLE) - 1, 0) AS BIGINT) AS bucket FROM r")
def quantile_buckets(spark, sf_dir):
    rows = panels.bars_of(spark, sf_dir)
    return rows.select("date", "code", quantile_bucket("volume", 5).cast("long").alias("bucket"))


@register("golden_cross_signals", f"WITH {DENSE}, g AS (SELECT *, round(({roll('avg', 'close', 3, 2)}) - ({roll('avg', 'close', 8, 5)}), 8) AS df FROM dense), s AS (SELECT *, lag(df) OVER ({TS}) AS p FROM g) SELECT date, code, CASE WHEN p <= 0 AND df > 0 THEN 1 ELSE -1 END AS signal FROM s WHERE (p <= 0 AND df > 0) OR (p >= 0 AND df < 0)")
def golden_cross_signals(spark, sf_dir):
    rows = dense_week(spark, sf_dir).withColumn("ma_diff", F.round(rolling(F.avg, "close", 3, 2) - rolling(F.avg, "close", 8, 5), 8))
    return factors.cross_signal(rows).where("signal <> 0").select("date", "code", "signal")


@register("index_normalised", f"WITH {WEEK}, m AS (SELECT date, round(avg(close), 8) AS level FROM wk GROUP BY date) SELECT date, round(level / first_value(level) OVER (ORDER BY date), 8) + 0.0 AS level FROM m WHERE date >= DATE '1998-01-01'")
def index_normalised(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = panels.bars_of(spark, sf_dir).groupBy("date").agg(F.round(F.avg("close"), 8).alias("level")).where("date >= date '1998-01-01'")
    return rounded(rows.select("date", (F.col("level") / F.first("level").over(Window.orderBy("date"))).alias("level")), "level")


# ---------------------------------------------------------------- selection
TRADABLE = "ok AS (SELECT * FROM (SELECT *, quantile_cont(am20, 0.3) OVER (PARTITION BY date) AS cut FROM f) WHERE close > 0 AND mom5 IS NOT NULL AND turnover > 0 AND am20 >= cut)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("score", F.col("mom5"))
    return selection.tradable_rows(rows, 0.3)


@register("top_n", f"WITH {DENSE}, {SCORES}, {TRADABLE} SELECT date, code, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom5 DESC, code DESC) AS r FROM ok) WHERE r <= 3")
def top_n(spark, sf_dir):
    return selection.rank_select(candidates(spark, sf_dir), 3).select("date", "code", "rank")


@register("top_pct", f"WITH {DENSE}, {SCORES}, {TRADABLE} SELECT date, code, CAST(r AS INTEGER) AS rank, round(1.0 / count(*) OVER (PARTITION BY date), 10) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom5, code) AS r, count(*) OVER (PARTITION BY date) AS n FROM ok) WHERE r <= greatest(1, ceil(n * 0.1 - 1e-9))")
def top_pct(spark, sf_dir):
    rows = selection.rank_select(candidates(spark, sf_dir), top_pct=0.1, ascending=True)
    return selection.equal_weights(rows).select("date", "code", "rank", F.round("weight", 10).alias("weight"))


@register("industry_cap", f"WITH {DENSE}, {SCORES}, {TRADABLE}, {INDUSTRY}, a AS (SELECT *, row_number() OVER (PARTITION BY date, coalesce(industry, '?') ORDER BY mom5 DESC, code DESC) AS i FROM ok LEFT JOIN ind USING (code)), b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom5 DESC, code DESC) AS r FROM a WHERE i <= 1) SELECT date, code, coalesce(industry, '?') AS industry, CAST(r AS INTEGER) AS rank FROM b WHERE r <= 5")
def industry_cap(spark, sf_dir):
    rows = joins.with_names(candidates(spark, sf_dir), industries(spark, sf_dir), "code", "industry", "?")
    return selection.rank_select(rows, 5, industry_cap=1).select("date", "code", "industry", "rank")


@register("long_short_legs", f"WITH {DENSE}, {SCORES}, {TRADABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom5 DESC, code DESC) AS r, count(*) OVER (PARTITION BY date) AS n FROM ok) SELECT date, code, CASE WHEN r <= 3 THEN 1 ELSE -1 END AS side, round(CASE WHEN r <= 3 THEN 1.0 / 3 ELSE 1.0 / 2 END, 10) AS weight FROM r WHERE n >= 5 AND (r <= 3 OR r > n - 2)")
def long_short_legs(spark, sf_dir):
    return selection.long_short_legs(candidates(spark, sf_dir), 3, 2).select("date", "code", "side", F.round("weight", 10).alias("weight"))


@register("rebalance_calendar", f"WITH {DENSE}, c AS (SELECT *, lag(date) OVER (ORDER BY date) AS p FROM cal) SELECT date, t_idx, coalesce(month(date) <> month(p), false) AS monthly, coalesce(month(date) <> month(p) AND month(date) IN (3, 9), false) AS semiannual, coalesce(isodow(date) = 5, false) AS weekly FROM c")
def rebalance_calendar(spark, sf_dir):
    cal = panels.calendar(panels.bars_of(spark, sf_dir))
    for freq in (selection.MONTHLY, selection.SEMIANNUAL, selection.WEEKLY):
        cal = selection.rebalance_days(cal, freq).withColumnRenamed("is_exec", freq)
    return cal


@register("latest_signals", f"WITH {DENSE}, {SCORES}, {TRADABLE}, l AS (SELECT * FROM ok WHERE date = (SELECT max(date) FROM ok)) SELECT date, code, mom5 AS score FROM l ORDER BY mom5 DESC, code DESC LIMIT 10")
def latest_signals(spark, sf_dir):
    return selection.latest_signals(candidates(spark, sf_dir), 10).select("date", "code", "score")


@register("leaders", f"WITH {DENSE}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom5 DESC, code DESC) AS a, row_number() OVER (PARTITION BY date ORDER BY mom5, code) AS b FROM f WHERE mom5 IS NOT NULL) SELECT date, code, 'head' AS side FROM r WHERE a <= 2 UNION ALL SELECT date, code, 'tail' AS side FROM r WHERE b <= 2")
def leaders(spark, sf_dir):
    return selection.leaders(scored(spark, sf_dir), 2, "mom5").select("date", "code", "side")


@register("regime_scale", f"WITH {DENSE}, {SCORES} SELECT date, code, CASE WHEN quantile_cont(vol5, 0.5) OVER (PARTITION BY date) < 0.4 THEN 0.5 ELSE 1.0 END AS scale FROM f WHERE vol5 IS NOT NULL")
def regime_scale(spark, sf_dir):
    rows = scored(spark, sf_dir).where("vol5 is not null").withColumn("adx", F.col("vol5"))
    return rows.select("date", "code", selection.regime_scale(0.4, 0.5).alias("scale"))


@register("min_history", f"WITH {WEEK} SELECT date, code, close FROM wk WHERE code IN (SELECT code FROM wk GROUP BY code HAVING count(*) FILTER (WHERE date < DATE '1999-01-01' - 400) >= 100)")
def min_history(spark, sf_dir):
    return joins.min_history(panels.bars_of(spark, sf_dir), "1999-01-01", 400, 100).select("date", "code", "close")


@register("stock_search", "SELECT code, name, CAST(hit AS INTEGER) AS hit FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, CASE WHEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') LIKE '00001%' THEN 0 WHEN contains(lower(s_name), '00001') THEN 1 END AS hit FROM supplier) WHERE hit IS NOT NULL ORDER BY hit, code LIMIT 20")
def stock_search(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(S.zero_filled(F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"))
    return selection.search(names, "00001").select("code", "name", "hit")


# ---------------------------------------------------------------- backtests and evaluation
OPENS = f"""
oo AS (SELECT *, last_value(CASE WHEN open > 0 THEN open END IGNORE NULLS) OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_ff FROM f),
o2o AS (SELECT *, coalesce(open_ff / nullif(lag(open_ff) OVER ({TS}), 0) - 1, 0.0) AS o2o FROM oo)"""
EXECS = f"""ex AS (SELECT t_idx FROM (SELECT t_idx, date, lag(date) OVER (ORDER BY date) AS p FROM cal) WHERE month(date) <> month(p)),
sel AS (SELECT date, t_idx, code, row_number() OVER (PARTITION BY date ORDER BY mom5 DESC, code DESC) AS r FROM ok),
tg AS (SELECT s.t_idx + 1 AS t_idx, code, 1.0 / count(*) OVER (PARTITION BY s.t_idx) AS weight FROM sel s WHERE r <= 3 AND s.t_idx + 1 IN (SELECT t_idx FROM ex))"""
NAV_SQL = f"""{DENSE}, {SCORES}, {OPENS}, {TRADABLE}, {EXECS},
exs AS (SELECT t_idx AS e, lead(t_idx) OVER (ORDER BY t_idx) AS nxt FROM (SELECT DISTINCT t_idx FROM tg)),
held AS (SELECT e, nxt, code, weight FROM tg JOIN exs ON tg.t_idx = e),
path AS (SELECT h.e, h.nxt, p.t_idx, h.code, h.weight * coalesce(p.open_ff / nullif(b.open_ff, 0), 1.0) AS value, h.weight
  FROM held h LEFT JOIN oo b ON b.code = h.code AND b.t_idx = h.e JOIN oo p ON p.code = h.code AND p.t_idx > h.e AND p.t_idx <= coalesce(h.nxt, 1000000000)),
byday AS (SELECT e, nxt, t_idx, sum(value) / sum(weight) AS growth FROM path GROUP BY ALL),
drift AS (SELECT p.t_idx, code, value / growth AS old FROM path p JOIN byday b ON p.e = b.e AND p.t_idx = b.t_idx WHERE p.t_idx = p.nxt),
cost AS (SELECT coalesce(d.t_idx, t.t_idx) AS t_idx, sum(greatest(coalesce(weight, 0) - coalesce(old, 0), 0)) * 0.0008 + sum(greatest(coalesce(old, 0) - coalesce(weight, 0), 0)) * 0.0013 AS cost
  FROM drift d FULL JOIN tg t ON d.t_idx = t.t_idx AND d.code = t.code GROUP BY 1),
daily AS (SELECT t_idx, growth / coalesce(lag(growth) OVER (PARTITION BY e ORDER BY t_idx), 1.0) - 1 AS raw FROM byday),
nav AS (SELECT c.date, c.t_idx, exp(sum(ln(1 + coalesce(raw, 0) - coalesce(cost, 0))) OVER (ORDER BY c.t_idx)) AS nav FROM cal c LEFT JOIN daily USING (t_idx) LEFT JOIN cost USING (t_idx))"""


def targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dense panel with opens, and monthly targets of the three best by mom5."""
    panel = factors.open_to_open(scored(spark, sf_dir).withColumn("score", F.col("mom5")))
    cal = selection.rebalance_days(panels.calendar(panel)).where("is_exec").select(F.col("t_idx").alias("x"))
    chosen = selection.equal_weights(selection.rank_select(selection.tradable_rows(panel, 0.3), 3))
    # the calendar is as long as history, so it may be broadcast
    days = chosen.withColumn("x", F.col("t_idx") + 1).join(F.broadcast(cal), "x", "left_semi")
    return panel, days.select(F.col("x").alias("t_idx"), "code", "weight")


@register("weight_nav", f"WITH {NAV_SQL} SELECT date, t_idx, CAST(printf('%.8e', nav) AS DOUBLE) AS nav FROM nav")
def weight_nav(spark, sf_dir):
    return significant(backtest.weight_nav(*targets(spark, sf_dir)), "nav")


@register("drawdown", f"WITH {NAV_SQL} SELECT date, round(nav / max(nav) OVER (ORDER BY date) - 1, 8) + 0.0 AS drawdown FROM nav")
def drawdown(spark, sf_dir):
    nav = backtest.weight_nav(*targets(spark, sf_dir)).withColumn("s", F.lit(0))
    return rounded(evaluate.drawdowns(nav, ["s"]).select("date", "drawdown"), "drawdown")


@register(
    "metrics",
    f"""WITH {NAV_SQL}, r AS (SELECT *, nav / lag(nav) OVER (ORDER BY date) - 1 AS ret, nav / max(nav) OVER (ORDER BY date) - 1 AS dd FROM nav),
    a AS (SELECT count(ret) AS n, last(nav ORDER BY date) / first(nav ORDER BY date) - 1 AS total, avg(ret) AS mean, stddev_samp(ret) * sqrt(244.0) AS vol, min(dd) AS mdd, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS win FROM r)
    SELECT n, CAST(printf('%.8e', total) AS DOUBLE) AS total, CAST(printf('%.8e', pow(1 + total, 244.0 / n) - 1) AS DOUBLE) AS annual, CAST(printf('%.8e', vol) AS DOUBLE) AS vol, CAST(printf('%.8e', mean * 244 / vol) AS DOUBLE) AS sharpe, CAST(printf('%.8e', mdd) AS DOUBLE) AS max_drawdown, CAST(printf('%.8e', (pow(1 + total, 244.0 / n) - 1) / abs(mdd)) AS DOUBLE) AS calmar, CAST(printf('%.8e', win) AS DOUBLE) AS win_rate FROM a""",
)
def metrics(spark, sf_dir):
    nav = backtest.weight_nav(*targets(spark, sf_dir)).withColumn("s", F.lit(0))
    return significant(evaluate.nav_metrics(nav, ["s"]).drop("s"), "total", "annual", "vol", "sharpe", "max_drawdown", "calmar", "win_rate")


@register("benchmark_nav", f"WITH {DENSE}, {SCORES}, {OPENS}, b AS (SELECT date, t_idx, CASE WHEN lag(close) OVER ({TS}) > 0 AND lag(open) OVER ({TS}) > 0 AND open > 0 THEN o2o END AS r FROM o2o), m AS (SELECT date, t_idx, coalesce(avg(r), 0) AS ret FROM b GROUP BY ALL) SELECT date, t_idx, CAST(printf('%.8e', exp(sum(ln(1 + ret)) OVER (ORDER BY t_idx))) AS DOUBLE) AS nav FROM m")
def benchmark_nav(spark, sf_dir):
    return significant(backtest.benchmark_nav(factors.open_to_open(dense_week(spark, sf_dir))), "nav")


@register(
    "long_short_nav",
    f"""WITH {DENSE}, {SCORES}, {OPENS}, {TRADABLE}, r AS (SELECT t_idx, code, row_number() OVER (PARTITION BY date ORDER BY mom5 DESC, code DESC) AS r, count(*) OVER (PARTITION BY date) AS n FROM ok),
    lg AS (SELECT t_idx + 1 AS e, code, CASE WHEN r <= 3 THEN 1 ELSE -1 END AS side, CASE WHEN r <= 3 THEN 1.0 / 3 ELSE 1.0 / 2 END AS weight FROM r WHERE n >= 5 AND (r <= 3 OR r > n - 2)),
    ex2 AS (SELECT e, lead(e) OVER (ORDER BY e) AS nxt FROM (SELECT DISTINCT e FROM lg WHERE e IN (SELECT t_idx FROM cal))),
    h AS (SELECT p.t_idx, side, weight, o2o FROM lg JOIN ex2 USING (e) JOIN o2o p ON p.code = lg.code AND p.t_idx > lg.e AND p.t_idx <= coalesce(nxt, 1000000000)),
    d AS (SELECT t_idx, sum(weight * o2o) FILTER (WHERE side = 1) / sum(weight) FILTER (WHERE side = 1) - 0.5 * sum(weight * o2o) FILTER (WHERE side = -1) / sum(weight) FILTER (WHERE side = -1) - 0.5 * 0.086 / 252 AS ret FROM h GROUP BY 1)
    SELECT date, t_idx, round(coalesce(ret, 0), 8) + 0.0 AS ret FROM cal LEFT JOIN d USING (t_idx)""",
)
def long_short_nav(spark, sf_dir):
    panel = factors.open_to_open(scored(spark, sf_dir).withColumn("score", F.col("mom5")))
    legs = selection.long_short_legs(selection.tradable_rows(panel, 0.3), 3, 2).select((F.col("t_idx") + 1).alias("t_idx"), "code", "side", "weight")
    cal = panels.calendar(panel).select("t_idx")
    return rounded(backtest.long_short_returns(panel, legs.join(F.broadcast(cal), "t_idx", "left_semi"), 0.086, 1.0, 0.5), "ret")


LABELS = f"lab AS (SELECT date, code, mom5 AS factor, lead(close, 5) OVER ({TS}) / nullif(close, 0) - 1 AS fwd FROM f)"
KNOWN = "kn AS (SELECT date, code, factor, round(fwd, 10) AS fwd FROM lab WHERE factor IS NOT NULL AND fwd IS NOT NULL)"
IC_SQL = f"""{DENSE}, {SCORES}, {LABELS}, {KNOWN},
rk AS (SELECT date, {rank_sql('factor')} AS rf, {rank_sql('fwd')} AS rr FROM kn),
ic AS (SELECT date, count(*) AS n, covar_pop(rf, rr) / (stddev_pop(rf) * stddev_pop(rr)) AS ic FROM rk GROUP BY date HAVING count(*) >= 10 AND min(rf) < max(rf) AND min(rr) < max(rr))"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.labelled(scored(spark, sf_dir), "mom5", 5).withColumn("fwd", F.round("fwd", 10))


@register("rank_ic", f"WITH {IC_SQL} SELECT date, n, round(ic, 8) + 0.0 AS ic FROM ic")
def rank_ic(spark, sf_dir):
    return rounded(evaluate.rank_ic(labels(spark, sf_dir)), "ic")


@register("ic_summary", f"WITH {IC_SQL} SELECT count(ic) AS n, round(avg(ic), 8) AS mean, round(stddev_samp(ic), 8) AS std, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) * sqrt(count(ic)) / stddev_samp(ic), 6) AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 8) AS win_rate FROM ic")
def ic_summary(spark, sf_dir):
    return rounded(rounded(evaluate.ic_summary(evaluate.rank_ic(labels(spark, sf_dir))), "mean", "std", "win_rate"), "icir", "t", digits=6)


GROUPS_SQL = f"""{DENSE}, {SCORES}, {LABELS}, {KNOWN},
pl AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY factor, code) AS p FROM kn),
bk AS (SELECT date, CAST(greatest(ceil((p - 1) * 5 / greatest(n - 1, 1)::DOUBLE) - 1, 0) AS BIGINT) AS bucket, fwd FROM pl WHERE n >= 10),
gr AS (SELECT date, bucket, count(*) AS n, avg(fwd) AS ret FROM bk GROUP BY ALL)"""


@register("group_returns", f"WITH {GROUPS_SQL} SELECT date, bucket, n, round(ret, 8) + 0.0 AS ret FROM gr")
def group_returns(spark, sf_dir):
    return rounded(evaluate.group_returns(labels(spark, sf_dir)), "ret").withColumn("bucket", F.col("bucket").cast("long"))


@register("group_spread", f"WITH {GROUPS_SQL}, m AS (SELECT bucket, avg(ret) AS ret FROM gr GROUP BY 1) SELECT round(max_by(ret, bucket), 6) AS top, round(min_by(ret, bucket), 6) AS bottom, round(max_by(ret, bucket) - min_by(ret, bucket), 6) AS spread, round((max_by(ret, bucket) - min_by(ret, bucket)) * (244.0 / 5), 5) AS annual_spread FROM m")
def group_spread(spark, sf_dir):
    out = evaluate.group_spread(evaluate.group_returns(labels(spark, sf_dir)), 5)
    return rounded(rounded(out, "top", "bottom", "spread", digits=6), "annual_spread", digits=5)


BRINSON_SQL = f"""{WEEK}, {INDUSTRY},
w AS (SELECT month, code, 1.0 / 3 AS weight FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, code, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY sum(CAST(amount AS DECIMAL(18,2))) DESC, code) AS r FROM wk GROUP BY 1, date_trunc('month', date), code) WHERE r <= 3),
mv AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, code, coalesce(industry, '?') AS industry, last(close ORDER BY date) / first(close ORDER BY date) - 1 AS ret FROM wk LEFT JOIN ind USING (code) WHERE close > 0 GROUP BY 1, 2, 3),
j AS (SELECT mv.*, coalesce(weight, 0) AS weight, count(*) OVER (PARTITION BY month) AS n FROM mv LEFT JOIN w USING (month, code)),
p AS (SELECT month, industry, sum(weight) AS cw, count(*) / first(n)::DOUBLE AS bw, sum(weight * ret) AS wr, avg(ret) AS bench FROM j GROUP BY ALL),
e AS (SELECT month, industry, (cw - bw) * bench AS allocation, bw * (CASE WHEN cw > 0 THEN wr / cw ELSE 0 END - bench) AS selection, (cw - bw) * (CASE WHEN cw > 0 THEN wr / cw ELSE 0 END - bench) AS interaction FROM p WHERE month IN (SELECT month FROM p GROUP BY month HAVING sum(cw) > 0))"""


def brinson_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = joins.with_names(panels.bars_of(spark, sf_dir), industries(spark, sf_dir), "code", "industry", "?")
    totals = rows.groupBy(F.trunc("date", "month").alias("month"), "code").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("a"))
    r = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("a"), "code"))
    return evaluate.brinson(rows, totals.withColumn("r", r).where("r <= 3").select("month", "code", F.lit(1.0 / 3).alias("weight")))


@register("brinson", f"WITH {BRINSON_SQL} SELECT month, industry, round(allocation, 8) + 0.0 AS allocation, round(selection, 8) + 0.0 AS selection, round(interaction, 8) + 0.0 AS interaction FROM e")
def brinson(spark, sf_dir):
    return rounded(brinson_effects(spark, sf_dir), "allocation", "selection", "interaction")


@register("brinson_total", f"WITH {BRINSON_SQL} SELECT industry, round(sum(allocation), 6) + 0.0 AS allocation, round(sum(selection), 6) + 0.0 AS selection, round(sum(interaction), 6) + 0.0 AS interaction, round(avg(allocation), 8) + 0.0 AS mean_allocation, round(avg(selection), 8) + 0.0 AS mean_selection, round(avg(interaction), 8) + 0.0 AS mean_interaction FROM e GROUP BY industry")
def brinson_total(spark, sf_dir):
    out = rounded(evaluate.brinson_total(brinson_effects(spark, sf_dir)), "allocation", "selection", "interaction", digits=6)
    return rounded(out, "mean_allocation", "mean_selection", "mean_interaction")


@register("sweep_heatmap", f"WITH {WEEK} SELECT year(date) AS year, round(avg(close) FILTER (WHERE month(date) <= 6), 6) AS h1, round(avg(close) FILTER (WHERE month(date) > 6), 6) AS h2 FROM wk GROUP BY 1")
def sweep_heatmap(spark, sf_dir):
    rows = panels.bars_of(spark, sf_dir).select(F.year("date").alias("year"), F.when(F.month("date") <= 6, "h1").otherwise("h2").alias("half"), "close")
    return rounded(sweeps.heatmap(rows, "year", "half", "close"), "h1", "h2", digits=6)


# ---------------------------------------------------------------- joins, sets, adjustment
PIT = f"ev AS (SELECT {CODE.format('o_custkey % 100')} AS code, CAST(o_orderdate AS DATE) AS ann_date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(S.zero_filled(F.col("o_custkey") % 100).alias("code"), F.col("o_orderdate").cast("date").alias("ann_date")).agg(F.max("o_totalprice").alias("value"))


@register("asof_pit", f"WITH {WEEK}, {PIT} SELECT w.date, w.code, w.close, ev.value FROM wk w ASOF LEFT JOIN ev ON w.code = ev.code AND w.date >= ev.ann_date")
def asof_pit(spark, sf_dir):
    return joins.asof(panels.bars_of(spark, sf_dir).select("date", "code", "close"), statements(spark, sf_dir), ["value"]).select("date", "code", "close", "value")


YOY = "q AS (SELECT o_custkey % 25 AS nation, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL)"


@register("yoy_growth", f"WITH {YOY} SELECT a.nation, a.year, a.quarter, round(CASE WHEN abs(a.value / nullif(b.value, 0) - 1) < 10 THEN a.value / nullif(b.value, 0) - 1 END, 8) + 0.0 AS value_yoy FROM q a LEFT JOIN q b ON a.nation = b.nation AND a.quarter = b.quarter AND a.year = b.year + 1")
def yoy_growth(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    q = o.groupBy((F.col("o_custkey") % 25).alias("nation"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return rounded(joins.year_over_year(q, "value", ["nation", "quarter"]).select("nation", "year", "quarter", "value_yoy"), "value_yoy")


ADJ = "adj AS (SELECT *, 1 + 0.1 * (year(date) - 1994) AS adj_factor FROM wk)"


def adjustable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.bars_of(spark, sf_dir).withColumn("adj_factor", F.lit(1.0) + F.lit(0.1) * (F.year("date") - 1994))


@register("adjust_qfq", f"WITH {WEEK}, {ADJ}, l AS (SELECT code, max_by(adj_factor, date) AS la FROM adj GROUP BY 1) SELECT date, code, round(open * adj_factor / la, 8) + 0.0 AS open, round(close * adj_factor / la, 8) + 0.0 AS close FROM adj JOIN l USING (code)")
def adjust_qfq(spark, sf_dir):
    return picked(panels.adjusted(adjustable(spark, sf_dir), "qfq"), "open", "close")


@register("adjust_hfq", f"WITH {WEEK}, {ADJ} SELECT date, code, round(open * adj_factor, 8) + 0.0 AS open, round(close * adj_factor, 8) + 0.0 AS close FROM adj")
def adjust_hfq(spark, sf_dir):
    return picked(panels.adjusted(adjustable(spark, sf_dir), "hfq"), "open", "close")


@register("anti_upsert", "WITH n AS (SELECT o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'), o AS (SELECT o_orderkey, o_totalprice AS price FROM orders) SELECT * FROM o ANTI JOIN n USING (o_orderkey) UNION ALL SELECT * FROM n")
def anti_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderdate >= timestamp_ntz '2000-01-01 00:00:00'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"))
    return joins.anti_upsert(o.select("o_orderkey", F.col("o_totalprice").alias("price")), new, ["o_orderkey"])


@register("anchor_diff", f"WITH {WEEK}, a AS (SELECT code, max_by(close, date) AS old_value FROM wk WHERE date < DATE '2000-01-01' GROUP BY 1), b AS (SELECT code, max_by(close, date) AS new_value FROM wk GROUP BY 1) SELECT coalesce(a.code, b.code) AS code, old_value, new_value FROM a FULL JOIN b ON a.code = b.code WHERE old_value IS DISTINCT FROM new_value")
def anchor_diff(spark, sf_dir):
    rows = panels.bars_of(spark, sf_dir)
    last = lambda df: df.groupBy("code").agg(F.max_by("close", "date").alias("v"))
    return joins.anchor_diff(last(rows.where("date < date '2000-01-01'")), last(rows), "code", "v")


@register("dedupe_last", "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1")
def dedupe_last(spark, sf_dir):
    recency = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return panels.dedupe_last(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], recency).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice")


@register("incremental_panel", f"WITH {WEEK} SELECT date, code, close FROM wk")
def incremental_panel(spark, sf_dir):
    raw = panels.bars_of(spark, sf_dir).select("date", "code", "close")
    affected = raw.select("code").distinct().where("code like '%3'")
    return joins.incremental_panel(raw.where("date < date '2000-01-01'"), raw, affected, lambda df: df)


# ---------------------------------------------------------------- ledger, fees, text
TRADES = f"tr AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {CODE.format('l_suppkey')} AS code, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS action, l_quantity AS shares, l_extendedprice / l_quantity AS price, l_tax AS fee, l_orderkey * 10000 + l_linenumber * 1000 + l_quantity AS seq, l_extendedprice FROM lineitem)"


def ledger_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as trades: returned lines are sales."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), S.zero_filled(F.col("l_suppkey")).alias("code"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("action"), F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("fee"), (F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("seq"), "l_extendedprice")


@register(
    "ledger_equity",
    f"""WITH {DENSE}, {TRADES}, px AS (SELECT date, code, last_value(close IGNORE NULLS) OVER ({TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM dense0),
    fl AS (SELECT date, CASE WHEN action = 'buy' THEN -(shares * price + fee) ELSE shares * price - fee END AS amount, 0.0 AS paid FROM tr UNION ALL SELECT CAST(date_trunc('week', o_orderdate) AS DATE), o_totalprice, o_totalprice FROM orders),
    bd AS (SELECT c.date, coalesce(sum(amount), 0) AS amount, coalesce(sum(paid), 0) AS paid FROM cal c LEFT JOIN fl USING (date) GROUP BY 1),
    cash AS (SELECT date, sum(amount) OVER (ORDER BY date) AS cash, sum(paid) OVER (ORDER BY date) AS paid FROM bd),
    st AS (SELECT date, code, sum(CASE WHEN action = 'buy' THEN shares ELSE -shares END) AS step FROM tr GROUP BY ALL),
    hl AS (SELECT p.date, p.code, close, sum(coalesce(step, 0)) OVER (PARTITION BY p.code ORDER BY p.date) AS held FROM px p LEFT JOIN st ON p.date = st.date AND p.code = st.code WHERE p.code IN (SELECT code FROM tr)),
    mv AS (SELECT date, sum(held * coalesce(close, 0)) AS mv FROM hl GROUP BY 1)
    SELECT date, round(cash, 3) + 0.0 AS cash, round(mv, 3) + 0.0 AS market_value, round(cash + mv, 3) + 0.0 AS equity, round(cash + mv - paid, 3) + 0.0 AS pnl FROM cash JOIN mv USING (date)""",
)
def ledger_equity(spark, sf_dir):
    px = panels.dense(panels.bars_of(spark, sf_dir)).select("date", "code", ffill("close").alias("close"))
    deposits = table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("amount"))
    return rounded(ledger.ledger_equity(px, ledger_trades(spark, sf_dir), deposits), "cash", "market_value", "equity", "pnl", digits=3)


@register(
    "ledger_positions",
    f"""WITH {TRADES}, o AS (SELECT code, date, seq, CAST(CASE WHEN action = 'buy' THEN shares ELSE -shares END AS DOUBLE) AS n, CAST(price AS DOUBLE) AS p FROM tr),
    x AS (SELECT code, list({{'n': n, 'p': p}} ORDER BY date, seq, n, p) AS ts FROM o GROUP BY code),
    s AS (SELECT code, list_reduce(list_prepend({{'n': CAST(0 AS DOUBLE), 'p': CAST(0 AS DOUBLE)}}, ts), lambda a, t: CASE WHEN t.n > 0 THEN {{'n': a.n + t.n, 'p': a.p + t.n * t.p}}
      ELSE {{'n': a.n - least(-t.n, a.n), 'p': a.p * CASE WHEN a.n > 0 THEN 1 - least(-t.n, a.n) / a.n ELSE 0 END}} END) AS r FROM x)
    SELECT code, r.n AS shares, round(r.p, 4) AS cost FROM s WHERE r.n > 1e-9""",
)
def ledger_positions(spark, sf_dir):
    return rounded(ledger.ledger_positions(ledger_trades(spark, sf_dir)), "cost", digits=4)


FIFO_SQL = f"""{TRADES}, ru AS (SELECT *, sum(shares) OVER (PARTITION BY code, action ORDER BY date, seq, price ROWS UNBOUNDED PRECEDING) AS hi FROM tr),
m AS (SELECT b.code, b.date AS buy_date, s.date AS sell_date, least(b.hi, s.hi) - greatest(b.hi - b.shares, s.hi - s.shares) AS shares FROM ru b JOIN ru s ON b.code = s.code AND b.action = 'buy' AND s.action = 'sell' AND b.hi - b.shares < s.hi AND s.hi - s.shares < b.hi)"""


@register("fifo_redeem", f"WITH {FIFO_SQL} SELECT code, buy_date, sell_date, sum(shares) AS shares FROM m GROUP BY ALL")
def fifo_redeem(spark, sf_dir):
    return ledger.fifo_matches(ledger_trades(spark, sf_dir)).groupBy("code", "buy_date", "sell_date").agg(F.sum("shares").alias("shares"))


@register("fee_tiers", f"WITH {FIFO_SQL} SELECT code, round(sum(shares * CASE WHEN d < 7 THEN 0.015 WHEN d < 30 THEN 0.0075 WHEN d < 365 THEN 0.005 ELSE 0.0 END), 6) + 0.0 AS fee FROM (SELECT *, sell_date - buy_date AS d FROM m) GROUP BY code")
def fee_tiers(spark, sf_dir):
    m = ledger.fifo_matches(ledger_trades(spark, sf_dir))
    out = m.groupBy("code").agg(F.sum(F.col("shares") * S.redemption_rate(F.date_diff("sell_date", "buy_date"))).alias("fee"))
    return rounded(out, "fee", digits=6)


ARTICLES = "art AS (SELECT d.source AS code, DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER) AS date, CAST(quality - toxic AS DOUBLE) AS score, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(F.col("source").alias("code"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("date"), (F.col("quality") - F.col("toxic")).cast("double").alias("score"), "lang")


@register("sentiment_daily", f"WITH {ARTICLES} SELECT code, date, round(avg(score), 8) AS score, count(*) AS articles FROM art GROUP BY ALL")
def sentiment_daily(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("code", "date").agg(F.round(F.avg("score"), 8).alias("score"), F.count(F.lit(1)).alias("articles"))


@register("sentiment_rolling", f"WITH {ARTICLES}, dl AS (SELECT code, date, avg(score) AS score, count(*) AS n FROM art GROUP BY ALL), g AS (SELECT c.code, d.date FROM (SELECT DISTINCT code FROM art) c CROSS JOIN (SELECT DISTINCT date FROM art) d), j AS (SELECT g.code, g.date, score, n FROM g LEFT JOIN dl ON g.code = dl.code AND g.date = dl.date) SELECT code, date, round({roll('avg', 'score', 20, 1)}, 8) AS sent20, CAST({roll('sum', 'n', 20, 1)} AS BIGINT) AS cnt20 FROM j")
def sentiment_rolling(spark, sf_dir):
    a = articles(spark, sf_dir)
    grid = panels.dense(a.select("code", "date").distinct()).select("code", "date")
    out = research.sentiment_panel(grid, a)
    return out.select("code", "date", F.round("sent20", 8).alias("sent20"), F.col("cnt20").cast("long").alias("cnt20"))


@register("sentiment_stats", f"WITH {ARTICLES} SELECT lang, count(*) AS n, count(DISTINCT code) AS codes, round(avg(score), 8) AS score FROM art WHERE date > (SELECT max(date) FROM art) - 30 GROUP BY lang")
def sentiment_stats(spark, sf_dir):
    a = articles(spark, sf_dir)
    recent = a.join(F.broadcast(a.agg(F.max("date").alias("edge")))).where(F.col("date") > F.date_sub("edge", 30))
    return recent.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("codes"), F.round(F.avg("score"), 8).alias("score"))


@register("json_params", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_params(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(S.json_field(F.col("props"), "k").cast("long")).alias("k"))


@register("strategy_archive", "SELECT event_type AS name, count(*) AS runs, max_by(json_extract_string(props, '$.k'), struct_pack(a := ts, b := event_id)) AS k FROM events GROUP BY 1")
def strategy_archive(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), F.lit("backtest").alias("kind"), F.col("ts").alias("created_at"), F.struct(F.col("event_type").alias("strategy"), S.json_field(F.col("props"), "k").alias("k")).alias("params"), F.struct(F.col("value")).alias("metrics"))
    latest = books.latest_runs(books.archive_row(runs))
    return latest.select("name", "runs", S.json_field(F.col("params"), "k").alias("k"))


@register("text_fields", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS code, upper(c_mktsegment) AS seg, sha256(c_name || chr(31) || c_mktsegment) AS digest FROM customer")
def text_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.zero_filled(F.col("c_custkey")).alias("code"), F.upper("c_mktsegment").alias("seg"), S.row_digest(F.col("c_name"), F.col("c_mktsegment")).alias("digest"))


# ---------------------------------------------------------------- research, events
CANDLES = {
    "KMID": "(close - open) / nullif(open, 0)", "KLEN": "(high - low) / nullif(open, 0)", "KMID2": "(close - open) / nullif(high - low, 0)", "KUP": "(high - greatest(open, close)) / nullif(open, 0)", "KUP2": "(high - greatest(open, close)) / nullif(high - low, 0)",
    "KLOW": "(least(open, close) - low) / nullif(open, 0)", "KLOW2": "(least(open, close) - low) / nullif(high - low, 0)", "KSFT": "(2 * close - high - low) / nullif(open, 0)", "KSFT2": "(2 * close - high - low) / nullif(high - low, 0)",
}


@register("candle_alphas", f"WITH {WEEK} SELECT date, code, " + ", ".join(f"round({e}, 8) + 0.0 AS {n}" for n, e in CANDLES.items()) + " FROM wk")
def candle_alphas(spark, sf_dir):
    rows = panels.bars_of(spark, sf_dir)
    return rounded(rows.select("date", "code", *[c.alias(n) for n, c in research.candle_alphas().items()]), *CANDLES)


factor_query("rolling_alphas", {"ROC5": (lambda: research.rolling_alphas((5,))["ROC5"], f"lag(close, 5) OVER ({TS}) / nullif(close, 0)"), "RSV5": (lambda: research.rolling_alphas((5,))["RSV5"], f"(close - ({roll('min', 'low', 5)})) / nullif(({roll('max', 'high', 5)}) - ({roll('min', 'low', 5)}), 0)"), "VMA5": (lambda: research.rolling_alphas((5,))["VMA5"], f"({roll('avg', 'volume', 5)}) / nullif(volume, 0)")})


W5 = f"({TS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@register(
    "trend_alphas",
    f"""WITH {DENSE}, s AS (SELECT *, ln(1 + volume) AS lv, close - lag(close) OVER ({TS}) AS step FROM dense),
    a AS (SELECT date, code,
      CASE WHEN count(close) OVER w >= 5 THEN regr_slope(close, t_idx) OVER w / nullif(close, 0) END AS beta,
      CASE WHEN count(close) OVER w >= 5 THEN covar_pop(close, lv) OVER w / nullif(stddev_pop(close) OVER w * stddev_pop(lv) OVER w, 0) END AS corr,
      CASE WHEN count(ret) OVER w >= 5 THEN avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) OVER w END AS cntp,
      CASE WHEN count(step) OVER w >= 5 THEN sum(CASE WHEN step IS NOT NULL THEN greatest(step, 0.0) END) OVER w / nullif(sum(abs(step)) OVER w, 0) END AS sump
      FROM s WINDOW w AS {W5})
    SELECT date, code, round(beta, 7) + 0.0 AS beta, round(corr, 7) + 0.0 AS corr, round(cntp, 8) + 0.0 AS cntp, round(sump, 7) + 0.0 AS sump FROM a WHERE beta IS NOT NULL""",
)
def trend_alphas(spark, sf_dir):
    rows = research.with_steps(dense_week(spark, sf_dir))
    found = rows.select("date", "code", research.trend_alphas((5,))["BETA5"].alias("beta"), research.trend_alphas((5,))["CORR5"].alias("corr"), research.move_alphas((5,))["CNTP5"].alias("cntp"), research.move_alphas((5,))["SUMP5"].alias("sump"))
    return rounded(rounded(found.where("beta is not null"), "beta", "corr", "sump", digits=7), "cntp")


@register("factor_coverage", f"WITH {DENSE}, {SCORES} SELECT 'mom5' AS name, count(mom5) AS n, round(count(mom5) / count(*), 8) AS coverage FROM f UNION ALL SELECT 'vol5', count(vol5), round(count(vol5) / count(*), 8) FROM f")
def factor_coverage(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("fwd", forward_return("close", 5))
    return rounded(research.evaluate(rows, ["mom5", "vol5"], "fwd")["coverage"], "coverage")


@register("multi_factor_ic", f"WITH {DENSE}, {SCORES}, l AS (SELECT *, round(lead(close, 5) OVER ({TS}) / nullif(close, 0) - 1, 10) AS fwd FROM f), k AS (SELECT date, 'mom5' AS name, mom5 AS factor, fwd FROM l UNION ALL SELECT date, 'vol5', vol5, fwd FROM l), r AS (SELECT date, name, {rank_sql('factor', 'date, name')} AS rf, {rank_sql('fwd', 'date, name')} AS rr FROM k WHERE factor IS NOT NULL AND fwd IS NOT NULL) SELECT date, name, count(*) AS n, round(covar_pop(rf, rr) / (stddev_pop(rf) * stddev_pop(rr)), 8) + 0.0 AS ic FROM r GROUP BY ALL HAVING count(*) >= 10 AND min(rf) < max(rf) AND min(rr) < max(rr)")
def multi_factor_ic(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("fwd", F.round(forward_return("close", 5), 10))
    return rounded(research.evaluate(rows, ["mom5", "vol5"], "fwd")["ic"], "ic").select("date", "name", "n", "ic")


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return incremental.windowed(table(spark, sf_dir, "events")).select("start", "event_type", "n", "total")


@register("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events")).select("user_id", "start", "n")


# ---------------------------------------------------------------- simulations: rows only, tested against plain loops
def quotes(spark: SparkSession, sf_dir: str, held: bool = False) -> DataFrame:
    """The quotes of every code with monthly targets, stops and cuts; with `held` only of codes that are ever a target, as cash and fund runs hold no others."""
    panel, chosen = targets(spark, sf_dir)
    rows = factors.chandelier(factors.limit_flags(panel), 5, 3.0, 3)
    if held:  # one code more, so that days stay where there are no targets at all
        rows = rows.join(chosen.select("code").union(panel.select(F.min("code"))).distinct(), "code", "left_semi")
    cut = panel.groupBy((F.col("t_idx") + 1).alias("t_idx")).agg(F.percentile("am20", F.lit(0.3)).alias("cut"))
    rows = rows.join(chosen.withColumnRenamed("weight", "target"), ["t_idx", "code"], "left").join(F.broadcast(cut), "t_idx", "left")
    return rows.select("t_idx", "date", "code", "open", "close", "am20", "turnover", "limit_up", "limit_down", "stop", "target", "cut")


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What event strategies see of every code: no targets, stops and cuts; backtest.reached adds the price limits."""
    return dense_week(spark, sf_dir).select("t_idx", "date", "code", "open", "close", "am20", "turnover")


def _nav_rows(df: DataFrame) -> DataFrame:
    return rounded(df.select("scenario_id", "date", "nav", "cash", "n_fills", "n_rejected"), "nav", "cash", digits=6)


@register("cash_backtest")
def cash_backtest(spark, sf_dir):
    return _nav_rows(backtest.run_scenarios(quotes(spark, sf_dir, True), sweeps.scenario_table(spark, {"stock": {"capital": 1e7}, "etf": {"capital": 1e7, "asset": "etf", "stops": True}})))


@register("fund_backtest")
def fund_backtest(spark, sf_dir):
    return _nav_rows(backtest.run_scenarios(quotes(spark, sf_dir, True), sweeps.scenario_table(spark, {"fund": {"capital": 1e6}}), backtest.fund_backtest))


@register("event_backtest")
def event_backtest(spark, sf_dir):
    scenarios = {"cross": {"strategy": "golden_cross", "short": 3, "long": 8, "capital": 1e7}, "momentum": {"strategy": "long_short_momentum", "window": 8, "capital": 1e7, "short_rate": 0.086}, "parity": {"strategy": "risk_parity", "window": 10, "capital": 1e7}}
    runs = sweeps.scenario_table(spark, scenarios)
    return _nav_rows(backtest.run_scenarios(backtest.reached(event_quotes(spark, sf_dir), runs), runs, backtest.event_backtest))


@register("walk_forward")
def walk_forward(spark, sf_dir):
    rows = event_quotes(spark, sf_dir)
    days = [r.date for r in panels.calendar(rows.select("date")).orderBy("date").collect()]
    found = sweeps.sweep(rows, sweeps.cross_grid([3, 5], [8, 13], capital=1e7), sweeps.split_windows(days, 4))
    return rounded(sweeps.summary(found, ["scenario_id"]), "mean_total", "mean_sharpe", digits=6)


@register("cross_heatmap")
def cross_heatmap(spark, sf_dir):
    """Mean totals of a golden-cross grid over its folds: a row for each short average, a column for each long one."""
    rows = event_quotes(spark, sf_dir)
    days = [r.date for r in panels.calendar(rows.select("date")).orderBy("date").collect()]
    found = sweeps.sweep(rows, sweeps.cross_grid([3, 5], [8, 13], capital=1e7), sweeps.split_windows(days, 4))
    sides = F.split("scenario_id", "x")
    out = sweeps.heatmap(found.select(sides[0].cast("int").alias("short"), sides[1].alias("long"), "total"), "short", "long", "total")
    return rounded(out, *out.columns[1:], digits=6)


@register("risk_parity")
def risk_parity(spark, sf_dir):
    from ..operators.portfolio import optimised_weights

    rows = dense_week(spark, sf_dir).withColumn("ret", F.coalesce(change(ffill("close")), F.lit(0.0)))
    return rounded(optimised_weights(rows.select(F.year("date").alias("year"), "date", "code", "ret"), "year", "risk_parity"), "weight", digits=6)


Z3 = "CASE WHEN {0} IS NOT NULL AND stddev_samp({0}) OVER (PARTITION BY date) > 0 THEN greatest(-3.0, least(3.0, ({0} - avg({0}) OVER (PARTITION BY date)) / stddev_samp({0}) OVER (PARTITION BY date))) END"
STYLES_SQL = f"""st AS (SELECT date, code, t_idx, close, mom5, {Z3.format('l')} AS a, {Z3.format('vol5')} AS b, {Z3.format('mom5')} AS m FROM (SELECT *, ln(1 + am20) AS l FROM f))"""
# residuals of two regressors and a constant: the coefficients solve the 2 x 2 normal equations of centred values
NEUTRAL_SQL = f"""{DENSE}, {SCORES}, {STYLES_SQL},
kn AS (SELECT *, mom5 IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AS ok FROM st WHERE mom5 IS NOT NULL),
mo AS (SELECT date, count(*) AS n, avg(mom5) AS y, avg(a) AS a, avg(b) AS b, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, mom5) AS ay, covar_pop(b, mom5) AS vy FROM kn WHERE ok GROUP BY date),
co AS (SELECT *, (ay * bb - vy * ab) / (aa * bb - ab * ab) AS ca, (vy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM mo)"""


@register("neutralize_ols", f"WITH {NEUTRAL_SQL} SELECT kn.date, code, CASE WHEN ok AND n >= 5 THEN round(mom5 - y - ca * (kn.a - co.a) - cb * (kn.b - co.b), 8) + 0.0 END AS score FROM kn LEFT JOIN co ON kn.date = co.date")
def neutralize_ols(spark, sf_dir):
    from ..operators.portfolio import neutralised, style_exposures

    rows = style_exposures(scored(spark, sf_dir).withColumns({"mom20": F.col("mom5"), "vol20": F.col("vol5")})).where("mom5 is not null")
    return rounded(neutralised(rows.withColumn("score", F.col("mom5")), "score", ["liquidity", "volatility"]), "score")


# three regressors by the 3 x 3 normal equations of centred values, by Cramer's rule
_DET = lambda x, y, z: f"({x[0]} * ({y[1]} * {z[2]} - {y[2]} * {z[1]}) - {y[0]} * ({x[1]} * {z[2]} - {x[2]} * {z[1]}) + {z[0]} * ({x[1]} * {y[2]} - {x[2]} * {y[1]}))"
_COLS, _RHS = [("aa", "ma", "ab"), ("ma", "mm", "mb"), ("ab", "mb", "bb")], ("ar", "mr", "br")
_BETA = [f"{_DET(*[_RHS if i == j else _COLS[j] for j in range(3)])} / {_DET(*_COLS)}" for i in range(3)]
FACTOR_RETURNS_SQL = f"""{DENSE}, {SCORES}, {STYLES_SQL},
kn AS (SELECT * FROM (SELECT *, lead(close, 1) OVER ({TS}) / nullif(close, 0) - 1 AS r FROM st) WHERE r IS NOT NULL AND a IS NOT NULL AND m IS NOT NULL AND b IS NOT NULL),
mo AS (SELECT date, count(*) AS n, avg(r) AS r0, avg(a) AS a0, avg(m) AS m0, avg(b) AS b0, var_pop(a) AS aa, var_pop(m) AS mm, var_pop(b) AS bb, covar_pop(m, a) AS ma, covar_pop(a, b) AS ab, covar_pop(m, b) AS mb, covar_pop(a, r) AS ar, covar_pop(m, r) AS mr, covar_pop(b, r) AS br, var_pop(r) AS rr FROM kn GROUP BY date HAVING count(*) >= 9),
be AS (SELECT *, {_BETA[0]} AS ba, {_BETA[1]} AS bm, {_BETA[2]} AS bv FROM mo),
fr AS (SELECT *, r0 - ba * a0 - bm * m0 - bv * b0 AS c0, rr - ba * ar - bm * mr - bv * br AS rv FROM be)"""


@register(
    "factor_returns",
    f"WITH {FACTOR_RETURNS_SQL} SELECT date, factor, round(ret, 6) + 0.0 AS ret, round(rv, 6) + 0.0 AS residual_var FROM (SELECT date, rv, 'market' AS factor, c0 AS ret FROM fr UNION ALL SELECT date, rv, 'liquidity', ba FROM fr UNION ALL SELECT date, rv, 'momentum', bm FROM fr UNION ALL SELECT date, rv, 'volatility', bv FROM fr)",
)
def factor_returns(spark, sf_dir):
    from ..operators.portfolio import factor_returns as fit
    from ..operators.portfolio import style_exposures

    rows = style_exposures(scored(spark, sf_dir).withColumns({"mom20": F.col("mom5"), "vol20": F.col("vol5")})).withColumn("fwd", forward_return("close", 1))
    return rounded(fit(rows, "fwd", ["liquidity", "momentum", "volatility"]), "ret", "residual_var", digits=6)


@register("gbt_scores")
def gbt_scores(spark, sf_dir):
    rows = research.with_labels(scored(spark, sf_dir), (5,))
    return rounded(research.boosted_scores(rows, ["mom5", "vol5", "turn20", "am20"], "ret_5", maxIter=5), "score", digits=6)
