"""Registered queries of single operators: slices, lists, filters, statistics, scores, accounts, with SQL where it can say them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.windows import forward_return
from ..operators import books, evaluate, factors, funds, joins, portfolio, research, selection
from ..sources import catalog, panels
from . import backtest, paper, sweeps
from . import queries as Q
from .queries import CODE, DENSE, IC_SQL, NAV_SQL, PIT, SCORES, TRADABLE, TRADES, TRUE_RANGE, TS, WEEK, pct_sql, rank_sql, register, roll, rounded, table


# ---------------------------------------------------------------- scans, filters, statistics
@register("panel_slice", f"WITH {WEEK} SELECT date, code, close, turn20, am20 FROM wk WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28' AND code IN ('000001', '000005', '000042')")
def panel_slice(spark, sf_dir):
    cut = lambda rows: panels.rolling_base(catalog.panel_where(rows, codes=["000001", "000005", "000042"]))
    return panels.with_lookback(panels.bars_of(spark, sf_dir), "1997-03-01", "1998-02-28", 3650, cut).select("date", "code", "close", "turn20", "am20")


BOARD_SQL = "lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0')"


@register(
    "code_boards",
    f"""WITH c AS (SELECT DISTINCT {BOARD_SQL} AS code FROM part)
    SELECT code, CAST({Q.LIMIT_SQL} AS DOUBLE) AS ratio, regexp_matches(code, '^(300|301|688|689)') AS excluded, code || CASE WHEN code[1] IN ('5', '6', '9') THEN '.SH' WHEN code[1] IN ('4', '8') THEN '.BJ' ELSE '.SZ' END AS ts_code FROM c""",
)
def code_boards(spark, sf_dir):
    code = S.zero_filled(F.col("p_partkey") * 7919 % 1000000)
    return table(spark, sf_dir, "part").select(code.alias("code")).distinct().select("code", S.limit_ratio(F.col("code")).alias("ratio"), selection.board_excluded(F.col("code")).alias("excluded"), S.market_suffix(F.col("code")).alias("ts_code"))


@register("code_statistics", f"WITH {WEEK} SELECT code, count(*) AS n, min(date) AS first, max(date) AS last, round(avg(close), 8) AS mean, max_by(close, date) AS latest FROM wk GROUP BY code")
def code_statistics(spark, sf_dir):
    return rounded(panels.code_statistics(panels.bars_of(spark, sf_dir)), "mean")


@register("last_change", f"WITH {WEEK}, r AS (SELECT *, lag(close) OVER ({TS}) AS was, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM wk) SELECT code, date, close, round(close / nullif(was, 0) - 1, 8) + 0.0 AS change FROM r WHERE n = 1")
def last_change(spark, sf_dir):
    return rounded(panels.last_change(panels.bars_of(spark, sf_dir)), "change")


@register("label_days", "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY date DESC, event_type LIMIT 30")
def label_days(spark, sf_dir):
    return selection.last_counts(table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date"), "event_type"), ["event_type"])


@register("recent_events", "SELECT event_id, CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) - 3 FROM events)")
def recent_events(spark, sf_dir):
    return selection.recent(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("date")), 3)


@register("valid_prices", f"WITH {WEEK} SELECT date, code, close FROM (SELECT date, code, open, high, low, CASE WHEN volume > 10 THEN close ELSE 0 END AS close FROM wk) WHERE close > 0 AND open > 0 AND high >= low")
def valid_prices(spark, sf_dir):
    rows = panels.bars_of(spark, sf_dir).withColumn("close", F.when(F.col("volume") > 10, F.col("close")).otherwise(0.0))
    return panels.valid_prices(rows).select("date", "code", "close")


@register(
    "adx_filter",
    f"""WITH {DENSE}, {TRUE_RANGE}, a AS (SELECT *, {roll('avg', 'tr', 5, 3)} AS atr, {roll('avg', 'up_move', 5, 3)} AS um, {roll('avg', 'down_move', 5, 3)} AS dm FROM ranges),
    d AS (SELECT *, abs(100 * um / nullif(atr, 0) - 100 * dm / nullif(atr, 0)) * 100 / nullif(100 * um / nullif(atr, 0) + 100 * dm / nullif(atr, 0), 0) AS dx FROM a),
    x AS (SELECT date, code, round({roll('avg', 'dx', 5, 3)}, 6) AS adx, close, turnover, am20, quantile_cont(am20, 0.3) OVER (PARTITION BY date) AS cut FROM d)
    SELECT date, code, adx + 0.0 AS adx FROM x WHERE close > 0 AND turnover > 0 AND am20 >= cut AND adx >= 40""",
)
def adx_filter(spark, sf_dir):
    rows = factors.with_adx(Q.dense_week(spark, sf_dir), 5, 3).withColumn("adx", F.round("adx", 6))
    return rounded(selection.tradable_rows(rows, 0.3, "close", 40.0).select("date", "code", "adx"), "adx", digits=6)


@register("affordable_top", f"WITH {DENSE}, {SCORES}, {TRADABLE} SELECT date, code, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom5 DESC, code DESC) AS r FROM ok WHERE close * 100 <= 500000.0 / 3) WHERE r <= 3")
def affordable_top(spark, sf_dir):
    rows = Q.candidates(spark, sf_dir).where(selection.affordable(500000.0, 3))
    return selection.rank_select(rows, 3).select("date", "code", "rank")


@register("fund_universe", "SELECT code, min(name) AS name, min(type) AS type FROM (SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_type AS type FROM part) WHERE regexp_matches(type, 'STANDARD|PROMO|SMALL') AND NOT regexp_matches(type, 'SMALL') AND NOT regexp_matches(name, 'ring') AND regexp_matches(name, 'red|blue|small') GROUP BY code")
def fund_universe(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return funds.fund_universe(rows, "STANDARD|PROMO|SMALL", "SMALL", "ring", ["red", "blue", "small"])


@register(
    "period_rules",
    """WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN '小于' || p_size || '天' WHEN 1 THEN '大于等于' || p_size || '天，小于' || (p_size + 30) || '天' WHEN 2 THEN '大于等于' || p_size || '天' ELSE ' ' END AS period, CASE WHEN p_size % 7 > 0 THEN p_size / 1000.0 END AS rate FROM part)
    SELECT p_partkey, period, rate, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_size END AS min_days, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 30 END AS max_days_exclusive FROM p WHERE trim(period) <> '' AND rate IS NOT NULL""",
)
def period_rules(spark, sf_dir):
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(kind == 0, F.concat(F.lit(funds.BELOW), size, F.lit("天"))).when(kind == 1, F.concat(F.lit(funds.FROM), size, F.lit("天，" + funds.BELOW), (F.col("p_size") + 30).cast("string"), F.lit("天"))).when(kind == 2, F.concat(F.lit(funds.FROM), size, F.lit("天"))).otherwise(" ")
    rule = funds.period_rule(text, F.when(F.col("p_size") % 7 > 0, F.col("p_size") / 1000.0))
    return table(spark, sf_dir, "part").select("p_partkey", rule.alias("r")).where("r is not null").select("p_partkey", "r.*")


@register(
    "text_numbers",
    """SELECT event_id, TRY_CAST(trim(CASE WHEN event_id % 3 = 0 THEN ' ' || value || ' ' WHEN event_id % 3 = 1 THEN 'n/a' END) AS DOUBLE) AS number, CASE WHEN event_id % 5 > 0 THEN event_id % 400 / 100.0 / 100 END AS percent, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, ''), 'none') AS label,
    array_to_string(list_slice([event_type, 'a', 'b', 'c'], 1, 3), ',') AS items FROM events""",
)
def text_numbers(spark, sf_dir):
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(n % 3 == 1, "n/a")
    percent = F.when(n % 5 > 0, F.concat((n % 400 / 100.0).cast("string"), F.lit("%"))).otherwise("-")
    return table(spark, sf_dir, "events").select("event_id", S.number(text).alias("number"), S.percent(percent).alias("percent"), S.filled(F.when(n % 2 == 0, "").otherwise(F.col("event_type")), "none").alias("label"), S.list_text(F.array("event_type", F.lit("a"), F.lit("b"), F.lit("c")), 3).alias("items"))


# ---------------------------------------------------------------- joins and fills
@register(
    "daily_rows",
    f"""WITH {WEEK}, b AS (SELECT {CODE.format('o_custkey % 100')} AS code, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1, 2)
    SELECT wk.date, wk.code, wk.close, b.orders, b.largest, CASE WHEN year(wk.date) % 2 = 0 THEN CAST(1 + 0.1 * (year(wk.date) - 1994) AS DOUBLE) END AS adj_factor FROM wk LEFT JOIN b ON wk.code = b.code AND wk.date = b.date""",
)
def daily_rows(spark, sf_dir):
    keys = (S.zero_filled(F.col("o_custkey") % 100).alias("code"), F.date_trunc("week", "o_orderdate").cast("date").alias("date"))
    basic = table(spark, sf_dir, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"), F.lit(0.0).alias("close"))
    factor = Q.adjustable(spark, sf_dir).where(F.year("date") % 2 == 0).select("code", "date", "adj_factor")
    return joins.daily_rows(panels.bars_of(spark, sf_dir).select("date", "code", "close"), basic, factor, ("code", "date"))


@register("reanchored", f"WITH {WEEK} SELECT date, code, CASE WHEN code LIKE '%7' THEN close * 2 ELSE close END AS close FROM wk")
def reanchored(spark, sf_dir):
    rows = panels.bars_of(spark, sf_dir).select("date", "code", "close")
    old = rows.select("code").distinct().withColumn("last_adj", F.lit(1.0))
    new = old.withColumn("last_adj", F.when(F.col("code").endswith("7"), 2.0).otherwise(1.0))
    return joins.reanchored(rows, old, new, lambda codes: rows.join(codes, "code", "left_semi").withColumn("close", F.col("close") * 2))


@register(
    "nav_fill",
    f"""WITH d AS (SELECT {CODE.format('user_id')} AS code, CAST(ts AS DATE) AS date, max_by(value, (ts, event_id)) AS nav FROM events GROUP BY 1, 2), cal AS (SELECT DISTINCT date FROM d),
    g AS (SELECT c.code, cal.date, d.nav FROM (SELECT DISTINCT code FROM d) c CROSS JOIN cal LEFT JOIN d ON d.code = c.code AND d.date = cal.date),
    f AS (SELECT *, last_value(nav IGNORE NULLS) OVER ({TS}) AS close FROM g) SELECT date, code, close, CAST(1 AS DOUBLE) AS turn20, CAST(1 AS DOUBLE) AS am20 FROM f WHERE close IS NOT NULL""",
)
def nav_fill(spark, sf_dir):
    nav = panels.daily_bars(table(spark, sf_dir, "events")).select("date", "code", F.col("close").alias("nav"))
    return panels.nav_panel(nav).select("date", "code", "close", "turn20", "am20")


@register("snapshot_qfq", f"WITH {WEEK}, {Q.ADJ}, l AS (SELECT code, coalesce(CASE WHEN code LIKE '%5' THEN CAST(3.7 AS DOUBLE) END, max_by(adj_factor, date)) AS la FROM adj GROUP BY code) SELECT date, code, round(close * adj_factor / la, 7) + 0.0 AS close FROM adj JOIN l USING (code)")
def snapshot_qfq(spark, sf_dir):
    rows = Q.adjustable(spark, sf_dir)
    snapshot = rows.where("code like '%5'").select("code", F.lit(3.7).alias("last_adj")).distinct()
    return rounded(panels.adjusted(rows, "qfq", snapshot, ("close",)).select("date", "code", "close"), "close", digits=7)


@register("order_trades", "SELECT o_orderkey AS order_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(10 AS DOUBLE) END, n) AS shares, round(p / 7, 6) AS price FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS n, sum(l_quantity * (l_extendedprice / l_quantity)) / sum(l_quantity) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def order_trades(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 3 == 0, 10.0).alias("shares"), F.lit(None).cast("double").alias("price"))
    trades = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rounded(books.order_trades(orders, trades).withColumn("price", F.col("price") / 7), "price", digits=6)


@register("positions_valued", f"WITH {WEEK}, {TRADES}, h AS (SELECT code, sum(shares) AS shares FROM tr WHERE action = 'buy' GROUP BY code), l AS (SELECT code, max_by(close, date) AS price FROM wk GROUP BY code) SELECT code, shares, price, round(shares * price, 4) AS value FROM h LEFT JOIN l USING (code)")
def positions_valued(spark, sf_dir):
    held = Q.ledger_trades(spark, sf_dir).where("action = 'buy'").groupBy("code").agg(F.sum("shares").alias("shares"))
    return rounded(books.positions_valued(held, panels.bars_of(spark, sf_dir)), "value", digits=4)


# ---------------------------------------------------------------- factors and research
@register("fund_composite", f"WITH {DENSE}, {SCORES}, m AS (SELECT *, round(close / nullif({roll('max', 'close', 5, 1)}, 0) - 1, 10) AS mdd5 FROM f) SELECT * FROM (SELECT date, code, ({rank_sql('vol5')}) - ({rank_sql('mdd5')}) AS score FROM m) WHERE score IS NOT NULL")
def fund_composite(spark, sf_dir):
    rows = Q.scored(spark, sf_dir).withColumns({"vol20": F.col("vol5"), "mdd20": F.round(factors.window_drawdown(5), 10)})
    return rows.withColumn("score", factors.composite_fund()).where("score is not null").select("date", "code", "score")


@register(
    "sentiment_momentum",
    f"""WITH {DENSE}, {SCORES}, {PIT}, a AS (SELECT code, CAST(date_trunc('week', ann_date) AS DATE) AS date, avg(value) AS score FROM ev GROUP BY 1, 2),
    s AS (SELECT f.*, {roll('avg', 'score', 4, 1)} AS sent20 FROM (SELECT f.*, a.score FROM f LEFT JOIN a USING (code, date)) f),
    z AS (SELECT date, code, (sent20 - avg(sent20) OVER (PARTITION BY date)) / nullif(stddev_samp(sent20) OVER (PARTITION BY date), 0) + (mom5 - avg(mom5) OVER (PARTITION BY date)) / nullif(stddev_samp(mom5) OVER (PARTITION BY date), 0) AS mre FROM s)
    SELECT date, code, round(mre, 6) + 0.0 AS mre FROM z WHERE mre IS NOT NULL""",
)
def sentiment_momentum(spark, sf_dir):
    articles = Q.statements(spark, sf_dir).select("code", F.date_trunc("week", "ann_date").cast("date").alias("date"), F.col("value").alias("score"))
    rows = research.sentiment_momentum(research.sentiment_panel(Q.scored(spark, sf_dir).withColumn("mom20", F.col("mom5")), articles, 4))
    return rounded(rows.where("mre is not null").select("date", "code", "mre"), "mre", digits=6)


@register("forward_labels", f"WITH {DENSE}, l AS (SELECT date, code, round(lead(close, 5) OVER ({TS}) / nullif(close, 0) - 1, 10) AS ret_5 FROM dense) SELECT date, code, ret_5 + 0.0 AS ret_5, CAST(row_number() OVER (PARTITION BY date ORDER BY ret_5, code) AS INTEGER) AS rank_5 FROM l WHERE ret_5 IS NOT NULL")
def forward_labels(spark, sf_dir):
    place = research.with_labels(Q.dense_week(spark, sf_dir), (5,), 10)
    return place.where("ret_5 is not null").select("date", "code", "ret_5", "rank_5")


@register("latest_percentiles", f"WITH {DENSE}, {SCORES} SELECT date, code, round(mom5, 8) AS mom5, round(vol5, 8) AS vol5 FROM (SELECT date, code, {pct_sql('mom5')} AS mom5, {pct_sql('vol5')} AS vol5 FROM f) WHERE date = (SELECT max(date) FROM f)")
def latest_percentiles(spark, sf_dir):
    return rounded(research.latest_percentiles(Q.scored(spark, sf_dir), ["mom5", "vol5"]), "mom5", "vol5")


@register("directed_ic", f"WITH {IC_SQL} SELECT count(ic) AS n, round(-avg(ic), 8) AS mean, round(-avg(ic) / stddev_samp(ic), 6) AS icir FROM ic")
def directed_ic(spark, sf_dir):
    summary = evaluate.ic_summary(evaluate.rank_ic(Q.labels(spark, sf_dir)))
    return rounded(rounded(evaluate.directed(summary, True, "mean", "icir").select("n", "mean", "icir"), "mean"), "icir", digits=6)


@register(
    "bucket_turnover",
    f"""WITH {DENSE}, {SCORES}, k AS (SELECT t_idx, date, code, mom5 AS factor FROM f WHERE mom5 IS NOT NULL), pl AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY factor, code) AS p FROM k),
    bk AS (SELECT t_idx, code, CAST(greatest(ceil((p - 1) * 5 / greatest(n - 1, 1)::DOUBLE) - 1, 0) AS INTEGER) AS bucket FROM pl)
    SELECT a.t_idx, a.bucket, round(1 - count(b.code) / count(*), 8) AS turnover FROM bk a LEFT JOIN bk b ON b.t_idx + 1 = a.t_idx AND a.code = b.code AND a.bucket = b.bucket GROUP BY 1, 2""",
)
def bucket_turnover(spark, sf_dir):
    from ..functions.windows import quantile_bucket

    rows = Q.scored(spark, sf_dir).where("mom5 is not null").withColumn("factor", F.col("mom5"))
    placed = rows.select("t_idx", "code", quantile_bucket("factor", 5).cast("int").alias("bucket"))
    return rounded(evaluate.turnover(placed).select(F.col("t_idx").cast("long").alias("t_idx"), "bucket", "turnover"), "turnover")


@register(
    "factor_quality",
    f"WITH {IC_SQL}, s AS (SELECT count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic) SELECT n, round(mean, 8) AS mean, round(mean / std, 6) AS icir FROM s",
)
def factor_quality(spark, sf_dir):
    summary, _ = evaluate.quality(Q.scored(spark, sf_dir), "mom5", 5)
    return rounded(rounded(summary.select("n", "mean", "icir"), "mean"), "icir", digits=6)


# ---------------------------------------------------------------- scores, portfolios
PRED = f"pr AS (SELECT code, date, max(value) AS pred FROM (SELECT {CODE.format('o_custkey % 100')} AS code, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_totalprice AS value FROM orders) GROUP BY 1, 2)"


def external_scores(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.date_trunc("week", "o_orderdate").alias("date"), (F.col("o_custkey") % 100).cast("string").alias("code"), F.col("o_totalprice").alias("score"))


@register("pred_top", f"WITH {DENSE}, {SCORES}, {PRED}, p AS (SELECT f.date, f.code, pred, row_number() OVER (PARTITION BY f.date ORDER BY pred DESC, f.code DESC) AS r FROM f JOIN pr USING (code, date) WHERE close > 0) SELECT date, code, pred, CAST(r AS INTEGER) AS rank FROM p WHERE r <= 3")
def pred_top(spark, sf_dir):
    rows = joins.with_scores(Q.scored(spark, sf_dir), external_scores(spark, sf_dir)).where("close > 0")
    return selection.rank_select(rows, 3, score="pred").select("date", "code", "pred", "rank")


def pred_targets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The panel with opens, and monthly targets of the three best by external scores."""
    panel = factors.open_to_open(joins.with_scores(Q.scored(spark, sf_dir), external_scores(spark, sf_dir)))
    cal = selection.rebalance_days(panels.calendar(panel)).where("is_exec").select(F.col("t_idx").alias("x"))
    chosen = selection.equal_weights(selection.rank_select(panel.where("close > 0"), 3, score="pred")).withColumn("x", F.col("t_idx") + 1)
    return panel, chosen.join(F.broadcast(cal), "x", "left_semi").select(F.col("x").alias("t_idx"), "code", "weight")


@register(
    "pred_nav",
    "WITH "
    + NAV_SQL.replace(TRADABLE, f"{PRED}, ok AS (SELECT f.*, pr.pred FROM f JOIN pr USING (code, date) WHERE close > 0)").replace("ORDER BY mom5 DESC, code DESC", "ORDER BY pred DESC, code DESC")
    + " SELECT date, t_idx, CAST(printf('%.8e', nav) AS DOUBLE) AS nav FROM nav",
)
def pred_nav(spark, sf_dir):
    return Q.significant(backtest.weight_nav(*pred_targets(spark, sf_dir)), "nav")


def exposures(spark, sf_dir) -> DataFrame:
    rows = Q.scored(spark, sf_dir).withColumns({"mom20": F.col("mom5"), "vol20": F.col("vol5")})
    return portfolio.style_exposures(rows)


@register("risk_by_factor")
def risk_by_factor(spark, sf_dir):
    """Shares of the variance of a portfolio of equal weights by factor, for each year."""
    xs = ["liquidity", "momentum", "volatility"]
    rows = exposures(spark, sf_dir).withColumn("fwd", forward_return("close", 1)).select(F.year("date").alias("year"), "date", "code", "fwd", *xs)
    return rounded(portfolio.attributed_risk(rows, "year", "fwd", xs), "share", digits=6)


# ---------------------------------------------------------------- runs
def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    quotes = Q.quotes(spark, sf_dir, True)
    return backtest.run_scenarios(quotes, sweeps.scenario_table(spark, {"stock": {"capital": 1e7}, "etf": {"capital": 1e7, "asset": "etf", "stops": True}})), quotes


@register("backtest_fills")
def backtest_fills(spark, sf_dir):
    return rounded(backtest.fills(_runs(spark, sf_dir)[0]), "price", "amount", "fee", digits=6)


@register("backtest_rejections")
def backtest_rejections(spark, sf_dir):
    return backtest.rejections(_runs(spark, sf_dir)[0])


@register("backtest_holdings")
def backtest_holdings(spark, sf_dir):
    return rounded(backtest.holdings(*_runs(spark, sf_dir)), "price", "weight", digits=6)


@register("paper_run", "SELECT 'cash' AS account, true AS idempotent, CAST(0 AS BIGINT) AS mismatches UNION ALL SELECT 'events', true, CAST(0 AS BIGINT)")
def paper_run(spark, sf_dir):
    """Two runs of paper accounts, one to the middle and one to the end and once more: days are written once, and equal a backtest's."""
    out = None
    for name, events, params in (("cash", False, {"capital": 1e7}), ("events", True, {"strategy": "golden_cross", "short": 3, "long": 8, "capital": 1e7, "shorts": False})):
        accounts = sweeps.scenario_table(spark, {name: params})
        # no more rows than codes in reach have days; all runs read the same ones, and a run to an earlier day needs no others
        quotes = (backtest.reached(Q.event_quotes(spark, sf_dir), accounts) if events else Q.quotes(spark, sf_dir, True)).persist()
        last = quotes.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        middle = date.fromordinal((last.a.toordinal() + last.b.toordinal()) // 2)
        empty = spark.createDataFrame([], paper.EQUITY)
        half = paper.paper_run(empty, accounts, quotes, middle, events).persist()  # a row for each day, read twice by the next run
        whole = paper.paper_run(half, accounts, quotes, last.b, events).persist()
        again = paper.paper_run(whole, accounts, quotes, last.b, events).persist()
        straight = backtest.run_scenarios(quotes, accounts, backtest.event_backtest if events else backtest.cash_backtest)
        found = evaluate.alignment(again, straight, ["scenario_id", "date"], "nav")
        same = again.agg(F.count(F.lit(1)).alias("days"), F.count_distinct("date").alias("dates"))
        row = found.crossJoin(F.broadcast(same)).select(F.lit(name).alias("account"), ((F.col("days") == F.col("dates")) & (F.col("n") == F.col("days"))).alias("idempotent"), "mismatches")
        out = row if out is None else out.unionByName(row)
    return out


@register("rolling_train_test")
def rolling_train_test(spark, sf_dir):
    """The golden cross that was best in each fold, in the fold after it."""
    rows = Q.event_quotes(spark, sf_dir)
    days = [r.date for r in panels.calendar(rows.select("date")).orderBy("date").collect()]
    found = sweeps.sweep(rows, sweeps.cross_grid([3, 5], [8, 13], capital=1e7), sweeps.split_windows(days, 4))
    return rounded(sweeps.rolling_choice(found), "train_sharpe", "test_total", "test_sharpe", digits=6)
