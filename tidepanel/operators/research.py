"""Factor research: alpha expressions, labels, evaluation of many factors at once, and a boosted-tree score.

An alpha is a name and a column over the dense panel, so any number of them is one projection.  The
candle family is that of the published price-shape factors; others are textbook forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_half_away
from ..functions.windows import avg_rank, change, cs, forward_return, frame, pct_rank, ratio, rolling, ts
from .evaluate import group_returns, ic_summary, rank_ic


def candle_alphas() -> dict[str, Column]:
    """Shapes of one bar, relative to its open or its range."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = F.nullif(h - l, F.lit(0.0))
    top, bottom = F.greatest(o, c), F.least(o, c)
    return {
        "KMID": ratio(c - o, o),
        "KLEN": ratio(h - l, o),
        "KMID2": (c - o) / span,
        "KUP": ratio(h - top, o),
        "KUP2": (h - top) / span,
        "KLOW": ratio(bottom - l, o),
        "KLOW2": (bottom - l) / span,
        "KSFT": ratio(2 * c - h - l, o),
        "KSFT2": (2 * c - h - l) / span,
    }


def rolling_alphas(windows: tuple[int, ...] = (5, 10, 20, 30, 60)) -> dict[str, Column]:
    """Rolling families over the close, high, low and volume, one of each for every window."""
    out: dict[str, Column] = {}
    c, v = F.col("close"), F.col("volume")
    for n in windows:
        hi, lo = rolling(F.max, "high", n), rolling(F.min, "low", n)
        out |= {
            f"ROC{n}": ratio(F.lag("close", n).over(ts()), c),
            f"MA{n}": ratio(rolling(F.avg, "close", n), c),
            f"STD{n}": ratio(rolling(F.stddev_samp, "close", n), c),
            f"MAX{n}": ratio(hi, c),
            f"MIN{n}": ratio(lo, c),
            f"RSV{n}": ratio(c - lo, hi - lo),
            f"VMA{n}": ratio(rolling(F.avg, "volume", n), v),
            f"VSTD{n}": ratio(rolling(F.stddev_samp, "volume", n), v),
            f"QTLU{n}": ratio(rolling(lambda x: F.percentile(x, F.lit(0.8)), "close", n), c),
            f"QTLD{n}": ratio(rolling(lambda x: F.percentile(x, F.lit(0.2)), "close", n), c),
        }
    return out


def _correlation(a: Column, b: Column, n: int) -> Column:
    """The rolling correlation of two columns; null with a gap, or where one of them is constant."""
    w = frame(n)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.when(F.count(x).over(w) >= n, ratio(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)))


def trend_alphas(windows: tuple[int, ...] = (5, 10, 20, 30, 60)) -> dict[str, Column]:
    """Rolling lines through the close, and correlations of price and volume; over a dense panel (t_idx)."""
    out: dict[str, Column] = {}
    c = F.col("close")
    log_volume = F.log1p("volume")
    for n in windows:
        w = frame(n)
        full = F.count("close").over(w) >= n
        slope, level = F.regr_slope("close", "t_idx").over(w), F.regr_intercept("close", "t_idx").over(w)
        out |= {
            f"BETA{n}": F.when(full, ratio(slope, c)),
            f"RSQR{n}": F.when(full & (F.var_pop("close").over(w) * n >= 1e-12), F.regr_r2("close", "t_idx").over(w)),
            f"RESI{n}": F.when(full, ratio(c - (slope * F.col("t_idx") + level), c)),
            f"CORR{n}": _correlation(c, log_volume, n),
        }
    return out


def move_alphas(windows: tuple[int, ...] = (5, 10, 20, 30, 60)) -> dict[str, Column]:
    """Shares of rising and falling steps, and of their sizes; over a panel with `ret`, `step` and `vstep` (with_steps)."""
    out: dict[str, Column] = {}
    for n in windows:
        up, down = (rolling(F.avg, F.when(F.col("ret").isNotNull(), cond.cast("double")), n) for cond in (F.col("ret") > 0, F.col("ret") < 0))
        out |= {f"CNTP{n}": up, f"CNTN{n}": down, f"CNTD{n}": up - down}
        for prefix, step in (("SUM", "step"), ("VSUM", "vstep")):
            total = rolling(F.sum, F.abs(step), n)
            gain, loss = (ratio(rolling(F.sum, F.greatest(sign * F.col(step), F.lit(0.0)), n), total) for sign in (1, -1))
            out |= {f"{prefix}P{n}": gain, f"{prefix}N{n}": loss, f"{prefix}D{n}": gain - loss}
    return out


def with_steps(panel: DataFrame) -> DataFrame:
    """step and vstep: the changes of close and volume."""
    return panel.withColumns({"step": F.col("close") - F.lag("close").over(ts()), "vstep": F.col("volume") - F.lag("volume").over(ts())})


def alpha_set(name: str) -> dict[str, Column]:
    return {"candles": candle_alphas(), "rolling": rolling_alphas(), "trends": trend_alphas(), "moves": move_alphas(), "all": candle_alphas() | rolling_alphas() | trend_alphas() | move_alphas()}[name]


def with_vwap(panel: DataFrame, lot: float = 1.0) -> DataFrame:
    return panel.withColumn("vwap", ratio(F.col("amount"), F.col("volume") * lot))


def with_labels(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), digits: int | None = None) -> DataFrame:
    """ret_h: forward returns, rounded to `digits` if given; rank_h: their place on the date, ties to the smaller code."""
    made = lambda h: forward_return("close", h) if digits is None else round_half_away(forward_return("close", h), digits)
    rows = panel.withColumns({f"ret_{h}": made(h) for h in horizons})
    return rows.withColumns({f"rank_{h}": F.when(F.col(f"ret_{h}").isNotNull(), F.row_number().over(cs().orderBy(F.col(f"ret_{h}").asc_nulls_last(), "code"))) for h in horizons})


def long_format(panel: DataFrame, names: list[str], ret: str) -> DataFrame:
    """One row for each (date, code, name) with factor and fwd."""
    return panel.select("date", "t_idx", "code", F.col(ret).alias("fwd"), F.posexplode(F.array(*[F.col(n) for n in names])).alias("_i", "factor")).select("date", "t_idx", "code", "fwd", F.get(F.array(*[F.lit(n) for n in names]), F.col("_i")).alias("name"), "factor")


def evaluate(panel: DataFrame, names: list[str], ret: str, min_n: int = 10, groups: int = 5) -> dict[str, DataFrame]:
    """Tables of all factors at once: ic, groups, coverage, autocorrelation of ranks."""
    rows = long_format(panel, names, ret)
    known = rows.where("factor is not null and fwd is not null")
    # the date and the name together are the cross section, so that all factors go through one exchange
    key = F.concat_ws("|", F.col("date").cast("string"), "name")
    cross = known.select(key.alias("date"), "code", "factor", "fwd")
    split = lambda df: df.withColumn("name", F.substring_index("date", "|", -1)).withColumn("date", F.to_date(F.substring_index("date", "|", 1)))
    ic = split(rank_ic(cross, min_n))
    coverage = rows.groupBy("name").agg(F.count("factor").alias("n"), (F.count("factor") / F.count(F.lit(1))).alias("coverage"))
    ranked = rows.withColumn("rank", pct_rank("factor", "date", "name"))
    before = ranked.select((F.col("t_idx") + 1).alias("t_idx"), "code", "name", F.col("rank").alias("_before"))
    both = ranked.join(before, ["t_idx", "code", "name"]).where("rank is not null and _before is not null")
    auto = both.groupBy("name").agg(F.try_divide(F.covar_pop("rank", "_before"), F.stddev_pop("rank") * F.stddev_pop("_before")).alias("autocorrelation"))
    return {"ic": ic, "summary": ic_summary(ic, ["name"]), "groups": split(group_returns(cross, groups, min_n)), "coverage": coverage, "autocorrelation": auto}


def latest_percentiles(panel: DataFrame, names: list[str]) -> DataFrame:
    """The last date's percentile of each factor."""
    last = F.broadcast(panel.agg(F.max("date").alias("date")))
    return panel.join(last, "date").select("date", "code", *[pct_rank(n).alias(n) for n in names])


def boosted_scores(panel: DataFrame, features: list[str], label: str, train_share: float = 0.7, **options) -> DataFrame:
    """date, code, score of gradient-boosted trees fitted on the first share of dates, with medians for missing features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    cut = panel.where(F.col(label).isNotNull()).select("date").distinct().agg(F.percentile_approx(F.unix_date("date"), train_share).alias("d")).first().d
    rows = panel.select("date", "code", F.col(label).alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    filled = [f"{f}_filled" for f in features]
    model = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="score", **({"maxIter": 20, "maxDepth": 3, "seed": 7} | options))])
    train = rows.where(F.col("_y").isNotNull() & (F.unix_date("date") <= F.lit(cut)))
    return model.fit(train).transform(rows).select("date", "code", "score")


def sentiment_panel(panel: DataFrame, articles: DataFrame, n: int = 20) -> DataFrame:
    """The panel with sent20 and cnt20: rolling mean and count of the daily mean scores (code, date, score)."""
    daily = articles.groupBy("code", "date").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("articles"))
    rows = panel.join(daily, ["code", "date"], "left")
    return rows.withColumns({"sent20": rolling(F.avg, "score", n, 1), "cnt20": rolling(F.sum, "articles", n, 1)})


def sentiment_momentum(panel: DataFrame) -> DataFrame:
    """mre: z(sent20) + z(mom20) by date."""
    from ..functions.windows import zscore

    return panel.withColumn("mre", zscore("sent20") + zscore("mom20"))


__all__ = ["alpha_set", "avg_rank", "boosted_scores", "candle_alphas", "change", "evaluate", "latest_percentiles", "rolling_alphas", "sentiment_momentum", "sentiment_panel", "with_labels", "with_vwap"]
