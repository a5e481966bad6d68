"""Incremental counterparts: batches upserted by key, rolling state by code, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.panels import dedupe_last
from ..sources.sinks import merge_into

BARS = "code string, date date, turnover double, amount double"
BASE = "code string, date date, turnover double, amount double, turn20 double, am20 double"


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, recency: list[str] | None = None):
    """Each batch replaces the rows of its keys, so late or repaired dates come out right and a repeated batch changes nothing.

    Of a batch's rows of one key the latest by `recency` counts; rows equal in that, or without it all rows of
    a key, are ordered by all their columns, the largest last.
    """

    def batch(rows: DataFrame, _: int) -> None:
        order = [*(recency or []), *(c for c in rows.columns if c not in keys)]
        merge_into(dedupe_last(rows, keys, [F.col(c) for c in order]), path, keys)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_base_stream(stream: DataFrame, n: int = 20, min_periods: int = 15) -> DataFrame:
    """turn20 and am20 of bars that arrive in date order by code; the state is each code's last n - 1 bars."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("date", ignore_index=True)
        old = np.array(state.get[0], dtype=float).reshape(-1, 2) if state.exists else np.zeros((0, 2))
        values = np.vstack((old, rows[["turnover", "amount"]].to_numpy(float)))
        means = pd.DataFrame(values).rolling(n, min_periods=min_periods).mean().to_numpy()[len(old) :]
        state.update((values[-(n - 1) :].ravel().tolist() if n > 1 else [],))
        out = rows[["code", "date", "turnover", "amount"]].assign(turn20=means[:, 0], am20=means[:, 1])
        yield out.astype(object).where(out.notna(), None)

    return stream.select("code", "date", "turnover", "amount").groupBy("code").applyInPandasWithState(update, BASE, "last array<double>", "append", "NoTimeout")


def windowed(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows; works on tables too."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user's events with no gap as long as `gap`."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    w = F.session_window("ts", gap)
    return rows.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_memory(spark: SparkSession, rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what is there and return the sink's table."""
    q = rows.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
