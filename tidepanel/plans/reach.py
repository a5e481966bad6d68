"""The codes that an event strategy can ask for, found over all codes in parallel, so that its run holds no others.

A strategy that chooses by places says how it ranks codes (`choices`): no code behind its last place on any day
is ever ordered, whatever the book holds, so leaving those out changes no trade.  Blocks of whole codes give
their own best for each day, and one window over these gives the best of all.  Strategies without `choices`
keep every code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 200_000
FOUND = "scenario_id string, kind int, t_idx long, score double, code string, larger boolean, places int"
_COMPENSATED = sum([0.1] * 10) == 1.0  # sum() of floats carries the lost digits since Python 3.12


@dataclass
class Bars:
    """The closes of whole codes in order of code and day, an element for each.

    nth: how many the code has had before; tradable: turnover on the day and an open on the next one, which
    has `weekday` (0, Monday) and on which the run may trade.
    """

    nth: np.ndarray
    close: np.ndarray
    am20: np.ndarray
    tradable: np.ndarray
    weekday: np.ndarray

    def sums(self, n: int) -> np.ndarray:
        """The sum of the last n closes as sum() gives it, nan for the first ones of a block."""
        m = max(0, len(self.close) - n + 1)
        s, lost = np.zeros(m), np.zeros(m)
        for j in range(n):
            x = self.close[j : j + m]
            t = s + x
            if _COMPENSATED:
                lost += np.where(np.abs(s) >= np.abs(x), (s - t) + x, (x - t) + s)
            s = t
        return np.concatenate((np.full(len(self.close) - m, np.nan), s + np.where(np.isfinite(lost), lost, 0.0)))

    def before(self, x: np.ndarray, n: int) -> np.ndarray:
        """x of n closes before, nan for the first ones of a block; of another code where nth is less than n."""
        out = np.full(len(x), np.nan)
        out[n:] = x[: max(0, len(x) - n)]
        return out


@dataclass
class Choice:
    """Rows that may be chosen, the places of the best by score, and whether ties go to the larger code."""

    ok: np.ndarray
    score: np.ndarray
    places: int
    larger: bool


def _best(code: np.ndarray, t: np.ndarray, c: Choice) -> np.ndarray:
    """The rows of the places of each day."""
    at = np.flatnonzero(c.ok)
    at = at[np.lexsort(((-1 if c.larger else 1) * code[at], -c.score[at], t[at]))]
    new = np.r_[True, np.diff(t[at]) != 0] if len(at) else np.zeros(0, bool)
    return at[np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) < c.places]


def _finder(runs: list[tuple[str, type, dict]], schema: pa.Schema):
    """A function of batches in order of code and date."""
    limits = []
    for _, _, p in runs:
        start, end = (date.fromisoformat(p[k]) if p.get(k) else None for k in ("start", "end"))
        lo = start - timedelta(days=int(p.get("warmup", 400))) if start else None
        limits.append([(x - date(1970, 1, 1)).days if x else other for x, other in ((lo, -(1 << 40)), (start, -(1 << 40)), (end, 1 << 40))])

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = rows["code"].combine_chunks().dictionary_encode()
        code, day, t = names.indices.to_numpy(), rows["date"].cast(pa.int32()).to_numpy().astype(np.int64), rows["t_idx"].to_numpy().astype(np.int64)
        open_, close, am20, turnover = (rows[c].to_numpy() for c in ("open", "close", "am20", "turnover"))
        opens = np.r_[(code[1:] == code[:-1]) & (t[1:] == t[:-1] + 1) & (open_[1:] > 0), False]
        then = np.r_[day[1:], 0]  # the day of execution
        for (scenario, strategy, params), (lo, start, end) in zip(runs, limits):
            at = np.flatnonzero((close > 0) & (day >= lo) & (day <= end))
            new = np.r_[True, np.diff(code[at]) != 0] if len(at) else np.zeros(0, bool)
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            trades = (turnover[at] > 0) & opens[at] & (then[at] >= start) & (then[at] <= end)
            bars = Bars(nth, close[at], am20[at], trades, (then[at] + 3) % 7)
            for kind, c in enumerate(strategy.choices(params, bars)):
                best = _best(code[at], t[at], c)
                if len(best):
                    values = {"scenario_id": [scenario] * len(best), "kind": [kind] * len(best), "t_idx": t[at[best]], "score": c.score[best] + 0.0, "code": names.dictionary.take(pa.array(code[at[best]])), "larger": [c.larger] * len(best), "places": [c.places] * len(best)}
                    yield pa.RecordBatch.from_pydict({f.name: pa.array(values[f.name], f.type) if not isinstance(values[f.name], pa.Array) else values[f.name].cast(f.type) for f in schema}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:  # the last code may go on in the next batch
                rows = pa.Table.from_batches(held)
                code = rows["code"].combine_chunks().dictionary_encode().indices.to_numpy()
                cut = int(np.searchsorted(code, code[-1]))
                if cut:
                    yield from found(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if n:
            yield from found(pa.Table.from_batches(held))

    return run


def reach(quotes: DataFrame, runs: list[tuple[str, type, dict]]) -> DataFrame:
    """scenario_id and code of what each run (id, strategy, params) can ask for; t_idx must number the dates without gaps."""
    schema = pa.schema([("scenario_id", pa.string()), ("kind", pa.int32()), ("t_idx", pa.int64()), ("score", pa.float64()), ("code", pa.string()), ("larger", pa.bool_()), ("places", pa.int32())])
    rows = quotes.select("code", "date", "t_idx", *[F.col(c).cast("double").alias(c) for c in ("open", "close", "am20", "turnover")]).where("open > 0 or close > 0")
    found = rows.repartition("code").sortWithinPartitions("code", "date").mapInArrow(_finder(runs, schema), FOUND)
    order = [F.desc("score"), F.when(~F.col("larger"), F.col("code")).asc(), F.when(F.col("larger"), F.col("code")).desc()]
    n = F.row_number().over(Window.partitionBy("scenario_id", "kind", "t_idx").orderBy(*order))
    return found.withColumn("n", n).where("n <= places").select("scenario_id", "code").distinct()


def reached(quotes: DataFrame, scenarios: DataFrame, strategy_of: Callable[[dict], type], along: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The quotes of each scenario's reach with its scenario_id, and a row without code or prices for each date, so that no day is lost.

    along adds columns by windows over a code's own rows, to the codes in reach alone.  A reach has no more
    codes than dates times places, so it may be broadcast.
    """
    runs = [(r.scenario_id, strategy_of(p := json.loads(r.params)), p) for r in scenarios.collect()]
    ranked = [r for r in runs if r[1].choices is not None]
    every = [r[0] for r in runs if r[1].choices is None]
    out = quotes.select("t_idx", "date").distinct().crossJoin(F.broadcast(scenarios.select("scenario_id"))).withColumn("code", F.lit(""))
    if ranked:
        codes = reach(quotes, ranked).persist()
        some = along(quotes.join(F.broadcast(codes.select("code").distinct()), "code", "left_semi"))
        out = out.unionByName(some.join(F.broadcast(codes), "code"), allowMissingColumns=True)
    if every:
        out = out.unionByName(along(quotes).crossJoin(F.broadcast(scenarios.select("scenario_id").where(F.col("scenario_id").isin(every)))), allowMissingColumns=True)
    return out
