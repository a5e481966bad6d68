"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (1 to 3 letters, a blank standing for either end of a
word; none spans two words) by rank.  A document takes the language whose profile is nearest by the out-of-place distance:
the sum over the document's own ranked n-grams of the difference of ranks, or of the greatest possible
difference where the language lacks the n-gram.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

COUNTS = "lang string, gram long, n long"
RESULT = "doc_id long, lang_pred string, score double"
FLUSH = 200_000


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """The codes of all 1- to 3-grams, 21 bits a letter, so that different n-grams never share a code; none without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    c = np.where(letter, c, 32).astype(np.int64)
    c = np.concatenate(([32], c, [32]))
    blank = c == 32
    c = c[~(blank & np.concatenate(([False], blank[:-1])))]
    one = c[c != 32]
    two = (c[:-1] << 21) | c[1:]
    three = ((two[:-1] << 21) | c[2:])[c[1:-1] != 32]
    return np.concatenate((one, two, three))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    u, n = np.unique(codes, return_counts=True)
    if len(u) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        u, n = u[keep], n[keep]
    return u[np.argsort(-n, kind="stable")][:size]


@dataclass
class Profiles:
    """ranks[i, j]: rank of grams[i] (sorted codes) in the profile of langs[j], or size where it has none."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(grams(text), self.size) if text else np.zeros(0, dtype=np.int64)
        if not len(top):
            return "und", 0.0
        if not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        found = self.grams[at] == top
        place = np.where(found[:, None], np.abs(self.ranks[at] - np.arange(len(top))[:, None]), self.size)
        away = np.where(found[:, None] & (self.ranks[at] < self.size), np.minimum(place, self.size), self.size).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1.0 - away[best] / (self.size * len(top)))


def train(docs: DataFrame, size: int = 400) -> Profiles:
    """Count the n-grams of every training document (text, lang; nulls take no part) and keep `size` of them for each language.

    Repeated rows count again; texts without a letter add nothing; without documents there is no language.

    Counts are summed in the worker, flushed at FLUSH distinct n-grams, and summed again by (language,
    n-gram), so a language with most of the rows is no hot key.  What reaches the driver is size rows
    for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            u, n = held.pop(lang)
            return C.record(COUNTS, lang=[lang] * len(u), gram=u.tolist(), n=n.tolist())

        for batch in C.small_batches(batches, "text", 1 << 20):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                u, n = np.unique(grams("\n".join(texts)), return_counts=True)
                if lang in held:
                    a, b = held[lang]
                    codes = np.concatenate((a, u))
                    u, back = np.unique(codes, return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate((b, n))).astype(np.int64)
                if len(u):
                    held[lang] = (u, n)
                if len(u) > FLUSH:
                    yield out(lang)
        for lang in list(held):
            yield out(lang)

    C.bound_batches(docs.sparkSession)
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = C.materialise(known.mapInArrow(count, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # each task keeps its own `size` first, so a language's window has few rows however many n-grams it has
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "place", "gram").collect()
    langs = sorted({r.lang for r in found})
    tops = [[r.gram for r in sorted((r for r in found if r.lang == lang), key=lambda r: r.place)] for lang in langs]
    codes = np.unique(np.array([g for t in tops for g in t], dtype=np.int64))
    ranks = np.full((len(codes), len(langs)), size, dtype=np.int64)
    for j, t in enumerate(tops):
        ranks[np.searchsorted(codes, t), j] = np.arange(len(t))
    return Profiles(langs, codes, ranks, size)


def predict(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text), over the whole text.

    lang_pred is `und` with score 0 where the text is null or has no letter, or the model knows no
    language.  Ties between languages go to the first by name.  One row for each input row, repeated rows and
    null ids included; an empty table gives no rows; other columns of any name are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, "text"):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield C.record(RESULT, doc_id=batch.column(0).to_pylist(), lang_pred=[a for a, _ in found], score=[b for _, b in found])

    return C.with_columns_first(docs, ["doc_id", "text"]).mapInArrow(run, RESULT)


def held_out(doc_id, modulus: int, remainder: int):
    """Is crc32 of the id as text that remainder?  False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def annotate(docs: DataFrame, model: Profiles) -> DataFrame:
    """docs with two columns more, the last: lang_pred and score as predict() has them, with underscores before the names if docs has such columns."""
    from pyspark.sql import types as T

    C.bound_batches(docs.sparkSession)
    lang, score = C.fresh(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, "text"):
            found = [model.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.append_column(lang, pa.array([a for a, _ in found], pa.string())).append_column(score, pa.array([b for _, b in found], pa.float64()))

    return docs.mapInArrow(run, schema)
