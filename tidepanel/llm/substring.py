"""Exact substring deduplication by level-wise doubling of repeated word windows.

The first level hashes every window of a few words.  Only positions whose window is repeated, and which
are followed by the repeated window that completes them, are extended to twice the length; the last level
has the wanted length.  No level runs over positions that the one before has ruled out, and the levels end
as soon as no candidate survives.

Keys travel as one compact row per (chunk, bucket), distinct within the chunk, so that a passage
that occurs in a third of all documents costs one key per chunk and no pairs are ever made.  What
comes back to a chunk is one bit for each key.  Keys of the levels that only rule out have 48 bits
within a bucket; those of the last level, which decide, have 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEYS = "bucket long, chunk long, n long, keys binary, twice binary"
BITS = "chunk long, bucket long, n long, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _levels(k: int, shortest: int) -> list[int]:
    """Window lengths that end in k, each at most twice the one before, none below shortest."""
    out = [k]
    while shortest <= (half := (out[0] + 1) // 2) < out[0]:
        out.insert(0, half)
    return out


def distinct(h: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """The sorted distinct keys, the other halves of wide ones, the place of each entry among them, and how many entries each has."""
    if other is None:
        u, back, n = np.unique(h, return_inverse=True, return_counts=True)
        return u, None, back, n
    order = np.lexsort((other, h))
    a, b = h[order], other[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    back = np.empty(len(h), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return a[new], b[new], back, np.bincount(back, minlength=int(new.sum()))


def key_rows(h: np.ndarray, chunk: int, buckets: int, other: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that the keys have; keys with another half are wide."""
    u, v, _, n = distinct(h, other)
    cut, twice = C.bucket_bounds(u, buckets), n > 1
    rows = [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b + 1] > cut[b]]
    yield C.record(
        KEYS,
        bucket=[b for b, _, _ in rows],
        chunk=[chunk] * len(rows),
        n=[int(y - x) for _, x, y in rows],
        keys=[C.narrow(u[x:y]) if v is None else u[x:y].tobytes() + v[x:y].tobytes() for _, x, y in rows],
        twice=[np.packbits(twice[x:y]).tobytes() for _, x, y in rows],
    )


def repeated_keys(keys: DataFrame, buckets: int, tasks: int, wide: bool) -> DataFrame:
    """For each (chunk, bucket) row of keys, a bit for each key: does it occur in another chunk, or twice in this one?  Then, from the next whole byte on, another: is this the first chunk that has it?

    Rows of the buckets from `buckets` on come back as they are, with that bucket.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in C.groups(batches, "bucket"):
            if bucket >= buckets:
                yield C.record(BITS, chunk=[r["chunk"] for r in rows], bucket=[buckets] * len(rows), n=[r["n"] for r in rows], bits=[r["keys"] for r in rows])
                continue
            sizes = np.array([r["n"] for r in rows])
            half = lambda i: np.concatenate([np.frombuffer(r["keys"], np.uint64, r["n"], 8 * i * r["n"]) for r in rows])
            h, other = (half(0), half(1)) if wide else (np.concatenate([C.widen(r["keys"], r["n"]) for r in rows]), None)
            bits = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
            order = np.lexsort((other, h)) if wide else np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            if wide:
                same &= other[order[1:]] == other[order[:-1]]
            bits[order[1:][same]] = True
            bits[order[:-1][same]] = True
            first = np.ones(len(h), dtype=bool)
            first[order[1:][same]] = False
            at = np.cumsum(sizes) - sizes
            packed = [np.packbits(bits[a : a + n]).tobytes() + np.packbits(first[a : a + n]).tobytes() for a, n in zip(at, sizes)]
            yield C.record(BITS, chunk=[r["chunk"] for r in rows], bucket=[bucket] * len(rows), n=sizes.tolist(), bits=packed)

    return C.by_bucket(keys, tasks, "bucket", "chunk").mapInArrow(find, BITS)


def with_answers(chunk_table: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Chunks and the answers to their keys, together: a chunk's body first, then its answers by bucket."""
    a = chunk_table.select("chunk", F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"), F.col("body").alias("data"))
    b = answers.select("chunk", "bucket", "n", F.col(answers.columns[-1]).alias("data"))
    return C.by_bucket(a.unionByName(b), tasks, "chunk", "bucket")


def marked(h: np.ndarray, rows: list[dict], other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of h are repeated, and whose chunk is the first with them, by the rows of answers, which are in the order of the distinct sorted keys."""
    if not len(h):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    back = distinct(h, other)[2]
    bits = (np.concatenate([np.unpackbits(np.frombuffer(r["data"], np.uint8, offset=skip * -(-r["n"] // 8)), count=r["n"]) for r in rows]).astype(bool) for skip in (0, 1))
    return tuple(b[back] for b in bits)


def _candidates(rows: list[dict], win: C.Windows, level: int, levels: list[int], buckets: int) -> np.ndarray:
    """The positions whose windows were asked for at a level: all of the first, else those of the chunk's map."""
    if level == 0:
        return win.starts(levels[0])
    kept = next((r["data"] for r in rows if r["bucket"] == buckets), None)
    return np.zeros(0, dtype=np.int64) if kept is None else np.flatnonzero(np.unpackbits(np.frombuffer(pa.decompress(kept, win.n // 8 + 1, "zstd"), np.uint8), count=win.n))


def substring_dedup(docs: DataFrame, min_words: int = 35, shortest: int = 5, keep_text: bool = False) -> DataFrame:
    """Remove each word that a window of min_words words covers whose word sequence also starts anywhere else.

    docs: doc_id long, text string; other columns are ignored.  Words are runs of characters other
    than ASCII white space, unchanged; a window lies within one document, but the other occurrence
    may be in the same document and may overlap it.  Windows are judged on the input.  The levels double
    from the least length of at least `shortest` words.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and with
    keep_text those words as `kept`.  One row for each input row.  Null or empty texts have no words;
    repeated rows count as occurrences of each other; a null doc_id is returned as null; texts shorter
    than min_words are never cut; an empty table gives no rows.
    """
    table = C.chunks(docs, C.CHUNK_BYTES)
    n_bytes = table.agg(F.sum("n_bytes")).first()[0] or 0
    tokens = C.word_chunks(table)
    tasks = C.partitions(docs.sparkSession, n_bytes // 6)
    buckets = 4 * tasks
    levels = _levels(min_words, shortest)

    def keys(w: C.Words, win: C.Windows, p: np.ndarray, level: int, chunk: int) -> Iterator[pa.RecordBatch]:
        k, last = levels[level], level == len(levels) - 1
        if not len(p):
            return
        yield from key_rows(win.hash(p, k), chunk, buckets, C.Windows(w, second=True).hash(p, k) if last else None)
        if level:
            kept = np.zeros(8 * (win.n // 8 + 1), dtype=bool)
            kept[p] = True
            yield C.record(KEYS, bucket=[buckets + chunk % buckets], chunk=[chunk], n=[len(p)], keys=[pa.compress(np.packbits(kept).tobytes(), "zstd", asbytes=True)], twice=[b""])

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = C.read_words(row["body"])
                win = C.Windows(w)
                yield from keys(w, win, win.starts(levels[0]), 0, row["chunk"])

    def next_keys(level: int):
        """Of the positions of the level before that are repeated, those followed by the repeated window that completes this level's."""
        k, longer = levels[level - 1], levels[level]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, rows in C.groups(batches, "chunk"):
                if len(rows) > 1:
                    w = C.read_words(rows[0]["data"])
                    win = C.Windows(w)
                    p = _candidates(rows, win, level - 1, levels, buckets)
                    hit = np.zeros(win.n + longer, dtype=bool)
                    hit[p[marked(win.hash(p, k), [r for r in rows[1:] if r["bucket"] < buckets])[0]]] = True
                    p = np.flatnonzero(hit[: win.n])
                    yield from keys(w, win, p[(p + longer <= win.end[p]) & hit[p + longer - k]], level, chunk)

        return run

    answers: DataFrame | None = None
    for level in range(len(levels)):
        asked = tokens.select("chunk", "body").mapInArrow(first_keys, KEYS) if answers is None else with_answers(tokens, answers, tasks).mapInArrow(next_keys(level), KEYS)
        before, answers = answers, C.materialise(repeated_keys(asked, buckets, tasks, level == len(levels) - 1), "bits")
        if before is not None:
            C.discard(before)
        if answers.isEmpty():  # no candidate has survived
            break

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.groups(batches, "chunk"):
            body = C.from_body(rows[0]["data"])
            texts = C.encoded(body.column("text").chunk(0))
            w = C.read_words(rows[1]["data"])
            cut = np.zeros(len(w.h), dtype=bool)
            if len(rows) > 2:
                win = C.Windows(w)
                p = _candidates(rows, win, len(levels) - 1, levels, buckets)
                again, _ = marked(win.hash(p, min_words), [r for r in rows[2:] if r["bucket"] < buckets], C.Windows(w, second=True).hash(p, min_words))
                cut = C.covered(len(w.h), p[again], min_words)
            total = np.concatenate(([0], np.cumsum(cut)))
            removed = total[w.first[1:]] - total[w.first[:-1]]
            out = []
            for i, text in enumerate(texts):
                parts = text.split()
                out.append(b" ".join(compress(parts, ~cut[w.first[i] : w.first[i + 1]]) if removed[i] else parts))
            yield C.record(RESULT, doc_id=body.column("doc_id").to_pylist(), n_words=w.n_words.tolist(), n_removed=removed.tolist(), kept_sha256=[hashlib.sha256(x).hexdigest() for x in out], kept=[x.decode() if keep_text else None for x in out])

    text = table.select("chunk", F.lit(-2).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"), F.col("body").alias("bits"))
    out = with_answers(tokens, answers.unionByName(text), tasks).mapInArrow(finish, RESULT)
    return out if keep_text else out.drop("kept")
