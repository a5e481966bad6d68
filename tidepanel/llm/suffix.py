"""Repeated passages by sparse suffix arrays.

Only suffixes that start at minimisers are retained: positions whose run of `seed` words has the least
hash among the min_words - seed + 1 runs of some window of min_words words.  The choice depends on the
words alone, so both copies of a repeated window retain the same suffix.

Suffixes whose seed no other suffix has are dropped.  The others are sorted, in ranges over all
executors, by their seed and then word by word; the common prefix with the nearer neighbour is the farthest
that a match of the suffix extends to the right.  Matches are then extended to the left: of the windows
of min_words words that hold the seed, those that end within the common prefix are compared as wholes, by
keys of 128 bits.  What matches is the set of windows of min_words words that occur twice or more.

All keys are distinct within a chunk: a passage in a third of all documents costs one key per chunk,
and no pairs of occurrences are made.  A seed that very many different contexts share is sorted by the
words that follow it, so it spreads over ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .substring import BITS, KEYS, key_rows, marked, repeated_keys, with_answers

SPANS = "doc_id long, start_word long, n_words long, n_removed long"
SUFFIXES = "suffix binary, chunk long, code long, twice boolean"
WORD = 6  # bytes of a word in a sort key
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(a: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over a[i : i + width] for each i that has a whole window."""
    reach = 1
    while 2 * reach <= width:
        a = take(a[:-reach], a[reach:])
        reach *= 2
    return take(a[: len(a) - (width - reach)], a[width - reach :]) if width > reach else a


def minimisers(win: C.Windows, seed: int, min_words: int) -> np.ndarray:
    """The positions that have the least seed hash of some whole window of min_words words; all of them where several have it."""
    n, width = win.n, min_words - seed + 1
    if n < min_words:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, MOST)
    p = win.starts(seed)
    h[p] = win.hash(p, seed)
    whole = win.starts(min_words)
    least = np.zeros(n, dtype=np.uint64)
    least[whole] = _sliding(h, width, np.minimum)[whole]
    best = _sliding(np.concatenate((np.zeros(width - 1, dtype=np.uint64), least)), width, np.maximum)
    return p[(best[p] == h[p]) & (h[p] > 0)]


def sort_keys(win: C.Windows, w: C.Words, p: np.ndarray, seed: int, min_words: int) -> np.ndarray:
    """For each suffix the bytes that sort it: its seed's hash, then the next words up to min_words, zeros behind the end of the document, and a one."""
    n = min_words - seed
    at = p[:, None] + seed + np.arange(n)
    inside = at < win.end[p][:, None]
    word = np.where(inside, w.h[np.minimum(at, win.n - 1)] | np.uint64(1 << 16), np.uint64(0))
    out = np.ones((len(p), 8 + WORD * n + 1), dtype=np.uint8)
    out[:, :8] = win.hash(p, seed).astype(">u8").view(np.uint8).reshape(-1, 8)
    if n:
        out[:, 8:-1] = word.astype(">u8").view(np.uint8).reshape(len(p), n, 8)[:, :, :WORD].reshape(len(p), -1)
    return out.view(f"S{out.shape[1]}").ravel()


def _word_bytes(keys: np.ndarray) -> np.ndarray:
    """The words behind the seed of sort keys (rows of bytes)."""
    return keys[:, 8:-1].reshape(len(keys), (keys.shape[1] - 9) // WORD, WORD)


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words behind the seed rows of sort keys share, -1 where the seeds differ."""
    x, y = _word_bytes(a), _word_bytes(b)
    same = (x == y).all(axis=2) & x.any(axis=2)
    return np.where((a[:, :8] == b[:, :8]).all(axis=1), np.cumprod(same, axis=1).sum(axis=1), -1)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of sorted suffixes: chunk, code, and how many words behind the seed the nearer neighbour shares.

    Before the first and behind the last row of a range lie others that it doesn't know, so these two share
    all they have.
    """
    held: tuple[np.ndarray, ...] | None = None  # the last row, whose next is not known yet, and what it shares so far

    def whole(k: np.ndarray) -> np.ndarray:
        return _word_bytes(k).any(axis=2).sum(axis=1)

    for batch in batches:
        rows = batch.column(0).to_pylist()
        if not rows:
            continue
        k = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), len(rows[0]))
        c, d, twice = np.asarray(batch.column(1)), np.asarray(batch.column(2)), np.array(batch.column(3).to_pylist(), dtype=bool)
        share = np.where(twice, whole(k), -1)
        if held is None:
            share[0] = whole(k[:1])[0]
        else:
            c, d, k, share = (np.concatenate(x) for x in zip(held, (c, d, k, share)))
        near = common_words(k[1:], k[:-1])
        share[1:] = np.maximum(share[1:], near)
        share[:-1] = np.maximum(share[:-1], near)
        held = c[-1:], d[-1:], k[-1:], share[-1:]
        yield c[:-1], d[:-1], share[:-1]
    if held is not None:
        yield held[0], held[1], whole(held[2])


def _candidates(win: C.Windows, p: np.ndarray, share: np.ndarray, seed: int, min_words: int) -> np.ndarray:
    """Starts of the windows that hold a suffix's seed and end no more than `share` words behind it."""
    reach = min_words - seed
    near = np.zeros(win.n + 2, dtype=np.int32)
    np.add.at(near, np.maximum(p - reach, 0), 1)
    np.add.at(near, np.maximum(p - reach + np.maximum(share, -1) + 1, 0), -1)
    at = np.flatnonzero(np.cumsum(near[: win.n]) > 0)
    return at[at + min_words <= win.end[at]]


def _found(docs: DataFrame, min_words: int, seed: int, extra: tuple[str, ...]) -> tuple[DataFrame, int]:
    """Chunks with their words and the answers to all comparisons, and the number of buckets of each."""
    table = C.chunks(docs, C.CHUNK_BYTES, extra)
    tokens = C.word_chunks(table)
    tasks = C.partitions(docs.sparkSession, (table.agg(F.sum("n_bytes")).first()[0] or 0) // 24)
    buckets = 4 * tasks

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                win = C.Windows(C.read_words(row["body"]))
                yield from key_rows(win.hash(minimisers(win, seed, min_words), seed), row["chunk"], buckets)

    def retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in C.groups(batches, "chunk"):
            w = C.read_words(rows[0]["data"])
            win = C.Windows(w)
            p = _retained(win, rows[1:], seed, min_words)
            if len(p):
                u, n = np.unique(sort_keys(win, w, p, seed, min_words), return_counts=True)
                yield C.record(SUFFIXES, suffix=u.tolist(), chunk=[chunk] * len(u), code=list(range(len(u))), twice=(n > 1).tolist())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = 2 * buckets + TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for chunk, code, share in neighbours(batches):
            order = np.argsort(chunk, kind="stable")
            ids, first = np.unique(chunk[order], return_index=True)
            for c, part in zip(ids.tolist(), np.split(order, first[1:])):
                held.setdefault(c, []).append((code[part], share[part]))
        for chunk, parts in held.items():
            code, share = (np.concatenate(x) for x in zip(*parts))
            yield C.record(BITS, chunk=[chunk], bucket=[at], n=[len(code)], bits=[code.astype(np.int32).tobytes() + share.astype(np.int16).tobytes()])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in C.groups(batches, "chunk"):
            if len(rows) > 1:
                w = C.read_words(rows[0]["data"])
                win = C.Windows(w)
                at = _windows(win, w, rows[1:], buckets, seed, min_words)
                if len(at):
                    yield from key_rows(win.hash(at, min_words), chunk, buckets, C.Windows(w, second=True).hash(at, min_words))

    same_seed = C.materialise(repeated_keys(tokens.select("chunk", "body").mapInArrow(seeds, KEYS), buckets, tasks, False), "seeds")
    suffixes = C.materialise(with_answers(tokens, same_seed, tasks).mapInArrow(retained, SUFFIXES), "suffixes")
    shared = C.materialise(suffixes.repartitionByRange(tasks, "suffix").sortWithinPartitions("suffix", "chunk").mapInArrow(compare, BITS), "shared")
    C.discard(suffixes)
    known = same_seed.unionByName(shared)
    matches = C.materialise(repeated_keys(with_answers(tokens, known, tasks).mapInArrow(extended, KEYS), buckets, tasks, True), "matches")
    text = table.select("chunk", F.lit(-2).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"), F.col("body").alias("bits"))
    every = known.unionByName(matches.withColumn("bucket", F.col("bucket") + buckets)).unionByName(text)
    return with_answers(tokens, every, tasks), buckets


def _retained(win: C.Windows, rows: list[dict], seed: int, min_words: int) -> np.ndarray:
    """The minimisers whose seeds are repeated."""
    p = minimisers(win, seed, min_words)
    return p[marked(win.hash(p, seed), rows)[0]]


def _windows(win: C.Windows, w: C.Words, rows: list[dict], buckets: int, seed: int, min_words: int) -> np.ndarray:
    """Starts of the windows that the common prefixes of the chunk's suffixes allow."""
    p = _retained(win, [r for r in rows if r["bucket"] < buckets], seed, min_words)
    if not len(p):
        return p
    _, back = np.unique(sort_keys(win, w, p, seed, min_words), return_inverse=True)
    share = np.zeros(int(back.max()) + 1, dtype=np.int64)
    for r in rows:
        if r["bucket"] >= 2 * buckets:
            share[np.frombuffer(r["data"], np.int32, r["n"])] = np.frombuffer(r["data"], np.int16, r["n"], 4 * r["n"])
    return _candidates(win, p, share[back], seed, min_words)


def _cover(w: C.Words, rows: list[dict], buckets: int, seed: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in a repeated window, and which in one that is not the first of its kind."""
    if not rows:
        return np.zeros(len(w.h), dtype=bool), np.zeros(len(w.h), dtype=bool)
    win = C.Windows(w)
    at = _windows(win, w, rows, buckets, seed, min_words)
    h = win.hash(at, min_words)
    again, first = marked(h, [r for r in rows if buckets <= r["bucket"] < 2 * buckets], C.Windows(w, second=True).hash(at, min_words))
    first_here = np.zeros(len(h), dtype=bool)
    first_here[np.unique(h, return_index=True)[1]] = True
    return C.covered(win.n, at[again], min_words), C.covered(win.n, at[again & ~(first & first_here)], min_words)


def repeated_spans(docs: DataFrame, min_words: int = 50, seed: int = 25) -> DataFrame:
    """The maximal runs of words covered by windows of min_words words that occur twice or more in docs.

    docs: doc_id long, text string; other columns are ignored.  Words are runs of characters other than
    ASCII white space; a window lies within one document; the other occurrence may be in the same
    document, may overlap, and repeated rows count.  Returns doc_id, start_word (from 0), n_words and
    n_removed: the span's words that are not in a first occurrence (in the order of the table).  Documents
    without such a run give no rows, nor do null, empty or short texts.
    """
    found, buckets = _found(docs, min_words, seed, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.groups(batches, "chunk"):
            body = C.from_body(rows[0]["data"])
            w = C.read_words(rows[1]["data"])
            every, later = _cover(w, rows[2:], buckets, seed, min_words)
            ids, starts, lens, removed = [], [], [], []
            doc_ids = body.column("doc_id").to_pylist()
            edge = np.zeros(len(every) + 1, dtype=bool)
            edge[w.first] = True  # spans end with their document
            begin = np.flatnonzero(every & (edge[:-1] | ~np.concatenate(([False], every[:-1]))))
            end = np.flatnonzero(every & (edge[1:] | ~np.concatenate((every[1:], [False])))) + 1
            doc = np.searchsorted(w.first, begin, side="right") - 1
            total = np.concatenate(([0], np.cumsum(later)))
            for b, e, d in zip(begin.tolist(), end.tolist(), doc.tolist()):
                ids.append(doc_ids[d])
                starts.append(b - int(w.first[d]))
                lens.append(e - b)
                removed.append(int(total[e] - total[b]))
            yield C.record(SPANS, doc_id=ids, start_word=starts, n_words=lens, n_removed=removed)

    return found.mapInArrow(run, SPANS)


def remove_repeats(docs: DataFrame, min_words: int = 50, seed: int = 25) -> DataFrame:
    """docs without the words of repeated windows but those of each window's first occurrence, in the order of the table.

    All columns but text are kept as they are, whatever their names.  A document without repeats keeps its
    text to the byte; in others a removed run goes with the white space after it.  Rows are never dropped,
    repeated rows included; nulls stay null; an empty table gives no rows.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    schema = T.StructType([docs.schema[c] for c in ("doc_id", "text", *others)])
    found, buckets = _found(docs, min_words, seed, others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for _, rows in C.groups(batches, "chunk"):
            body = C.from_body(rows[0]["data"])
            texts = C.encoded(body.column("text").chunk(0))
            w = C.read_words(rows[1]["data"])
            _, later = _cover(w, rows[2:], buckets, seed, min_words)
            new = {name: body.column(name).to_pylist() for name in body.column_names}
            total = np.concatenate(([0], np.cumsum(later)))
            for i in np.flatnonzero(total[w.first[1:]] > total[w.first[:-1]]).tolist():
                cut = later[w.first[i] : w.first[i + 1]]
                begins = [m.start() for m in word.finditer(texts[i])] + [len(texts[i])]
                edge = np.flatnonzero(np.diff(cut, prepend=~cut[:1])).tolist() + [len(cut)]
                text = b"".join(texts[i][begins[a] if a else 0 : begins[b]] for a, b in zip(edge, edge[1:]) if not cut[a])
                new["text"][i] = text.decode()
            yield C.record(schema, **new)

    return found.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in docs.columns])
