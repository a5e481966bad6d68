"""Line labelling by a linear-chain conditional random field, and the content share that decides retention.

Each line is a position of the chain; its state is content (0) or boilerplate (1).  Emission scores
are linear in a few features of the line, transition scores are learned.  Labels are of documents, so
line labels are latent: a line that many documents have between different neighbours is boilerplate
wherever it stands, the other lines of a good document are content, and those of a bad document are
whatever the model of the round before makes of them, one boilerplate line at least.  The weights
maximise the L2-penalised conditional likelihood of these labels on a bounded sample of labelled
documents.  Viterbi decoding then labels every line of every document.

Common lines are counted over all documents.  A line is common if it has MANY_CONTEXTS pairs of
neighbours or more, and one for each thousand documents; so at most a thousand times the mean number of
lines of a document are common, however large the corpus is, and the model carries their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
N_FEATURES = 11
MANY_CONTEXTS, SHARE_OF_DOCUMENTS = 3, 1000

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_words long, content_share double, kept boolean"


def line_hash(line: bytes) -> int:
    """The hash that xxhash64 of Spark gives the line as a string."""
    h = xxhash.xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def line_features(line: bytes, seen: set[bytes], common: frozenset[int] = frozenset()) -> list[float]:
    """Features of a line with at least one word; seen has the earlier lines of the document."""
    parts = line.split()
    n = len(parts)
    size = sum(map(len, parts))
    symbols = size - sum(len(p.translate(None, SYMBOLS)) for p in parts) if any(s in line for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) else 0
    letters = size - len(line.translate(None, _LETTERS + _SPACES)) if size else 0
    upper = len(line) - len(line.translate(None, _UPPER))
    digits = len(line) - len(line.translate(None, _DIGITS))
    marked = sum(1 for p in parts if p[-1:] in b"#*$%&|<>!")
    return [
        1.0,
        min(1.0, 8.0 * symbols / size),
        min(1.0, 2.0 * upper / max(letters, 1)),
        marked / n,
        min(1.0, 2.0 * digits / size),
        float(parts[-1][-1:] in b".?!;:"),
        1.0 - len(set(parts)) / n,
        float(line in seen),
        min(1.0, np.log1p(n) / 5.0),
        float(n < 3),
        float(line_hash(line) in common),
    ]


def _lines(text: bytes, common: frozenset[int] = frozenset()) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of them equal an earlier line."""
    seen: set[bytes] = set()
    rows, counts, dup = [], [], 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            rows.append(line_features(line, seen, common))
            counts.append(n)
            dup += line in seen
            seen.add(line)
    return rows, counts, dup


def common_lines(docs: DataFrame) -> frozenset[int]:
    """Hashes of the lines that stand between MANY_CONTEXTS different pairs of neighbours or more, and one for each SHARE_OF_DOCUMENTS documents.

    Neighbours are the lines before and after, the edges of the text being one kind each.  Copies of a
    text thus count once, and so does a line of many near copies whose neighbours are the same.
    """
    h = F.transform(F.split("text", "\n"), lambda x: F.when(F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")), F.xxhash64(x)))
    edge = F.array(F.lit(None).cast("long"))
    texts = C.with_columns_first(docs, ["text"]).where("text is not null")
    rows = texts.select(h.alias("h")).select(F.explode(F.arrays_zip(F.col("h"), F.concat(edge, F.col("h")).alias("before"), F.concat(F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), edge).alias("after"))).alias("x"))
    contexts = rows.select(F.col("x.h").alias("h"), F.struct("x.before", "x.after").alias("at")).where("h is not null").groupBy("h", "at").agg(F.lit(1)).groupBy("h").agg(F.count(F.lit(1)).alias("contexts"))
    least = max(MANY_CONTEXTS, -(-texts.count() // SHARE_OF_DOCUMENTS))
    return frozenset(r.h for r in contexts.where(F.col("contexts") >= least).select("h").collect())


@dataclass
class ChainModel:
    """emission: score of boilerplate over content for each feature; transition[i, j]: from state i to j; common: hashes of common lines."""

    emission: np.ndarray
    transition: np.ndarray
    common: frozenset[int] = frozenset()

    def viterbi(self, score: list[float]) -> list[int]:
        """The best states of one chain; ties go to content."""
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b, back = 0.0, score[0], []
        for s in score[1:]:
            from_b0, from_b1 = b + t10 > a + t00, b + t11 >= a + t01
            back.append((from_b0, from_b1))
            a, b = (b + t10 if from_b0 else a + t00), (b + t11 if from_b1 else a + t01) + s
        state = int(b > a)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, lens: np.ndarray, l2: float = 1e-4) -> tuple[float, np.ndarray]:
    """Mean log likelihood of the states y of chains of falling lengths, less the penalty, and its gradient; forward and backward run over all chains at once."""
    first = np.cumsum(lens) - lens
    active = [int((lens > t).sum()) for t in range(lens[0])]
    w, tr = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
    e = np.stack([np.zeros(len(x)), x @ w], axis=1)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[first] = e[first]
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        alpha[at] = np.logaddexp.reduce(alpha[at - 1][:, :, None] + tr, axis=1) + e[at]
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        beta[at - 1] = np.logaddexp.reduce(tr[None] + (e[at] + beta[at])[:, None, :], axis=2)
    z = np.logaddexp.reduce(alpha[first + lens - 1], axis=1)
    zz = np.repeat(z, lens)
    p = np.exp(alpha + beta - zz[:, None])[:, 1]
    inner = np.ones(len(x), dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    joint = np.exp(alpha[at - 1][:, :, None] + tr + (e[at] + beta[at])[:, None, :] - zz[at][:, None, None]).sum(axis=0)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[at - 1], y[at]), 1.0)
    total = float(len(x))
    value = (e[np.arange(len(x)), y].sum() + (pairs * tr).sum() - z.sum()) / total - l2 / 2 * float(theta @ theta)
    return value, np.concatenate((x.T @ (y - p), (pairs - joint).ravel())) / total - l2 * theta


def fit_chain(chains: list[np.ndarray], states: list[np.ndarray], steps: int = 300, rate: float = 0.1) -> ChainModel:
    """Maximise the conditional likelihood of the lines' states by Adam."""
    order = np.argsort([-len(c) for c in chains], kind="stable")
    lens = np.array([len(chains[i]) for i in order])
    x, y = np.concatenate([chains[i] for i in order]), np.concatenate([states[i] for i in order]).astype(np.int64)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = likelihood(theta, x, y, lens)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ChainModel(theta[:N_FEATURES].copy(), theta[N_FEATURES:].reshape(2, 2).copy())


def fit_documents(chains: list[np.ndarray], bad: list[bool], rounds: int = 2) -> ChainModel | None:
    """Fit on documents whose lines' states are latent; None unless there are good and bad ones.

    The first round looks at lines one by one, all lines of bad documents being boilerplate; the others at
    chains, with the states that the round before gives to bad documents.
    """
    if len(set(bad)) < 2:
        return None
    common = [c[:, -1] > 0 for c in chains]
    states = [k | b for k, b in zip(common, bad)]
    lines, flat = np.concatenate(chains), np.concatenate(states)
    model = fit_chain([lines[i : i + 1] for i in range(len(lines))], [flat[i : i + 1] for i in range(len(lines))])
    model.transition[:] = 0.0
    for _ in range(rounds):
        for i in np.flatnonzero(bad).tolist():
            score = chains[i] @ model.emission
            states[i] = np.array(model.viterbi(score.tolist()), dtype=bool) | common[i]
            if not (states[i] & ~common[i]).any():
                states[i][np.argmax(np.where(common[i], -np.inf, score))] = True
        model = fit_chain(chains, states)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, most_lines: int = 2000) -> ChainModel | None:
    """Count the common lines of all docs, and fit on at most `sample` labelled documents, the first in the order of crc32(doc_id).

    A label is `quality` 0 or 1, the least if there are several; other values, and null ids, are none.  Of
    rows that repeat an id one counts, that of the least text hash.  Texts of more than most_lines lines
    are not sampled, so sample * most_lines lines at most reach the driver.  None, which is no model,
    unless the sample has good and bad documents.
    """
    C.bound_batches(docs.sparkSession)
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    short = C.with_columns_first(docs, ["doc_id", "text"]).where(F.length(F.translate("text", "\n", "")) > F.length("text") - most_lines)
    labelled = C.with_columns_first(labels, ["doc_id", "quality"]).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = short.select("doc_id").join(labelled, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(sample)
    common = common_lines(docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, "text"):
            for doc_id, text, quality in zip(batch.column(0).to_pylist(), C.encoded(batch.column(1)), batch.column(2).to_pylist()):
                rows, _, _ = _lines(text, common)
                if rows:
                    yield C.record("doc_id long, quality int, x binary", doc_id=[doc_id], quality=[quality], x=[np.array(rows, dtype=np.float32).tobytes()])

    # the chosen ids are at most `sample`
    joined = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "quality"), F.xxhash64("text")).alias("row")).select("doc_id", "row.text", "row.quality")
    rows = sorted(joined.mapInArrow(features, "doc_id long, quality int, x binary").collect())
    model = fit_documents([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES).astype(float) for r in rows], [r.quality == 0 for r in rows])
    return model and ChainModel(model.emission, model.transition, common)


def label_lines(docs: DataFrame, model: ChainModel | None, min_share: float = 0.5) -> DataFrame:
    """Base rules and the content share of each document.

    docs: doc_id long, text string; other columns are ignored.  A document is kept if the base rules
    pass (10 words at least; words in repeated 5-word windows at most 20 in 100) and content lines hold
    at least min_share of its words.  Null, empty and white texts have no words: base_failed, not kept,
    share 0.  Without a model lines are not labelled: n_content_words and content_share are null, and the
    base rules decide alone.  One row for each input row, repeated rows and null ids included; whole texts
    of any length; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, "text"):
            texts = C.encoded(batch.column(1))
            w = C.words(texts)
            win = C.Windows(w)
            p = win.starts(5)
            key = win.hash(p, 5) ^ C.mix(w.doc_of_word()[p].astype(np.uint64) + np.uint64(1))
            _, back, n = np.unique(key, return_inverse=True, return_counts=True)
            again = C.covered(len(w.h), p[n[back] > 1], 5).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(again)))
            repeat = total[w.first[1:]] - total[w.first[:-1]]
            found = [_lines(t, model.common if model else frozenset()) for t in texts]
            x = np.array([f for rows, _, _ in found for f in rows], dtype=float).reshape(-1, N_FEATURES)
            content, at = [], 0
            scores = (x @ model.emission).tolist() if model else []
            for rows, counts, _ in found:
                states = model.viterbi(scores[at : at + len(rows)]) if model and rows else []
                at += len(rows)
                content.append(sum(c for c, s in zip(counts, states) if s == 0) if model else None)
            n_words = w.n_words.tolist()
            failed = [n < 10 or 100 * r > 20 * n for n, r in zip(n_words, repeat.tolist())]
            share = [None if c is None else c / n if n else 0.0 for c, n in zip(content, n_words)]
            yield C.record(
                RESULT,
                doc_id=batch.column(0).to_pylist(),
                n_words=n_words,
                word_chars=[len(t.decode()) - (len(t) - len(t.translate(None, _SPACES))) for t in texts],
                n_symbols=[len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
                n_dup_lines=[d for _, _, d in found],
                n_repeat_words=repeat.tolist(),
                base_failed=failed,
                n_lines=[len(r) for r, _, _ in found],
                n_content_words=content,
                content_share=share,
                kept=[not f and (s is None or s >= min_share) for f, s in zip(failed, share)],
            )

    return C.with_columns_first(docs, ["doc_id", "text"]).mapInArrow(run, RESULT)
