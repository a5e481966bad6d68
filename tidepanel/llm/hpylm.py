"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every context word has a restaurant whose customers are the words that follow it in the training texts;
all of them share one parent, the restaurant of single words, whose customers are the children's tables.
The parent's own base is diffuse, so every known word has one table there, and what the parent leaves
for new tables is the probability of a word that training has not seen.

The seating is sampled by Gibbs in blocks that are exactly independent given two kinds of auxiliary
draws: the parent's word weights (independent gammas of tables less discount, over their sum) and, for
each context u, a gamma of strength / discount + its tables.  Given those, a dish with c customers has t
tables with weight S(c, t) lambda^t, lambda = discount * gamma of u * weight of the word, S the
generalised Stirling numbers.  Up to EXACT customers that is drawn as it stands; beyond, the seating at
EXACT customers is drawn with its exact weights times the fluid limit of what follows, and the later
customers in blocks with the same limit (see `_beyond`; the tests bound its error).

A sweep is one exchange each way between pair buckets and word buckets.  Only dishes of two customers or
more move; the one table of each single pair is a constant of its word and context.  After a burn-in,
predictive probabilities are averaged over DRAWS sweeps, each with the tables, totals and parent of that
very sweep, so those of a context sum to 1.  The number of buckets and all seeds depend on the data
alone, not on the cluster.

Pairs are counted in buckets of (context, quarter of the words), so that the restaurant of the most common
word is spread; counts of words and pairs cover all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .substring import with_answers

CHUNK = "chunk long, n_bytes long, body binary"
ROW = "bucket long, chunk long, n long, body binary"
STATE = "kind int, bucket long, chunk long, n long, ones long, twos long, body binary"
WORDS = "kind int, bucket long, chunk long, n long, weight double, tables long, ones long, twos long, body binary"
ANSWER = "chunk long, bucket long, n long, data binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
EXACT, DRAWS, SPLIT = 128, 4, 4
TOKENS_PER_BUCKET = 3_000_000
#: Ids of the end of a text and of the context at its start.
END, START = np.uint64(1), np.uint64(2)


# ---------------------------------------------------------------- seating
@cache
def log_stirling(discount: float, top: int = EXACT) -> np.ndarray:
    """log S(c, t) for t tables of c customers: S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    s = np.full((top + 1, top + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(1, top + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, top):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + s[c, 1:], -np.inf)
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay)
    return s


def _pick(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An index of each row, by the row's log weights."""
    w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
    return (w < rng.random(len(w))[:, None] * w[:, -1:]).sum(axis=1)


def draw_tables(c: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """For each dish of c customers, a draw of its tables t with weight S(c, t) rate^t."""
    t = np.minimum(c, 1).astype(np.int64)
    table, log_rate = log_stirling(discount, exact), np.log(np.maximum(rate, 1e-300))
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, exact + 2))
    for k, (x, y) in enumerate(zip(edges, edges[1:]), start=2):
        for at in np.array_split(order[x:y], max(1, (y - x) * k // 1_000_000)):
            if len(at):
                t[at] = 1 + _pick(table[k, 1 : k + 1] + log_rate[at][:, None] * np.arange(1, k + 1), rng)
    for at in np.array_split(order[edges[-1] :], max(1, (len(c) - edges[-1]) * exact // 500_000)):
        if len(at):
            t[at] = _beyond(c[at].astype(float), np.maximum(rate[at], 1e-300), discount, rng, table[exact, 1:])
    return t


def _fluid(n, t, c, rate, d: float, start: np.ndarray | None = None, rounds: int = 8) -> np.ndarray:
    """The constant K of the path through t tables at n customers of c: tables less rate * rho / d, where rho = ((n - d K) / (c - d K))^d is what one table more is worth to the customers after n."""
    k = t - rate / d * ((n / c) ** d) if start is None else start
    for _ in range(rounds):
        left, right = n - d * k, c - d * k
        rho = rate * (left / right) ** d
        slope = 1 - rho * d * (c - n) / (left * right)
        k = np.clip(k - (k - t + rho / d) / np.maximum(slope, 0.05), t - rate / d, t)
    return k


def _beyond(c: np.ndarray, rate: np.ndarray, d: float, rng: np.random.Generator, row: np.ndarray) -> np.ndarray:
    """Tables of dishes with more customers than `row` (log S(n, 1..n)) knows, by the limit of many customers.

    Seating customer n + 1 multiplies the weight by n - d t at an old table and by the rate at a new one.  Of
    all ways to seat the rest, those that start with one table more weigh rho times as much, and d ln rho /
    d n = d / (n - d t + rate rho), whose solution _fluid has.  K is solved at 17 numbers of tables and
    interpolated between them, and again for each of 12 blocks of customers to a factor of e.
    """
    n = len(row)
    t = np.arange(1, n + 1)
    knots = 1.5 + (n - 2) * np.linspace(0, 1, 17) ** 2
    at = np.clip(np.searchsorted(knots, t[:-1] + 0.5, side="right") - 1, 0, 15)
    share = (t[:-1] + 0.5 - knots[at]) / (knots[at + 1] - knots[at])
    k = _fluid(n, knots, c[:, None], rate[:, None], d)
    k = k[:, at] * (1 - share) + k[:, at + 1] * share
    worth = np.cumsum(d * np.log((n - d * k) / (c[:, None] - d * k)), axis=1)
    out = 1 + _pick(row + np.log(rate)[:, None] * t + np.concatenate((np.zeros((len(c), 1)), worth), axis=1), rng)
    now, k = np.full(len(c), float(n)), _fluid(n, out + 0.5, c, rate, d)
    steps = int(np.ceil(12 * np.log(c.max() / n))) + 1
    for j in range(1, steps + 1):
        then = c if j == steps else np.round(n * (c / n) ** (j / steps))
        k = _fluid(now, out + 0.5, c, rate, d, k, 2)
        left = (now + then) / 2 - d * k
        new = rate * (left / (c - d * k)) ** d / left
        out += rng.binomial((then - now).astype(np.int64), np.clip(new, 0.0, 1.0))
        now = then
    return out


def _id_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """Buckets of 48-bit word ids, non-decreasing in the id."""
    return ((ids >> np.uint64(16)) * np.uint64(n)) >> np.uint64(32)


def _ranges(buckets: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    cut = np.searchsorted(buckets, np.arange(n + 1, dtype=np.uint64))
    return [(b, int(cut[b]), int(cut[b + 1])) for b in range(n) if cut[b + 1] > cut[b]]


# ---------------------------------------------------------------- tokens
def token_chunks(docs: DataFrame, limit: int = 2 * C.CHUNK_BYTES) -> DataFrame:
    """Chunks of docs (doc_id, text, held), each as its tokens: words in lower case, then one end, as sorted distinct ids and codes."""
    C.bound_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[pa.RecordBatch] = []
        parts: list[C.Words] = []

        def out() -> pa.RecordBatch:
            first = np.concatenate([[0], np.cumsum(np.concatenate([p.n_words for p in parts]) + 1)]).astype(np.int64)
            tok = np.empty(int(first[-1]), dtype=np.uint64)
            word = np.ones(len(tok), dtype=bool)
            word[first[1:] - 1] = False
            tok[word] = np.maximum(np.concatenate([p.h for p in parts]) >> np.uint64(16), np.uint64(3))
            tok[~word] = END
            ids, codes = np.unique(np.concatenate((tok, [START])), return_inverse=True)
            docs_ = pa.Table.from_batches(held).combine_chunks()
            row = pa.record_batch({"doc_id": [docs_.column("doc_id").to_pylist()], "held": [docs_.column("held").to_pylist()], "first": [first.tobytes()], "ids": [C.narrow(ids)], "codes": [C.pack_ints(codes)]}, schema=_TOKENS)
            return C.record(CHUNK, chunk=[base + n], n_bytes=[size], body=[C.to_body(row)])

        for piece in C.small_batches(batches, "text", limit // 4):
            texts = C.encoded(piece.column(1))
            parts.append(C.words(texts, lower=True))
            held.append(piece.select(["doc_id", "held"]))
            size += int(pc.sum(pc.binary_length(piece.column(1))).as_py() or 0) + 64 * piece.num_rows
            if size >= limit:
                yield out()
                n, size, held, parts = n + 1, 0, [], []
        if held:
            yield out()

    return C.materialise(docs.mapInArrow(pack, CHUNK), "tokens")


_TOKENS = pa.schema([("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("first", pa.binary()), ("ids", pa.binary()), ("codes", pa.binary())])


class Tokens:
    """The tokens of a chunk and its distinct pairs of context and token."""

    def __init__(self, body: bytes):
        row = C.from_body(body).to_pylist()[0]
        self.doc_id, self.first = row["doc_id"], np.frombuffer(row["first"], np.int64)
        n = int(self.first[-1])
        self.ids = C.widen(row["ids"], len(row["ids"]) // 6)
        codes = C.unpack_ints(row["codes"], 0, n + 1)[0].astype(np.int32)
        self.held = np.array(row["held"], dtype=bool)
        self.train = np.repeat(~self.held, np.diff(self.first))
        self.tok = codes[:-1]
        ctx = np.concatenate((codes[-1:], self.tok[:-1]))
        ctx[self.first[:-1]] = codes[-1]
        self.ctx = ctx
        wide = np.int64(len(self.ids))
        # the order of pairs: part of the words, context, word
        part = (self.ids & np.uint64(SPLIT - 1)).astype(np.int64)
        pairs, self.pair = np.unique((part[self.tok] * wide + ctx) * wide + self.tok, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.counts = np.bincount(self.pair, weights=self.train, minlength=len(pairs)).astype(np.uint32)
        rest, word = np.divmod(pairs, wide)
        self.pair_part, self.pair_ctx = np.divmod(rest, wide)
        self.pair_word = word.astype(np.int32)

    def pair_rows(self, buckets: int) -> list[tuple[int, int, int]]:
        """Slices of the pairs by bucket: the word's part, then a range of contexts."""
        own = buckets // SPLIT
        b = self.pair_part.astype(np.uint64) * np.uint64(own) + _id_bucket(self.ids[self.pair_ctx], own)
        return _ranges(b, own * SPLIT)


def _packed(ctx: np.ndarray, ctx_ids: np.ndarray, word_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs in order of context: runs of contexts, their ids, the words' ids, counts."""
    start = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    return np.uint32(len(start)).tobytes() + C.pack_ints(np.diff(np.append(start, len(ctx)))) + C.narrow(ctx_ids[start]) + C.narrow(word_ids) + C.pack_ints(counts)


def _read_pairs(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int(np.frombuffer(body, np.uint32, 1)[0])
    runs, at = C.unpack_ints(body, 4, k)
    ctx = np.repeat(C.widen(body[at : at + 6 * k], k), runs)
    at += 6 * k
    return ctx, C.widen(body[at : at + 6 * n], n), C.unpack_ints(body, at + 6 * n, n)[0]


def _unpacked(data: bytes, at: int, n: int, columns: int) -> list[np.ndarray]:
    """So many packed columns of n integers, from offset at."""
    out = []
    for _ in range(columns):
        x, at = C.unpack_ints(data, at, n)
        out.append(x)
    return out


def _sums(at: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=t, minlength=n).astype(np.int64)


class Dishes:
    """The pairs of a bucket with two training customers or more: codes of context and word among the sorted ids, customers."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray):
        self.ids, self.u, self.w, self.c = ids, u, w, c

    def body(self) -> bytes:
        return np.uint32(len(self.ids)).tobytes() + C.narrow(self.ids) + C.pack_ints(np.diff(self.u, prepend=0)) + C.pack_ints(self.w) + C.pack_ints(self.c)

    @staticmethod
    def read(body: bytes, n: int) -> Dishes:
        k = int(np.frombuffer(body, np.uint32, 1)[0])
        u, w, c = _unpacked(body, 4 + 6 * k, n, 3)
        return Dishes(C.widen(body[4 : 4 + 6 * k], k), np.cumsum(u), w, c)


def score(docs: DataFrame, held, burn_in: int = 2, draws: int = DRAWS, strength: float = 1.0, base_strength: float = 1.0, seed: int = 7) -> DataFrame:
    """Base and model log10 probability of every whole text.

    docs: doc_id long, text string; other columns are ignored; held: a Boolean column, true for documents
    that training leaves out.  Tokens: runs of characters other than ASCII white space, A-Z in lower case,
    then one end.  burn_in: sweeps before the `draws` averaged ones.  Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (add-one unigram) and score.  Both models give one probability to all
    words that training has not seen, together.  A null or empty text is its end alone; repeated rows train
    again; without training texts every token is unseen, with probability 1; an empty table gives no rows.
    Word ids are 48-bit hashes.
    """
    spark = docs.sparkSession
    table = token_chunks(docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"), F.coalesce(held, F.lit(False)).alias("held")))
    n_bytes = table.agg(F.sum("n_bytes")).first()[0] or 0
    # by the data alone, for the same draws on every cluster
    buckets = SPLIT * -(-max(1, n_bytes // 6) // (SPLIT * TOKENS_PER_BUCKET))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row["body"])
                mine = t.pair_rows(buckets)
                yield C.record(ROW, bucket=[b for b, _, _ in mine], chunk=[row["chunk"]] * len(mine), n=[y - x for _, x, y in mine], body=[_packed(t.pair_ctx[x:y], t.ids[t.pair_ctx[x:y]], t.ids[t.pair_word[x:y]], t.counts[x:y]) for _, x, y in mine])
                counts = np.bincount(t.tok, weights=t.train, minlength=len(t.ids)).astype(np.uint32)
                mine = _ranges(_id_bucket(t.ids, buckets), buckets)
                yield C.record(ROW, bucket=[buckets + b for b, _, _ in mine], chunk=[row["chunk"]] * len(mine), n=[y - x for _, x, y in mine], body=[C.narrow(t.ids[x:y]) + C.pack_ints(counts[x:y]) for _, x, y in mine])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kinds: 0 the dishes of a pair bucket, 1 the places of a chunk's pairs or words, 2 all counts of a bucket, 3 the words of a word bucket, 4 the first message of a pair bucket to a word bucket."""

        def out(kind: int, bucket: int, chunk: int, n: int, body: bytes, ones: int = 0, twos: int = 0) -> pa.RecordBatch:
            return C.record(STATE, kind=[kind], bucket=[bucket], chunk=[chunk], n=[n], ones=[ones], twos=[twos], body=[body])

        for bucket, rows in C.groups(batches, "bucket"):
            if bucket >= buckets:
                word = np.concatenate([C.widen(r["body"], r["n"]) for r in rows])
                ids, back = np.unique(word, return_inverse=True)
                total = _sums(back, np.concatenate([C.unpack_ints(r["body"], 6 * r["n"], r["n"])[0] for r in rows]), len(ids))
                yield out(3, bucket, -1, len(ids), C.narrow(ids))
                yield out(2, bucket, -1, len(ids), C.pack_ints(total), int(total.sum()), int((total > 0).sum()))
            else:
                ctx, word, c = (np.concatenate(x) for x in zip(*(_read_pairs(r["body"], r["n"]) for r in rows)))
                us, u = np.unique(ctx, return_inverse=True)
                ws, w = np.unique(word, return_inverse=True)
                key, back = np.unique(u * np.int64(len(ws)) + w, return_inverse=True)
                total = _sums(back, c, len(key))
                del ctx, word, c, u, w
                ku, kw = np.divmod(key, np.int64(len(ws)))
                yield out(2, bucket, -1, len(key), C.pack_ints(total), int((total == 1).sum()), int((total == 2).sum()))
                ids = np.union1d(us, ws)
                ku, kw = np.searchsorted(ids, us)[ku], np.searchsorted(ids, ws)[kw]
                one, more = total == 1, total > 1
                sums = [_sums(at[pick], np.ones(int(pick.sum())), len(ids)) for pick in (one, more) for at in (kw, ku)]
                busy = sums[2] + sums[3] > 0
                place = np.cumsum(busy) - 1
                yield out(0, bucket, -1, int(more.sum()), Dishes(ids[busy], place[ku[more]], place[kw[more]], total[more]).body())
                for b, x, y in _ranges(_id_bucket(ids, buckets), buckets):
                    yield out(4, b, bucket, y - x, C.narrow(ids[x:y]) + b"".join(C.pack_ints(v[x:y]) for v in sums))
            at = 0
            for r in rows:
                # positions rise within a row, as both sides are in the same order
                yield out(1, bucket, r["chunk"], r["n"], C.pack_ints(np.diff(back[at : at + r["n"]], prepend=0)))
                at += r["n"]

    state = C.materialise(C.by_bucket(table.select("chunk", "body").mapInArrow(pairs, ROW), 2 * buckets, "bucket", "chunk").mapInArrow(merge, STATE), "state")
    totals = {r.words: r for r in state.where("kind = 2").groupBy((F.col("bucket") >= buckets).alias("words")).agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).collect()}
    n_train, types = (int(totals[True].ones), int(totals[True].twos)) if True in totals else (0, 0)
    seen = totals.get(False)
    model = {"d": _discount(seen.ones, seen.twos) if seen else 0.5, "d0": 0.5, "s": strength, "s0": base_strength, "types": types, "tables": 0, "weight": 1.0}

    def sweep(step: int, model: dict):
        """Pair buckets: draw the tables of all dishes, and send their sums by word and by context."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in C.groups(batches, "bucket"):
                dishes, old, answers = Dishes.read(rows[0]["body"], rows[0]["n"]), rows[1] if len(rows) > 1 and rows[1]["chunk"] == -1 else None, [r for r in rows if r["chunk"] >= 0]
                if not len(dishes.c):
                    continue
                weight, room = (np.concatenate([np.frombuffer(r["body"], np.float32, r["n"], 4 * i * r["n"]) for r in answers]).astype(float) for i in range(2))
                rate = model["d"] * room[dishes.u] * weight[dishes.w] / model["weight"]
                t = draw_tables(dishes.c, rate, model["d"], np.random.default_rng([seed, 2 * step, bucket]))
                total = _unpacked(old["body"], 0, len(t), 1)[0] if old else np.zeros(len(t), dtype=np.int64)
                yield C.record(ROW, bucket=[bucket], chunk=[-1], n=[len(t)], body=[C.pack_ints(total + t if step > burn_in else total)])
                sums = [_sums(at, t, len(dishes.ids)) for at in (dishes.w, dishes.u)]
                mine = _ranges(_id_bucket(dishes.ids, buckets), buckets)
                yield C.record(ROW, bucket=[b for b, _, _ in mine], chunk=[bucket] * len(mine), n=[y - x for _, x, y in mine], body=[C.narrow(dishes.ids[x:y]) + b"".join(C.pack_ints(v[x:y]) for v in sums) for _, x, y in mine])

        return run

    def seat(step: int, model: dict):
        """Word buckets: sum the tables of words and contexts, and draw the auxiliary weights.  Kinds: 0 an answer to a pair bucket, 1 the words and what the averaged sweeps said of them, 2 a pair bucket's own row on its way back."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(kind: int, bucket: int, chunk: int, n: int, body: bytes, weight: float = 0.0, tables: int = 0, ones: int = 0, twos: int = 0) -> pa.RecordBatch:
                return C.record(WORDS, kind=[kind], bucket=[bucket], chunk=[chunk], n=[n], weight=[weight], tables=[tables], ones=[ones], twos=[twos], body=[body])

            for bucket, rows in C.groups(batches, "bucket"):
                heads = {r["chunk"]: r for r in rows if r["chunk"] < 0}
                if -1 in heads:
                    yield out(2, bucket, bucket, heads[-1]["n"], heads[-1]["body"])
                if -2 not in heads:
                    continue
                rows = rows[len(heads) :]
                n = heads[-2]["n"]
                ids, rest = C.widen(heads[-2]["body"], n), heads[-2]["body"][6 * n :]
                at = [np.searchsorted(ids, C.widen(r["body"], r["n"])) for r in rows]
                values = [_unpacked(r["body"], 6 * r["n"], r["n"], 2 if step else 4) for r in rows]
                every = np.concatenate([*at, np.zeros(0, dtype=np.int64)])
                sums = [_sums(every, np.concatenate([*(v[i] for v in values), np.zeros(0)]), n) for i in range(2 if step else 4)]
                if step:
                    tables, room = (x + y for x, y in zip(sums, _unpacked(rest, 0, n, 2)))
                else:
                    rest = b"".join(map(C.pack_ints, sums[:2]))
                    tables, room = sums[0] + sums[2], sums[1] + sums[3]
                rng = np.random.default_rng([seed, 2 * step + 1, bucket])
                weight = rng.standard_gamma(np.maximum(tables - model["d0"], 0.0))
                gamma = rng.standard_gamma(model["s"] / model["d"] + room)
                for r, place, own in zip(rows, at, values):
                    mine = place if step else place[own[2] + own[3] > 0]
                    if len(mine):
                        yield out(0, r["chunk"], bucket, len(mine), weight[mine].astype(np.float32).tobytes() + gamma[mine].astype(np.float32).tobytes())
                if step > burn_in:
                    rest += C.pack_ints(tables) + C.pack_ints(room)
                yield out(1, bucket, -2, n, C.narrow(ids) + rest, float(weight.sum()), int(tables.sum()), int((tables == 1).sum()), int((tables == 2).sum()))

        return run

    dishes = state.where("kind = 0").select("bucket", F.lit(-2).cast("long").alias("chunk"), "n", "body")
    words = state.where("kind = 3").select((F.col("bucket") - buckets).alias("bucket"), F.lit(-2).cast("long").alias("chunk"), "n", "body")
    parts = words.unionByName(state.where("kind = 4").select("bucket", "chunk", "n", "body"))
    before, models = None, []
    for step in range(1 + burn_in + draws):
        said = C.materialise(C.by_bucket(parts, buckets, "bucket", "chunk").mapInArrow(seat(step, dict(model)), WORDS), "seated", free=step % 2 == 0)
        if before is not None:
            C.discard(before)
        before = said
        r = said.where("kind = 1").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("weight", "tables", "ones", "twos")]).first()
        if step == 0:  # the parent's discount, by the first tables: a word has as many as contexts
            model["d0"] = _discount(r.ones, r.twos)
        new = float(np.random.default_rng([seed, step]).standard_gamma(model["s0"] + model["d0"] * types))
        model |= {"tables": int(r.tables), "weight": float(r.weight) + new}
        if step > burn_in:
            models.append(dict(model))
        if step < burn_in + draws:
            back = said.where("kind in (0, 2)").select("bucket", F.when(F.col("kind") == 2, -1).otherwise(F.col("chunk")).alias("chunk"), "n", "body")
            drawn = C.by_bucket(dishes.unionByName(back), buckets, "bucket", "chunk").mapInArrow(sweep(step + 1, dict(model)), ROW)
            parts = drawn.unionByName(said.where("kind = 1").select("bucket", "chunk", "n", "body"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each chunk, for its pairs: customers and the tables of all draws; for its words: counts, then tables and restaurant totals of each draw."""
        for bucket, rows in C.groups(batches, "bucket"):
            heads = {r["chunk"]: r for r in rows if r["chunk"] < 0}
            n = heads[-1]["n"]
            count = C.unpack_ints(heads[-1]["body"], 0, n)[0]
            if bucket >= buckets:
                columns = [count, *_unpacked(heads[-2]["body"], 6 * n, n, 2 + 2 * draws)[2:]]
            else:
                tables = np.where(count == 1, draws, 0)
                if -2 in heads:
                    tables[count > 1] = C.unpack_ints(heads[-2]["body"], 0, heads[-2]["n"])[0]
                columns = [count, tables]
            for r in rows[len(heads) :]:
                at = np.cumsum(C.unpack_ints(r["body"], 0, r["n"])[0])
                yield C.record(ANSWER, chunk=[r["chunk"]], bucket=[bucket], n=[r["n"]], data=[b"".join(C.pack_ints(x[at]) for x in columns)])

    told = said.where("kind in (1, 2)").select((F.col("bucket") + F.when(F.col("kind") == 1, buckets).otherwise(0)).alias("bucket"), F.lit(-2).cast("long").alias("chunk"), "n", "body")
    asked = state.where("kind in (1, 2)").select("bucket", "chunk", "n", "body").unionByName(told)
    answers = C.materialise(C.by_bucket(asked, 2 * buckets, "bucket", "chunk").mapInArrow(settle, ANSWER), "answers")
    C.discard(state, said)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.groups(batches, "chunk"):
            t = Tokens(rows[0]["data"])
            told = [[_unpacked(r["data"], 0, r["n"], k) for r in rows[1:] if (r["bucket"] >= buckets) == (k > 2)] for k in (2, 1 + 2 * draws)]
            (customers, tables), (c, *sampled) = ([np.concatenate(x).astype(float) for x in zip(*own)] for own in told)
            base = np.log10((c + 1.0) / (n_train + types + 1.0))[t.tok]
            # A word's restaurant has as many customers as the word has training tokens; that of starts (the second id) as many as there are ends (the first).
            guests = model["s"] + c
            guests[1] = model["s"] + c[0]
            p = (customers - model["d"] / draws * tables)[t.pair]
            for m, mine, room in zip(models, sampled[::2], sampled[1::2]):
                parent = np.where(mine > 0, mine - m["d0"], m["s0"] + m["d0"] * types) / (m["s0"] + m["tables"])
                p += (m["s"] + m["d"] * room)[t.ctx] * parent[t.tok] / draws
            p = np.log10(p / guests[t.ctx])
            by_doc = lambda x: np.add.reduceat(x, t.first[:-1]).tolist()
            yield C.record(RESULT, doc_id=t.doc_id, held_out=t.held.tolist(), n_tokens=np.diff(t.first).tolist(), n_known=by_doc((c[t.tok] > 0).astype(np.int64)), train_tokens=[n_train] * len(t.held), base_score=by_doc(base), score=by_doc(p))

    return with_answers(table, answers, C.partitions(spark, n_bytes // 6)).mapInArrow(finish, RESULT)


def _discount(ones: float | None, twos: float | None) -> float:
    """The discount that counts of counts suggest, n1 / (n1 + 2 n2), within 0.1 and 0.95; 0.5 without counts."""
    ones, twos = float(ones or 0), float(twos or 0)
    return round(min(0.95, max(0.1, ones / (ones + 2 * twos))), 3) if ones else 0.5
