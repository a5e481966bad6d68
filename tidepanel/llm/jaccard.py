"""Jaccard join of word n-grams by partitioned universes, exact.

Sets are banded by size; a band has sizes up to a power of two U, and each set takes part in the scheme
of its own band and, if it can match larger sets of the next band, in that one's.  A scheme hashes the
universe of shingles into m segments.  Two sets that link differ in at most H shingles, H = (q - p) / (q
+ p) of the sum of their sizes for a threshold p / q, so their segments differ by at most H in all.  Each
segment has a mode: 1 indexes its subset, which finds partners that agree on it; 2 indexes the subset
and its one-deletion neighbourhood, which finds partners that differ by one.  By the pigeonhole
principle some segment finds every link if the modes sum to H + 1 at least; schemes get spare segments, so
that a link agrees on many of them.  The modes of a band are those of least cost (keys, and candidates
expected from segments that hold common shingles only).

Pass 1 finds the keys that occur in more than one place, on compact rows, one bit back for each key.
Sets that have too few such keys for any link drop out; so do sets that share fewer than p / q of their
shingles with all other sets together.  Pass 2 brings the rest together by key.
Groups of up to SMALL sets give all pairs, larger ones a chain; pairs are verified on their shingles and
linked into components.  What is left are larger groups that are not in one component: each set
allocates the looks it still owes to the groups with the fewest components, and components that meet
there are compared in blocks of sets, without emitting pairs.
Sets that are equal (copies) are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .components import components
from .substring import KEYS, key_rows, marked, repeated_keys, with_answers

SMALL = 4
BLOCK = 256
COMMON_SHARE, CANDIDATE_COST, SPARE = 0.2, 100.0, 0.25
FOUND = "kind int, a long, b long, n long, body binary"
PAIRS = "kind int, a long, b long"
NEEDS = "set_id long, need long, own long, band long"
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Scheme:
    """Segments and modes of the band of sizes up to `top`: the first `twos` segments have mode 2, the rest mode 1.

    h differences spoil at most h segments of mode 1, or half as many of mode 2; the scheme has so many
    segments that 1 + SPARE * h are left.  Of all numbers of mode 2 the one of least cost is taken: a key for
    each segment, one for each deletion, and the candidates expected of segments with common shingles only.
    """

    def __init__(self, top: int, p: int, q: int):
        self.top = top
        h = (q - p) * 2 * top // (q + p)
        left = 1 + int(SPARE * h)
        twos = np.arange(left + h // 2 + 1)
        # with fewer of mode 2 than are to be left, every difference spoils a segment of mode 1; each one more saves two of those
        ones = np.where(twos < left, h + left - twos, np.maximum(h - 2 * (twos - left) - 1, 0))
        m = ones + twos
        k = top / m
        cost = m * (1 + CANDIDATE_COST * COMMON_SHARE**k) + twos * k
        best = int(np.argmin(cost))
        self.twos, self.m = best, int(m[best])


@cache
def scheme(top: int, p: int, q: int) -> Scheme:
    return Scheme(top, p, q)


class Sets:
    """The shingle sets of some texts, and the keys of the distinct ones."""

    def __init__(self, texts: list[bytes], n: int, p: int, q: int):
        w = C.words(texts, lower=True)
        win = C.Windows(w)
        at = win.starts(n)
        doc = w.doc_of_word()[at] if len(at) else np.zeros(0, dtype=np.int64)
        short = np.flatnonzero((w.n_words > 0) & (w.n_words < n))
        h = np.concatenate((win.hash(at, n), win.hash(w.first[short], w.n_words[short])))
        doc = np.concatenate((doc, short))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
        size = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        total = np.zeros(len(texts), dtype=np.uint64)
        np.add.at(total, doc, C.mix(h ^ _SALT))
        #: per text: the size of its set, and the set's id (0 for none)
        self.size = size
        self.id = np.where(size > 0, C.mix(total + size.astype(np.uint64)) | np.uint64(1), np.uint64(0)).view(np.int64)
        # from here on, distinct sets only
        _, rep = np.unique(self.id, return_index=True)
        rep = np.sort(rep[self.size[rep] > 0])
        number = np.full(len(texts), -1, dtype=np.int64)
        number[rep] = np.arange(len(rep))
        mine = number[doc] >= 0
        self.keys = Keys(h[mine], size[rep], self.id[rep], p, q)


class Keys:
    """The keys of distinct sets in all their schemes: h has the shingles of one set after the other."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray, p: int, q: int):
        self.h, self.sizes, self.ids = h, sizes, ids
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        b = sizes
        top = np.left_shift(1, np.ceil(np.log2(np.maximum(b, 1))).astype(np.int64))
        up = np.flatnonzero(b * q >= p * (top + 1))
        vset = np.concatenate((np.arange(len(b)), up))
        vtop = np.concatenate((top, 2 * top[up]))
        tops, which = np.unique(vtop, return_inverse=True)
        plans = [scheme(int(t), p, q) for t in tops]
        pick = lambda name: np.array([getattr(x, name) for x in plans], dtype=np.int64)[which] if len(plans) else np.zeros(0, dtype=np.int64)
        m, twos = pick("m"), pick("twos")
        size = b[vset]
        most = (q - p) * (size + np.minimum(vtop, size * q // p)) // (q + p)
        base = np.concatenate(([0], np.cumsum(m)))
        reps = size
        v = np.repeat(np.arange(len(vset)), reps)
        inside = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        h = self.h[self.first[vset][v] + inside]
        salt = C.mix(vtop.astype(np.uint64))
        seg = ((C.mix(h ^ salt[v]) >> np.uint64(32)) * m[v].astype(np.uint64)) >> np.uint64(32)
        seg = seg.astype(np.int64)
        flat = base[v] + seg
        total = np.zeros(int(base[-1]), dtype=np.uint64)
        val = C.mix(h + _SALT)
        np.add.at(total, flat, val)
        count = np.bincount(flat, minlength=len(total))
        owner = np.repeat(np.arange(len(vset)), m)
        tag = C.mix(salt[owner] + (np.arange(len(total)) - base[owner]).astype(np.uint64))
        # what a link leaves of the segments at least; an empty one of mode 1 is a key only where the others might not do
        kept = m - np.where(most <= m - twos, most, m - twos + (most - (m - twos)) // 2)
        double = np.arange(len(total)) - base[owner] < twos[owner]
        empty = np.bincount(owner, weights=(count == 0) & ~double, minlength=len(vset)).astype(np.int64)
        weak = empty >= kept
        use = (count > 0) | weak[owner] | double
        two = seg < twos[v]
        self.key = np.concatenate((C.mix(total[use] + tag[use]), C.mix(total[flat[two]] - val[two] + tag[flat[two]])))
        self.key_owner = np.concatenate((owner[use], v[two]))
        self.key_set = vset[self.key_owner]
        self.key_own = self.key_owner < len(b)
        #: how many own keys a set has to look at to meet every linked set that isn't larger: all where modes differ
        self.need = np.where(twos[: len(b)] > 0, np.int64(1) << 40, (q - p) * 2 * b // (q + p) + 1)
        self.n_own = np.bincount(self.key_owner, minlength=len(vset))[: len(b)]
        #: a set drops out of a scheme with fewer shared keys than this
        self.least = np.maximum(1, kept - empty)

    def distinct_keys(self) -> np.ndarray:
        """Keys, one for each set that has it."""
        order = np.lexsort((self.key, self.key_set))
        k, s = self.key[order], self.key_set[order]
        keep = np.ones(len(k), dtype=bool)
        keep[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        return k[keep]

    def shingles(self, i: int) -> np.ndarray:
        return self.h[self.first[i] : self.first[i + 1]]


def _linked(common, a, b, p: int, q: int):
    """Does the intersection reach p / q of the union?"""
    return q * common >= p * (a + b - common)


def _group_pairs(key: np.ndarray, sid: np.ndarray, size: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of the groups of equal keys (sorted by key, set): all of small groups, chains of larger ones; and a mask of the members of larger ones."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(start, len(key)))
    per = np.repeat(n, n)
    left, right = [], []
    for step in range(1, SMALL):
        i = np.arange(len(key) - step)
        i = i[(key[i] == key[i + step]) & ((per[i] <= SMALL) | (step == 1))]
        left.append(i)
        right.append(i + step)
    i, j = np.concatenate(left), np.concatenate(right)
    ok = np.minimum(size[i], size[j]) * q >= np.maximum(size[i], size[j]) * p
    pairs = np.unique(np.stack([sid[i[ok]], sid[j[ok]]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], per > SMALL


def jaccard_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """doc_id, n_shingles, component_id of each document, and its set_id.

    docs: doc_id long, text string; other columns are ignored.  A text's set: its distinct runs of n
    words (A-Z in lower case; runs of characters other than ASCII white space), or with fewer words the
    whole sequence as one; without words (null, empty, white) none.  Two documents link if q times the
    intersection is at least p times the union; component_id is the smallest doc_id reachable by links,
    itself included.  Documents without a set are alone.  Repeated rows link; null ids are never the
    smallest unless all are null.  One row for each input row.
    """
    p, q = threshold
    spark = docs.sparkSession
    table = C.chunks(docs, C.CHUNK_BYTES)
    tasks = C.partitions(spark, (table.agg(F.sum("n_bytes")).first()[0] or 0) // 8)
    buckets = 4 * tasks
    sets_of = lambda body: Sets(C.encoded(C.from_body(body).column("text").chunk(0)), n, p, q)

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from key_rows(sets_of(row["body"]).keys.distinct_keys(), row["chunk"], buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.groups(batches, "chunk"):
            body = C.from_body(rows[0]["data"])
            s = Sets(C.encoded(body.column("text").chunk(0)), n, p, q)
            k, x = len(s.id), s.keys
            yield C.record(FOUND, kind=[1] * k, a=body.column("doc_id").to_pylist(), b=s.id.tolist(), n=s.size.tolist(), body=[None] * k)
            if len(x.key):
                shared, _ = marked(x.key, rows[1:])
                enough = np.bincount(x.key_owner[shared], minlength=len(x.least)) >= x.least
                for i in np.unique(x.key_set[shared & enough[x.key_owner]]).tolist():
                    yield C.record(FOUND, kind=[2], a=[int(x.ids[i])], b=[None], n=[int(x.sizes[i])], body=[x.shingles(i).tobytes()])

    bits = C.materialise(repeated_keys(table.select("chunk", "body").mapInArrow(first_keys, KEYS), buckets, tasks, False), "bits")
    found = C.materialise(with_answers(table, bits, tasks).mapInArrow(gather, FOUND), "found")
    C.discard(table, bits)
    nodes = found.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("set_id"), F.col("n").alias("n_shingles"))
    sets = _pruned(found.where("kind = 2").groupBy(F.col("a").alias("set_id")).agg(F.any_value("body").alias("body")), tasks, p, q)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, "body"):
            parts = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            x = Keys(np.concatenate(parts), np.array([len(v) for v in parts]), np.array(batch.column(0).to_pylist(), dtype=np.int64), p, q)
            key, sid, size = x.key, x.ids[x.key_set], (2 * x.sizes[x.key_set] + x.key_own).astype(np.int32)
            order = np.lexsort((sid, key))
            key, sid, size = key[order], sid[order], size[order]
            cut = C.bucket_bounds(key, buckets)
            mine = [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b + 1] > cut[b]]
            yield C.record(FOUND, kind=[0] * len(mine), a=[b for b, _, _ in mine], b=[None] * len(mine), n=[int(y - x) for _, x, y in mine], body=[key[x:y].tobytes() + sid[x:y].tobytes() + size[x:y].tobytes() for _, x, y in mine])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.groups(batches, "a"):
            key, sid, size = (np.concatenate([np.frombuffer(r["body"], kind, r["n"], skip * r["n"]) for r in rows]) for kind, skip in ((np.uint64, 0), (np.int64, 8), (np.int32, 16)))
            order = np.lexsort((sid, key))
            key, sid, size = key[order], sid[order], size[order].astype(np.int64)
            keep = np.ones(len(key), dtype=bool)
            keep[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            key, sid, size = key[keep], sid[keep], size[keep]
            a, b, large = _group_pairs(key, sid, size // 2, p, q)
            yield C.record(PAIRS, kind=[0] * len(a) + (1 + size[large] % 2).tolist(), a=a.tolist() + key[large].view(np.int64).tolist(), b=b.tolist() + sid[large].tolist())

    met = C.materialise(C.by_bucket(sets.mapInArrow(postings, FOUND), tasks, "a").mapInArrow(meet, PAIRS), "met")
    links = _verified(met.where("kind = 0").select("a", "b").distinct(), sets, p, q)
    links = C.materialise(links, "verified", free=False)
    labels = components(links)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, "body"):
            parts = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            x = Keys(np.concatenate(parts), np.array([len(v) for v in parts]), np.array(batch.column(0).to_pylist(), dtype=np.int64), p, q)
            # links have sizes in the same or neighbouring bands
            band = np.floor(np.log(x.sizes) / np.log(q / p)).astype(np.int64)
            yield C.record(NEEDS, set_id=x.ids.tolist(), need=x.need.tolist(), own=x.n_own.tolist(), band=band.tolist())

    members = met.where("kind > 0").select(F.col("a").alias("key"), F.col("b").alias("set_id"), (F.col("kind") == 2).alias("mine"))
    more = C.materialise(_finished(members, sets.mapInArrow(needs, NEEDS), labels, sets, p, q), "finished", free=False)
    if not more.isEmpty():
        labels = components(links.union(more))
    own = nodes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    own = C.materialise(own, "members", free=False)
    C.discard(found, sets)
    # written for the same reason: a component may hold a third of all documents
    least = C.materialise(own.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least")), "least", free=False)
    return own.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "set_id")


def _pruned(sets: DataFrame, tasks: int, p: int, q: int) -> DataFrame:
    """The sets of whose shingles at least p / q occur in another of these sets: a link shares as many of either side."""
    table = C.chunks(sets.select(F.col("set_id").alias("doc_id"), F.col("body").alias("text")))
    buckets = 4 * tasks
    shingles = lambda body: np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in body.column("text").to_pylist()]])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from key_rows(C.mix(shingles(C.from_body(row["body"]))), row["chunk"], buckets)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.groups(batches, "chunk"):
            body = C.from_body(rows[0]["data"])
            shared = np.concatenate(([0], np.cumsum(marked(C.mix(shingles(body)), rows[1:])[0])))
            bodies = body.column("text").to_pylist()
            size = np.array([len(x) // 8 for x in bodies])
            end = np.cumsum(size)
            good = np.flatnonzero(q * (shared[end] - shared[end - size]) >= p * size).tolist()
            ids = body.column("doc_id").to_pylist()
            yield C.record("set_id long, body binary", set_id=[ids[i] for i in good], body=[bodies[i] for i in good])

    bits = C.materialise(repeated_keys(table.select("chunk", "body").mapInArrow(keys, KEYS), buckets, tasks, False), "shared")
    out = C.materialise(with_answers(table, bits, tasks).mapInArrow(keep, "set_id long, body binary"), "sets")
    C.discard(table, bits)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of set ids that link, by their shingles."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                if _linked(int((both[1:] == both[:-1]).sum()), len(x), len(y), p, q):
                    out.append((a, b))
            yield C.record("a long, b long", a=[x for x, _ in out], b=[x for _, x in out])

    right = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("body").alias("right")), "b")
    return right.join(sets.select(F.col("set_id").alias("a"), F.col("body").alias("left")), "a").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _finished(members: DataFrame, needs: DataFrame, labels: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Links that chains of larger groups have missed.

    A set has to look at `need` of its own keys to meet every linked set that isn't larger.  Keys of its
    own, of small groups and of groups in one component have nothing left to find, so they come first; the
    rest of its allocation goes to the groups with the fewest components.  Components that meet there
    form areas; within an area, sets of the same or neighbouring sizes are compared in pairs of blocks
    of BLOCK sets, without emitting pairs.
    """
    everyone = sets.select("set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    everyone = C.materialise(everyone, "everyone", free=False)
    tagged = C.materialise(members.join(everyone, "set_id").select("key", "label", "set_id", "mine"), "tagged", free=False)
    known = C.materialise(tagged.select("key", "label").distinct(), "known", free=False)
    # written, so that both sides of the joins are plain exchanges, whose hot keys adaptive execution splits
    mixed = C.materialise(known.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.min("label").alias("low")).where("labels > 1"), "mixed", free=False)
    own = tagged.where("mine").join(mixed, "key").select("key", "labels", "label", "set_id")
    spent = own.groupBy("set_id").agg(F.count(F.lit(1)).alias("open")).join(needs, "set_id").select("set_id", (F.col("need") - (F.col("own") - F.col("open"))).alias("left")).where("left > 0")
    turn = F.row_number().over(Window.partitionBy("set_id").orderBy("labels", "key"))
    chosen = own.join(spent, "set_id").withColumn("turn", turn).where(F.col("turn") <= F.col("left")).select("key")
    # All components of a chosen group are one area: a star from the least label, not pairs, connects them.
    met = known.select("key", "label").join(chosen.distinct(), "key").join(mixed.select("key", "low"), "key")
    areas = components(met.select(F.col("low").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("area"))
    near = everyone.join(areas, "label").join(needs.select("set_id", "band"), "set_id")
    near = near.select("set_id", "label", "area", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    near = C.materialise(near, "near", free=False)
    shape = near.groupBy("area", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count_distinct("label").alias("labels")).where("labels > 1")
    placed = near.join(shape, ["area", "band"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    # every unordered pair of blocks is one group of at most two blocks of sets
    rows = placed.select("area", "band", "block", "label", "set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).join(sets, "set_id")
    rows = rows.select(F.xxhash64("area", "band", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "label", "set_id", "body")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.groups(batches, "pair"):
            lo, hi = rows[0]["lo"], rows[0]["hi"]
            a, b = [r for r in rows if r["block"] == lo], [r for r in rows if r["block"] == hi]
            if not a or not b:
                continue
            parts = [np.frombuffer(r["body"], np.uint64) for r in b]
            sizes = np.array([len(x) for x in parts])
            u, code = np.unique(np.concatenate(parts), return_inverse=True)
            at = np.cumsum(sizes) - sizes
            label = np.array([r["label"] for r in b])
            out = set()
            for r in a:
                x = np.frombuffer(r["body"], np.uint64)
                i = np.minimum(np.searchsorted(u, x), len(u) - 1)
                mark = np.zeros(len(u), dtype=np.int64)
                mark[i[u[i] == x]] = 1
                hit = np.flatnonzero(_linked(np.add.reduceat(mark[code], at), len(x), sizes, p, q) & (label != r["label"]))
                # one link to each other component is enough
                for j in hit[np.unique(label[hit], return_index=True)[1]].tolist():
                    out.add((r["set_id"], b[j]["set_id"]))
            yield C.record("a long, b long", a=[x for x, _ in out], b=[y for _, y in out])

    return C.by_bucket(rows, C.partitions(sets.sparkSession), "pair").mapInArrow(compare, "a long, b long")
