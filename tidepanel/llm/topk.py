"""Exact top-k search by inner product with a kd-tree for each shard of the vectors.

Components are turned into integers floor(1024 x), so scores are exact integers.  Each shard builds a
kd-tree by median splits along the widest axis, with a tight bounding box at every node.  A box bounds
the score of a query from above by the sum of the larger product at either end of each axis.  Shards are
dealt to groups, and blocks of queries go once to every group.  There a query visits the shards in falling
order of their root's bound, each best-first: boxes in falling order of their bound, until no bound beats
the kth score so far, which it carries from shard to shard.  A first round visits the best leaf of the
best shards only; the best kth score over the groups is propagated to the second round, which searches
all groups.  Nothing is broadcast, no table is joined to all of another, and no pairs of rows are made but
k for each query and group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SCALE = 1024
LEAF = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
SHARDS_PER_GROUP = 16
SHARD = "kind int, block long, n int, dim int, ids binary, vectors binary, bound binary"
HITS = "query_id long, vec_id long, score long"


def as_integers(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and integer components (one row each) of the vectors that take part, by their length; null vectors and those with null or non-finite components don't."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    length = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1)).astype(np.int64)
    first = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    x = np.floor(SCALE * np.asarray(pc.fill_null(pc.list_flatten(vectors), np.nan), dtype=np.float64))
    out = []
    for n in np.unique(length[length >= 0]).tolist():
        at = np.flatnonzero(length == n)
        rows = x[first[at][:, None] + np.arange(n)]
        good = np.isfinite(rows).all(axis=1)
        if good.any():
            out.append((at[good], rows[good]))
    return out


class Tree:
    """A kd-tree over integer rows; node arrays: box (low, high), children or a slice of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int]] = []
        self.slices: list[np.ndarray] = []
        self.least: list[int] = []
        if len(ids):
            self._build(np.argsort(ids, kind="stable"))
        self.lows, self.highs = (np.array(x) for x in (self.low, self.high))

    def _build(self, at: np.ndarray) -> int:
        me, sub = len(self.low), self.rows[at]
        low, high = sub.min(axis=0), sub.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append((-1, -1))
        self.slices.append(at)
        self.least.append(int(self.ids[at].min()))
        axis = int(np.argmax(high - low)) if len(low) else 0
        if len(at) > LEAF and len(low) and high[axis] > low[axis]:
            half = len(at) // 2
            by = np.argsort(sub[:, axis], kind="stable")  # equal values stay in the order of ids
            self.kids[me] = (self._build(at[np.sort(by[:half])]), self._build(at[np.sort(by[half:])]))
        return me

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The upper bound of every box for a query."""
        return np.maximum(query * self.lows, query * self.highs).sum(axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int, kth: float, top: list[tuple[int, int]], best_leaf_only: bool = False) -> None:
        """Put into the heap `top`, of at most k (score, -vec_id), what scores kth at least and beats its least; the query's own row never counts."""
        if not self.low:
            return
        bound = self.bounds(query)
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth or (len(top) == k and (-b < top[0][0] or (-b == top[0][0] and self.least[node] > -top[0][1]))):
                if -b < kth or -b < top[0][0]:
                    break
                continue
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            at = self.slices[node]
            scores = self.rows[at] @ query
            keep = (scores >= max(kth, top[0][0] if len(top) == k else -np.inf)) & (self.ids[at] != query_id)
            for s, i in zip(scores[keep].tolist(), self.ids[at][keep].tolist()):
                item = (int(s), -i)
                if len(top) < k:
                    heapq.heappush(top, item)
                elif item > top[0]:
                    heapq.heapreplace(top, item)
            if best_leaf_only:
                break


class Group:
    """The trees of the shards of a group, by the length of their vectors."""

    def __init__(self) -> None:
        self.trees: dict[int, list[Tree]] = {}

    def add(self, row: dict) -> None:
        self.trees.setdefault(row["dim"], []).append(Tree(*_matrix(row)))

    def search(self, dim: int, query_id: int, query: np.ndarray, k: int, kth: float, best_leaves_only: bool = False) -> list[tuple[int, int]]:
        """Up to k (score, -vec_id), best first, of those that score kth at least."""
        trees, top = self.trees.get(dim, []), []
        roots = [float(np.maximum(query * t.lows[0], query * t.highs[0]).sum()) for t in trees]
        for i in sorted(range(len(trees)), key=lambda i: -roots[i]):
            if roots[i] < max(kth, top[0][0] if len(top) == k else -np.inf):
                break
            trees[i].search(query_id, query, k, kth, top, best_leaves_only)
        return sorted(top, reverse=True)


def _blobs(vectors: DataFrame, kind: int, rows: int) -> DataFrame:
    """Vectors in blocks of at most `rows`, as integers; by the order in which partitions are read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        by_dim: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def out(dim: int, most: int) -> pa.RecordBatch:
            ids, held = (np.concatenate(x) for x in by_dim.pop(dim))
            if len(ids) > most:
                by_dim[dim] = ([ids[most:]], [held[most:]])
            ids, held = ids[:most], held[:most]
            small = np.abs(held).max(initial=0) < 2**31
            return C.record(SHARD, kind=[kind], block=[base + n], n=[len(ids)], dim=[dim], ids=[ids.tobytes()], vectors=[held.astype(np.int32 if small else np.float64).tobytes()], bound=[b""])

        for batch in batches:
            every = np.asarray(batch.column(0))
            for at, found in as_integers(batch.column(1)):
                own = by_dim.setdefault(found.shape[1], ([], []))
                own[0].append(every[at].astype(np.int64))
                own[1].append(found)
                while found.shape[1] in by_dim and sum(map(len, by_dim[found.shape[1]][0])) >= rows:
                    yield out(found.shape[1], rows)
                    n += 1
        for dim in list(by_dim):
            yield out(dim, rows)
            n += 1

    return vectors.mapInArrow(pack, SHARD)


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    width = len(row["vectors"]) // max(1, row["n"] * row["dim"])
    kind = np.int32 if width == 4 else np.float64
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], kind).reshape(row["n"], row["dim"]).astype(np.float64)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank (from 1), vec_id, score.

    vectors, queries: vec_id long, embedding array of numbers; other columns are ignored.  Ties go to the
    smaller vec_id; a row with the query's own id is no candidate; fewer than k candidates give them all;
    a query without candidates gives no row.  Null ids or vectors, and vectors with null or non-finite
    components, take no part; vectors of another length than the query's are no candidates.  Repeated
    rows are candidates of their own.  Products are summed in float64, exact below 2**53.
    """
    spark = vectors.sparkSession
    C.bound_batches(spark)
    pick = lambda df: df.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").alias("embedding")).where("vec_id is not null and embedding is not null")
    parallel = max(1, spark.sparkContext.defaultParallelism)
    shards = C.materialise(_blobs(pick(vectors).repartition(parallel), 0, shard_rows), "shards")
    blocks = C.materialise(_blobs(pick(queries), 1, BLOCK_ROWS), "queries")
    n_shards = shards.count()
    groups = max(1, min(n_shards, max(parallel, -(-n_shards // SHARDS_PER_GROUP))))
    tasks = C.partitions(spark)
    dealt = shards.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def meet(q: DataFrame) -> DataFrame:
        """Every block of queries in every group, behind the group's shards."""
        copies = q.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        return C.by_bucket(dealt.unionByName(copies), groups, "group", "kind", "block")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Group, dict]]:
        now, group = None, Group()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["group"] != now:
                    now, group = row["group"], Group()
                if row["kind"] == 0:
                    group.add(row)
                else:
                    yield group, row

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, row in answered(batches):
            ids, q = _matrix(row)
            kth = []
            for i, v in zip(ids.tolist(), q):
                top = group.search(row["dim"], i, v, k, -np.inf, best_leaves_only=True)
                kth.append(float(top[-1][0]) if len(top) == k else -np.inf)
            yield C.record("block long, bound binary", block=[row["block"]], bound=[np.array(kth).tobytes()])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in C.groups(batches, "block"):
            bound = np.max([np.frombuffer(r["bound"]) for r in rows if r["kind"] < 0], axis=0)
            for r in rows:
                if r["kind"] >= 0:
                    yield C.record(SHARD, **{c: [r[c]] for c in ("kind", "block", "n", "dim", "ids", "vectors")}, bound=[bound.tobytes()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, row in answered(batches):
            ids, q = _matrix(row)
            hits = [(i, -v, s) for i, x, b in zip(ids.tolist(), q, np.frombuffer(row["bound"]).tolist()) for s, v in group.search(row["dim"], i, x, k, b)]
            yield C.record(HITS, query_id=[h[0] for h in hits], vec_id=[h[1] for h in hits], score=[h[2] for h in hits])

    # a block's own row behind the bounds that the groups gave it
    probed = meet(blocks).mapInArrow(probe, "block long, bound binary")
    bounds = probed.select(F.lit(-1).alias("kind"), "block", F.lit(0).alias("n"), F.lit(0).alias("dim"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("vectors"), "bound")
    bounded = C.materialise(C.by_bucket(bounds.unionByName(blocks), tasks, "block", "kind").mapInArrow(best, SHARD), "bounded")
    hits = meet(bounded).mapInArrow(search, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH ints AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
