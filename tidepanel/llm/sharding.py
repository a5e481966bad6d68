"""K-d tree partitioning of documents into shards of near equal bytes, with DataFrame operations only.

The tree lives in a metadata space of three dimensions (log of the size, source, language), each scaled
to 18 bits.  A node with n shards to hold splits at the weighted quantile n // 2 / n along its widest
dimension.  The quantiles of all nodes of a level are found together by three passes of radix selection
over 36-bit keys (dimension, then a hash that breaks ties, so that one value with a third of all rows
still splits evenly): each pass sums bytes by (node, 12-bit digit) on the map side first, and at most
4096 sums a node reach the driver.  The splits found so far are an expression over the metadata, so
rows are never rewritten or moved until they get their slots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

DIGIT, PASSES, VALUE_BITS = 12, 3, 18
SLOT_ROWS = 2048


@dataclass
class Node:
    """A subtree that holds shards low to low + n - 1; dim and cut: rows with a key below cut go left."""

    low: int
    n: int
    dim: int = -1
    cut: int = 0


def _metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, row and the raw dimensions; missing source or lang columns count as null."""
    have = set(docs.columns)
    code = lambda name: F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")) if name in have else F.lit(0).cast("long")
    text = F.coalesce(F.col("`text`").cast("binary"), F.lit(b""))
    size = F.octet_length(text).cast("long") + F.lit(8)
    row = F.monotonically_increasing_id()
    return docs.select(F.col("`doc_id`").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), row.alias("row"), F.log2(size.cast("double")).alias("d0"), code("source").cast("double").alias("d1"), code("lang").cast("double").alias("d2"))


def _key(dim: int) -> Column:
    """36 bits: the dimension's 18, then 18 that break its ties."""
    return F.shiftleft(F.col(f"k{dim}"), VALUE_BITS).bitwiseOR(F.col("tie"))


def _node(tree: list[list[Node]], n_shards: int) -> Column:
    """The lowest shard of the node that a row is in, by the splits of all levels so far: a fold over the levels, each an array by node."""
    if not tree:
        return F.lit(0)
    never = (1 << 62) - 1
    levels = []
    for level in tree:
        dims, cuts, halves = [0] * n_shards, [never] * n_shards, [0] * n_shards
        for node in level:
            if node.dim >= 0:
                dims[node.low], cuts[node.low], halves[node.low] = node.dim, node.cut, node.n // 2
        levels.append(F.struct(*[F.array(*[F.lit(v).cast(kind) for v in values]).alias(name) for name, kind, values in (("dims", "int", dims), ("cuts", "long", cuts), ("halves", "int", halves))]))
    keys = F.array(*[_key(d) for d in range(3)])
    step = lambda at, level: at + F.when(F.get(keys, F.get(level["dims"], at)) >= F.get(level["cuts"], at), F.get(level["halves"], at)).otherwise(F.lit(0))
    return F.aggregate(F.array(*levels), F.lit(0), step)


def _splits(rows: DataFrame, nodes: list[Node], n_shards: int) -> None:
    """Set dim and cut of each node that holds two shards or more; rows has the node of each row as `node`."""
    widths = {r.node: r for r in rows.groupBy("node").agg(*[(F.max(f"k{d}") - F.min(f"k{d}")).alias(f"w{d}") for d in range(3)], F.sum("size").alias("bytes")).collect()}
    split = [x for x in nodes if x.n > 1 and x.low in widths]
    if not split:
        return
    want, dims, prefix, before, here = {}, [-1] * n_shards, [-1] * n_shards, {}, {}
    for x in split:
        r = widths[x.low]
        x.dim = max(range(3), key=lambda d: (r[f"w{d}"], -d))
        want[x.low], before[x.low], dims[x.low], prefix[x.low] = r.bytes * (x.n // 2) / x.n, 0, x.dim, 0
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("node"))
    keyed = rows.select("node", "size", F.get(F.array(*[_key(d) for d in range(3)]), at(dims, "int")).alias("key"))
    for done in range(PASSES):
        shift = DIGIT * (PASSES - 1 - done)
        inside = F.shiftright("key", shift + DIGIT) == at(prefix, "long")
        sums = keyed.where(inside).groupBy("node", F.shiftright("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")).agg(F.sum("size").alias("bytes")).collect()
        by: dict[int, list] = {}
        for r in sums:
            by.setdefault(r.node, []).append((r.digit, r.bytes))
        for low, found in by.items():
            found.sort()
            total = before[low] + np.cumsum([b for _, b in found])
            i = min(int(np.searchsorted(total, want[low])), len(found) - 1)
            before[low], here[low] = int(total[i]) - found[i][1], found[i][1]
            prefix[low] = (prefix[low] << DIGIT) | found[i][0]
    for x in split:
        # the last key goes to the side that leaves the sizes nearer to what is wanted
        x.cut = prefix[x.low] + int(2 * (want[x.low] - before[x.low]) > here[x.low])


def keyed_metadata(meta: DataFrame) -> DataFrame:
    """Metadata with the scaled dimensions k0 to k2 and the hash that breaks their ties."""
    r = meta.agg(F.count(F.lit(1)).alias("n"), *[f(f"d{d}").alias(f"{f.__name__}{d}") for d in range(3) for f in (F.min, F.max)]).first()
    top = (1 << VALUE_BITS) - 1
    scaled = [F.floor((F.col(f"d{d}") - F.lit(r[f"min{d}"])) / F.lit((r[f"max{d}"] - r[f"min{d}"]) or 1.0) * F.lit(top)).cast("long").alias(f"k{d}") for d in range(3)] if r.n else [F.lit(0).cast("long").alias(f"k{d}") for d in range(3)]
    return meta.select("doc_id", "size", "text_crc32", "row", *scaled, F.xxhash64("doc_id", "text_crc32", "row").bitwiseAND(F.lit(top)).alias("tie"))


def kd_shards(docs: DataFrame, n_shards: int | None = 24, target_bytes: int | None = None) -> DataFrame:
    """Shard and slot of each document; the shards' sizes are nearly equal.

    docs: doc_id long, text string, and source and lang if there are any; other columns are ignored.
    The size of a document is its text's UTF-8 bytes (null: none) plus 8.  Give n_shards, or target_bytes
    for as many shards as leaves of at most that size on average.  Returns doc_id, size, text_crc32, law
    (`bytes`), shard, slot (0 to the shard's rows - 1), grown_shard (null: only key sharding has it).
    Every row is placed, repeated rows, null ids and null texts included; rows equal in all dimensions are
    split by a hash.  An empty table gives no rows.  A single row of more than a shard's share of bytes
    has a shard of its own.
    """
    meta = C.materialise(_metadata(docs), "metadata")
    if n_shards is None:
        n_shards = max(1, -(-(meta.agg(F.sum("size")).first()[0] or 0) // (target_bytes or 1 << 30)))
    keyed = keyed_metadata(meta)
    tree: list[list[Node]] = []
    nodes = [Node(0, n_shards)]
    while any(x.n > 1 for x in nodes):
        _splits(keyed.withColumn("node", _node(tree, n_shards)), nodes, n_shards)
        tree.append(nodes)
        nodes = [y for x in nodes for y in ([Node(x.low, 1)] if x.n == 1 else [Node(x.low, x.n // 2), Node(x.low + x.n // 2, x.n - x.n // 2)])]
    return _slots(keyed.select("doc_id", "size", "text_crc32", "row", _node(tree, n_shards).alias("shard")), n_shards)


def _slots(rows: DataFrame, n_shards: int) -> DataFrame:
    """Gapless slots in each shard: shards are cut into parts of about SLOT_ROWS rows by a hash, rows are numbered within parts, and the parts' offsets are prefix sums of their counts."""
    counts = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.get(F.array(*[F.lit(max(1, -(-counts.get(s, 0) // SLOT_ROWS))) for s in range(n_shards)]), F.col("shard"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), parts))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    return (
        rows.withColumn("own", own)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
