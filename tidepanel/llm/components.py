"""Connected components of links by rounds of contraction, all in DataFrames.

Each round hooks every vertex to the neighbour of least hash (a new hash order each round, so that long
sorted chains shrink by a constant factor), jumps once along the hooks, and relabels the links; links
inside a label go.  The rounds' maps are composed at the end.  Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of links (a long, b long); equal labels are the same component.

    Self links make a component of one; repeated links count once; an empty table gives no rows; rows
    with a null end are ignored.
    """
    links = links.where("a is not null and b is not null")
    edges = C.materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", free=False)
    labels = C.materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label")), "labels", free=False)
    edges, round_ = edges.where("a <> b"), 0
    while not edges.isEmpty():
        round_ += 1
        order = lambda c: F.xxhash64(F.col(c), F.lit(round_))
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("v"))).alias("best"))
        hook = C.materialise(best.select(F.col("a").alias("x"), F.when(F.struct(order("a").alias("h"), F.col("a").alias("v")) < F.col("best"), F.col("a")).otherwise(F.col("best.v")).alias("to")), "hooks", free=False)
        jump = C.materialise(hook.join(hook.select(F.col("x").alias("to"), F.col("to").alias("far")), "to").select("x", F.col("far").alias("to")), "jumps", free=False)
        a, b = (jump.select(F.col("x").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = C.materialise(moved, "links", free=False)
        labels = C.materialise(labels.join(jump.select(F.col("x").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", free=False)
    return labels
