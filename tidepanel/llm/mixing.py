"""Mixing of sources to target weights by a time-varying curriculum, with DataFrame operations only.

Targets: sources in order of code point (null last) weigh 5, 2, 1, repeating, and share the total of all
sizes; a source stops at three times its own size and the excess goes to the others by weight (the
water level of the shares, in closed form).  Curriculum: a source's weight at time t of the training,
from 0 to 1, is its mean weight times 1 + a (2t - 1).  The integral of that schedule is the source's
cumulative demand for words; its inverse gives the time at which each word of the source's stream is
due.  The stream is the source's documents in hash order, again and again; a copy of a document is taken
if its middle lies before the source's target, and its training position is the time its first word
is due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

WEIGHTS = (5, 2, 1)
RAMPS = (0.5, 0.0, -0.5)
CAP = 3
PART_ROWS = 2048


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, ramp from source and source_size (one row for each source)."""
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("nth") % len(values) + 1).cast("int"))
    rows = sizes.withColumn("nth", nth).select("source", "source_size", pick(weights).cast("double").alias("weight"), pick(ramps).alias("ramp"))
    rows = rows.withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    every = Window.partitionBy()
    below = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        ((F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(below), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))).alias("level"),
    )
    # a source is capped if the level at its place is not below its ratio; the first one that is not has the water level, and levels fall after it
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    return rows.withColumn("water", level).select("source", "source_size", "ramp", F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("water") * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, cap: int = CAP, row: str | None = None) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, copies, before, ramp, row.

    docs: doc_id long, text string, source string; other columns are ignored.  size: runs of characters
    other than ASCII white space (null: 0).  No document is taken more than cap times.  One row for each
    input row; equal ids are ordered by size, and rows equal in both are interchangeable.  Null sources
    are one source, the last; a source of size 0 has target 0; an empty table gives no rows.  row names a
    long column of docs that breaks the last ties (0 without one), returned as `row`.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    key = F.col(f"`{row}`") if row else F.lit(0).cast("long")
    rows = C.materialise(docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`source`").cast("string").alias("source"), F.col("`text`").alias("text"), key.alias("row")).select("doc_id", "source", "row", F.substring(digest, 1, 16).alias("digest"), size.alias("size")), "sizes")
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(by.select("source", "source_size"), weights, ramps, cap)
    info = by.select(F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("n") / PART_ROWS)).alias("parts")).join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    info = info.select(F.col("source").alias("s"), "source_size", "target", "ramp", "parts")
    cut = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("parts") / F.lit(float(1 << 32))).cast("long")
    known = rows.join(info, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", cut).drop("s")
    own = Window.partitionBy("source", "part").orderBy("digest", "doc_id", "size", "row")
    sums = known.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    starts = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size")).alias("start"))
    within = known.withColumn("within", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = within.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("before", F.col("start") + F.col("within"))
    room = F.floor((F.col("target") - F.col("before") - F.col("size") / 2.0) / F.col("source_size"))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.greatest(F.lit(0), room + 1))).otherwise(F.lit(0)).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "before", "ramp", "row")


def position(words_before):
    """The time from 0 to 1 at which the source's cumulative demand reaches so many words: the inverse of the integrated schedule."""
    x = F.least(F.lit(1.0), words_before / F.col("target"))
    a = F.col("ramp")
    return F.when(F.col("target") <= 0, F.lit(0.0)).when(a == 0, x).otherwise((F.sqrt((F.lit(1.0) - a) * (F.lit(1.0) - a) + F.lit(4.0) * a * x) - (F.lit(1.0) - a)) / (F.lit(2.0) * a) + F.lit(0.0))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training order: one row for each copy taken (doc_id, source, size, copy from 0, position), range-sorted by position.

    Nulls, repeated rows and other columns count as in mixture(); an empty table gives no rows.
    """
    taken = mixture(docs, **options).where("copies > 0")
    copies = taken.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    at = position(F.col("copy") * F.col("source_size") + F.col("before"))
    return copies.select("doc_id", "source", "size", "copy", at.alias("position")).repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one for each copy that the mix takes, in training order; rows that it doesn't take go.

    All columns of docs are returned as they are, whatever their names and nulls; repeated rows are rows of
    their own; an empty table gives no rows.
    """
    row, copy, at = C.fresh(docs, "_row", "_copy", "_position")
    numbered = C.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mixture(numbered, row=row, **options).where("copies > 0")
    when = position(F.col("copy") * F.col("source_size") + F.col("before"))
    plan = taken.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).select(F.col("row").alias(row), F.col("copy").alias(copy), when.alias(at))
    return numbered.join(plan, row).repartitionByRange(at, row, copy).sortWithinPartitions(at, row, copy).select(*C.own_columns(docs))


MIXTURE_SQL = """
WITH sized AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([5, 2, 1][1 + (nth % 3)] AS DOUBLE) AS weight, CAST([0.5, 0.0, -0.5][1 + (nth % 3)] AS DOUBLE) AS ramp
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nth FROM by_source)),
ratios AS (SELECT *, source_size * 3 / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
  FROM ratios WINDOW below AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS water FROM levels),
targets AS (SELECT source, source_size, ramp, CASE WHEN water IS NULL OR ratio <= water THEN source_size * CAST(3 AS DOUBLE) ELSE water * weight END AS target FROM water),
placed AS (
  SELECT s.*, t.source_size, t.target, t.ramp,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, greatest(0, floor((target - before - size / 2.0) / source_size) + 1)) AS BIGINT) ELSE 0 END AS copies
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken
FROM counted"""
