"""Sinks: atomic parquet replacement, appends that skip known keys, upserts, result directories, text reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..operators.books import insert_once, upsert


def write_panel(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replace a parquet table by swap(), sorted by code and date within files so that later filters skip row groups."""
    out = rows.repartition(partitions, "code") if partitions else rows.repartition("code")
    swap(out.sortWithinPartitions("code", "date"), path)


def write_table(rows: DataFrame, name: str, mode: str = "append") -> None:
    rows.write.mode(mode).saveAsTable(name)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merge_into(rows: DataFrame, path: str, keys: list[str], replace: bool = True) -> None:
    """Upsert (or insert once) into a parquet table by swap(): a crash leaves the old table or the new one."""
    spark = rows.sparkSession
    recover(spark, path)
    if not _exists(spark, path):
        swap(rows, path)
        return
    old = spark.read.parquet(path)
    swap((upsert if replace else insert_once)(old, rows.select(*old.columns), keys), path)


def swap(rows: DataFrame, path: str) -> None:
    """Replace a parquet table: the new one is written beside it, the old one steps aside, and only then goes.

    At every moment either the table, or `.old` with a complete `.new` beside it, exists; recover() finishes
    what a crash has interrupted.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.new")
    fs, at = _files(spark, path)
    fs.delete(at(f"{path}.old"), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.new"), at(path))
    fs.delete(at(f"{path}.old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash in swap(): without the table the complete new one takes its place, or else the old one comes back."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        for side in ("new", "old"):
            if fs.exists(at(f"{path}.{side}/_SUCCESS")):
                fs.rename(at(f"{path}.{side}"), at(path))
                break


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_results(tables: dict[str, DataFrame], root: str) -> None:
    """A directory with one parquet table for each result."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}")


def write_text(text: str, path: str) -> None:
    """Replace a small local text file at once."""
    fd, new = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(new, path)


def write_meta(meta: dict, path: str) -> None:
    write_text(json.dumps(meta, ensure_ascii=False, indent=1, default=str), path)


def report(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A Markdown report of small tables; at most so many rows of each reach the driver."""
    parts = [f"# {title}"]
    for name, rows in tables.items():
        found = rows.limit(most).collect()
        parts += [f"\n## {name}\n", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
        parts += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found]
    return "\n".join(parts) + "\n"
