"""Precomputed tables: what many plans derive from the same files is built once and read by all of them.

A table is known by its name and by path, size and time of every file it is built from, so a changed input is
built anew.  It lies in the folder that spark.checkpoint.dir names (local mode has a folder of its own);
executors that are lost take nothing with them, and no plan aggregates the raw table more than once.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not spark.conf.get("spark.tidepanel.store", None):
        spark.conf.set("spark.tidepanel.store", "file://" + tempfile.mkdtemp(prefix="tidepanel-"))
    return spark.conf.get("spark.tidepanel.store")


def fingerprint(source: DataFrame) -> str:
    """A digest of path, size and time of each file of a table."""
    spark = source.sparkSession
    conf, at = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    parts = []
    for name in sorted(source.inputFiles()):
        status = at(name).getFileSystem(conf).getFileStatus(at(name))
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def precomputed(source: DataFrame, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(source), written at its first use and read from there on; a table without files is built each time."""
    spark = source.sparkSession
    if not source.inputFiles():
        return build(source)
    path = f"{_root(spark)}/{name}-{fingerprint(source)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build(source).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
