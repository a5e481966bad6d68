"""Shared pieces: scratch tables, chunks of documents, vectorised word hashing, scattering of keys to buckets.

Several operators run over *chunks*: rows that hold a few megabytes of whole documents as one
compressed Arrow record batch.  A chunk table is written once to the shared scratch folder, so
every later pass sees the same chunks whatever executors are lost in between, and an exchange of
texts moves few large compressed rows instead of many small ones.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20


def _return_memory() -> None:
    """Let large arrays go back to the system when they are freed: by default glibc keeps blocks of up to 32 MB for itself, and Arrow's pool all it ever had."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_return_memory()
ENTRIES_PER_TASK = 4_000_000
CHUNK_SCHEMA = "chunk long, n_bytes long, body binary"


# ---------------------------------------------------------------- scratch tables
def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, a folder of our own is set (local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = spark.conf.get("spark.tidepanel.scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="tidepanel-")
            spark.conf.set("spark.tidepanel.scratch", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPE:
        _SCOPE[-1].append(path)
    return path


_SCOPE: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the scratch paths that are made inside, for drop()."""
    paths: list[str] = []
    _SCOPE.append(paths)
    try:
        yield paths
    finally:
        _SCOPE.pop()
        if _SCOPE:
            _SCOPE[-1].extend(paths)


def drop(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Delete scratch paths that no later plan reads, but those that `keep` reads."""
    files = keep.inputFiles() if keep is not None else []
    for path in paths:
        tail = path.rsplit("/", 1)[1]
        if not any(f"/{tail}/" in f for f in files):
            _delete(spark, path)
    paths.clear()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts the lineage and, with free, lets shuffle files go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if free:
        release(spark)
    return out


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Hold the session's Arrow batches to `size` bytes, so that a Python worker and its buffers stay small whatever the rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().getConfString(key, "64m") != str(size):
        spark.conf.set(key, str(size))


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later plan reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of finished plans: the second collection finds what the first has finalised."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.4)
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, entries: int = 0) -> int:
    """Shuffle partitions: the session's number, more if a task would hold more than ENTRIES_PER_TASK entries."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES_PER_TASK))


def with_columns_first(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that extra columns of any name never clash with computed ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already (in any case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list:
    """The columns of df, for a select of them from a table with more."""
    return [F.col(f"`{c}`") for c in df.columns]


# ---------------------------------------------------------------- batches and chunks
def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of `column`; a longer row is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64) + 64
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def to_body(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def from_body(body: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(body)) as r:
        return r.read_all().combine_chunks()


def chunks(docs: DataFrame, limit: int = CHUNK_BYTES, extra: tuple[str, ...] = ()) -> DataFrame:
    """The chunk table of docs (doc_id, text and the extra columns), written once to the scratch folder."""

    bound_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            body = to_body(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({"chunk": [base + n], "n_bytes": [size], "body": [body]}, schema=pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("body", pa.binary())]))

        for piece in small_batches(batches, "text", limit // 4):
            held.append(piece)
            size += int(pc.sum(pc.binary_length(piece.column(1))).as_py() or 0) + 64 * piece.num_rows
            if size >= limit:
                yield out()
                n, held, size = n + 1, [], 0
        if held:
            yield out()

    names = ["doc_id", "text", *extra]
    return materialise(with_columns_first(docs, names).mapInArrow(pack, CHUNK_SCHEMA), "chunks")


# ---------------------------------------------------------------- words
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_REACH = 48
_TABLE = np.random.default_rng(20240601).integers(0, 2**64, size=(_REACH, 256), dtype=np.uint64).ravel()
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MINV = np.uint64(pow(int(_M), -1, 2**64))
_M2, _SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_M2INV = np.uint64(pow(int(_M2), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of some documents: `first[i]:first[i + 1]` are those of document i; `h` has a 64-bit hash of each."""

    first: np.ndarray
    h: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null has none."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def words(texts: list[bytes], lower: bool = False, block: int = 1 << 20) -> Words:
    """Hash every run of bytes that are not ASCII white space, by a random table for the first 48 bytes of a word and by blake2b for longer words.

    Texts are taken in blocks of about `block` bytes, as a word's working arrays are many times its size.
    """
    parts, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= block:
            parts.append(_words(held, lower))
            held, size = [], 0
    if held or not parts:
        parts.append(_words(held, lower))
    base = np.cumsum([0, *[len(p.h) for p in parts]])
    return Words(np.concatenate([[0], *[p.first[1:] + b for p, b in zip(parts, base)]]).astype(np.int64), np.concatenate([p.h for p in parts]))


def _words(texts: list[bytes], lower: bool) -> Words:
    data = b" ".join(texts)
    if lower:
        data = data.translate(LOWER)
    b = np.frombuffer(data + b" ", dtype=np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    lens = np.flatnonzero(edge == -1) - starts
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    first = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    if not len(starts):
        return Words(first, np.zeros(0, dtype=np.uint64))
    offset = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(offset.astype(np.int32), lens)
    long = lens > _REACH
    if long.any():
        np.minimum(pos, _REACH - 1, out=pos)
    pos *= 256
    pos += b[inside]
    h = mix(np.add.reduceat(_TABLE[pos], offset) + lens.astype(np.uint64))
    if long.any():
        import hashlib

        for i in np.flatnonzero(long):
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + lens[i]], digest_size=8).digest(), "little")
    return Words(first, h)


def word_chunks(table: DataFrame) -> DataFrame:
    """The words of a chunk table, as sorted distinct hashes and codes, so that later passes need not hash texts again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = words(encoded(from_body(row["body"]).column("text").chunk(0)))
                ids, codes = np.unique(w.h, return_inverse=True)
                one = pa.record_batch({"first": pa.array([w.first.tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "codes": pa.array([pack_ints(codes)], pa.binary())})
                yield record(CHUNK_SCHEMA, chunk=[row["chunk"]], n_bytes=[row["n_bytes"]], body=[to_body(one)])

    return materialise(table.mapInArrow(pack, CHUNK_SCHEMA), "words")


def read_words(body: bytes) -> Words:
    row = from_body(body).to_pylist()[0]
    first = np.frombuffer(row["first"], np.int64)
    return Words(first, np.frombuffer(row["ids"], np.uint64)[unpack_ints(row["codes"], 0, int(first[-1]))[0]])


class Windows:
    """Hashes of runs of consecutive words, of any length, from one pass of prefix sums modulo 2**64."""

    def __init__(self, w: Words, second: bool = False):
        """second: hashes by another multiplier and other hashes of words, for keys of 128 bits."""
        n = len(w.h)
        self.first, self.n = w.first, n
        h, m, inverse = (mix(w.h ^ _SECOND), _M2, _M2INV) if second else (w.h, _M, _MINV)
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, m, dtype=np.uint64))))
        self.inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, inverse, dtype=np.uint64))))
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * powers[:n], dtype=np.uint64)))
        self.end = np.repeat(w.first[1:], np.diff(w.first))

    def starts(self, k: int) -> np.ndarray:
        """Positions at which a window of k words of one document starts."""
        p = np.arange(self.n)
        return p[p + k <= self.end]

    def hash(self, p: np.ndarray, k) -> np.ndarray:
        return mix((self.sums[p + k] - self.sums[p]) * self.inverse[p] + np.asarray(k).astype(np.uint64))


def covered(n: int, starts: np.ndarray, k) -> np.ndarray:
    """Which of n positions lie in [s, s + k) of any start s."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:n]) > 0


# ---------------------------------------------------------------- buckets
def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1 by the high half of the hash; non-decreasing in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def bucket_bounds(sorted_h: np.ndarray, n: int) -> np.ndarray:
    """The n + 1 offsets of the buckets in sorted hashes."""
    return np.searchsorted(bucket_of(sorted_h, n), np.arange(n + 1, dtype=np.uint64))


def narrow(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash, as bytes."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | (np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers in the least of 1, 2, 4 or 8 bytes each; the first byte says which."""
    top = int(x.max()) if len(x) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def unpack_ints(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n packed integers from offset at, and the offset behind them."""
    size = data[at]
    return np.frombuffer(data, f"u{size}", n, at + 1).astype(np.int64), at + 1 + size * n


def by_bucket(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows of a bucket (or chunk) together and in order, streamed to one task; the bucket's size is bounded by the number of buckets.

    Buckets count from 0, so they are dealt out in turn and tasks get equally many; other keys go by hash.
    """
    key = order[0]
    dealt = df.repartition(n, key) if key in ("chunk", "pair") else df.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions(*order)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows of one key as lists of dicts; the rows must come ordered by key."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def record(schema: str | T.StructType, /, **columns) -> pa.RecordBatch:
    """A record batch with the Arrow types of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pydict(columns, schema=to_arrow_schema(_parsed(schema)))


_PARSED: dict[str, T.StructType] = {}


def _parsed(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else _PARSED.setdefault(schema, _from_ddl(schema))


def _from_ddl(schema: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "float": T.FloatType(), "array<int>": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(*(name, kinds[kind])) for name, kind in (x.split() for x in schema.split(", "))])
