"""What the operators share: the shared folder, materialised tables, words and packed exchanges."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that part words: space and tab to carriage return. bytes.split() parts by the same.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Arrays of at least so many bytes get pages of their own, which go back when they are freed.
OWN_PAGES = 1 << 20


def _bounded_heap() -> None:
    """Python workers live on from task to task; without a fixed threshold glibc keeps what large arrays have used."""
    try:
        ctypes.CDLL(None).mallopt(-3, OWN_PAGES)  # M_MMAP_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
        in_tasks.append(True)
    except (AttributeError, OSError):  # another C library
        pass


#: Whether this process is a task's and has set its allocator so.
in_tasks: list[bool] = []
if TaskContext.get() is not None:  # a worker that loads this module for a task; the driver's process is left as it is
    _bounded_heap()


def give_back() -> None:
    """At the end of a task's large group: free pages go back to the machine."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: What workers keep from task to task, by owner: how to forget it.
caches: dict[str, Callable[[], object]] = {}
_last_owner = [""]


def begin(owner: str) -> None:
    """Called where a task's function begins: what other operators' tasks have left in this worker goes."""
    if owner != _last_owner[0]:
        for name, forget in caches.items():
            if name != owner:
                forget()
        _last_owner[0] = owner
        give_back()


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset (tests on one machine), a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = _own.setdefault("dir", "")
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            own = tempfile.mkdtemp(prefix="lexmill-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            path = _own["dir"] = f"file://{own}"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: With it Spark deletes an execution's shuffle files when the execution ends; what is written doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of what is written in here go when it is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path  # for drop()
    return out


def drop(*dfs: DataFrame) -> None:
    """Deletes tables made by materialize() that nothing reads any more, and lets Spark clean the shuffle files behind them."""
    for df in dfs:
        path = getattr(df, "_lexmill_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a folder that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def slices(batches: Iterator[pa.RecordBatch], nbytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about nbytes (one row at least), so that Python objects exist for a slice at a time."""
    for b in batches:
        step = max(1, b.num_rows * nbytes // max(nbytes, b.get_total_buffer_size()))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df doesn't have (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys that spread_lookup() broadcasts at most.
HOT_KEYS = 10_000


def spread_lookup(rows: DataFrame, key: str, table: DataFrame, n_rows: int) -> DataFrame:
    """rows left join table (a row a key: key, rows_of_key, other columns), however many rows a key has.

    A key with more than n_rows / HOT_KEYS rows is hot. There are at most HOT_KEYS of those: they are broadcast,
    so their rows stay where they are. No other key has more than that share of the rows.
    """
    least = max(1, -(-n_rows // HOT_KEYS))
    cols = [c for c in table.columns if c not in (key, "rows_of_key")]
    hot = table.where(F.col("rows_of_key") > least).select(key, F.lit(True).alias("is_hot"), *cols)
    known = rows.join(F.broadcast(hot), key, "left")
    done = known.where("is_hot").drop("is_hot")
    rest = known.where("is_hot is null").select(*rows.columns).join(table.where(F.col("rows_of_key") <= least).select(key, *cols), key, "left")
    return done.unionByName(rest)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def parts_for(nbytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(nbytes / each))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts (one pass over one column)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(col)).cast("long"))).first()[0] or 0)


# words and hashes ---------------------------------------------------------

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix's finaliser)."""
    x = (x ^ (x >> U(30))) * _M3
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a whole text; lower: A-Z to a-z only."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k consecutive words, from the words' hashes; fewer words give one hash of the whole sequence, none gives none."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    acc = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = mix(acc * _M1 + h[j : len(h) - k + 1 + j] + U(k))
    return acc


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k consecutive words in a number of steps that doesn't depend on k (products of doubling spans)."""
    n = len(h)
    if n < k:
        return h[:0]
    with np.errstate(over="ignore"):
        span, width, out, at = h, 1, None, 0
        bits = k
        while bits:
            if bits & 1:
                piece = span[at : at + n - k + 1]
                out = piece if out is None else mix(out * _M1 + piece * _M2 + U(width))
                at += width
            bits >>= 1
            if bits:
                span = mix(span[: len(span) - width] * _M1 + span[width:] * _M2 + U(width))
                width *= 2
        return mix(out + U(k))


# packed arrays --------------------------------------------------------------


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as differences, in planes of bytes so that high zero bytes compress away."""
    if len(a) == 0:
        return b""
    d = np.diff(a, prepend=U(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    p = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(p.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_planes(a: np.ndarray) -> bytes:
    w = a.dtype.itemsize
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, w).T).tobytes() if len(a) else b""


def unpack_planes(b: bytes, dtype) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(w, -1).T).view(dtype).ravel() if b else np.zeros(0, dtype)


def binary_array(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())


def squeeze(b: bytes) -> bytes:
    """Bytes for a shuffle, whose own codec has no entropy coding."""
    return zstandard.ZstdCompressor(level=1).compress(b)


def expand(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)
