"""Corpus-wide counts of hashes, exchanged as packed arrays.

Documents are dealt to chunks by hash of doc_id, a chunk being as much text as one task should hold, and stay there. Each
chunk reduces its hashes to sorted distinct ones with counts and cuts them into ranges; a packet (range, chunk)
is one row of packed bytes. A range adds up what all chunks say about a hash and replies to every chunk with
the answers in the order in which that chunk sent its hashes, so a reply needs no keys. A hash that is
everywhere is one entry a chunk, so nothing is skewed whatever the texts hold. Packets number chunks times ranges,
but never more than the entries.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import common as C

CHUNK_BYTES, LEAST_CHUNKS = 12 << 20, 16


def assign(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """docs(doc_id, text) -> (those with their chunk, number of chunks). A document without an id is dealt by its text."""
    n = C.parts_for(C.text_bytes(docs), chunk_bytes, least=LEAST_CHUNKS)
    of = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return docs.select(F.pmod(of, F.lit(n)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text"), n


def store(assigned: DataFrame, n: int, made=lambda df: df) -> DataFrame:
    """Chunks, or what is made of each of them, as a table bucketed by chunk: texts are shuffled once, each pass over the
    chunks reads a bucket where the last one did, and only packets and replies move. Pass the table to C.drop() when no pass is left."""
    spark = assigned.sparkSession
    buckets = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path, name = C.new_path(spark, "chunks"), f"chunks_{uuid.uuid4().hex[:12]}"
    with C.cleaned(spark):
        made(assigned.repartition(buckets, "chunk")).write.option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").sortBy("chunk").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved; the files stay when the catalogue forgets them
    spark.sql(f"DROP TABLE {name}")
    out._lexmill_path = path
    return out


def deal(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """docs(doc_id, text) -> (those with their chunk, stored, number of chunks)."""
    assigned, n = assign(docs, chunk_bytes)
    return store(assigned, n), n


def cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted hashes are cut into ranges of the hash space: ranges + 1 positions."""
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.r_[0, np.searchsorted(hashes, bounds), len(hashes)].astype(np.int64)


def packets(chunk: int, ranges: int, hashes: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows range, chunk, hashes and a packed column for each of columns, which run along sorted hashes."""
    at = cuts(hashes, ranges)
    parts = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
    out = {"range": pa.array([k for k, _ in parts], pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int32()), "hashes": C.binary_array([C.pack_sorted(hashes[s]) for _, s in parts])}
    for j, c in enumerate(columns):
        out[f"c{j}"] = C.binary_array([C.pack_planes(np.ascontiguousarray(c[s])) for _, s in parts])
    return pa.table(out)


def add_up(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of unsigned 64-bit counts by position, exact beyond 2^53."""
    if counts.sum(dtype=np.float64) < 2**52:
        return np.bincount(at, counts).astype(np.uint64)
    out = np.zeros(int(at.max()) + 1, np.uint64)
    np.add.at(out, at, counts)
    return out


PACKETS = "range int, chunk int, hashes binary"


def totals(packed: DataFrame) -> DataFrame:
    """packets with c0: counts (unsigned 64 bit) -> replies (chunk, range, r0: the corpus-wide sums)."""

    def add(key, t):
        parts = [C.unpack_sorted(x) for x in t.column("hashes").to_pylist()]
        counts = np.concatenate([C.unpack_planes(x, np.uint64) for x in t.column("c0").to_pylist()])
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = add_up(inverse, counts)[inverse]
        split = np.split(total, np.cumsum([len(x) for x in parts])[:-1])
        return pa.table({"chunk": t.column("chunk").cast(pa.int32()), "range": t.column("range").cast(pa.int32()), "r0": C.binary_array([C.pack_planes(x) for x in split])})

    return packed.groupBy("range").applyInArrow(add, "chunk int, range int, r0 binary")


def reply(t: pa.Table, column: str, dtype) -> np.ndarray:
    """A chunk's replies put together in the order of its sorted hashes."""
    rows = sorted(zip(t.column("range").to_pylist(), t.column(column).to_pylist(), strict=True))
    return np.concatenate([C.unpack_planes(x, dtype) for _, x in rows]) if rows else np.zeros(0, dtype)
