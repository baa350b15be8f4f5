"""Order-dependent work over rows of any number and keys of any size: offsets, neighbours, gaps, islands and greedy cutting.

`blocks` sorts a table by key and order over all its rows and writes it as ranges of some ROWS rows, numbered. A key may fill many
blocks and a block may hold many keys; no task has more than a block. What a block must know of those before it (sums, the last
row, where the batch that is open began) is told by a row for each block and key, which is all that is
gathered by key. Rows must have a unique order within their key, or which of equal ones comes first is not defined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.files import scratch

ROWS = 200_000


def blocks(df: DataFrame, by: str, order: str, rows: int | None = None) -> DataFrame:
    """df + block and at: the number of a row's range, and its place over the whole table. Written to the shared folder."""
    spark = df.sparkSession
    n = max(1, -(-df.count() // (rows or ROWS)))
    keys = [F.col(by).asc_nulls_first(), F.col(order).asc_nulls_first()]
    at = F.monotonically_increasing_id()  # a partition's number above 33 bits, the row's below
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", at).withColumn("block", F.shiftright("at", 33).cast("int"))
    path = scratch(spark, "blocks")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _told(b: DataFrame, by: str, *what: Column) -> DataFrame:
    """A row for each block and key."""
    return b.groupBy("block", by).agg(*what)


def _join(b: DataFrame, told: DataFrame, by: str) -> DataFrame:
    t = told.withColumnsRenamed({"block": "_block", by: "_by"})
    return b.join(t, (F.col("block") == F.col("_block")) & F.col(by).eqNullSafe(F.col("_by"))).drop("_block", "_by")


def running(df: DataFrame, by: str, order: str, value: str, start: str = "start", end: str = "end", rows: int | None = None) -> DataFrame:
    """df + the sum of value before and up to each row of its key. A null value counts as nothing."""
    b = blocks(df.withColumn("_value", F.coalesce(F.col(value), F.lit(0))), by, order, rows)
    ahead = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = _told(b, by, F.sum("_value").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = F.sum("_value").over(Window.partitionBy("block", by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _join(b, told, by).withColumn(end, F.col("_ahead") + inside).withColumn(start, F.col(end) - F.col("_value")).drop("_value", "_ahead", "block", "at")


def previous(df: DataFrame, by: str, order: str, value: str, name: str, rows: int | None = None) -> DataFrame:
    """df + name: value of the row before of the same key; null for a key's first."""
    b = blocks(df, by, order, rows)
    told = _told(b, by, F.max_by(F.struct(F.col(value).alias("v")), "at").alias("_last")).withColumn("_before", F.lag("_last").over(Window.partitionBy(by).orderBy("block"))).drop("_last")
    w = Window.partitionBy("block", by).orderBy("at")
    out = _join(b, told, by).withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_before.v")).otherwise(F.lag(value).over(w)))
    return out.drop("_before", "block", "at")


def gaps(df: DataFrame, by: str, number: str, rows: int | None = None) -> DataFrame:
    """by, gap_start, gap_end: numbers missing inside the range of a key's numbers, a row a gap."""
    d = df.select(by, number).where(F.col(number).isNotNull()).distinct()
    p = previous(d, by, number, number, "_p", rows)
    return p.where(F.col(number) > F.col("_p") + 1).select(by, (F.col("_p") + 1).alias("gap_start"), (F.col(number) - 1).alias("gap_end"))


def islands(df: DataFrame, by: str, order: str, key: str, name: str, rows: int | None = None) -> DataFrame:
    """df + name: the number (from 0) of each run of equal key values within by. A value that comes back is a new run; null equals null."""
    p = previous(df.withColumn("_key", F.struct(F.col(key).alias("k"))), by, order, "_key", "_p", rows)
    new = F.when(F.col("_p").isNull() | F.col("_p.k").eqNullSafe(F.col(key)), 0).otherwise(1)
    return running(p.withColumn("_new", new).drop("_key", "_p"), by, order, "_new", "_unused", name, rows).drop("_new", "_unused")


# greedy cutting -------------------------------------------------------------------


def next_starts(sizes: np.ndarray, limit: int, joint: int = 0, most: int | None = None, lone: bool = True) -> np.ndarray:
    """For each item: where the next batch begins if one begins there (len(sizes): not within). One item may be too large by itself; lone: also after nothing but items of size 0."""
    m = len(sizes)
    w = np.r_[0, np.cumsum(sizes + joint)]
    i = np.arange(m)
    e = np.searchsorted(w[1:], w[:-1] + joint + limit, "right")
    if not lone:
        e = np.minimum(e + (w[np.minimum(e, m)] == w[:-1]), m)
    return np.minimum(np.maximum(e, i + 1), m if most is None else np.minimum(i + most, m))


def doubled(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: the last batch's start and how many batches begin, if one begins there; by pointer doubling."""
    m = len(nxt)
    last, count, jump = np.arange(m), np.ones(m, np.int64), nxt.copy()
    while (on := np.flatnonzero(jump < m)).size:
        to = jump[on]
        last[on], count[on], jump[on] = last[to], count[on] + count[to], jump[to]
    return last, count


class _Part:
    """A run of one key's items in a block."""

    def __init__(self, sizes: np.ndarray, limit: int, joint: int, most: int | None, lone: bool = True):
        self.sizes, self.limit, self.joint, self.most, self.lone = sizes, limit, joint, most, lone
        self.next = next_starts(sizes, limit, joint, most, lone)

    def entries(self) -> list[tuple[int, int, int, int]]:
        """For each place where the first batch of this part may begin (those that an open batch could reach, however little it holds): bytes up to there, batches begun, size and count of the last."""
        w = np.cumsum(self.sizes + self.joint)
        far = min(int(np.searchsorted(w, self.limit, "right")) + (not self.lone), len(w) if self.most is None else max(0, self.most - 1))
        last, count = doubled(self.next)
        j = np.arange(min(far + 1, len(w)))
        total = np.r_[0, w]
        size = total[-1] - total[last[j]] - self.joint
        return list(zip(w[j].tolist(), count[j].tolist(), size.tolist(), (len(w) - last[j]).tolist(), strict=True))

    def first(self, size: int, count: int) -> int:
        """Where the first batch begins if an open one has this size and count; len: not within."""
        w = size + np.cumsum(self.sizes + self.joint)
        at = int(np.searchsorted(w, self.limit, "right"))
        if not self.lone and at < len(w) and (w[at - 1] if at else size) == 0:
            at += 1
        return at if self.most is None else min(at, max(0, self.most - count))

    def numbers(self, first: int, before: int) -> np.ndarray:
        """Each item's batch; items before `first` belong to number before - 1."""
        start, p = np.zeros(len(self.sizes), np.int64), first
        while p < len(self.sizes):
            start[p] = 1
            p = int(self.next[p])
        return before - 1 + np.cumsum(start)


def _runs(keys: list) -> list[tuple[int, int]]:
    at = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
    return list(zip(at[:-1], at[1:], strict=True))


def cut(df: DataFrame, by: str, order: str, size: str, limit: int, joint: int = 0, most: int | None = None, name: str = "batch", allowed: tuple[int, int] | None = None, lone: bool = True, rows: int | None = None) -> DataFrame:
    """df + name: the number (from 0, within by) of the batch that each row falls into when a key's rows are packed in order.

    A new batch begins when the row, with its joint, would take the open one's size over limit, or the open one has `most` rows; with
    lone=False (and joint 0) not if the open one has rows of size 0 only. Same as
    chunking.greedy_groups, without a key's rows in one array: a block works out, for every place at which its first batch
    can begin, how its last one ends (next starts by search in prefix sums, then pointer doubling); one pass over a row a
    block settles the places; blocks then number their rows. Sizes that are null, negative or outside `allowed` raise.
    """
    low, high = allowed or (0, (1 << 62))
    s = F.col(size).cast("long")
    bad = F.raise_error(F.concat(F.lit(f"a size outside {low}..{high}: "), F.coalesce(s.cast("string"), F.lit("null")))).cast("long")
    b = blocks(df.withColumn("_size", F.when(s.between(low, high), s).otherwise(bad)).withColumn("_key", F.coalesce(F.col(by).cast("string"), F.lit("\0null"))), by, order, rows)

    def part(t: pa.Table, i: int, j: int) -> _Part:
        return _Part(t.column("_size").to_numpy()[i:j].astype(np.int64), limit, joint, most, lone)

    def tell(key, t):
        t = t.sort_by("at")
        keys = t.column("_key").to_pylist()
        runs = _runs(keys)
        first, last = part(t, *runs[0]), part(t, *runs[-1])
        told = {"first": keys[0], "last": keys[-1], "one": len(runs) == 1, "entries": first.entries(), "length": len(first.sizes), "sizes": first.sizes[: len(first.entries())].tolist(), "end": last.entries()[0][1:]}
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "told": pa.array([json.dumps(told)])})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over blocks in order: where the first batch of each begins, and how many of its key have begun before."""
        key, state, begun, out = None, (0, 0), 0, []
        for k, text in ((k, x) for b in batches for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            x = json.loads(text)
            goes_on = out and key == x["first"]
            begun = begun if goes_on else 0
            if goes_on:
                reach = _Part(np.array(x["sizes"], np.int64), limit, joint, most, lone).first(*state)
                at = reach if reach < len(x["sizes"]) else x["length"]
            else:
                at = 0
            out.append((k, at, begun))
            if x["one"]:
                if at < x["length"]:
                    _, n, size, count = x["entries"][at]
                    state, begun = (size, count), begun + n
                else:  # no batch begins in it
                    state = (state[0] + x["entries"][-1][0], state[1] + x["length"])
            else:
                n, size, count = x["end"]
                state, begun = (size, count), n
            key = x["last"]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["block", "first", "begun"])

    told = b.select("block", "at", "_key", "_size").groupBy("block").applyInArrow(tell, "block int, told string")
    places = told.repartition(1).sortWithinPartitions("block").mapInArrow(settle, "block int, first long, begun long")

    def number(key, t, p):
        t, p = t.sort_by("at"), p.to_pylist()[0]
        keys, out = t.column("_key").to_pylist(), []
        for n, (i, j) in enumerate(_runs(keys)):
            out.append(part(t, i, j).numbers(p["first"] if n == 0 else 0, p["begun"] if n == 0 else 0))
        return t.select(["at"]).append_column("_batch", pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))

    numbered = b.select("block", "at", "_key", "_size").groupBy("block").cogroup(places.groupBy("block")).applyInArrow(number, "at long, _batch long")
    return b.join(numbered, "at").withColumn(name, F.col("_batch")).drop("_batch", "_size", "_key", "block", "at")
