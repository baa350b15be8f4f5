"""Document routing by centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroids(vectors: DataFrame, by: str, v: str = "embedding") -> DataFrame:
    """by, c: the mean vector of each document's vectors, of length one. Sums go over (by, position) and combine before the shuffle."""
    parts = vectors.select(by, F.posexplode(F.col(v).cast("array<double>")).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("m"))
    mean = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("m"))
    return mean.select(by, F.transform("m", lambda x: x / norm(F.col("m"))).alias("c"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


#: Questions and centres of a task.
QUESTIONS, CENTRES = 4096, 50_000


def route(queries: DataFrame, centers: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """queries(query_id, q) and centers(by, c) -> query_id, rank, by, similarity: the first k centres of each question by cosine, or all of them; ties (of similarities rounded to 9 places) by name.

    Blocks of questions meet shards of centres in matrix products; with k only k rows a question and shard are shuffled.
    """
    blocks, shards = max(1, -(-queries.count() // QUESTIONS)), max(1, -(-centers.count() // CENTRES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", each(shards))
    c = centers.select(by, F.col("c").cast("array<double>").alias("c"), F.pmod(F.xxhash64(by), F.lit(shards)).cast("int").alias("shard")).withColumn("block", each(blocks))

    def compare(key, left, right):
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            x, y = np.array(left.column("q").to_pylist(), np.float64), np.array(right.column("c").to_pylist(), np.float64)
            names, ids = right.column(by).to_pylist(), left.column("query_id").to_pylist()
            order = np.array(sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i])))
            near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ y[order].T
            for i, s in zip(ids, near, strict=True):
                best = np.argsort(-np.round(s, 9), kind="stable")[:k]
                out[0].extend([i] * len(best))
                out[1].extend(names[j] for j in order[best].tolist())
                out[2].extend(s[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), by: pa.array(out[1], right.schema.field(by).type), "similarity": pa.array(out[2], pa.float64())})

    kind = centers.schema[by].dataType.simpleString()
    near = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInArrow(compare, f"query_id long, {by} {kind}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), F.col(by).asc())
    out = near.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def margins(routes: DataFrame) -> DataFrame:
    """One row: count, mean, median, min and max of the gap between the first and the second."""
    top = routes.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("b"))
    m = F.col("a") - F.col("b")
    return top.agg(F.count("*").alias("n"), F.avg(m).alias("mean"), F.median(m).alias("median"), F.min(m).alias("least"), F.max(m).alias("most"))
