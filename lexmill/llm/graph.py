"""Connected components of large graphs by alternating stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import common as C


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges(a, b) -> node, root: the smallest node of its component; nodes without an edge to another are absent.

    Large star: a node's larger neighbours join its smallest neighbour; small star: its smaller
    neighbours do. Edges never grow in number, and rounds grow with the logarithm of the longest path.
    Each round is written to the shared folder; only counts reach the driver. A node's smallest neighbour is
    a sum made before the shuffle, and edges learn it by C.spread_lookup(): the star of a large component
    isn't gathered anywhere.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = C.materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n, mark = e.count(), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("rows_of_key"))
        large = C.spread_lookup(both, "u", low, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = C.materialize(large.distinct(), "stars")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows_of_key"))
        j = C.spread_lookup(large, "u", low2, n)
        small = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        new = C.materialize(small, "edges")  # u > v in all of them
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        C.drop(e, large)
        e, n = new, now[0]
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
