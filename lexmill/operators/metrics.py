"""Ranking metrics, bands, paired comparisons, gates and the NULL rules of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(flag: Column) -> Column:
    """Share of true among known; NULL when none is known."""
    return F.avg(flag.cast("double"))


def at_cutoffs(ranking: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """ranking(query_id, rank, key, document) and gold(query_id, key, document) -> a row a query and cutoff.

    source_any, source_all, document_hit, document_all; intrusion: share of slots of documents that aren't gold,
    NULL without slots. A key or document counts once however many slots it has.
    """
    cut = F.explode(F.array(*map(F.lit, cutoffs)))
    first = lambda c: ranking.groupBy("query_id", c).agg(F.min("rank").alias("first"))
    keys = gold.select("query_id", "key").distinct().join(first("key"), ["query_id", "key"], "left").withColumn("k", cut)
    keys = keys.groupBy("query_id", "k").agg(F.coalesce(F.bool_or(F.col("first") <= F.col("k")), F.lit(False)).alias("source_any"), F.bool_and(F.coalesce(F.col("first") <= F.col("k"), F.lit(False))).alias("source_all"))
    docs = gold.select("query_id", "document").distinct()
    hits = docs.join(first("document"), ["query_id", "document"], "left").withColumn("k", cut)
    hits = hits.groupBy("query_id", "k").agg(F.coalesce(F.bool_or(F.col("first") <= F.col("k")), F.lit(False)).alias("document_hit"), F.bool_and(F.coalesce(F.col("first") <= F.col("k"), F.lit(False))).alias("document_all"))
    slots = ranking.join(docs.withColumn("ours", F.lit(1)), ["query_id", "document"], "left").withColumn("k", cut).where("rank <= k").groupBy("query_id", "k").agg(F.avg(F.col("ours").isNull().cast("double")).alias("intrusion"))
    return keys.join(hits, ["query_id", "k"]).join(slots, ["query_id", "k"], "left")


def first_ranks(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query over the first k: first gold rank, reciprocal rank (0 if none), recall and full coverage of gold keys."""
    first = ranking.where(F.col("rank") <= k).groupBy("query_id", "key").agg(F.min("rank").alias("first"))
    g = gold.select("query_id", "key").distinct().join(first, ["query_id", "key"], "left")
    out = g.groupBy("query_id").agg(F.min("first").alias("first_rank"), F.count("first").alias("found"), F.count("*").alias("gold"))
    return out.select("query_id", "first_rank", F.coalesce(1 / F.col("first_rank").cast("double"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("found") / F.col("gold")).alias("recall"), (F.col("found") == F.col("gold")).alias("full_coverage"))


def band(rank: Column, edges: tuple[int, ...] = (1, 3, 5, 10, 20, 50)) -> Column:
    """Exclusive bands of ranks; NULL is beyond the last."""
    out, low = F.lit(f">{edges[-1]}"), [0, *edges]
    for a, b in reversed(list(zip(low[:-1], low[1:], strict=True))):
        out = F.when(rank.between(a + 1, b), F.lit(str(b) if b == a + 1 else f"{a + 1}-{b}")).otherwise(out)
    return out


def duplicate_slots(ranking: DataFrame, key: str, k: int) -> DataFrame:
    """Per query: slots of the first k that repeat a key."""
    return ranking.where(F.col("rank") <= k).groupBy("query_id", key).count().groupBy("query_id").agg(F.sum(F.col("count") - 1).alias("duplicates"))


def paired(old: DataFrame, new: DataFrame, on: str, value: str) -> DataFrame:
    """old and new(on, value) -> on, old, new, change; raises where ids differ."""
    both = old.select(on, F.col(value).alias("old")).join(new.select(on, F.col(value).alias("new"), F.lit(1).alias("has_new")), on, "full_outer")
    word = F.when(F.col("new") > F.col("old"), "improved").when(F.col("new") < F.col("old"), "regressed").otherwise("unchanged")
    same = F.when(F.col("old").isNull() | F.col("new").isNull(), F.raise_error(F.lit("the two runs have different questions")).cast("string")).otherwise(word)
    return both.select(on, "old", "new", same.alias("change"))


def sum_or_null(c: str) -> Column:
    """The sum, or NULL as soon as one value is missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def gates(named: dict[str, Column]) -> list[Column]:
    """Columns of a one-row aggregate: each gate and whether all hold."""
    every = None
    for c in named.values():
        every = c if every is None else every & c
    return [*(c.alias(n) for n, c in named.items()), every.alias("all_pass")]


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Confusion matrix over a complete grid of column values."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)
