"""The vector collection: alignment, idempotent upsert, audits and fingerprints on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alignment(left: DataFrame, right: DataFrame, on: str, vector: str | None = None) -> DataFrame:
    """One row: ids on both sides, missing on either, repeated on either. Both must be 1:1 before an inner join. vector (of right): also how many
    sizes its vectors have, and how many are null, empty or hold what is no finite number."""
    count = lambda d, n: d.groupBy(on).agg(F.count("*").alias(n))
    if vector:
        v = F.col(vector)
        bad = F.coalesce(F.size(v) < 1, F.lit(True)) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        sizes = right.agg(F.countDistinct(F.when(F.size(v) > 0, F.size(v))).alias("sizes"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_vectors"))
        return alignment(left, right, on).crossJoin(F.broadcast(sizes))  # one row each
    both = count(left, "l").join(count(right, "r"), on, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("missing_right"), F.count_if(F.col("l").isNull()).alias("missing_left"), F.count_if(F.col("l") > 1).alias("repeated_left"), F.count_if(F.col("r") > 1).alias("repeated_right"))


def upsert(base: DataFrame, changes: DataFrame, on: str) -> DataFrame:
    """base with changes by id: rows of changes replace or join those of base. Doing it again changes nothing."""
    return base.join(changes.select(on), on, "left_anti").unionByName(changes)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new snapshot folder; an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def field_audit(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """A row a field: present, missing, valid, invalid. fields: name -> what makes a present value valid. One pass."""
    sums = []
    for name, ok in fields.items():
        there = F.col(name).isNotNull()
        sums += [F.count_if(there).alias(f"p_{name}"), F.count_if(~there).alias(f"m_{name}"), F.count_if(there & F.coalesce(ok, F.lit(False))).alias(f"v_{name}")]
    one = df.agg(*sums)
    rows = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"p_{n}").alias("present"), F.col(f"m_{n}").alias("missing"), F.col(f"v_{n}").alias("valid"), (F.col(f"p_{n}") - F.col(f"v_{n}")).alias("invalid")) for n in fields))
    return one.select(F.inline(rows))


def fingerprint(df: DataFrame, on: str) -> DataFrame:
    """One row: rows and a sum of row hashes, the same in any order and partitioning; no row is collected."""
    row = F.sha2(F.to_json(F.struct(on, *sorted(c for c in df.columns if c != on))).cast("binary"), 256)
    low = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(low).cast("string").alias("fingerprint"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def eav_to_wide(df: DataFrame, on: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """Entity-attribute-value rows to a column for each attribute."""
    return df.groupBy(on).pivot(key, keys).agg(F.first(value, ignorenulls=True))
