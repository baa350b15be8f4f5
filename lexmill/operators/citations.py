"""Evidence blocks, answer envelopes and citation labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context(ranked: DataFrame, by: str, rank: str, text: str) -> DataFrame:
    """by, context: numbered blocks in rank order, parted by an empty line."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    blocks = F.transform(rows, lambda x, i: F.concat(F.lit("[KAYNAK "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(x["t"], F.lit(""))))
    return ranked.groupBy(by).agg(F.array_join(blocks, "\n\n").alias("context"))


def envelope(answer: Column) -> Column:
    """struct(status, body): DURUM (in any case, once white space around all is gone) and CEVAP, else status FORMAT_ERROR and no body."""
    p = r"(?s)^DURUM:\s*(\S+)\s*\n+CEVAP:[ \t]*\n?(.*)$"
    t = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    s, body = F.upper(F.regexp_extract(t, p, 1)), F.regexp_replace(F.regexp_extract(t, p, 2), r"(?U)^\s+|\s+$", "")
    fine = s.isin("YETERLI", "YETERSIZ") & (body != "")
    return F.struct(F.when(fine, s).otherwise("FORMAT_ERROR").alias("status"), F.when(fine, body).alias("body"))


def labels(answer: Column) -> Column:
    """All label numbers in order, repeated ones too."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[KAYNAK\s+(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))


def valid_labels(found: Column, n: Column, status: Column) -> Column:
    """struct(labels, problem): distinct by first appearance; a label out of 1..n, or none where the status needs one, is a problem."""
    once = F.array_distinct(found)
    bad = F.exists(found, lambda x: (x < 1) | (x > n))
    problem = F.when(bad, "out_of_range").when((status == "YETERLI") & (F.size(once) == 0), "no_citation")
    return F.struct(F.when(problem.isNull(), once).alias("labels"), problem.alias("problem"))


def registered(cited: DataFrame, registry: DataFrame) -> DataFrame:
    """cited(answer_id, rank, chunk_id, document_id, article_type, article_no, and maybe legislation_number, source_file) against a manifest
    (document_id, title, document_type, legislation_number, local_file) -> cited + source_key, document_title, document_type.

    A document that isn't in the manifest, a number that is not the manifest's (where both are known), and a source file that is no document's or
    another document's raise: what a citation says of its source comes from the manifest alone.
    """
    null = F.lit(None).cast("string")
    c = cited.withColumns({f: F.col(f) if f in cited.columns else null for f in ("legislation_number", "source_file")})
    by_id = registry.select("document_id", F.col("title").alias("document_title"), "document_type", F.col("legislation_number").alias("_number"), F.lit(True).alias("_known"))
    by_file = registry.select(F.col("local_file").alias("source_file"), F.col("document_id").alias("_of_file"))
    j = c.join(by_id, "document_id", "left").join(by_file, "source_file", "left")
    what = (
        F.when(F.col("_known").isNull(), "a document that is not in the manifest: ")
        .when(F.col("legislation_number") != F.col("_number"), "a number that contradicts the manifest: ")
        .when(F.col("source_file").isNotNull() & F.col("_of_file").isNull(), "a file that is not in the manifest: ")
        .when(F.col("_of_file") != F.col("document_id"), "a file of another document: ")
    )
    key = F.concat_ws("/", "document_id", "article_type", F.lower("article_no"))
    checked = F.when(what.isNotNull(), F.raise_error(F.concat(what, F.coalesce(F.col("chunk_id").cast("string"), F.lit("?")))).cast("string")).otherwise(key)
    return j.select(*cited.columns, checked.alias("source_key"), "document_title", "document_type")
