"""Lossless chunking and batching as folds over arrays: order matters, so each is one expression a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_groups(sizes: Column, limit: int, joint: int = 1, most: int | None = None) -> Column:
    """Group numbers (from 0) of items packed in order: a new group begins when the item with its joint would pass the limit (or the group has `most`). One item may be too large by itself."""
    start = F.struct(F.array().cast("array<int>").alias("g"), F.lit(-1).alias("n"), F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("count"))

    def step(a: Column, x: Column) -> Column:
        x = x.cast("bigint")
        over = (a["n"] < 0) | (a["size"] + joint + x > limit)
        if most is not None:
            over = over | (a["count"] >= most)
        n = F.when(over, a["n"] + 1).otherwise(a["n"])
        return F.struct(F.concat(a["g"], F.array(n)).alias("g"), n.alias("n"), F.when(over, x).otherwise(a["size"] + joint + x).alias("size"), F.when(over, F.lit(1)).otherwise(a["count"] + 1).alias("count"))

    return F.aggregate(sizes, start, step, lambda a: a["g"])


def pack_lines(docs: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    """Lines packed into chunks of at most `limit` characters, joined by newlines: doc_id, chunk_no (from 1), n_lines, chunk. Joining a document's chunks by newlines gives its text again."""
    lines = docs.select(doc_id, F.split(F.col(text), "\n", -1).alias("l")).withColumn("g", greedy_groups(F.transform("l", F.length), limit))
    rows = lines.select(doc_id, F.posexplode(F.arrays_zip("g", "l")).alias("at", "x"))
    made = rows.groupBy(doc_id, (F.col("x.g") + 1).alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("x.l").alias("l")))).alias("s"))
    return made.select(doc_id, "chunk_no", F.size("s").alias("n_lines"), F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("chunk"))


def units(text: Column) -> Column:
    """Numbered paragraphs of an article's text: array<struct(no, text)>, lossless when joined by newlines.

    Line 0 may hold (N) after notes in parentheses, or the dotted 1. only. (N) at a line's beginning always
    begins a unit; a dotted N. does if it follows the dotted N - 1, or is 1 with nothing but lines of parentheses
    since the heading. A first unit without number joins the second.
    """
    lines = F.split(text, "\n", -1)
    head = r"(?iuU)^\s*(?:EK\s+|GEÇİCİ\s+)?MADDE\s+\d+(?:\s*/\s*\p{L})?\s*[-–—]\s*"  # what follows the heading at once
    note = r"(?:\((?!\d+\)\s)[^)]*\)\s*)*"
    paren0 = F.nullif(F.regexp_extract(lines[0], head + note + r"\((\d+)\)\s", 1), F.lit(""))
    one0 = F.nullif(F.regexp_extract(lines[0], head + note + r"(1)\.\s", 1), F.lit(""))
    line0 = F.coalesce(paren0, one0)
    dotted0 = paren0.isNull() & one0.isNotNull()
    kind = "struct<units:array<struct<no:string,text:string>>,no:int,dotted:boolean,bare:boolean>"
    start = F.struct(F.array(F.struct(line0.alias("no"), lines[0].alias("text"))).alias("units"), line0.cast("int").alias("no"), F.coalesce(dotted0, F.lit(False)).alias("dotted"), F.lit(True).alias("bare")).cast(kind)

    def step(a: Column, line: Column) -> Column:
        paren = F.nullif(F.regexp_extract(line, r"(?U)^\((\d+)\)\s", 1), F.lit(""))
        dot = F.nullif(F.regexp_extract(line, r"(?U)^(\d+)\.\s*", 1), F.lit(""))
        n = dot.try_cast("int")
        begins_dot = dot.isNotNull() & ((a["no"].isNull() & (n == 1) & a["bare"]) | (a["dotted"] & (n == a["no"] + 1)))
        begins = paren.isNotNull() | F.coalesce(begins_dot, F.lit(False))
        no = F.when(paren.isNotNull(), paren).otherwise(dot)
        last = F.element_at(a["units"], -1)
        grown = F.concat(F.slice(a["units"], 1, F.size(a["units"]) - 1), F.array(F.struct(last["no"].alias("no"), F.concat(last["text"], F.lit("\n"), line).alias("text"))))
        return F.struct(
            F.when(begins, F.concat(a["units"], F.array(F.struct(no.alias("no"), line.alias("text"))))).otherwise(grown).alias("units"),
            F.when(begins, no.try_cast("int")).otherwise(a["no"]).alias("no"),
            F.when(begins, paren.isNull()).otherwise(a["dotted"]).alias("dotted"),
            (a["bare"] & line.rlike(r"(?U)^\s*\(.*\)\s*$")).alias("bare"),
        ).cast(kind)

    made = F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), start, step, lambda a: a["units"])
    merged = F.concat(F.array(F.struct(made[1]["no"].alias("no"), F.concat(made[0]["text"], F.lit("\n"), made[1]["text"]).alias("text"))), F.slice(made, 3, F.greatest(F.size(made) - 2, F.lit(0))))
    return F.when((F.size(made) > 1) & made[0]["no"].isNull(), merged).otherwise(made)


def article_chunks(articles: DataFrame, limit: int | None = 4000) -> DataFrame:
    """articles(article_id, text, ...) -> chunk_id, paragraph_numbers (NULL if none), text: whole units packed in order."""
    u = articles.withColumn("u", units(F.col("text")))
    g = greedy_groups(F.transform("u", lambda x: F.length(x["text"])), limit if limit is not None else 1 << 31)
    u = u.withColumn("g", g).select("article_id", F.posexplode(F.arrays_zip("g", "u")).alias("pos", "x")).select("article_id", "pos", F.col("x.g").alias("g"), F.col("x.u.no").alias("no"), F.col("x.u.text").alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "no", "t")))
    out = u.groupBy("article_id", "g").agg(ordered.alias("s"))
    numbers = F.array_compact(F.transform("s", lambda x: x["no"]))
    return out.select("article_id", F.format_string("%s-chunk-%03d", "article_id", F.col("g") + 1).alias("chunk_id"), F.when(F.size(numbers) > 0, numbers).alias("paragraph_numbers"), F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("text"))
