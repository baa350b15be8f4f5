"""Identities across tables: legacy numbers, ranks to chunks, references, replicas, copies, candidates and reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: Sequences that show a text was decoded wrongly (fixed values).
BROKEN = ("�", "Ã", "Ä±", "Å\u009f", "ÅŸ", "Ä\u009f", "ÄŸ")


def raise_where(bad: Column, message: str, what: Column, out: Column) -> Column:
    """out, or an error that names what is wrong."""
    return F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(what.cast("string"), F.lit("null")))).cast("string")).otherwise(out)


def legacy_registry(pairs: DataFrame) -> DataFrame:
    """pairs(number, document_id) -> one document a number; a blank number or one with two documents raises, the same pair again doesn't."""
    d = pairs.groupBy("number").agg(F.min("document_id").alias("document_id"), F.count_distinct("document_id").alias("n"))
    d = d.withColumn("document_id", raise_where(F.col("number").isNull() | (T.strip("number") == "") | F.col("document_id").isNull(), "blank legacy number or document", F.col("number"), F.col("document_id")))
    return d.select("number", raise_where(F.col("n") > 1, "ambiguous legacy number", F.col("number"), F.col("document_id")).alias("document_id"))


def to_source_keys(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """keys(number, article_type, article_no, ...) + source_key through legacy_registry(); a number that isn't there raises. The registry is one row a law."""
    j = keys.join(registry, "number", "left")
    known = raise_where(F.col("document_id").isNull(), "unresolved legacy number", F.col("number"), F.col("document_id"))
    return j.withColumn("document_id", known).withColumn("source_key", T.source_key("document_id", "article_type", "article_no"))


def ranks_to_chunks(history: DataFrame, chunks: DataFrame) -> DataFrame:
    """history(query_id, ids array) and chunks(id, ...) -> a row a rank with the chunk's fields; an id without chunk raises."""
    h = history.select("query_id", F.posexplode("ids").alias("at", "id")).select("query_id", (F.col("at") + 1).alias("rank"), "id")
    j = h.join(chunks.withColumn("is_there", F.lit(True)), "id", "left")
    none = F.raise_error(F.concat(F.lit("no chunk for "), F.col("id").cast("string"))).cast(h.schema["id"].dataType)
    return j.withColumn("id", F.when(F.col("is_there").isNull(), none).otherwise(F.col("id"))).drop("is_there")



def references(found: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """found(..., key) with resolved: whether the corpus has that key."""
    return found.join(corpus.select(key, F.lit(True).alias("resolved")).distinct(), key, "left").fillna(False, ["resolved"])


def replica(source: DataFrame, copy: DataFrame, on: str, vector: str, tolerance: float = 1e-4) -> DataFrame:
    """Each id's state: same, only_source, only_copy, fields (another column differs), vector (a component differs by more than the tolerance, or their number does)."""
    others = [c for c in source.columns if c not in (on, vector)]
    x = source.select(on, F.col(vector).alias("v"), F.struct(*others).alias("o") if others else F.lit(1).alias("o"), F.lit(1).alias("a"))
    y = copy.select(on, F.col(vector).alias("w"), F.struct(*others).alias("p") if others else F.lit(1).alias("p"), F.lit(1).alias("b"))
    j = x.join(y, on, "full_outer")
    near = (F.size("v") == F.size("w")) & F.forall(F.zip_with("v", "w", lambda p, q: F.abs(p - q) <= tolerance), lambda t: F.coalesce(t, F.lit(False)))
    state = F.when(F.col("b").isNull(), "only_source").when(F.col("a").isNull(), "only_copy").when(~F.col("o").eqNullSafe(F.col("p")), "fields").when(~F.coalesce(near, F.lit(False)), "vector").otherwise("same")
    return j.select(on, state.alias("state"))


def file_hashes(files: DataFrame) -> DataFrame:
    """binaryFile rows -> name (below the last slash), length, sha256."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verified_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """file_hashes() of two folders -> name, state: same, missing, extra, changed."""
    j = source.select("name", F.col("sha256").alias("x")).join(copy.select("name", F.col("sha256").alias("y")), "name", "full_outer")
    return j.select("name", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "changed").otherwise("same").alias("state"))


def pending_batches(planned: DataFrame, done: DataFrame, attempts: DataFrame) -> DataFrame:
    """planned(batch), done(batch), attempts(batch) -> batches still to do, in order; one that was begun and isn't known to be done raises, as a paid call may have been made."""
    j = planned.join(done.select("batch", F.lit(True).alias("is_done")).distinct(), "batch", "left").join(attempts.select("batch", F.lit(True).alias("begun")).distinct(), "batch", "left")
    open_ = j.where("is_done is null")
    return open_.select(F.when(F.col("begun"), F.raise_error(F.concat(F.lit("begun and not known to be done: batch "), F.col("batch").cast("string"))).cast(planned.schema["batch"].dataType)).otherwise(F.col("batch")).alias("batch"))


def candidate_problems(questions: DataFrame) -> DataFrame:
    """questions(id, question, notes, source_keys array) -> id, problems: broken characters, blank fields, repeated keys, no keys."""
    broken = lambda c: F.coalesce(F.greatest(*(F.instr(F.col(c), x) for x in BROKEN)) > 0, F.lit(False))
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    n = F.coalesce(F.size("source_keys"), F.lit(0))
    found = F.array_compact(F.array(
        F.when(broken("question") | broken("notes"), "encoding"),
        F.when(blank("question"), "blank_question"),
        F.when(blank("notes"), "blank_notes"),
        F.when(n <= 0, "no_sources"),
        F.when((n > 0) & (F.size(F.array_distinct("source_keys")) < n), "repeated_source"),
    ))
    return questions.select("id", found.alias("problems"))


def reconstruction(articles: DataFrame, chunks: DataFrame, joint: str = "\n") -> DataFrame:
    """articles(article_id, text), chunks(article_id, chunk_id, text) -> one row: counts, whether ids are unique, whether each article comes out of its chunks again, orphans."""
    c = chunks.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), joint).alias("again"), F.count("*").alias("n"), F.countDistinct("chunk_id").alias("k"))
    a = articles.groupBy("article_id").agg(F.first("text").alias("text"), F.count("*").alias("m"))
    j = a.join(c, "article_id", "full_outer")
    return j.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("articles"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.coalesce(F.bool_and((F.coalesce("m", F.lit(1)) == 1) & (F.coalesce("n", F.lit(0)) == F.coalesce("k", F.lit(0)))), F.lit(True)).alias("unique_ids"),
        F.count_if(~F.coalesce(F.col("again") == F.col("text"), F.lit(False)) & F.col("m").isNotNull()).alias("not_rebuilt"),
        F.count_if(F.col("m").isNull()).alias("orphans"),
    )
