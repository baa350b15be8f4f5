"""Structure audits, run comparisons, recommendations and taxonomies; citations copied from trusted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_labels(df: DataFrame, by: str, label: str) -> DataFrame:
    return df.groupBy(by, label).agg(F.count("*").alias("n")).where("n > 1")


def same_prefix(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Two rankings (query_id, rank, id): per question whether the first k ids agree in order, and how many agree at all."""
    ids = lambda d, n: d.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(n))
    j = ids(a, "x").join(ids(b, "y"), "query_id", "full_outer")
    return j.select("query_id", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same_order"), F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0)).alias("shared"))


def drift(old: DataFrame, new: DataFrame, k: int, tolerance: float = 1e-7) -> DataFrame:
    """Per question: the first k slots have the same ids, and distances within the tolerance."""
    x = old.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("i"), F.col("distance").alias("d"))
    y = new.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("j"), F.col("distance").alias("e"))
    j = x.join(y, ["query_id", "rank"], "full_outer")
    same = F.coalesce(F.col("i") == F.col("j"), F.lit(False))
    return j.groupBy("query_id").agg(F.bool_and(same).alias("same_ids"), F.bool_and(same & (F.abs(F.col("d") - F.col("e")) <= tolerance)).alias("within_tolerance"))


def recommend(scores: DataFrame, baseline: str) -> DataFrame:
    """scores(variant, position, any_rate, all_rate): the baseline, or the best variant that is worse in neither; by all, then any, then the earlier position."""
    base = scores.where(F.col("variant") == baseline).select(F.col("any_rate").alias("b_any"), F.col("all_rate").alias("b_all"), F.lit(1).alias("one"))
    ok = scores.withColumn("one", F.lit(1)).join(base, "one").where((F.col("any_rate") >= F.col("b_any")) & (F.col("all_rate") >= F.col("b_all")))
    return ok.agg(F.max_by("variant", F.struct("all_rate", "any_rate", -F.col("position"))).alias("recommended"))


def valid_prediction(predicted: Column, known: list[str]) -> Column:
    """Whether a router's answer is a permutation of the known documents."""
    return F.coalesce(F.array_sort(predicted) == F.array(*map(F.lit, sorted(known))), F.lit(False))


def taxonomy(any_hit: Column, all_hit: Column, document_hit: Column, intrusion: Column) -> Column:
    """Overlapping labels of what went wrong."""
    return F.array_compact(F.array(
        F.when(~any_hit, "complete_miss"),
        F.when(any_hit & ~all_hit, "partial"),
        F.when(document_hit & ~any_hit, "right_document_wrong_source"),
        F.when(intrusion > 0.5, "intrusion"),
    ))


def excerpt_audit(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """gold(question_id, key, excerpt) and texts(key, text): whether each excerpt stands literally in its source; a source that isn't there is a problem too."""
    j = gold.join(texts, "key", "left")
    return j.select("question_id", "key", F.when(F.col("text").isNull(), "no_source").when(~F.col("text").contains(F.col("excerpt")), "not_literal").otherwise("ok").alias("audit"))


def copied_citations(labels: DataFrame, context: DataFrame) -> DataFrame:
    """labels(answer_id, labels) against context(answer_id, rank, chunk_id, ...): each cited block's own fields by position; a label without a block raises."""
    l = labels.select("answer_id", F.posexplode("labels").alias("position", "rank"))
    j = l.join(context, ["answer_id", "rank"], "left")
    return j.withColumn("chunk_id", F.when(F.col("chunk_id").isNull(), F.raise_error(F.concat(F.lit("no block for label "), F.col("rank").cast("string"))).cast("string")).otherwise(F.col("chunk_id").cast("string")))


def metadata(df: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """on, metadata: canonical JSON of the fields, absent ones (null or empty) left out."""
    clean = [F.when(F.size(F.col(f)) > 0, F.col(f)).alias(f) if dict(df.dtypes)[f].startswith("array") else F.col(f) for f in sorted(fields)]
    return df.select(on, F.to_json(F.struct(*clean)).alias("metadata"))


def dataset_problems(questions: DataFrame, evidence: DataFrame, texts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """questions(id, question, source_keys array), evidence(id, key, excerpt), texts(key, text) and maybe the ids that must be there (id) -> id, problem, what, a row a
    problem: missing_id, unexpected_id, repeated_id, repeated_question (white space and case aside), no_evidence (a source without excerpt), foreign_evidence (an excerpt of no
    source of the question), no_source, not_literal."""
    q = questions.select("id", "question", F.array_distinct("source_keys").alias("keys"))
    found = q.groupBy("id").count().where("count > 1").select("id", F.lit("repeated_id").alias("problem"), F.lit(None).cast("string").alias("what"))
    key = F.lower(F.regexp_replace(F.trim("question"), r"(?U)\s+", " "))
    twice = q.groupBy(key.alias("k")).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1).select(F.explode("ids").alias("id"), "k")
    found = found.union(twice.select("id", F.lit("repeated_question"), "k"))
    pairs, proof = q.select("id", F.explode("keys").alias("key")).distinct(), evidence.select("id", "key").distinct()
    found = found.union(pairs.join(proof, ["id", "key"], "left_anti").select("id", F.lit("no_evidence"), "key")).union(proof.join(pairs, ["id", "key"], "left_anti").select("id", F.lit("foreign_evidence"), "key"))
    literal = excerpt_audit(evidence.select(F.col("id").alias("question_id"), "key", "excerpt"), texts).where("audit <> 'ok'")
    found = found.union(literal.select(F.col("question_id").alias("id"), "audit", "key"))
    if ids is not None:
        found = found.union(ids.join(q, "id", "left_anti").select("id", F.lit("missing_id"), F.lit(None).cast("string"))).union(q.join(ids, "id", "left_anti").select("id", F.lit("unexpected_id"), F.lit(None).cast("string")))
    return found


def composition(questions: DataFrame, *fields: str) -> DataFrame:
    """field, value, questions: how many questions each value of the fields has; source_type (annex, article, mixed) and sources (their number) are made of source_keys."""
    from lexmill.operators.evaluation import question_type

    d = questions.withColumn("source_type", question_type(F.col("source_keys"))).withColumn("sources", F.size(F.array_distinct("source_keys")).cast("string"))
    names = (*fields, "source_type", "sources")
    one = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names))
    return d.select(F.explode(one).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("questions"))


def rank_hashes(ranks: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranks(query_id, rank, id, text_sha256) of a saved run against chunks(id, text) -> query_id, rank, id, state: same, changed, or gone (no such chunk)."""
    j = ranks.join(chunks.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("now")), "id", "left")
    return j.select("query_id", "rank", "id", F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("text_sha256"), "same").otherwise("changed").alias("state"))
