"""Reports over evaluated questions: by type of source, before and after, failures to look at, rows for people to fill in.

A question is a row; slots and gold sources are rows (query_id, rank, key, document) and (query_id, key, document). Lists of ids in
reports are in order and as long as what they report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import evaluation, metrics

CUTOFFS, SLOTS = (1, 3, 5), 5
TYPES = ("overall", "article", "annex", "mixed")


def question_scores(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """A row a question of gold: type, hit_1, hit_3, hit_5, first_rank, all_by (the rank by which every source is found; null if one isn't), reciprocal_rank, recall,
    full_coverage, both_sources (of mixed questions: whether exactly two were found, else null), slots, wrong_slots (of documents that aren't expected), wrong_fraction
    (null without slots), source_ranks (key, rank or null). Over the first five slots; a key counts at its first. Ranks that aren't 1, 2, 3, ... raise.
    """
    r = evaluation.checked_ranks(ranking).where(F.col("rank") <= SLOTS)
    first = r.groupBy("query_id", "key").agg(F.min("rank").alias("first"))
    keys = gold.select("query_id", "key").distinct().join(first, ["query_id", "key"], "left")
    one = keys.groupBy("query_id").agg(F.min("first").alias("first_rank"), F.when(F.count("first") == F.count("*"), F.max("first")).alias("all_by"), F.count("first").alias("found"), F.count("*").alias("expected"), F.array_sort(F.collect_list(F.struct("key", F.col("first").alias("rank")))).alias("source_ranks"))
    ours = gold.select("query_id", "document").distinct().withColumn("ours", F.lit(True))
    slots = r.join(ours, ["query_id", "document"], "left").groupBy("query_id").agg(F.count("*").alias("slots"), F.count_if(F.col("ours").isNull()).alias("wrong_slots"))
    j = one.join(slots, "query_id", "left").fillna(0, ["slots", "wrong_slots"])
    kind = evaluation.question_type(F.transform("source_ranks", lambda x: x["key"].cast("string")))
    hits = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"hit_{k}") for k in CUTOFFS]
    return j.withColumn("type", kind).select(
        "query_id", "type", *hits, "first_rank", "all_by", F.coalesce(1 / F.col("first_rank").cast("double"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("found") / F.col("expected")).alias("recall"),
        (F.col("found") == F.col("expected")).alias("full_coverage"), F.when(F.col("type") == "mixed", F.col("found") == 2).alias("both_sources"), "slots", "wrong_slots",
        F.when(F.col("slots") > 0, F.col("wrong_slots") / F.col("slots")).alias("wrong_fraction"), "source_ranks",
    )


def by_type(scores: DataFrame) -> DataFrame:
    """question_scores()'s rows -> a row a group (overall and each type, those without questions too): questions, hits, recall, coverage and MRR as means, wrong and all slots and
    their quotient, questions with a wrong slot, and of mixed ones those with both sources."""
    rows = scores.withColumn("group", F.explode(F.array(F.lit("overall"), F.col("type"))))
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    made = rows.groupBy("group").agg(
        F.count("*").alias("questions"), *(mean(f"hit_{k}") for k in CUTOFFS), mean("recall"), mean("full_coverage"), F.avg("reciprocal_rank").alias("mrr"), F.sum("wrong_slots").alias("wrong_slots"), F.sum("slots").alias("slots"),
        F.count_if(F.col("wrong_slots") > 0).alias("questions_with_wrong"), F.when(F.first("group") == "mixed", F.count_if("both_sources")).alias("both_sources"),
    )
    every = scores.sparkSession.createDataFrame([(t,) for t in TYPES], "group string")
    out = every.join(made, "group", "left").fillna(0, ["questions"])
    return out.withColumn("wrong_fraction", F.col("wrong_slots") / F.nullif(F.col("slots"), F.lit(0)))


def before_after(old: DataFrame, new: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """old, new (query_id, flags...) of the same questions -> a row a flag: questions, before, after (rates), delta_pp, lost (ids that were hits), gained (ids that are now). Different or repeated questions raise."""
    side = lambda d, n: d.groupBy("query_id").agg(F.count("*").alias(f"n_{n}"), *(F.first(f).alias(f"{n}_{f}") for f in flags))
    j = side(old, "x").join(side(new, "y"), "query_id", "full_outer")
    same = F.coalesce((F.col("n_x") == 1) & (F.col("n_y") == 1), F.lit(False))
    j = j.withColumn("ok", F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not one question in both: "), F.col("query_id").cast("string"))).cast("boolean")))
    both = F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"x_{f}").alias("x"), F.col(f"y_{f}").alias("y")) for f in flags))
    long = j.where("ok").select("query_id", F.explode(both).alias("v")).select("query_id", "v.*")
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("query_id"))))
    g = long.groupBy("flag").agg(F.count("*").alias("questions"), metrics.rate(F.col("x")).alias("before"), metrics.rate(F.col("y")).alias("after"), ids(F.col("x") & ~F.col("y")).alias("lost"), ids(~F.col("x") & F.col("y")).alias("gained"))
    return g.select("flag", "questions", "before", "after", ((F.col("after") - F.col("before")) * 100).alias("delta_pp"), "lost", "gained")


def delta_summary(pairs: DataFrame, *by: str, better: str = "higher") -> DataFrame:
    """pairs(by..., old, new) -> by..., n, mean and median of new - old where both are known, improved, unchanged, regressed. better: higher, or lower as for ranks."""
    d = F.col("new") - F.col("old")
    up, down = (d > 0, d < 0) if better == "higher" else (d < 0, d > 0)
    return pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.count_if(up).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(down).alias("regressed"))


def failure_cases(results: DataFrame) -> DataFrame:
    """evaluation.law_metrics()'s rows with n_keys and maybe error -> query_id, reasons, of the questions that have any: the retrieval failed, no expected source among the
    first five, not all of several, a first slot of another law, or 60 % or more of the slots of other laws."""
    error = F.col("error").isNotNull() if "error" in results.columns else F.lit(False)
    why = {
        "retrieval_error": error,
        "expected_source_absent_from_top5": ~F.col("any_5"),
        "not_all_expected_sources_retrieved": ~F.col("all_5") & (F.col("n_keys") > 1),
        "top1_law_not_expected": F.coalesce(F.col("unexpected_top"), F.lit(False)),
        "high_non_expected_legislation_share": F.coalesce(F.col("share_5") >= 0.6, F.lit(False)),
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in why.items())))
    return results.select("query_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def answered_summary(rows: DataFrame, flags: tuple[str, ...], tokens: tuple[str, ...], *by: str) -> DataFrame:
    """rows(by..., completed, flags..., tokens..., latency_ms) -> by..., questions, completed, failed, each flag's completed hits over all questions, mean latency of completed ones, sums of
    known tokens (null if none is known: unlike metrics.sum_or_null, unknown ones count as nothing)."""
    done = F.coalesce(F.col("completed"), F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("questions"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), *((F.count_if(done & F.col(f)) / F.count("*")).alias(f) for f in flags), F.avg(F.when(done, F.col("latency_ms"))).alias("latency_ms"), *(F.sum(t).alias(t) for t in tokens))


def phrase_rates(docs: DataFrame, tokens: Column, first: str, second: str, *by: str) -> DataFrame:
    """How often two tokens stand side by side: by..., hits, documents with any, per_10k tokens."""
    d = docs.select(*by, tokens.alias("t")).withColumn("n", F.size("t"))
    pairs = F.zip_with("t", F.slice("t", F.lit(2), F.greatest(F.col("n"), F.lit(1))), lambda a, b: (a == first) & F.coalesce(b == second, F.lit(False)))
    c = d.withColumn("hits", F.size(F.filter(pairs, lambda x: x)).cast("long"))
    return c.groupBy(*by).agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("documents"), (10000.0 * F.sum("hits") / F.sum("n")).alias("per_10k"))


def review_rows(rows: DataFrame, rubric: tuple[str, ...], **fixed: str) -> DataFrame:
    """rows with columns for people to fill in: `fixed` ones with their value, those of the rubric empty."""
    return rows.withColumns({n: F.lit(v) for n, v in fixed.items()} | {n: F.lit("") for n in rubric})
