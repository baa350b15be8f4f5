"""Queries of reports over evaluated questions; catalogue.py takes them in.

Even labels are annexes, odd ones articles, of five documents; every third question has a second source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import audits, evaluation, reports
from lexmill.plans.catalogue import _COS, _ranked_sql, query, ranked, table

_KEY = "'d' || {0} % 5 || CASE WHEN {0} % 2 = 0 THEN '/annex/' ELSE '/normal/' END || {0}"


def _key(c):
    return F.concat(F.lit("d"), (c % 5).cast("string"), F.when(c % 2 == 0, "/annex/").otherwise("/normal/"), c.cast("string"))


def _slots(spark, sf, metric: str = "l2") -> tuple[DataFrame, DataFrame]:
    r = ranked(spark, sf, 5, metric)
    second = F.when(F.col("query_id") % 3 == 0, (F.col("gold") + 1) % 10).otherwise(F.col("gold"))
    g = r.select("query_id", F.explode(F.array_distinct(F.array(F.col("gold"), second))).alias("k")).distinct()
    return r.select("query_id", "rank", _key(F.col("label")).alias("key"), F.concat(F.lit("d"), (F.col("label") % 5).cast("string")).alias("document")), g.select("query_id", _key(F.col("k")).alias("key"), F.concat(F.lit("d"), (F.col("k") % 5).cast("string")).alias("document"))


def _scores_sql(prefix: str, d: str | None = None) -> str:
    r = _ranked_sql(5) if d is None else _ranked_sql(5, d=d)
    r = r.replace("p AS (", f"{prefix}p AS (", 1).replace("\nr AS (", f"\n{prefix}r AS (", 1).replace("FROM p QUALIFY", f"FROM {prefix}p QUALIFY")
    p = prefix
    return f"""{r}, {p}g AS (SELECT DISTINCT query_id, unnest(CASE WHEN query_id % 3 = 0 THEN [gold, (gold + 1) % 10] ELSE [gold] END) AS k FROM {p}r),
{p}f AS (SELECT g.query_id, g.k, min(r.rank) AS rank FROM {p}g g LEFT JOIN {p}r r ON r.query_id = g.query_id AND r.label = g.k GROUP BY ALL),
{p}w AS (SELECT r.query_id, count(*) AS slots, count(*) FILTER (r.label % 5 NOT IN (SELECT k % 5 FROM {p}g g WHERE g.query_id = r.query_id)) AS wrong_slots FROM {p}r r GROUP BY 1),
{p}s AS (SELECT f.query_id, CASE WHEN count(*) FILTER (k % 2 = 0) = count(*) THEN 'annex' WHEN count(*) FILTER (k % 2 = 0) > 0 THEN 'mixed' ELSE 'article' END AS type, coalesce(min(rank) <= 1, false) AS hit_1, coalesce(min(rank) <= 3, false) AS hit_3, coalesce(min(rank) <= 5, false) AS hit_5, min(rank) AS first_rank,
  CASE WHEN count(rank) = count(*) THEN max(rank) END AS all_by, coalesce(1.0 / min(rank), 0) AS reciprocal_rank, CAST(count(rank) AS DOUBLE) / count(*) AS recall, count(rank) = count(*) AS full_coverage, count(rank) AS found, count(*) AS n_keys FROM {p}f f GROUP BY 1),
{p}t AS (SELECT s.* EXCLUDE (found), CASE WHEN type = 'mixed' THEN found = 2 END AS both_sources, slots, wrong_slots FROM {p}s s JOIN {p}w w USING (query_id))"""


@query(f"WITH {_scores_sql('')} SELECT query_id, type, hit_1, hit_3, hit_5, first_rank, all_by, round(reciprocal_rank, 6) AS reciprocal_rank, round(recall, 6) AS recall, full_coverage, both_sources, slots, wrong_slots, round(CAST(wrong_slots AS DOUBLE) / slots, 6) AS wrong_fraction FROM t")
def four_source_scores(spark, sf):
    s = reports.question_scores(*_slots(spark, sf)).drop("source_ranks")
    return s.withColumns({c: F.round(c, 6) for c in ("reciprocal_rank", "recall", "wrong_fraction")} | {c: F.col(c).cast("long") for c in ("first_rank", "all_by")})


@query(f"""WITH {_scores_sql('')}, e AS (SELECT *, unnest(['overall', type]) AS grp FROM t), m AS (SELECT grp, count(*) AS questions, avg(hit_1::INT) AS hit_1, avg(hit_3::INT) AS hit_3, avg(hit_5::INT) AS hit_5, avg(recall) AS recall, avg(full_coverage::INT) AS full_coverage, avg(reciprocal_rank) AS mrr, CAST(sum(wrong_slots) AS BIGINT) AS wrong_slots, CAST(sum(slots) AS BIGINT) AS slots, count(*) FILTER (wrong_slots > 0) AS questions_with_wrong, CASE WHEN grp = 'mixed' THEN count(*) FILTER (both_sources) END AS both_sources FROM e GROUP BY grp)
SELECT x.grp AS "group", coalesce(questions, 0) AS questions, round(hit_1, 6) AS hit_1, round(hit_3, 6) AS hit_3, round(hit_5, 6) AS hit_5, round(recall, 6) AS recall, round(full_coverage, 6) AS full_coverage, round(mrr, 6) AS mrr, wrong_slots, slots, questions_with_wrong, both_sources, round(CAST(wrong_slots AS DOUBLE) / nullif(slots, 0), 6) AS wrong_fraction FROM (SELECT unnest(['overall', 'article', 'annex', 'mixed']) AS grp) x LEFT JOIN m USING (grp)""")
def four_source_summary(spark, sf):
    s = reports.by_type(reports.question_scores(*_slots(spark, sf)))
    return s.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in s.schema))


_BOTH = f"{_scores_sql('a_')}, {_scores_sql('b_', _COS)}"


@query(f"""WITH {_BOTH}, j AS (SELECT query_id, unnest(['hit_1', 'hit_3', 'hit_5', 'full_coverage']) AS flag, unnest([o.hit_1, o.hit_3, o.hit_5, o.full_coverage]) AS x, unnest([n.hit_1, n.hit_3, n.hit_5, n.full_coverage]) AS y FROM a_t o JOIN b_t n USING (query_id))
SELECT flag, count(*) AS questions, round(avg(x::INT), 6) AS before, round(avg(y::INT), 6) AS after, round((avg(y::INT) - avg(x::INT)) * 100, 4) AS delta_pp, coalesce(string_agg(CASE WHEN x AND NOT y THEN query_id::VARCHAR END, ',' ORDER BY query_id), '') AS lost, coalesce(string_agg(CASE WHEN y AND NOT x THEN query_id::VARCHAR END, ',' ORDER BY query_id), '') AS gained FROM j GROUP BY flag""")
def regression_report(spark, sf):
    old, new = (reports.question_scores(*_slots(spark, sf, m)) for m in ("l2", "cosine"))
    r = reports.before_after(old, new, ("hit_1", "hit_3", "hit_5", "full_coverage"))
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return r.select("flag", "questions", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("delta_pp", 4).alias("delta_pp"), ids("lost"), ids("gained"))


@query(f"""WITH {_BOTH}, j AS (SELECT o.type, CAST(o.first_rank AS DOUBLE) AS old, CAST(n.first_rank AS DOUBLE) AS new FROM a_t o JOIN b_t n USING (query_id))
SELECT type, count(new - old) AS n, round(avg(new - old), 6) AS mean, round(median(new - old), 6) AS median, count(*) FILTER (new < old) AS improved, count(*) FILTER (new = old) AS unchanged, count(*) FILTER (new > old) AS regressed FROM j GROUP BY type""")
def delta_summary(spark, sf):
    old, new = (reports.question_scores(*_slots(spark, sf, m)) for m in ("l2", "cosine"))
    j = old.select("query_id", "type", F.col("first_rank").cast("double").alias("old")).join(new.select("query_id", F.col("first_rank").cast("double").alias("new")), "query_id")
    d = reports.delta_summary(j, "type", better="lower")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


@query(f"""WITH {_scores_sql('')}, l AS (SELECT query_id, count(*) FILTER (label % 5 NOT IN (SELECT k % 5 FROM g WHERE g.query_id = r.query_id)) / CAST(count(*) AS DOUBLE) AS share, bool_or(rank = 1 AND label % 5 NOT IN (SELECT k % 5 FROM g WHERE g.query_id = r.query_id)) AS odd FROM r GROUP BY 1),
z AS (SELECT query_id, list_filter([CASE WHEN query_id % 100 = 0 THEN 'retrieval_error' END, CASE WHEN NOT hit_5 THEN 'expected_source_absent_from_top5' END, CASE WHEN NOT full_coverage AND n_keys > 1 THEN 'not_all_expected_sources_retrieved' END, CASE WHEN odd THEN 'top1_law_not_expected' END, CASE WHEN share >= 0.6 THEN 'high_non_expected_legislation_share' END], lambda x: x IS NOT NULL) AS reasons FROM t JOIN l USING (query_id))
SELECT query_id, array_to_string(reasons, ' | ') AS reasons FROM z WHERE len(reasons) > 0""")
def failure_cases(spark, sf):
    slots, gold = _slots(spark, sf)
    m = evaluation.law_metrics(slots.withColumnRenamed("document", "law"), gold.withColumnRenamed("document", "law"))
    m = m.join(gold.groupBy("query_id").agg(F.countDistinct("key").alias("n_keys")), "query_id").withColumn("error", F.when(F.col("query_id") % 100 == 0, "timeout"))
    return reports.failure_cases(m).select("query_id", F.array_join("reasons", " | ").alias("reasons"))


@query("""WITH e AS (SELECT event_type, event_id % 11 > 0 AS completed, event_id % 3 = 0 AS cited, event_id % 2 = 0 AS complete_, CASE WHEN event_id % 7 > 0 THEN CAST(floor(value * 10) AS BIGINT) END AS tokens, value FROM events)
SELECT event_type, count(*) AS questions, count(*) FILTER (completed) AS completed, count(*) FILTER (NOT completed) AS failed, round(count(*) FILTER (completed AND cited) / CAST(count(*) AS DOUBLE), 6) AS cited, round(count(*) FILTER (completed AND complete_) / CAST(count(*) AS DOUBLE), 6) AS complete, round(avg(CASE WHEN completed THEN value END), 4) AS latency_ms, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY 1""")
def answered_summary(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_type", (i % 11 > 0).alias("completed"), (i % 3 == 0).alias("cited"), (i % 2 == 0).alias("complete"), F.when(i % 7 > 0, F.floor(F.col("value") * 10).cast("long")).alias("tokens"), F.col("value").alias("latency_ms"))
    s = reports.answered_summary(e, ("cited", "complete"), ("tokens",), "event_type")
    return s.withColumns({c: F.round(c, 6) for c in ("cited", "complete")} | {"latency_ms": F.round("latency_ms", 4)})


@query("""WITH q AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 1 THEN 'Same  question' WHEN doc_id % 50 = 2 THEN ' same QUESTION' ELSE 'q ' || doc_id END AS question, text, doc_id % 4 AS m FROM documents WHERE text IS NOT NULL),
t AS (SELECT list(id ORDER BY id) AS ids FROM q WHERE id % 50 IN (1, 2))
SELECT unnest(ids)::VARCHAR AS id, 'repeated_question' AS problem, 'same question' AS what FROM t WHERE len(ids) > 1
UNION ALL SELECT id::VARCHAR, 'no_evidence', 'k' || id FROM q WHERE m = 1 UNION ALL SELECT id::VARCHAR, 'foreign_evidence', 'x' || id FROM q WHERE m = 1 UNION ALL SELECT id::VARCHAR, 'no_source', 'x' || id FROM q WHERE m = 1
UNION ALL SELECT id::VARCHAR, 'not_literal', 'k' || id FROM q WHERE m = 2 AND NOT contains(text, substr(text, 5, 30) || '#')
UNION ALL SELECT CAST(-1 AS VARCHAR), 'missing_id', NULL UNION ALL SELECT id::VARCHAR, 'unexpected_id', NULL FROM q WHERE m = 3""")
def dataset_problems(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").where("text is not null").withColumn("k", F.concat(F.lit("k"), i.cast("string")))
    q = d.select(i.alias("id"), F.when(i % 50 == 1, "Same  question").when(i % 50 == 2, " same QUESTION").otherwise(F.concat(F.lit("q "), i.cast("string"))).alias("question"), F.array("k").alias("source_keys"))
    cut = F.substring("text", 5, 30)
    e = d.select(i.alias("id"), F.when(i % 4 == 1, F.concat(F.lit("x"), i.cast("string"))).otherwise(F.col("k")).alias("key"), F.when(i % 4 == 2, F.concat(cut, F.lit("#"))).otherwise(cut).alias("excerpt"))
    ids = d.where("doc_id % 4 <> 3").select(i.alias("id")).union(spark.range(1).select(F.lit(-1).cast("long")))
    return audits.dataset_problems(q, e, d.select(F.col("k").alias("key"), "text"), ids).select(F.col("id").cast("string").alias("id"), "problem", "what")


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS questions FROM documents GROUP BY 2 UNION ALL SELECT 'source_type', CASE doc_id % 3 WHEN 0 THEN 'annex' WHEN 1 THEN 'mixed' ELSE 'article' END, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'sources', CASE WHEN doc_id % 3 = 1 THEN '2' ELSE '1' END, count(*) FROM documents GROUP BY 2""")
def dataset_composition(spark, sf):
    i = F.col("doc_id") % 3
    a, b = F.lit("d/annex/1"), F.lit("d/normal/2")
    return audits.composition(table(spark, sf, "documents").select("lang", F.when(i == 0, F.array(a, a)).when(i == 1, F.array(a, b)).otherwise(F.array(b)).alias("source_keys")), "lang")


@query(f"""WITH {_ranked_sql(5)} SELECT query_id, rank, id, CASE WHEN id % 13 = 0 THEN 'gone' WHEN id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM r""")
def rank_hashes(spark, sf):
    r = ranked(spark, sf, 5)
    text = F.concat(F.lit("text "), F.col("id").cast("string"))
    saved = r.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    now = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).where("id % 13 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.concat(text, F.lit("!"))).otherwise(text).alias("text"))
    return audits.rank_hashes(saved, now)
