"""Queries of the evaluation, identity, answering and annex operators, with the SQL that must agree; catalogue.py takes them in.

Laws are labels modulo five, source keys are labels, datasets are the questions' ids modulo two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import annex, answering, audits, chunking, evaluation, identity, parsing, retrieval
from lexmill.sources import office, questions
from lexmill.sources.files import scratch
from lexmill.plans.catalogue import _COS, _METRICS, _gold, _ranked_sql, _scored, query, ranked, table, vectors

_LAW_SLOTS = """s AS (SELECT query_id, rank, id, CAST(label AS VARCHAR) AS key, CASE WHEN label = 9 THEN NULL ELSE CAST(label % 5 AS VARCHAR) END AS law, gold FROM r),
g AS (SELECT DISTINCT query_id, unnest([CAST(gold AS VARCHAR), CASE WHEN query_id % 3 = 0 THEN CAST((gold + 1) % 10 AS VARCHAR) ELSE CAST(gold AS VARCHAR) END]) AS key, unnest([CAST(gold % 5 AS VARCHAR), CASE WHEN query_id % 3 = 0 THEN CAST((gold + 1) % 5 AS VARCHAR) ELSE CAST(gold % 5 AS VARCHAR) END]) AS law FROM s)"""


def _law_metrics_sql(name: str, slots: str, gold: str = "g") -> str:
    flags = ", ".join(f"bool_or(rank <= {k} AND key IN (SELECT key FROM {gold} WHERE {gold}.query_id = x.query_id)) AS any_{k}, count(DISTINCT CASE WHEN rank <= {k} AND key IN (SELECT key FROM {gold} WHERE {gold}.query_id = x.query_id) THEN key END) = (SELECT count(DISTINCT key) FROM {gold} WHERE {gold}.query_id = x.query_id) AS all_{k}, coalesce(bool_or(rank <= {k} AND law IN (SELECT law FROM {gold} WHERE {gold}.query_id = x.query_id)), false) AS law_{k}" for k in (1, 3, 5))
    return f"""{name} AS (SELECT query_id, {flags}, round(CAST(count(CASE WHEN law IS NOT NULL AND law NOT IN (SELECT law FROM {gold} WHERE {gold}.query_id = x.query_id) THEN 1 END) AS DOUBLE) / nullif(count(law), 0), 6) AS share_5,
  max(CASE WHEN rank = 1 THEN law END) AS top_law, max(CASE WHEN rank = 1 THEN law END) NOT IN (SELECT law FROM {gold} WHERE {gold}.query_id = x.query_id) AS unexpected_top FROM {slots} x WHERE rank <= 5 GROUP BY query_id)"""


def _slots(r: DataFrame) -> DataFrame:
    return r.select("query_id", "rank", "id", F.col("label").cast("string").alias("key"), F.when(F.col("label") != 9, (F.col("label") % 5).cast("string")).alias("law"), "gold")


def _law_gold(r: DataFrame) -> DataFrame:
    second = F.when(F.col("query_id") % 3 == 0, (F.col("gold") + 1) % 10).otherwise(F.col("gold"))
    g = r.select("query_id", F.explode(F.array_distinct(F.array(F.col("gold"), second))).alias("k")).distinct()
    return g.select("query_id", F.col("k").cast("string").alias("key"), (F.col("k") % 5).cast("string").alias("law"))


def _laws(spark, sf, metric: str = "l2") -> tuple[DataFrame, DataFrame, DataFrame]:
    r = ranked(spark, sf, 5, metric)
    slots, gold = _slots(evaluation.checked_ranks(r)), _law_gold(ranked(spark, sf, 5))
    return evaluation.law_metrics(slots, gold), slots, gold


@query(f"WITH {_ranked_sql(5)}, {_LAW_SLOTS}, {_law_metrics_sql('m', 's')} SELECT * FROM m")
def law_metrics(spark, sf):
    return _laws(spark, sf)[0].withColumn("share_5", F.round("share_5", 6))


_RATES = ", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in evaluation.RATES) + ", count(CASE WHEN unexpected_top THEN 1 END) AS unexpected_tops, round(count(CASE WHEN unexpected_top THEN 1 END)::DOUBLE / nullif(count(top_law), 0), 6) AS unexpected_top_rate, round(avg(share_5), 4) AS mean_share_5"


@query(f"WITH {_ranked_sql(5)}, {_LAW_SLOTS}, {_law_metrics_sql('m', 's')} SELECT CASE query_id % 60 WHEN 0 THEN 'a' WHEN 20 THEN 'b' END AS case_type, count(*) AS questions, {_RATES} FROM m WHERE query_id % 60 <> 40 GROUP BY 1")
def grouped_rates(spark, sf):
    m = _laws(spark, sf)[0].withColumn("case_type", F.when(F.col("query_id") % 60 == 0, "a").when(F.col("query_id") % 60 == 20, "b"))
    out = evaluation.rates(m, "case_type")
    return out.select("case_type", "questions", *(F.round(c, 6).alias(c) for c in evaluation.RATES), "unexpected_tops", F.round("unexpected_top_rate", 6).alias("unexpected_top_rate"), F.round("mean_share_5", 4).alias("mean_share_5"))


@query(_METRICS + """, gg AS (SELECT query_id, count(DISTINCT key) AS nk, list(DISTINCT key % 5) AS docs FROM (SELECT DISTINCT query_id, unnest([gold, (gold + 1) % 10]) AS key FROM r) GROUP BY 1),
z AS (SELECT * FROM a JOIN d USING (query_id, k) LEFT JOIN i USING (query_id, k) JOIN gg USING (query_id)),
e AS (SELECT 'overall' AS grp, * FROM z UNION ALL SELECT CASE WHEN nk = 1 THEN 'single_source' ELSE 'multi_source' END, * FROM z UNION ALL SELECT CASE WHEN len(docs) = 1 THEN 'single_document' ELSE 'multi_document' END, * FROM z UNION ALL SELECT 'document:' || u, z.* FROM z, unnest(docs) t(u)),
f AS (SELECT grp, k, count(*) AS questions, round(avg(source_any::INT), 6) AS source_any, round(avg(source_all::INT), 6) AS source_all, round(avg(document_hit::INT), 6) AS document_hit, round(avg(document_all::INT), 6) AS document_all, round(avg(intrusion), 6) AS intrusion, count(intrusion) AS defined, count(*) - count(intrusion) AS undefined FROM e GROUP BY ALL)
SELECT coalesce(f.grp, x.grp) AS "group", coalesce(f.k, x.k) AS k, coalesce(questions, 0) AS questions, source_any, source_all, document_hit, document_all, intrusion, coalesce(defined, 0) AS defined, coalesce(undefined, 0) AS undefined
FROM f FULL JOIN (SELECT unnest(['overall', 'single_source', 'multi_source', 'single_document', 'multi_document']) AS grp, k FROM (SELECT unnest([1, 3, 5]) AS k)) x ON x.grp = f.grp AND x.k = f.k""")
def document_summary(spark, sf):
    r = ranked(spark, sf, 5)
    out = evaluation.document_summary(_scored(spark, sf), _gold(r))
    return out.select("group", "k", "questions", *(F.round(c, 6).alias(c) for c in ("source_any", "source_all", "document_hit", "document_all", "intrusion")), "defined", "undefined")


_TWO = f"""WITH {_ranked_sql(5)}, {_LAW_SLOTS}, {_ranked_sql(5, "", _COS).replace("p AS (", "p2 AS (").replace("r AS (", "r2 AS (").replace("FROM p QUALIFY", "FROM p2 QUALIFY")},
s2 AS (SELECT query_id, rank, id, CAST(label AS VARCHAR) AS key, CASE WHEN label = 9 THEN NULL ELSE CAST(label % 5 AS VARCHAR) END AS law FROM r2),
{_law_metrics_sql("m", "s")}, {_law_metrics_sql("n", "s2")}"""


@query(_TWO + """, q AS (SELECT query_id, CASE WHEN query_id % 40 = 0 THEN 'x' ELSE 'y' END AS ds, (SELECT count(DISTINCT key) FROM g WHERE g.query_id = m.query_id) AS nk FROM m),
c AS (SELECT count(CASE WHEN ds = 'x' AND n.any_5 THEN 1 END) - count(CASE WHEN ds = 'x' AND m.any_5 THEN 1 END) AS a1, count(CASE WHEN ds = 'x' AND n.all_5 THEN 1 END) - count(CASE WHEN ds = 'x' AND m.all_5 THEN 1 END) AS a2,
 count(CASE WHEN ds = 'y' AND n.any_5 THEN 1 END) - count(CASE WHEN ds = 'y' AND m.any_5 THEN 1 END) AS b1, count(CASE WHEN ds = 'y' AND n.all_5 THEN 1 END) - count(CASE WHEN ds = 'y' AND m.all_5 THEN 1 END) AS b2,
 count(CASE WHEN n.all_5 THEN 1 END) - count(CASE WHEN m.all_5 THEN 1 END) AS c1, count(CASE WHEN n.law_1 THEN 1 END) - count(CASE WHEN m.law_1 THEN 1 END) AS d1, count(CASE WHEN nk > 1 AND n.all_5 THEN 1 END) - count(CASE WHEN nk > 1 AND m.all_5 THEN 1 END) AS e1 FROM q JOIN m USING (query_id) JOIN n USING (query_id)),
h AS (SELECT 'A' AS gate, a1 >= 0 AND a2 >= 0 AS holds FROM c UNION ALL SELECT 'B', (b1 > 0 OR b2 > 0) AND b1 >= -1 AND b2 >= -1 FROM c UNION ALL SELECT 'C', c1 >= 0 FROM c UNION ALL SELECT 'D', d1 >= -1 FROM c UNION ALL SELECT 'E', e1 >= 0 FROM c UNION ALL SELECT 'F', true)
SELECT * FROM h UNION ALL SELECT 'VALIDATED', bool_and(holds) FROM h""")
def holdout_gates(spark, sf):
    old, _, gold = _laws(spark, sf)
    new, _, _ = _laws(spark, sf, "cosine")
    n = gold.groupBy("query_id").agg(F.countDistinct("key").alias("n_keys"), F.max(F.when(F.col("query_id") % 40 == 0, "x").otherwise("y")).alias("dataset"))
    return evaluation.gates(old.join(n, "query_id"), new.join(n, "query_id"), "x", "y")


@query(_TWO + """, o AS (SELECT query_id, list(id ORDER BY rank) AS ids FROM s GROUP BY 1), w AS (SELECT query_id, list(id ORDER BY rank) AS ids FROM s2 GROUP BY 1),
cov AS (SELECT g.query_id, g.key, k, EXISTS (SELECT 1 FROM s WHERE s.query_id = g.query_id AND s.key = g.key AND s.rank <= k) AS o, EXISTS (SELECT 1 FROM s2 WHERE s2.query_id = g.query_id AND s2.key = g.key AND s2.rank <= k) AS n FROM (SELECT DISTINCT query_id, key FROM g) g, (SELECT unnest([1, 3, 5]) AS k)),
cc AS (SELECT query_id, bool_or(n AND NOT o) AS rec, bool_or(o AND NOT n) AS dis, bool_and(o OR k <> 5) AS ofull, bool_and(n OR k <> 5) AS nfull, count(DISTINCT key) AS nk FROM cov GROUP BY 1),
x AS (SELECT s2.query_id, bool_or(s2.id NOT IN (SELECT id FROM s WHERE s.query_id = s2.query_id) AND s2.law IS NOT NULL AND s2.law NOT IN (SELECT law FROM g WHERE g.query_id = s2.query_id)) AS odd FROM s2 GROUP BY 1),
l AS (SELECT cc.query_id, list_filter([CASE WHEN rec THEN 'HYBRID RECOVERY' END, CASE WHEN dis THEN 'DENSE EVIDENCE DISPLACEMENT' END, CASE WHEN nk > 1 AND ofull AND NOT nfull THEN 'MULTI-SOURCE COMPLETENESS LOSS' END, CASE WHEN nk > 1 AND nfull AND NOT ofull THEN 'MULTI-SOURCE COMPLETENESS GAIN' END, CASE WHEN odd THEN 'CROSS-LAW INTRUSION' END], lambda t: t IS NOT NULL) AS f, o.ids <> w.ids AS moved FROM cc JOIN x USING (query_id) JOIN o USING (query_id) JOIN w USING (query_id))
SELECT query_id, array_to_string(CASE WHEN len(f) = 0 AND moved THEN ['BENIGN REORDERING'] ELSE f END, '; ') AS labels FROM l""")
def ranking_changes(spark, sf):
    _, old, gold = _laws(spark, sf)
    _, new, _ = _laws(spark, sf, "cosine")
    return evaluation.changes(old, new, gold).select("query_id", F.array_join("labels", "; ").alias("labels"))


@query(_TWO + """, t AS (SELECT query_id, CASE WHEN query_id % 40 = 0 THEN 'x' ELSE 'y' END AS ds, (SELECT count(DISTINCT key) FROM g WHERE g.query_id = m.query_id) AS nk FROM m),
v AS (SELECT 'B0' AS st, 0 AS pos, m.* FROM m UNION ALL SELECT 'B1', 1, n.* FROM n UNION ALL SELECT 'B2', 2, query_id, any_1, any_3, true, all_1, all_3, true, true, law_3, law_5, share_5, top_law, unexpected_top FROM m),
""" + """u AS (SELECT st, pos, sc, avg(any_5::INT) AS any_5, avg(all_5::INT) AS all_5, avg(law_1::INT) AS law_1 FROM (SELECT v.st, v.pos, v.query_id, v.any_5, v.all_5, v.law_1, unnest([ds, 'combined', CASE WHEN ds = 'y' AND nk > 1 THEN 'multi_part' END, CASE WHEN ds = 'y' AND nk = 1 THEN 'single_source' END]) AS sc FROM (SELECT st, pos, query_id, any_5, all_5, law_1 FROM (SELECT 'B0' AS st, 0 AS pos, query_id, any_5, all_5, law_1 FROM m UNION ALL SELECT 'B1', 1, query_id, any_5, all_5, law_1 FROM n UNION ALL SELECT 'B2', 2, query_id, true, true, true FROM m)) v JOIN t USING (query_id)) WHERE sc IS NOT NULL GROUP BY ALL),
j AS (SELECT s.*, b.any_5 AS ba, b.all_5 AS bl, b.law_1 AS b1 FROM u s JOIN u b ON b.sc = s.sc AND b.st = 'B0' WHERE s.st <> 'B0'),
k AS (SELECT st, pos, count(CASE WHEN (sc = 'x' AND any_5 >= ba AND all_5 >= bl) OR (sc = 'y' AND any_5 > ba AND all_5 > bl) OR (sc = 'combined' AND law_1 >= b1) OR (sc = 'multi_part' AND all_5 > bl) OR (sc = 'single_source' AND any_5 >= ba) THEN 1 END) = 5 AS eligible, max(CASE WHEN sc = 'y' THEN all_5 END) AS al, max(CASE WHEN sc = 'y' THEN any_5 END) AS an FROM j GROUP BY ALL)
SELECT st AS strategy, eligible, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY al DESC, an DESC, pos) = 1 AS recommended FROM k""".replace("v AS (SELECT 'B0' AS st, 0 AS pos, m.* ", "v AS (SELECT 'B0' AS st, 0 AS pos, m.* "))
def strategy_recommendation(spark, sf):
    old, _, gold = _laws(spark, sf)
    new, _, _ = _laws(spark, sf, "cosine")
    n = gold.groupBy("query_id").agg(F.countDistinct("key").alias("nk"))
    cols = ["query_id", "any_5", "all_5", "law_1"]
    rows = old.select(*cols, F.lit("B0").alias("strategy"), F.lit(0).alias("position"))
    rows = rows.union(new.select(*cols, F.lit("B1"), F.lit(1))).union(old.select("query_id", *(F.lit(True) for _ in range(3)), F.lit("B2"), F.lit(2)))
    ds = F.when(F.col("query_id") % 40 == 0, "x").otherwise("y")
    scopes = F.array_compact(F.array(ds, F.lit("combined"), F.when((ds == "y") & (F.col("nk") > 1), "multi_part"), F.when((ds == "y") & (F.col("nk") == 1), "single_source")))
    s = rows.join(n, "query_id").withColumn("scope", F.explode(scopes)).groupBy("strategy", "position", "scope").agg(*(evaluation.share(F.col(c)).alias(c) for c in cols[1:]))
    return evaluation.recommend(s, "B0", "x", "y")


def _routes(spark, sf, step: int) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("gold"), "n_chars")
    langs = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    first = langs[((F.col("n_chars") + step) % 4).cast("int")]
    p = F.when(F.col("n_chars") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(first, langs[((F.col("n_chars") / 4).cast("long") % 4).cast("int")]))
    return d.select("query_id", "gold", p.alias("prediction"), (F.col("query_id") % 2).alias("half"))


def _routes_sql(name: str, step: int) -> str:
    return f"{name} AS (SELECT doc_id AS query_id, lang AS gold, CASE WHEN n_chars % 11 = 0 THEN [] ELSE [['de','en','es','fr'][1 + (n_chars + {step}) % 4], ['de','en','es','fr'][1 + (n_chars // 4) % 4]] END AS prediction, doc_id % 2 AS half FROM documents)"


@query(f"""WITH {_routes_sql("p", 0)} SELECT half, count(*) AS questions, count(CASE WHEN len(prediction) > 0 THEN 1 END) AS valid, count(CASE WHEN prediction[1] = gold THEN 1 END) AS top1, count(CASE WHEN list_contains(prediction, gold) THEN 1 END) AS top2,
round(count(CASE WHEN prediction[1] = gold THEN 1 END) / count(*), 6) AS top1_accuracy, round(count(CASE WHEN list_contains(prediction, gold) THEN 1 END) / count(*), 6) AS top2_accuracy, count(CASE WHEN len(prediction) = 0 THEN 1 END) AS failures FROM p GROUP BY half""")
def router_accuracy(spark, sf):
    out = evaluation.route_accuracy(_routes(spark, sf, 0), "half")
    return out.withColumns({c: F.round(c, 6) for c in ("top1_accuracy", "top2_accuracy")})


@query(f"""WITH {_routes_sql("p", 0)}, n AS (SELECT gold, prediction[1] AS predicted, count(*) AS n FROM p WHERE len(prediction) > 0 GROUP BY ALL)
SELECT a.x AS gold, b.x AS predicted, coalesce(n, 0) AS n FROM (SELECT unnest(['de','en','es','fr']) AS x) a CROSS JOIN (SELECT unnest(['de','en','es','fr']) AS x) b LEFT JOIN n ON n.gold = a.x AND n.predicted = b.x""")
def router_confusion(spark, sf):
    return evaluation.routing_confusion(_routes(spark, sf, 0), ["de", "en", "es", "fr"])


@query(f"""WITH {_routes_sql("p", 0)}, {_routes_sql("q", 1)}, h AS (SELECT p.query_id, coalesce(list_contains(p.prediction[1:1], p.gold), false) AS x, coalesce(list_contains(q.prediction[1:1], q.gold), false) AS y FROM p JOIN q USING (query_id))
SELECT CASE WHEN x AND y THEN 'both_correct' WHEN x THEN 'first_only' WHEN y THEN 'second_only' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM h GROUP BY 1""")
def routers_compared(spark, sf):
    return evaluation.routers_compared(_routes(spark, sf, 0), _routes(spark, sf, 1), 1).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT vec_id, list_filter([CASE WHEN g IS NULL AND o1 <= 10 THEN 'document_competition' END, CASE WHEN o1 > 10 THEN 'within_document_difficulty' END, CASE WHEN o2 IS NOT NULL AND (g IS NULL OR o2 < g) THEN 'enriched_global_improves' END, CASE WHEN o3 < o1 THEN 'enrichment_improves_within' END, CASE WHEN o3 > o1 THEN 'enrichment_worsens_within' END, CASE WHEN o1 > 20 AND o3 > 20 THEN 'persistent_poor_rank' END], lambda t: t IS NOT NULL)::VARCHAR AS labels
FROM (SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN vec_id % 50 END AS g, vec_id % 37 AS o1, CASE WHEN vec_id % 7 > 0 THEN vec_id % 29 END AS o2, vec_id % 31 AS o3 FROM embeddings)""")
def oracle_rank_labels(spark, sf):
    v = F.col("vec_id")
    x = evaluation.oracle_labels(F.when(v % 4 > 0, v % 50), v % 37, F.when(v % 7 > 0, v % 29), v % 31)
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]")).alias("labels"))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.vec_id % 40 AS key, {_COS} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank, count(*) OVER (PARTITION BY query_id) AS candidates FROM p), g AS (SELECT vec_id AS query_id, (vec_id + 1) % 40 AS key FROM embeddings WHERE vec_id % 20 = 0)
SELECT g.query_id, g.key, CAST(min(rank) AS BIGINT) AS rank, max(candidates) AS candidates FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.key = g.key GROUP BY ALL""")
def source_ranks(spark, sf):
    q, c = vectors(spark, sf)
    asked = q.join(c.select(F.col("id").alias("query_id"), F.col("label").cast("long").alias("document")), "query_id")
    rows = c.select("id", "v", F.col("label").cast("long").alias("document"), (F.col("id") % 40).alias("key"))
    return retrieval.exact_ranks(asked, rows, asked.select("query_id", ((F.col("query_id") + 1) % 40).alias("key")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'annex' WHEN doc_id % 5 = 1 THEN 'mixed' ELSE 'article' END AS type, doc_id % 5 IN (1, 2) AS multi,
 CASE WHEN n_chars % 2 = 0 OR n_chars % 3 = 0 THEN true WHEN n_chars % 5 = 0 THEN true ELSE doc_id % 5 IN (1, 2) AND n_chars % 7 > 0 END AS review FROM documents""")
def question_types(spark, sf):
    i, n = F.col("doc_id") % 5, F.col("n_chars")
    a, b = F.lit("d/annex/1"), F.lit("d/normal/2")
    keys = F.when(i == 0, F.array(a)).when(i == 1, F.array(a, b)).when(i == 2, F.array(b, F.lit("d/normal/3"))).otherwise(F.array(b, b))
    multi = evaluation.is_multi_source(keys)
    review = evaluation.needs_review(F.when(n % 2 == 0, "YETERSIZ").otherwise("YETERLI"), n % 3 == 0, n % 5 > 0, multi, n % 7 == 0)
    return table(spark, sf, "documents").select("doc_id", evaluation.question_type(keys).alias("type"), multi.alias("multi"), review.alias("review"))


@query("""SELECT vec_id, '5326_kabahatler/normal/' || vec_id AS source_key FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, '4458_gumruk/ek/' || vec_id FROM embeddings WHERE vec_id % 2 = 1""")
def legacy_keys(spark, sf):
    reg = identity.legacy_registry(spark.createDataFrame([("5326", "5326_kabahatler"), ("4458", "4458_gumruk"), ("5326", "5326_kabahatler")], "number string, document_id string"))
    even = F.col("vec_id") % 2 == 0
    k = table(spark, sf, "embeddings").select("vec_id", F.when(even, "5326").otherwise("4458").alias("number"), F.when(even, "normal").otherwise("ek").alias("article_type"), F.col("vec_id").cast("string").alias("article_no"))
    return identity.to_source_keys(k, reg).select("vec_id", "source_key")


@query(f"WITH {_ranked_sql(5)} SELECT query_id, rank, id, label FROM r")
def ranks_to_chunks(spark, sf):
    h = ranked(spark, sf, 5).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return identity.ranks_to_chunks(h, vectors(spark, sf)[1].select("id", F.col("label").cast("long").alias("label"))).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "label")


@query("SELECT doc_id, quality IS NOT NULL AS resolved FROM documents LEFT JOIN labels USING (doc_id)")
def references_resolved(spark, sf):
    return identity.references(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'only_source' WHEN vec_id % 7 = 0 THEN 'fields' WHEN vec_id % 5 = 0 THEN 'vector' ELSE 'same' END AS state FROM embeddings UNION ALL SELECT -1 - vec_id, 'only_copy' FROM embeddings WHERE vec_id % 13 = 0")
def replica_compared(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    v = F.col("vec_id")
    moved = F.transform("embedding", lambda x, i: x + F.when((i == 0) & (v % 5 == 0), 0.01).otherwise(0.00001).cast("float"))
    copy = e.where(v % 11 != 0).select("vec_id", moved.alias("embedding"), F.when(v % 7 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("label"))
    extra = e.where(v % 13 == 0).select((-1 - v).alias("vec_id"), "embedding", "label")
    return identity.replica(e, copy.union(extra), "vec_id", "embedding")


@query("SELECT CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'same' END AS state FROM pages UNION ALL SELECT 'new' || page_id, 'extra' FROM pages WHERE page_id % 4 = 0")
def copy_verified(spark, sf):
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    files = lambda d, name, content: identity.file_hashes(d.select(F.concat(F.lit("file:/a/"), name).alias("path"), F.octet_length(content).cast("long").alias("length"), content.cast("binary").alias("content")))
    html = F.coalesce("html", F.lit(""))
    copy = files(p.where(i % 5 != 0), i.cast("string"), F.when(i % 3 == 0, F.concat(html, F.lit("x"))).otherwise(html)).union(files(p.where(i % 4 == 0), F.concat(F.lit("new"), i.cast("string")), html))
    return identity.verified_copy(files(p, i.cast("string"), html), copy)


@query("SELECT DISTINCT user_id AS batch FROM events WHERE user_id % 3 <> 0")
def batches_pending(spark, sf):
    b = table(spark, sf, "events").select(F.col("user_id").alias("batch")).distinct()
    return identity.pending_batches(b, b.where("batch % 3 = 0"), b.where("batch % 6 = 0"))


@query("""SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'encoding' END, CASE WHEN coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') = '' AND doc_id % 9 <> 0 THEN 'blank_question' END, CASE WHEN doc_id % 4 = 0 THEN 'blank_notes' END, CASE WHEN doc_id % 5 = 0 THEN 'no_sources' END, CASE WHEN doc_id % 5 = 1 THEN 'repeated_source' END], lambda t: t IS NOT NULL), ',') AS problems FROM (SELECT doc_id, replace(replace(replace(text, chr(65533), ''), 'Ã', ''), 'Å', '') AS text FROM documents)""")
def candidate_problems(spark, sf):
    i = F.col("doc_id")
    clean = F.translate("text", "�ÃÅ", "")
    keys = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    q = table(spark, sf, "documents").select(i.alias("id"), F.when(i % 9 == 0, F.concat(F.coalesce(clean, F.lit("")), F.lit("x�"))).otherwise(clean).alias("question"), F.when(i % 4 == 0, " ").otherwise("n").alias("notes"), keys.alias("source_keys"))
    return identity.candidate_problems(q).select("id", F.array_join("problems", ",").alias("problems"))


@query("""WITH l AS (SELECT doc_id, coalesce(text, '') AS text, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
SELECT count(*) AS articles, CAST(sum(n) - count(CASE WHEN doc_id % 10 = 3 THEN 1 END) AS BIGINT) AS chunks, true AS unique_ids, CAST(count(CASE WHEN doc_id % 10 = 3 THEN 1 END) AS BIGINT) AS not_rebuilt, 0 AS orphans FROM l""")
def reconstruction_audit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    a = d.select(F.col("doc_id").alias("article_id"), "text")
    c = a.select("article_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).where("article_id % 10 <> 3 or at > 0")
    out = identity.reconstruction(a, c.select("article_id", F.format_string("%08d", "at").alias("chunk_id"), "text"))
    return out.select("articles", "chunks", "unique_ids", "not_rebuilt", F.col("orphans").cast("int").alias("orphans"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Başlık — Madde ' || doc_id WHEN 1 THEN '5326 sayılı Kanun, Geçici Madde ' || doc_id WHEN 2 THEN 'Başlık — EK-7/A' WHEN 3 THEN '[KAYNAK 3]' WHEN 4 THEN 'Ek Madde ' || doc_id ELSE '5326 sayılı Kanun' END AS citation,
CASE doc_id % 6 WHEN 2 THEN 'EK-7/A' WHEN 3 THEN 'EK-?' WHEN 5 THEN 'Madde ?' ELSE 'Madde ' || doc_id END AS label, CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE printf('%.1f%%', doc_id % 8 * 12.5) END AS rate FROM documents""")
def citation_display(spark, sf):
    i = F.col("doc_id")
    k = i % 6
    pick = lambda **by: F.element_at(F.create_map(*(x for n, v in by.items() for x in (F.lit(int(n[1:])), F.lit(v)))), k.cast("int"))
    title, law = F.when(k.isin(0, 2), "Başlık"), F.when(k.isin(0, 1, 5), "5326")
    kind = F.when(k == 0, "normal").when(k == 1, "gecici").when(k == 4, "ek")
    number = F.when(k.isin(0, 1, 4), i.cast("string"))
    made = T.citation(title, law, kind, number, F.when(k == 2, "EK-7/A"), F.lit("KAYNAK 3"))
    shown = T.display_label(F.when(k.isin(2, 3), "annex"), number, F.when(k == 2, "7").otherwise("0"), F.when(k == 2, "A"))
    return table(spark, sf, "documents").select("doc_id", made.alias("citation"), shown.alias("label"), T.percent(F.when(i % 3 != 0, (i % 8) / 8.0)).alias("rate"))


@query("""SELECT doc_id, md5('T' || chr(10) || 'EK-' || doc_id || chr(10) || chr(10) || coalesce(text, '')) AS annex_input, md5('T' || chr(10) || chr(10) || lang) AS enriched, md5(CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) ELSE '' END || source || chr(10) || coalesce(text, '')) AS lexical FROM documents""")
def search_inputs(spark, sf):
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    h = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf, "documents").select("doc_id", h(T.annex_text(F.lit("T"), F.concat(F.lit("EK-"), i.cast("string")), text)).alias("annex_input"), h(T.enriched_question(F.lit("T"), "lang")).alias("enriched"), h(T.lexical_text(F.when(i % 2 == 0, F.col("lang")), "source", text)).alias("lexical"))


@query(f"""WITH {_ranked_sql(3)}, c AS (SELECT query_id, list(id ORDER BY rank) AS ids, bool_or(label = query_id % 10) AS hit FROM r WHERE query_id % 100 <> 0 GROUP BY 1), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0)
SELECT q.query_id, coalesce(len(ids), 0) AS n, CASE WHEN ids IS NULL THEN '{answering.INSUFFICIENT}' ELSE 'label ' || q.query_id % 10 || ' [KAYNAK 1]' END AS answer, NOT coalesce(hit, false) AS insufficient, ids[1] AS cited FROM q LEFT JOIN c USING (query_id)""")
def answers_checked(spark, sf):
    r = ranked(spark, sf, 3)
    questions = r.select("query_id").distinct().withColumn("question", F.concat(F.lit("label "), (F.col("query_id") % 10).cast("string")))
    chunks = vectors(spark, sf)[1].select("id", F.concat(F.lit("Label "), F.col("label").cast("string")).alias("text"))
    out = answering.answer_questions(questions, r.where("query_id % 100 <> 0").select("query_id", "rank", "id", "distance"), chunks, 3)
    return out.select("query_id", F.size("results").cast("long").alias("n"), "answer", "insufficient", F.get("citations", F.lit(0))["id"].alias("cited"))


@query("""SELECT turn % 3 AS kind, count(*) AS n, count(CASE WHEN turn % 3 = 1 THEN 1 END) AS errors FROM conversations GROUP BY 1""")
def chat_messages(spark, sf):
    t = F.col("turn") % 3
    m = answering.chat(F.lit("q"), F.col("text"), F.array(F.lit("a")), t == 2, t == 1)
    d = table(spark, sf, "conversations").select(t.alias("kind"), m.alias("m"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if((F.col("m")[1]["kind"] == "error") & (F.size(F.col("m")[1]["citations"]) == 0) & (F.size("m") == 2)).alias("errors"))


def _annex_blocks(spark, sf) -> DataFrame:
    """Documents by threes as members of one annex, their lines as blocks: the second has the first's text, the same with other blanks, or its own, as the third has.
    Every fourth document goes on with another annex and comes back."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^a-z \n]", "x").alias("t"))
    i, a = F.col("doc_id"), F.floor(F.col("doc_id") / 3) + 1
    copies = (i % 3 == 1) & (a % 4).isin(0, 1)  # only those need another document's text, and not their own
    t0 = d.where((i % 3 == 0) & (a % 4).isin(0, 1)).select(F.floor(i / 3).alias("f"), F.col("t").alias("t0"))
    own = d.where(~copies).select("doc_id", F.when(a % 4 == 2, F.concat(F.when(i % 3 == 0, "yeni metin ").otherwise("eski metin "), "t")).otherwise(F.col("t")).alias("body"))
    second = d.where(copies).select("doc_id", F.floor(i / 3).alias("f")).join(t0, "f", "left").select("doc_id", F.concat(F.coalesce("t0", F.lit("")), F.when(a % 4 == 1, "  ").otherwise("")).alias("body"))
    j, body = own.union(second), F.col("body")
    back = F.when(i % 4 == 0, F.array(F.concat(F.lit("EK-"), a.cast("string"), F.lit("/Z")), F.lit("alt"), F.concat(F.lit("EK-"), a.cast("string")), F.lit("geri"))).otherwise(F.array().cast("array<string>"))
    lines = j.select(i.alias("i"), a.cast("string").alias("a"), F.posexplode(F.concat(F.split(body, "\n", -1), back)).alias("source_order", "text"))
    nothing = lambda kind: F.lit(None).cast(kind)
    cells = "array<struct<coord:string,value:string,formula:string,cached_value:string>>"
    return lines.select(F.lit("z").alias("path"), F.concat(F.lit("EK-"), "a", F.lit(" "), (F.col("i") % 3).cast("string"), F.lit(".docx")).alias("member"), (-F.col("i")).cast("int").alias("member_order"), F.lit("docx").alias("detected"), "source_order", F.lit("paragraph").alias("kind"), "text", nothing("array<array<string>>").alias("rows"), nothing("string").alias("sheet_name"), nothing(cells).alias("cells"))


#: Annexes are numbered by documents, so their numbers have more digits than the reference's three.
_DIGITS = 18
#: Members stand in archive order by descending doc_id. A part of a member is a contributor; blank lines aren't rendered.
_ANNEX = """d AS (SELECT doc_id, doc_id // 3 + 1 AS a, doc_id // 3 AS f, regexp_replace(coalesce(text, ''), '[^a-z \n]', 'x', 'g') AS t FROM documents),
j AS (SELECT d.*, coalesce(o.t, '') AS t0 FROM d LEFT JOIN d o ON o.f = d.f AND o.doc_id % 3 = 0),
m AS (SELECT a, doc_id, 'EK-' || a || ' ' || doc_id % 3 || '.docx' AS member, CASE WHEN doc_id % 3 = 1 AND a % 4 = 0 THEN t0 WHEN doc_id % 3 = 1 AND a % 4 = 1 THEN t0 || '  ' WHEN a % 4 = 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'yeni metin ' ELSE 'eski metin ' END || t ELSE t END AS text FROM j),
c AS (SELECT CAST(a AS VARCHAR) AS annex, doc_id, member, 0 AS part, array_to_string(list_filter(string_split(text, chr(10)), lambda l: l <> ''), chr(10)) AS text FROM m
  UNION ALL SELECT a || '/Z', doc_id, member, 1, 'EK-' || a || '/Z' || chr(10) || 'alt' FROM m WHERE doc_id % 4 = 0 UNION ALL SELECT CAST(a AS VARCHAR), doc_id, member, 2, 'EK-' || a || chr(10) || 'geri' FROM m WHERE doc_id % 4 = 0),
u AS (SELECT annex, count(*) AS n, list(member ORDER BY doc_id DESC, part) AS members, list(text ORDER BY doc_id DESC, part) AS texts, list(text ORDER BY member, part)[1] AS first, list(member ORDER BY member, part)[1] AS canonical FROM c GROUP BY annex),
l AS (SELECT *, list_transform(texts, lambda t: lower(translate(t, 'Iİ', 'ıi'))) AS low, len(list_distinct(list_transform(texts, lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))))) AS loose FROM u),
v AS (SELECT *, CASE WHEN n = 1 THEN 'SINGLE' WHEN len(list_distinct(texts)) = 1 THEN 'EXACT_DUPLICATE' WHEN loose = 1 THEN 'WHITESPACE_EQUIVALENT'
  WHEN len(list_filter(low, lambda t: t <> '' AND len(list_filter(low, lambda o: o <> t AND (contains(o, t) OR contains(t, o)))) > 0)) = n THEN 'STRUCTURALLY_EQUIVALENT'
  WHEN len(list_filter(low, lambda t: contains(t, 'version') OR contains(t, 'eski metin') OR contains(t, 'yeni metin') OR contains(t, 'yürürlük tarihi') OR contains(t, 'değişik'))) >= 2 AND len(list_filter(low, lambda t: contains(t, 'mülga'))) = 0 THEN 'CONFLICTING'
  WHEN len(list_filter(texts, lambda t: t = '')) = 0 THEN 'COMPLEMENTARY' ELSE 'UNKNOWN' END AS relation FROM l),
w AS (SELECT annex, n, relation, canonical, CASE WHEN relation IN ('CONFLICTING', 'COMPLEMENTARY', 'UNKNOWN') THEN array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: texts[i] <> ''), lambda i: 'SOURCE_MEMBER | ' || members[i] || chr(10) || texts[i]), chr(10)) ELSE first END AS rendered FROM v)"""


@query(f"WITH {_ANNEX} SELECT annex, n, relation, canonical, md5(rendered) AS digest FROM w")
def annex_merge(spark, sf):
    return annex.units(_annex_blocks(spark, sf), _DIGITS).select("annex", F.size("members").cast("long").alias("n"), "relation", "canonical", F.md5(F.col("rendered").cast("binary")).alias("digest"))


@query(f"WITH {_ANNEX} SELECT annex, md5(rendered) AS digest, CAST(len(rendered) AS BIGINT) AS n_chars, CASE WHEN relation = 'COMPLEMENTARY' THEN n ELSE 0 END AS heads, true AS packed FROM w WHERE relation NOT IN ('CONFLICTING', 'UNKNOWN')")
def annex_chunks(spark, sf):
    b = _annex_blocks(spark, sf)
    c = annex.chunks(b, 400, digits=_DIGITS, unresolved="drop")
    again = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), "")
    one = F.col("oversized") & (F.size(F.filter("pieces", lambda p: p["source_order"] >= 0)) > 0) & (F.size("oversized_pieces") == 1)
    g = c.groupBy("path", "annex").agg(again.alias("t"), F.max("char_end").alias("n_chars"), F.count_if(F.col("text").rlike("(?s)^\n?SOURCE_MEMBER")).alias("heads"), F.bool_and((F.length("text") <= 400) | one).alias("packed"))
    return g.select("annex", F.md5(F.col("t").cast("binary")).alias("digest"), F.col("n_chars").cast("long").alias("n_chars"), "heads", "packed")


#: A statute by lines, D the document's number, T its whole text on one line: where each line goes is in the SQL.
_STATUTE = (
    "BİRİNCİ KISIM", "Genel Hükümler", "Amaç D", "MADDE D- (1) Bu metin D içindir.", "(2) İkinci fıkra: T.", "Kapsam", "Madde  9/Ç – (Değişik: 1/1/2020-5/1 md.) (1) Metin.", "satır T.",
    "İKİNCİ BÖLÜM", "EK MADDE 1- Ek metin D.", "GEÇİCİ MADDE 2- Geçici metin.", "5326 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER", "Başlık D", "GEÇİCİ MADDE 3- Son metin.", "son satır.", "5326 SAYILI KANUNA EK VE DEĞİŞİKLİK GETİREN MEVZUAT", "MADDE 99- yok",
)
_FLAT = "(SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g')) AS t FROM documents)"
_ARTICLES = [
    ("'5326-madde-' || doc_id", "CAST(doc_id AS VARCHAR)", "normal", "'Amaç ' || doc_id", "Birinci Kısım", 3, "'MADDE ' || doc_id || '- (1) Bu metin ' || doc_id || ' içindir.' || chr(10) || '(2) İkinci fıkra: ' || t || '.'", None, 2),
    ("'5326-madde-9-c-cedilla'", "'9/Ç'", "normal", "'Kapsam'", "Birinci Kısım", 6, "'Madde  9/Ç – (Değişik: 1/1/2020-5/1 md.) (1) Metin.' || chr(10) || 'satır ' || t || '.'", None, 1),
    ("'5326-ek-madde-1'", "'1'", "ek", "NULL", "Birinci Kısım > İkinci Bölüm", 9, "'EK MADDE 1- Ek metin ' || doc_id || '.'", None, 1),
    ("'5326-gecici-madde-2'", "'2'", "gecici", "NULL", "Birinci Kısım > İkinci Bölüm", 10, "'GEÇİCİ MADDE 2- Geçici metin.'", None, 1),
    ("'5326-islenemeyen-hukum-gecici-madde-3'", "'3'", "islenemeyen_hukum", "'Başlık ' || doc_id", "5326 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER", 13, "'GEÇİCİ MADDE 3- Son metin.' || chr(10) || 'son satır.'", None, 1),
]


def _statutes(spark, sf) -> DataFrame:
    lines = F.array(*map(F.lit, _STATUTE))
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", " "))  # once a document, not once a line
    p = retrieval.spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", flat.alias("flat")).select("doc_id", "flat", F.posexplode(lines).alias("index", "line"))
    text = F.replace(F.regexp_replace("line", r"\bD\b", F.col("doc_id").cast("string")), F.lit("T."), F.concat("flat", F.lit(".")))
    return p.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), "index", text.alias("text"), F.lit(None).cast("array<int>").alias("footnotes"), F.lit("5326").alias("legislation_number"))


@query(" UNION ALL ".join(f"SELECT 'd' || doc_id AS document_id, {i} AS article_id, {n} AS article_no, '{k}' AS article_type, {t} AS article_title, '{c}' AS section_context, CAST({a} AS BIGINT) AS first, md5({x}) AS digest FROM {_FLAT}" for i, n, k, t, c, a, x, _, _ in _ARTICLES))
def statutes_parse(spark, sf):
    a = parsing.articles(_statutes(spark, sf))
    return a.select("document_id", "article_id", "article_no", "article_type", "article_title", "section_context", F.col("start").cast("long").alias("first"), F.md5(F.col("text").cast("binary")).alias("digest"))


_FITS = f"length({_ARTICLES[0][6]}) <= 4000"


@query(" UNION ALL ".join(f"SELECT 'd' || doc_id AS document_id, {i} || '-chunk-001' AS chunk_id, {numbers} AS numbers FROM {_FLAT}" for (i, *_), numbers in zip(_ARTICLES, (f"CASE WHEN {_FITS} THEN '1,2' ELSE '1' END", "'1'", "NULL", "NULL", "NULL"), strict=True)) + f" UNION ALL SELECT 'd' || doc_id, {_ARTICLES[0][0]} || '-chunk-002', '2' FROM {_FLAT} WHERE NOT ({_FITS})")
def statute_chunks(spark, sf):
    a = parsing.articles(_statutes(spark, sf)).withColumn("article_id", F.concat_ws("|", "document_id", "article_id"))
    c = chunking.article_chunks(a, 4000)
    parts = F.split("chunk_id", r"\|")
    return c.select(parts[0].alias("document_id"), parts[1].alias("chunk_id"), F.array_join("paragraph_numbers", ",").alias("numbers"))


def _written(spark, values: DataFrame, name: str) -> str:
    """A folder with one file that holds the one row of values(value)."""
    path = scratch(spark, name)
    values.select("value").coalesce(1).write.text(path)
    return path


@query("SELECT 'd' || doc_id AS document_id, n - 1 AS index, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL)")
def paragraphs_payload(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("index", "text"))
    payload = questions.paragraphs_json(d.withColumn("style_name", F.lit("Normal")).withColumn("footnotes", F.lit(None).cast("array<int>")), "x.docx")
    path = scratch(spark, "paragraphs")
    payload.select("value").write.text(path)  # a document a line
    return questions.load_paragraphs(spark, path, lines=True).select("document_id", F.col("index").cast("long").alias("index"), "text")


@query("""SELECT printf('q%03d', item_id + 1) AS id, '5326_kabahatler/normal/' || (item_id + 1) || ',5326_kabahatler/normal/' || (item_id + 1) || '/a' AS source_keys, '5326_kabahatler' AS documents FROM benchmark WHERE item_id < 30
UNION ALL SELECT printf('gk%03d', item_id + 1), '4458_gumruk/ek/' || (item_id + 1), '4458_gumruk' FROM benchmark WHERE item_id < 30""")
def question_sets_combined(spark, sf):
    b = table(spark, sf, "benchmark").where("item_id < 30").orderBy("item_id").coalesce(1)
    n = (F.col("item_id") + 1).cast("string")
    common = [F.lit("paraphrase").alias("case_type"), F.lit("easy").alias("difficulty"), F.lit(True).alias("source_verified"), F.lit(False).alias("expert_validated"), F.lit("n").alias("notes")]
    one = b.select(F.struct(F.format_string("q%03d", F.col("item_id") + 1).alias("id"), F.concat(F.lit("A "), n, F.lit(" "), F.col("text")).alias("question"), F.array(n, F.concat(n, F.lit("-A"))).alias("expected_articles"), *common).alias("q"))
    source = F.struct(F.lit("4458").alias("legislation_number"), F.lit("ek").alias("article_type"), n.alias("article_no"))
    two = b.select(F.struct(F.format_string("gk%03d", F.col("item_id") + 1).alias("id"), F.concat(F.lit("B "), n, F.lit(" "), F.col("text")).alias("question"), F.array(source).alias("expected_sources"), *common).alias("q"))
    as_list = lambda df: df.agg(F.to_json(F.array_sort(F.collect_list("q"), lambda x, y: F.when(x["id"] < y["id"], -1).otherwise(1))).alias("value"))
    first = questions.load_set(spark, _written(spark, as_list(one), "set"), 30, [f"q{k:03d}" for k in range(1, 31)], annotated=True)
    second = questions.load_set(spark, _written(spark, as_list(two), "set"), 30, [f"gk{k:03d}" for k in range(1, 31)], annotated=True, datasets=("4458",), least_keys=20)
    every = questions.combined(questions.qualified(first, "5326"), questions.qualified(second))
    registry = identity.legacy_registry(spark.createDataFrame([("5326", "5326_kabahatler"), ("4458", "4458_gumruk")], "number string, document_id string"))
    documents = questions.by_document(every, registry)
    again = questions.load_document_questions(spark, _written(spark, questions.document_questions_json(documents), "set"))
    return again.select("id", F.array_join(F.array_sort("source_keys", lambda x, y: F.length(x) - F.length(y)), ",").alias("source_keys"), F.array_join("document_ids", ",").alias("documents"))


@query("SELECT doc_id, md5('EK-' || doc_id || chr(10) || regexp_replace(text, '[^a-zA-Z \n]', '?', 'g') || chr(9) || 'ş') AS digest FROM documents WHERE text IS NOT NULL")
def rtf_decode(spark, sf):
    plain = F.regexp_replace("text", r"[^a-zA-Z \n]", "?")
    body = F.replace(plain, F.lit("\n"), F.lit("\\line "))
    rtf = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}EK-"), F.col("doc_id").cast("string"), F.lit("\\par "), body, F.lit("\\tab \\u351?}"))

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "text": [office.rtf_text(x.encode()) for x in b.rtf]})

    d = retrieval.spread(table(spark, sf, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", rtf.alias("rtf")).mapInPandas(run, "doc_id long, text string")
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'ok' END AS audit FROM documents""")
def envelope_rules(spark, sf):
    from lexmill.operators import citations

    i = F.col("doc_id")
    text = F.when(i % 3 == 0, "DURUM: BELKİ\nCEVAP: x").when(i % 3 == 1, " \nDURUM:  yeterli \n\nCEVAP:\nx [KAYNAK 1]\n").otherwise("DURUM: Yetersiz\nCEVAP: x")
    d = table(spark, sf, "documents").select("doc_id", citations.envelope(text).alias("e"))
    good = F.col("e.status") == F.when(i % 3 == 1, "YETERLI").otherwise("YETERSIZ")
    return d.select("doc_id", F.when(F.col("e.status") == "FORMAT_ERROR", "fail").when(good & F.col("e.body").startswith("x"), "ok").otherwise("wrong").alias("audit"))
