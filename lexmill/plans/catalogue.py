"""Queries over the driver's tables, one or more for each operator, with the SQL that must agree.

Vectors stand for chunks and questions (every twentieth is a question), their label for the document they
come from; documents for chunk texts, benchmark passages for questions in words, conversations for answers,
events for usage records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import audits, chunking, citations, collection, metrics, parsing, reports, retrieval, routing, sequences
from lexmill.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EVERY = 20  # one vector in so many is a question


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def ranked(spark: SparkSession, sf: str, k: int, metric: str = "l2") -> DataFrame:
    """query_id, rank, id, distance, label of the slot, gold label of the question."""
    q, c = vectors(spark, sf)
    top = retrieval.dense_topk(q, c, k, metric)
    gold = c.select(F.col("id").alias("query_id"), F.col("label").cast("long").alias("gold"))
    return top.join(c.select("id", F.col("label").cast("long").alias("label")), "id").join(gold, "query_id")


_D = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))"


def _ranked_sql(k: int, where: str = "", d: str = _D) -> str:
    return f"""p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, CAST(b.label AS BIGINT) AS label, CAST(a.label AS BIGINT) AS gold, {d} AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0 {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM p QUALIFY rank <= {k})"""


_COS = "1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _out(top: DataFrame) -> DataFrame:
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("distance", 6).alias("distance"))


_OUT_SQL = "SELECT query_id, rank, id, round(distance, 6) AS distance FROM r"


@query(f"WITH {_ranked_sql(5)} {_OUT_SQL}")
def dense_topk_l2(spark, sf):
    q, c = vectors(spark, sf)
    return _out(retrieval.dense_topk(q, c, 5))


@query(f"WITH {_ranked_sql(5, d=_COS)} {_OUT_SQL}")
def dense_topk_cosine(spark, sf):
    q, c = vectors(spark, sf)
    return _out(retrieval.dense_topk(q, c, 5, "cosine"))


@query(f"WITH {_ranked_sql(5, 'AND b.label = 3')} {_OUT_SQL}")
def dense_topk_filter_eq(spark, sf):
    q, c = vectors(spark, sf)
    return _out(retrieval.dense_topk(q, c.where("label = 3"), 5))


@query(f"WITH {_ranked_sql(5, 'AND b.label IN (1, 4, 7)')} {_OUT_SQL}")
def dense_topk_filter_in(spark, sf):
    q, c = vectors(spark, sf)
    return _out(retrieval.dense_topk(q, c.where(F.col("label").isin(1, 4, 7)), 5))


@query(f"""WITH {_ranked_sql(5)} SELECT query_id, k, bool_or(label = gold AND rank <= k) AS hit FROM r, (SELECT unnest([1, 3, 5]) AS k) GROUP BY query_id, k""")
def hit_at_k(spark, sf):
    r = ranked(spark, sf, 5).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5)))))
    return r.groupBy("query_id", "k").agg(F.bool_or((F.col("label") == F.col("gold")) & (F.col("rank") <= F.col("k"))).alias("hit"))


def _gold(r: DataFrame) -> DataFrame:
    """Two gold keys a question: its own label and the next."""
    own = r.select("query_id", "gold").distinct()
    return own.select("query_id", F.explode(F.array("gold", (F.col("gold") + 1) % 10)).alias("key")).withColumn("document", F.col("key") % 5)


_METRICS = f"""WITH {_ranked_sql(5)}, c AS (SELECT unnest([1, 3, 5]) AS k),
g AS (SELECT DISTINCT query_id, unnest([gold, (gold + 1) % 10]) AS key FROM r), gd AS (SELECT DISTINCT query_id, key % 5 AS document FROM g),
s AS (SELECT r.*, label AS key, label % 5 AS document FROM r),
a AS (SELECT g.query_id, c.k, bool_or(h) AS source_any, bool_and(h) AS source_all FROM (SELECT g.query_id, g.key, c.k, EXISTS (SELECT 1 FROM s WHERE s.query_id = g.query_id AND s.key = g.key AND s.rank <= c.k) AS h FROM g, c) g JOIN c USING (k) GROUP BY ALL),
d AS (SELECT query_id, k, bool_or(h) AS document_hit, bool_and(h) AS document_all FROM (SELECT gd.query_id, c.k, EXISTS (SELECT 1 FROM s WHERE s.query_id = gd.query_id AND s.document = gd.document AND s.rank <= c.k) AS h FROM gd, c) GROUP BY ALL),
i AS (SELECT s.query_id, c.k, avg(CASE WHEN gd.document IS NULL THEN 1.0 ELSE 0.0 END) AS intrusion FROM s JOIN c ON s.rank <= c.k LEFT JOIN gd ON gd.query_id = s.query_id AND gd.document = s.document GROUP BY ALL)"""


def _scored(spark, sf):
    r = ranked(spark, sf, 5)
    return metrics.at_cutoffs(r.select("query_id", "rank", F.col("label").alias("key"), (F.col("label") % 5).alias("document")), _gold(r), (1, 3, 5))


@query(_METRICS + " SELECT query_id, k, source_any, source_all, document_hit, document_all, round(intrusion, 6) AS intrusion FROM a JOIN d USING (query_id, k) JOIN i USING (query_id, k)")
def metrics_at_k(spark, sf):
    return _scored(spark, sf).withColumn("intrusion", F.round("intrusion", 6))


@query(_METRICS + """ SELECT k, count(*) AS n, round(avg(source_any::INT), 6) AS any_rate, round(avg(source_all::INT), 6) AS all_rate, round(avg(document_hit::INT), 6) AS document_rate, round(avg(intrusion), 6) AS mean_intrusion
FROM a JOIN d USING (query_id, k) JOIN i USING (query_id, k) GROUP BY k""")
def metric_summary(spark, sf):
    return _scored(spark, sf).groupBy("k").agg(F.count("*").alias("n"), F.round(metrics.rate(F.col("source_any")), 6).alias("any_rate"), F.round(metrics.rate(F.col("source_all")), 6).alias("all_rate"), F.round(metrics.rate(F.col("document_hit")), 6).alias("document_rate"), F.round(F.avg("intrusion"), 6).alias("mean_intrusion"))


@query(f"""WITH {_ranked_sql(5)}, g AS (SELECT DISTINCT query_id, unnest([gold, (gold + 1) % 10]) AS key FROM r), f AS (SELECT g.query_id, g.key, min(r.rank) AS first FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.label = g.key GROUP BY ALL)
SELECT query_id, min(first) AS first_rank, round(coalesce(1.0 / min(first), 0), 6) AS reciprocal_rank, round(count(first) / count(*), 6) AS recall, count(first) = count(*) AS full_coverage FROM f GROUP BY query_id""")
def mrr_recall(spark, sf):
    r = ranked(spark, sf, 5)
    out = metrics.first_ranks(r.withColumn("key", F.col("label")), _gold(r), 5)
    return out.select("query_id", F.col("first_rank").cast("long").alias("first_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("recall", 6).alias("recall"), "full_coverage")


@query(f"""WITH {_ranked_sql(50)}, f AS (SELECT query_id, min(CASE WHEN label = gold THEN rank END) AS f FROM r GROUP BY 1)
SELECT CASE WHEN f = 1 THEN '1' WHEN f <= 3 THEN '2-3' WHEN f <= 5 THEN '4-5' WHEN f <= 10 THEN '6-10' WHEN f <= 20 THEN '11-20' WHEN f <= 50 THEN '21-50' ELSE '>50' END AS band, count(*) AS n FROM f GROUP BY 1""")
def recovery_bands(spark, sf):
    f = ranked(spark, sf, 50).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))).alias("f"))
    return f.groupBy(metrics.band(F.col("f")).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {_ranked_sql(5)} SELECT query_id, CAST(count(*) - count(DISTINCT label) AS BIGINT) AS duplicates FROM r GROUP BY 1")
def duplicate_slots(spark, sf):
    return metrics.duplicate_slots(ranked(spark, sf, 5), "label", 5)


@query(f"WITH {_ranked_sql(1)} SELECT gold, label AS predicted, count(*) AS n FROM r GROUP BY ALL")
def confusion_matrix(spark, sf):
    wide = metrics.pivot_counts(ranked(spark, sf, 1), "gold", "label", list(range(10)))
    return wide.unpivot(["gold"], [str(k) for k in range(10)], "predicted", "n").where("n > 0").select("gold", F.col("predicted").cast("long").alias("predicted"), "n")


_TOK = "regexp_extract_all(lower(translate({}, 'Iİ', 'ıi')), '[\\p{{L}}\\p{{N}}]+')"
_STATS = f"""d AS (SELECT doc_id AS id, {_TOK.format("coalesce(text, '')")} AS terms FROM documents), w AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d)"""


@query(f"WITH {_STATS} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM (SELECT DISTINCT unnest(terms) FROM d)) AS terms FROM w")
def bm25_corpus_stats(spark, sf):
    docs = table(spark, sf, "documents")
    kinds = docs.select(F.explode(T.tokens("text")).alias("t")).distinct().agg(F.count("*").alias("terms"))
    s = retrieval.corpus_stats(docs, "text").select("n", F.round("avgdl", 6).alias("avgdl"), F.lit(1).alias("one"))
    return s.join(kinds.withColumn("one", F.lit(1)), "one").drop("one")


_BM25 = f"""{_STATS}, q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format("text")}) AS term FROM benchmark),
t AS (SELECT id, any_value(len(terms)) AS dl, term, count(*) AS tf FROM (SELECT id, terms, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM t JOIN f USING (term) JOIN q USING (term), w GROUP BY ALL),
b AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 20)"""


def _bm25(spark, sf):
    return retrieval.bm25(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), table(spark, sf, "documents"))


@query(f"WITH {_BM25} SELECT query_id, rank, id, score FROM b")
def bm25_topk(spark, sf):
    return _bm25(spark, sf).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


_TWO = f"""WITH {_ranked_sql(20)}, c0 AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(range(1, 33), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM c0 QUALIFY rank <= 20),
u AS (SELECT query_id, id, rank FROM r UNION ALL SELECT query_id, id, rank FROM c),
f0 AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM f0)"""


def _two(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Dense ranks over all dimensions and over the first half."""
    q, c = vectors(spark, sf)
    half = retrieval.dense_topk(q.withColumn("q", F.slice("q", 1, 32)), c.withColumn("v", F.slice("v", 1, 32)), 20)
    return retrieval.dense_topk(q, c, 20), half


@query(_TWO + " SELECT query_id, id, rank, round(score, 9) AS score FROM f")
def rrf_fusion(spark, sf):
    return retrieval.rrf(*_two(spark, sf)).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(f"""WITH {_ranked_sql(20)}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM r)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id, label FROM o WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""")
def dedup_by_key(spark, sf):
    return retrieval.first_per_key(ranked(spark, sf, 20), "label", 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "label")


@query(_TWO + """, m AS (SELECT query_id, id, 0 AS k FROM r WHERE rank = 1 UNION ALL SELECT f.query_id, f.id, f.rank FROM f JOIN r ON r.query_id = f.query_id AND r.rank = 1 AND r.id <> f.id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank, id FROM m QUALIFY rank <= 5""")
def allocate_c1(spark, sf):
    d, h = _two(spark, sf)
    return retrieval.allocate(d, retrieval.rrf(d, h), "C1").select("query_id", F.col("rank").cast("long").alias("rank"), "id")


@query("WITH RECURSIVE" + _TWO.removeprefix("WITH") + """, l AS (SELECT query_id, list(id ORDER BY rank) AS d FROM r GROUP BY 1), h AS (SELECT query_id, list(id ORDER BY rank) AS h FROM f GROUP BY 1),
x AS (SELECT l.query_id, d, h, 0 AS t, []::BIGINT[] AS got FROM l JOIN h USING (query_id)
 UNION ALL SELECT query_id, d, h, t + 1, CASE WHEN len(got) < 5 AND len(n) > 0 THEN list_append(got, n[1]) ELSE got END FROM
 (SELECT *, list_filter(CASE WHEN t % 2 = 0 THEN d ELSE h END, lambda v: NOT list_contains(got, v)) AS n FROM x WHERE t < 10)),
y AS (SELECT query_id, got FROM x WHERE t = 10)
SELECT query_id, unnest(range(1, 6)) AS rank, unnest(got) AS id FROM y""")
def allocate_c2(spark, sf):
    d, h = _two(spark, sf)
    return retrieval.allocate(d, retrieval.rrf(d, h), "C2").select("query_id", F.col("rank").cast("long").alias("rank"), "id")


_CENTERS = """c0 AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), c1 AS (SELECT label, pos, avg(x) AS m FROM c0 GROUP BY ALL),
c2 AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM c1)"""
_ROUTES = f"""{_CENTERS}, e AS (SELECT vec_id AS query_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % {EVERY} = 0),
e1 AS (SELECT query_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM e), s AS (SELECT query_id, label, sum(x * c) AS similarity FROM e1 JOIN c2 USING (pos) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, label) AS rank FROM s)"""


@query(f"WITH {_CENTERS} SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, round(c, 6) AS c FROM c2")
def centroids(spark, sf):
    c = routing.centroids(table(spark, sf, "embeddings"), "label")
    return c.select(F.col("label").cast("long").alias("label"), F.posexplode("c").alias("pos", "c")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("c", 6).alias("c"))


def _routes(spark, sf):
    q, _ = vectors(spark, sf)
    return routing.route(q, routing.centroids(table(spark, sf, "embeddings"), "label"), "label", 2)


@query(f"WITH {_ROUTES} SELECT query_id, rank, CAST(label AS BIGINT) AS label, round(similarity, 6) AS similarity FROM o WHERE rank <= 2")
def centroid_routing(spark, sf):
    return _routes(spark, sf).where("rank <= 2").select("query_id", F.col("rank").cast("long").alias("rank"), F.col("label").cast("long").alias("label"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_ROUTES}, t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN similarity END) - max(CASE WHEN rank = 2 THEN similarity END) AS m FROM o GROUP BY 1) SELECT count(*) AS n, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(min(m), 6) AS least, round(max(m), 6) AS most FROM t")
def router_margin(spark, sf):
    return routing.margins(_routes(spark, sf)).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "least", "most")))


@query(f"WITH {_ROUTES}, {_ranked_sql(10**9)}, z AS (SELECT r.query_id, r.id, k, row_number() OVER (PARTITION BY r.query_id, k ORDER BY r.rank) AS rank FROM r JOIN o ON o.query_id = r.query_id AND o.label = r.label JOIN (SELECT unnest([1, 2]) AS k) ON o.rank <= k) SELECT query_id, CAST(k AS BIGINT) AS documents, rank, id FROM z WHERE rank <= 5")
def routed_topk(spark, sf):
    q, c = vectors(spark, sf)
    routes = _routes(spark, sf).where("rank <= 2").select("query_id", "label", F.col("rank").alias("route"))
    routed = routes.select("query_id", F.col("label").cast("long").alias("label"), "route")
    near = retrieval.dense_topk(q.join(routed, "query_id"), c.withColumn("label", F.col("label").cast("long")), 5, within="label")
    out = near.join(routed, ["query_id", "label"]).withColumn("documents", F.explode(F.sequence("route", F.lit(2))))
    w = Window.partitionBy("query_id", "documents").orderBy(F.round("distance", 9), "id")
    return out.withColumn("r", F.row_number().over(w)).where("r <= 5").select("query_id", F.col("documents").cast("long").alias("documents"), F.col("r").cast("long").alias("rank"), "id")


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(' ' || regexp_replace(text, '[^0-9A-Za-z_\\p{L}\\p{N}]', '  ', 'g') || ' ', ' (123|456|555) ', 1))), '|') AS found FROM documents""")
def detect_laws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.detect("text", ["123", "456", "555"]), "|").alias("found"))


_LINES = "l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id, CAST(n - 1 AS BIGINT) AS idx, trim(replace(line, chr(13), ' ')) AS line FROM l WHERE trim(line) <> ''")
def paragraphs_extract(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    return p.select("doc_id", F.col("idx").cast("long").alias("idx"), T.normalize_paragraph("line").alias("line")).where("line <> ''")


_PACK = f"""WITH RECURSIVE {_LINES}, x AS (SELECT doc_id, n, length(line) AS size, 1 AS g FROM l WHERE n = 1
 UNION ALL SELECT l.doc_id, l.n, CASE WHEN x.size + 1 + length(l.line) > 500 THEN length(l.line) ELSE x.size + 1 + length(l.line) END, CASE WHEN x.size + 1 + length(l.line) > 500 THEN x.g + 1 ELSE x.g END
 FROM x JOIN l ON l.doc_id = x.doc_id AND l.n = x.n + 1),
c AS (SELECT x.doc_id, g, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY x.n) AS chunk FROM x JOIN l ON l.doc_id = x.doc_id AND l.n = x.n GROUP BY ALL)"""


@query(_PACK + " SELECT doc_id, CAST(g AS BIGINT) AS chunk_no, n_lines, CAST(length(chunk) AS BIGINT) AS size, md5(chunk) AS digest FROM c")
def chunk_pack(spark, sf):
    c = chunking.pack_lines(table(spark, sf, "documents"), "doc_id", "text", 500)
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n_lines").cast("long").alias("n_lines"), F.length("chunk").cast("long").alias("size"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def chunk_lossless_check(spark, sf):
    docs = table(spark, sf, "documents")
    c = chunking.pack_lines(docs, "doc_id", "text", 500).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "\n").alias("again"))
    return docs.select("doc_id").join(c, "doc_id", "left").select("doc_id", F.md5(F.col("again").cast("binary")).alias("digest"))


@query("""WITH RECURSIVE o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
x AS (SELECT source, n, n_chars AS size, 1 AS k, 0 AS g FROM o WHERE n = 1
 UNION ALL SELECT o.source, o.n, CASE WHEN x.size + o.n_chars > 20000 OR x.k >= 8 THEN o.n_chars ELSE x.size + o.n_chars END, CASE WHEN x.size + o.n_chars > 20000 OR x.k >= 8 THEN 1 ELSE x.k + 1 END, CASE WHEN x.size + o.n_chars > 20000 OR x.k >= 8 THEN x.g + 1 ELSE x.g END FROM x JOIN o ON o.source = x.source AND o.n = x.n + 1)
SELECT x.source, CAST(g AS BIGINT) AS batch, count(*) AS n, CAST(sum(o.n_chars) AS BIGINT) AS size FROM x JOIN o ON o.source = x.source AND o.n = x.n GROUP BY ALL""")
def batch_plan(spark, sf):
    d = sequences.cut(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20_000, most=8)
    return d.groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


@query("""SELECT doc_id, md5(source || chr(10) || upper(lang) || ' ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'T' || doc_id END || chr(10) || chr(10) || text) AS digest FROM documents""")
def embedding_text(spark, sf):
    title = F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("T"), F.col("doc_id").cast("string")))
    e = T.embedding_text("source", F.concat_ws(" ", F.upper("lang"), F.col("doc_id").cast("string")), title, "text")
    return table(spark, sf, "documents").select("doc_id", F.md5(e.cast("binary")).alias("digest"))


_RAW = "CASE doc_id % 4 WHEN 0 THEN ' ' || doc_id || ' - A ' WHEN 1 THEN doc_id || '_b' WHEN 2 THEN doc_id || '/Ç' ELSE doc_id || ' / ç' END"


def _raw():
    i = F.col("doc_id").cast("string")
    return F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), i, F.lit(" - A "))).when(F.col("doc_id") % 4 == 1, F.concat(i, F.lit("_b"))).when(F.col("doc_id") % 4 == 2, F.concat(i, F.lit("/Ç"))).otherwise(F.concat(i, F.lit(" / ç")))


@query(f"SELECT doc_id, lower(regexp_replace(regexp_replace(trim({_RAW}), '[-_]', '/', 'g'), ' */ *', '/', 'g')) AS legacy, CASE doc_id % 4 WHEN 0 THEN doc_id || '/a' WHEN 1 THEN doc_id || '/b' WHEN 2 THEN doc_id || '/Ç' ELSE doc_id || '/ç' END AS canonical FROM documents")
def normalize_article_no(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.article_no_legacy(_raw()).alias("legacy"), T.article_no(_raw()).alias("canonical"))


@query("SELECT doc_id, source || '/' || (['normal', 'ek', 'gecici'])[CAST(doc_id % 3 AS INT) + 1] || '/' || doc_id AS key, source || '/annex/' || (doc_id + 1) || CASE WHEN doc_id % 2 = 0 THEN '/a' ELSE '' END AS annex, source || '-ek-' || (doc_id + 1) || CASE WHEN doc_id % 2 = 0 THEN '-a' ELSE '' END AS storage FROM documents")
def source_keys(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("normal", "ek", "gecici"))), (F.col("doc_id") % 3 + 1).cast("int"))
    label = F.concat(F.lit("EK-"), (F.col("doc_id") + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, "/a").otherwise(""))
    d = table(spark, sf, "documents").select("doc_id", T.source_key("source", kind, F.col("doc_id").cast("string")).alias("key"), T.annex_key("source", label).alias("annex"))
    return d.withColumn("key", F.concat_ws("/", T.parse_source_key("key")["document_id"], T.parse_source_key("key")["article_type"], T.parse_source_key("key")["article_no"])).withColumn("storage", T.annex_storage_id("annex"))


@query("WITH m AS (SELECT source, min(lang) AS lang FROM documents GROUP BY 1) SELECT d.doc_id, m.source AS document_id, 'T ' || m.source AS title, CASE WHEN m.lang = 'de' THEN NULL ELSE m.lang END AS legislation_number FROM documents d JOIN m USING (source)")
def manifest_admission(spark, sf):
    d = table(spark, sf, "documents").where("source is not null")
    m = d.groupBy("source").agg(F.min("lang").alias("lang")).select(F.col("source").alias("document_id"), F.concat(F.lit("T "), "source").alias("title"), F.lit("law").alias("document_type"), F.when(F.col("lang") != "de", F.col("lang")).alias("legislation_number"), F.concat(F.lit("data/raw/"), "source", F.lit(".docx")).alias("local_file"))
    spelt = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/p/data/./raw/"), "source", F.lit(".docx"))).otherwise(F.concat(F.lit("data/raw/old/../"), "source", F.lit(".docx")))
    return files.admitted(d.select("doc_id", F.col("source").alias("document_id"), spelt.alias("source_file")), m, "/p").select("doc_id", "document_id", "title", "legislation_number")


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS missing_right, count(*) FILTER (d.doc_id IS NULL) AS missing_left, 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def alignment_audit(spark, sf):
    return collection.alignment(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT d.doc_id, coalesce(upper(d.lang) || l.quality, d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_merge(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", "lang")
    changes = base.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.concat(F.upper("lang"), F.col("quality").cast("string")).alias("lang"))
    once = collection.upsert(base, changes, "doc_id")
    return collection.upsert(once, changes, "doc_id")


@query("""SELECT 'minus' AS op, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'overlap', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'not_in_corpus', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)""")
def corpus_set_ops(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(d.subtract(l.select("doc_id")), "minus").union(n(d.intersect(l.where("toxic = 1").select("doc_id")), "overlap")).union(n(l.join(d, "doc_id", "left_anti"), "not_in_corpus")).union(n(d.union(table(spark, sf, "embeddings").select("vec_id")).distinct(), "union"))


@query("""WITH j AS (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
a AS (SELECT 'lang' AS field, count(lang) AS present, count(*) - count(lang) AS missing, count(*) FILTER (lang IN ('en', 'de')) AS valid FROM j UNION ALL SELECT 'quality', count(quality), count(*) - count(quality), count(*) FILTER (quality = 1) FROM j UNION ALL SELECT 'n_chars', count(n_chars), count(*) - count(n_chars), count(*) FILTER (n_chars = length(text)) FROM j)
SELECT *, present - valid AS invalid FROM a""")
def metadata_audit(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return collection.field_audit(j, {"lang": F.col("lang").isin("en", "de"), "quality": F.col("quality") == 1, "n_chars": F.col("n_chars") == F.length("text")})


@query("SELECT doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def eav_pivot(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("string").alias("n_chars"))
    return collection.eav_to_wide(d.unpivot(["doc_id"], ["lang", "source", "n_chars"], "key", "value"), "doc_id", "key", "value", ["lang", "source", "n_chars"])


@query("""WITH h AS (SELECT doc_id, sha256(text) AS e, sha256(regexp_replace(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g')) AS w FROM documents)
SELECT w AS key, count(*) AS n, count(DISTINCT e) AS texts, min(doc_id) AS canonical, CASE WHEN count(DISTINCT e) = 1 THEN 'EXACT_DUPLICATE' ELSE 'WHITESPACE_EQUIVALENT' END AS kind FROM h GROUP BY w HAVING count(*) > 1""")
def content_hash_dups(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("e"), T.whitespace_hash("text").alias("key"))
    g = h.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("e").alias("texts"), F.min("doc_id").alias("canonical")).where("n > 1")
    return g.withColumn("kind", F.when(F.col("texts") == 1, "EXACT_DUPLICATE").otherwise("WHITESPACE_EQUIVALENT"))


_ANSWER = "'DURUM: ' || CASE turn % 3 WHEN 0 THEN 'YETERLI' WHEN 1 THEN 'YETERSIZ' ELSE 'BELKI' END || chr(10) || 'CEVAP: ' || trim(text) || ' [KAYNAK ' || (turn % 5) || '] [KAYNAK 2] [KAYNAK ' || (turn % 5) || ']'"


def _answers(spark, sf):
    t = F.col("turn")
    n = (t % 5).cast("string")
    status = F.when(t % 3 == 0, "YETERLI").when(t % 3 == 1, "YETERSIZ").otherwise("BELKI")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("DURUM: "), status, F.lit("\nCEVAP: "), F.trim("text"), F.lit(" [KAYNAK "), n, F.lit("] [KAYNAK 2] [KAYNAK "), n, F.lit("]")).alias("answer"))


@query(f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'YETERLI' WHEN 1 THEN 'YETERSIZ' ELSE 'FORMAT_ERROR' END AS status, CASE WHEN turn % 3 < 2 THEN md5(substr({_ANSWER}, CASE turn % 3 WHEN 0 THEN 23 ELSE 24 END)) END AS body FROM conversations")
def envelope_parse(spark, sf):
    e = citations.envelope(F.col("answer"))
    return _answers(spark, sf).select("conv_id", "turn", e["status"].alias("status"), F.md5(e["body"].cast("binary")).alias("body"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 5 = 2 THEN '2' ELSE (turn % 5) || ',2' END AS labels, CASE WHEN turn % 5 = 0 THEN 'out_of_range' END AS problem FROM conversations")
def citation_validate(spark, sf):
    a = _answers(spark, sf).withColumn("v", citations.valid_labels(citations.labels(F.col("answer")), F.lit(4), F.lit("YETERLI")))
    return a.select("conv_id", "turn", F.array_join(F.col("v.labels").cast("array<string>"), ",").alias("labels"), F.col("v.problem").alias("problem"))


@query("SELECT conv_id, turn, CAST(unnest(range(3)) AS BIGINT) AS pos, CAST(unnest([turn % 5, 2, turn % 5]) AS BIGINT) AS label FROM conversations")
def citation_extract(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", F.posexplode(citations.labels(F.col("answer"))).alias("pos", "label")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("label").cast("long").alias("label"))


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) SELECT conv_id, md5(string_agg('[KAYNAK ' || n || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n)) AS digest FROM o GROUP BY 1")
def context_build(spark, sf):
    return citations.context(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5(F.col("context").cast("binary")).alias("digest"))


_OLD_NEW = _TWO + """, a AS (SELECT r.query_id, min(CASE WHEN r.label = r.gold THEN r.rank END) AS f FROM r GROUP BY 1), b AS (SELECT c.query_id, min(CASE WHEN e.label = q.label THEN c.rank END) AS f FROM c JOIN embeddings e ON e.vec_id = c.id JOIN embeddings q ON q.vec_id = c.query_id GROUP BY 1),
pp AS (SELECT query_id, coalesce(1.0 / b.f, 0) AS old, coalesce(1.0 / a.f, 0) AS new FROM a JOIN b USING (query_id))"""


def _old_new(spark, sf):
    full, half = _two(spark, sf)
    lab = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    gold = lab.select(F.col("id").alias("query_id"), F.col("label").alias("gold"))
    rr = lambda r: r.join(lab, "id").join(gold, "query_id").groupBy("query_id").agg(F.coalesce(1 / F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))).cast("double"), F.lit(0.0)).alias("rr"))
    return metrics.paired(rr(half), rr(full), "query_id", "rr")


@query(_OLD_NEW + " SELECT query_id, round(old, 6) AS old, round(new, 6) AS new, CASE WHEN new > old THEN 'improved' WHEN new < old THEN 'regressed' ELSE 'unchanged' END AS change FROM pp")
def paired_delta(spark, sf):
    return _old_new(spark, sf).select("query_id", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "change")


@query(_OLD_NEW + " SELECT avg(new) >= avg(old) AS mrr_not_worse, count(*) FILTER (new < old) <= 1 AS few_regressed, count(*) FILTER (new > 0) >= count(*) FILTER (old > 0) AS hits_not_worse, avg(new) >= avg(old) AND count(*) FILTER (new < old) <= 1 AND count(*) FILTER (new > 0) >= count(*) FILTER (old > 0) AS all_pass FROM pp")
def gates(spark, sf):
    new, old = F.col("new"), F.col("old")
    return _old_new(spark, sf).agg(*metrics.gates({"mrr_not_worse": F.avg("new") >= F.avg("old"), "few_regressed": F.count_if(new < old) <= 1, "hits_not_worse": F.count_if(new > 0) >= F.count_if(old > 0)}))


@query("""WITH u AS (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(value * 100 AS BIGINT) END AS t FROM events)
SELECT user_id, CASE WHEN count(t) = count(*) THEN CAST(sum(t) AS BIGINT) END AS strict_total, CAST(sum(t) AS BIGINT) AS loose_total, count(*) AS n FROM u GROUP BY 1""")
def usage_null_poison(spark, sf):
    u = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 97 == 0, None).otherwise(F.round(F.col("value") * 100).cast("long")).alias("t"))
    return u.groupBy("user_id").agg(metrics.sum_or_null("t").alias("strict_total"), F.sum("t").alias("loose_total"), F.count("*").alias("n"))


@query("""SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, round(avg(quality), 6) AS quality_rate, count(*) - count(quality) AS unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def group_summary_rollup(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    out = j.rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("quality_rate"), (F.count("*") - F.count("quality")).alias("unknown"))
    return out.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("lang", "source")})


@query(f"""WITH d AS (SELECT lang, {_TOK.format("text")} AS t FROM documents), c AS (SELECT lang, len(t) AS n, CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS BIGINT) AS hits FROM d)
SELECT lang, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (hits > 0) AS documents, round(10000.0 * sum(hits) / sum(n), 6) AS per_10k FROM c GROUP BY 1""")
def phrase_stats(spark, sf):
    made = reports.phrase_rates(retrieval.spread(table(spark, sf, "documents").select("lang", "text")), T.tokens("text"), "of", "the", "lang")
    return made.withColumn("per_10k", F.round("per_10k", 6))


@query("SELECT md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS key, count(*) AS n, min(conv_id) AS first_conv FROM conversations WHERE role = 'user' GROUP BY 1")
def question_dedup(spark, sf):
    u = table(spark, sf, "conversations").where("role = 'user'")
    return u.groupBy(F.md5(T.question_key("text").cast("binary")).alias("key")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


@query("""WITH p AS (SELECT doc_id, text, greatest(greatest(position('on the' IN text), 1) - 20, 1) AS s FROM documents)
SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, 40) || CASE WHEN s + 40 <= length(text) THEN '...' ELSE '' END AS snippet FROM p""")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet("text", F.lit("on the"), 40).alias("snippet"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({_TOK.format("text")}) AS t FROM benchmark), o AS (SELECT item_id, t, lag(t) OVER (ORDER BY item_id) AS p FROM b)
SELECT item_id, CAST(len(list_intersect(t, p)) AS BIGINT) AS shared, CAST(len(list_filter(t, lambda x: NOT list_contains(p, x))) AS BIGINT) AS own FROM o WHERE p IS NOT NULL""")
def token_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select(F.lit(0).alias("set"), "item_id", F.array_distinct(T.tokens("text")).alias("t"))
    o = sequences.previous(b, "set", "item_id", "t", "p").where("p is not null")
    return o.select("item_id", F.size(F.array_intersect("t", "p")).cast("long").alias("shared"), F.size(F.array_except("t", "p")).cast("long").alias("own"))


@query("SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS BIGINT) AS char_start, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS char_end FROM documents")
def running_offsets(spark, sf):
    return sequences.running(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", "char_start", "char_end").select("doc_id", "char_start", "char_end")


@query("""WITH h AS (SELECT sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS h FROM documents)
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 12) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM h""")
def fingerprint(spark, sf):
    return collection.fingerprint(table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source"), "doc_id")


@query("SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has_the, len(list_intersect(string_split(lower(text), ' '), ['of', 'and', 'the'])) = 3 AS has_all FROM documents")
def array_membership(spark, sf):
    words = lambda c: F.split(c, " ", -1)
    want = F.array(*map(F.lit, ("of", "and", "the")))
    return table(spark, sf, "documents").select("doc_id", F.array_contains(words(F.col("text")), "the").alias("has_the"), (F.size(F.array_intersect(words(F.lower("text")), want)) == 3).alias("has_all"))


@query("""WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'unknown' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), ' | ') AS reasons FROM j WHERE quality IS NULL OR toxic = 1 OR quality = 0 OR lang <> 'en'""")
def failure_labels(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    why = F.array_compact(F.array(F.when(F.col("quality").isNull(), "unknown"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low"), F.when(F.col("lang") != "en", "foreign")))
    return j.select("doc_id", F.array_join(why, " | ").alias("reasons")).where("reasons <> ''")


@query("""WITH d AS (SELECT DISTINCT lang, doc_id FROM documents), n AS (SELECT lang, doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS nx FROM d)
SELECT lang, doc_id + 1 AS gap_start, nx - 1 AS gap_end FROM n WHERE nx > doc_id + 1""")
def number_gaps(spark, sf):
    return sequences.gaps(table(spark, sf, "documents"), "lang", "doc_id")


@query("SELECT source, n_chars, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def repeated_labels(spark, sf):
    return audits.repeated_labels(table(spark, sf, "documents"), "source", "n_chars")


@query(_TWO + """, x AS (SELECT query_id, list(id ORDER BY rank) AS x FROM r WHERE rank <= 5 GROUP BY 1), y AS (SELECT query_id, list(id ORDER BY rank) AS y FROM c WHERE rank <= 5 GROUP BY 1)
SELECT query_id, x = y AS same_order, CAST(len(list_intersect(x, y)) AS BIGINT) AS shared FROM x JOIN y USING (query_id)""")
def prefix_comparison(spark, sf):
    full, half = _two(spark, sf)
    return audits.same_prefix(full, half, 5).select("query_id", "same_order", F.col("shared").cast("long").alias("shared"))


@query(_TWO + " SELECT r.query_id, bool_and(r.id = c.id) AS same_ids, bool_and(r.id = c.id AND abs(r.distance - c.distance) <= 1e-7) AS within_tolerance FROM r JOIN c ON c.query_id = r.query_id AND c.rank = r.rank WHERE r.rank <= 5 GROUP BY 1")
def drift_check(spark, sf):
    full, half = _two(spark, sf)
    return audits.drift(full, half, 5)


@query(_METRICS + """, t AS (SELECT query_id, k, array_to_string(list_filter([CASE WHEN NOT source_any THEN 'complete_miss' END, CASE WHEN source_any AND NOT source_all THEN 'partial' END, CASE WHEN document_hit AND NOT source_any THEN 'right_document_wrong_source' END, CASE WHEN intrusion > 0.5 THEN 'intrusion' END], lambda x: x IS NOT NULL), '|') AS problems
FROM a JOIN d USING (query_id, k) JOIN i USING (query_id, k)) SELECT query_id, k, problems FROM t""")
def failure_taxonomy(spark, sf):
    m = _scored(spark, sf)
    return m.select("query_id", "k", F.array_join(audits.taxonomy(F.col("source_any"), F.col("source_all"), F.col("document_hit"), F.col("intrusion")), "|").alias("problems"))


@query(_METRICS + """, s1 AS (SELECT 'k' || k AS variant, k AS position, avg(source_any::INT) AS any_rate, avg(source_all::INT) AS all_rate FROM a GROUP BY k), b AS (SELECT any_rate AS ba, all_rate AS bl FROM s1 WHERE variant = 'k1')
SELECT variant AS recommended FROM s1, b WHERE any_rate >= ba AND all_rate >= bl ORDER BY all_rate DESC, any_rate DESC, position LIMIT 1""")
def recommendation(spark, sf):
    s = _scored(spark, sf).groupBy("k").agg(F.avg(F.col("source_any").cast("double")).alias("any_rate"), F.avg(F.col("source_all").cast("double")).alias("all_rate"))
    return audits.recommend(s.select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("variant"), F.col("k").alias("position"), "any_rate", "all_rate"), "k1")


@query("""SELECT doc_id AS question_id, doc_id % 7 AS part, CASE WHEN doc_id % 7 = 0 THEN 'no_source' WHEN NOT contains(text, CASE WHEN doc_id % 5 = 0 THEN upper(substr(text, 3, 30)) || '#' ELSE substr(text, 3, 30) END) THEN 'not_literal' ELSE 'ok' END AS audit FROM documents""")
def gold_excerpt_audit(spark, sf):
    d = table(spark, sf, "documents")
    cut = F.substring("text", 3, 30)
    gold = d.select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 7 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("key"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.upper(cut), F.lit("#"))).otherwise(cut).alias("excerpt"))
    return audits.excerpt_audit(gold, d.select(F.col("doc_id").alias("key"), "text")).select("question_id", (F.col("question_id") % 7).alias("part"), "audit")


@query("""WITH l AS (SELECT conv_id, turn, unnest([turn % 2 + 1, 2]) AS rank FROM conversations), o AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rank FROM conversations)
SELECT l.conv_id, turn, CAST(l.rank AS BIGINT) AS rank, md5(o.text) AS digest FROM l JOIN o ON o.conv_id = l.conv_id AND o.rank = l.rank WHERE l.conv_id IN (SELECT conv_id FROM o WHERE rank = 2)""")
def citation_copy(spark, sf):
    c = table(spark, sf, "conversations")
    blocks = c.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("rank"), F.md5(F.col("text").cast("binary")).alias("chunk_id"))
    answers = c.select("conv_id", "turn").join(blocks.where("rank = 2").select("conv_id"), "conv_id", "left_semi").withColumn("answer_id", F.struct("conv_id", "turn"))
    labels = answers.select("answer_id", F.array((F.col("turn") % 2 + 1).cast("int"), F.lit(2)).alias("labels"))
    out = audits.copied_citations(labels, answers.join(blocks, "conv_id").select("answer_id", "rank", "chunk_id"))
    return out.select("answer_id.conv_id", "answer_id.turn", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("digest"))


@query("""SELECT doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || CASE WHEN quality IS NULL THEN '' ELSE ',"quality":' || quality END || ',"source":"' || source || '"}' AS metadata FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_json(spark, sf):
    return audits.metadata(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left"), "doc_id", ["lang", "n_chars", "quality", "source"])


@query("""SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN false WHEN doc_id % 3 = 1 THEN true ELSE false END AS valid FROM documents""")
def router_prediction_validate(spark, sf):
    p = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("c"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf, "documents").select("doc_id", "lang", audits.valid_prediction(p, ["a", "b", "c"]).alias("valid"))


@query("""WITH b AS (SELECT CASE label WHEN 0 THEN 'x' ELSE 'y' END AS grp, vec_id FROM embeddings), e AS (SELECT label AS gold, label FROM embeddings)
SELECT grp, count(*) AS n, CAST(min(vec_id) AS BIGINT) AS first_id, CAST(max(vec_id) AS BIGINT) AS last_id FROM b GROUP BY 1""")
def collection_distribution(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("grp", F.when(F.col("label") == 0, "x").otherwise("y"))
    return e.groupBy("grp").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


_LAW = f"{_LINES}, p AS (SELECT doc_id, n - 1 AS idx, (n - 1) // 4 + 1 AS no, CASE WHEN (n - 1) % 4 = 0 THEN 'MADDE ' || ((n - 1) // 4 + 1) || '- ' ELSE '' END || line || '.' AS t FROM l)"


def _law(spark, sf) -> DataFrame:
    """Documents as statutes: every fourth line begins an article, no line looks like a title."""
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("index", "line"))
    head = F.when(F.col("index") % 4 == 0, F.concat(F.lit("MADDE "), (F.floor(F.col("index") / 4) + 1).cast("string"), F.lit("- "))).otherwise("")
    return p.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), "index", F.concat(head, "line", F.lit(".")).alias("text"), F.lit(None).cast("array<int>").alias("footnotes"))


@query(f"WITH {_LAW} SELECT 'd' || doc_id AS document_id, CAST(no AS VARCHAR) AS article_no, 'd' || doc_id || '-madde-' || no AS article_id, min(idx) AS first, max(idx) AS last, md5(string_agg(t, chr(10) ORDER BY idx)) AS digest FROM p GROUP BY doc_id, no")
def articles_parse(spark, sf):
    a = parsing.articles(_law(spark, sf))
    return a.select("document_id", "article_no", "article_id", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_LAW} SELECT 'd' || doc_id || '-madde-' || no AS article_id, md5(string_agg(t, chr(10) ORDER BY idx)) AS digest FROM p GROUP BY doc_id, no")
def article_chunks_lossless(spark, sf):
    a = parsing.articles(_law(spark, sf))
    c = chunking.article_chunks(a, 300).groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n").alias("again"))
    return a.select("article_id").join(c, "article_id", "left").select("article_id", F.md5(F.col("again").cast("binary")).alias("digest"))


from lexmill.plans import calls, evaluations, reporting, stores  # noqa: E402,F401  add their queries to those above
