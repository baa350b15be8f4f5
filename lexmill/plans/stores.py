"""Queries of what is stored and asked again: the collection's snapshots, the lexical index, the variants of retrieval; catalogue.py takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import lexical, snapshots
from lexmill.plans.catalogue import _BM25, EVERY, query, table, vectors, _ranked_sql
from lexmill.sources.files import scratch


@query("""SELECT e.vec_id, CASE WHEN l.quality IS NULL OR e.vec_id % 3 = 0 THEN e.label ELSE 100 + l.quality END AS label, e.label AS before, CAST(list_sum(e.embedding::DOUBLE[]) AS DECIMAL(18, 3)) AS total FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id""")
def collection_snapshots(spark, sf):
    """Three upserts, the last of which is lost before it is committed: vectors; new labels of some; labels of all."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    root = scratch(spark, "collection")
    c = snapshots.Collection.open(spark, root, "vec_id", "embedding", buckets=16)
    c.upsert(e)
    some = e.join(table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id").where("vec_id % 3 <> 0 and quality is not null")
    c.upsert(some.select("vec_id", "embedding", (F.col("quality") + 100).cast("long").alias("label")))
    c.stage(e.withColumn("label", F.lit(-1).cast("long")))  # lost: never committed
    again = snapshots.Collection.open(spark, root, "vec_id", "embedding")
    before = again.read(1).select("vec_id", F.col("label").alias("before"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return again.read().join(before, "vec_id").select("vec_id", "label", "before", total.cast("decimal(18,3)").alias("total"))


@query("SELECT count(*) AS rows, count(DISTINCT vec_id) AS ids, 0::BIGINT AS misplaced, 0::BIGINT AS wrong_buckets, 0::BIGINT AS wrong_vectors FROM embeddings")
def collection_verify(spark, sf):
    c = snapshots.Collection.open(spark, scratch(spark, "collection"), "vec_id", "embedding", buckets=16)
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    c.upsert(e.where("vec_id % 2 = 0"))
    c.upsert(e.where("vec_id % 3 > 0"))
    c.upsert(e.where("vec_id % 2 = 1"))
    return c.verify()


def _questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _index(spark, sf) -> lexical.LexicalIndex:
    return lexical.build(table(spark, sf, "documents"), scratch(spark, "lexical"), shard_docs=256)


@query(f"WITH {_BM25} SELECT query_id, rank, id, score FROM b")
def lexical_index_topk(spark, sf):
    return _index(spark, sf).topk(_questions(spark, sf)).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


#: Dense questions are vectors, lexical ones passages: question number n is vector 20 n and passage n.
_VARIANTS = f"""{_ranked_sql(20)}, {_BM25}, dn AS (SELECT query_id // 20 AS query_id, rank, id FROM r WHERE query_id // 20 IN (SELECT item_id FROM benchmark)), lx AS (SELECT query_id, rank, id FROM b WHERE query_id IN (SELECT query_id FROM dn) AND id IN (SELECT vec_id FROM embeddings)),
lr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id FROM lx),
fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM dn UNION ALL SELECT * FROM lr) GROUP BY ALL), fr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fu),
fk AS (SELECT query_id, id, rank FROM fr QUALIFY row_number() OVER (PARTITION BY query_id, id % 40 ORDER BY rank) = 1), fd AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fk),
va AS (SELECT 'B0' AS variant, query_id, rank, id FROM dn UNION ALL SELECT 'B1', query_id, rank, id FROM lr UNION ALL SELECT 'B2', query_id, rank, id FROM fr UNION ALL SELECT 'B3', query_id, rank, id FROM fd)"""


def _kept(spark, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder: a ranking that several variants take is searched once."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _variants(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, keys, gold)"""
    asked, chunks = vectors(spark, sf)
    keys = chunks.select("id", (F.col("id") % 40).alias("key"), F.col("label").cast("long").alias("document"))
    # vectors without a passage aren't searched for, nor passages without a ranking
    passages = _questions(spark, sf)
    asked = asked.join(passages.select((F.col("query_id") * EVERY).alias("query_id")), "query_id", "left_semi")
    dense = _kept(spark, lexical.retrieval.dense_topk(asked, chunks, 20).select(F.floor(F.col("query_id") / EVERY).alias("query_id"), "rank", "id"), "dense")
    ours = dense.select("query_id").distinct()
    found = _index(spark, sf).topk(passages.join(ours, "query_id", "left_semi")).join(keys.select("id"), "id", "left_semi")
    found = _kept(spark, lexical.retrieval.rank(found.withColumnRenamed("rank", "old"), [F.col("old").asc()]), "found")
    gold = chunks.where(F.col("id") % EVERY == 0).select(F.floor(F.col("id") / EVERY).alias("query_id"), ((F.col("id") + 1) % 40).alias("key"), F.col("label").cast("long").alias("document")).join(ours, "query_id", "left_semi")
    return lexical.variants(dense, found, keys.select("id", "key")), keys, gold


@query(f"WITH {_VARIANTS} SELECT variant, query_id, rank, id FROM va WHERE rank <= 5")
def retrieval_variants(spark, sf):
    return _variants(spark, sf)[0]


@query(f"""WITH {_VARIANTS}, gd AS (SELECT vec_id // 20 AS query_id, (vec_id + 1) % 40 AS key, label AS document FROM embeddings WHERE vec_id % 20 = 0 AND vec_id // 20 IN (SELECT query_id FROM dn)),
sl AS (SELECT va.variant, va.query_id, rank, id % 40 = g.key AS hit, e.label = g.document AS ours FROM va JOIN embeddings e ON e.vec_id = va.id JOIN gd g USING (query_id) WHERE rank <= 5),
qv AS (SELECT query_id, variant FROM gd, (SELECT unnest(['B0', 'B1', 'B2', 'B3']) AS variant)),
pq AS (SELECT qv.variant, qv.query_id, coalesce(bool_or(hit AND rank <= 1), false) AS a1, coalesce(bool_or(hit AND rank <= 3), false) AS a3, coalesce(bool_or(hit), false) AS a5, coalesce(bool_or(ours AND rank <= 1), false) AS d1, coalesce(bool_or(ours AND rank <= 3), false) AS d3, coalesce(bool_or(ours), false) AS d5,
  bool_or(NOT ours AND rank = 1) AS un, avg(CASE WHEN NOT ours THEN 1.0 WHEN ours THEN 0.0 END) AS share FROM qv LEFT JOIN sl USING (variant, query_id) GROUP BY ALL)
SELECT variant, count(*) AS questions, round(avg(a1::INT), 6) AS any_1, round(avg(a3::INT), 6) AS any_3, round(avg(a5::INT), 6) AS any_5, round(avg(a1::INT), 6) AS all_1, round(avg(a3::INT), 6) AS all_3, round(avg(a5::INT), 6) AS all_5, round(avg(d1::INT), 6) AS document_1, round(avg(d3::INT), 6) AS document_3, round(avg(d5::INT), 6) AS document_5,
 count(*) FILTER (un) AS unexpected_top, round(avg(un::INT), 6) AS unexpected_top_rate, round(avg(share), 6) AS unexpected_share, round(avg(CASE WHEN variant = 'B0' THEN query_id ELSE query_id + 0.5 END), 6) AS latency_ms, CASE WHEN variant <> 'B3' THEN CAST(sum(query_id) AS BIGINT) END AS tokens FROM pq GROUP BY variant""")
def retrieval_variants_summary(spark, sf):
    v, keys, gold = _variants(spark, sf)
    v, gold = _kept(spark, v, "variants"), _kept(spark, gold, "gold")  # a row a slot and a row a question, which the summary takes many times
    usage = gold.select("query_id").withColumn("variant", F.explode(F.array(*map(F.lit, lexical.VARIANTS)))).select("variant", "query_id", F.when(F.col("variant") == "B0", F.col("query_id").cast("double")).otherwise(F.col("query_id") + 0.5).alias("latency_ms"), F.when((F.col("variant") != "B3") | (F.col("query_id") > 0), F.col("query_id")).alias("tokens"))
    s = lexical.variants_summary(v, keys, gold, usage)
    return s.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in s.schema))
