import json
import threading
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import lexical, retrieval, snapshots
from lexmill.plans import stores
from lexmill.sources import shared


def rows(spark, ids, mark, size=3):
    return spark.createDataFrame([(f"c{i}", [float(i)] * size, mark) for i in ids], "chunk_id string, v array<float>, mark string")


def test_shared_files_are_created_once(spark, tmp_path):
    p = f"file://{tmp_path}/a/b.json"
    assert shared.put(spark, p, b"1") and not shared.put(spark, p, b"2") and shared.get(spark, p) == b"1"
    assert shared.claim(f"{tmp_path}/c") and not shared.claim(f"{tmp_path}/c") and shared.is_there(f"{tmp_path}/c")
    assert shared.names(spark, f"{tmp_path}/a") == ["b.json"] and shared.names(spark, f"{tmp_path}/none") == [] and shared.get(spark, f"{tmp_path}/none") is None
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(shared.claim(f"{tmp_path}/race", str(k).encode()))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1


def test_a_lost_upsert_leaves_the_old_snapshot(spark, tmp_path):
    c = snapshots.Collection.open(spark, str(tmp_path), vector="v", buckets=4)
    with pytest.raises(ValueError, match="nothing"):
        c.read()
    assert c.upsert(rows(spark, range(20), "a")) == 1
    staged = c.stage(rows(spark, range(5, 25), "lost"))
    assert {r.mark for r in c.read().collect()} == {"a"} and c.count() == 20
    assert c.upsert(rows(spark, range(18, 22), "b")) == 2  # the same snapshot was the base of both
    with pytest.raises(snapshots.Lost):
        c.commit(staged)
    got = {r.chunk_id: r.mark for r in snapshots.Collection.open(spark, str(tmp_path), vector="v").read().collect()}
    assert got == {f"c{i}": "b" if i >= 18 else "a" for i in range(22)}
    assert c.read(1).count() == 20 and c.numbers() == [0, 1, 2]
    assert tuple(c.verify().first()) == (22, 22, 0, 0, 0)
    assert c.upsert(rows(spark, range(18, 22), "b")) == 3 and c.count() == 22


def test_only_touched_buckets_are_written(spark, tmp_path):
    c = snapshots.Collection.open(spark, str(tmp_path), buckets=16)
    c.upsert(rows(spark, range(200), "a"))
    before = c.manifest()["folders"]
    c.upsert(rows(spark, [7], "b"))
    after = c.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    c.upsert(rows(spark, [], "b"))
    assert c.manifest()["folders"] == after and c.count() == 200


def test_what_is_not_valid_raises(spark, tmp_path):
    c = snapshots.Collection.open(spark, str(tmp_path), vector="v", buckets=4)
    c.upsert(rows(spark, range(3), "a"))
    for bad, why in ((rows(spark, [1, 1], "b"), "twice"), (rows(spark, [1], "b", 4), "dimensions"), (rows(spark, [1], "b").withColumn("chunk_id", F.lit(None).cast("string")), "missing"), (rows(spark, [1], "b").withColumn("v", F.array(F.lit(float("nan")))), "not valid"), (rows(spark, [1], "b").drop("mark"), "columns")):
        with pytest.raises(ValueError, match=why):
            c.upsert(bad)
    assert c.numbers() == [0, 1]
    with pytest.raises(ValueError, match="the collection has"):
        snapshots.Collection.open(spark, str(tmp_path), on="other", vector="v")
    with pytest.raises(KeyError):
        c.read(9)
    # rows that were moved or lost are noticed
    m = c.manifest()
    b, folder = next(iter(m["folders"].items()))
    shared.put(spark, f"{tmp_path}/manifests/000000002.json", json.dumps(m | {"number": 2, "rows": m["rows"] | {b: 77}}).encode())
    assert c.verify().first().wrong_buckets == 1


def test_index_equals_bm25_and_drops_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(["common"] * (i % 3 + 1) + [f"w{i % 40}"] * (1 + i % 5) + (["rare", "rare"] if i in (3, 400) else []) + [f"u{i}"] * (i % 17))) for i in range(600)] + [(9000, None), (9001, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "rare common"), (2, "w7 W7 common w8"), (3, "nothing known"), (4, ""), (5, "u16 common"), (6, "common")], "query_id long, question string")
    index = lexical.build(docs, str(tmp_path / "i"), shard_docs=40)
    want = sorted(map(tuple, retrieval.bm25(asked, docs, 5).select("query_id", "rank", "id", "score").collect()))
    assert sorted(map(tuple, index.topk(asked, 5).select("query_id", "rank", "id", "score").collect())) == want
    again = lexical.LexicalIndex(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.topk(asked, 5).select("query_id", "rank", "id", "score").collect())) == want
    read = {r.query_id: r for r in again.shards_read(asked, 1).collect()}
    assert read[1].read < read[1].touched and 3 not in read
    assert "documents" not in again.topk(asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    plan = again.topk(asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan and "FlatMapCoGroupsInArrow" in plan  # postings go to their shard's task, not to each question
    with pytest.raises(FileNotFoundError):
        lexical.LexicalIndex(spark, str(tmp_path / "none"))
    one = lexical.build(docs.where("doc_id < 30"), str(tmp_path / "one"))
    assert sorted(map(tuple, one.topk(asked, 20).select("query_id", "rank", "id", "score").collect())) == sorted(map(tuple, retrieval.bm25(asked, docs.where("doc_id < 30"), 20).select("query_id", "rank", "id", "score").collect()))
    assert lexical.build(docs.limit(0), str(tmp_path / "e")).topk(asked).count() == 0


def test_index_of_several_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 50)
    words = lambda i: " ".join(["common"] * (i % 3 + 1) + [f"w{i % 23}"] * (1 + i % 5) + [f"u{i}"] * (i % 7) + ["I\u0307z"] * (i % 11 == 0))
    docs = spark.createDataFrame([(f"d{i:03d}", words(i)) for i in range(400)] + [("none", None), ("empty", "")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "w7 common"), (2, "İz u300 w2"), (3, "nothing"), (4, "common")], "query_id long, question string")
    index = lexical.build(docs, str(tmp_path / "i"), shard_docs=10)
    assert index.about["segments"] == 9 and index.about["documents"] == 402 and index.about["shards"] >= 41
    # a row a term and segment, not a shard, and each document in one segment; a part is one file
    p = index.postings()
    assert p.where("term = 'common'").count() == 9 and p.where("part = -1").selectExpr("explode(ids) id").distinct().count() == 402 == p.where("part = -1").selectExpr("sum(size(ids))").first()[0]
    parts = [p for p in (tmp_path / "i" / "postings").iterdir() if p.is_dir()]
    assert len(parts) == 10 and all(len(list(p.glob("*.parquet"))) == 1 for p in parts)
    composed = docs.withColumn("text", F.replace("text", F.lit("I\u0307"), F.lit("İ")))
    for k in (1, 7, 500):
        want = sorted(map(tuple, retrieval.bm25(asked, composed, k).select("query_id", "rank", "id", "score").collect()))
        assert sorted(map(tuple, index.topk(asked, k).select("query_id", "rank", "id", "score").collect())) == want
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", 800)  # long texts: fewer documents a segment
    long_ = lexical.build(docs, str(tmp_path / "long"), shard_docs=10)
    assert long_.about["segments"] > 9 and sorted(map(tuple, long_.topk(asked, 500).select("query_id", "rank", "id", "score").collect())) == want
    monkeypatch.setattr(lexical, "ASKED", 0)  # too many terms to broadcast
    assert sorted(map(tuple, index.topk(asked, 500).select("query_id", "rank", "id", "score").collect())) == want
    read = {r.query_id: r for r in index.shards_read(asked, 1).collect()}
    assert sorted(read) == [1, 2, 4] and all(r.read <= r.touched <= index.about["shards"] for r in read.values())


def test_what_composition_may_change_is_found(spark):
    changed = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c))]
    assert min(changed) >= "\u0300"
    d = spark.createDataFrame([(f"ab{c}cd",) for c in changed], "t string")
    assert d.where(~F.col("t").rlike(text.not_composed())).count() == 0
    assert spark.createDataFrame([("plain",), ("çğıİöşü é",), ("слово 字 “x”",)], "t string").where(F.col("t").rlike(text.not_composed())).count() == 0
    # letters before the first mark, of which most texts are, are told by one comparison and not by hundreds
    assert text.not_composed().startswith(r"[\x{300}-\x{10FFFF}&&")


def test_variants(spark):
    dense = spark.createDataFrame([(1, r, i) for r, i in enumerate([10, 11, 12, 13], 1)], "query_id long, rank int, id long")
    found = spark.createDataFrame([(1, r, i) for r, i in enumerate([13, 20], 1)], "query_id long, rank int, id long")
    keys = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, "c"), (20, "c")], "id long, key string")
    got = {}
    for r in lexical.variants(dense, found, keys, 3).orderBy("variant", "rank").collect():
        got.setdefault(r.variant, []).append(r.id)
    assert got == {"B0": [10, 11, 12], "B1": [13, 20], "B2": [13, 10, 11], "B3": [13, 10, 12]}


def test_variants_search_only_what_is_asked_and_once(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id vec_id", "array(cast(id % 17 as float), cast(id % 5 as float)) embedding", "cast(id % 3 as int) label").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(60).selectExpr("id doc_id", "concat('w', id % 7, ' common') text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "w1 w2"), (7, "common"), (19, "w6"), (500, "w3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    searched, asked, dense, topk = [], [], retrieval.dense_topk, lexical.LexicalIndex.topk
    monkeypatch.setattr(retrieval, "dense_topk", lambda q, *a: searched.append(q.count()) or dense(q, *a))
    monkeypatch.setattr(lexical.LexicalIndex, "topk", lambda self, q, *a: asked.append(q.count()) or topk(self, q, *a))
    v, _, gold = stores._variants(spark, str(tmp_path))
    assert searched == [3] and asked == [3] and gold.count() == 3  # of 20 vectors and four passages
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan  # rankings are read where they are taken
    q, c = spark.read.parquet(str(tmp_path / "embeddings.parquet")).where("vec_id in (0, 140, 380)").selectExpr("vec_id query_id", "embedding q"), spark.read.parquet(str(tmp_path / "embeddings.parquet")).selectExpr("vec_id id", "embedding v")
    want = sorted((r.query_id // 20, r["rank"], r.id) for r in dense(q, c, 5).collect())
    assert sorted((r.query_id, r["rank"], r.id) for r in v.where("variant = 'B0'").collect()) == want
    s = stores.retrieval_variants_summary(spark, str(tmp_path))
    assert len(searched) == len(asked) == 2 and {r.variant: r.questions for r in s.collect()} == {"B0": 3, "B1": 3, "B2": 3, "B3": 3}
    assert "doc_id" not in s._jdf.queryExecution().optimizedPlan().toString() and s._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0  # nothing is ranked again
