import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import answering, chunking, citations, evaluation, identity, retrieval
from lexmill.sources import questions


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_law_metrics(spark):
    slots = spark.createDataFrame([(1, 1, "5326/1", "5326"), (1, 2, "4458/1", "4458"), (1, 3, "4458/1", "4458"), (1, 4, "x", None)], "query_id long, rank int, key string, law string")
    gold = spark.createDataFrame([(1, "4458/1", "4458"), (1, "4458/2", "4458"), (2, "a", "b")], "query_id long, key string, law string")
    got = {r.query_id: r for r in evaluation.law_metrics(slots, gold).collect()}
    assert (got[1].any_1, got[1].any_3, got[1].all_5, got[1].law_1, got[1].law_3) == (False, True, False, False, True)
    assert got[1].share_5 == pytest.approx(1 / 3) and got[1].top_law == "5326" and got[1].unexpected_top
    assert got[2].share_5 is None and got[2].any_5 is False and got[2].unexpected_top is None
    with pytest.raises(Exception, match="not sequential"):
        evaluation.checked_ranks(slots.where("rank <> 2")).collect()


def test_gates_and_recommendation(spark):
    cols = "query_id long, dataset string, n_keys int, any_5 boolean, all_5 boolean, law_1 boolean"
    old = spark.createDataFrame([(1, "x", 1, True, True, True), (2, "y", 2, False, False, True), (3, "y", 1, True, True, True)], cols)
    good = spark.createDataFrame([(1, "x", 1, True, True, True), (2, "y", 2, True, True, False), (3, "y", 1, True, True, True)], cols)
    assert all(r.holds for r in evaluation.gates(old, good, "x", "y").collect())
    worse = good.withColumn("any_5", F.col("any_5") & (F.col("query_id") != 1))
    held = {r.gate: r.holds for r in evaluation.gates(old, worse, "x", "y").collect()}
    assert not held["A"] and held["B"] and not held["VALIDATED"]
    assert not {r.gate: r.holds for r in evaluation.gates(old, old, "x", "y").collect()}["B"]
    scopes = [("x", 0.5, 0.5), ("y", 0.5, 0.5), ("combined", 0.5, 0.5), ("multi_part", 0.5, 0.5), ("single_source", 0.5, 0.5)]
    rows = [(s, p, sc, a + up, b + up, 0.9) for s, p, up in (("B0", 0, 0.0), ("B1", 1, 0.1), ("B2", 2, 0.2), ("B3", 3, 0.2)) for sc, a, b in scopes]
    df = spark.createDataFrame(rows, "strategy string, position int, scope string, any_5 double, all_5 double, law_1 double")
    got = {r.strategy: (r.eligible, r.recommended) for r in evaluation.recommend(df, "B0", "x", "y").collect()}
    assert got == {"B1": (True, False), "B2": (True, True), "B3": (True, False)}
    missing = df.where("not (strategy = 'B2' and scope = 'multi_part')")
    assert {r.strategy: (r.eligible, r.recommended) for r in evaluation.recommend(missing, "B0", "x", "y").collect()}["B2"] == (False, False)


def test_routing_cost_and_types(spark):
    flag = lambda a, b: F.struct(F.lit(a).alias("source_any"), F.lit(b).alias("source_all"))
    df = spark.range(1).select(flag(True, True).alias("b"), flag(False, False).alias("r1"), flag(True, False).alias("r2"))
    assert df.select(evaluation.routing_cost("b", "r1", "r2").alias("x")).first().x == ["catastrophic", "recovered_by_second"]
    assert df.select(evaluation.routing_cost("r1", "r1", "r1").alias("x")).first().x == ["already_wrong", "no_impact"]
    keys = F.array(F.lit("d/annex/1"), F.lit("d/normal/1"))
    assert one(spark, evaluation.question_type(keys)) == "mixed" and one(spark, evaluation.is_multi_source(keys))


def test_identities(spark):
    pair = lambda *rows: identity.legacy_registry(spark.createDataFrame(rows, "number string, document_id string"))
    assert pair(("1", "a"), ("1", "a"), ("2", "b")).count() == 2
    with pytest.raises(Exception, match="ambiguous"):
        pair(("1", "a"), ("1", "b")).collect()
    keys = spark.createDataFrame([("9", "normal", "1")], "number string, article_type string, article_no string")
    with pytest.raises(Exception, match="unresolved"):
        identity.to_source_keys(keys, pair(("1", "a"))).collect()
    h = spark.createDataFrame([(1, ["a", "zz"])], "query_id long, ids array<string>")
    with pytest.raises(Exception, match="no chunk for zz"):
        identity.ranks_to_chunks(h, spark.createDataFrame([("a",)], "id string")).collect()
    b = lambda *x: spark.createDataFrame([(k,) for k in x], "batch long")
    assert [r.batch for r in identity.pending_batches(b(1, 2, 3), b(1), b(1)).orderBy("batch").collect()] == [2, 3]
    with pytest.raises(Exception, match="begun and not known"):
        identity.pending_batches(b(1, 2), b(1), b(2)).collect()
    q = spark.createDataFrame([("a", "madde Ã¼", "n", ["k"]), ("b", " ", None, ["k", "k"]), ("c", "şöyle", "n", [])], "id string, question string, notes string, source_keys array<string>")
    assert {r.id: r.problems for r in identity.candidate_problems(q).collect()} == {"a": ["encoding"], "b": ["blank_question", "blank_notes", "repeated_source"], "c": ["no_sources"]}


def test_a_ranking_with_an_id_twice_raises(spark):
    r = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, id long, rank int")
    got = {x.id: x.score for x in retrieval.rrf(r, r).collect()}
    assert got == {5: pytest.approx(2 / 61), 6: pytest.approx(2 / 62)}
    with pytest.raises(Exception, match="an id twice"):
        retrieval.rrf(r.union(r)).collect()


def test_units_begin_at_the_heading(spark):
    u = lambda t: [(x["no"], x["text"]) for x in one(spark, chunking.units(F.lit(t)))]
    assert u("MADDE 3- Metin sonra – (3) devam") == [(None, "MADDE 3- Metin sonra – (3) devam")]
    assert u("MADDE 3- (5/2/2020 degisik) (1) Metin\n(2) iki") == [("1", "MADDE 3- (5/2/2020 degisik) (1) Metin"), ("2", "(2) iki")]
    assert u("Ek Madde 4 – (Değişik: x) 1. bir\n2. iki") == [("1", "Ek Madde 4 – (Değişik: x) 1. bir"), ("2", "2. iki")]


def test_envelope_and_labels(spark):
    e = lambda t: tuple(one(spark, citations.envelope(F.lit(t))))
    assert e(" DURUM: yeterli\n\nCEVAP: a\nb \n") == ("YETERLI", "a\nb")
    assert e("DURUM: YETERLI\n CEVAP: a") == ("FORMAT_ERROR", None) and e("DURUM: YETERLI\nCEVAP:  ") == ("FORMAT_ERROR", None) and e("x DURUM: YETERLI\nCEVAP: a") == ("FORMAT_ERROR", None)
    with pytest.raises(Exception, match="no article type"):
        one(spark, T.article_label(F.lit("zz"), F.lit("1")))
    assert one(spark, T.annex_label(F.lit(77), F.lit("A"))) == "EK-77/A" and one(spark, T.annex_label(F.lit(0), F.lit(None).cast("string"))) == "EK-?"


def test_answers(spark):
    q = spark.createDataFrame([(1, "bir"), (2, "iki")], "query_id long, question string")
    r = spark.createDataFrame([(1, 1, "a", 0.1), (1, 2, "b", 0.2)], "query_id long, rank int, id string, distance double")
    c = spark.createDataFrame([("a", "Bir metin"), ("b", "öteki")], "id string, text string")
    got = {x.query_id: x for x in answering.answer_questions(q, r, c, 5).collect()}
    assert got[1].answer == "bir [KAYNAK 1]" and not got[1].insufficient and got[1].context_ids == ["a", "b"] and got[1].citations[0].id == "a"
    assert got[2].answer == answering.INSUFFICIENT and got[2].insufficient and got[2].citations == []
    say = lambda text: lambda i, question, context: F.lit(text)
    with pytest.raises(Exception, match="out_of_range"):
        answering.answer_questions(q, r, c, 5, say("DURUM: YETERLI\nCEVAP: x [KAYNAK 3]")).collect()
    with pytest.raises(Exception, match="no_citation"):
        answering.answer_questions(q, r, c, 5, say("DURUM: YETERLI\nCEVAP: x")).collect()
    loose = answering.generate(answering.retrieve(q, r, c, 5), say("merhaba"), strict=False)
    assert {x.query_id: x.problem for x in loose.collect()} == {1: "format", 2: None}
    with pytest.raises(Exception, match="must not be empty"):
        answering.retrieve(spark.createDataFrame([(1, " ")], "query_id long, question string"), r, c, 5).collect()
    for bad in (r.withColumn("distance", F.lit(-1.0)), r.withColumn("id", F.lit("a")), r.withColumn("id", F.lit("zz")), r.withColumn("rank", F.col("rank") + 1)):
        with pytest.raises(Exception, match="result not valid"):
            answering.retrieve(q, bad, c, 5).collect()
    found = answering.retrieve(q, r, c, 5)
    made = answering.generate(found)
    for other in (made.withColumn("question", F.lit("x")), made.withColumn("context_ids", F.reverse("context_ids")), made.withColumn("citations", F.transform("citations", lambda x: x.withField("rank", F.lit(2))))):
        with pytest.raises(Exception, match="layers differ"):
            answering.cross_checked(found, other).collect()


def test_question_sets(spark, tmp_path):
    row = {"id": "q1", "question": "Bir?", "expected_articles": ["1", "2/a"], "case_type": "long_tail", "difficulty": "hard", "source_verified": True, "expert_validated": False, "notes": "n"}

    def load(rows, **how):
        (tmp_path / "s.json").write_text(json.dumps(rows))
        return questions.load_set(spark, str(tmp_path / "s.json"), **how)

    assert load([row, row | {"id": "q2", "question": "iki"}], count=2, ids=["q1", "q2"], annotated=True).count() == 2
    bad = [([], {}), ([row], {"count": 2}), ([row | {"id": "q3"}], {"ids": ["q1"]}), ([row | {"difficulty": "x"}], {"annotated": True}), ([row | {"notes": " "}], {"annotated": True}), ([row, row | {"question": "b"}], {}), ([row, row | {"id": "q2", "question": " BİR?  ".replace("İ", "i")}], {}), ([row | {"expected_articles": ["1", "1"]}], {}), ([row | {"expected_articles": []}], {}), ([row], {"approved": True})]
    for rows, how in bad:
        with pytest.raises(ValueError):
            load(rows, **how)
    source = {"legislation_number": "5326", "article_type": "normal", "article_no": "1"}
    held = row | {"dataset": "5326", "expected_sources": [source], "gold_human_approved": False}
    assert load([held], datasets=("5326", "4458"), approved=False, annotated=True).count() == 1
    with pytest.raises(ValueError, match="sources not valid"):
        load([held | {"dataset": "4458"}], datasets=("5326", "4458"))
    for text in ('{"questions": []}', '{"source_identity_schema": "x", "questions": []}', '{"source_identity_schema": "document-source-v1", "questions": [{"id": "a"}]}'):
        (tmp_path / "d.json").write_text(text)
        with pytest.raises(ValueError):
            questions.load_document_questions(spark, str(tmp_path / "d.json"))
    (tmp_path / "p.json").write_text('{"document_id": "a", "source_file": "f", "paragraph_count": 2, "paragraphs": [{"index": 0, "text": "x"}]}')
    with pytest.raises(ValueError, match="paragraph_count"):
        questions.load_paragraphs(spark, str(tmp_path / "p.json"))
    (tmp_path / "c.json").write_text('{"document_id": "a", "chunk_count": 1, "chunks": [{"chunk_id": "k", "text": "x", "paragraph_numbers": ["1"]}]}')
    assert questions.load_chunks(spark, str(tmp_path / "c.json")).first().chunk_id == "k"
