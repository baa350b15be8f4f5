import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import reports
from lexmill.sources import files, questions


def test_scores_of_a_question_with_wrong_repeated_and_right_slots(spark):
    keys = ["x/normal/9", "d/normal/496", "d/normal/496", "d/normal/27", "d/annex/77/c"]
    ranking = spark.createDataFrame([(1, r, k, k.split("/")[0]) for r, k in enumerate(keys, 1)], "query_id long, rank int, key string, document string")
    gold = spark.createDataFrame([(1, "d/normal/496", "d"), (1, "d/annex/77/c", "d"), (2, "d/annex/1", "d")], "query_id long, key string, document string")
    s = {r.query_id: r for r in reports.question_scores(ranking, gold).collect()}
    one = s[1]
    assert (one.type, one.hit_1, one.hit_3, one.hit_5, one.first_rank, one.all_by, one.reciprocal_rank, one.recall, one.full_coverage, one.both_sources, one.wrong_slots, one.wrong_fraction) == ("mixed", False, True, True, 2, 5, 0.5, 1.0, True, True, 1, 0.2)
    assert [tuple(x) for x in one.source_ranks] == [("d/annex/77/c", 5), ("d/normal/496", 2)]
    assert (s[2].type, s[2].hit_5, s[2].first_rank, s[2].all_by, s[2].reciprocal_rank, s[2].slots, s[2].wrong_fraction, s[2].both_sources) == ("annex", False, None, None, 0.0, 0, None, None)
    t = {r.group: r for r in reports.by_type(reports.question_scores(ranking, gold)).collect()}
    assert (t["overall"].questions, t["overall"].mrr, t["overall"].wrong_slots, t["overall"].questions_with_wrong, t["mixed"].both_sources, t["article"].questions, t["article"].mrr) == (2, 0.25, 1, 1, 1, 0, None)
    with pytest.raises(Exception, match="not sequential"):
        reports.question_scores(ranking.where("rank <> 2"), gold).collect()


def test_before_and_after(spark):
    old = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "query_id long, hit boolean")
    new = spark.createDataFrame([(1, False), (2, True), (3, True), (4, True)], "query_id long, hit boolean")
    r = reports.before_after(old, new, ("hit",)).first()
    assert (r.questions, r.before, r.after, r.delta_pp, r.lost, r.gained) == (4, 0.5, 0.75, 25.0, [1], [2, 4])
    for other in (new.where("query_id > 1"), new.union(new)):
        with pytest.raises(Exception, match="not one question in both"):
            reports.before_after(old, other, ("hit",)).collect()
    d = reports.delta_summary(spark.createDataFrame([(3.0, 1.0), (1.0, 1.0), (2.0, 5.0), (None, 1.0)], "old double, new double"), better="lower").first()
    assert (d.n, d["mean"], d["median"], d.improved, d.unchanged, d.regressed) == (3, 1 / 3, 0.0, 1, 1, 1)


def test_answered_summary_counts_unknown_tokens_as_nothing(spark):
    rows = spark.createDataFrame([("a", True, True, 5, 10.0), ("a", False, True, 7, 99.0), ("a", True, False, None, 20.0), ("b", False, True, None, 1.0)], "g string, completed boolean, cited boolean, tokens long, latency_ms double")
    s = {r.g: r for r in reports.answered_summary(rows, ("cited",), ("tokens",), "g").collect()}
    assert (s["a"].questions, s["a"].completed, s["a"].failed, s["a"].cited, s["a"].latency_ms, s["a"].tokens) == (3, 2, 1, 1 / 3, 15.0, 12) and s["b"].tokens is None and s["b"].latency_ms is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ş", ["a", "b"], 0.5), (None, [], None)], "x string, l array<string>, r double")
    files.write_csv(df, str(tmp_path / "a.csv"))
    assert (tmp_path / "a.csv").read_bytes() == "\ufeffx,l,r\nş,a | b,0.5\n,,\n".encode()
    files.write_json(df, str(tmp_path / "a.json"), exclusive=True)
    assert json.loads((tmp_path / "a.json").read_text()) == [{"x": "ş", "l": ["a", "b"], "r": 0.5}, {"l": []}]
    with pytest.raises(FileExistsError):
        files.write_json(df, str(tmp_path / "a.json"), exclusive=True)
    files.write_csv(df, str(tmp_path / "a.csv"), bom=False)
    files.write_markdown(str(tmp_path / "a.md"), "Report", {"Text": "words", "Table": df.select(F.lit("a|b\nc").alias("x"), "r", "l")})
    assert (tmp_path / "a.md").read_text() == "# Report\n\n## Text\n\nwords\n\n## Table\n\n| x | r | l |\n| --- | --- | --- |\n| a\\|b<br>c | 0.5000 | a \\| b |\n| a\\|b<br>c |  |  |\n"
    with pytest.raises(ValueError, match="not a report"):
        files._few(df, 1)
    r = reports.review_rows(df, ("correct", "notes"), review_status="pending").first()
    assert (r.review_status, r.correct, r.notes) == ("pending", "", "")


def test_admission(spark, tmp_path):
    rows = [{"document_id": "d_a", "title": "A", "document_type": "law", "local_file": "data/a.docx", "legislation_number": "5"}, {"document_id": "d-b", "title": "B", "document_type": "law", "local_file": "data/b.docx"}]

    def manifest(rows):
        (tmp_path / "m.json").write_text(json.dumps(rows))
        return files.load_manifest(spark, str(tmp_path / "m.json"))

    m = manifest(rows)
    ok = spark.createDataFrame([("d_a", "/p/data/../data/./a.docx"), ("d-b", "data//b.docx")], "document_id string, source_file string")
    assert sorted((r.document_id, r.title, r.legislation_number) for r in files.admitted(ok, m, "/p").collect()) == [("d-b", "B", None), ("d_a", "A", "5")]
    for d, f, why in (("d_a", "data/b.docx", "another document"), ("d_a", "data/c.docx", "not in the manifest"), (None, "data/a.docx", "without document_id"), ("d_a", " ", "without source_file")):
        with pytest.raises(Exception, match=why):
            files.admitted(spark.createDataFrame([(d, f)], "document_id string, source_file string"), m, "/p").collect()
    for bad in ({"document_id": "D A"}, {"notes": " "}, {"local_file": "data/./b.docx"}, {"legislation_number": 5}):
        with pytest.raises(ValueError):
            manifest([rows[0] | bad, rows[1]])
    payload = {"document_id": "d_a", "source_file": "data/a.docx", "paragraph_count": 2, "paragraphs": [{"index": 0, "text": "MADDE 1- (1) Bir.", "style_name": "n"}, {"index": 1, "text": "(2) İki.", "style_name": "n"}]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps(payload))
    articles, chunks = questions.parse_documents(spark, str(tmp_path / "p"), manifest(rows), "/p")
    assert [(r.document_id, r.article_no) for r in articles.collect()] == [("d_a", "1")] and [(r.document_id, r.text) for r in chunks.collect()] == [("d_a", "MADDE 1- (1) Bir.\n(2) İki.")]
    (tmp_path / "p" / "a.json").write_text(json.dumps(payload | {"document_id": "d-b"}))
    with pytest.raises(Exception, match="another document"):
        questions.parse_documents(spark, str(tmp_path / "p"), m, "/p")[0].collect()


def test_checks_of_parameters(spark):
    from lexmill.functions import checks
    from lexmill.operators import audits, collection, retrieval

    assert checks.positive("k", 3) == 3 and checks.one_of("m", "a", ("a", "b")) == "a"
    for bad in (0, -1, True, 1.0, "3", None):
        with pytest.raises(ValueError, match="positive"):
            checks.positive("k", bad)
    with pytest.raises(ValueError, match="one of"):
        retrieval.dense_topk(spark.range(1), spark.range(1), 3, "dot")
    d = spark.createDataFrame([("a",), (" ",)], "t string")
    assert d.where("t = 'a'").select(checks.not_blank("t", "a question")).first()[0] == "a"
    with pytest.raises(Exception, match="a question must not be empty"):
        d.select(checks.not_blank("t", "a question")).collect()
    left = spark.createDataFrame([(1,), (2,)], "id long")
    right = spark.createDataFrame([(1, [1.0]), (2, [1.0, float("nan")]), (3, None), (3, [])], "id long, v array<double>")
    a = collection.alignment(left, right, "id", "v").first()
    assert (a.matched, a.missing_left, a.repeated_right, a.sizes, a.bad_vectors) == (2, 1, 1, 2, 3)
    c = {(r.field, r.value): r.questions for r in audits.composition(spark.createDataFrame([("x", ["a/annex/1", "b/ek/1"]), ("y", ["b/ek/1"])], "kind string, source_keys array<string>"), "kind").collect()}
    assert c == {("kind", "x"): 1, ("kind", "y"): 1, ("source_type", "mixed"): 1, ("source_type", "article"): 1, ("sources", "1"): 1, ("sources", "2"): 1}
