import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import annex, chunking, citations, collection, embedding, metrics, parsing, retrieval
from lexmill.sources import files, office
from lexmill.streaming import questions


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_tokens_fold_turkish(spark):
    assert one(spark, T.tokens(F.lit("İTHALAT, IŞIK; ÇĞÖŞÜ ıi / 35_A --"))) == ["ithalat", "ışık", "çğöşü", "ıi", "35", "a"]
    assert one(spark, T.tokens(F.lit("İTHALAT"))) == ["ithalat"]


def test_article_numbers(spark):
    assert one(spark, T.article_no(F.lit(" 72 - Ç "))) == "72/Ç"
    assert one(spark, T.article_no(F.lit("72/ç"))) == "72/ç"
    assert one(spark, T.article_no_legacy(F.lit("72_B"))) == "72/b"
    with pytest.raises(Exception, match="not valid"):
        one(spark, T.article_no(F.lit("7 2!")))


def test_source_keys(spark):
    assert one(spark, T.source_key(F.lit("law_1"), F.lit("ek"), F.lit("3"))) == "law_1/ek/3"
    assert one(spark, T.parse_source_key(F.lit("law_1/normal/42/a")))["article_no"] == "42/a"
    with pytest.raises(Exception, match="not canonical"):
        one(spark, T.parse_source_key(F.lit("law_1/normal/42/B")))
    with pytest.raises(Exception, match="not valid"):
        one(spark, T.source_key(F.lit("Law"), F.lit("ek"), F.lit("3")))
    assert one(spark, T.annex_key(F.lit("d"), F.lit("EK-77/A"))) == "d/annex/77/a" == one(spark, T.annex_key(F.lit("d"), F.lit("EK 77 a"))) == one(spark, T.annex_key(F.lit("d"), F.lit("ek–77-A")))
    keys = spark.createDataFrame([("d/annex/10",), ("d/annex/2/b",), ("d/annex/2",), ("c/annex/99",)], "k string")
    assert [r.k for r in keys.orderBy(T.annex_order("k")).collect()] == ["c/annex/99", "d/annex/2", "d/annex/2/b", "d/annex/10"]
    assert one(spark, T.annex_key(F.lit("d"), F.lit("EK-0"))) is None
    assert one(spark, T.annex_storage_id(F.lit("d/annex/77/A"))) == "d-ek-77-a"


def test_amendment_note(spark):
    assert one(spark, T.amendment_note(F.lit("(Değişik: 1/2/2020) (Ek) metin"))) == "(Değişik: 1/2/2020) (Ek)"
    assert one(spark, T.amendment_note(F.lit("(1) metin"))) is None


def test_bm25_closed_form(spark):
    docs = spark.createDataFrame([("a", "eşya eşya"), ("b", "eşya vergi"), ("c", "vergi vergi")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "eşya eşya")], "query_id long, question string")
    got = {r.id: r.score for r in retrieval.bm25(q, docs).collect()}
    idf = math.log(1 + 1.5 / 2.5)
    assert got == {"a": round(idf * 2 * 2.5 / 3.5, 6), "b": round(idf, 6)}


def test_rrf_dedup_allocate(spark):
    rows = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, id long, rank int")
    got = {r.id: r.score for r in retrieval.rrf(rows([1, 2]), rows([3, 1])).collect()}
    assert got == pytest.approx({1: 1 / 61 + 1 / 62, 2: 1 / 62, 3: 1 / 61})
    keyed = rows(range(9)).withColumn("key", F.greatest(F.col("id"), F.lit(4)))
    assert [r.key for r in retrieval.first_per_key(keyed, "key", 5).orderBy("rank").collect()] == [4, 5, 6, 7, 8]
    d, h = rows([1, 2, 3, 4, 5]), rows([2, 1, 6, 7, 8])
    ids = lambda p: [r.id for r in retrieval.allocate(d, h, p).orderBy("rank").collect()]
    assert ids("C1") == [1, 2, 6, 7, 8] and ids("C2") == [1, 2, 3, 6, 4]
    with pytest.raises(Exception, match="fewer than"):
        retrieval.allocate(rows([1]), rows([1]), "C1").collect()


def test_dense_topk_brute(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = retrieval.dense_topk(c.select(F.col("id").alias("query_id"), F.col("v").alias("q")), c, 4).collect()
    for r in got:
        d = ((x - x[r.query_id]) ** 2).sum(1)
        d[r.query_id] = np.inf
        assert np.argsort(d)[r["rank"] - 1] == r.id


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, 1, "a/1", "a"), (1, 2, "b/1", "b")], "query_id long, rank int, key string, document string")
    gold = spark.createDataFrame([(1, "b/1", "b"), (1, "b/2", "b"), (2, "a/1", "a")], "query_id long, key string, document string")
    got = {(r.query_id, r.k): r for r in metrics.at_cutoffs(ranking, gold, (1, 3)).collect()}
    assert not got[1, 1].source_any and got[1, 3].source_any and not got[1, 3].source_all and got[1, 3].intrusion == 0.5
    assert got[2, 3].intrusion is None and got[2, 3].source_any is False
    f = {r.query_id: r for r in metrics.first_ranks(ranking, gold, 5).collect()}
    assert f[1].reciprocal_rank == 0.5 and f[1].recall == 0.5 and f[2].reciprocal_rank == 0.0


def test_paired_needs_the_same_questions(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 0.0)], "id long, v double")
    assert [r.change for r in metrics.paired(a, a, "id", "v").collect()] == ["unchanged"] * 2
    with pytest.raises(Exception, match="different questions"):
        metrics.paired(a, a.where("id = 1"), "id", "v").collect()


P = [
    (0, "BİRİNCİ KISIM"), (1, "Genel"), (3, "Amaç"), (4, "MADDE 1- (1) Bu Kanun"), (5, "(2) ikinci"), (7, "Kapsam"), (8, "Madde 42/A – (Ek: 1/1/2020) Metin"),
    (9, "İKİNCİ KISIM"), (10, "serbest"), (11, "Ek Madde 1 — ek metin"), (12, "Geçici Madde 2- geçici"), (13, "5 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER"), (14, "Başlık satırı"),
    (15, "GEÇİCİ MADDE 1- hüküm"), (16, "devam."), (17, "6 SAYILI KANUNA EK VE DEĞİŞİKLİK GETİREN"), (18, "MADDE 9- tuzak"),
]


def test_articles(spark):
    rows = [("d", i, t, [7] if i == 4 else [3] if i == 3 else None) for i, t in P]
    df = spark.createDataFrame(rows, "document_id string, index int, text string, footnotes array<int>").repartition(4)
    a = {(r.article_type, r.article_no): r for r in parsing.articles(df).collect()}
    assert set(a) == {("normal", "1"), ("normal", "42/A"), ("ek", "1"), ("gecici", "2"), ("islenemeyen_hukum", "1")}
    m = a["normal", "1"]
    assert (m.article_title, m.text, m.start, m.end, m.footnotes, m.section_context) == ("Amaç", "MADDE 1- (1) Bu Kanun\n(2) ikinci", 4, 5, [3, 7], "Birinci Kısım")
    assert a["normal", "42/A"].article_title == "Kapsam" and a["normal", "42/A"].amendment_note == "(Ek: 1/1/2020)" and a["normal", "42/A"].end == 8
    assert a["ek", "1"].section_context == "İkinci Kısım"
    s = a["islenemeyen_hukum", "1"]
    assert s.article_title == "Başlık satırı" and s.text.endswith("devam.") and s.section_context == "5 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER"


def test_units_and_chunks(spark):
    text = "MADDE 1- (1) " + "a" * 30 + "\n(2) " + "b" * 30 + "\nek satır\n(3) " + "c" * 30
    u = one(spark, chunking.units(F.lit(text)))
    assert [x.no for x in u] == ["1", "2", "3"] and "\n".join(x.text for x in u) == text
    dotted = "MADDE 2- başlık\n(not)\n1. bir\n3. değil\n2. iki"
    v = one(spark, chunking.units(F.lit(dotted)))
    assert [x.no for x in v] == ["1", "2"] and "\n".join(x.text for x in v) == dotted
    a = spark.createDataFrame([("x", text)], "article_id string, text string")
    c = chunking.article_chunks(a, 90).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in c] == ["x-chunk-001", "x-chunk-002"] and "\n".join(r.text for r in c) == text
    assert chunking.article_chunks(a, None).count() == 1


def test_citations(spark):
    e = citations.envelope(F.lit("DURUM: YETERLI\n\nCEVAP: evet [KAYNAK 2] [KAYNAK 1] [KAYNAK 2]\n"))
    r = spark.range(1).select(e["status"].alias("s"), citations.valid_labels(citations.labels(e["body"]), F.lit(2), e["status"]).alias("v")).first()
    assert r.s == "YETERLI" and r.v.labels == [2, 1] and r.v.problem is None
    assert one(spark, citations.envelope(F.lit("x"))["status"]) == "FORMAT_ERROR"
    bad = lambda n, s, t: one(spark, citations.valid_labels(citations.labels(F.lit(t)), F.lit(n), F.lit(s))["problem"])
    assert bad(1, "YETERLI", "[KAYNAK 2]") == "out_of_range" and bad(1, "YETERLI", "") == "no_citation" and bad(1, "YETERSIZ", "") is None


def test_collection(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = collection.upsert(base, new, "id")
    assert collection.same_rows(once, collection.upsert(once, new, "id")) and once.count() == 3
    assert collection.fingerprint(once, "id").first() == collection.fingerprint(once.repartition(5), "id").first()
    r = collection.alignment(base, new, "id").first()
    assert (r.matched, r.missing_right, r.missing_left) == (1, 1, 1)


def docx(paragraphs):
    body = "".join(f'<w:p><w:r><w:t>{t}</w:t></w:r>{"<w:r><w:footnoteReference w:id=\"4\"/></w:r>" if n else ""}</w:p>' for t, n in paragraphs)
    xml = f'<w:document xmlns:w="{office.W[1:-1]}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_office_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("bir", True), ("  ", False), ("iki", False)]))
    got = office.read_docx(spark, str(tmp_path / "a.docx")).orderBy("index").collect()
    assert [(r["index"], r.text, r.footnotes) for r in got] == [(0, "bir", [4]), (2, "iki", None)]
    assert office.rtf_text(b"{\\rtf1\\ansi EK-48\\par Unicode: \\u304?}") == "EK-48\nUnicode: İ"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("ek-48.rtf", b"{\\rtf1\\ansi EK-48\\par metin}")
        z.writestr("EK 48 kopya.docx", docx([("EK-48", False), ("metin", False), ("EK-48/A", False), ("alt", False)]))
        z.writestr("ek/EK-7.docx", docx([("giris", False), ("govde EK-80 geçer", False)]))
        z.writestr("ek-9-b.docx", docx([("önce", False), ("(Değişik:RG-1/1/2020-1) EK 77/A", False), ("sonra", False)]))
        z.writestr("ek-3.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1...")
    b = office.read_archive(spark, str(tmp_path / "x.zip"))
    assert b.where("warning is not null").count() == 1
    made, table = annex.units(b), "\nTABLE | h | "
    u = {r.annex: r for r in made.collect()}
    assert set(u) == {"48", "48/A", "7", "9/B", "77/A", "3"}
    assert u["48"].canonical == "EK 48 kopya.docx" and u["48"].relation == "EXACT_DUPLICATE" and u["48"].rendered == "EK-48\nmetin"
    assert u["48/A"].relation == "SINGLE" and u["48/A"].rendered == "EK-48/A\nalt" + table
    assert u["7"].rendered == "giris\ngovde EK-80 geçer" + table and u["9/B"].rendered == "önce" and u["77/A"].rendered.endswith("EK 77/A\nsonra" + table)
    c = annex.chunks(b, 8).orderBy("annex", "chunk_no").collect()
    assert "".join(r.text for r in c if r.annex == "48/A") == "EK-48/A\nalt" + table and all(r.char_end - r.char_start == len(r.text) for r in c)
    d = annex.diagnostics(b, made).first()
    assert (d.members, d.units, d.multi_source, d.empty, d.unresolved, d.storage_collisions, d.failures, d.unreadable) == (5, 6, 1, 1, 0, 0, 1, 1)
    assert d.readers == {"docx": 3, "rtf": 1, "legacy_doc": 1} and d.provenance and not d.normalization
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("kopya.docx", docx([("EK-48", False)]))
    with pytest.raises(Exception, match="no annex label"):
        annex.units(office.read_archive(spark, str(tmp_path / "y.zip"))).collect()


def test_annex_relations_and_chunks(spark):
    rel = lambda *t: spark.range(1).select(annex.relation(F.array(*map(F.lit, t))).alias("r")).first().r
    assert rel("a") == "SINGLE" and rel("a b", "a b") == "EXACT_DUPLICATE" and rel("a  b ", "a b") == "WHITESPACE_EQUIVALENT"
    assert rel("Uzun METİN burada", "metin") == "STRUCTURALLY_EQUIVALENT"
    assert rel("Eski metin: x", "Yeni metin: y") == "CONFLICTING" and rel("Eski metin: x", "Yeni metin: y, mülga") == "COMPLEMENTARY"
    assert rel("bir", "iki") == "COMPLEMENTARY" and rel("bir", "") == "UNKNOWN"



def test_article_ids_and_numbers(spark):
    p = [("k", 0, "MADDE 42/i- metin", "5326"), ("k", 1, "Madde  7- x", "5326"), ("k", 2, "EK MADDE 1- y", "5326"), ("k", 3, "GEÇİCİ\tMADDE 2 – z", "5326"), ("k", 4, "MADDE 9/Ç- w", "5326"), ("k", 5, "5326 SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER", "5326"), ("k", 6, "Başlık", "5326"), ("k", 7, "Geçici Madde 1- v", "5326")]
    df = spark.createDataFrame(p, "document_id string, index int, text string, legislation_number string").withColumn("footnotes", F.lit(None).cast("array<int>"))
    got = [(r.article_no, r.article_type, r.article_id) for r in parsing.articles(df).orderBy("start").collect()]
    assert got == [("42/İ", "normal", "5326-madde-42-i-dotted"), ("7", "normal", "5326-madde-7"), ("1", "ek", "5326-ek-madde-1"), ("2", "gecici", "5326-gecici-madde-2"), ("9/Ç", "normal", "5326-madde-9-c-cedilla"), ("1", "islenemeyen_hukum", "5326-islenemeyen-hukum-gecici-madde-1")]


def test_files(spark, tmp_path):
    m = tmp_path / "m.json"
    m.write_text('[{"document_id":"a","title":"t","document_type":"k","local_file":"f","legislation_number":"5"}]')
    d = files.load_manifest(spark, str(m))
    c = spark.createDataFrame([("a", None), ("z", "5"), ("q", None)], "document_id string, legislation_number string")
    assert [r.display_title for r in embedding.display_title(c, d).orderBy("document_id").collect()] == ["5 Sayılı t", "q", "5 Sayılı t"]
    m.write_text('[{"document_id":"a","document_id":"b","title":"t","document_type":"k","local_file":"f"}]')
    with pytest.raises(ValueError, match="repeats a key"):
        files.load_manifest(spark, str(m))
    files.write_csv(spark.createDataFrame([(1, ["a", "b"])], "id long, v array<string>"), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfid,v") and "a | b" in (tmp_path / "o.csv").read_text()
    with pytest.raises(FileExistsError):
        files.write_json(d, str(tmp_path / "o.csv"), exclusive=True)


def test_embed_once_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "bir iki"), (2, "bir iki"), (3, "üç")], "id long, t string")
    e = embedding.embed_texts(df, "t", embedding.hash_projection(8))
    v = {r.id: r.embedding for r in e.collect()}
    assert v[1] == v[2] != v[3]
    e.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("query_id long, q array<float>").parquet(str(tmp_path / "in"))
    questions.answer_stream(s, e.select("id", F.col("embedding").alias("v")), 1, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.query_id: r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == 2 and got[2] == 1


def test_what_spark_infers_stays_behind_the_spread(spark, tmp_path):
    spark.range(5).selectExpr("id as doc_id", "'a b' as text").coalesce(1).write.parquet(str(tmp_path / "d"))
    d = retrieval.spread(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", F.explode(T.tokens("text")).alias("term"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert d.count() == 10 and "regexp_extract_all" not in plan[plan.index("Repartition") :]


def test_vectors_as_rows():
    import pyarrow as pa

    c = pa.chunked_array([pa.array([[9.0, 9.0], [1.0, 2.0]])[1:], pa.array([[3.0, 4.0], [5.0, 6.0]])])
    assert retrieval._matrix(c).tolist() == [[1, 2], [3, 4], [5, 6]]


def test_rtf_runs_of_plain_bytes_are_one_step():
    assert office._RTF.findall(b"plain words here\\par more")[0][-1] == b"plain words here"
    assert office.rtf_text(b"{\\rtf1 a\\uc2\\u351xyz\\uc1 \\u304?b\\fonttbl no}{c\\'e9\x81\\par d}") == "aşzİbcé�\nd"


def test_statutes_flatten_a_text_once(spark):
    from lexmill.plans import evaluations

    plan = evaluations._statutes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z]+" in plan[plan.index("Generate") :] and "[^a-z]+" not in plan[: plan.index("Generate")]
