import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import answering, citations, embedding, evaluation, providers, retrieval
from lexmill.sources import shared


def three(text):
    return [[float(len(text)), 1.0, 0.0]], 7


def test_one_vector_a_question():
    assert providers.one_vector(three, "ab") == ([2.0, 1.0, 0.0], 7)
    assert providers.one_vector(lambda t: ([[1]], True), "x") == ([1.0], None)
    for bad in (lambda t: ([], 1), lambda t: ([[1.0], [2.0]], 1), lambda t: ([[]], 1), lambda t: ([[float("nan")]], 1), lambda t: ([[True]], 1), lambda t: ([["x"]], 1)):
        with pytest.raises(ValueError):
            providers.one_vector(bad, "x")
    for blank in (None, "", "  "):
        with pytest.raises(ValueError, match="empty"):
            providers.one_vector(three, blank)


def test_questions_to_answers(spark):
    questions = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "x" * 50)], "query_id long, question string")
    chunks = spark.createDataFrame([(10, "two", "5326", "1", "T", [2.0, 1.0, 0.0]), (11, "four", None, "2/a", None, [4.0, 1.0, 0.0]), (12, "five", "", None, "U", [5.0, 1.0, 0.0])], "id long, text string, legislation_number string, article_no string, article_title string, v array<double>")
    found = providers.retrieve(questions, chunks, three, 2)
    r = {x.query_id: x for x in found.collect()}
    assert [x.id for x in r[1].results] == [10, 11] and [x.id for x in r[2].results] == [11, 12] and (r[1].requested, r[1].returned, r[1].metric, r[1].tokens) == (2, 2, "l2", 7)
    seen = found.select("query_id", answering.context_of("results", answering.header_fields(found)).alias("c")).where("query_id = 2").first().c
    assert seen == "[KAYNAK 1]\nchunk_id: 11\nmadde: 2/a\n\nfour\n\n[KAYNAK 2]\nchunk_id: 12\nbaşlık: U\n\nfive"

    def call(instructions, messages, temperature):
        if temperature is not None:
            raise providers.TemperatureRefused
        assert [m["role"] for m in messages] == ["user", "user"] and messages[0]["content"].startswith("SORU:\n") and messages[1]["content"].endswith("five") | messages[1]["content"].endswith("four")
        return providers.Reply("DURUM: YETERLI\nCEVAP: x [KAYNAK 2] [KAYNAK 2]", 5, "many", None)

    made = providers.generate(found, call, temperature=0.5)
    g = {x.query_id: x for x in answering.cross_checked(found, made).collect()}
    assert [c.id for c in g[1].citations] == [11] and (g[1].input_tokens, g[1].output_tokens, g[1].total_tokens, g[1].retried) == (5, None, None, True)
    none = providers.generate(found.withColumn("results", F.slice("results", 1, 0)), call).first()
    assert none.answer == answering.INSUFFICIENT and none.input_tokens is None and not none.retried
    with pytest.raises(Exception, match="TemperatureRefused"):
        providers.generate(found, lambda i, m, t: (_ for _ in ()).throw(providers.TemperatureRefused())).collect()
    with pytest.raises(Exception, match="without text"):
        providers.generate(found, lambda i, m, t: providers.Reply(" ")).collect()
    for bad in (0, True, -1, 1.5):
        with pytest.raises(ValueError):
            providers.retrieve(questions, chunks, three, bad)


def test_calls_in_flight_are_bounded_and_in_order():
    import threading
    import time

    now, most, lock = [0], [0], threading.Lock()

    def run(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01 * (5 - k % 5))
        with lock:
            now[0] -= 1
        return k

    assert providers._each(run, [(k,) for k in range(20)], 3) == list(range(20)) and 1 < most[0] <= 3


def test_paid_calls_are_made_once(spark, tmp_path):
    b = spark.createDataFrame([(k // 3, k, f"c{k}", f"text {k}") for k in range(8)], "batch long, position long, id string, text string")
    root, log = str(tmp_path / "paid"), str(tmp_path / "log")

    def call(texts):
        with open(log, "a") as f:
            f.write("x")
        return [[float(t.split()[1])] for t in texts], len(texts)

    first = {r.id: (r.batch, r.vector, r.tokens) for r in providers.paid(b, root, call).collect()}
    assert first["c7"] == (2, [7.0], 2) and open(log).read() == "xxx"
    assert {r.id: (r.batch, r.vector, r.tokens) for r in providers.paid(b, root, call).collect()} == first and open(log).read() == "xxx"
    # lost between note and result: nobody knows whether it was paid
    (tmp_path / "paid" / "batch-000000001.json").unlink()
    with pytest.raises(Exception, match="batch 1 was begun and has no result"):
        providers.paid(b, root, call).collect()
    assert open(log).read() == "xxx"
    # lost before the note: it is called
    (tmp_path / "paid" / "batch-000000001.attempt.json").unlink()
    assert providers.paid(b, root, call).count() == 8 and open(log).read() == "xxxx"
    with pytest.raises(Exception, match="other inputs"):
        providers.paid(b.withColumn("text", F.concat("text", F.lit(" y"))), root, call).collect()
    with pytest.raises(Exception, match="vectors for"):
        providers.paid(b.withColumn("batch", F.col("batch") + 100), root, lambda t: ([], 0)).collect()
    assert json.loads(shared.read(f"{root}/batch-000000000.json"))["ids"] == ["c0", "c1", "c2"]


def test_citations_against_the_registry(spark):
    registry = spark.createDataFrame([("a", "A", "law", "1", "a.docx"), ("b", "B", "law", None, "b.docx")], "document_id string, title string, document_type string, legislation_number string, local_file string")
    good = spark.createDataFrame([(1, 1, "c", "a", "normal", "5/A", "1", "a.docx"), (1, 2, "d", "b", "ek", "1", "7", None)], "answer_id long, rank int, chunk_id string, document_id string, article_type string, article_no string, legislation_number string, source_file string")
    assert [(r.source_key, r.document_title) for r in citations.registered(good, registry).orderBy("rank").collect()] == [("a/normal/5/a", "A"), ("b/ek/1", "B")]
    for column, value, why in (("document_id", "z", "not in the manifest"), ("legislation_number", "2", "contradicts"), ("source_file", "none", "a file that is not"), ("source_file", "b.docx", "another document")):
        with pytest.raises(Exception, match=why):
            citations.registered(good.where("rank = 1").withColumn(column, F.lit(value)), registry).collect()


def test_exact_ranks(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(4)), float(rng.randrange(4)), 1.0], i % 3, rng.randrange(9)) for i in range(80)]
    c = spark.createDataFrame(rows, "id long, v array<double>, document long, key long")
    q = spark.createDataFrame([(i, v, d) for i, v, d, _ in rows[:12]], "query_id long, q array<double>, document long")
    gold = spark.createDataFrame([(i, k) for i in range(12) for k in (i % 9, (i + 4) % 9, 77)], "query_id long, key long")
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 15)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    for metric in ("l2", "cosine"):
        got = {(r.query_id, r.key): (r.rank, r.candidates) for r in retrieval.exact_ranks(q, c, gold, metric).collect()}
        for i, v, d, _ in rows[:12]:
            def far(w, v=v):
                if metric == "l2":
                    return round(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), 9)
                return round(1 - sum(x * y for x, y in zip(v, w, strict=True)) / (sum(x * x for x in v) ** 0.5 * sum(x * x for x in w) ** 0.5), 9)
            order = sorted((far(w), j, k) for j, w, e, k in rows if e == d and j != i)
            for k in (i % 9, (i + 4) % 9, 77):
                at = [n for n, x in enumerate(order, 1) if x[2] == k]
                assert got[i, k] == ((at[0], len(order)) if at else (None, None)), (metric, i, k)


def test_best_lines(spark):
    chunks = spark.createDataFrame([(1, "alpha beta\r\nbeta gamma delta\ngamma beta delta\n"), (2, ""), (3, "nothing here\nat all"), (4, None), (5, "\nthe alpha")], "id long, text string")
    asked = spark.createDataFrame([(7, "The GAMMA delta beta?", i) for i in range(1, 6)], "query_id long, question string, id long")
    got = {r.id: (r.line_no, r.line, r.shared) for r in evaluation.best_lines(asked, chunks, ("the",)).collect()}
    assert got == {1: (2, "beta gamma delta", ["beta", "delta", "gamma"]), 3: (1, "nothing here", []), 5: (1, "", [])}


def test_composition_equals_the_standard(spark):
    texts = [unicodedata.normalize("NFD", chr(c)) for c in range(0xA0, 0x3100) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    texts += [chr(c) for c in range(0xA0, 0x11FFF) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)] + [unicodedata.normalize("NFD", "한국어"), "plain", "", "a\u0323\u0307", "I\u0307THALAT"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i long, t string").repartition(3)
    got = {r.i: r.t for r in T.composed(df, "t").collect()}
    assert all(got[i] == unicodedata.normalize("NFC", t) for i, t in enumerate(texts)) and got[-1] is None
    assert not df.where("t = 'plain'").where(F.col("t").rlike(T.not_composed())).count()


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "a b", "<|endoftext|>", "Gümrük  vergisi\n", None]
    got = embedding.token_counts(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t", path, P.PATTERN).orderBy("i").collect()
    assert [r.tokens for r in got] == [len(enc.encode_ordinary(t or "")) for t in texts]
