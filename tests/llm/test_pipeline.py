import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

from tests.llm import test_jaccard, test_mixing, test_substring  # noqa: E402


def fixture(spark, tmp_path):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    docs, labels = [], []
    for i in range(240):
        w = [rng.choice(vocab) for _ in range(rng.randrange(30, 90))]
        toxic = int(i % 9 == 0)
        if toxic:
            w[3] = rng.choice(["grumpf", "zonkish"])
        text = " ".join(w)
        if i % 20 == 5:
            text += " " + passage
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    near = docs[1][1].split()
    near[-1] = "changed"
    docs += [(300, " ".join(near), "en", "src0", 1), (301, docs[2][1], "en", "src1", 1), (302, None, None, None, None), (302, None, None, None, None), (None, "no id here", "de", "src2", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return passage


def test_stages_equal_brute_force(spark, tmp_path):
    passage = fixture(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, out = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, str(tmp_path))
        got.write.parquet(str(tmp_path / f"s{k}"))
        out[name] = (docs.collect(), spark.read.parquet(str(tmp_path / f"s{k}")).collect())
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert k + 1 == len(P.STAGES) or docs.columns == columns
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=repr)
    before, after = out["toxicity"]
    assert key(after) == key([r for r in before if not {"grumpf", "zonkish"} & set((r.text or "").split())])
    before, after = out["near_copies"]
    classes = test_jaccard.brute([(r.doc_id, r.text) for r in before], P.SHINGLE, P.SIMILAR, 100)
    assert sorted({r.doc_id for r in after}, key=repr) == sorted({d for d, _, c in classes if d == c or d is None}, key=repr)
    assert len(after) == len({(r.doc_id, r.text) for r in after})
    before, after = out["substring_dedup"]
    cut = {d: (n, gone, kept) for d, n, gone, kept in test_substring.brute([(r.doc_id, r.text) for r in before], P.PASSAGE)}
    assert key(after) == key([r if not cut[r.doc_id][1] else r.__class__(doc_id=r.doc_id, text=cut[r.doc_id][2]) for r in before])
    assert sum(passage in (r.text or "") for r in after) == 1
    before, after = out["mixing"]
    m = P.mixing
    rows = [(r.doc_id, r.text, r.lang, r.source, domain(r.source)) for r in before]
    want = test_mixing.brute(rows, P.FRACTION, P.EPOCHS, m.SEED, {"domain": m.DOMAIN_WEIGHTS, "language": m.LANGUAGE_WEIGHTS, "source": m.SOURCE_WEIGHTS})
    assert sorted((r.doc_id for r in after), key=repr) == sorted((d for d, *_, n in want if n), key=repr)
    before, after = out["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert P.run(spark, str(tmp_path)).count() == len(after)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    names = ["text_md5", "kept_id", "cut_text", "mix_nth", "toxicity", "whole_text", "h", "part", "heads", "chunk"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "e")).count() == 0
    fixture(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n in names:
        docs = docs.withColumn(n, P.common.F.lit(f"own {n}"))
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert kept and all(r[n] == f"own {n}" for r in kept for n in names), name
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in docs.collect()}


def domain(source):
    import hashlib

    return f"d{int(hashlib.md5((source or '').encode()).hexdigest()[0], 16) % P.mixing.DOMAINS}"
