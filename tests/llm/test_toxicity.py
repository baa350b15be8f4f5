import numpy as np

from lexmill.llm import toxicity as T


def corpus(n=400):
    rng = np.random.default_rng(5)
    plain = [f"w{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(n):
        ws = list(rng.choice(plain, 30))
        y = int(i % 8 == 0)
        if y:
            ws[int(rng.integers(30))] = str(rng.choice(["grumpf", "blarg,", "zonkingly", "zonkish"]))
        docs.append((i, " ".join(ws)))
        labels.append((i, y))
    return docs, labels


def test_finds_toxic_and_leaves_clean(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "w1 grumpf w2"), (902, "w1 " * 50_000 + "grumpf")], "doc_id long, text string")
    l = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = T.fit(d, l)
    got = {r.doc_id: r.score for r in T.score(d, model, ["doc_id"]).collect()}
    truth = dict(labels)
    assert len(got) == len(docs) + 4
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in truth.items()]) >= 0.98
    assert got[900] == got[901] < 0.5 and got[None] > 0.5 and got[902] > 0.5


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(160)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a = spark.createDataFrame(labels, "doc_id long, toxic int")
    b = a.withColumn("toxic", T.F.when(T.C.fold(T.F.col("doc_id")) == 0, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    assert T.fit(d, a).entries == T.fit(d, b).entries


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(d, none)
    assert [round(r.score, 6) for r in T.score(d, model, ["doc_id"]).collect()] == [0.0]
    assert T.score(d.limit(0), model, ["doc_id"]).count() == 0


def test_lexicon_is_the_same_for_any_partitions(spark):
    docs, labels = corpus(1600)
    rng = np.random.default_rng(6)
    y = dict(labels)
    # a neutral word of 6% of both classes; toxic rows come first, so most tasks hold clean ones only
    rows = sorted(((t + (" neutralo" if rng.random() < 0.06 else ""), y[i]) for i, t in docs), key=lambda r: -r[1])
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 200), "text string, toxic int")
    one, many = T.learn_lexicon(d.coalesce(1)), T.learn_lexicon(d)
    assert one == many and "grum*" in one and not any(x.startswith("neut") for x in one)


def test_every_entry_votes(spark):
    # 80 toxic words of 16 rows each
    rows = [(k, f"plain words here {k % 80:03d}toxic", 1) for k in range(1280)] + [(k, f"plain words here c{k % 7}", 0) for k in range(1280, 5280)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"), lambda doc_id: T.F.lit(True))
    assert len(model.entries) == 80
    got = {r.doc_id: r.score for r in T.score(d, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_posterior_and_pairs_of_votes():
    m = T.LabelModel(3)
    j = m.width
    m.w, m.b, m.b_none, m.rho = np.arange(1.0, j + 1), -1.0, -2.0, np.random.default_rng(2).random((j, j))
    np.fill_diagonal(m.rho, 0)
    ids = [[0, 2, 4], [], [1], [3, 5]]
    want = []
    for x in ids:
        z = sum(m.w[k] / (1 + sum(m.rho[k, l] for l in x)) for k in x) + (m.b if any(k < 3 for k in x) else m.b_none)
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(m.posterior(ids), want)


def test_sample_is_bounded_even_where_ids_are_null(spark):
    d = spark.createDataFrame([(None, [k]) for k in range(50)] + [(None, [1])] * 60, "doc_id long, ids array<int>")
    assert T.bounded(d, 25, 110).count() <= 25 and T.bounded(d, 25, 110).count() >= 10
    assert T.bounded(d, 200, 110).count() == 110


def test_clashing_columns_and_repeated_rows_keep_their_own(spark):
    docs, labels = corpus()
    rows = [(i, t, 0.25, "a", i) for i, t in docs] + [(1, docs[1][1], 0.25, "a", 1)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, toxicity double, whole_text string, `odd name` long")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.keep_clean(d, l)
    assert got.columns == d.columns
    out = got.collect()
    kept = {r.doc_id for r in out}
    assert np.mean([(i in kept) == (not y) for i, y in labels]) >= 0.98 and sum(r.doc_id == 1 for r in out) == 3
    assert all(r.toxicity == 0.25 and r.whole_text == "a" and r["odd name"] == r.doc_id for r in out)


def test_query_folds(spark, tmp_path):
    docs, labels = corpus(800)
    spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    import zlib

    got = {r.doc_id: r for r in T.query(spark, str(tmp_path)).collect()}
    assert len(got) == 800
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, y in labels if got[i].held_out]) >= 0.95


def test_linear_classifier_reaches_the_minimum():
    rng = np.random.default_rng(3)
    ids = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(200)]
    y = rng.random(200)
    w, b = T.fit_linear(ids, y, 6, l2=0.0)
    p = 1 / (1 + np.exp(-np.array([b + sum(w[k] for k in x) for x in ids])))
    assert abs((p - y).mean()) < 1e-4  # the gradient is zero there
    assert all(abs(sum((p[i] - y[i]) for i, x in enumerate(ids) if k in x)) / 200 < 1e-3 for k in range(6))


def test_label_model_recovers_accuracies_of_independent_voters():
    rng = np.random.default_rng(4)
    n, p = 20_000, np.array([0.7, 0.5, 0.6])
    y = rng.random(n) < 0.3
    votes = rng.random((n, 3)) < np.where(y[:, None], p, 0.02)
    s = np.zeros((2, 2 + 3 + len(T.PATTERNS) + (3 + len(T.PATTERNS)) ** 2))
    j = 3 + len(T.PATTERNS)
    for c, of in ((0, ~y), (1, y)):
        v = np.pad(votes[of].astype(float), ((0, 0), (0, j - 3)))
        s[c] = [len(v), *v.sum(0), *(v.T @ v).ravel(), (v.sum(1) == 0).sum()]
    m = T.LabelModel(3)
    m.set(s)
    assert np.allclose(m.mu[1, :3], p, atol=0.02) and np.allclose(m.mu[0, :3], 0.02, atol=0.01) and abs(m.prior - 0.3) < 0.02
    got = m.posterior([[k for k in range(3) if v[k]] for v in votes])
    assert ((got > 0.5) == y).mean() > 0.93
