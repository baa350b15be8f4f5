import numpy as np

from lexmill.llm import forest as A


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    x = (centers[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:400] = x[100]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 3), (5003, [float("nan")] * 16), (5004, [None] + [1.0] * 15), (5005, [float("inf")] * 16), (7, rows[7][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").repartition(4)
    points = A.valid(df, "vec_id", "embedding")
    got = A.Forest(points, 10).search(A.asked(points, 50)).collect()
    hits = total = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
        total += 10
        if 100 <= q < 400:
            assert [r.vec_id for r in mine] == [i for i in range(100, 112) if i != q][:10]
    assert hits / total >= 0.9


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    p = A.valid(df, "vec_id", "embedding")
    got = A.Forest(p, 10).search(p.where("id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(2, 1.0), (1, round(2**0.5, 6))]
    none = A.valid(df.limit(0), "vec_id", "embedding")
    assert A.Forest(none, 10).search(none).count() == 0


def test_layout_visits_enough():
    counts = np.zeros((1, 1 << A.COARSE), np.int64)
    counts[0, :3] = [5, 1, 90_000]
    layout = A.Layout(counts)
    assert layout.shard[0, 2] in layout.visited(0, 2, 50_000) and len(layout.visited(0, 0, 1)) == 1
    assert set(layout.visited(0, 0, 10**9)) == set(range(layout.n))


def test_recall_on_the_test_table(spark):
    import os

    import pytest

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    points = A.valid(df, "vec_id", "embedding")
    got = {}
    for r in A.Forest(points, 10).search(A.asked(points, 100)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        hits += len(got[q] & {int(i) for i in ids[np.lexsort((ids, d))] if i != q and len(got[q]) == 10 and d[ids == i][0] <= np.sort(d[ids != q])[9]})
    assert len(got) == sum(i % 100 == 0 for i in ids) and hits / (10 * len(got)) >= 0.9


def test_recall_on_queries_that_were_no_trials(spark):
    """What the number of candidates was fitted on doesn't count: four queries in five, at least, are others."""
    import os

    import pytest
    from pyspark.sql import functions as F

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    points = A.valid(spark.read.parquet(path), "vec_id", "embedding")
    rows = points.collect()
    ids, x = np.array([r.id for r in rows]), A.matrix(spark.createDataFrame(rows, points.schema).toArrow().column("vec"))
    queries = A.asked(points, 4)
    share = A.TRIALS / queries.count()
    held = {r.id for r in queries.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) >= int(share * 1_000_000) + 1).collect()}
    assert len(held) > 0.7 * queries.count()
    got = {}
    for r in A.Forest(points, 10).search(queries).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in held:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        near = [int(i) for i in ids[np.argsort(d, kind="stable")] if i != q][:10]
        hits += len(got[q] & set(near))
    assert hits / (10 * len(held)) >= 0.9


def test_clashing_columns_and_two_vectors_of_one_id(spark):
    rows = [(100, [1.0, 0.0], 1, [9.0]), (100, [0.5, 0.0], 1, [9.0]), (1, [1.0, 0.1], 2, [9.0]), (2, [0.0, 5.0], 3, [9.0])]
    p = A.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, vec array<double>"), "vec_id", "embedding")
    assert p.count() == 4
    got = A.Forest(p, 10).search(A.asked(p, 100)).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(100, 1), (100, 2)]
