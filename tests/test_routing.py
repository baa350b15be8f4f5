import numpy as np

from lexmill.operators import routing


def test_route_in_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(routing, "QUESTIONS", 5)
    monkeypatch.setattr(routing, "CENTRES", 3)
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(12, 4)), rng.normal(size=(7, 4))
    c[6] = c[2]  # a tie, by name
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, q array<double>")
    centers = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(unit)], "name string, c array<double>")
    want = {}
    for i, v in enumerate(q):
        s = unit @ (v / np.linalg.norm(v))
        want[i] = sorted(range(7), key=lambda j: (-round(float(s[j]), 9), j))
    for k in (None, 2):
        got = {}
        for r in routing.route(queries, centers, "name", k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(int(r.name[1:]))
        assert got == {i: w[:k] for i, w in want.items()}
    assert routing.route(queries.limit(0), centers, "name").count() == 0 == routing.route(queries, centers.limit(0), "name").count()
    m = routing.margins(routing.route(queries, centers, "name", 2)).first()
    assert m.n == 12 and m.least >= -1e-9
