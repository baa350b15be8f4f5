import random

import numpy as np

from lexmill.llm import jaccard as J


def sets(text, k):
    w = J.C.words_of(text)
    return set() if not w else {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if len(w) >= k else {tuple(w)}


def brute(rows, k, num, den):
    s = [sets(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s[i]), least.get(root(i), d) if s[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(1, 80))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i * 3 % 500, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    return [*rows, (900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "a b"), (None, "a b"), (906, "x " * 3000), rows[0], rows[0]]


def test_equals_brute_force(spark):
    for k, num in ((3, 90), (5, 80), (2, 60)):
        rows = corpus(k)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((tuple(r) for r in J.join(df, k, num, 100).collect()), key=repr)
        assert got == brute(rows, k, num, 100)


def test_heavy_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "HEAVY", 6)
    monkeypatch.setattr(J, "TILE", 16)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in J.join(df, 3, 90, 100).collect()), key=repr) == brute(rows, 3, 90, 100)


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (3, "q w e r t y"), (3, "q w e r t y"), (4, None), (None, "z z z"), (5, "z z z")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, node string, root long")
    got = J.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, rows[0][1]), (3, "q w e r t y"), (5, "z z z")]
    assert got.count() == 4
    assert J.deduplicate(df.limit(0)).count() == 0 and J.join(df.limit(0)).count() == 0


def test_intersections():
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 90, 30)).astype(np.uint64) for _ in range(7)] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert J._intersections(a, b, 16).tolist() == want
