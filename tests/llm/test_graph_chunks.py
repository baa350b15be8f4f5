import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import chunks, graph
from lexmill.llm import common as C


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3), (5, None), (1, 2), (2, 1)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_stars_are_gathered_nowhere(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_KEYS", 4)  # so that the star's centre is hot and most nodes aren't
    edges = [(0, k) for k in range(1, 300)] + [(5000 + k, 5001 + k) for k in range(30)] + [(299, 5000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 for x in [*range(300), *range(5000, 5031)]}
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0), (3, 1)], "key long, x long")
    table = rows.groupBy("key").agg(F.count("*").alias("rows_of_key"), F.max("x").alias("most")).where("key < 3")
    out = sorted(map(tuple, C.spread_lookup(rows, "key", table, 52).select("key", "x", "most").collect()))
    assert out == sorted([(1, k, 49) for k in range(50)] + [(2, 0, 0), (3, 1, None)], key=lambda r: r[:2])


def test_sums_are_exact_beyond_32_bits():
    at, n = np.array([1, 0, 1, 0]), np.array([2**40, 3, 2**60 + 1, 2**33], np.uint64)
    assert chunks.add_up(at, n).tolist() == [2**33 + 3, 2**40 + 2**60 + 1]


def test_packing_is_lossless():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**64, 999, dtype=np.uint64))
    a = np.unique(np.r_[a, np.uint64(0), np.uint64(2**64 - 1)])
    assert (C.unpack_sorted(C.pack_sorted(a)) == a).all() and len(C.unpack_sorted(C.pack_sorted(a[:0]))) == 0
    assert (C.unpack_planes(C.pack_planes(a), np.uint64) == a).all()
    t = chunks.packets(3, 7, a, np.arange(len(a), dtype=np.uint32))
    assert (np.concatenate([C.unpack_sorted(x) for x in t.column("hashes").to_pylist()]) == a).all()


def test_totals_answer_in_order(spark):
    rng = np.random.default_rng(1)
    sent, want = [], Counter()
    for k in range(5):
        h, n = np.unique(rng.integers(0, 300, 200).astype(np.uint64) * np.uint64(2**55), return_counts=True)
        sent.append((h, n))
        want.update(dict(zip(h.tolist(), n.tolist(), strict=True)))
    rows = [r for k, (h, n) in enumerate(sent) for r in chunks.packets(k, 4, h, n.astype(np.uint64)).to_pylist()]
    df = spark.createDataFrame([(r["range"], r["chunk"], r["hashes"], r["c0"]) for r in rows], chunks.PACKETS + ", c0 binary")
    t = chunks.totals(df).toArrow()
    for k, (h, _) in enumerate(sent):
        mine = t.filter(np.array([x == k for x in t.column("chunk").to_pylist()]))
        assert chunks.reply(mine, "r0", np.uint64).tolist() == [want[x] for x in h.tolist()]


def test_window_hashes_tell_sequences_apart():
    w = [b"a", b"b", b"a", b"b", b"a", b"c"] * 6
    h = C.hash_words(w)
    for k in (1, 2, 3, 5, 7, 20):
        got = C.window_hashes(h, k)
        names = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        assert len(got) == len(names) and len(set(got.tolist())) == len(set(names))
        assert len({(x, y) for x, y in zip(got.tolist(), names, strict=True)}) == len(set(names))
    assert len(C.window_hashes(h[:3], 5)) == 0
