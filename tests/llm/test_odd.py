import random

import numpy as np
import pytest

from lexmill.llm import odd as O
from tests.llm.test_jaccard import brute, corpus


def got(spark, rows, k, num, parts=4):
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, node string, chunk int").repartition(parts)
    return sorted((tuple(r) for r in O.classes(df, k, num, 100).collect()), key=repr)


def wanted(rows, k, num):
    return sorted(((*r, r[0] == r[2]) for r in brute(rows, k, num, 100)), key=repr)


@pytest.mark.parametrize(("k", "num"), [(2, 80), (5, 80), (1, 60), (3, 100)])
def test_equals_brute_force(spark, k, num):
    rows = corpus(k)
    assert got(spark, rows, k, num) == wanted(rows, k, num)


def chain(seed):
    """Texts each of which is like the next only, and groups that are like each other but not enough."""
    rng, rows = random.Random(seed), []
    for g in range(6):
        w = [f"g{g}w{i}" for i in range(60)]
        for i in range(40):
            rows.append((g * 100 + i, " ".join(w)))
            if g % 2:
                w = w[2:] + [f"g{g}n{i}a", f"g{g}n{i}b"]
            else:
                w = w[: 40 + g] + [f"g{g}r{rng.randrange(9)}x{j}" for j in range(14)]
    return rows


@pytest.mark.parametrize("few", [0, 20_000])
def test_hot_buckets_and_refused_edges_in_tiles(spark, monkeypatch, few):
    monkeypatch.setattr(O, "TILE", 8)
    monkeypatch.setattr(O, "FEW", few)
    for rows in (chain(1), corpus(4)):
        assert got(spark, rows, 2, 80) == wanted(rows, 2, 80)


def test_plan():
    bands, rows, most = O.plan(80, 100)
    assert (1 - 0.8**rows) ** bands <= O.LOST and bands * rows <= O.SAMPLES and most % 2 == 0
    rng = np.random.default_rng(1)
    assert (rng.binomial(bands * rows, 0.2, 200_000) * 2 <= most).all()
    assert O.plan(100, 100) == (1, 32, 0)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    n = 265
    for want in (0.95, 0.9, 0.8, 0.7):
        got = []
        for _ in range(40):
            common, each = int(400 * want), int(400 * (1 - want) / 2)
            x = rng.integers(0, 2**63, common + 2 * each).astype(np.uint64)
            m = O.samples([x[: common + each], np.r_[x[:common], x[common + each :]]], n)
            same = (m[0] == m[1]).mean()
            s = O.sketch_of(m)
            assert O.differ(s[0], s[1]) <= 2 * round(n * (1 - same))
            got.append(float(O.estimate(O.differ(s[0], s[1]), n)))
        assert abs(np.mean(got) - want) < 0.02


def test_trees_span_the_graph():
    rng = np.random.default_rng(2)
    for _ in range(30):
        s = np.cumsum(rng.integers(0, 2, (25, 1)), axis=0).astype(np.uint64)
        s = (np.uint64(1) << s) - np.uint64(1)  # a line
        edges = O.trees(s, 2)
        assert len(edges) == 24 and {j for e in edges for j in e} == set(range(25))
    far = np.array([[0], [0xFF], [0xFFFF]], np.uint64)
    assert O.trees(far, 4) == [] and len(O.trees(far, 8)) == 2


def test_empty_table(spark):
    assert O.classes(spark.createDataFrame([], "doc_id long, text string"), 2, 80, 100).count() == 0
