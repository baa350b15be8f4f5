import random

import numpy as np
import pytest

from lexmill.operators import sequences as S


def fold(sizes, limit, joint, most, lone=True):
    out, g, total, n = [], -1, 0, 0
    for x in sizes:
        if g < 0 or total + joint + x > limit and (lone or total) or (most is not None and n >= most):
            g, total, n = g + 1, x, 1
        else:
            total, n = total + joint + x, n + 1
        out.append(g)
    return out


@pytest.mark.parametrize(("seed", "limit", "joint", "most", "rows"), [(1, 50, 0, 8, 7), (2, 50, 1, None, 5), (3, 10, 0, 3, 1), (4, 1000, 2, None, 9), (5, 30, 0, 2, 1000), (6, 0, 0, None, 4), (7, 200, 0, 100, 6)])
def test_cut_equals_the_fold(spark, seed, limit, joint, most, rows):
    rng = random.Random(seed)
    data = [(k, i, rng.choice([0, 1, 5, 20, 60])) for k in ("a", "b", None, "c", "d", "e") for i in range({"a": 60, "b": 1, None: 5, "c": 3}.get(k, 17))]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i long, s long")
    got = {(r.k, r.i): r.batch for r in S.cut(df, "k", "i", "s", limit, joint, most, rows=rows).collect()}
    assert len(got) == len(data)
    for k in {d[0] for d in data}:
        mine = sorted((i, s) for a, i, s in data if a == k)
        assert [got[k, i] for i, _ in mine] == fold([s for _, s in mine], limit, joint, most), k


def test_cut_of_one_key_of_all_rows(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9000, 3000).tolist()
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(sizes)], "k string, i long, s long")
    got = [r.batch for r in S.cut(df, "k", "i", "s", 20_000, most=8, rows=100).orderBy("i").collect()]
    assert got == fold(sizes, 20_000, 0, 8)
    with pytest.raises(Exception, match="a size outside 1..8192"):
        S.cut(df, "k", "i", "s", 20_000, allowed=(1, 8192), rows=100).collect()
    assert S.cut(df.limit(0), "k", "i", "s", 10).count() == 0


@pytest.mark.parametrize("rows", [1, 4, 30])
def test_empty_items_wait_for_what_follows(spark, rows):
    rng = random.Random(rows)
    sizes = [rng.choice([0, 0, 0, 3, 50]) for _ in range(90)]
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(sizes)], "k string, i long, s long")
    assert [r.batch for r in S.cut(df, "k", "i", "s", 9, lone=False, rows=rows).orderBy("i").collect()] == fold(sizes, 9, 0, None, False)


def test_doubling():
    rng = np.random.default_rng(1)
    for _ in range(50):
        nxt = S.next_starts(rng.integers(0, 9, 40), 12, 1, 5)
        last, count = S.doubled(nxt)
        for i in range(40):
            p, n = i, 1
            while nxt[p] < 40:
                p, n = int(nxt[p]), n + 1
            assert (last[i], count[i]) == (p, n)


def test_offsets_neighbours_gaps_and_islands(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None])) for i in rng.sample(range(500), 120)]
    df = spark.createDataFrame(data, "k string, i long, n long, x string")
    run = {r.i: (r.start, r.end) for r in S.running(df, "k", "i", "n", rows=10).collect()}
    before = {r.i: r.p for r in S.previous(df, "k", "i", "x", "p", rows=10).collect()}
    runs = {r.i: r.run for r in S.islands(df, "k", "i", "x", "run", rows=10).collect()}
    gaps = sorted(map(repr, ((r.k, r.gap_start, r.gap_end) for r in S.gaps(df, "k", "i", rows=10).collect())))
    want = []
    for k in ("a", "b", None):
        total, last, number = 0, None, 0
        for _, i, n, x in sorted((d for d in data if d[0] == k), key=lambda d: d[1]):
            assert run[i] == (total, total + (n or 0))
            total += n or 0
            assert before[i] == (last[1] if last else None)
            number += bool(last and last[1] != x)
            assert runs[i] == number
            if last and i > last[0] + 1:
                want.append(repr((k, last[0] + 1, i - 1)))
            last = (i, x)
    assert gaps == sorted(want)
