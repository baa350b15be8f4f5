import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import katz as K


def brute(docs, order):
    """The same model from plain counters; also p(w | h) as a function."""
    toks = {k: (t or "").lower().split() + ["</s>"] for k, (_, t) in enumerate(docs)}
    train = [k for k, (i, _) in enumerate(docs) if not K.held_out(i)]
    grams = [Counter() for _ in range(order + 1)]  # by order; a history that would reach before the start begins there

    def history(t, i, k):
        return tuple(["<s>", *t][max(0, i + 2 - k) : i + 1])

    for k in train:
        grams[1].update(toks[k])
    ctx = [Counter() for _ in range(order + 1)]
    followers = [defaultdict(list) for _ in range(order + 1)]
    for n in range(2, order + 1):
        grams[n] = Counter()
        for k in train:
            for i, w in enumerate(toks[k]):
                h = ("<s>",) if i == 0 else history(toks[k], i, n)
                grams[n][h, w] += 1
        for (h, w), c in grams[n].items():
            ctx[n][h] += c
            followers[n][h].append(w)
    uni, nn = grams[1], sum(grams[1].values())
    coc = lambda c: [sum(x == r for x in c.values()) for r in range(1, K.CUT + 2)]
    d = [None, *(K.discounts(coc(g)) for g in grams[1:])]
    cut = lambda t, r: t[r] if r <= K.CUT else 1.0
    total = nn if sum(cut(d[1], c) * c for c in uni.values()) < nn * (1 - 1e-12) else nn + 1
    unk = 1 - sum(cut(d[1], c) * c / total for c in uni.values())

    def p(w, h, n):
        if n == 1:
            return cut(d[1], uni[w]) * uni[w] / total if uni[w] else unk
        low = ("<s>",) if h == ("<s>",) else h[-(n - 2) :] if n > 2 else ()
        if not ctx[n][h]:
            return p(w, low, n - 1)
        given = sum(cut(d[n], grams[n][h, x]) * grams[n][h, x] for x in followers[n][h])
        t = ctx[n][h] if given < ctx[n][h] * (1 - 1e-12) else ctx[n][h] + 1
        if grams[n][h, w]:
            return cut(d[n], grams[n][h, w]) * grams[n][h, w] / t
        return (1 - given / t) / (1 - sum(p(x, low, n - 1) for x in followers[n][h])) * p(w, low, n - 1)

    rows = {}
    for k, (i, _) in enumerate(docs):
        t = toks[k]
        hs = [("<s>",) if j == 0 else history(t, j, order) for j in range(len(t))]
        rows[k] = (i, K.held_out(i), len(t), sum(uni[w] > 0 for w in t), nn, sum(math.log10((uni[w] + 0.5) / (nn + 0.5 * (len(uni) + 1))) for w in t), sum(math.log10(p(w, h, order)) for h, w in zip(hs, t)))
    return rows, p, uni, ctx


def docs():
    import random

    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(4000)]
    out = [(i, " ".join(words[rng.randrange(3000) :][: rng.randrange(1, 60)])) for i in range(90)]
    return [*out, (500, None), (501, ""), (502, "Unseen WORDS only zz yy"), (503, "w1 " * 400), (3, "w1 w2"), (None, "w1 nothing")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force_and_sums_to_one(spark, order):
    d = docs()
    want, p, uni, ctx = brute(d, order)
    for h in [("<s>",), *list(ctx[order])[:20], ("never",) * (order - 1)]:
        assert abs(sum(p(w, h, order) for w in [*uni, "an unknown word"]) - 1) < 1e-9
    df = spark.createDataFrame([(*r, 1, "x") for r in d], "doc_id long, text string, chunk int, word string")
    got = sorted((tuple(r) for r in K.score(df, 3000, order).collect()), key=repr)
    for a, b in zip(got, sorted(want.values(), key=repr), strict=True):
        assert a[:5] == b[:5]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:]))


def test_tables_hold_the_counts(spark):
    d = docs()
    _, _, uni, ctx = brute(d, 3)
    _, replies, model, _, used = K.fit(spark.createDataFrame(d, "doc_id long, text string"), 3, 3000, tables=True)
    t = K.Tables(replies)
    assert model.tokens == sum(uni.values())
    for w in [*list(uni)[:30], "never seen"]:
        assert t.count([w.encode()] if w != "</s>" else [None]) == uni[w]
    shared = 0
    for h in [x for x in ctx[3] if len(x) == 2 and x[0] != "<s>"][:200]:
        got = t.history([w.encode() for w in h])
        shared += got is not None
        assert got is None or got == ctx[3][h]
    assert shared > 20
    K.C.drop(*used)


def test_counts_pass_32_bits():
    sq = K.C.squeeze
    one = lambda x: sq(K.C.pack_planes(np.array([x], np.uint64)))
    t = pa.table({"range": [0, 0], "chunk": [0, 1], "history": [sq(K.C.pack_sorted(np.array([7], np.uint64)))] * 2, "followers": [one(1)] * 2, "word": [one(9)] * 2, "n": [one(x) for x in (2**40, 5)], "lower": [one(2**41)] * 2, "total": [one(2**42)] * 2, "stats": pa.array([None, None], pa.list_(pa.int64()))})
    r = K.count(t, 2, np.ones(K.CUT + 1), False).to_pylist()
    assert [int(K.C.unpack_planes(x["a"], np.uint64)[0]) for x in r] == [2 * (2**40 + 5) + 1] * 2
    assert np.frombuffer(r[0]["b"], np.float64, 1)[0] == 0.5 and int(K.C.unpack_planes(r[0]["b"][8:], np.uint64)[0]) == 2**40 + 5


def test_edges(spark):
    assert K.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if K.held_out(i))
    r = K.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
