import random

import numpy as np
import pytest

from lexmill.llm import substring as S


def brute(rows, width):
    """Windows that also start earlier, by plain dictionaries; rows that repeat id and text are one document."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    seen, out = {}, {}
    words = {k: k[2].encode().split() for k in docs}
    for k in docs:
        w = words[k]
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if seen.setdefault(key, (k, i)) != (k, i):
                gone.update(range(i, i + width))
        out[k] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return sorted(((d, *out[d is not None, d or 0, t or ""]) for d, t in rows), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(4, 30))] for _ in range(5)]
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((rng.randrange(1000) - 500, " ".join(w) if i % 3 else "\n".join(w)))
    return [*rows, rows[3], (2000, None), (2001, ""), (None, "x y " * 40), (2002, "x y " * 3000), (2003, "é ü " * 9)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 300)
    for width, frequent in ((1, 50_000), (2, 30), (5, 50_000), (5, 20), (8, 3), (20, 50_000), (20, 12)):
        monkeypatch.setattr(S, "FREQUENT", frequent)
        rows = corpus(width)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.spans(df, width).collect()), key=repr)
        assert got == brute(rows, width)


def test_words_of_equal_upper_halves_of_their_hashes(spark):
    """n6848 and n16623 agree in the upper 32 bits: windows around them are told apart all the same."""
    from lexmill.llm import common as C

    a, b = C.hash_words([b"n6848", b"n16623"])
    assert a >> np.uint64(32) == b >> np.uint64(32)
    head, tail = " ".join(f"h{i}" for i in range(19)), " ".join(f"t{i}" for i in range(19))
    rows = [(1, f"{head} n6848 {tail}"), (2, f"{head} n16623 {tail}"), (3, f"{head} n6848 {tail}")]
    got = {r.doc_id: r.n_removed for r in S.spans(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert got == {1: 0, 2: 0, 3: 39}


def test_spans_are_maximal_and_cover_what_is_removed(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    for r in S.spans(df, 5).collect():
        assert sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed
        assert all(b < a for b, a in zip(r.ends, r.starts[1:], strict=False))


def test_deduplicate(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"head one\n{p}", "x", 9), (2, f"{p} tail", "x", 9), (3, p, "x", 9), (4, "short", "x", 9), (5, None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars long")
    got = {r.doc_id: r for r in S.deduplicate(df, 50).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == rows[0][1] and got[2].text == "tail" and got[2].n_chars == 4 and got[4].n_chars == 9
    assert S.spans(df.limit(0)).count() == 0


def test_subtree_has_the_nodes_of_the_suffix_tree():
    rng = random.Random(3)
    for _ in range(20):
        words = np.zeros((40, 6), np.uint32)
        for r in words:
            n = rng.randrange(1, 7)
            r[:n] = [rng.randrange(1, 3) for _ in range(n)]
        t = S.Subtree(words)
        assert [tuple(x) for x in words[t.order]] == sorted(map(tuple, words))
        # internal nodes by definition: prefixes of at least two rows that don't all go on alike
        want = set()
        for depth in range(1, 7):
            for p in {tuple(r[:depth]) for r in words}:
                rows = frozenset(i for i, r in enumerate(words) if tuple(r[:depth]) == p)
                if len(rows) > 1 and (depth == 6 or len({r[depth] for r in words[list(rows)]}) > 1):
                    want.add((depth, rows))
        got = t.nodes()
        assert {(d, frozenset(x)) for d, x in got} == want and len(got) == len(want)
        assert all(d >= 3 for d, _ in t.nodes(3))
        cut = t.below(4)
        assert all((cut[i] == cut[j]) == (tuple(words[i][:4]) == tuple(words[j][:4])) for i in range(40) for j in range(40))


def test_least_of():
    x = np.array([5, 3, 3, 9, 1, 1, 7, 2], np.uint64)
    for n in range(1, 9):
        assert S.least_of(x, n).tolist() == [min(range(i, i + n), key=lambda k: (x[k], k)) for i in range(8 - n + 1)]


def test_documents_without_an_id_and_the_least_one(spark):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{p} a"), (None, f"b {p}"), (None, f"{p} a"), (-(2**63), p), (5, f"{p} c")]
    got = S.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 10).collect()
    removed = {}
    for r in got:
        removed.setdefault(r.doc_id, set()).add((r.kept, r.n_removed))
    assert {n for x in removed[None] for n in [x[1]]} == {0, 30} and len(removed[None]) == 2
    assert removed[-(2**63)] == {("", 30)} and removed[5] == {("c", 30)}


@pytest.mark.parametrize("name", ["cut_id", "cut_md5", "cut_text", "text_md5", "kept"])
def test_clashing_columns_keep_their_own(spark, name):
    p = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, p, "own"), (2, f"{p} tail", "own")], f"doc_id long, text string, {name} string")
    assert sorted(map(tuple, S.deduplicate(df, 50).collect())) == [(1, p, "own"), (2, "tail", "own")]
