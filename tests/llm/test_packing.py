import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
from lexmill.llm import packing as P  # noqa: E402


def test_pieces_cover_documents_and_windows(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 900)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "null id"), (102, "long " * 7000), (103, "a b"), (103, "c d e")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(P, "SHARD", 10_000)
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    tok = Tokenizer.from_file(path)
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for (_, n), rs in pieces.items():
        rs.sort(key=lambda r: r.start)
        assert [r.start for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1]] and sum(r.length for r in rs) == n
    for rs in windows.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1]]
        total = sum(r.length for r in rs)
        assert total == P.WINDOW or total < P.WINDOW and total & (total - 1) == 0
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_texts_of_white_space(spark):
    from tests.llm.test_token_store import WHITE

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a normal text", *WHITE, "another", "b", *(f"x{w}" for w in WHITE), "\u00a0"]
    tok = Tokenizer.from_file(path)
    got = P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()
    assert sorted((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got if r.length == r.doc_tokens and r.start == 0) == [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in enumerate(texts) for ids in [[*tok.encode(t, add_special_tokens=False).ids, 1]] if any(r.doc_id == i and r.length == r.doc_tokens for r in got)]
    assert sum(r.length == r.doc_tokens for r in got) > 60


def test_index_scores_are_bm25_and_best_neighbour_follows():
    tails = [np.array(x, "<u4") for x in ([5, 6, 7, 7], [1, 2, 3], [7, 7, 7, 2], [5, 6, 9])]
    n, mean = 4, np.mean([len(x) for x in tails])
    df = np.array([sum(k in x for x in tails) for k in range(10)])
    index = P.Index(tails, n, mean, df)
    want = []
    for x in tails:
        s = 0.0
        for t in set(tails[0].tolist()):
            tf = int((x == t).sum())
            s += np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(x) / mean))
        want.append(s)
    assert np.allclose(index.score(tails[0]), want, atol=1e-5)
    near = [u for u in np.argsort(-np.array(want)) if u != 0]
    first = P.fill(tails, index, window=7)[0]
    assert [u for u, _, _ in first][:2] == [0, near[0]]


def test_long_documents_take_part_by_their_whole_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    topic, rest = "zebra quagga okapi giraffe ", "plain other filler words "
    rows = [(1, topic * 600 + rest * 200), (2, "some thing else"), (3, "one more line"), (4, topic * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(P.pack(df, path).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in got if r.length < P.WINDOW))
    assert abs(order.index(4) - order.index(1)) == 1
    made = P.units(df, path, "byte", 1)
    n, mean, counted, left = P.statistics(made)
    ids = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for _, t in rows]
    assert (n, mean, left) == (4, np.mean([len(x) for x in ids]), sum(len(x) % P.WINDOW for x in ids))
    assert all(counted[k] == sum(k in x for x in ids) for x in ids for k in x[:50])


def test_all_ids_score_and_all_scored_units_come_first():
    # ids 50 to 89 are the seed's alone and rarer than id 5, by which 300 units further on are its neighbours
    tails = [np.array([5, *range(50, 90)], "<u4"), *[np.array([9, 10], "<u4")] * 350, *(np.array([5, 100 + k], "<u4") for k in range(300))]
    df = np.bincount(np.concatenate(tails))
    index = P.Index(tails, len(tails), np.mean([len(x) for x in tails]), df)
    assert np.flatnonzero(index.score(tails[0])).tolist() == [0, *range(351, 651)]
    first = P.fill(tails, index, window=41 + 600)[0]
    assert [u for u, _, _ in first] == [0, *range(351, 651)]
    s = np.random.default_rng(1).integers(0, 40, 3000).astype(np.float32)
    assert list(P.ranked(s)) == [u for u in np.lexsort((np.arange(3000), -s)) if s[u]]


def plain_fill(tails, index, window):
    """Greedy filling as the docstring has it, with every ranking sorted whole."""
    left, out, seed = {u: 0 for u in range(len(tails))}, [], None
    while left:
        seed = seed if seed is not None else min(left)
        score = index.score(index.bags[seed][0])
        ranking = [seed, *sorted((u for u in left if u != seed and score[u] > 0), key=lambda u: (-score[u], u)), *sorted(u for u in left if u != seed and score[u] <= 0)]
        room, pieces, seed = window, [], None
        for u in ranking:
            n = min(room, len(tails[u]) - left[u])
            pieces.append((u, left[u], n))
            left[u] += n
            room -= n
            if left[u] == len(tails[u]):
                del left[u]
            else:
                seed = u
            if not room:
                break
        out.append(pieces)
    if (short := sum(n for _, _, n in out[-1])) < window:
        out += P._powers(out.pop(), short)
    return out


def test_fill_equals_plain_greedy_filling():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        tails = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u4") for _ in range(80)]
        tails += tails[:5]  # equal units: ties
        df = np.bincount(np.concatenate([np.unique(x) for x in tails]), minlength=41)
        index = P.Index(tails, len(tails), np.mean([len(x) for x in tails]), df)
        assert P.fill(tails, index, window=64) == plain_fill(tails, index, 64)


def test_neighbours_meet_in_many_shards(spark, monkeypatch):
    """Documents of one topic are dealt to the shard of their topic, however many shards there are; extra columns, repeated rows and ties do no harm."""
    import random

    rng = random.Random(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    common = [f"{a}{b}" for a in ("run", "walk", "talk") for b in ("ing", "ed", "er", "s")]
    topics = [[f"{a}{k}" for a in ("zebra", "quark", "fjord")] for k in range(40)]
    rows = [(k * 40 + t, " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(topics[t]) for _ in range(60)), 1, "x") for k in range(12) for t in range(40)]
    rows += [rows[0], rows[0]]
    monkeypatch.setattr(P, "SHARD", 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, head0 int, tail string").repartition(5)
    got = P.pack(docs, path).toPandas()
    assert (got.groupby(["doc_id"]).length.sum().loc[1] == got[got.doc_id == 1].doc_tokens.iloc[0]) and got.doc_id.nunique() == 480
    shard = got.assign(shard=got.sequence_id // (1 << 40) * 1000).groupby("doc_id").shard.first()
    assert shard.nunique() > 5
    topic = shard.groupby(shard.index % 40)
    assert topic.agg(lambda x: x.value_counts().iloc[0] / len(x)).mean() > 0.7


def test_heads_are_the_ids_that_weigh_most():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 30, rng.integers(1, 40)), return_counts=True) for _ in range(50)]
    df = np.bincount(np.concatenate([f for f, _ in docs]), minlength=31)
    df[7] = 1  # of one document only: no head
    n, mean = len(docs), np.mean([c.sum() for _, c in docs])
    idf = P.idf_of(n, df)
    got = P.heads_of([P.C.pack_planes(np.concatenate(x).astype("<u4")) for x in docs], mean, df, idf)
    for (found, tf), g in zip(docs, got.tolist(), strict=True):
        w = {int(i): idf[i] * c * (P.K1 + 1) / (c + P.K1 * (1 - P.B + P.B * tf.sum() / mean)) for i, c in zip(found, tf, strict=True) if df[i] > 1}
        best = sorted(w, key=lambda i: (-w[i], i))[:2]
        if len(best) == 2 and df[best[1]] < df[best[0]]:
            best.reverse()
        assert [g >> 32, g & (2**32 - 1)] == [*(i + 1 for i in best), 0, 0][:2]
