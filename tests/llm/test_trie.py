import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexmill.llm import trie as T


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, md5(md5(y[1]) + md5(y[2]))))] for c, x in own.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + x[h:])
    return out


def brute(rows):
    """Nodes by their prefixes."""
    convs = plain_rebuilt(rows)
    members = defaultdict(list)
    for c, x in sorted(convs.items()):
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        kids = [q for q in out if len(q) == len(p) + 1 and q[:-1] == p]
        leaves = sum(out[q][5] for q in kids) or 1
        saved = sum(out[q][6] for q in kids) + ((n - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in members[p] if convs[c] == p)
        out[p] = (members[p][0], len(p), members[p[:-1]][0] if p else None, n, len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    says = ["", "a", "bb", "é", "long text", None]
    rows = []
    for c in [rng.randrange(-40, 200) for _ in range(n)]:
        kind = rng.random()
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, t if kind < 0.8 else rng.choice([None, 1, 2]), rng.choice(["user", None]) if kind < 0.3 else "user", "a" if kind < 0.6 else rng.choice(says)))
    return [*rows, rows[0], (None, 1, "user", "nobody's")]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, keys string, block int")
    return sorted(map(tuple, T.trie(df.repartition(3)).collect()), key=repr)


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 1), (3, 200), (4, 60), (5, 120)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_one_conversation_many_times_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 400)
    rows = [(c, t, "user", f"turn {t}") for c in range(100) for t in range(12)] + [(1000 + c, 0, "user", "turn 0" if c % 2 else "other") for c in range(40)]
    assert got(spark, rows) == brute(rows)


def test_blocks_by_themselves():
    """The stack over blocks gives what one block gives, wherever the blocks are cut."""
    rng = random.Random(9)
    for _ in range(60):
        seqs = sorted((tuple(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 6]))), c) for c in rng.sample(range(1000), rng.randrange(1, 14)))
        cuts = sorted(rng.sample(range(1, len(seqs)), min(len(seqs) - 1, rng.randrange(0, 5)))) if len(seqs) > 1 else []
        nodes, summaries = [], []
        for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(seqs)], strict=True)):
            part = seqs[i:j]
            for b in T.block_of(k, np.array([c for _, c in part]), [b"".join(hashlib.md5(x.encode()).digest() for x in s) for s, _ in part], [[1 + (x == "b") for x in s] for s, _ in part]):
                for r in b.to_pylist():
                    if r["summary"]:
                        summaries.append((k, r["summary"]))
                    elif r["depth"] is not None:
                        nodes.append(r)
        whole = [r for b in T.whole_of(iter(summaries)) for r in b.to_pylist()]
        up = {(r["block"], r["below"]): r["conv_id"] for r in whole if r["kind"] == "name"}
        all_ = [(r["conv_id"], r["depth"], r["parent_conv_id"] if r.get("below") is None else up[r["block"], r["below"]], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in [*nodes, *(r for r in whole if r["kind"] == "node")]]
        want = defaultdict(list)
        for s, c in seqs:
            for d in range(len(s) + 1):
                want[s[:d]].append(c)
        assert sorted(x[:2] + x[3:5] for x in all_) == sorted((min(m), len(p), len(m), len({s[len(p)] for s, _ in seqs if s[: len(p)] == p and len(s) > len(p)})) for p, m in want.items())


def test_empty_table_and_a_single_turn(spark):
    assert T.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    rows = [(5, None, None, None)]
    assert got(spark, rows) == brute(rows)
