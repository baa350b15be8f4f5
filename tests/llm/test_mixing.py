import hashlib
import random
from collections import defaultdict

from lexmill.llm import mixing as M


def brute(rows, fraction, epochs, seed, weights):
    """Budgets by repeated dealing down a tree; prefixes by plain sorting."""
    keyed = [(i, (dom or "", lang or "", src or ""), len([w for w in (t or "").encode().split()]), hashlib.md5((t or "").encode()).hexdigest()) for i, t, lang, src, dom in rows]
    tokens = defaultdict(int)
    for _, leaf, n, _ in keyed:
        tokens[leaf] += n
    w = lambda level, v: weights.get(level, {}).get(v, 1.0)
    open_ = lambda leaf: all(w(k, v) > 0 for k, v in zip(M.LEVELS, leaf, strict=True))
    cap = {leaf: (n * epochs if open_(leaf) else 0) for leaf, n in tokens.items()}
    out = {}

    def deal(prefix, budget):
        if len(prefix) == 3:
            out[prefix] = budget
            return
        kids = sorted({leaf[: len(prefix) + 1] for leaf in cap if leaf[: len(prefix)] == prefix})
        c = {k: sum(n for leaf, n in cap.items() if leaf[: len(k)] == k) for k in kids}
        got, left, live = dict.fromkeys(kids, 0.0), budget, {k for k in kids if w(M.LEVELS[len(prefix)], k[-1]) > 0}
        while live and left > 1e-9:
            total = sum(w(M.LEVELS[len(prefix)], k[-1]) for k in live)
            share = {k: left * w(M.LEVELS[len(prefix)], k[-1]) / total for k in live}
            full = {k for k in live if got[k] + share[k] >= c[k]}
            if not full:
                for k in live:
                    got[k] += share[k]
                break
            for k in full:
                left -= c[k] - got[k]
                got[k] = c[k]
            live -= full
        for k in kids:
            deal(k, got[k])

    deal((), min(fraction * sum(tokens.values()), sum(cap.values())))
    copies = []
    for leaf, budget in out.items():
        mine = [r for r in keyed if r[1] == leaf]
        full = int(budget / tokens[leaf] + 1e-9) if tokens[leaf] else 0
        rest = max(0, budget - full * tokens[leaf])
        rest = 0 if rest < 1e-6 * tokens[leaf] else rest
        place = lambda r: (hashlib.md5(f"{seed}:{full + 1}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[3])  # noqa: E731,B023
        for r in mine:
            ahead = sum(x[2] for x in mine if place(x) < place(r))
            copies.append((r[0], leaf, r[2], round(budget, 3), full + (ahead < rest)))
    return sorted(copies, key=repr)


def corpus():
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["en", "en", "de", None]), f"src{min(rng.randrange(12), 5)}", rng.choice(["a", "b", "c"])) for i in range(300)]
    return [*rows, (None, "x y z", "en", None, None), (900, None, "en", "src1", "a"), rows[4], (901, "big " * 5000, "de", "src2", "b")]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, domain string").repartition(4)
    for fraction, epochs, digits in ((0.3, 1, 1), (1.4, 2, 2), (0.5, 3, 1), (9.0, 2, 1)):
        weights = {"domain": {"a": 5.0, "b": 0.5, "c": 0.0 if epochs == 3 else 1.0}, "language": {"en": 3.0}, "source": {"src1": 4.0, "src5": 0.1}}
        got = M.select(df, fraction, epochs, 5, weights, digits).collect()
        got = sorted(((r.doc_id, (r.mix_domain, r.mix_language, r.mix_source), r.mix_tokens, round(r.mix_budget, 3), r.mix_copies) for r in got), key=repr)
        assert got == brute(corpus(), fraction, epochs, 5, weights)


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 7), (2, "c d", "en", "s", 8)], "doc_id long, text string, lang string, source string, copies long")
    got = M.mix(df, fraction=9.0, epochs=2, weights={})
    assert got.columns == df.columns and got.count() == 4
    assert M.mix(df.limit(0), weights={}).count() == 0
