"""Katz backoff: Good-Turing discounted counts, exactly normalised backoff weights, evaluated recursively per token.

Tokens: lower-cased words (A-Z), then one end per document; before the first token stands a start mark. The model has
n-grams of up to ORDER tokens; the first tokens of a document have the start mark and what follows it as history. With
N training tokens of V kinds and one more kind, "unknown", for all the rest,

    p(w)      = d1(c(w)) c(w) / N                           c(w) > 0
              = 1 - the sum of those                        unknown
    p(w | h)  = dk(c(h w)) c(h w) / c(h)                    c(h w) > 0, h of k - 1 tokens
              = a(h) p(w | h')                              else; h' is h without its first token
    a(h)      = (1 - sum of p(w | h) over seen w) / (1 - sum of p(w | h') over the same w)
    p(w | h)  = p(w | h')                                   c(h) = 0

so that each distribution sums to one over the V + 1 kinds. dk(r) for r <= CUT is Good-Turing's for that order,
renormalised after Katz; where counts of counts can't give one in (0, 1), (r - 1/2) / r. A history all of whose
followers occur more often than CUT has no mass to give; there c(h) + 1 replaces c(h), and likewise N + 1 replaces N.

Tables. For each order there is a table partitioned by ranges of the hash of the history (of the word, for order one).
Documents are dealt to chunks (chunks.py); a chunk sends each partition its distinct n-grams with counts and gets back,
in the same order, the corpus-wide counts and for each history what its backoff weight is made of. Each n-gram is
one entry a chunk however often it occurs, so a frequent word is no hot key. A partition also says whether another chunk
has an n-gram too; one that no other chunk has needs no partition as a history, as all that follows it is at hand.
With tables=True the partitions are kept as rows (order, range, packed n-grams and counts) that Tables reads again.

A null text is empty: the end alone. A null doc_id has the fold of the empty text. Rows that repeat a doc_id
count as often as they occur. Without training rows nothing is known and every token has probability 1 as
the one kind there is. Columns other than doc_id and text are ignored. Words and histories are told apart by 64-bit
hashes, followers of one history by 40 bits of theirs. Counts have 64 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chunks
from lexmill.llm import common as C

#: Any order from one on; the README has what order three measured, which is why the query takes two.
CUT, ORDER, CHUNK_BYTES = 5, 2, 5 << 20
U = np.uint64
_END, _START = U(0x454E44454E44454E), U(0xFFFFFFFFFFFFFFFF)
_LOW = U(24)  # bits of a follower's hash that are not sent


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def discounts(n: list[int]) -> np.ndarray:
    """d(r) for r in 0..CUT from counts of counts n[r - 1], r in 1..CUT + 1."""
    d = np.ones(CUT + 1)
    tail = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and tail < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """p(w) from a count; stats: [kinds, tokens, n_1 .. n_(CUT + 1)]."""

    def __init__(self, stats: list[int]):
        self.kinds, self.tokens = stats[0], stats[1]
        self.d = discounts(stats[2 : 3 + CUT])
        low = sum(r * x for r, x in enumerate(stats[2 : 2 + CUT], 1))
        mass = sum(self.d[r] * r * x for r, x in enumerate(stats[2 : 2 + CUT], 1)) + self.tokens - low
        self.total = self.tokens if mass < self.tokens * (1 - 1e-12) else self.tokens + 1
        self.unknown = 1 - mass / self.total if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / max(1, self.total), self.unknown)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= CUT, d[np.minimum(c, CUT).astype(np.int64)], 1.0) * c


def history_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a history that goes on with a word."""
    with np.errstate(over="ignore"):
        return C.mix(C.mix(history) + word)


class Part:
    """A chunk: its tokens as numbers of its sorted distinct hashes, by document."""

    def __init__(self, t: pa.Table):
        """t: the chunk's row of tokenised()."""
        self.ids = t.column("ids")[0].as_py()
        self.n = C.unpack_planes(t.column("n")[0].as_py(), U).astype(np.int64)
        self.word = C.unpack_sorted(t.column("word")[0].as_py())
        self.token = C.unpack_planes(t.column("token")[0].as_py(), np.uint32).astype(np.int32)
        self.start = np.cumsum(self.n) - self.n
        self.weight = np.repeat(~np.array([held_out(i) for i in self.ids]), self.n)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)


_TOKENS = "chunk int, ids array<long>, n binary, word binary, token binary"


def tokenise(key, t):
    """A chunk's documents as one row of arrays, by which all passes go on."""
    C.begin("katz")
    each = []
    for text in t.column("text").to_pylist():
        each += [C.hash_words(C.words_of(text)), np.array([_END])]
    word, token = np.unique(np.concatenate(each), return_inverse=True)
    n = np.array([len(h) + 1 for h in each[::2]], U)
    del each
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([t.column("doc_id").to_pylist()], pa.list_(pa.int64())), "n": C.binary_array([C.pack_planes(n)]), "word": C.binary_array([C.pack_sorted(word)]), "token": C.binary_array([C.pack_planes(token.astype(np.uint32))])})


class Level:
    """A chunk's distinct n-grams of one order, in the order of their histories' hashes."""

    def __init__(self, p: Part, below: Level | None, shared: np.ndarray):
        """below: the order before (None for bigrams); shared: of its n-grams (of the words), whether another chunk has them too."""
        gram, hashes = (p.token, p.word) if below is None else (below.gram, history_hash(below.hash[below.history], p.word[below.second]))
        history = np.r_[len(hashes), gram[:-1]]
        history[p.start] = len(hashes)  # the start mark
        hashes, shared = np.r_[hashes, _START], np.r_[shared, True]
        # histories are numbered by hash, those of this chunk alone last
        used = np.unique(history)
        used = used[np.lexsort((hashes[used], ~shared[used]))]
        number = np.empty(len(hashes), np.int64)
        number[used] = np.arange(len(used))
        self.hash, self.sent = hashes[used], int(shared[used].sum())
        kinds = len(p.word)
        key, at, self.gram = np.unique(number[history] * kinds + p.token, return_index=True, return_inverse=True)
        self.gram = self.gram.astype(np.int32)
        self.history, self.second = (key // kinds).astype(np.int32), (key % kinds).astype(np.int32)
        self.lower = gram_of(p, below)[at]  # the same token's n-gram of the order before
        self.followers = np.bincount(self.history, minlength=len(used))
        self.n = np.bincount(self.gram, p.weight, len(key)).astype(np.int64)
        self.n_sent = int(self.followers[: self.sent].sum())

    def summary(self, count: np.ndarray, lower: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the histories first..last: sum of lower-order probabilities of seen followers; c(h) and followers by count 1..CUT."""
        s = slice(int(self.followers[:first].sum()), int(self.followers[:last].sum()))
        return summary(self.history[s] - first, count[s], lower[s], last - first)


def gram_of(p: Part, level: Level | None) -> np.ndarray:
    return p.token if level is None else level.gram


def summary(history: np.ndarray, count: np.ndarray, lower: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    seen = count > 0
    h, r = history[seen], count[seen]
    whole = np.zeros(m, U)
    np.add.at(whole, h, r.astype(U))
    return np.bincount(h, lower[seen], m), np.stack([whole, *(np.bincount(h[r == k], minlength=m).astype(U) for k in range(1, CUT + 1))])


def weights(mass: np.ndarray, whole: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total that counts are divided by, backoff weight) of histories."""
    whole = whole.astype(np.float64)
    c = whole[0]
    low = sum(k * whole[k] for k in range(1, CUT + 1))
    given = sum(d[k] * k * whole[k] for k in range(1, CUT + 1)) + c - low
    total = np.where(given < c * (1 - 1e-12), c, c + 1)
    return total, np.where(c > 0, (1 - given / total) / np.maximum(1 - mass, 1e-300), 1.0)


def _stats(c: np.ndarray) -> list[int]:
    n = np.bincount(np.minimum(c[c > 0], CUT + 2).astype(np.int64), minlength=CUT + 3)
    return [int((c > 0).sum()), int(c.sum()), *n[1 : CUT + 2].tolist()]


def _total(replies: DataFrame) -> list[int]:
    rows = replies.select(F.posexplode("stats").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = [0] * (3 + CUT)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


_SENT = "range int, chunk int, history binary, followers binary, word binary, n binary, lower binary, total binary, stats array<long>"
_REPLY = "kind int, chunk int, range int, a binary, b binary, stats array<long>"


def _replies(kind: int, t: pa.Table, a: list[bytes], b: list[bytes], stats: list[int]) -> dict:
    n = t.num_rows
    return {"kind": [kind] * n, "chunk": t.column("chunk").to_pylist(), "range": t.column("range").to_pylist(), "a": a, "b": b, "stats": [stats] + [None] * (n - 1)}


def _reply_table(cols: dict) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(cols.items(), kinds, strict=True)})


class Chunk:
    """A chunk with what it has been told so far (replies by kind: the order), as counts, totals, weights and log10 probabilities by order."""

    def __init__(self, t: pa.Table, r: pa.Table, uni: Unigrams, d: list[np.ndarray]):
        rows: dict[int, list] = {}
        for x in sorted(zip(*(r.column(c).to_pylist() for c in ("kind", "range", "a", "b")), strict=True), key=lambda x: x[:2]):
            rows.setdefault(x[0], []).append(x)
        p = self.p = Part(t)
        told = np.concatenate([C.unpack_planes(x[2], U) for x in rows[1]]) if 1 in rows else np.zeros(0, U)
        self.c = (told >> U(1)).astype(np.int64)
        self.prob, self.level = [uni.p(self.c)], None
        self.count, self.total = self.c, np.full(len(p.word), max(1, uni.total))
        self.seen_prob = np.where(self.c > 0, self.prob[0], 0.0)
        self.shared = (told & U(1)).astype(bool)
        for k, dk in enumerate(d, 2):
            level = self.next_level()
            told, mass, whole = [np.zeros(0, U)], [np.zeros(0)], [np.zeros((1 + CUT, 0), U)]
            for _, _, a, b in rows.get(k, []):
                told.append(C.unpack_planes(a, U))
                m = len(b) // (8 * (2 + CUT))
                mass.append(np.frombuffer(b, np.float64, m))
                whole.append(C.unpack_planes(b[8 * m :], U).reshape(1 + CUT, m))
            told = np.concatenate(told)
            count = np.r_[(told >> U(1)).astype(np.int64), level.n[level.n_sent :]]
            own = level.summary(count, self.seen_prob[level.lower], level.sent, len(level.hash))
            total, alpha = weights(np.r_[np.concatenate(mass), own[0]], np.concatenate([*whole, own[1]], axis=1), dk)
            lower = self.prob[-1][level.lower]
            seen = discounted(count, dk) / np.maximum(total, 1)[level.history]
            self.prob.append(np.where(count > 0, seen, alpha[level.history] * lower))
            self.level, self.count, self.total = level, count, np.maximum(total, 1)[level.history]
            self.seen_prob = np.where(count > 0, seen, 0.0)
            self.shared = np.r_[(told & U(1)).astype(bool), np.zeros(len(count) - len(told), bool)]

    def next_level(self) -> Level:
        return Level(self.p, self.level, self.shared)


def send(key, t: pa.Table, r: pa.Table, uni: Unigrams, d: list[np.ndarray], ranges: int) -> pa.Table:
    """What a chunk sends of the next order."""
    c = Chunk(t, r, uni, d)
    v = c.next_level()
    chunk = key[0].as_py()
    at = chunks.cuts(v.hash[: v.sent], ranges)
    to = np.r_[0, np.cumsum(v.followers)]
    out = {x: [] for x in ("range", "chunk", "history", "followers", "word", "n", "lower", "total", "stats")}
    count, total = c.count[v.lower].astype(U), c.total[v.lower].astype(U)
    for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if j > i:
            s = slice(to[i], to[j])
            known = v.n[s] > 0
            row = (k, chunk, *map(C.squeeze, (C.pack_sorted(v.hash[i:j]), C.pack_planes(v.followers[i:j].astype(U)), C.pack_planes(c.p.word[v.second[s]] >> _LOW), C.pack_planes(v.n[s].astype(U)), C.pack_planes(np.where(known, count[s], U(0))), C.pack_planes(np.where(known, total[s], U(0))))), None)
            for name, x in zip(out, row, strict=True):
                out[name].append(x)
    own = _stats(v.n[v.n_sent :])  # of histories that no other chunk has
    for name, x in zip(out, (-1 - chunk % 1024, chunk, b"", b"", b"", b"", b"", b"", own), strict=True):
        out[name].append(x)
    C.give_back()
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int64())]
    return pa.table({k: pa.array(x, kind) for (k, x), kind in zip(out.items(), kinds, strict=True)})


def count(t: pa.Table, order: int, d: np.ndarray, tables: bool) -> pa.Table:
    """A partition: adds up what all chunks sent of its histories and answers each. d: discounts of the order before."""
    if t.column("range")[0].as_py() < 0:
        total = np.array(t.column("stats").to_pylist()).sum(axis=0).tolist()
        return _reply_table({"kind": [-order], "chunk": [-1], "range": [t.column("range")[0].as_py()], "a": [None], "b": [None], "stats": [total]})
    history = [C.unpack_sorted(C.expand(x)) for x in t.column("history").to_pylist()]
    followers = [C.unpack_planes(C.expand(x), U).astype(np.int64) for x in t.column("followers").to_pylist()]
    word, n, lower, total = (np.concatenate([C.unpack_planes(C.expand(x), U) for x in t.column(c).to_pylist()]) for c in ("word", "n", "lower", "total"))
    names, of = np.unique(np.concatenate(history), return_inverse=True)
    entry = np.repeat(of, np.concatenate(followers))
    if len(names) >> 24:
        raise ValueError("more histories than a partition can number: take smaller chunks")
    _, first, gram = np.unique(entry.astype(U) << U(40) | word, return_index=True, return_inverse=True)
    c = chunks.add_up(gram, n)
    shared = np.bincount(gram) > 1
    # any chunk with a training row of it knows the lower order's count and total
    best = np.zeros(len(c), np.int64)
    best[gram[n > 0]] = np.flatnonzero(n > 0)
    p = discounted(lower[best].astype(np.int64), d) / np.maximum(total[best], 1)
    mass, whole = summary(entry[first], c.astype(np.int64), p, len(names))
    a = np.split((c << U(1) | shared.astype(U))[gram], np.cumsum([int(x.sum()) for x in followers])[:-1])
    b = np.split(of, np.cumsum([len(x) for x in history])[:-1])
    out = _replies(order, t, [C.pack_planes(x) for x in a], [mass[x].tobytes() + C.pack_planes(np.ascontiguousarray(whole[:, x]).ravel()) for x in b], _stats(c.astype(np.int64)))
    if tables:
        kept = (C.pack_sorted(names), C.pack_planes(np.bincount(entry[first], minlength=len(names)).astype(U)), C.pack_planes(word[first]), C.pack_planes(c), mass.tobytes(), C.pack_planes(whole.ravel()))
        for k, x in zip(("kind", "chunk", "range", "a", "b", "stats"), (order, -1, t.column("range")[0].as_py(), b"".join(kept), None, [len(x) for x in kept]), strict=True):
            out[k].append(x)
    C.give_back()
    return _reply_table(out)


def sender(*how):
    return lambda key, t, r: send(key, t, r, *how)


def counter(*how):
    return lambda key, t: count(t, *how)


def fit(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, tables: bool = False) -> tuple[DataFrame, DataFrame, Unigrams, list[np.ndarray], list[DataFrame]]:
    """(documents by chunk, replies of all orders, unigrams, discounts of the orders above, tables to drop)."""
    assigned, ranges = chunks.assign(docs.select("doc_id", "text"), chunk_bytes)
    dealt = chunks.store(assigned, ranges, lambda df: df.groupBy("chunk").applyInArrow(tokenise, _TOKENS))
    by_chunk = dealt.groupBy("chunk")

    def send_words(key, t):
        p = Part(t)
        return chunks.packets(t.column("chunk")[0].as_py(), ranges, p.word, np.bincount(p.token, p.weight, len(p.word)).astype(U))

    def count_words(key, t):
        parts = [C.unpack_sorted(x) for x in t.column("hashes").to_pylist()]
        n = np.concatenate([C.unpack_planes(x, U) for x in t.column("c0").to_pylist()])
        words, of = np.unique(np.concatenate(parts), return_inverse=True)
        c = chunks.add_up(of, n)
        split = np.split((c << U(1) | (np.bincount(of) > 1).astype(U))[of], np.cumsum([len(x) for x in parts])[:-1])
        out = _replies(1, t, [C.pack_planes(x) for x in split], [b""] * len(parts), _stats(c.astype(np.int64)))
        if tables:
            kept = (C.pack_sorted(words), C.pack_planes(c))
            for k, x in zip(out, (1, -1, t.column("range")[0].as_py(), b"".join(kept), None, [len(x) for x in kept]), strict=True):
                out[k].append(x)
        return _reply_table(out)

    told = [C.materialize(by_chunk.applyInArrow(send_words, chunks.PACKETS + ", c0 binary").groupBy("range").applyInArrow(count_words, _REPLY), "katz-1")]
    replies = told[0]
    uni, d = Unigrams(_total(replies.where("b is not null"))), []
    for k in range(2, order + 1):
        sent = by_chunk.cogroup(replies.where("chunk >= 0").drop("stats").groupBy("chunk")).applyInArrow(sender(uni, list(d), ranges), _SENT)
        made = sent.groupBy("range").applyInArrow(counter(k, d[-1] if d else uni.d, tables), _REPLY)
        told.append(C.materialize(made, f"katz-{k}"))
        d.append(discounts(_total(told[-1].where("b is not null or kind < 0"))[2 : 3 + CUT]))
        replies = replies.union(told[-1])
    return dealt, replies, uni, d, [dealt, *told]


class Tables:
    """The partitions that fit(tables=True) keeps, opened where a lookup needs one."""

    def __init__(self, replies: DataFrame):
        self.kept = replies.where("chunk = -1 and kind > 0")
        self.ranges = {r["kind"]: r["n"] for r in replies.where("kind > 0").groupBy("kind").agg((F.max("range") + 1).alias("n")).collect()}
        self.open: dict[tuple[int, int], list[np.ndarray]] = {}

    def partition(self, order: int, key: int) -> list[np.ndarray]:
        """Hashes of the words or histories of a partition, and what it has of them."""
        at = next(k for k in range(self.ranges[order]) if key < (((k + 1) << 64) // self.ranges[order]))
        if (order, at) not in self.open:
            row = self.kept.where((F.col("kind") == order) & (F.col("range") == at)).first()
            parts, begin = [], 0
            for n in row["stats"] if row else []:
                parts.append(bytes(row["a"][begin : begin + n]))
                begin += n
            self.open[order, at] = [C.unpack_sorted(parts[0]), *(np.frombuffer(x, np.float64) if order > 1 and k == 4 else C.unpack_planes(x, U) for k, x in enumerate(parts[1:], 1))] if row else [np.zeros(0, U)] * 6
        return self.open[order, at]

    def count(self, words: list[bytes | None]) -> int:
        """c(w) of one word in lower case (None: the end)."""
        h = _END if words[0] is None else C.hash_words(words)[0]
        names, c, *_ = self.partition(1, int(h))
        k = int(np.searchsorted(names, h))
        return int(c[k]) if k < len(names) and names[k] == h else 0

    def history(self, words: list[bytes]) -> int | None:
        """c(h) of a history of several words; None if no two chunks have it."""
        h = C.hash_words(words)
        name = h[:1]
        for w in h[1:]:
            name = history_hash(name, np.array([w]))
        names, *_, whole = self.partition(len(words) + 1, int(name[0]))
        k = int(np.searchsorted(names, name[0]))
        return int(whole.reshape(1 + CUT, -1)[0, k]) if k < len(names) and names[k] == name[0] else None


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, order: int = ORDER) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    dealt, replies, uni, d, used = fit(docs, order, chunk_bytes)

    def evaluate(key, t, r):
        x = Chunk(t, r, uni, d)
        p, m = x.p, len(x.p.n)
        logp = np.log10(np.maximum(x.prob[-1], 1e-300))[gram_of(p, x.level)]
        base = np.bincount(p.doc, np.log10(x.c + 0.5)[p.token], m) - p.n * np.log10(uni.tokens + 0.5 * (uni.kinds + 1))
        out = pa.table({"doc_id": pa.array(p.ids, pa.int64()), "held_out": pa.array([held_out(i) for i in p.ids], pa.bool_()), "n_tokens": pa.array(p.n), "n_known": pa.array(np.bincount(p.doc, (x.c > 0)[p.token], m).astype(np.int64)), "train_tokens": pa.array([uni.tokens] * m, pa.int64()), "base_score": pa.array(base), "score": pa.array(np.bincount(p.doc, logp, m))})
        C.give_back()
        return out

    out = dealt.groupBy("chunk").cogroup(replies.where("chunk >= 0").drop("stats").groupBy("chunk")).applyInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = C.materialize(out, "katz-scores")
    C.drop(*used)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
