"""Substring dedup over prefix-partitioned suffix trees.

The text's alphabet is its words, unchanged, each by 32 bits of its hash; a suffix is the words from one
position to its document's end. What is looked for are repeats of at least `width` words, that is, internal nodes of the
suffix tree of string depth `width` or more, and for each window of `width` words whether it also starts earlier.

1. Anchors. Of the grams (GRAM consecutive words) of a window the one of least hash is its anchor, the leftmost if
   there are several: equal windows have equal anchors at equal places. A run of windows that share an anchor is stood
   for by the suffix that begins there, with the words that those windows have before it and after it. So one suffix of
   several is kept, and the trees are sparse.
2. Vertical partitioning. Every chunk (chunks.py) says how often which grams are anchors, and is told which are so more than
   once anywhere; suffixes that begin with other grams are leaves above depth `width` and go no further. The
   prefix that decides a suffix's group is its gram, unless more than FREQUENT suffixes begin with it: then it is
   lengthened to `width` words, one suffix for each window. Groups hold about GROUP suffixes; a chunk sends
   equal suffixes once (the earliest), so a passage that is everywhere is one suffix a chunk in its group.
3. Subtrees. A group sorts its suffixes by their words and has its tree by the lengths of the prefixes that neighbours
   share (Subtree). A window with `a` words before its anchor stands for the node at depth width - a; windows under
   one node whose `a` words before the anchor are equal too, word by word, and whose names (64 more bits over the
   whole window, from all 64 bits of its words' hashes) are equal, are one repeat: all but
   the earliest learn that they are later. Chunks get a bit for each window that they sent. So windows that differ in
   a single word are told apart by 32 bits of that word's hash and by 64 of the window's name.
4. Repeats. Later windows that overlap or touch in a document form one maximal repeated span.

Order: documents without an id first, by hash of the text, then by doc_id; within a document by position; rows that
repeat doc_id and text are one document with the same result; of different texts under one doc_id the lesser text
is the earlier. Nulls are empty texts; a text of fewer than width words loses nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chunks
from lexmill.llm import common as C

GRAM, GROUP, FREQUENT, CHUNK_BYTES = 8, 150_000, 50_000, 8 << 20
U = np.uint64


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """Position of the least of each n consecutive numbers, the leftmost of equal ones."""
    at, span = np.arange(len(x)), 1

    def pick(at: np.ndarray, by: int) -> np.ndarray:
        left, right = at[: len(at) - by], at[by:]
        return np.where(x[left] <= x[right], left, right)

    while 2 * span <= n:
        at, span = pick(at, span), 2 * span
    return pick(at, n - span) if n > span else at


class Spans:
    """128-bit names of spans of a sequence, each in constant time, by sums of powers."""

    def __init__(self, h: np.ndarray):
        self.by = []
        with np.errstate(over="ignore"):
            for base in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
                inverse = U(pow(int(base), -1, 1 << 64))
                up = np.cumprod(np.r_[U(1), np.full(len(h), base, U)], dtype=U)
                down = np.cumprod(np.r_[U(1), np.full(len(h), inverse, U)], dtype=U)
                self.by.append((np.r_[U(0), np.cumsum(C.mix(h + base) * up[:-1], dtype=U)], down))

    def name(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return tuple(C.mix((s[start + length] - s[start]) * down[start] + length.astype(U)) for s, down in self.by)


class Chunk:
    """A chunk's documents in order, their windows, and the runs of windows of one anchor."""

    def __init__(self, t: pa.Table, width: int):
        C.begin("substring")
        self.width, self.gram = width, min(GRAM, max(1, width // 2))
        ids, texts = t.column("doc_id").to_pylist(), [x or "" for x in t.column("text").to_pylist()]
        self.docs = sorted({self.name(i, x) for i, x in zip(ids, texts, strict=True)})
        hashes = [C.hash_words(C.words_of(x, lower=False)) for _, _, x in self.docs]
        self.n_words = np.array([len(h) for h in hashes], np.int64)
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        del hashes
        self.begin = np.cumsum(self.n_words) - self.n_words
        grams = C.window_hashes(self.h, self.gram)
        # windows that lie within one document, and their anchors
        fits = np.maximum(0, self.n_words - width + 1)
        self.window = np.repeat(self.begin, fits) + np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
        anchor = least_of(grams, width - self.gram + 1)[self.window] if len(self.window) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(fits)), fits)
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(anchor) else np.zeros(0, np.int64)
        # runs: first window, windows, anchor, the anchor's gram
        self.lo, self.m = self.window[first], np.diff(np.r_[first, len(anchor)])
        self.anchor = anchor[first]
        self.key = C.mix(grams[self.anchor] + U(1)) if len(first) else np.zeros(0, U)  # anchors' hashes are small ones: spread them
        self.doc = doc[first]
        self.grams, self.of, self.times = np.unique(self.key, return_inverse=True, return_counts=True)

    @staticmethod
    def name(doc_id: int | None, text: str) -> tuple[bool, int, str]:
        """(whether there is an id, the id from 0 on or else a hash of the text, text): the order of documents."""
        return (False, C.xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")), text) if doc_id is None else (True, doc_id + (1 << 63), text)

    def suffixes(self, state: np.ndarray) -> None:
        """Distinct suffixes to send, by what is known of each of self.grams (0: once, 1: repeated, 2: frequent)."""
        state = state[self.of]
        some, often = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        m = self.m[often]
        each = np.repeat(self.lo[often], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        spans = Spans(self.h)
        lo = np.r_[self.lo[some], each]
        m = np.r_[self.m[some], np.ones(len(each), np.int64)]
        ahead = np.r_[self.anchor[some] - self.lo[some], np.zeros(len(each), np.int64)]  # words before the anchor that the first window has
        doc = np.r_[self.doc[some], np.repeat(self.doc[often], self.m[often])]
        a, b = spans.name(lo, m + self.width - 1)
        key = np.r_[self.key[some], a[len(some) :]]
        order = np.lexsort((lo, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        new = np.r_[True, ~same] if len(order) else np.zeros(0, bool)
        first = order[new]
        first = first[np.argsort(key[first], kind="stable")]
        # what each run or window was sent as, and whether it is the one that was sent
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        place = np.empty(len(first), np.int64)
        place[group[first]] = np.arange(len(first))
        self.sent_as, self.all_lo, self.all_m = place[group], lo, m
        self.is_first = np.zeros(len(lo), bool)
        self.is_first[first] = True
        self.s_lo, self.s_m, self.s_ahead, self.s_key, self.s_doc = lo[first], m[first], ahead[first], key[first], doc[first]
        m = self.s_m
        each = np.repeat(self.s_lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        self.names = spans.name(each, np.full(len(each), self.width))[1]  # by window of the suffixes sent

    def packets(self, chunk: int, groups: int) -> pa.Table:
        at = chunks.cuts(self.s_key, groups)
        word = np.maximum((self.h >> U(32)).astype(np.uint32), np.uint32(1))
        out = {k: [] for k in ("range", "m", "ahead", "words", "names", "owner", "place")}
        window = np.r_[0, np.cumsum(self.s_m)]
        known = np.array([x for x, _, _ in self.docs], bool)
        owner = np.array([i for _, i, _ in self.docs], U)
        for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if j > i:
                lo, n, doc = self.s_lo[i:j], self.s_m[i:j] + self.width - 1, self.s_doc[i:j]
                flat = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out["range"].append(k)
                out["m"].append(C.pack_planes(self.s_m[i:j].astype(np.uint32)))
                out["ahead"].append(C.pack_planes(self.s_ahead[i:j].astype(np.uint32)))
                out["words"].append(C.pack_planes(word[flat]))
                out["names"].append(C.pack_planes(self.names[window[i] : window[j]]))
                out["owner"].append(C.pack_planes(owner[doc]))
                out["place"].append(C.pack_planes(known[doc].astype(U) << U(48) | lo.astype(U)))
        ranges = out.pop("range")
        return pa.table({"range": pa.array(ranges, pa.int32()), "chunk": pa.array([chunk] * len(ranges), pa.int32()), **{k: C.binary_array(v) for k, v in out.items()}})

    def repeats(self, later: np.ndarray) -> np.ndarray:
        """Start positions of windows that also start earlier, from the bits of the windows of the suffixes sent."""
        at = np.cumsum(self.s_m) - self.s_m
        m = self.all_m
        flat = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        gone = later[np.repeat(at[self.sent_as], m) + flat] | np.repeat(~self.is_first, m)
        return (np.repeat(self.all_lo, m) + flat)[gone]


class Subtree:
    """The suffix tree over rows of words (0 past a suffix's end), as the order of the suffixes and the depths at which neighbours part."""

    def __init__(self, words: np.ndarray):
        n, width = words.shape
        self.order = np.argsort(np.ascontiguousarray(words.astype(">u4")).view(f"S{4 * width}").ravel(), kind="stable")
        s = words[self.order]
        differ = s[1:] != s[:-1]
        self.shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if n > 1 else np.zeros(0, np.int64)

    def below(self, depth: int) -> np.ndarray:
        """For each suffix its subtree when the tree is cut at this string depth: suffixes under one node of that depth or more have one number."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.r_[0, np.cumsum(self.shared < depth)]
        return out

    def nodes(self, least: int = 1) -> list[tuple[int, list[int]]]:
        """Internal nodes of string depth `least` or more: (depth, suffixes below), deeper ones first among those that begin together."""
        out, stack = [], []  # stack: (depth, first place)
        for i, d in enumerate([*self.shared.tolist(), 0]):
            first = i
            while stack and stack[-1][0] > d:
                depth, first = stack.pop()
                if depth >= least:
                    out.append((depth, self.order[first : i + 1].tolist()))
            if d and (not stack or stack[-1][0] < d):
                stack.append((d, first))
        return out


def later_windows(words: list[np.ndarray], m: np.ndarray, ahead: np.ndarray, rank: np.ndarray, width: int, names: np.ndarray) -> np.ndarray:
    """For each window of each suffix, in order, whether an equal one has a lesser (rank, start).

    words: those of a suffix's windows together, m + width - 1 of them, of which `ahead` stand before the anchor.
    A window with a words before the anchor is the window number ahead - a of its suffix; names: a number for each
    window, equal for equal ones. Ranks of suffixes are distinct and in the order of where their anchors stand.
    """
    n = m + width - 1
    begin = np.cumsum(n) - n
    all_words = np.concatenate(words)
    after = n - ahead  # words from the anchor on
    right = np.zeros((len(m), int(min(width, after.max()))), np.uint32)
    keep = np.minimum(after, right.shape[1])
    flat = np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
    right[np.repeat(np.arange(len(m)), keep), flat] = all_words[np.repeat(begin + ahead, keep) + flat]
    tree = Subtree(right)
    out, at = np.zeros(int(m.sum()), bool), np.cumsum(m) - m
    mine, left = np.arange(len(m)), np.zeros(len(m), np.int64)  # suffixes with at least a words ahead, and which of them are equal in those
    for a in range(int(ahead.max()) + 1):
        if a:
            stay = ahead[mine] >= a
            mine = mine[stay]
            _, left = np.unique(left[stay].astype(U) << U(32) | all_words[begin[mine] + ahead[mine] - a].astype(U), return_inverse=True)
        has = a > ahead[mine] - m[mine]  # windows begin ahead, ahead - 1, ..., ahead - m + 1 words before the anchor
        some = mine[has]
        if len(some):
            window = at[some] + ahead[some] - a
            node, name = tree.below(width - a)[some] * len(m) + left[has], names[window]
            order = np.lexsort((rank[some], name, node))
            node, name = node[order], name[order]
            out[window[order[1:]]] = (node[1:] == node[:-1]) & (name[1:] == name[:-1])
    return out


_SENT = "range int, chunk int, m binary, ahead binary, words binary, names binary, owner binary, place binary"
_BITS = "chunk int, range int, n int, bits binary"


def spans(docs: DataFrame, width: int = 20, *columns: Column | str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, starts, ends (word positions of maximal repeated spans), kept (the rest, words joined by one space), text_md5; or columns made of these. The result is written, so that what it is made of can go."""
    dealt, n_chunks = chunks.deal(docs.select("doc_id", "text"), CHUNK_BYTES)
    ranges = max(chunks.LEAST_CHUNKS, n_chunks // 4)
    group, frequent = GROUP, FREQUENT

    def send_grams(key, t):
        c = Chunk(t, width)
        return chunks.packets(t.column("chunk")[0].as_py(), ranges, c.grams, c.times.astype(U))

    def count_grams(key, t):
        parts = [C.unpack_sorted(x) for x in t.column("hashes").to_pylist()]
        times = np.concatenate([C.unpack_planes(x, U) for x in t.column("c0").to_pylist()])
        _, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = chunks.add_up(of, times)
        state = np.where(total > frequent, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        split = np.split(state[of], np.cumsum([len(x) for x in parts])[:-1])
        some = [int(total[total > 1].sum())] + [0] * (len(parts) - 1)
        return pa.table({"chunk": t.column("chunk").cast(pa.int32()), "range": t.column("range").cast(pa.int32()), "state": C.binary_array([x.tobytes() for x in split]), "suffixes": pa.array(some, pa.int64())})

    packed = dealt.groupBy("chunk").applyInArrow(send_grams, chunks.PACKETS + ", c0 binary")
    grams = C.materialize(packed.groupBy("range").applyInArrow(count_grams, "chunk int, range int, state binary, suffixes long"), "suffix-grams")
    groups = C.parts_for(int(grams.agg(F.sum("suffixes")).first()[0] or 0), group)

    def chunk_of(t, g) -> Chunk:
        c = Chunk(t, width)
        rows = sorted(zip(g.column("range").to_pylist(), g.column("state").to_pylist(), strict=True))
        c.suffixes(np.frombuffer(b"".join(x for _, x in rows), np.uint8))
        return c

    def send_suffixes(key, t, g):
        out = chunk_of(t, g).packets(key[0].as_py(), groups)
        C.give_back()
        return out

    def subtree(key, t):
        """A group: merges what the chunks sent into one tree; replies a bit for each window: whether it also starts earlier."""
        m, ahead, owner, place = ([C.unpack_planes(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("m", np.uint32), ("ahead", np.uint32), ("owner", U), ("place", U)))
        sizes, windows = [len(x) for x in m], [int(x.sum()) for x in m]
        words = [C.unpack_planes(x, np.uint32) for x in t.column("words").to_pylist()]
        names = np.concatenate([C.unpack_planes(x, U) for x in t.column("names").to_pylist()])
        m, ahead, owner, place = (np.concatenate(x) for x in (m, ahead, owner, place))
        m, ahead = m.astype(np.int64), ahead.astype(np.int64)
        at = (place & U((1 << 48) - 1)).astype(np.int64) + ahead
        rank = np.empty(len(m), np.int64)
        rank[np.lexsort((at, owner, place >> U(48)))] = np.arange(len(m))
        later = later_windows(words, m, ahead, rank, width, names)
        split = np.split(later, np.cumsum(windows)[:-1])
        assert len(sizes) == len(split)
        C.give_back()
        return pa.table({"chunk": t.column("chunk").cast(pa.int32()), "range": t.column("range").cast(pa.int32()), "n": pa.array(windows, pa.int32()), "bits": C.binary_array([np.packbits(x).tobytes() for x in split])})

    sent = dealt.groupBy("chunk").cogroup(grams.groupBy("chunk")).applyInArrow(send_suffixes, _SENT)
    bits = C.materialize(sent.groupBy("range").applyInArrow(subtree, _BITS), "suffix-bits")
    replies = grams.select("chunk", "range", F.lit(-1).alias("n"), F.col("state").alias("bits")).union(bits.select("chunk", "range", "n", "bits"))

    def cut(key, t, r):
        c = chunk_of(t, r.filter(pc.equal(r.column("n"), -1)).rename_columns(["chunk", "range", "n", "state"]))
        rows = sorted((k, n, b) for k, n, b in zip(r.column("range").to_pylist(), r.column("n").to_pylist(), r.column("bits").to_pylist(), strict=True) if n >= 0)
        later = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in rows]) if rows else np.zeros(0, bool)
        starts = np.sort(c.repeats(later))
        d = np.bincount(starts, minlength=len(c.h) + 1) - np.bincount(starts + width, minlength=len(c.h) + 1)
        gone = np.cumsum(d)[: len(c.h)] > 0
        got = {}
        for doc, at, n in zip(c.docs, c.begin.tolist(), c.n_words.tolist(), strict=True):
            w, mine, begin, end = C.words_of(doc[2], lower=False), gone[at : at + n], [], []
            if mine.any():
                edges = np.flatnonzero(np.diff(np.r_[0, mine.astype(np.int8), 0]))
                begin, end = edges[::2].tolist(), edges[1::2].tolist()
                kept, last = [], 0
                for x, y in zip(begin, end, strict=True):
                    kept += w[last:x]
                    last = y
                w = kept + w[last:]
            got[doc] = (n, n - len(w), begin, end, b" ".join(w).decode("utf-8", "surrogatepass"))
        out = [(i, *got[Chunk.name(i, x or "")], hashlib.md5((x or "").encode("utf-8", "surrogatepass")).hexdigest()) for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string())
        cols = list(zip(*out, strict=True)) or [[]] * 7
        C.give_back()
        return pa.table({name: pa.array(x, k) for name, x, k in zip(("doc_id", "n_words", "n_removed", "starts", "ends", "kept", "text_md5"), cols, kinds, strict=True)})

    out = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept string, text_md5 string")
    out = C.materialize(out.select(*columns) if columns else out, "suffix-spans")
    C.drop(dealt, grams, bits)
    return out


def deduplicate(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs' rows and columns, repeated spans cut out of text (n_chars follows if there is one); rows of which nothing is left go."""
    i, t, kept, md5 = C.free_names(docs, "cut_id", "cut_md5", "cut_text", "text_md5")
    changed = F.col("n_removed") > 0
    cut = spans(docs, width, F.when(changed, F.col("doc_id")).alias(i), F.when(changed, F.col("text_md5")).alias(t), F.when(changed, F.col("kept")).alias(kept)).where(F.col(t).isNotNull()).dropDuplicates([i, t])
    rows = docs.withColumn(md5, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    out = rows.join(cut, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(md5) == F.col(t)), "left").where(F.col(kept).isNull() | (F.col(kept) != ""))
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(new).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: windows of 20 words."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20, "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS s, unnest(w) AS word, len(w) AS n FROM w WHERE len(w) >= 20),
g AS (SELECT doc_id, s, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS t FROM v),
h AS (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(t) ORDER BY doc_id, s) AS k FROM g WHERE s <= n - 19),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM h WHERE k > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
