"""Lexical retrieval packing: windows of WINDOW tokens filled with a seed document's nearest unused ones by BM25.

1. Every document is encoded (token_store.Encoder) and ends with an end id. Whole windows of a long document
   are sequences by themselves; what is left, at most WINDOW - 1 tokens, is a unit to be packed.
2. Token ids are the index's terms, so the vocabulary bounds the statistics: documents, their mean length and
   each id's document frequency are counted over the whole texts of the corpus. A unit is found and searched
   for by its document's whole text too (its bag: distinct ids and counts), however little of it is left.
3. Shards hold SHARD tokens of units that are alike: a unit's heads are the two ids of its whole text that weigh
   most by BM25; units are ordered by their heads, the rarer first, and cut into ranges. A shard builds its
   inverted index with weights from the corpus-wide statistics. Documents that share their most
   telling ids (copies, documents with one passage or topic) are thereby in one shard, wherever they come
   from and however many shards there are; neighbours in other shards aren't found (README: the share found).
4. Seeds are taken in that order; all of a seed's distinct ids score all units of the shard, and unused ones,
   best first (ties to the smaller in that order), fill the seed's window; when no scored unit is left, the next unused
   one follows. The unit that doesn't fit is cut, and what is left of it is the next seed. So every window
   but a shard's last is full; that one is cut into sequences whose lengths are powers of two, which need
   no padding either.

A null text is empty: its end id alone. Rows that repeat a doc_id are documents of their own. Other columns
are ignored. No document, or an empty table, gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import common as C
from lexmill.llm.token_store import encoder

WINDOW, SHARD, K1, B = 2048, 1_000_000, 1.2, 0.75

#: Bytes of texts that are encoded at a time.
ENCODED = 8 << 20

#: An id in more than one of so many units of a shard is kept as a row over all of them.
COMMON = 8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def units(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, doc_tokens, crcs (of its whole windows), tail (ids of the rest, 4 bytes each), bag (distinct ids of the whole text, then their counts)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        for b in C.slices(batches, ENCODED):
            got, size = enc.encode_column(b.column(1))
            size, to = size + 1, np.cumsum(size + 1)  # with the end id
            ids = np.full(int(to[-1]), end_id, "<u4")
            at = np.ones(len(ids), bool)
            at[to - 1] = False
            ids[at] = got
            crcs, tails, bags = [], [], []
            for begin, n in zip((to - size).tolist(), size.tolist(), strict=True):
                x, whole = ids[begin : begin + n], n // WINDOW
                crcs.append([zlib.crc32(x[k * WINDOW : (k + 1) * WINDOW]) for k in range(whole)])
                tails.append(C.pack_planes(x[whole * WINDOW :]))
                bags.append(C.pack_planes(np.concatenate(np.unique(x, return_counts=True)).astype("<u4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), C.binary_array(tails), C.binary_array(bags)], ["doc_id", "doc_tokens", "crcs", "tail", "bag"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, doc_tokens long, crcs array<long>, tail binary, bag binary")


def bag_of(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, their counts) of a document's whole text."""
    x = C.unpack_planes(bag, "<u4")
    return x[: len(x) // 2], x[len(x) // 2 :]


def statistics(made: DataFrame) -> tuple[int, float, np.ndarray, int]:
    """(documents, their mean length, document frequencies by id, ids in all tails) over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total, left = np.zeros(0, np.int64), 0, 0, 0
        for b in batches:
            for tail, bag in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, tf = bag_of(bag)
                if int(found[-1]) >= len(df):
                    df = np.concatenate([df, np.zeros(int(found[-1]) + 1 - len(df), np.int64)])
                df[found] += 1
                n, total, left = n + 1, total + int(tf.sum()), left + tail
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-3, -2, -1, seen], pa.int64()), pa.array(np.r_[left, n, total, df[seen]], pa.int64())], ["id", "n"])

    rows = made.select((F.octet_length("tail") / 4).cast("int"), "bag").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many as the vocabulary
    got = {r["id"]: r["n"] for r in rows}
    left, n, total = got.pop(-3, 0), got.pop(-2, 0), got.pop(-1, 0)
    df = np.zeros(max(got, default=0) + 1, np.int64)
    for k, v in got.items():
        df[k] = v
    return n, total / max(1, n), df, left


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def heads_of(bags: list[bytes], mean: float, df: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each document its two ids that weigh most and that others have too, the rarer first, as one number: those ids plus one, 0 where there is none."""
    split = [bag_of(x) for x in bags]
    size = np.array([len(f) for f, _ in split])
    doc, found, tf = np.repeat(np.arange(len(bags)), size), np.concatenate([f for f, _ in split]).astype(np.int64), np.concatenate([c for _, c in split])
    length = np.bincount(doc, tf, len(bags))
    w = np.where(df[found] > 1, idf[found] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean)), 0.0)
    out, left = np.zeros((2, len(bags)), np.int64), w
    for head in out:  # the best by reduction, then the best of the others; ties to the smaller id, which stands first
        best = np.maximum.reduceat(left, np.cumsum(size) - size)
        at = np.flatnonzero((left == best[doc]) & (left > 0))
        at = at[np.unique(doc[at], return_index=True)[1]]
        head[doc[at]] = found[at] + 1
        left = left.copy()
        left[at] = 0
    a, b = out
    swap = (b > 0) & (df[b - 1] < df[a - 1])
    return np.where(swap, b, a) << 32 | np.where(swap, a, b)


#: Heads that are sampled to set the bounds of parts.
SAMPLE = 1_000_000


def by_heads(made: DataFrame, n: int, mean: float, df: np.ndarray, parts: int) -> DataFrame:
    """units() + heads, what they are ordered by, and part, a range of that order; units of very common heads are spread over the parts that those fill."""
    idf = idf_of(n, df)
    names = [*made.columns, "heads", "part"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields) + ", heads long, part int"

    def run(made: DataFrame, bounds: np.ndarray) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in C.slices(batches):
                heads = heads_of(b.column("bag").to_pylist(), mean, df, idf)
                lo, hi = np.searchsorted(bounds, heads, "left"), np.searchsorted(bounds, heads, "right")
                part = lo + b.column("h").to_numpy() % (hi - lo + 1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-2]), pa.array(heads), pa.array(part.astype(np.int32))], names)

        return made.withColumn("h", F.pmod(F.xxhash64("doc_id", "tail"), F.lit(1 << 31))).mapInArrow(add, schema)

    each = max(1, n // min(SAMPLE, 200 * parts))
    some = run(made.where(F.pmod(F.xxhash64("tail", "doc_id"), F.lit(each)) == 0), np.zeros(0, np.int64)).select("heads").toArrow().column(0).to_numpy()
    return run(made, np.sort(some)[len(some) * np.arange(1, parts) // parts] if len(some) else np.zeros(0, np.int64))


class Index:
    """A shard's inverted index: for each id its units and their BM25 weights."""

    def __init__(self, tails: list[np.ndarray], n: int, mean: float, df: np.ndarray, bags: list[bytes] | None = None):
        self.bags = [bag_of(b) for b in bags] if bags else [np.unique(x, return_counts=True) for x in tails]
        length = np.array([int(tf.sum()) for _, tf in self.bags])
        ids, tf = (np.concatenate([x[k] for x in self.bags]) for k in (0, 1))
        order = np.argsort(ids, kind="stable")
        self.ids, tf = ids[order].astype(np.int64), tf[order]
        self.unit = np.repeat(np.arange(len(tails)), [len(x) for x, _ in self.bags])[order]
        self.idf = idf_of(n, df)
        self.weight = (self.idf[self.ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.unit] / mean))).astype(np.float32)
        self.n = len(tails)
        self.at = np.searchsorted(self.ids, np.arange(len(df) + 1))

        # ids of many units as rows over all units, which add up faster than postings; under COMMON values a posting
        often = np.flatnonzero(np.diff(self.at) * COMMON > self.n)
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        mine = self.row[self.ids] >= 0
        self.dense[self.row[self.ids[mine]], self.unit[mine]] = self.weight[mine]

    def score(self, ids: np.ndarray) -> np.ndarray:
        """Every unit's BM25 score by all distinct ids."""
        return self.score_distinct(np.unique(ids))

    def score_distinct(self, t: np.ndarray) -> np.ndarray:
        """score() of ids that are distinct and ascend."""
        row = self.row[t]
        out = self.dense[row[row >= 0]].sum(axis=0)
        rare = t[row < 0]
        begin = self.at[rare]
        n = self.at[rare + 1] - begin
        to = np.cumsum(n)
        if len(to):  # all postings in the order of ids
            at = np.repeat(begin - to + n, n) + np.arange(int(to[-1]))
            np.add.at(out, self.unit[at], self.weight[at])
        return out


def ranked(s: np.ndarray, block: int = 256) -> Iterator[int]:
    """Units of positive score, best first, ties to the smaller; sorted a block at a time."""
    near = np.flatnonzero(s)
    while len(near):
        least = -np.partition(-s[near], block - 1)[block - 1] if len(near) > block else 0
        first = near[s[near] >= least]
        yield from first[np.lexsort((first, -s[first]))].tolist()
        near = near[s[near] < least]


def fill(tails: list[np.ndarray], index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (unit, start, length). Units have 1 to window - 1 ids."""
    start, used, out, first = [0] * len(tails), np.zeros(len(tails), bool), [], 0
    rest = None  # the unit that was cut last
    while True:
        if rest is None:
            while first < len(tails) and used[first]:
                first += 1
            if first == len(tails):
                break
            rest = first
        seed, pieces, room = rest, [], window
        rest, order = None, iter((seed,))
        used[seed] = True
        tried_scores = False
        while room:
            u = next(order, None)
            if u is None:
                if tried_scores:
                    while first < len(tails) and used[first]:
                        first += 1
                    if first == len(tails):
                        break
                    u = first
                else:
                    tried_scores = True
                    s = index.score_distinct(index.bags[seed][0])
                    s[used] = 0
                    order = ranked(s)
                    continue
            elif u != seed and used[u]:
                continue
            used[u] = True
            n = min(room, len(tails[u]) - start[u])
            pieces.append((u, start[u], n))
            start[u] += n
            room -= n
            if start[u] < len(tails[u]):
                rest = u
        out.append(pieces)
    if out and (short := sum(n for _, _, n in out[-1])) < window:
        out += _powers(out.pop(), short)
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """A short sequence cut into sequences whose lengths are its length's powers of two."""
    out, left = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, mine = total & (1 << bit), []
        while room:
            u, s, n = left.pop(0)
            k = min(n, room)
            mine.append((u, s, k))
            room -= k
            if k < n:
                left.insert(0, (u, s + k, n - k))
        if mine:
            out.append(mine)
    return out


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 1) -> DataFrame:
    """docs(doc_id, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    made = C.materialize(units(docs, tokenizer, kind, end_id), "pack-units")
    n, mean, df, left = statistics(made)
    shards = C.parts_for(left, SHARD)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def sequences(rows: list[tuple], seq: int) -> tuple[pa.RecordBatch, int]:
        """Pieces of a shard's units (doc_id, doc_tokens, crcs, tail, bag), numbered from seq on."""
        out = []
        for doc_id, total, crcs, _, _ in rows:
            for k, crc in enumerate(crcs):
                out.append((doc_id, k * WINDOW, WINDOW, crc, total, seq, 0))
                seq += 1
        kept = [r for r in rows if r[3]]
        tails = [C.unpack_planes(r[3], "<u4") for r in kept]
        if tails:
            for pieces in fill(tails, Index(tails, n, mean, df, [r[4] for r in kept])):
                offset = 0
                for u, s, m in pieces:
                    doc_id, total, crcs, _, _ = kept[u]
                    out.append((doc_id, len(crcs) * WINDOW + s, m, zlib.crc32(tails[u][s : s + m].tobytes()), total, seq, offset))
                    offset += m
                seq += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names), seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range of units may hold more than a shard (ties of heads, uneven ranges): it is cut into shards as it comes."""
        from pyspark import TaskContext

        seq, rows, size = TaskContext.get().partitionId() << 40, [], 0
        for b in C.slices(batches):
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "tail", "bag")), strict=True):
                rows.append(r)
                size += len(r[3]) // 4
                if size >= 1.25 * SHARD:
                    out, seq = sequences(rows, seq)
                    yield out
                    rows, size = [], 0
        if rows:
            yield sequences(rows, seq)[0]
        C.give_back()

    order = ["part", "heads", F.col("doc_id").asc_nulls_first(), F.col("doc_tokens"), F.xxhash64("tail", "crcs")]
    parts = max(1, -(-shards // 4))  # each cut into shards
    dealt = by_heads(made, n, mean, df, parts).repartition(parts, "part").sortWithinPartitions(*order)
    return dealt.select("doc_id", "doc_tokens", "crcs", "tail", "bag").mapInArrow(run, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
