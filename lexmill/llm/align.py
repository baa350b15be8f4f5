"""Cross-tokenizer alignment by deduplicated segments.

A text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B, which adds the
space itself). Offsets where tokens of both end cut the tokens into groups; the two tokens that end there are a link.

1. Segments. The text is cut before runs of spaces that stand between characters that aren't white space. Neither vocabulary
   can merge across such a place: `check_vocabularies` makes sure that no entry of either has a space after a
   character that isn't white space, and that A's pre-tokenizer and B's normaliser leave spaces as they are. Each segment begins with
   a space, as a text does, so it is encoded as a text is. Elsewhere (tabs, line ends, the ends of a text) nothing is cut.
2. Documents are dealt to chunks (chunks.py) and stored as their segments' numbers and the chunk's distinct segments, which
   are cut into ranges of their hashes. A range encodes and aligns each distinct segment of the corpus once and replies
   to each chunk in the order in which that chunk named them. Segments are compared as texts, not by their hashes.
3. Join. A chunk counts its documents' links by pair of ids; pairs meet in ranges of B's ids, which add them up over the
   corpus, find each B id's highest count, and reply.
4. A chunk composes its documents from the segments' numbers: sums, and groups one after another.

A segment whose joined bytes, by A or by B, are not its own has no tokens, and neither has any document with it: its
numbers are zeros and its hash is the empty string. So it is with null and empty texts. Special tokens' strings in texts are plain text.
Repeated rows are documents of their own. Other columns are ignored. A hot segment or pair is an entry a chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chunks
from lexmill.llm import common as C

CHUNK_BYTES, BATCH = 6 << 20, 20_000

_CUT = re.compile(r"(?<=\S)(?= +\S)")
#: Where a text's spaces aren't all single ones between other characters.
_ODD = re.compile(r" \s|[^\S ] | \Z")


def segments(text: str) -> list[str]:
    """A text's segments, each without the space that it begins with; joined by spaces they are the text."""
    if not text:
        return []
    if text[0] != " " and not _ODD.search(text):
        return text.split(" ")
    return [s[1:] for s in _CUT.split(" " + text)]


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of Latin-1 are themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        of = byte_level()
        special = {x["id"] for x in json.loads(self.a.to_str())["added_tokens"]}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = piece.encode() if i in special else bytes(of[c] for c in piece)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def check(self) -> None:
        """Raises where a segment's ids could differ from the whole text's."""
        pre = json.loads(self.a.to_str())
        kind = pre["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex") or pre["normalizer"]:
            raise ValueError("A must part texts as byte-level vocabularies do, and leave them as they are")
        for table in (self.a_bytes, self.b_bytes):
            for x in table:
                at = x.find(b" ", 1)
                while at > 0:
                    before = x[:at].decode("utf-8", "replace")[-1]
                    if not before.isspace():
                        raise ValueError(f"a vocabulary can merge across a space: {x!r}")
                    at = x.find(b" ", at + 1)
        for probe in ("  a", "a  b", "ÄﬁⅣ ́"):
            if b"".join(self.b_bytes[i] for i in self.b.encode(probe)) != f" {probe}".encode():
                raise ValueError("B must leave texts as they are and begin them with a space")

    def align(self, keys: list[str]) -> tuple[np.ndarray, ...]:
        """Of segments without their first space: numbers of A and of B tokens (0: none), all ids of A and of B, and whether a group ends with each."""
        texts = [f" {k}" for k in keys]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode(keys, num_threads=1)
        size = np.array([len(t.encode()) for t in texts], np.int64)
        out = []
        ok = np.ones(len(keys), bool)
        for ids, table, length in ((ids_a, self.a_bytes, self.a_len), (ids_b, self.b_bytes, self.b_len)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            if b"".join(map(table.__getitem__, flat.tolist())) != "".join(texts).encode() or (np.bincount(np.repeat(np.arange(len(n)), n), length[flat], len(n)) != size).any():
                ok &= [b"".join(map(table.__getitem__, x)) == t.encode() for x, t in zip(ids, texts, strict=True)]
            out.append((n, flat, length))
        (na, a, la), (nb, b, lb) = out
        a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
        end_a, end_b = np.cumsum(la[a]), np.cumsum(lb[b])  # segments follow one another in both
        return np.where(ok, na, 0), np.where(ok, nb, 0), a, b, np.isin(end_a, end_b), np.isin(end_b, end_a)


_own: dict[tuple[str, str], Vocabularies] = {}
C.caches["align"] = _own.clear


def vocabularies(a: str, b: str) -> Vocabularies:
    C.begin("align")
    if (a, b) not in _own:
        _own.clear()
        _own[a, b] = Vocabularies(a, b)
    return _own[a, b]


def _numbers(x: np.ndarray) -> bytes:
    return C.squeeze(C.pack_planes(np.ascontiguousarray(x, np.uint32)))


def _unpacked(x: bytes) -> np.ndarray:
    return C.unpack_planes(C.expand(x), np.uint32).astype(np.int64)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of spans of n from each of begin."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


_STORED = "chunk int, doc_id long, codes binary, range int, n int, texts binary, sizes binary"
_ALIGNED = "chunk int, range int, na binary, nb binary, a binary, b binary, ends_a binary, ends_b binary"
_PAIRS = "range int, chunk int, keys binary, times binary"
_COUNTS = "chunk int, range int, total binary, best binary"
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def cut(t: pa.Table, ranges: int) -> pa.Table:
    """A chunk's documents as the numbers of their segments, and its distinct segments, by ranges of their hashes."""
    C.begin("align")
    ids, known, codes = t.column("doc_id").to_pylist(), {}, []
    for text in t.column("text").to_pylist():
        found = segments(text or "")
        for s in found:
            if s not in known:
                known[s] = len(known)
        codes.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
    names = [s.encode() for s in known]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order))
    at = chunks.cuts(hashes[order], ranges).tolist()
    size = np.array([len(x) for x in names], np.int64)
    parts = [(k, order[i:j].tolist()) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
    d, p, chunk = len(ids), len(parts), t.column("chunk")[0].as_py()
    out = {
        "chunk": pa.array([chunk] * (d + p), pa.int32()),
        "doc_id": pa.array(ids + [None] * p, pa.int64()),
        "codes": pa.array([_numbers(number[c]) for c in codes] + [None] * p, pa.binary()),
        "range": pa.array([None] * d + [k for k, _ in parts], pa.int32()),
        "n": pa.array([None] * d + [len(x) for _, x in parts], pa.int32()),
        "texts": pa.array([None] * d + [C.squeeze(b"".join(names[i] for i in x)) for _, x in parts], pa.binary()),
        "sizes": pa.array([None] * d + [_numbers(size[x]) for _, x in parts], pa.binary()),
    }
    C.give_back()
    return pa.table(out)


def encode_range(t: pa.Table, v: Vocabularies) -> pa.Table:
    """A range's distinct segments, aligned once each; replies to each chunk."""
    known: dict[bytes, int] = {}
    asked = []
    for texts, sizes in zip(t.column("texts").to_pylist(), t.column("sizes").to_pylist(), strict=True):
        data, end = C.expand(texts), np.cumsum(_unpacked(sizes)).tolist()
        mine, a = [], 0
        for b in end:
            mine.append(known.setdefault(data[a:b], len(known)))
            a = b
        asked.append(np.array(mine, np.int64))
    keys, parts = [k.decode() for k in known], []
    del known
    for at in range(0, len(keys), BATCH):
        parts.append(v.align(keys[at : at + BATCH]))
    na, nb, a, b, ends_a, ends_b = (np.concatenate(x) for x in zip(*parts, strict=True))
    begin_a, begin_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    out = {k: [] for k in ("na", "nb", "a", "b", "ends_a", "ends_b")}
    for mine in asked:
        i, j = _ragged(begin_a[mine], na[mine]), _ragged(begin_b[mine], nb[mine])
        for k, x in (("na", _numbers(na[mine])), ("nb", _numbers(nb[mine])), ("a", _numbers(a[i])), ("b", _numbers(b[j])), ("ends_a", _bits(ends_a[i])), ("ends_b", _bits(ends_b[j]))):
            out[k].append(x)
    C.give_back()
    return pa.table({"chunk": t.column("chunk").cast(pa.int32()), "range": t.column("range").cast(pa.int32()), **{k: C.binary_array(x) for k, x in out.items()}})


class Chunk:
    """A chunk's documents and its aligned segments."""

    def __init__(self, t: pa.Table, replies: pa.Table):
        C.begin("align")
        rows = [(i, c) for i, c in zip(t.column("doc_id").to_pylist(), t.column("codes").to_pylist(), strict=True) if c is not None]
        self.ids, self.codes = [i for i, _ in rows], [_unpacked(c) for _, c in rows]
        got = sorted(zip(*(replies.column(k).to_pylist() for k in ("range", "na", "nb", "a", "b", "ends_a", "ends_b")), strict=True), key=lambda r: r[0])
        col = lambda k: np.concatenate([_unpacked(r[k]) for r in got]) if got else np.zeros(0, np.int64)
        self.na, self.nb, self.a, self.b = (col(k) for k in (1, 2, 3, 4))
        flags = lambda k, like: np.concatenate([np.unpackbits(np.frombuffer(r[k], np.uint8), count=len(_unpacked(r[like]))).astype(bool) for r in got]) if got else np.zeros(0, bool)
        self.ends_a, self.ends_b = flags(5, 3), flags(6, 4)
        seg = np.repeat(np.arange(len(self.na)), self.na)
        self.groups = np.bincount(seg[self.ends_a], minlength=len(self.na))  # links, by segment
        self.link = self.b[self.ends_b] << 32 | self.a[self.ends_a]
        self.whole = [len(c) > 0 and bool((self.na[c] > 0).all()) for c in self.codes]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (B's id in the upper half), how often documents have them, and each link's pair."""
        used = [c for c, ok in zip(self.codes, self.whole, strict=True) if ok]
        times = np.bincount(np.concatenate(used), minlength=len(self.na)) if used else np.zeros(len(self.na), np.int64)
        keys, of = np.unique(self.link, return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, of, np.repeat(times, self.groups))
        return keys, n, of

    def names(self) -> list[str]:
        """Each segment's groups as text."""
        out, a, b = [], self.a.tolist(), self.b.tolist()
        stop_a, stop_b = (np.flatnonzero(self.ends_a) + 1).tolist(), (np.flatnonzero(self.ends_b) + 1).tolist()
        i = j = k = 0
        for n in self.groups.tolist():
            mine = []
            for _ in range(n):
                p, q = stop_a[k], stop_b[k]
                mine.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
                i, j, k = p, q, k + 1
            out.append(";".join(mine))
        return out


def _ranges_of(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in the order of the ranges that their B id falls into, and where each range begins."""
    part = (keys >> 32) % ranges
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(ranges + 1))


def align(docs: DataFrame, a: str, b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text) -> a row a row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of `a1,a2|b1;a3|b2,b3`)."""
    Vocabularies(a, b).check()
    assigned, n = chunks.assign(docs.select("doc_id", "text"), chunk_bytes)
    ranges = max(chunks.LEAST_CHUNKS, n // 4)
    stored = chunks.store(assigned, n, lambda df: df.groupBy("chunk").applyInArrow(lambda key, t: cut(t, ranges), _STORED))
    named = stored.where("range is not null").select("chunk", "range", "texts", "sizes")
    aligned = C.materialize(named.groupBy("range").applyInArrow(lambda key, t: encode_range(t, vocabularies(a, b)), _ALIGNED), "align-segments")
    mine = stored.where("range is null").select("chunk", "doc_id", "codes")

    def count(key, t, r):
        c = Chunk(t, r)
        keys, times, _ = c.pairs()
        some = np.flatnonzero(times)
        keys, times = keys[some], times[some]
        order, at = _ranges_of(keys, ranges)
        parts = [(k, order[i:j]) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
        C.give_back()
        return pa.table({"range": pa.array([k for k, _ in parts], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "keys": C.binary_array([C.squeeze(C.pack_sorted(keys[x].astype(np.uint64))) for _, x in parts]), "times": C.binary_array([C.squeeze(C.pack_planes(times[x])) for _, x in parts])})

    def total(key, t):
        parts = [C.unpack_sorted(C.expand(x)) for x in t.column("keys").to_pylist()]
        times = np.concatenate([C.unpack_planes(C.expand(x), np.int64) for x in t.column("times").to_pylist()])
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, of, times)
        _, b_of = np.unique(keys >> np.uint64(32), return_inverse=True)
        most = np.zeros(int(b_of.max()) + 1, np.int64)
        np.maximum.at(most, b_of, n)
        best, stop = n == most[b_of], np.cumsum([len(x) for x in parts])[:-1]
        return pa.table({"chunk": t.column("chunk").cast(pa.int32()), "range": t.column("range").cast(pa.int32()), "total": C.binary_array([C.squeeze(C.pack_planes(n[x])) for x in np.split(of, stop)]), "best": C.binary_array([_bits(best[x]) for x in np.split(of, stop)])})

    packets = mine.groupBy("chunk").cogroup(aligned.groupBy("chunk")).applyInArrow(count, _PAIRS)
    counts = C.materialize(packets.groupBy("range").applyInArrow(total, _COUNTS), "align-counts")
    both = aligned.withColumns({"total": F.lit(None).cast("binary"), "best": F.lit(None).cast("binary")}).unionByName(counts, allowMissingColumns=True)

    def compose(key, t, r):
        has = np.array([x is not None for x in r.column("na").to_pylist()], bool)
        c = Chunk(t, r.filter(pa.array(has)))
        keys, times, of = c.pairs()
        order, at = _ranges_of(keys[np.flatnonzero(times)], ranges)
        order = np.flatnonzero(times)[order]
        n, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at_of = dict(enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)))
        for k, x, y in zip(*(r.filter(pa.array(~has)).column(j).to_pylist() for j in ("range", "total", "best")), strict=True):
            i, j = at_of[k]
            n[order[i:j]] = C.unpack_planes(C.expand(x), np.int64)
            best[order[i:j]] = np.unpackbits(np.frombuffer(y, np.uint8), count=j - i).astype(bool)
        seg = np.repeat(np.arange(len(c.na)), c.groups)
        n_best, sums = np.bincount(seg, best[of], len(c.na)).astype(np.int64), np.zeros(len(c.na), np.int64)
        np.add.at(sums, seg, n[of])
        names, out = c.names(), []
        for i, codes, ok in zip(c.ids, c.codes, c.whole, strict=True):
            if ok:
                g = int(c.groups[codes].sum())
                sha = hashlib.sha256(";".join(map(names.__getitem__, codes.tolist())).encode()).hexdigest()
                out.append((i, int(c.na[codes].sum()), int(c.nb[codes].sum()), g, g, int(n_best[codes].sum()), int(sums[codes].sum()), sha))
            else:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
        C.give_back()
        cols = list(zip(*out, strict=True)) or [[]] * 8
        return pa.table({f.split()[0]: pa.array(x, pa.string() if f.endswith("string") else pa.int64()) for f, x in zip(ROWS.split(", "), cols, strict=True)})

    out = C.materialize(mine.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(compose, ROWS), "align-rows")
    C.drop(stored, aligned, counts)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents, byte_bpe_50k against piece_bpe_32k."""
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
