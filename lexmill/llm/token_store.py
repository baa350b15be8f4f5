"""Token ids in binary shards with a minimal perfect hash index for keyed access.

Format. A shard is three files. NAME.ids: 8 bytes magic, then the ids of its documents in ascending doc_id
order as little-endian unsigned integers of 2 bytes (4 if the vocabulary needs them), nothing between
documents. NAME.mph: an .npz of the hash function's levels and, by its slots, each key's fingerprint, first
row and number of copies, and by rows their starts and lengths; it holds no key. NAME.keys: the keys in
ascending order, for those who want all of them. A key is a doc_id. Rows without one have no key: they
are the first rows, and the index has their number. Rows that repeat a doc_id lie side by side, ordered by a
hash of the text and by the text, and their slot says how many they are; a key of very many rows may go on in the
next shard. The manifest has each shard's least and greatest key: lookup() finds a key's shards there, then
takes a constant number of steps: hash, compare the fingerprint, seek.

Ids come from the tokenizers library alone. As its pre-tokenizers never join what a single space parts,
a text is cut there, and pieces that a worker has met lately aren't encoded again; where white space is not so
simple, the whole text is one piece.

Nulls and edges: a null text is the empty text and has the end id alone; an empty table gives no shard;
columns other than the id and the text are ignored whatever they are called.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import common as C

MAGIC = b"LMTOKID1"
#: Pieces whose ids a worker keeps before it starts anew (and eight times as many ids), and new pieces encoded at a time: the library
#: takes some hundred bytes a token while it encodes.
CACHE, NEW = 500_000, 20_000

#: A space after which white space or nothing follows: the pre-tokenizer of byte-level vocabularies may take it with what is before it.
_GAP = re.compile(r" (?=\s|\Z)")
_ODD = re.compile(r"\s")
#: Words that the pre-tokenizers leave whole and the normalisers change by lower case alone: composed Latin letters, maybe a space before.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: How byte-level vocabularies write bytes as characters.
_BYTES = {b: chr(c) for b, c in zip(range(256), (lambda shown: [b if b in shown else 256 + sum(x not in shown for x in range(b)) for b in range(256)])({*range(33, 127), *range(161, 173), *range(174, 256)}), strict=True)}
_MARKS = ".,;:!?"
#: Marks that aren't between a letter or digit and white space, line ends beside white space.
_INNER = re.compile(r"[.,;:!?\n](?:(?<=[.,;:!?])(?:(?![ \n]|\Z)|(?<![^\W_].))|(?<=\n)(?:(?=\s|\Z)|(?<!\S\n)))")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes.

    kind "byte" (byte-level, no normaliser; a space belongs to the word after it) or "word" (lower case, word
    ends, white space dropped).
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.kind = kind
        self.clear()
        self.mark, self.between = ("\n", "\n") if kind == "byte" else ("|", " | ")
        (self.mark_id,) = self.tok.encode(self.mark, add_special_tokens=False).ids

    def library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str | None) -> list[str]:
        """Pieces that the pre-tokenizer parts anyway: at single spaces and, where all of them stand plainly, at marks and line ends."""
        if not text:
            return []
        plain = not _INNER.search(text) and "\u0130" not in text  # which has a mark of its own in lower case
        if self.kind == "word":
            text = text.replace("\n", " ")
            for m in _MARKS if plain else "":
                text = text.replace(m, " " + m)
            return text.split(" ")
        if _GAP.search(text) or "\0" in text:
            return [text]
        text = text.replace(" ", "\0 ")
        if plain:
            text = text.replace("\n", "\0\n\0")
            for m in _MARKS:
                text = text.replace(m, "\0" + m)
        return text.split("\0")

    def clear(self) -> None:
        """Forgets all pieces: known has their numbers, ids, begin and length what they are."""
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        """Pieces with their ids, one after another."""
        n, at = len(self.known), self.used
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        while len(self.begin) < n + len(pieces):
            self.begin, self.length = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.begin, self.length))
        self.ids[at : at + len(ids)] = ids
        self.begin[n : n + len(pieces)], self.length[n : n + len(pieces)] = at + np.cumsum(length) - length, length
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used += len(ids)

    def encode_new(self, new: list[str]) -> None:
        """Adds pieces. Those without white space but one leading space are encoded as one text, parted by a mark that none of
        them has and that is one token by itself; should a mark have gone into another token, all are encoded alone."""
        for at in range(0, len(new), NEW):
            self._encode_some(new[at : at + NEW])

    def _encode_some(self, new: list[str]) -> None:
        words = [x for x in new if _LETTERS.fullmatch(x)]
        if words:  # one pre-token each: the model alone
            low = words if self.kind == "byte" else [x.strip(" ").lower() for x in words]
            each = [[t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(_BYTES))] for x in low]
            length = np.fromiter(map(len, each), np.int64, len(each))
            self.add(words, np.fromiter(chain.from_iterable(each), "<u4", int(length.sum())), length)
            rest = set(words)
            new = [x for x in new if x not in rest]
        if not new:
            return
        odd = [x for x in new if self.mark in x or not x or x == " " or _ODD.search(x, x[0] == " ")]
        rest = set(odd)
        plain = [x for x in new if x not in rest]
        if plain:
            (e,) = self.tok.encode_batch_fast([self.between.join(plain) + self.between], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            end = np.flatnonzero(ids == self.mark_id)
            if len(end) == len(plain) and end[-1] == len(ids) - 1:
                self.add(plain, ids[ids != self.mark_id], np.diff(end, prepend=-1) - 1)
            else:
                odd = new
        if odd:
            each = [np.array(e.ids, "<u4") for e in self.tok.encode_batch(odd, add_special_tokens=False)]
            self.add(odd, np.concatenate(each), np.array([len(x) for x in each]))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of ids."""
        if len(self.known) > CACHE or self.used > 8 * CACHE:
            self.clear()
        cut = [self.pieces(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self.encode_new(list(dict.fromkeys(flat[i] for i in missing)))
            at[missing] = [self.known[flat[i]] for i in missing]
        n = self.length[at]
        to = np.cumsum(n)
        ids = self.ids[np.repeat(self.begin[at] - to + n, n) + np.arange(int(to[-1]) if len(to) else 0)]
        ends = np.r_[0, to][np.cumsum([len(x) for x in cut], dtype=np.int64)]
        return ids, np.diff(ends, prepend=0)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode_flat() of a column of texts."""
        return self.encode_flat(texts.to_pylist())

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        ids, n = self.encode_flat(texts)
        data, out, a = ids.tobytes(), [], 0
        for b in np.cumsum(n).tolist():
            out.append(data[4 * a : 4 * b])
            a = b
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


# What a byte is to the byte-level pre-tokenizer. Letters: ASCII and Latin or Cyrillic ones of two bytes; _VISIBLE begins a character
# that isn't white space; _OTHER may be anything; _EDGE is beyond the text.
_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _LINE, _VISIBLE, _OTHER, _EDGE = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
for _first, _last, _is in (("A", "Z", _LETTER), ("a", "z", _LETTER), ("0", "9", _DIGIT), ("'", "'", _QUOTE), (" ", " ", _SPACE), ("\n", "\n", _LINE)):
    _CLASS[ord(_first) : ord(_last) + 1] = _is
_CLASS[0xC3:0xE0] = _CLASS[0xE4:0xF5] = _VISIBLE  # not those that U+0085, U+00A0, U+1680, U+2000 and U+3000 begin with
_CLASS = _CLASS.tobytes()
_TWO = bytes(b in (*range(0xC3, 0xCA), 0xD0, 0xD1) for b in range(256))  # U+00C0 to U+027F and U+0400 to U+047F but U+00D7 and U+00F7


def _pairs() -> bytes:
    """For the classes of two bytes on end, 4 bits each: 1 if the pre-tokenizer parts between them whatever stands around, 2 if before both,
    4 and 8 if a line end is the second and the first of them and what is beside it is seen (or the text begins)."""
    out, seen, signs = np.zeros(256, np.uint8), (_LETTER, _DIGIT, _SIGN, _QUOTE), (_LETTER, _DIGIT, _SIGN)
    for a, b in ((a, b) for a in range(9) for b in range(9)):
        between = (a != b and a in signs and b in signs) or (b == _QUOTE and a in (_LETTER, _DIGIT)) or (b == _LINE and a in seen)
        before = a == _SPACE and b in (*seen, _VISIBLE)  # the space belongs to what follows
        out[a << 4 | b] = between | before << 1 | (b == _LINE and a in (*seen, _EDGE)) << 2 | (a == _LINE and b in seen) << 3
    return out.tobytes()


_PAIRS = _pairs()


class ByteEncoder:
    """Encoder of kind "byte" over Arrow columns: pieces are cut, told apart and put together without a Python object each.

    A piece that is one pre-token (a word, number or run of signs with one space before at most, or a line end) goes
    to the library as it is, many at a time, parted by white space, which its byte-level writing has not; all others go to Encoder.
    """

    def __init__(self, rest: Encoder):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.rest = rest
        self.words = Tokenizer(self.rest.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        vocab = self.rest.tok.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes by id
        self.size[list(vocab.values())] = [len(x) for x in vocab]
        self.written = np.array([ord(_BYTES[b]) for b in range(256)], "<u2")
        self.clear()

    @staticmethod
    def fits(rest: Encoder) -> bool:
        """Whether the pre-tokenizer is the one that _cuts() knows and nothing else parts or changes a text."""
        how, added = json.loads(rest.tok.pre_tokenizer.__getstate__()), rest.tok.get_added_tokens_decoder()
        return how["type"] == "ByteLevel" and how["use_regex"] and not how["add_prefix_space"] and rest.tok.normalizer is None and all(t.special for t in added.values())

    def clear(self) -> None:
        self.known, self.ids, self.length, self.met = pa.array([], pa.binary()), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Of too many pieces those stay that were met again since the last time, if they are no more than half; else none."""
        if len(self.known) <= CACHE and len(self.ids) <= 8 * CACHE:
            return
        again = self.met > 1
        if 2 * int(again.sum()) > CACHE or int(self.length[again].sum()) > 4 * CACHE:
            return self.clear()
        self.known, self.ids, self.length = self.known.filter(pa.array(again)), self.ids[np.repeat(again, self.length)], self.length[again]
        self.met = np.zeros(len(self.known), np.int64)

    @staticmethod
    def classes(x: np.ndarray) -> np.ndarray:
        out = np.frombuffer(bytearray(x).translate(_CLASS), np.uint8)
        two = np.flatnonzero(np.frombuffer(x[:-1].tobytes().translate(_TWO), bool))
        out[two] = out[two + 1] = _LETTER
        sign = two[(x[two] == 0xC3) & ((x[two + 1] == 0x97) | (x[two + 1] == 0xB7))]
        out[sign], out[sign + 1] = _VISIBLE, _OTHER
        return out

    def pieces(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes x of texts that begin at rows (and end where the next begins)."""
        c = self.classes(x)
        first = rows[:-1][np.diff(rows) > 0]
        pair = np.full(len(x) + 1, _EDGE << 4, np.uint8)  # each byte with the one before it
        pair[1:] = c << 4
        pair[first] = _EDGE << 4
        pair[:-1] |= c
        pair[-1] |= _EDGE
        cut = np.frombuffer(pair.tobytes().translate(_PAIRS), np.uint8)
        begin = cut[:-1] & 1 > 0
        begin[1:] |= (cut[1:-1] & 8 > 0) & (cut[:-2] & 4 > 0)
        begin |= cut[1:] & 2 > 0
        begin[first] = True
        return np.flatnonzero(begin)

    def encode_pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and each one's number of ids."""
        if not len(new):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        x, at = _bytes_of(new)
        c = self.classes(x)
        odd = (c == _QUOTE) | (c >= _VISIBLE)
        odd[1:] |= (c[1:] == _SPACE) | (c[1:] == _LINE)
        odd[at[1:-1]] &= c[at[1:-1]] != _SPACE
        odd[at[1:-1]] &= c[at[1:-1]] != _LINE
        odd = np.add.reduceat(odd, at[:-1], dtype=np.int64) > 0
        length, parts = np.zeros(len(new), np.int64), []
        plain = np.flatnonzero(~odd)
        for a in range(0, len(plain), NEW):
            some = plain[a : a + NEW]
            ids = self.encode_words(x, at[some], at[some + 1])
            end, wanted = np.cumsum(self.size[ids]), np.cumsum(at[some + 1] - at[some])
            to = np.searchsorted(end, wanted)
            if len(ids) == 0 or to[-1] != len(ids) - 1 or not np.array_equal(end[to], wanted):  # a vocabulary without some byte
                odd[some] = True
                continue
            length[some] = np.diff(to, prepend=-1)
            parts.append(ids)
        got, n = self.rest.encode_flat([b.decode() for b in new.filter(pa.array(odd)).to_pylist()])
        length[odd] = n
        which, begin = np.repeat(odd, length), np.cumsum(length)
        out = np.zeros(int(begin[-1]) if len(begin) else 0, "<u4")
        out[which] = got
        out[~which] = np.concatenate(parts) if parts else 0
        return out, length

    def encode_words(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - begin + 1  # and the white space
        to = np.cumsum(n)
        at = np.repeat(begin - to + n, n) + np.arange(int(to[-1]))
        at[to - 1] = 0
        written = self.written[x[at]]
        written[to - 1] = 32
        (e,) = self.words.encode_batch_fast([written.tobytes().decode("utf-16-le")], add_special_tokens=False)
        return np.array(e.ids, "<u4")

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of ids."""
        self.forget()
        x, rows = _bytes_of(texts)
        if not len(x):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        begin = self.pieces(x, rows)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.r_[begin, len(x)].astype(np.int32)), pa.py_buffer(x)]).dictionary_encode()
        code, found = coded.indices.to_numpy(), coded.dictionary
        at = pc.index_in(found, value_set=self.known).fill_null(-1).to_numpy().copy()
        fresh = np.flatnonzero(at < 0)
        new = found.take(pa.array(fresh))
        ids, n = self.encode_pieces(new)
        at[fresh] = len(self.known) + np.arange(len(fresh))
        self.known, self.ids, self.length = pa.concat_arrays([self.known, new]), np.concatenate([self.ids, ids]), np.concatenate([self.length, n])
        at = at[code]
        self.met = np.bincount(at, minlength=len(self.known)) + np.pad(self.met, (0, len(new)))
        n = self.length[at]
        to = np.cumsum(n)
        ids = self.ids[np.repeat((np.cumsum(self.length) - self.length)[at] - to + n, n) + np.arange(int(to[-1]))]
        return ids, np.diff(np.r_[0, to][np.searchsorted(begin, rows)])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each begins and the last ends; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_encoders: dict[tuple[str, str], Encoder | ByteEncoder] = {}
C.caches["tokens"] = _encoders.clear


def encoder(path: str, kind: str) -> Encoder | ByteEncoder:
    """The worker's own encoder; it outlives a task, as the worker does, but not tasks of other operators."""
    C.begin("tokens")
    if (path, kind) not in _encoders:
        _encoders.clear()
        made = Encoder(path, kind)
        _encoders[path, kind] = ByteEncoder(made) if kind == "byte" and ByteEncoder.fits(made) else made
    return _encoders[path, kind]


# minimal perfect hashing -----------------------------------------------------


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix(keys ^ C.mix(np.array([seed + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class Mph:
    """Levels of bits: a key stands at the first level where it shares its bit with no other; its slot is the number of set bits before it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sizes = [int(x.sum()) for x in levels]
        self.base = np.cumsum([0, *sizes])
        self.rank = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> Mph:
        """keys: distinct unsigned 64-bit numbers (equal ones would never part: an error)."""
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys must be distinct")
        levels, rest = [], keys
        while len(rest):
            m = max(64, int(gamma * len(rest)))
            at = (_hash(rest, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for keys it was not built of (fingerprints tell)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_hash(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.base[k] + self.rank[k][at[hit]]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 10_007) >> np.uint64(32)).astype(np.uint32)


# writing ------------------------------------------------------------------------

_MANIFEST = "shard int, n_docs long, n_tokens long, n_null long, least long, greatest long, path string"


class _File:
    """All or nothing: a lost attempt leaves no half file under the final name, and each attempt writes the same bytes."""

    def __init__(self, path: str):
        self.fs, self.at = C.filesystem(path)
        self.tmp = f"{self.at}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.at)


def write_store(docs: DataFrame, root: str, tokenizer: str, kind: str, end_id: int, wide: bool = False, shard_bytes: int = 24 << 20) -> DataFrame:
    """Encodes docs(doc_id, text) and writes shards under root in ascending doc_id order (nulls first).

    Returns the manifest, one row a shard: shard, n_docs, n_tokens, n_null, least, greatest (doc_id), path, start
    (ids in all shards before). Texts are shuffled by ranges of doc_id and of the text's hash, so a key of very many
    rows is spread too; ids go to the file as they come.
    """
    n = C.parts_for(C.text_bytes(docs), shard_bytes)
    order = (F.col("doc_id").asc_nulls_first(), F.col("h"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    unit = "<u4" if wide else "<u2"
    tail = np.array([end_id], "<u4").tobytes()
    fs, at = C.filesystem(root)
    fs.create_dir(at, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, k = encoder(tokenizer, kind), TaskContext.get().partitionId()
        path, ids_file, keys, lengths, n_null = f"{root}/{k:06d}", None, [], [], 0
        for b in C.slices(batches):
            if ids_file is None:
                ids_file = _File(f"{path}.ids")
                ids_file.write(MAGIC)
            n_null += b.column(0).null_count
            keys.append(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            for x in enc.encode_all(b.column(1).to_pylist()):
                ids = np.frombuffer(x + tail, "<u4")
                if not wide and ids.max() > 0xFFFF:
                    raise ValueError("an id needs 4 bytes: pass wide=True")
                lengths.append(len(ids))
                ids_file.write(ids.astype(unit).tobytes())
        if ids_file is None:
            return
        ids_file.close()
        length = np.array(lengths, np.int64)
        key, first, copies = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        f = Mph.build(key.view(np.uint64))
        slot = f.slots(key.view(np.uint64))
        index = {"fingerprint": np.zeros(len(key), np.uint32), "first": np.zeros(len(key), np.int64), "copies": np.zeros(len(key), np.int64)}
        index["fingerprint"][slot], index["first"][slot], index["copies"][slot] = fingerprints(key.view(np.uint64)), first + n_null, copies
        out = io.BytesIO()
        np.savez(out, **index, n_null=n_null, start=np.cumsum(length) - length, length=length, sizes=np.array([len(x) for x in f.levels], np.int64), **{f"level{i}": np.packbits(x) for i, x in enumerate(f.levels)})
        for end, data in ((".mph", out.getvalue()), (".keys", key.astype("<i8").tobytes())):
            file = _File(path + end)
            file.write(data)
            file.close()
        span = [[int(key[i])] if len(key) else [None] for i in (0, -1)]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "n_docs": [len(lengths)], "n_tokens": [int(length.sum())], "n_null": [n_null], "least": pa.array(span[0], pa.int64()), "greatest": pa.array(span[1], pa.int64()), "path": [path]})

    return C.materialize(starts(dealt.mapInArrow(shard, _MANIFEST)), "token-manifest")


def starts(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """Adds start, the ids in all shards before: sums by groups of shards first, then within each."""
    m = C.materialize(manifest, "token-shards").withColumn("g", F.floor(F.col("shard") / group))
    ahead = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each `group` shards
    sums = m.groupBy("g").agg(F.sum("n_tokens").alias("s")).select("g", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return m.join(sums, "g").withColumn("start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("g", "ahead")


# reading ------------------------------------------------------------------------


class Shard:
    """An open shard: constant-time access by key."""

    def __init__(self, path: str, wide: bool = False):
        fs, at = C.filesystem(path)
        self.unit = np.dtype("<u4" if wide else "<u2")
        self.fs, self.at = fs, at
        self.file = fs.open_input_file(at + ".ids")
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path} is no shard of ids")
        with fs.open_input_file(at + ".mph") as f:
            x = np.load(io.BytesIO(f.read()))
        self.n_null = int(x["n_null"])
        self.index = {k: x[k] for k in ("fingerprint", "first", "copies", "start", "length")}
        self.mph = Mph([np.unpackbits(x[f"level{i}"], count=int(m)).astype(bool) for i, m in enumerate(x["sizes"])])

    def keys(self) -> np.ndarray:
        with self.fs.open_input_file(self.at + ".keys") as f:
            return np.frombuffer(f.read(), "<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key (int64), -1 where the fingerprint says that it isn't here."""
        keys = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        slot = self.mph.slots(keys)
        ok = slot >= 0
        ok[ok] = self.index["fingerprint"][slot[ok]] == fingerprints(keys[ok])
        return np.where(ok, slot, -1)

    def rows(self, slot: int) -> range:
        return range(int(self.index["first"][slot]), int(self.index["first"][slot] + self.index["copies"][slot]))

    def ids(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents with this key; of null: of all without one."""
        if doc_id is None:
            return [self.row(i) for i in range(self.n_null)]
        s = int(self.find(np.array([doc_id]))[0])
        return [] if s < 0 else [self.row(i) for i in self.rows(s)]

    def row(self, i: int) -> np.ndarray:
        self.file.seek(8 + int(self.index["start"][i]) * self.unit.itemsize)
        return np.frombuffer(self.file.read(int(self.index["length"][i]) * self.unit.itemsize), self.unit)

    def digest(self, doc_id: int | None, i: int, start: int) -> tuple:
        return doc_id, start + int(self.index["start"][i]), int(self.index["length"][i]), zlib.crc32(self.row(i).astype("<u4").tobytes())


_DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _batches(rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    out = []
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)


def read_store(manifest: DataFrame, wide: bool = False) -> DataFrame:
    """Reads every key of every shard through its index: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for r in b.to_pylist():
                    s = Shard(r["path"], wide)
                    keys = s.keys()
                    slots = s.find(keys)
                    if (slots < 0).any():
                        raise ValueError(f"{r['path']}: the index misses a key")
                    yield from (s.digest(None, i, r["start"]) for i in range(s.n_null))
                    for key, k in zip(keys.tolist(), slots.tolist(), strict=True):
                        yield from (s.digest(key, i, r["start"]) for i in s.rows(k))

        yield from _batches(rows())

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, _DIGESTS)


def lookup(ids: DataFrame, manifest: DataFrame, wide: bool = False) -> DataFrame:
    """ids(doc_id) -> a row for each document with one of these keys, read by key: doc_id, start, n_tokens, ids_crc32; keys that aren't there give none.

    Keys are sent to the shards whose span has them: the spans, 16 bytes a shard of 24 MB of text, are what tasks get.
    """
    spans = manifest.where("least is not null").select("shard", "least", "greatest").orderBy("least", "shard").toArrow()
    shard, least, greatest = (spans.column(c).to_numpy() for c in ("shard", "least", "greatest"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            lo, hi = np.searchsorted(greatest, keys, "left"), np.searchsorted(least, keys, "right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(shard[at].astype(np.int32))], ["doc_id", "shard"])

    def read(key, t, m):
        found = []
        if m.num_rows and t.num_rows:
            r = m.to_pylist()[0]
            s, keys = Shard(r["path"], wide), np.unique(t.column("doc_id").to_numpy())
            found = [s.digest(k, i, r["start"]) for k, x in zip(keys.tolist(), s.find(keys).tolist(), strict=True) if x >= 0 for i in s.rows(x)]
        return pa.table({x.split()[0]: pa.array(c, pa.int64()) for x, c in zip(_DIGESTS.split(", "), list(zip(*found, strict=True)) or [[]] * 4, strict=True)})

    sent = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(route, "doc_id long, shard int")
    return sent.groupBy("shard").cogroup(manifest.groupBy("shard")).applyInArrow(read, _DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the whole table written, then read back from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_store(write_store(docs, C.new_path(spark, "token-store"), public_tokenizers.path("word_bpe_49k.json"), "word", end_id=2))
