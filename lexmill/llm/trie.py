"""Prefix trie of conversations, from the Cartesian tree over the sorted conversations' LCP array.

1. A conversation is rebuilt as the sequence of its turns, each as 128 bits of a hash of role and text and the
   bytes of its text. Conversations are sorted by that sequence, then by conv_id, over the whole table; a range of
   that order is a block, one task's. Equal conversations lie side by side and may fill many blocks.
2. LCP array: how many turns a conversation shares with the one before it. A conversation opens the nodes of the depths
   from its LCP (exclusive) to its length, and a node of depth d ends before the next conversation whose LCP is less than d: the
   nearest smaller value. Nodes of one conversation that end together are one node of the Cartesian tree (equal
   LCPs are merged, depths between a node's and its parent's are the missing ones): such a node is a segment (lo, hi].
   A stack of segments gives a block's nearest smaller values, and what a closed segment has gathered (smallest
   member, leaves, sums) goes to the one below it.
3. Across blocks. What a block can't tell is which nodes stand open when it begins. It takes its first conversation's
   nodes for open ones; the places where its LCPs fall below all before them (the block's minima, one for
   each such value) end those, and with each goes what the block adds to them until then. The nodes that are still open
   when the block ends follow. That is a row a block; in one pass over these rows, in order, the same stack finds
   the nearest smaller values across blocks. Such a row is no longer than two conversations.
4. Segments are expanded to a row for each depth. Hashes of members that end at a node are made where these stand; where
   they fill several blocks, their ids are hashed as a stream of a piece a block.

Rows without a conv_id are no conversation's and are ignored. Turns are ordered by turn, null first, ties by the hash of role
and text; rows that repeat stay turns of their own. Null role or text is empty. A conversation is a row with 24 bytes a
turn, as a document is one. An empty table has no node, not even a root. Other columns are ignored whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import common as C

#: Bytes of packed turns that a block holds.
BLOCK = 4 << 20
#: Conversations of one base; at most HEADS - 1 turns come from the base.
BASE, HEADS = 5, 9
NONE = hashlib.sha256(b"").hexdigest()
_FAR = (1 << 63) - 1


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, keys (16 bytes a turn), sizes (bytes of each turn's text): the base's first h turns, then its own after its first h."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary"))
    c = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(c.alias("c"), (c - c % BASE).alias("base"), F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), key.alias("key"), F.octet_length(text).alias("size")).alias("t"))
    own = turns.repartition("base").groupBy("base", "c").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.max(F.when(F.col("c") == F.col("base"), F.col("own"))).over(Window.partitionBy("base"))  # at most BASE rows, of one partition already
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("int")
    whole = F.concat(F.slice(F.coalesce(F.col("head"), F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    both = own.withColumn("head", head).select("c", whole.alias("turns"))
    return both.select("c", F.coalesce(F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), "")), F.lit(b"")).alias("keys"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


class Segment:
    """Nodes of the depths lo + 1 to hi, opened by one conversation at `start`, and what the deepest has gathered."""

    __slots__ = ("lo", "hi", "start", "sums", "name", "ends", "children", "least", "leaves", "saved")

    def __init__(self, lo: int, hi: int, start: int, sums: list[int], name: int, ends):
        self.lo, self.hi, self.start, self.sums, self.name, self.ends = lo, hi, start, sums, name, ends
        self.children, self.least, self.leaves, self.saved = 0, _FAR, 0, 0

    def add(self, children: int, least: int, leaves: int, saved: int) -> None:
        self.children += children
        self.least = min(self.least, least)
        self.leaves += leaves
        self.saved += saved


class Stack:
    """Open segments, each on the one that it hangs from. sums: bytes of a conversation's first turns, by their number from lo on."""

    def __init__(self):
        self.open: list[Segment] = []
        self.least: dict[int, int] = {}  # by name: smallest member of a segment's deepest node, once it is closed
        self.closed: list[tuple] = []
        self.names = 0

    def push(self, lo: int, hi: int, start: int, sums: list[int], ends, name: int | None = None) -> Segment:
        if self.open:
            self.open[-1].children += 1
        if name is None:
            name, self.names = self.names, self.names + 1
        self.open.append(Segment(lo, hi, start, sums, name, ends))
        return self.open[-1]

    def close(self, depth: int, at: int) -> None:
        """All nodes deeper than depth end before conversation `at`."""
        while self.open and self.open[-1].hi > depth:
            s = self.open[-1]
            if s.start < 0:  # opened before this block: its end is noted by whoever asked
                return
            lo, n = max(s.lo, depth), at - s.start
            leaves = s.leaves if s.children else 1
            base = s.sums[0]
            saved = s.saved + (n - 1) * (s.sums[s.hi - s.lo] - s.sums[lo - s.lo])
            self.least[s.name] = s.least
            if lo > s.lo:  # the upper nodes stay open, with this one below them
                rest = Segment(s.lo, lo, s.start, s.sums, self.names, None)
                self.names += 1
                rest.add(1, s.least, leaves, saved)
                self.open[-1] = rest
            else:
                self.open.pop()
                if self.open:
                    self.open[-1].add(0, s.least, leaves, saved)
            below = self.open[-1].name if self.open else None
            self.closed.append((s.least, lo, s.hi, below, n, s.children, leaves, s.saved, [x - base for x in s.sums[lo - s.lo : s.hi - s.lo + 1]], s.ends))


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_BLOCK = f"block int, below int, {_NODE}, piece binary, piece_of int, summary string"
_WHOLE = f"kind string, block int, below int, {_NODE}, ends_block int, ends_name int"


def expand(closed: list[tuple], parent) -> dict[str, np.ndarray | list]:
    """Closed segments as a row for each depth. parent: (its smallest member or None, what names it) of what a segment's name or None is."""
    n_depths = np.array([c[2] - c[1] for c in closed], np.int64)
    at = np.repeat(np.arange(len(closed)), n_depths)
    first, last = np.cumsum(n_depths) - n_depths, np.cumsum(n_depths) - 1
    col = lambda k: np.array([c[k] for c in closed], np.int64)[at]
    least, n, saved = col(0), col(4), col(7)
    depth = col(1) + 1 + np.arange(len(at)) - first[at]
    sums = [np.array(c[8], np.int64) for c in closed]
    under = np.concatenate([x[-1] - x[:-1] for x in sums]) if sums else np.zeros(0, np.int64)
    children = np.ones(len(at), np.int64)
    children[last] = [c[5] for c in closed]
    up, known = least.copy(), np.ones(len(at), bool)
    below = [parent(c[3]) for c in closed]
    up[first] = [x or 0 for x, _ in below]
    known[first] = [x is not None for x, _ in below]
    names = np.zeros(len(at), np.int64)
    names[first] = [0 if x is None else x for _, x in below]
    named = np.zeros(len(at), bool)
    named[first] = [x is not None for _, x in below]
    ends = np.full(len(at), None, object)
    ends[last] = [c[9] for c in closed]
    return {"conv_id": least, "depth": depth, "parent": up, "known": known, "name": names, "named": named, "n_convs": n, "n_children": children, "n_leaves": col(6), "saved_tokens": saved + (n - 1) * under, "ends": ends}


def _node_columns(x: dict, sha: list) -> dict[str, pa.Array]:
    out = {k: pa.array(x[k], pa.int64()) for k in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    out["parent_conv_id"] = pa.array(x["parent"], pa.int64(), mask=~x["known"])
    return out | {"ends_sha256": pa.array(sha, pa.string())}


def _table(columns: dict[str, pa.Array], schema: str, rows: int) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields], [n for n, _ in fields])


def block_of(k: int, conv: np.ndarray, keys: list[bytes], sizes: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """A block's closed nodes, pieces of ids of members that end at nodes open at its beginning or end, and its summary."""
    n = len(conv)
    length = np.array([len(x) // 16 for x in keys], np.int64)
    turns = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) if length.any() else np.zeros((0, 2), "<u8")
    begin = np.cumsum(length) - length
    both = np.minimum(length[1:], length[:-1])
    at = np.repeat(begin[1:], both) + np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    before = at - np.repeat(begin[1:] - begin[:-1], both)
    differ = np.r_[np.flatnonzero((turns[at] != turns[before]).any(axis=1)), len(at)]
    start = np.cumsum(both) - both
    lcp = np.r_[length[0], np.minimum(differ[np.searchsorted(differ, start)] - start, both)]
    again = lcp == length  # ends where the one before ends; the first row does so in its own nodes
    again[1:] &= length[1:] == length[:-1]
    run = np.diff(np.r_[np.flatnonzero(~again), n]) if (~again).any() else np.zeros(0, np.int64)
    run_at = dict(zip(np.flatnonzero(~again).tolist(), run.tolist(), strict=True))
    run_at[0] = int(np.flatnonzero(~again)[0]) if (~again).any() else n
    ids = lambda i: ",".join(map(str, conv[i : i + run_at[i]].tolist())).encode()

    stack, minima = Stack(), []  # minima: [value, place, children, least, leaves, saved]
    stack.open.append(Segment(-1, int(length[0]), -1, [], -1, None))
    base = stack.open[0]
    base.add(0, int(conv[0]), 0, 0)
    minima.append([base.hi, 0])
    c, v, m = conv.tolist(), lcp.tolist(), length.tolist()
    for i in range(1, n):
        stack.close(v[i], i)
        top = stack.open[-1]
        if top.hi > v[i]:  # only what was open before is left: a new minimum
            minima[-1] += [top.children, top.least, top.leaves, top.saved]
            minima.append([v[i], i])
            top = stack.open[0] = Segment(-1, v[i], -1, [], -1 - len(minima) + 1, None)
        if m[i] > v[i]:
            top = stack.push(v[i], m[i], i, np.cumsum([0, *sizes[i][v[i] :]] if v[i] >= 0 else [0, 0, *sizes[i]]).tolist(), i)
        top.least = min(top.least, c[i])
    last = stack.open[0]
    minima[-1] += [last.children, last.least, last.leaves, last.saved]
    still = {s.name for s in stack.open}
    # parents that are open: a segment by its name, a minimum by -1 - its number
    x = expand(stack.closed, lambda name: (None, name) if name in still or name < 0 else (stack.least[name], None))
    sha = [NONE if i is None else hashlib.sha256(ids(i)).hexdigest() for i in x["ends"]]
    rows = len(x["depth"])
    if rows:
        yield _table({"block": pa.array([k] * rows, pa.int32()), "below": pa.array(x["name"].astype(np.int32), pa.int32(), mask=~x["named"])} | _node_columns(x, sha), _BLOCK, rows)
    opened = stack.open[1:]
    pieces = [(-1, ids(0)), *((s.name, ids(s.ends)) for s in opened if s.ends is not None)]
    yield _table({"block": pa.array([k] * len(pieces), pa.int32()), "piece": pa.array([p for _, p in pieces], pa.binary()), "piece_of": pa.array([i for i, _ in pieces], pa.int32())}, _BLOCK, len(pieces))
    told = {"n": n, "first": keys[0].hex(), "last": keys[-1].hex(), "sizes": sizes[0], "minima": minima, "open": [(s.lo, s.hi, s.start, s.sums, s.name, s.ends is not None, s.children, s.least, s.leaves, s.saved) for s in opened]}
    yield _table({"block": pa.array([k], pa.int32()), "summary": pa.array([json.dumps(told)], pa.string())}, _BLOCK, 1)


def _shared(a: str, b: str) -> int:
    """Turns that two conversations' hexadecimal keys share."""
    lo, hi = 0, min(len(a), len(b)) // 32
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: 32 * mid] == b[: 32 * mid] else (lo, mid - 1)
    return lo


def whole_of(summaries: Iterator[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """The stack over blocks: nodes that were open where a block begins or ends, and who stands behind the names that blocks gave."""
    stack, last, start, given, sent = Stack(), None, 0, [], 0  # given: (block, what it names, name here)

    def out(final: bool) -> Iterator[pa.RecordBatch]:
        """Closed nodes whose parents are closed too, and names that are."""
        nonlocal given
        ready = [c for c in stack.closed if c[3] is None or c[3] in stack.least]
        stack.closed = [c for c in stack.closed if not (c[3] is None or c[3] in stack.least)]
        if ready:
            x = expand(ready, lambda name: (None, None) if name is None else (stack.least[name], None))
            rows = len(x["depth"])
            where = [e if e is not None else (None, None) for e in x["ends"]]
            cols = {"kind": pa.array(["node"] * rows), "ends_block": pa.array([a for a, _ in where], pa.int32()), "ends_name": pa.array([b for _, b in where], pa.int32())}
            yield _table(cols | _node_columns(x, [NONE if e is None else None for e in x["ends"]]), _WHOLE, rows)
        known = [g for g in given if g[2] in stack.least]
        given = [g for g in given if g[2] not in stack.least]
        if known:
            yield _table({"kind": pa.array(["name"] * len(known)), "block": pa.array([g[0] for g in known], pa.int32()), "below": pa.array([g[1] for g in known], pa.int32()), "conv_id": pa.array([stack.least[g[2]] for g in known], pa.int64())}, _WHOLE, len(known))
        if not final:  # what is still referred to
            used = {c[3] for c in stack.closed} | {g[2] for g in given}
            stack.least = {k: v for k, v in stack.least.items() if k in used}

    for k, text in summaries:
        x = json.loads(text)
        shared = -1 if last is None else _shared(last, x["first"])
        stack.close(shared, start)
        hi = len(x["sizes"])
        if hi > shared:
            stack.push(shared, hi, start, np.cumsum([0, *x["sizes"][shared:]] if shared >= 0 else [0, 0, *x["sizes"]]).tolist(), (k, -1))
        owner = stack.open[-1].ends  # of the members that end where the first conversation does
        yield _table({"kind": pa.array(["piece"]), "block": pa.array([k], pa.int32()), "ends_block": pa.array([owner[0]], pa.int32()), "ends_name": pa.array([owner[1]], pa.int32())}, _WHOLE, 1)
        for j, (value, at, children, least, leaves, saved) in enumerate(x["minima"]):
            stack.close(value, start + at)
            stack.open[-1].add(children, least, leaves, saved)
            if children:
                given.append((k, -1 - j, stack.open[-1].name))
        for lo, hi, at, sums, name, ends, children, least, leaves, saved in x["open"]:
            s = stack.push(lo, hi, start + at, sums, (k, name) if ends else None)
            stack.open[-2].children -= 1  # counted by the block
            s.add(children, least, leaves, saved)
            given.append((k, name, s.name))
        last, start = x["last"], start + x["n"]
        sent += 1
        if sent % 256 == 0:
            yield from out(False)
    stack.close(-2, start)
    yield from out(True)


def trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    made = C.materialize(rebuilt(conversations), "trie-turns")
    nbytes = made.agg(F.sum(F.octet_length("keys").cast("long") + 4 * F.size("sizes") + 16)).first()[0] or 0
    order = ("keys", "c")
    dealt = made.repartitionByRange(C.parts_for(nbytes, BLOCK, least=8), *order).sortWithinPartitions(*order).select("c", "keys", "sizes")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is not None and t.num_rows:
            yield from block_of(TaskContext.get().partitionId(), t.column(0).to_numpy(), t.column(1).to_pylist(), t.column(2).to_pylist())

    told = C.materialize(dealt.mapInArrow(blocks, _BLOCK), "trie-blocks")
    C.drop(made)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole_of((k, s) for b in batches for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    across = C.materialize(told.where("summary is not null").select("block", "summary").repartition(1).sortWithinPartitions("block").mapInArrow(whole, _WHOLE), "trie-whole")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order, those of a node one after another."""
        out, key, h = [], None, None
        for b in batches:
            for block, name, piece in zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (block, name) != key:
                    out += [] if key is None else [(*key, h.hexdigest())]
                    key, h = (block, name), hashlib.sha256(piece)
                else:
                    h.update(b"," + piece)
        out += [] if key is None else [(*key, h.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.string()))], ["ends_block", "ends_name", "sha"])

    pieces = told.where("piece is not null").select("block", "piece_of", "piece")
    first = pieces.where("piece_of < 0").join(across.where("kind = 'piece'").select("block", "ends_block", "ends_name"), "block")
    mine = pieces.where("piece_of >= 0").select(F.col("block").alias("ends_block"), F.col("piece_of").alias("ends_name"), "block", "piece")
    streams = first.select("ends_block", "ends_name", "block", "piece").union(mine).repartition("ends_block", "ends_name").sortWithinPartitions("ends_block", "ends_name", "block")
    sha = streams.mapInArrow(hashed, "ends_block int, ends_name int, sha string")

    columns = [f.split()[0] for f in _NODE.split(", ")]
    inside = told.where("depth is not null")
    known = inside.where("below is null").select(*columns)
    names = across.where("kind = 'name'").select("block", "below", F.col("conv_id").alias("up"))
    named = inside.where("below is not null").join(names, ["block", "below"]).withColumn("parent_conv_id", F.col("up")).select(*columns)
    outer = across.where("kind = 'node'").join(sha, ["ends_block", "ends_name"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "sha")).select(*columns)
    return known.union(named).union(outer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 of a decimal number's digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS k, octet_length(encode(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM t),
h AS (SELECT c, c - c % {BASE} AS b, crc % {HEADS} AS h FROM (SELECT c, {_CRC} AS crc FROM (SELECT DISTINCT c FROM t))),
r AS (SELECT h.c, 0 AS own, o.p, o.k, o.n FROM h JOIN o ON o.c = h.b AND o.p <= h.h UNION ALL SELECT h.c, 1, o.p, o.k, o.n FROM h JOIN o ON o.c = h.c AND o.p > h.h),
s AS (SELECT c, n, k, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM r),
f AS (SELECT c, d, n, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS f FROM s UNION ALL SELECT c, 0, 0, '' FROM h),
l AS (SELECT c, max(d) AS len FROM f GROUP BY c),
g AS MATERIALIZED (SELECT f.d, f.f, min(f.c) AS c, count(*) AS m, any_value(f.n) AS n,
  sha256(coalesce(string_agg(CAST(f.c AS VARCHAR), ',' ORDER BY f.c) FILTER (l.len = f.d), '')) AS e, max(l.len) > f.d AS inner_ FROM f JOIN l USING (c) GROUP BY f.d, f.f),
u AS (SELECT g.d, g.f, a.d AS ad, a.f AS af, (g.m - 1) * g.n AS own, NOT g.inner_ AS leaf FROM g JOIN f a ON a.c = g.c AND a.d <= g.d),
w AS (SELECT ad AS d, af AS f, sum(own) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (d = ad + 1) AS children FROM u GROUP BY ad, af)
SELECT g.c AS conv_id, CAST(g.d AS BIGINT) AS depth, q.c AS parent_conv_id, g.m AS n_convs, w.children AS n_children, w.leaves AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, g.e AS ends_sha256
FROM g JOIN w ON w.d = g.d AND w.f = g.f LEFT JOIN f x ON x.c = g.c AND x.d = g.d - 1 LEFT JOIN g q ON q.d = x.d AND q.f = x.f
"""
