"""MinHash near-duplicate detection by odd sketches.

Sets: a document's distinct k-word shingles, as in jaccard.py. Two documents link when den * intersection >= num * union.

1. For each distinct set: `samples` MinHashes (the least of its shingles' hashes under that many functions), of which bands of
   `rows` make keys, and its odd sketch: each sample, with its number, toggles one of BITS bits. Two sets that differ in m
   samples have sketches that differ in 2m bits at most, fewer only where toggles meet.
   `plan` takes as many bands that a linked pair shares none of them with probability LOST at most, and as `most` twice the number of samples
   in which it differs with probability 1 - LOST at least. So the exclusive or of two sketches and its population count settle
   at once whether a pair is similar enough to be looked at.
2. Buckets. Sets with a key in common are a bucket. Within one, sets whose sketches differ in `most` bits or fewer are joined to trees, so that a
   bucket gives fewer edges than it has sets: all against the least one, then the rest breadth-first, each against those that aren't in a tree yet.
   A bucket of more than TILE sets is dealt to parts.
3. The edges are confirmed on full sets, which only sets with an edge or in such a bucket send. Components of confirmed edges are classes. In buckets that were dealt to
   parts, sets of different classes are then tested across parts in pairs of tiles (`tiled`), again for trees. Edges that failed and those across parts
   join classes to groups; in a group, sets of different classes are tested pair by pair, in tiles too: by sketch, then on full sets unless
   they have become one class meanwhile. So every pair that shares a band and passes by its sketch is either
   confirmed, refused, or in one class, and no group's pairs become rows.

What is lost is a linked pair that shares no band or differs in too many samples: LOST for each, 10^-9, whatever the tables.
Nulls and edges: as in jaccard.py: a null text is empty, empty ones link with nothing; a null doc_id takes part but is never a
component's id unless all are null, and is kept only then; rows that repeat link like any copies; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chunks, graph, jaccard
from lexmill.llm import common as C

BITS, TILE, LOST, SAMPLES = 1024, 1024, 1e-9, 320
U = np.uint64
#: Sets whose samples are made together.
TOGETHER = 1024


def plan(num: int, den: int, lost: float = LOST) -> tuple[int, int, int]:
    """(bands, rows of a band, most bits by which sketches of linked sets differ) for a similarity of num/den."""
    s = num / den
    bands_of = lambda r: max(1, math.ceil(math.log(lost) / math.log1p(-(s**r)))) if s < 1 else 1
    rows = max(r for r in range(1, 33) if r == 1 or r * bands_of(r) <= SAMPLES)
    bands = bands_of(rows)
    n, m, tail = bands * rows, bands * rows, 0.0
    while m > 0:  # the probability of m or more differing samples
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) + m * math.log(1 - s) + (n - m) * math.log(s)) if s < 1 else 0.0
        if tail > lost:
            break
        m -= 1
    return bands, rows, 2 * m


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of a factor (odd) and an addend."""
    k = np.arange(1, n + 1, dtype=U)
    with np.errstate(over="ignore"):
        return C.mix(k * U(0x9E3779B97F4A7C15)) | U(1), C.mix(k * U(0xC2B2AE3D27D4EB4F) + U(7))


def samples(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHashes: a row a set, none of which is empty."""
    items = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    out = np.empty((n, len(sets)), U)
    with np.errstate(over="ignore"):
        for j, (a, b) in enumerate(zip(*functions(n), strict=True)):
            out[j] = np.minimum.reduceat(items * a + b, begin)
    return out.T


def keys_of(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key a band: its samples and its number, hashed."""
    out = np.zeros((len(mins), bands), U)
    with np.errstate(over="ignore"):
        out += np.arange(bands, dtype=U)
        for j in range(rows):
            out = C.mix(out * U(0x9E3779B97F4A7C15) + mins[:, j::rows])
    return out


def sketch_of(mins: np.ndarray) -> np.ndarray:
    """Odd sketches: a row of BITS / 64 numbers a set."""
    n = len(mins)
    with np.errstate(over="ignore"):
        bit = (C.mix(mins + C.mix(np.arange(1, mins.shape[1] + 1, dtype=U))) % U(BITS)).astype(np.int64)
    odd = np.bincount((np.arange(n)[:, None] * BITS + bit).ravel(), minlength=n * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1).view(U)


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits by which sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def estimate(bits: np.ndarray, n: int) -> np.ndarray:
    """Similarity estimated from the number of differing bits of n samples' sketches."""
    toggles = np.log1p(-2 * np.minimum(bits, BITS / 2 - 1) / BITS) / np.log1p(-2 / BITS)
    return 1 - toggles / (2 * n)


def trees(sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of sets whose sketches differ in `most` bits or fewer."""
    out, rest, queue = [], np.arange(1, len(sketches)), [0]
    while len(rest):
        x = queue.pop() if queue else int(rest[0])
        if len(rest) and rest[0] == x:
            rest = rest[1:]
        near = differ(sketches[rest], sketches[x]) <= most
        found = rest[near].tolist()
        out += [(x, y) for y in found]
        queue += found
        rest = rest[~near]
    return out


_NODES = "chunk int, doc_id long, text_md5 binary, n_shingles long, node binary, bands array<long>, sketch binary"


def nodes(dealt: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """chunks.deal()'s table -> a row a document: its set's size and node; for one document of each node and chunk also band keys and sketch."""

    def make(key, t):
        C.begin("odd")
        ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        md5 = [hashlib.md5((x or "").encode("utf-8", "surrogatepass")).digest() for x in texts]
        seen, size, node, first = {}, [], [], {}
        sets, cols = [], ([None] * len(ids), [None] * len(ids))

        def flush() -> None:
            if sets:
                m = samples([s for _, s in sets], bands * rows)
                for (i, _), b, x in zip(sets, keys_of(m, bands, rows).view(np.int64), sketch_of(m), strict=True):
                    cols[0][i], cols[1][i] = b, x.tobytes()
                sets.clear()

        for i, (text, m) in enumerate(zip(texts, md5, strict=True)):
            if m not in seen:
                s = jaccard.shingle_set(text, k)
                seen[m] = len(s), jaccard.node_of(s)
                if len(s) and seen[m][1] not in first:
                    first[seen[m][1]] = i
                    sets.append((i, s))
                    if len(sets) == TOGETHER:
                        flush()
            size.append(seen[m][0])
            node.append(seen[m][1])
        flush()
        C.give_back()
        return pa.table({"chunk": t.column("chunk").cast(pa.int32()), "doc_id": pa.array(ids, pa.int64()), "text_md5": C.binary_array(md5), "n_shingles": pa.array(size, pa.int64()), "node": pa.array(node, pa.binary()), "bands": pa.array(cols[0], pa.list_(pa.int64())), "sketch": pa.array(cols[1], pa.binary())})

    return C.materialize(dealt.groupBy("chunk").applyInArrow(make, _NODES), "odd-nodes")


_EDGES = "a binary, b binary"


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([min(p) for p in pairs], pa.binary()), "b": pa.array([max(p) for p in pairs], pa.binary())})


def bucket_trees(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows band, part, node, sketch, those of a part of a bucket one after another -> edges a, b."""
    C.begin("odd")
    rest = None

    def run(t: pa.Table) -> pa.RecordBatch:
        band, part = t.column("band").to_numpy(), t.column("part").to_numpy()
        name = t.column("node").to_pylist()
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), U).reshape(len(name), -1)
        new = np.r_[True, (band[1:] != band[:-1]) | (part[1:] != part[:-1])]
        start = np.flatnonzero(new)
        first = start[np.cumsum(new) - 1]
        near = differ(sk, sk[first]) <= most
        pairs = [(name[f], name[i]) for i, f in zip(np.flatnonzero(near & ~new).tolist(), first[near & ~new].tolist(), strict=True)]
        size = np.diff(np.r_[start, len(name)])
        for f in np.unique(first[~near]).tolist():
            n = int(size[np.searchsorted(start, f)])
            if n > 2:
                mine = f + np.r_[np.flatnonzero(near[f : f + n]), np.flatnonzero(~near[f : f + n])]
                # the first one's tree is known; the others are tested against it and each other
                x = sk[mine]
                queue, left = list(range(1, int(near[f : f + n].sum()))), np.arange(int(near[f : f + n].sum()), n)
                while len(left):
                    p = queue.pop() if queue else int(left[0])
                    left = left[1:] if left[0] == p else left
                    ok = differ(x[left], x[p]) <= most
                    found = left[ok].tolist()
                    pairs += [(name[mine[p]], name[mine[q]]) for q in found]
                    queue += found
                    left = left[~ok]
        return _edges(pairs).combine_chunks()

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from run(t).to_batches()

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        band, part = t.column("band").to_numpy(), t.column("part").to_numpy()
        end = np.flatnonzero((band != band[-1]) | (part != part[-1]))
        cut = int(end[-1]) + 1 if len(end) else 0
        if cut:
            yield from emit(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield from emit(rest)


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """members(grp, comp, node) -> grp, i, j, tile, comp, node: for pairs of tiles (i <= j) of a group whose sets may be of different components.

    A component of more than `tile` sets has tiles of its own, which aren't paired with each other; the others share tiles.
    Groups of one component are left out. Counts are made before the shuffle; rows find them by C.spread_lookup().
    """
    sizes = C.materialize(members.groupBy("grp", "comp").agg(F.count("*").alias("n")), "odd-sizes")
    large = F.col("n") > tile
    groups = sizes.groupBy("grp").agg(F.count("*").alias("comps"), F.sum(F.when(large, F.lit(0)).otherwise(F.col("n"))).alias("pooled"), F.sum("n").alias("rows_of_key"), F.sort_array(F.collect_list(F.when(large, F.struct("comp", F.ceil(F.col("n") / tile).cast("int").alias("k"))))).alias("own"))
    # a group's large components are fewer than its rows by the size of a tile
    groups = C.materialize(groups.where("comps > 1").withColumn("shared", F.ceil(F.col("pooled") / tile).cast("int")), "odd-groups")
    rows = groups.agg(F.sum("rows_of_key")).first()[0] or 0
    at = C.spread_lookup(members, "grp", groups, rows).where("comps is not null")
    place = F.expr("array_position(transform(own, x -> x.comp), comp)").cast("int")
    before = F.expr("shared + aggregate(slice(own, 1, greatest(0, p - 1)), 0, (s, x) -> s + x.k)")
    at = at.withColumn("p", place).withColumn("k", F.expr("if(p > 0, own[p - 1].k, shared)")).withColumn("from", F.when(F.col("p") > 0, before).otherwise(0))
    at = at.withColumn("all", F.expr("shared + aggregate(own, 0, (s, x) -> s + x.k)")).withColumn("tile", F.col("from") + F.pmod(F.when(F.col("p") > 0, F.xxhash64("node")).otherwise(F.xxhash64("comp", "node")), F.col("k")).cast("int"))
    other = F.expr("filter(sequence(0, all - 1), t -> p = 0 or t < from or t >= from + k)")
    at = at.withColumn("other", F.explode(other))
    return at.select("grp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "comp", "node")


def _sides(t: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    tile = t.column("tile").to_numpy()
    return np.flatnonzero(tile == i), np.flatnonzero(tile == j)


#: Edges up to which one task finds components; more go by rounds over tables.
FEW = 20_000


def components(edges: DataFrame) -> DataFrame:
    """graph.components(), in one task if there are FEW edges or less."""
    edges = C.materialize(edges.where("a <> b"), "odd-graph")
    if edges.count() > FEW:
        return graph.components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = sorted((root(x), root(y)))
                up[y] = x
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([root(x) for x in up], pa.binary())], ["node", "root"])

    return C.materialize(edges.select("a", "b").repartition(1).mapInArrow(run, "node binary, root binary"), "odd-roots")


def candidate_edges(one: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """one(node, bands, sketch) -> (edges that join all sets of a part of a bucket whose sketches differ in `most` bits or fewer; members (grp, node) of the buckets of several parts, if any)."""
    posts = one.select("node", F.explode("bands").alias("band"))
    sizes = C.materialize(posts.groupBy("band").count().where("count > 1"), "odd-buckets")
    told = sizes.select("band", F.col("count").alias("rows_of_key"), "count")
    n = sizes.agg(F.sum("count"), F.max("count")).first()
    # parts by powers of two, so that a set's part is the same in most of its buckets
    parts = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("count") / TILE)))).cast("int")
    member = C.spread_lookup(posts, "band", told, n[0] or 0).where("count is not null").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).select("band", "part", "node", "count")
    hot = (n[1] or 0) > TILE
    if hot:
        member = C.materialize(member, "odd-members")
    seen = member.join(one.select("node", "sketch"), "node").select("band", "part", "node", "sketch")
    edges = seen.repartition("band", "part").sortWithinPartitions("band", "part", "node").mapInArrow(lambda it: bucket_trees(it, most), _EDGES)
    edges = C.materialize(edges.distinct(), "odd-edges")
    C.drop(sizes)
    return edges, member.where(F.col("count") > TILE).select(F.col("band").alias("grp"), "node") if hot else None


def across_parts(large: DataFrame, one: DataFrame, klass: DataFrame, most: int) -> DataFrame:
    """Edges between sets of different classes of one bucket of several parts."""
    large = large.join(klass.select("node", F.col("root").alias("comp")), "node", "left").select("grp", F.coalesce("comp", "node").alias("comp"), "node")
    pairs = tiled(large, TILE).join(one.select("node", "sketch"), "node")

    def across(key, t):
        C.begin("odd")
        name = t.column("node").to_pylist()
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), U).reshape(len(name), -1)
        return _edges([(name[x], name[y]) for x, y in trees(sk, most)])

    return C.materialize(pairs.groupBy("grp", "i", "j").applyInArrow(across, _EDGES).distinct(), "odd-across")


def _confirmed(s: np.ndarray, r: np.ndarray, num: int, den: int) -> bool:
    common = int((s[np.minimum(np.searchsorted(s, r), len(s) - 1)] == r).sum())
    return den * common >= num * (len(s) + len(r) - common)


def links(dealt: DataFrame, known: DataFrame, k: int, num: int, den: int, most: int) -> DataFrame:
    """nodes()'s rows -> node, root: one root for all that links join; sets that link with none are absent. Links are confirmed on full sets."""
    one = known.where("bands is not null").groupBy("node").agg(F.min(F.struct("chunk", "text_md5")).alias("at"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    one = C.materialize(one.select("node", "at.chunk", "at.text_md5", "bands", "sketch"), "odd-sets")
    edges, large = candidate_edges(one, most)
    some = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    wanted = (some if large is None else some.union(large.select("node"))).distinct().join(one.select("node", "chunk", "text_md5"), "node")

    def full(key, t, w):
        C.begin("odd")
        node, md5 = w.column("node").to_pylist(), w.column("text_md5").to_pylist()
        want, out = dict(zip(md5, node, strict=True)), {}
        if want:
            for text in t.column("text").to_pylist():
                m = hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()
                if m in want and want[m] not in out:
                    out[want[m]] = jaccard.shingle_set(text, k).tobytes()
        C.give_back()
        return pa.table({"node": pa.array(list(out), pa.binary()), "items": pa.array(list(out.values()), pa.binary())})

    sets = C.materialize(dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(full, "node binary, items binary"), "odd-items")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, 8 << 20):
            ok = [_confirmed(np.frombuffer(s, U), np.frombuffer(r, U), num, den) for s, r in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), sets.select(F.col("node").alias("b"), F.col("items").alias("sb"))
    tested = C.materialize(edges.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(confirm, "a binary, b binary, ok boolean"), "odd-tested")
    klass = components(tested.where("ok").select("a", "b"))
    left = tested.where("not ok").select("a", "b")
    if large is not None:
        left = left.union(across_parts(large, one, klass, most))
    of = lambda c: klass.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    by_class = left.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct()
    by_class = C.materialize(by_class, "odd-left")
    if not by_class.isEmpty():
        group = components(by_class).select(F.col("root").alias("grp"), F.col("node").alias("comp"))
        every = klass.select("node", F.col("root").alias("comp"))
        single = group.select(F.col("comp").alias("node"), "comp").join(klass.select("node"), "node", "left_anti")
        member = every.unionByName(single).join(group, "comp").select("grp", "comp", "node")
        pairs = tiled(C.materialize(member, "odd-classes"), TILE // 4).join(one.select("node", "sketch"), "node").join(sets, "node")

        def settle(key, t):
            """Confirms pairs of different classes, the most similar by their sketches first, unless they have become one."""
            C.begin("odd")
            x, y = _sides(t, key[1].as_py(), key[2].as_py())
            name, comp = t.column("node").to_pylist(), t.column("comp").to_pylist()
            items = [np.frombuffer(s, U) for s in t.column("items").to_pylist()]
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), U).reshape(len(name), -1)
            number: dict[bytes, int] = {}
            up = [number.setdefault(c, len(number)) for c in comp]
            of = np.array(up)
            size = np.array([len(s) for s in items], np.int64)
            root, out = list(range(len(number))), []

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            some = []
            for p in x.tolist():
                q = y[of[y] != of[p]]
                if key[1].as_py() == key[2].as_py():
                    q = q[q > p]
                q = q[den * np.minimum(size[q], size[p]) >= num * np.maximum(size[q], size[p])]
                d = differ(sk[q], sk[p])
                some += [(int(n), p, z) for n, z in zip(d[d <= most].tolist(), q[d <= most].tolist(), strict=True)]
            for _, p, q in sorted(some):
                c, e = find(up[p]), find(up[q])
                if c != e and _confirmed(items[p], items[q], num, den):
                    root[c] = e
                    out.append((name[p], name[q]))
            C.give_back()
            return _edges(out)

        new = C.materialize(pairs.groupBy("grp", "i", "j").applyInArrow(settle, _EDGES), "odd-links")
        # classes that have become one
        more = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        one_of = components(more.where("a <> b").distinct()).select(F.col("node").alias("_class"), F.col("root").alias("_root"))
        joined = every.unionByName(single).join(one_of, F.col("comp") == F.col("_class"), "left")
        klass = C.materialize(joined.select("node", F.coalesce("_root", "comp").alias("root")), "odd-roots")
    C.drop(one, edges, sets, tested)
    return klass


def classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs(doc_id, text) -> a row a row: doc_id, n_shingles, component_id, kept (whether it is the one of its component that stays)."""
    bands, rows, most = plan(num, den)
    dealt, _ = chunks.deal(docs.select("doc_id", "text"))
    known = nodes(dealt, k, bands, rows)
    tied = links(dealt, known, k, num, den, most)
    mine = C.materialize(known.select("doc_id", "n_shingles", "node").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "odd-rows")
    C.drop(dealt, known)
    kept: Column = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    least = mine.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows_of_key"))
    alone = mine.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    spread = C.spread_lookup(mine.where("root is not null"), "root", least, mine.count())
    return spread.select("doc_id", "n_shingles", "component_id").union(alone).select("doc_id", "n_shingles", "component_id", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: two-word shingles, similarity 0.8."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, num=80, den=100)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM s),
t AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS x FROM n),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.d)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = n.doc_id
"""
