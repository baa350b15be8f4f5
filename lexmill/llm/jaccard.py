"""N-gram Jaccard join with adaptive multi-match prefixes.

Sets: a document's distinct k-word shingles (words: lower-case A-Z, parted by ASCII white space; fewer than k
words: the whole sequence; none: empty and linked with nothing), as 64-bit hashes. Two documents link when
den * intersection >= num * union.

1. Every shingle's document frequency over the whole corpus (chunks.py). Only documents that share at least
   num/den of their set can link; only these go on, one for each distinct set (equal sets link by equality).
2. Shingles in ascending order of frequency, ties by hash, one order for all. With t = ceil(num/den |x|),
   a document's l-prefix is its first |x| - t + l shingles; documents that link share at least l of both
   l-prefixes. Each document chooses its own l in 1..LONGEST by estimated cost: a longer prefix adds postings
   to scan, and asking for l matches leaves at most sum(frequency - 1) / l candidates to verify. A pair is
   verified when it shares at least the smaller l of the two in its prefixes.
3. Prefix shingles of more than HEAVY sets stand for groups of many similar copies. The groups that such
   shingles tie together are cut into tiles of TILE sets; each pair of tiles is one task that counts all
   intersections by a product of incidence matrices and emits at most a spanning forest, so no pair of
   copies becomes a row. All other prefix shingles have at most HEAVY postings, whose pairs are counted.
4. Links are verified on the full sets; components by alternating stars.

Nulls and edges: a null text is empty. A null doc_id takes part but is never a component's id unless all are
null. Rows that repeat link like any copies. Columns other than doc_id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chunks, graph
from lexmill.llm import common as C

LONGEST, HEAVY, TILE = 12, 192, 512
#: What verifying a candidate costs against scanning a posting, for each shingle of the set.
VERIFY = 0.3

_NODES = "doc_id long, text_md5 string, n_shingles long, node binary, least int, prefix array<long>, items binary"


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(C.shingle_hashes(C.hash_words(C.words_of(text)), k))


def node_of(items: np.ndarray) -> bytes | None:
    """Equal sets, equal nodes."""
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def prefix_of(items: np.ndarray, df: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """(l, prefix shingles that another document has) by estimated cost."""
    n = len(items)
    order = np.lexsort((items, df))
    f = df[order].astype(float)
    base = n + (-num * n // den)
    longest = min(LONGEST, n - base)
    scan = np.cumsum(f)
    extra = np.cumsum(f - 1)
    ls = np.arange(1, longest + 1)
    at = base + ls - 1
    cost = scan[at] + VERIFY * n * extra[at] / ls
    l = int(ls[int(np.argmin(cost))])
    chosen = order[: base + l]
    return l, items[chosen[df[chosen] > 1]]


def nodes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row a document: its set's size and node; for one document of each node and chunk that may link, also prefix and set."""
    dealt, n = chunks.deal(docs)

    def pack(key, t):
        C.begin("jaccard")
        sets = {}
        for text in t.column("text").to_pylist():
            s = shingle_set(text, k)
            if len(s):
                sets[node_of(s)] = s
        all_ = np.concatenate(list(sets.values())) if sets else np.zeros(0, np.uint64)
        u, c = np.unique(all_, return_counts=True)
        del sets, all_
        C.give_back()
        return chunks.packets(t.column("chunk")[0].as_py(), n, u, c.astype(np.uint64))

    replies = C.materialize(chunks.totals(dealt.groupBy("chunk").applyInArrow(pack, chunks.PACKETS + ", c0 binary")), "jaccard-df")

    def look(key, t, r):
        C.begin("jaccard")
        rows, sets = [], {}
        for i, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
            s = shingle_set(text, k)
            node = node_of(s)
            rows.append([i, hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest(), len(s), node, None, None, None])
            if node is not None and node not in sets:
                sets[node] = (s, rows[-1])
        if sets:
            _, at = np.unique(np.concatenate([s for s, _ in sets.values()]), return_inverse=True)
            df = chunks.reply(r, "r0", np.uint64)[at]
            del at, r
            for s, row in sets.values():
                d, df = df[: len(s)], df[len(s) :]
                if den * int((d > 1).sum()) >= num * len(s):
                    l, p = prefix_of(s, d, num, den)
                    row[4:] = l, p.view(np.int64).tolist(), s.tobytes()
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("doc_id", "text_md5", "n_shingles", "node", "least", "prefix", "items"), cols, kinds, strict=True)})

    out = C.materialize(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(look, _NODES), "jaccard-nodes")
    C.drop(replies, dealt)
    return out


def _intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections by products of incidence matrices, some columns at a time."""
    everything = np.concatenate([*a, *b])
    u = np.unique(everything)
    out = np.zeros((len(a), len(b)), np.float32)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    cols = [np.searchsorted(u, np.concatenate(x)) for x in (a, b)]
    order = [np.argsort(c, kind="stable") for c in cols]
    rows, cols = [r[o] for r, o in zip(rows, order, strict=True)], [c[o] for c, o in zip(cols, order, strict=True)]
    for at in range(0, len(u), columns):
        m = []
        for x, r, c in zip((a, b), rows, cols, strict=True):
            lo, hi = np.searchsorted(c, [at, at + columns])
            z = np.zeros((len(x), min(columns, len(u) - at)), np.float32)
            z[r[lo:hi], c[lo:hi] - at] = 1
            m.append(z)
        out += m[0] @ m[1].T
    return out


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    up, out = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def links(known: DataFrame, num: int, den: int) -> DataFrame:
    """nodes()'s rows -> links a, b between nodes of different sets that join all that link."""
    one = known.where("items is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("least").alias("least"), F.first("prefix").alias("prefix"), F.first("items").alias("items"))
    one = C.materialize(one, "jaccard-sets")
    posts = one.select("node", "n", "least", F.explode("prefix").alias("token"))
    sizes = C.materialize(posts.groupBy("token").count().where("count > 1"), "jaccard-postings")
    # a token of very many sets meets its count without gathering them
    counted = C.spread_lookup(posts, "token", sizes.select("token", F.col("count").alias("rows_of_key"), "count"), sizes.agg(F.sum("count")).first()[0] or 0)
    light = counted.where(F.col("count") <= HEAVY).select("token", "node", "n", "least")
    x, y = light, light.select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "least")))
    near = (F.col("node") < F.col("node_b")) & (F.least("n", "n_b") * den >= F.greatest("n", "n_b") * num)
    pairs = x.join(y, "token").where(near).groupBy(F.col("node").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("c"), F.first(F.least("least", "least_b")).alias("l")).where("c >= l").select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for s, r in zip(t.column("sa").to_pylist(), t.column("sb").to_pylist(), strict=True):
                s, r = np.frombuffer(s, np.uint64), np.frombuffer(r, np.uint64)
                common = int((s[np.minimum(np.searchsorted(s, r), len(s) - 1)] == r).sum())
                ok.append(den * common >= num * (len(s) + len(r) - common))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = one.select(F.col("node").alias("a"), F.col("items").alias("sa")), one.select(F.col("node").alias("b"), F.col("items").alias("sb"))
    found = C.materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a binary, b binary"), "jaccard-links")

    heavy = sizes.where(F.col("count") > HEAVY)
    if not heavy.isEmpty():
        of = C.materialize(counted.where(F.col("count") > HEAVY).select("node", "token"), "jaccard-heavy")
        first = C.materialize(of.groupBy("node").agg(F.min("token").alias("first")), "jaccard-first")
        n = first.count()
        token_of = C.spread_lookup(of, "node", first.select("node", F.lit(1).alias("rows_of_key"), "first"), n)
        tied = graph.components(token_of.select(F.col("first").alias("a"), F.col("token").alias("b")).distinct())
        uses = first.groupBy("first").agg(F.count("*").alias("rows_of_key"))
        roots = uses.join(tied.withColumnRenamed("node", "first"), "first", "left")
        block = C.materialize(C.spread_lookup(first, "first", roots, n).select("node", F.coalesce("root", "first").alias("block")), "jaccard-blocks")
        tiles = block.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("rows_of_key"))
        member = C.spread_lookup(block, "block", tiles, n).join(one.select("node", "n", "items"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("block", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "items")

        def tile(key, t):
            C.begin("jaccard")
            i, j = key[1].as_py(), key[2].as_py()
            rows = sorted(zip(t.column("tile").to_pylist(), t.column("node").to_pylist(), t.column("items").to_pylist(), strict=True))
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            a = [k for k, r in enumerate(rows) if r[0] == i]
            b = a if i == j else [k for k, r in enumerate(rows) if r[0] == j]
            out = []
            if a and b:
                m = _intersections([sets[k] for k in a], [sets[k] for k in b])
                n = np.array([len(s) for s in sets], np.float64)
                union = n[a][:, None] + n[b][None, :] - m
                p, q = np.nonzero(den * m.astype(np.float64) >= num * union)
                out = _forest(((a[x], b[y]) for x, y in zip(p.tolist(), q.tolist(), strict=True) if a[x] != b[y]), len(rows))
            return pa.table({"a": pa.array([rows[x][1] for x, _ in out], pa.binary()), "b": pa.array([rows[y][1] for _, y in out], pa.binary())})

        found = found.union(C.materialize(member.groupBy("block", "i", "j").applyInArrow(tile, "a binary, b binary"), "jaccard-tiles"))
    return found


def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    known = nodes(docs.select("doc_id", "text"), k, num, den)
    tied = graph.components(links(known, num, den))
    return C.materialize(known.select("doc_id", "text_md5", "n_shingles", "node").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "jaccard-classes")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs(doc_id, text) -> a row a row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    mine = _classes(docs, k, num, den).drop("text_md5")
    least = mine.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows_of_key"))
    alone = mine.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    tied = C.spread_lookup(mine.where("root is not null"), "root", least, mine.count())
    return tied.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).union(alone)


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs' rows and columns without near copies: of each component the row of the smallest doc_id (null last, ties by text) stays, once; rows without words stay, once for each doc_id. Of equal doc_id and text any row's other columns stay. Names added on the way are ones that docs doesn't have."""
    mine = _classes(docs, k, num, den)
    name = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_md5").alias("t"))
    first = mine.where("root is not null").groupBy("root").agg(F.min(name).alias("k"))
    md5, i, t = C.free_names(docs, "text_md5", "kept_id", "kept_md5")
    stay = first.select(F.col("k.i").alias(i), F.col("k.t").alias(t)).union(mine.where("root is null").select("doc_id", "text_md5").distinct())
    rows = docs.withColumn(md5, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(md5) == F.col(t)), "left_semi")
    return kept.dropDuplicates(["doc_id", md5]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: three-word shingles, similarity 0.9."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM s),
t AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS x FROM n),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.d)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = n.doc_id
"""
