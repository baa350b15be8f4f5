"""Approximate nearest neighbours: a forest of hash prefixes.

A tree gives each vector a string of BITS bits, bit j being the side of a random hyperplane (shifted to the
median of a bounded sample, so that prefixes halve the data), and keeps all vectors as an array sorted by
string. The vectors under a node of the tree are those whose strings begin with its prefix: a slice of the
array. A query descends each tree to its longest prefix that any vector matches and then ascends all trees
together, one bit at a time, until the nodes that it stands on hold `want` vectors; all of those are compared
exactly. `want` is learned: for a bounded sample of queries the true neighbours are found by brute force, and
it is the least number that reaches RECALL on them.

Arrays are cut into shards of up to SHARD vectors at prefixes of variable length (from a histogram of short
prefixes, TREES * 2^COARSE numbers). A query visits, in each tree, the shards under the deepest prefix that
holds `want` vectors by itself, since the common ascent never passes it.

Equal vectors are one point of the forest with its k + 1 smallest ids: as many as any query can need.
Vectors that are null, zero, of another length than most or hold null or non-finite components take no part.
Rows that repeat a vec_id and vector are one; of several vectors of one vec_id each is a candidate, and the one of
the least bytes is the query. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import common as C

#: Short prefixes have COARSE bits at least and DEEPEST at most, so that a tree can have 16 times as many as it needs shards.
TREES, BITS, COARSE, DEEPEST = 16, 30, 8, 20
SHARD = 50_000
#: Bounds of what is fitted: vectors of the sample for medians, queries for `want`; recall aimed at.
SAMPLE, TRIALS, RECALL = 8192, 48, 0.96


def valid(df: DataFrame, key: str, col: str) -> DataFrame:
    """df -> id, vec (float64 components as bytes) of vectors that take part."""
    x = df.select(F.col(key).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    x = x.where(fine)
    size = x.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    x = x.where(F.size("v") == (size["s"] if size else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1) + 0.0  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), C.binary_array([r.tobytes() for r in m])], ["id", "vec"])

    return x.mapInArrow(pack, "id long, vec binary")


def matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


class Hashes:
    """Hyperplanes of all trees, with their shifts."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(TREES, sample.shape[1], BITS))
        self.shift = np.stack([np.median(sample @ p, axis=0) for p in self.planes])

    def codes(self, m: np.ndarray) -> np.ndarray:
        """trees x vectors, each string as a number whose order is the strings'."""
        w = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        return np.stack([((m @ p > s) @ w) for p, s in zip(self.planes, self.shift, strict=True)])


class Layout:
    """Shards of each tree by short prefixes, and how many vectors each short prefix has."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # trees x short prefixes
        self.coarse = counts.shape[1].bit_length() - 1
        self.shard = np.zeros(counts.shape, np.int64)
        self.n = 0
        for t in range(len(counts)):
            self._cut(t, 0, counts.shape[1])

    def _cut(self, t: int, a: int, b: int) -> None:
        if b - a > 1 and self.counts[t, a:b].sum() > SHARD:
            self._cut(t, a, (a + b) // 2)
            self._cut(t, (a + b) // 2, b)
        else:
            self.shard[t, a:b] = self.n
            self.n += 1

    def visited(self, t: int, short: int, want: int) -> list[int]:
        """Shards under the deepest short prefix with `want` vectors."""
        for depth in range(self.coarse, -1, -1):
            a = short >> (self.coarse - depth) << (self.coarse - depth)
            b = a + (1 << (self.coarse - depth))
            if depth == 0 or self.counts[t, a:b].sum() >= want:
                return np.unique(self.shard[t, a:b]).tolist()
        return []


def _slice(codes: np.ndarray, code: int, level: int) -> tuple[int, int]:
    low = code >> (BITS - level) << (BITS - level)
    return int(np.searchsorted(codes, low)), int(np.searchsorted(codes, low + (1 << (BITS - level))))


class Forest:
    """An index over all vectors of points(id, vec)."""

    def __init__(self, points: DataFrame, k: int):
        self.k = k
        w = Window.partitionBy("vec").orderBy("id")
        few = points.dropDuplicates(["id", "vec"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
        self.members = C.materialize(few.groupBy("vec").agg(F.min("id").alias("uid"), F.sort_array(F.collect_list("id")).alias("ids")), "forest-points")
        self.size = self.members.count()
        if not self.size:
            return
        share = min(1.0, SAMPLE / self.size)
        some = self.members.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).orderBy("uid").limit(2 * SAMPLE)
        sample = matrix(some.select("vec").toArrow().column(0)) if share < 1 else matrix(self.members.select("vec").toArrow().column(0))
        hashes = self.hashes = Hashes(sample if len(sample) else matrix(self.members.limit(1).select("vec").toArrow().column(0)))

        coarse = self.coarse = min(DEEPEST, max(COARSE, (self.size // SHARD).bit_length() + 4))

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((TREES, 1 << coarse), np.int64)
            for b in batches:
                for t, c in enumerate(hashes.codes(matrix(b.column(0)))):
                    n[t] += np.bincount(c >> (BITS - coarse), minlength=1 << coarse)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["at", "n"])

        counts = np.zeros(TREES << coarse, np.int64)
        for r in self.members.select("vec").mapInArrow(histogram, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[r["at"]] = r["n"]
        layout = self.layout = Layout(counts.reshape(TREES, -1))

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t, c in enumerate(hashes.codes(matrix(b.column(1)))):
                    shard = layout.shard[t, c >> (BITS - coarse)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(c), b.column(0), b.column(1)], ["shard", "code", "uid", "vec"])

        trees = self.members.select("uid", "vec").mapInArrow(grow, "shard int, code long, uid long, vec binary")
        self.trees = C.materialize(trees.repartition(layout.n, "shard").sortWithinPartitions("shard", "code", "uid"), "forest-trees")

    def routed(self, queries: DataFrame, want: int) -> DataFrame:
        """queries(id, vec) -> shard, tree, qid, code, q: a row for each shard that a query visits."""
        hashes, layout, coarse = self.hashes, self.layout, self.coarse

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, vecs = b.column(0).to_pylist(), b.column(1).to_pylist()
                out = [(s, i, int(c[j]), v) for t, c in enumerate(hashes.codes(matrix(b.column(1)))) for j, (i, v) in enumerate(zip(ids, vecs, strict=True)) for s in layout.visited(t, int(c[j]) >> (BITS - coarse), want)]
                for at in range(0, len(out), 4000):
                    x = list(zip(*out[at : at + 4000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.int64()), C.binary_array(list(x[3]))], ["shard", "qid", "code", "q"])

        return queries.mapInArrow(route, "shard int, qid long, code long, q binary")

    def levels(self, routed: DataFrame) -> DataFrame:
        """qid, level, n: vectors under the query's prefixes of that length, over all trees."""

        def count(key, q, t):
            codes, out = np.sort(t.column("code").to_numpy()), []
            for i, c in zip(q.column("qid").to_pylist(), q.column("code").to_pylist(), strict=True):
                for level in range(BITS, -1, -1):
                    a, b = _slice(codes, c, level)
                    if b > a:
                        out.append((i, level, b - a))
            x = list(zip(*out, strict=True)) or [[]] * 3
            return pa.table({"qid": pa.array(x[0], pa.int64()), "level": pa.array(x[1], pa.int32()), "n": pa.array(x[2], pa.int64())})

        per = routed.select("shard", "qid", "code").groupBy("shard").cogroup(self.trees.select("shard", "code").groupBy("shard")).applyInArrow(count, "qid long, level int, n long")
        return per.groupBy("qid", "level").agg(F.sum("n").alias("n"))

    def learn(self, queries: DataFrame, total: int) -> int:
        """The least `want` that reaches RECALL on a bounded sample of queries, by brute force on those."""
        share = min(1.0, TRIALS / max(1, total))
        trials = queries.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy("id").limit(2 * TRIALS)
        some = trials.toArrow()
        if not some.num_rows:
            return self.size
        q, qid, k, hashes = matrix(some.column("vec")), some.column("id").to_pylist(), self.k, self.hashes
        mine = hashes.codes(q)

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [[] for _ in qid]
            for b in batches:
                m, ids = matrix(b.column(1)), b.column(0).to_numpy()
                codes = hashes.codes(m)
                for j, v in enumerate(q):
                    d = (m * m).sum(1) - 2 * (m @ v)
                    for x in np.argpartition(d, min(k, len(d) - 1))[: k + 1]:
                        if int(ids[x]) != qid[j]:
                            differ = codes[:, x] ^ mine[:, j]
                            best[j].append((float(d[x]), int(ids[x]), BITS - int(min(int(e).bit_length() for e in differ))))
                    best[j] = sorted(best[j])[:k]
            out = [(qid[j], *x) for j, xs in enumerate(best) for x in xs]
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.float64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32())], ["qid", "d", "uid", "match"])

        near = self.members.select("uid", "vec").mapInArrow(brute, "qid long, d double, uid long, match int")
        true = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "uid"))).where(F.col("r") <= k).toPandas()
        sizes = self.levels(self.routed(trials, 1 << 62)).toPandas()
        at = {(r.qid, r.level): r.n for r in sizes.itertuples()}
        match = {i: g["match"].to_numpy() for i, g in true.groupby("qid")}
        for want in sorted({int(n) for n in at.values()}):
            got = []
            for i in qid:
                level = max((v for (j, v), n in at.items() if j == i and n >= want), default=0)
                got.append(float((match.get(i, np.zeros(1)) >= level).mean()))
            if np.mean(got) >= RECALL:
                return want
        return self.size * TREES

    def search(self, queries: DataFrame) -> DataFrame:
        """queries(id, vec) -> query_id, rank, vec_id, score."""
        k, spark = self.k, queries.sparkSession
        schema = "query_id long, rank int, vec_id long, score double"
        if not self.size:
            return spark.createDataFrame([], schema)
        total = queries.count()
        want = max(k + 1, self.learn(queries, total))
        routed = C.materialize(self.routed(queries, want), "forest-visits")
        enough = self.levels(routed).where(F.col("n") >= want).groupBy("qid").agg(F.max("level").alias("level"))
        asked = routed.join(enough, "qid", "left").select("shard", "qid", "code", "q", F.coalesce("level", F.lit(0)).alias("level"))

        def compare(key, q, t):
            order = np.argsort(t.column("code").to_numpy(), kind="stable")
            codes, uid = t.column("code").to_numpy()[order], t.column("uid").to_numpy()[order]
            m = matrix(t.column("vec"))[order] if t.num_rows else np.zeros((0, 1))
            norm, out = (m * m).sum(1), []
            for i, c, v, level in zip(*(q.column(x).to_pylist() for x in ("qid", "code", "q", "level")), strict=True):
                a, b = _slice(codes, c, level)
                if b <= a:
                    continue
                v = np.frombuffer(v, np.float64)
                d = norm[a:b] - 2 * (m[a:b] @ v)
                few = np.arange(b - a)
                if b - a > 4 * (k + 1):
                    cut = np.partition(d, k + 1)[k + 1]
                    few = np.flatnonzero(d <= cut + 1e-9 * (1 + abs(cut) + float(v @ v)))
                exact = np.sqrt(((m[a:b][few] - v) ** 2).sum(1))
                for x in np.lexsort((uid[a:b][few], exact))[: k + 1]:
                    out.append((i, int(uid[a:b][few[x]]), float(exact[x])))
            x = list(zip(*out, strict=True)) or [[]] * 3
            return pa.table({"qid": pa.array(x[0], pa.int64()), "uid": pa.array(x[1], pa.int64()), "score": pa.array(x[2], pa.float64())})

        found = asked.groupBy("shard").cogroup(self.trees.groupBy("shard")).applyInArrow(compare, "qid long, uid long, score double")
        best = Window.partitionBy("qid").orderBy("score", "uid")
        found = found.groupBy("qid", "uid").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
        named = found.join(self.members.select("uid", "ids"), "uid").select("qid", "score", F.explode("ids").alias("vec_id")).where("vec_id <> qid")
        last = Window.partitionBy("qid").orderBy("score", "vec_id")
        return named.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")


def asked(points: DataFrame, each: int) -> DataFrame:
    """The points whose ids `each` divides, one vector an id."""
    return points.where(F.col("id") % each == 0).groupBy("id").agg(F.min("vec").alias("vec"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every hundredth vector against all."""
    points = C.materialize(valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "forest-vectors")
    return Forest(points, 10).search(asked(points, 100))
