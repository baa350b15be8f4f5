"""A stored lexical index: BM25 over postings in blocks, built once and asked often; retrieval variants from two rankings.

build() shuffles texts (composed, NFC) once, by segment: some SEGMENT_DOCS documents (fewer where they are long) by hash of their id, which one task cuts into terms and turns into postings:
a row for each term with the places of its documents in the segment and their frequencies, and one row with the segment's ids and lengths. Rows lie in parts by hash of
the term, in order of term and segment. Weights aren't stored: they need the whole collection's figures, which are sums over rows of the terms that are asked, and are computed for those alone.
A question reads the parts that its terms fall into (the part is a folder), there the rows of its terms. A segment's task gets the rows once, however many questions ask for them.
In it, shards of shard_docs documents are bounded by the sum of a question's terms' greatest weights; the FIRST shards of highest bound are scored, the k-th score found is a floor,
and only shards whose bound reaches it are scored further. Nothing is lost: a document in a shard below the floor can't be
among the first k.

Weights are whole multiples of 10^-13, so sums don't depend on their order. A document without terms has no row; null texts
are empty; an empty table or a question without known terms gives no row. Ids are longs or strings, and unique.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lexmill.functions import text as T
from lexmill.operators import metrics, retrieval
from lexmill.sources import shared

FIRST, SHARD_DOCS = 2, 4096
#: What a segment has of documents and, on average, of their text: one task holds it.
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 32 << 20
UNIT = retrieval.UNIT
#: 10^-6 in units, to which scores are rounded.
ROUNDED = 10_000_000
#: Question terms up to which they are broadcast to the postings.
ASKED = retrieval.ASKED
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), pa.array(values.astype(np.int32)))


def _flat(c: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column of lists, one after another."""
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in c.chunks])


def build(docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, parts: int | None = None) -> LexicalIndex:
    """Writes the index of docs under root (a new folder) and opens it."""
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text).cast("long"))).first()
    segments = max(1, math.ceil(n / max(shard_docs, SEGMENT_DOCS)), math.ceil((size or 0) / SEGMENT_BYTES))
    parts = parts or max(8, min(4096, segments))
    dealt = T.composed(docs.select(doc_id, text), text).select(F.pmod(F.xxhash64(doc_id), F.lit(segments)).cast("int").alias("segment"), F.col(doc_id).alias("id"), text)
    dealt = dealt.repartitionById(min(4096, segments), F.col("segment")).sortWithinPartitions("segment", "id")  # a segment a task; places are the same whenever a task is run
    cut = dealt.select("segment", "id", T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    id_type = cut.schema["id"].dataType.simpleString()
    kind = _ARROW[id_type]

    def post(key, t):
        n, lengths = t.num_rows, np.concatenate([pc.list_value_length(c).to_numpy() for c in t.column("terms").chunks])
        terms = pa.chunked_array([c.flatten() for c in t.column("terms").chunks], pa.string()).dictionary_encode()
        codes = np.concatenate([c.indices.to_numpy() for c in terms.chunks]).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
        known = terms.chunk(terms.num_chunks - 1).dictionary if len(terms) else pa.array([], pa.string())
        pairs, tf = np.unique(codes * n + np.repeat(np.arange(n), lengths), return_counts=True)
        count = np.bincount(pairs // n, minlength=len(known))
        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t.column("id").combine_chunks().cast(kind))
        head = [pa.nulls(1, pa.string()), _lists(lengths[:0], np.zeros(1)), _lists(lengths, np.array([n])), ids]
        body = [known, _lists(pairs % n, count), _lists(tf, count), pa.nulls(len(known), ids.type)]
        made = [pa.chunked_array([x, y]) for x, y in zip(head, body, strict=True)]
        return pa.table([pa.array(np.full(1 + len(known), key[0].as_py(), np.int32)), *made], ["segment", "term", "at", "tf", "ids"])

    made = cut.groupBy("segment").applyInArrow(post, f"segment int, term string, at array<int>, tf array<int>, ids array<{id_type}>")
    made = made.withColumn("n", F.size("at")).withColumn("part", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(parts))).cast("int"))
    made.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "term", "segment").write.partitionBy("part").option("compression", "zstd").parquet(f"{root}/postings")
    about = {"segments": segments, "shard_docs": shard_docs, "parts": parts, "schema": json.loads(made.drop("part").schema.json())}
    size = F.size("ids")
    whole = _read(spark, root, about).where("part = -1").agg(F.sum(size).alias("n"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms"), F.sum(F.ceil(size / shard_docs)).alias("shards")).first()
    n = whole["n"] or 0
    shared.put(spark, f"{root}/index.json", json.dumps(about | {"documents": n, "avgdl": (whole["terms"] / n if n else 0) or 1.0, "shards": int(whole["shards"] or 0)}).encode())
    return LexicalIndex(spark, root)


def _read(spark: SparkSession, root: str, about: dict) -> DataFrame:
    schema = Ty.StructType([*Ty.StructType.fromJson(about["schema"]).fields, Ty.StructField("part", Ty.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/postings")


class LexicalIndex:
    """An index that is there; asking it reads no text but the questions'."""

    def __init__(self, spark: SparkSession, root: str):
        data = shared.get(spark, f"{root}/index.json")
        if data is None:
            raise FileNotFoundError(f"no index under {root}")
        self.spark, self.root, self.about = spark, root, json.loads(data)

    def postings(self) -> DataFrame:
        """segment, term, at, tf, ids, n, part: a row for each term and segment; part -1 has a row for each segment, with ids and, as tf, lengths."""
        return _read(self.spark, self.root, self.about)

    def asked(self, questions: DataFrame) -> DataFrame:
        """questions(query_id, question) -> query_id, its distinct terms, the part of each."""
        return T.composed(questions.select("query_id", "question"), "question").select("query_id", F.explode(F.array_distinct(T.tokens("question"))).alias("term")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(self.about["parts"])).cast("int"))

    def topk(self, questions: DataFrame, k: int = retrieval.POOL) -> DataFrame:
        """questions(query_id, question) -> query_id, rank, id, score: distinct question terms, score > 0, ties by id, as retrieval.bm25."""
        return self._ranked(self._by_segment(questions, k, "id"), k)

    def shards_read(self, questions: DataFrame, k: int = retrieval.POOL) -> DataFrame:
        """query_id, touched (shards with any of its terms), read (those that topk() scores)."""
        return self._by_segment(questions, k, "shards").groupBy("query_id").agg(F.sum("touched").alias("touched"), F.sum("read").alias("read"))

    def _by_segment(self, questions: DataFrame, k: int, what: str) -> DataFrame:
        """id: query_id, id, score (sums of weights) of a segment's documents, but those that k others of it pass for sure. shards: query_id, touched and read shards of a segment.

        A row that leaves a segment's task is one of about k for a question.
        """
        about, asked = self.about, self.asked(questions)
        terms = asked.select("part", "term").distinct()
        some = terms.groupBy("part").count().collect()  # at most `parts`, which are at most 4096
        spread = F.broadcast if sum(r["count"] for r in some) <= ASKED else lambda d: d
        every = self.postings().where(F.col("part").isin([r["part"] for r in some] or [-2]))
        df = every.select("part", "term", "n").join(spread(terms), ["part", "term"], "left_semi").groupBy("term").agg(F.sum("n").cast("double").alias("df"))
        idf = F.log(1 + (F.lit(float(about["documents"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        wanted = asked.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("s"))
        wanted = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(about["segments"] - 1))).alias("of"), "query_id", F.col("s.term").alias("terms"), F.col("s.idf").alias("idfs"))
        columns = ["segment", "term", "at", "tf", "ids"]
        rows = every.join(spread(terms), ["part", "term"], "left_semi").select(*columns).union(self.postings().where("part = -1").select(*columns))
        q_type, id_type = asked.schema["query_id"].dataType.simpleString(), rows.schema["ids"].dataType.elementType.simpleString()
        names, kinds = ("query_id", "id", "score") if what == "id" else ("query_id", "touched", "read"), (_ARROW[q_type], _ARROW[id_type] if what == "id" else pa.int64(), pa.int64())
        avgdl, shard_docs = float(about["avgdl"]), about["shard_docs"]

        def look(_, left, right):
            out: tuple[list, list, list] = ([], [], [])
            for q, *found in _look(left, right, k, avgdl, shard_docs, what) if left.num_rows > 1 and right.num_rows else ():
                for c, x in zip(out, (pa.array([q] * len(found[0]), kinds[0]), *found), strict=True):
                    c.append(x)
            return pa.table({n: pa.chunked_array(c, t) for n, c, t in zip(names, out, kinds, strict=True)})

        return rows.groupBy("segment").cogroup(wanted.groupBy("of")).applyInArrow(look, f"query_id {q_type}, " + (f"id {id_type}, score long" if what == "id" else "touched long, read long"))

    @staticmethod
    def _ranked(scores: DataFrame, k: int) -> DataFrame:
        s = scores.select("query_id", "id", F.round(F.col("score") / UNIT, 6).alias("score")).where("score > 0")
        return retrieval.rank(s, [F.col("score").desc(), F.col("id").asc()], k)


def _look(left: pa.Table, right: pa.Table, k: int, avgdl: float, shard_docs: int, what: str):
    """A segment's rows (of its documents and of asked terms) and questions -> for each question: it, ids and scores of its best; or it, how many shards it touches and how many were scored."""
    of_docs = pc.is_null(left.column("term"))
    head, body = left.filter(of_docs), left.filter(pc.invert(of_docs))
    ids, dl = pa.chunked_array([c.flatten() for c in head.column("ids").chunks]).combine_chunks(), _flat(head.column("tf")).astype(np.float64)
    if not body.num_rows:
        return
    count, at, tf = np.concatenate([pc.list_value_length(c).to_numpy() for c in body.column("at").chunks]), _flat(body.column("at")).astype(np.int64), _flat(body.column("tf")).astype(np.float64)
    asks = np.r_[0, np.cumsum(np.concatenate([pc.list_value_length(c).to_numpy() for c in right.column("terms").chunks]))]
    asked = pa.chunked_array([c.flatten() for c in right.column("terms").chunks])
    row_of = pc.fill_null(pc.index_in(asked, value_set=body.column("term").combine_chunks()), -1).to_numpy()
    idf = np.zeros(body.num_rows)
    idf[row_of[row_of >= 0]] = _flat(right.column("idfs"))[row_of >= 0]
    row = np.repeat(np.arange(body.num_rows), count)
    weight = idf[row] * tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * dl[at] / avgdl))
    weight = np.floor(weight * UNIT + 0.5).astype(np.int64)
    # runs: the postings of a row in a shard
    shards = -(-len(ids) // shard_docs)
    cell = row * shards + at // shard_docs
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    length, cell = np.diff(np.r_[begin, len(cell)]), cell[begin]
    top = np.zeros(body.num_rows * shards, np.int64)
    top[cell] = np.maximum.reduceat(weight, begin)
    top, run_at = top.reshape(-1, shards), np.searchsorted(cell // shards, np.arange(body.num_rows + 1))

    def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())

    for q, i, j in zip(right.column("query_id").to_pylist(), asks[:-1].tolist(), asks[1:].tolist(), strict=True):
        r = row_of[i:j]
        r = r[r >= 0]
        bound = top[r].sum(axis=0)
        touched = bound > 0
        if not touched.any():
            continue
        runs, s = spans(run_at[r], run_at[r + 1] - run_at[r]), np.zeros(len(ids), np.int64)
        shard = cell[runs] % shards

        def add(which: np.ndarray, runs=runs, shard=shard, s=s) -> None:
            mine = runs[which[shard]]
            p = spans(begin[mine], length[mine])
            np.add.at(s, at[p], weight[p])

        read = np.zeros(shards, bool)
        read[np.argsort(-bound, kind="stable")[:FIRST]] = True
        read &= touched
        add(read)
        found = s[s > 0]
        floor = np.partition(found, -k)[-k] if len(found) >= k else 0
        more = touched & ~read & (bound + ROUNDED >= floor)
        if more.any():
            add(more)
        if what == "shards":
            yield q, pa.array([int(touched.sum())]), pa.array([int((read | more).sum())])
            continue
        few = np.flatnonzero(s > 0)
        if len(few) > k:
            few = few[s[few] >= np.partition(s[few], -k)[-k] - 2 * ROUNDED]
        yield q, ids.take(pa.array(few)), pa.array(s[few])


VARIANTS = ("B0", "B1", "B2", "B3")


def variants(dense: DataFrame, lexical: DataFrame, keys: DataFrame, k: int = 5, pool: int = retrieval.POOL) -> DataFrame:
    """dense, lexical (query_id, rank, id) and keys(id, key) -> variant, query_id, rank, id.

    B0: the dense ranking as it is. B1: the lexical one. B2: both fused over the first `pool` of each. B3: the fused one,
    the whole of it, with the first of each key kept. The first k of each. Nothing is searched anew: one dense ranking serves all.
    """
    d, x = (r.where(F.col("rank") <= pool).select("query_id", "rank", "id") for r in (dense, lexical))
    fused = retrieval.rrf(d, x)
    once = retrieval.first_per_key(fused.join(keys, "id"), "key", k)
    out = None
    for name, r in zip(VARIANTS, (d, x, fused, once), strict=True):
        part = r.where(F.col("rank") <= k).select(F.lit(name).alias("variant"), "query_id", F.col("rank").cast("long").alias("rank"), "id")
        out = part if out is None else out.union(part)
    return out


def variants_summary(ranked: DataFrame, keys: DataFrame, gold: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """variants()'s rows, keys(id, key, document), gold(query_id, key, document) -> a row a variant: questions, any/all source and document
    hits at 1, 3 and 5, questions with an unexpected document first (count and rate of those with any), mean share of unexpected
    slots (of questions with slots), and with usage(variant, query_id, latency_ms, tokens) the mean latency and the tokens (null as soon as one is unknown).

    A question without any slot counts as a miss of every hit.
    """
    cuts = (1, 3, 5)
    every = gold.select("query_id").distinct().withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    slots = ranked.join(keys, "id").select(F.struct("variant", "query_id").alias("query_id"), "rank", "key", "document", "id")
    asked = every.join(gold, "query_id").select(F.struct("variant", "query_id").alias("query_id"), "key", "document")
    m = metrics.at_cutoffs(slots, asked, cuts)
    wide = m.groupBy("query_id").agg(*(F.max(F.when(F.col("k") == k, F.col(c).cast("double"))).alias(f"{a}_{k}") for k in cuts for c, a in (("source_any", "any"), ("source_all", "all"), ("document_hit", "document"))), F.max(F.when(F.col("k") == 5, F.col("intrusion"))).alias("share"))
    top = slots.where("rank = 1").select("query_id", F.col("document").alias("top"))
    ours = asked.select("query_id", F.col("document").alias("top")).distinct().withColumn("is_ours", F.lit(True))
    wide = wide.join(top.join(ours, ["query_id", "top"], "left").select("query_id", F.coalesce("is_ours", F.lit(False)).alias("expected_top")), "query_id", "left")
    cols = [F.count("*").alias("questions"), *(F.avg(f"{a}_{k}").alias(f"{a}_{k}") for a in ("any", "all", "document") for k in cuts), F.count_if(~F.col("expected_top")).alias("unexpected_top"), F.avg((~F.col("expected_top")).cast("double")).alias("unexpected_top_rate"), F.avg("share").alias("unexpected_share")]
    if usage is not None:
        wide = wide.join(usage.select(F.struct("variant", "query_id").alias("query_id"), "latency_ms", "tokens"), "query_id", "left")
        cols += [F.avg("latency_ms").alias("latency_ms"), metrics.sum_or_null("tokens").alias("tokens")]
    return wide.groupBy(F.col("query_id.variant").alias("variant")).agg(*cols)
