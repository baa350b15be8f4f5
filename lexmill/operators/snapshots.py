"""The collection of chunks and vectors: opened or created, upserted by id, read at any snapshot, verified.

Rows lie in buckets by hash of the id. A snapshot is a numbered manifest that says in which folder each bucket's rows are, and
how many. An upsert writes the buckets that its rows fall into anew, into a folder of its own, then commits by creating
the next manifest, which only one can (sources/shared.py). So a run that is lost on the way leaves the old snapshot
as it was, readers of an older number go on reading it, and of two that commit over the same snapshot one raises Lost.

Ids must be there and be unique in what is upserted; vectors must have the collection's number of dimensions, no nulls, and finite
numbers. The first upsert settles columns and dimensions. An upsert of no rows is a snapshot with the same rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.sources import shared

#: Rows of a file of a bucket.
FILE_ROWS = 250_000


class Lost(RuntimeError):
    """Somebody else has committed the next snapshot."""


@dataclass(frozen=True)
class Staged:
    """What is written but not committed: the manifest that would be next."""

    manifest: dict


class Collection:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, root: str, on: str = "chunk_id", vector: str | None = None, buckets: int = 64) -> Collection:
        """The collection under root; a new, empty one if there is none. One that is there keeps its own id, vector and buckets; another id or vector raises."""
        c = cls(spark, root)
        first = {"number": 0, "on": on, "vector": vector, "buckets": buckets, "dimensions": None, "schema": None, "folders": {}, "rows": {}}
        shared.put(spark, c._path(0), json.dumps(first).encode())
        there = c.manifest()
        if (there["on"], there["vector"]) != (on, vector):
            raise ValueError(f"the collection has {there['on']} and {there['vector']}")
        return c

    def _path(self, number: int) -> str:
        return f"{self.root}/manifests/{number:09d}.json"

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in shared.names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]

    def manifest(self, number: int | None = None) -> dict:
        """Of a snapshot, the latest if none is named."""
        known = self.numbers()
        if number is None:
            number = known[-1]
        data = shared.get(self.spark, self._path(number)) if number in known else None
        if data is None:
            raise KeyError(f"no snapshot {number}")
        return json.loads(data)

    def _rows(self, m: dict, only: list[int] | None = None) -> DataFrame | None:
        """Rows of the buckets named (all of them), with their bucket."""
        if m["schema"] is None:
            return None
        schema, out = T.StructType.fromJson(m["schema"]), None
        of: dict[str, list[int]] = {}
        for b, folder in m["folders"].items():
            if only is None or int(b) in only:
                of.setdefault(folder, []).append(int(b))
        for folder, some in sorted(of.items()):
            part = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.root}/data/{folder}").where(F.col("bucket").isin(some))
            out = part if out is None else out.unionByName(part)
        return out

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a snapshot, the latest if none is named."""
        m = self.manifest(number)
        if m["schema"] is None:
            raise ValueError("nothing has been upserted")
        schema = T.StructType.fromJson(m["schema"])
        rows = self._rows(m)
        return self.spark.createDataFrame([], schema) if rows is None else rows.select(*schema.names)

    def count(self, number: int | None = None) -> int:
        return sum(self.manifest(number)["rows"].values())

    def _bucket(self, m: dict):
        return F.pmod(F.xxhash64(F.col(m["on"])), F.lit(m["buckets"])).cast("int")

    def stage(self, changes: DataFrame) -> Staged:
        """Checks changes and writes the buckets that they touch; nothing of it can be read before commit()."""
        m = self.manifest()
        on, vector = m["on"], m["vector"]
        schema = T.StructType.fromJson(m["schema"]) if m["schema"] else T.StructType([T.StructField(f.name, f.dataType) for f in changes.schema])
        if sorted(schema.names) != sorted(changes.columns):
            raise ValueError(f"the collection's columns are {schema.names}")
        rows = changes.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumn("bucket", self._bucket(m))
        checks = [F.count("*").alias("n"), F.count(on).alias("ids")]
        if vector:
            v = F.col(vector)
            checks += [F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("most"), F.count_if(v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad")]
        seen = rows.agg(*checks, F.sort_array(F.collect_set("bucket")).alias("touched")).first()
        twice = rows.groupBy(on).count().where("count > 1").limit(1).collect()
        if seen["ids"] < seen["n"] or twice:
            raise ValueError("an id is missing" if seen["ids"] < seen["n"] else f"an id is there twice: {twice[0][0]}")
        dimensions = m["dimensions"]
        if vector and seen["n"]:
            if seen["bad"] or seen["least"] != seen["most"] or (dimensions or seen["most"]) != seen["most"]:
                raise ValueError(f"vectors of {seen['least']} to {seen['most']} dimensions, {seen['bad']} not valid; the collection has {dimensions}")
            dimensions = seen["most"]
        folders, counts = dict(m["folders"]), dict(m["rows"])
        if touched := list(seen["touched"]):
            old, name = self._rows(m, touched), uuid.uuid4().hex
            whole = rows if old is None else old.join(rows.select(on), on, "left_anti").unionByName(rows)
            some = max(1, -(-(seen["n"] + sum(m["rows"].get(str(b), 0) for b in touched)) // (FILE_ROWS * len(touched))))
            path = f"{self.root}/data/{name}"
            whole.repartition(len(touched) * some, "bucket", F.pmod(F.xxhash64(F.lit(1), F.col(on)), F.lit(some))).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
            made = self.spark.read.schema("bucket int").parquet(path).groupBy("bucket").count().collect()  # a row a bucket
            folders |= {str(r["bucket"]): name for r in made}
            counts |= {str(r["bucket"]): r["count"] for r in made}
        return Staged(m | {"number": m["number"] + 1, "dimensions": dimensions, "schema": json.loads(schema.json()), "folders": folders, "rows": counts})

    def commit(self, staged: Staged) -> int:
        """Makes a staged upsert the next snapshot; its number."""
        number = staged.manifest["number"]
        if not shared.put(self.spark, self._path(number), json.dumps(staged.manifest).encode()):
            raise Lost(f"snapshot {number} is there already")
        return number

    def upsert(self, changes: DataFrame) -> int:
        return self.commit(self.stage(changes))

    def verify(self, number: int | None = None) -> DataFrame:
        """One row: rows, distinct ids, rows outside their bucket, buckets whose rows aren't as many as the manifest says, vectors of another size."""
        m = self.manifest(number)
        rows = self._rows(m)
        if rows is None:
            return self.spark.createDataFrame([(0, 0, 0, 0, 0)], "rows long, ids long, misplaced long, wrong_buckets long, wrong_vectors long")
        wrong = F.count_if(F.size(m["vector"]) != m["dimensions"]) if m["vector"] else F.lit(0)
        # ids of one bucket only: counted by bucket, so no distinct over all
        per = rows.groupBy("bucket", m["on"]).agg(F.count("*").alias("n"), F.count_if(F.col("bucket") != self._bucket(m)).alias("misplaced"), wrong.cast("long").alias("wrong"))
        per = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum("misplaced").alias("misplaced"), F.sum("wrong").alias("wrong"))
        said = self.spark.createDataFrame([(int(b), n) for b, n in m["rows"].items()], "bucket int, said long")
        j = said.join(per, "bucket", "full_outer")
        return j.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "rows"), ("ids", "ids"), ("misplaced", "misplaced"))), F.count_if(~F.col("n").eqNullSafe(F.col("said"))).alias("wrong_buckets"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong_vectors"))
