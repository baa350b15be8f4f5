"""JSON and CSV sources and sinks of small artifacts, with strict validation."""

from __future__ import annotations

import atexit
import csv
import io
import json
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.sources import shared

MANIFEST = T.StructType([T.StructField(n, T.StringType(), n not in ("document_id", "title", "document_type", "local_file")) for n in ("document_id", "title", "document_type", "local_file", "legislation_number", "issuing_authority", "official_source_url", "retrieved_at", "notes")])
QUESTION = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("question", T.StringType(), False), T.StructField("expected_articles", T.ArrayType(T.StringType()))])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (spark.checkpoint.dir); under a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _no_repeats(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a JSON object repeats a key")
    return out


def strict_json(text: str) -> object:
    return json.loads(text, object_pairs_hook=_no_repeats)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A list of documents; ids, files and known numbers are unique, required fields are there."""
    rows = strict_json("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(rows, list):
        raise ValueError("a manifest is a list")
    known = set(MANIFEST.names)
    for r in rows:
        if set(r) - known or any(not isinstance(r.get(f.name), str) or not r[f.name].strip() for f in MANIFEST if not f.nullable):
            raise ValueError(f"manifest row not valid: {r}")
    for r in rows:
        if not re.fullmatch(r"[a-z0-9]+([_-][a-z0-9]+)*", r["document_id"]):
            raise ValueError(f"not a document id: {r['document_id']!r}")
        if any(r.get(n) is not None and (not isinstance(r[n], str) or not r[n].strip()) for n in MANIFEST.names):
            raise ValueError(f"an optional field is blank or no text: {r}")
    df = spark.createDataFrame([tuple(r.get(n) for n in MANIFEST.names) for r in rows], MANIFEST)
    for key, by in (("document_id", F.col("document_id")), ("local_file", file_key("local_file", "/")), ("legislation_number", F.col("legislation_number"))):
        if not df.where(F.col(key).isNotNull()).groupBy(by.alias(key)).count().where("count > 1").isEmpty():
            raise ValueError(f"the manifest repeats a {key}")
    return df


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question, expected_articles; empty sets, blank fields and repeated ids or questions raise."""
    df = spark.read.schema(QUESTION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = df.where("id is null or question is null or trim(question) = '' or expected_articles is null or size(expected_articles) = 0")
    if df.isEmpty() or not bad.isEmpty():
        raise ValueError("no questions, or one that is not valid")
    key = F.lower(F.regexp_replace(F.trim("question"), r"(?U)\s+", " "))
    for c in (F.col("id"), key):
        if not df.groupBy(c).count().where("count > 1").isEmpty():
            raise ValueError("an id or a question is repeated")
    return df


#: Rows of a report that goes through the driver.
REPORT_ROWS = 100_000


def _few(df: DataFrame, rows: int = REPORT_ROWS) -> list:
    """All rows of a report; a table with more rows than a report has raises."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows: not a report")
    return found


def write_json(df: DataFrame, path: str, exclusive: bool = False) -> None:
    """A small table as an indented JSON list, UTF-8, with a newline at its end; absent values are left out. Written whole or not at all; exclusive: never over a file that is there."""
    data = json.dumps([json.loads(r[0]) for r in _few(df.select(F.to_json(F.struct(*df.columns))))], ensure_ascii=False, indent=2) + "\n"
    _put(Path(path), data.encode(), exclusive)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(F.col(f.name).cast("array<string>"), " | ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else f.name for f in df.schema))


def write_csv(df: DataFrame, path: str, bom: bool = True, exclusive: bool = False) -> None:
    """A small table as CSV; arrays are joined with ' | ', nulls are empty."""
    flat, out = _flat(df), io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(flat.columns)
    w.writerows(["" if x is None else x for x in r] for r in _few(flat))
    _put(Path(path), out.getvalue().encode("utf-8-sig" if bom else "utf-8"), exclusive)


def write_markdown(path: str, title: str, sections: dict[str, DataFrame | str], exclusive: bool = False) -> None:
    """A report: a title, then by section a heading and a paragraph or a small table (rates with four places; pipes and line ends in cells are escaped)."""
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", "<br>")
    out = [f"# {title}", ""]
    for name, what in sections.items():
        out += [f"## {name}", ""]
        if isinstance(what, str):
            out += [what, ""]
        else:
            flat = _flat(what)
            out += ["| " + " | ".join(flat.columns) + " |", "|" + " --- |" * len(flat.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in _few(flat)), ""]
    _put(Path(path), "\n".join(out).encode(), exclusive)


def _put(path: Path, data: bytes, exclusive: bool) -> None:
    if not shared._link(path, data, replace=not exclusive):
        raise FileExistsError(path)


# admission ---------------------------------------------------------------------


def file_key(path: Column | str, root: str) -> Column:
    """A file's path under root without . and .. and doubled slashes, so that all spellings of one file are one key."""
    p = F.col(path) if isinstance(path, str) else path
    whole = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    parts = F.aggregate(F.split(F.regexp_replace(whole, r"^file:/*", "/"), "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def admitted(roots: DataFrame, manifest: DataFrame, project_root: str = "/") -> DataFrame:
    """roots(document_id, source_file, ...) with the manifest's title, document_type and legislation_number, found by the file alone.

    A blank id or file, a file that is not in the manifest, and an id that isn't that file's raise; nothing is taken from another record.
    """
    of = manifest.select(file_key("local_file", project_root).alias("_file"), F.col("document_id").alias("_id"), "title", "document_type", "legislation_number")
    old = [c for c in roots.columns if c not in ("title", "document_type", "legislation_number")]
    j = roots.select(*old).withColumn("_file", file_key("source_file", project_root)).join(of, "_file", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    what = F.when(blank("document_id"), "a paragraph file without document_id: ").when(blank("source_file"), "a paragraph file without source_file: ").when(F.col("_id").isNull(), "a file that is not in the manifest: ").when(F.col("_id") != F.col("document_id"), "another document's file: ")
    checked = F.when(what.isNotNull(), F.raise_error(F.concat(what, F.coalesce("source_file", F.lit("?")))).cast("string")).otherwise(F.col("document_id"))
    return j.withColumn("document_id", checked).select(*old, "title", "document_type", "legislation_number")
