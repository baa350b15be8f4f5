"""Binary document sources: OOXML text and sheets, RTF, ZIP archives of annexes; DataFrames over binaryFile."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

PARAGRAPHS = "path string, index int, text string, style_name string, footnotes array<int>"
BLOCKS = "path string, member string, member_sha256 string, detected string, source_order int, kind string, text string, rows array<array<string>>, sheet_name string, cells array<struct<coord:string,value:string,formula:string,cached_value:string>>, warning string"


def detect(data: bytes) -> str:
    """By content, whatever the name says: rtf, ole, docx, xlsx or unknown."""
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return "ole"
    if data.startswith(b"PK"):
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return "unknown"
        return "docx" if "word/document.xml" in names else "xlsx" if "xl/workbook.xml" in names else "unknown"
    return "unknown"


def _text(p: ElementTree.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif x.tag == W + "tab":
            out.append("\t")
    return "".join(out)


def normalize(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\n", " ").strip()


def docx_paragraphs(data: bytes) -> list[tuple[int, str, str, list[int] | None]]:
    """(index, text, style, footnote ids) of body paragraphs outside tables; blank ones are left out but keep their index."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                n = s.find(W + "name")
                names[s.get(W + "styleId")] = n.get(W + "val") if n is not None else None
    out = []
    for k, p in enumerate(body.findall(W + "p")):
        text = normalize(_text(p))
        if text:
            style = p.find(f"{W}pPr/{W}pStyle")
            notes = [int(x.get(W + "id")) for x in p.iter(W + "footnoteReference")]
            out.append((k, text, names.get(style.get(W + "val"), style.get(W + "val")) if style is not None else "Normal", notes or None))
    return out


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs (as they are, blank ones too) and tables in the order of the file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
    out = []
    for x in body:
        if x.tag == W + "p":
            out.append({"kind": "paragraph", "text": _text(x)})
        elif x.tag == W + "tbl":
            out.append({"kind": "table", "rows": [[" ".join(filter(None, (normalize(_text(p)) for p in c.iter(W + "p")))) for c in r.findall(W + "tc")] for r in x.findall(W + "tr")]})
    return out


def xlsx_blocks(data: bytes) -> list[dict]:
    """A block a sheet: cells with their value, formula and cached value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")]
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
            at = target[s.get(R + "id")]
            cells = []
            for c in ElementTree.fromstring(z.read(at.lstrip("/") if at.lstrip("/").startswith("xl/") else "xl/" + at)).iter(S + "c"):
                v, f = c.find(S + "v"), c.find(S + "f")
                value = v.text if v is not None else None
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(S + "t"))
                if f is not None:
                    cells.append({"coord": c.get("r"), "value": None, "formula": f.text, "cached_value": value})
                elif value is not None:
                    cells.append({"coord": c.get("r"), "value": value, "formula": None, "cached_value": None})
            out.append({"kind": "spreadsheet", "sheet_name": s.get("name"), "cells": cells})
    return out


_RTF = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+|.)", re.I | re.S)
#: Groups without text of the document (fixed values of the format).
_SKIP = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"object", b"header", b"footer", b"themedata", b"datastore", b"generator", b"listtable", b"listoverridetable", b"rsidtbl"}


def rtf_text(data: bytes, codepage: str = "cp1252") -> str:
    """Plain text of RTF: paragraphs and tabs, \\'xx in the codepage, \\uN with its substitute skipped; tables of fonts and the like left out."""
    stack, skip, uc, drop, out = [], False, 1, 0, []
    for word, arg, hexa, sign, brace, plain in (m.groups(b"") for m in _RTF.finditer(data)):
        if brace == b"{":
            stack.append((skip, uc))
        elif brace == b"}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif word:
            w = word.lower()
            if w in _SKIP:
                skip = True
            elif w == b"uc":
                uc = int(arg or 1)
            elif skip:
                pass
            elif w in (b"par", b"line", b"row"):
                out.append("\n")
            elif w in (b"tab", b"cell"):
                out.append("\t")
            elif w == b"u" and arg:
                n = int(arg)
                out.append(chr(n + 65536 if n < 0 else n))
                drop = uc
        elif plain:
            if drop:
                drop, plain = max(0, drop - len(plain)), plain[drop:]
            if not skip:
                out.append(plain.decode(codepage, "replace"))
        elif hexa or sign:
            if drop:
                drop -= 1
            elif not skip:
                if hexa:
                    out.append(bytes([int(hexa, 16)]).decode(codepage, "replace"))
                elif sign in (b"\\", b"{", b"}"):
                    out.append(sign.decode())
                elif sign == b"~":
                    out.append("\u00a0")
    return "".join(out)


def blocks_of(data: bytes) -> tuple[str, list[dict], str | None]:
    """(detected type, blocks, warning)."""
    kind = detect(data)
    if kind == "docx":
        return kind, docx_blocks(data), None
    if kind == "xlsx":
        return kind, xlsx_blocks(data), None
    if kind == "rtf":
        return kind, [{"kind": "paragraph", "text": rtf_text(data)}], None  # one block: its lines aren't paragraphs of their own
    return kind, [], f"can't read a {kind} file"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of .docx files; a missing path raises."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *r) for p, c in zip(b.path, b.content, strict=True) for r in docx_paragraphs(bytes(c))]
            yield pd.DataFrame(out, columns=["path", "index", "text", "style_name", "footnotes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, PARAGRAPHS)


#: Bytes of members that a task reads.
TASK_BYTES = 32 << 20
_MEMBERS = "path string, archive_sha256 string, member string, member_order int, size long"


def _opened(path: str):
    """A seekable file of the shared file system; None if only Spark can read it."""
    from pyarrow import ArrowInvalid, fs

    try:
        system, at = fs.FileSystem.from_uri(path)
    except (ArrowInvalid, OSError):
        return None
    return system.open_input_file(at)


def members(spark: SparkSession, path: str) -> DataFrame:
    """A row a member of ZIP archives, from their central directories: path, archive_sha256, member, member_order, size. An archive is read as a stream for its hash, never held."""
    paths = spark.read.format("binaryFile").load(path).select("path")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.path:
                with _opened(p) as f:
                    h = hashlib.sha256()
                    while part := f.read(1 << 20):
                        h.update(part)
                    f.seek(0)
                    with zipfile.ZipFile(f) as z:
                        found = [i for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame([(p, h.hexdigest(), i.filename, k, i.file_size) for k, i in enumerate(found)], columns=["path", "archive_sha256", "member", "member_order", "size"])

    return paths.repartition(max(1, paths.count())).mapInPandas(rows, _MEMBERS)


def _contents(found: DataFrame, tasks: int) -> DataFrame:
    """members() + content: each member is read by itself, wherever in its archive it stands."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, archive = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.path != at:
                    at, archive = r.path, zipfile.ZipFile(_opened(r.path))
                yield pd.DataFrame([(*r, archive.read(r.member))], columns=[*b.columns, "content"])

    return found.repartition(tasks, "path", "member").sortWithinPartitions("path", "member_order").mapInPandas(rows, f"{_MEMBERS}, content binary")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """The same for archives in a store that only Spark reads: an archive is one task's."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b.path, b.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                    for k, i in enumerate(i for i in z.infolist() if not i.is_dir()):
                        yield pd.DataFrame([(p, hashlib.sha256(bytes(c)).hexdigest(), i.filename, k, i.file_size, z.read(i))], columns=["path", "archive_sha256", "member", "member_order", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"{_MEMBERS}, content binary")


CONVERSION = "archive_member_path string, conversion_status string, normalized_relative_path string, normalized_sha256 string, normalization_tool string, normalization_tool_version string, normalization_command_family string"


def load_conversions(spark: SparkSession, path: str) -> DataFrame:
    """A normalisation manifest (JSON with source_zip_sha256 and entries) as a row an entry, with the archive's hash. A member that is there twice raises."""
    d = spark.read.schema(f"source_zip_sha256 string, entries array<struct<{CONVERSION.replace(' string', ':string')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = d.select("source_zip_sha256", F.inline("entries"))
    twice = out.groupBy("source_zip_sha256", "archive_member_path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the manifest has {twice[0][1]} twice")
    return out


def converted(found: DataFrame, conversions: DataFrame, files: DataFrame) -> DataFrame:
    """found (path, archive_sha256, member, ..., content) with the bytes of successful conversions in place of their members', and what they are.

    files(path, content): the converted files; an entry's is the one whose path ends in its normalized_relative_path. A conversion
    of another archive than the one that is read and one whose file isn't there or has another hash raise; entries of members that aren't there are ignored.
    """
    ok = conversions.where("conversion_status = 'SUCCESS'")
    f = files.select(F.col("path").alias("_file"), F.col("content").alias("_bytes"), F.sha2("content", 256).alias("_sha"), F.element_at(F.split("path", "/"), -1).alias("_name"))
    e = ok.withColumn("_name", F.element_at(F.split("normalized_relative_path", "/"), -1)).join(f, "_name", "left").where(F.col("_file").isNull() | F.col("_file").endswith(F.concat(F.lit("/"), F.col("normalized_relative_path"))))
    j = found.join(e.withColumnRenamed("archive_member_path", "member"), "member", "left")
    what = F.when(F.col("normalized_sha256").isNull(), None).when(F.col("source_zip_sha256") != F.col("archive_sha256"), "conversion of another archive: ").when(F.col("_bytes").isNull(), "no converted file for ").when(F.col("_sha") != F.col("normalized_sha256"), "another hash than the manifest's: ")
    content = F.when(what.isNotNull(), F.raise_error(F.concat(what, F.col("member"))).cast("binary")).otherwise(F.coalesce("_bytes", "content"))
    of = F.when(F.col("normalized_sha256").isNotNull(), F.struct("normalization_tool", "normalization_tool_version", "normalization_command_family", "normalized_relative_path", "normalized_sha256"))
    return j.select(*(found[c] for c in found.columns if c != "content"), F.col("content").alias("_own"), content.alias("content"), of.alias("normalized"))


def read_archive(spark: SparkSession, path: str, conversions: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Blocks of all members of ZIP archives, with hashes of member and archive; a member without blocks has one row.

    Members are rows and read one by one, so a large archive is many tasks' (in a store that pyarrow reads). conversions
    (load_conversions) and files (binaryFile of the converted ones): what stands in for members in legacy formats; see converted().
    member_sha256 and original are of the member as it is in the archive, detected is of what was read.
    """
    some = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    if some and _opened(some[0][0]) is None:
        found = _whole(spark, path)
    else:
        rows = members(spark, path)
        total = rows.agg(F.sum("size")).first()[0] or 0
        found = _contents(rows, max(1, -(-total // TASK_BYTES)))
    found = converted(found, conversions, files) if conversions is not None else found.withColumn("_own", F.col("content")).withColumn("normalized", F.lit(None).cast("struct<normalization_tool:string,normalization_tool_version:string,normalization_command_family:string,normalized_relative_path:string,normalized_sha256:string>"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                data, own = bytes(r.content), bytes(r.own)
                kind, made, warning = blocks_of(data)
                out = [(r.path, r.archive_sha256, r.member, r.member_order, hashlib.sha256(own).hexdigest(), detect(own), kind, r.normalized, k, x.get("kind"), x.get("text"), x.get("rows"), x.get("sheet_name"), x.get("cells"), warning) for k, x in enumerate(made or [{}])]
                yield pd.DataFrame(out, columns=["path", "archive_sha256", "member", "member_order", "member_sha256", "original", "detected", "normalized", "source_order", "kind", "text", "rows", "sheet_name", "cells", "warning"])

    schema = BLOCKS.replace("path string, member string, member_sha256 string, detected string,", "path string, archive_sha256 string, member string, member_order int, member_sha256 string, original string, detected string, normalized string,")
    return found.select("path", "archive_sha256", "member", "member_order", "content", F.col("_own").alias("own"), F.to_json("normalized").alias("normalized")).mapInPandas(blocks, schema)
