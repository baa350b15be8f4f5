"""Legacy ARC archives to WARC.

An ARC file is a sequence of records: a header line whose fields depend on the version that the file's own
first record (filedesc://) declares, then as many bytes as the line declares, then a newline. Version 1 has
URL, IP, date, content type, length; version 2 has URL, IP, date, content type, result code, checksum,
location, offset, file name, length. convert() reads both and writes the equivalent WARC/1.1 records:
identifiers are name-based UUIDs of what identifies the record, dates are rewritten, types follow from the
content (filedesc: warcinfo; HTTP: response, or revisit where another record holds the payload; the rest:
resource) and digests are computed over the payload. A response is stored as its bytes stand in the ARC.

pages(page_id, url, html) -> one ARC a task in memory -> one .warc.gz in the shared folder, a gzip member a
record. Records with equal payloads of at least 1000 bytes: the largest page_id is the response, the others
revisit it; equal page_ids among them are all responses. A null html is an empty payload, a null url is
urn:page:ID, a null page_id never is revisited unless all its group is null, and then all are responses.
Header lines never hold white space or line ends of a url: these are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import common as C

ARC_FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1000


def clean_url(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"


def arc_head(version: int, name: str, date: str = "20240101000000") -> bytes:
    body = f"{version} 0 lexmill\n{' '.join(f.capitalize() for f in ARC_FIELDS[version])}\n\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, offset: int, name: str, location: str = "-", date: str = "20240101000000") -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = {"url": url, "ip": "0.0.0.0", "date": date, "type": "text/html", "result": "200", "checksum": hashlib.sha1(payload).hexdigest(), "location": location, "offset": str(offset), "filename": name, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


#: Header lines by version. Addresses and types may hold blanks: what stands between them, and all after them, doesn't.
_IP = r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*|-)"
_LINE = {
    1: re.compile(rf"(?P<url>.+?) {_IP} (?P<date>\d{{4,14}}) (?P<type>.*) (?P<length>\d+)"),
    2: re.compile(rf"(?P<url>.+?) {_IP} (?P<date>\d{{4,14}}) (?P<type>.*) (?P<result>\S+) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\S+) (?P<filename>\S+) (?P<length>\d+)"),
}


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, content) of each record; the first is the file's own. Blank lines between records are skipped, bytes that aren't UTF-8
    in a header line are kept as they are. Fails on a line that is no header, on a length that overruns the file or a missing end."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without an end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "surrogateescape")
        if version is None:
            body = data[end + 1 : end + 1 + int(line.rsplit(" ", 1)[1])]
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
        m = _LINE[version].fullmatch(line)
        if not m:
            raise ValueError(f"no header line of an ARC of version {version}: {line[:200]!r}")
        fields = m.groupdict() | {"version": version}
        n = int(fields["length"])
        if end + 1 + n > len(data) or data[end + 1 + n : end + 2 + n] not in (b"\n", b"\r", b""):
            raise ValueError(f"a declared length of {n} doesn't fit: {line[:200]!r}")
        yield fields, data[end + 1 : end + 1 + n]
        at = end + 1 + n


def iso_date(d: str) -> str:
    """14 digits, or fewer filled up from the first of January, to WARC's date."""
    if not re.fullmatch(r"\d{4,14}", d):
        raise ValueError(f"date {d}")
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*what: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, what)).encode("utf-8", "surrogateescape"))}>"


def b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogateescape") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def convert(arc: bytes, original: dict[tuple[str, str], tuple[str, str]] | None = None) -> Iterator[bytes]:
    """WARC records of an ARC file's records. original: by location and payload's SHA-1 (hex), (location, url) of the record whose payload it repeats."""
    for f, content in parse_arc(arc):
        url, date, where = f["url"], iso_date(f["date"]), f.get("location", "-")
        if url.startswith("filedesc://"):
            yield warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(url, date)), ("WARC-Date", date), ("WARC-Filename", url[11:]), ("Content-Type", "application/warc-fields")], b"software: lexmill\r\nformat: WARC File Format 1.1\r\ndescription: from ARC version %d\r\n" % f["version"])
            continue
        http = content.startswith(b"HTTP/")
        cut = content.find(b"\r\n\r\n") + 4 if http else 0
        if http and cut < 4:
            cut = len(content)
        payload = content[cut:]
        digest = hashlib.sha1(payload).digest()
        to = (original or {}).get((where, digest.hex())) if http else None
        kind = ("revisit" if to else "response") if http else "resource"
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(url, date, where, digest.hex())), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", f["ip"]), ("WARC-Payload-Digest", b32(digest)), ("WARC-Block-Digest", b32(hashlib.sha1(content[:cut] if to else content).digest())), ("X-Source-Location", where), ("X-Payload-Length", str(len(payload)))]
        if to:
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(to[1], date, to[0], digest.hex())), ("WARC-Refers-To-Target-URI", to[1]), ("X-Refers-To-Location", to[0])]
        headers.append(("Content-Type", "application/http; msgtype=response" if http else f["type"]))
        yield warc_record(headers, content[:cut] if to else content)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of uncompressed WARC bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:100]}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        n = int(headers["content-length"])
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a declared length doesn't fit")
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 8 + n


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed members of a gzip file, one at a time."""
    d, out = zlib.decompressobj(31), []
    while chunk := stream.read(size):
        while chunk:
            out.append(d.decompress(chunk))
            chunk = d.unused_data
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the last gzip member is cut off")


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# on tables --------------------------------------------------------------------


def with_originals(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds refers_to and refers_url: the page of the same payload that holds it, null for that page and where no other has it.

    Only digests, lengths and ids are grouped (summed up before the shuffle); pages learn by C.spread_lookup(), so a payload
    of very many pages stays where its pages are. Small payloads meet nothing.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html")).withColumn("key", F.when(F.col("n") >= least, F.concat_ws(":", F.sha1("html"), "n")))
    large, small = p.where("key is not null"), p.where("key is null")
    groups = large.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("rows_of_key")).where("rows_of_key > 1 and o.page_id is not null")
    known = C.spread_lookup(large, "key", groups.select("key", "rows_of_key", F.col("o.page_id").alias("o_id"), F.col("o.url").alias("o_url")), pages.count())
    own = F.col("page_id").eqNullSafe(F.col("o_id"))
    found = known.select("page_id", "url", "html", F.when(~own, F.col("o_id")).alias("refers_to"), F.when(~own, F.col("o_url")).alias("refers_url"))
    return found.union(small.select("page_id", "url", "html", F.lit(None).cast("long"), F.lit(None).cast("string")))


def write_archives(pages: DataFrame, root: str, version: int = 2, nbytes: int = 4 << 20) -> DataFrame:
    """with_originals()'s rows to .warc.gz files under root, by way of ARC, about nbytes of pages at a time; returns the manifest: path, n_records."""
    fs, at = C.filesystem(root)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}"
        fs, at = C.filesystem(f"{root}/{name}.warc.gz")
        tmp, n = f"{at}.{uuid.uuid4().hex}.tmp", 0
        out = None
        for b in C.slices(batches, nbytes):
            rows, arc, original = b.to_pylist(), io.BytesIO(), {}
            arc.write(arc_head(version, f"{name}.arc"))
            for r in rows:
                where = f"page:{r['page_id']}"
                payload = r["html"].encode("utf-8", "surrogatepass")
                arc.write(arc_record(version, clean_url(r["url"], r["page_id"]), payload, arc.tell(), f"{name}.arc", where))
                if r["refers_to"] is not None:
                    original[where, hashlib.sha1(payload).hexdigest()] = (f"page:{r['refers_to']}", clean_url(r["refers_url"], r["refers_to"]))
            out = out or fs.open_output_stream(tmp, compression=None)
            for x in convert(arc.getvalue(), original):
                out.write(gz(x))
            n += len(rows)
        if out:
            out.close()
            fs.move(tmp, at)
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}.warc.gz"], "n_records": pa.array([n], pa.int64())})

    return C.materialize(pages.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, files: int) -> DataFrame:
    """Records of the archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits). Digests of stored payloads are checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def page(where: str | None) -> int | None:
            return None if where in (None, "page:None") else int(where[5:])

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = C.filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for m in members(f):
                        for h, block in parse_warc(m):
                            if h["warc-type"] not in ("response", "revisit"):
                                continue
                            digest = base64.b32decode(h["warc-payload-digest"][5:]).hex()
                            body = None
                            if h["warc-type"] == "response":
                                body = block[block.index(b"\r\n\r\n") + 4 :]
                                if hashlib.sha1(body).hexdigest() != digest:
                                    raise ValueError(f"{path}: {h['warc-record-id']} has another payload than its digest says")
                            rows.append((page(h["x-source-location"]), h["warc-target-uri"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), h["warc-type"], len(body) if body is not None else int(h["x-payload-length"]), digest, page(h.get("x-refers-to-location")), body))
                            held += 1000 + len(body or b"")
                            if held > 4 << 20:
                                yield flush(rows)
                                rows, held = [], 0
                if rows:
                    yield flush(rows)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all pages written as WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(with_originals(pages), C.new_path(spark, "warc"))
    return read_archives(manifest, manifest.count()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS o FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN o IS NULL OR o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to
FROM m
"""
