"""Files in the folder that all machines share: written whole or not at all, created once or not at all.

`put` and `get` are the driver's, over Spark's own file systems; `claim` and `deliver` are for tasks, over pyarrow's. A file is
written under another name first; it gets its own by a link (local folders) or a move (elsewhere, where a move onto a
file that is there fails), so whoever sees it sees all of it, and of two that write the same name one fails.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def local(path: str) -> Path | None:
    """The path on this machine's file system, if that is where it points."""
    u = urlparse(path)
    return Path(unquote(u.path) if u.scheme else path) if u.scheme in ("", "file") else None


def _link(path: Path, data: bytes, replace: bool = False) -> bool:
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    tmp.write_bytes(data)
    try:
        if replace:
            tmp.replace(path)
        else:
            os.link(tmp, path)
        return True
    except FileExistsError:
        return False
    finally:
        tmp.unlink(missing_ok=True)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def put(spark: SparkSession, path: str, data: bytes) -> bool:
    """Whether the file is new and now there; False if there was one."""
    if (at := local(path)) is not None:
        return _link(at, data)
    fs, p = _hadoop(spark, path)
    tmp = p.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(data))
    out.close()
    if fs.exists(p) or not fs.rename(tmp, p):
        fs.delete(tmp, False)
        return False
    return True


def get(spark: SparkSession, path: str) -> bytes | None:
    """The file's bytes (of a small file), None if there is none."""
    if (at := local(path)) is not None:
        return at.read_bytes() if at.exists() else None
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    if (at := local(folder)) is not None:
        return sorted(x.name for x in at.iterdir() if not x.name.startswith(".")) if at.is_dir() else []
    fs, p = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _arrow(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def claim(path: str, data: bytes = b"") -> bool:
    """From a task: creates the file if nobody has; whether it is ours."""
    if (at := local(path)) is not None:
        return _link(at, data)
    fs, at = _arrow(path)
    tmp = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    try:
        if is_there(path):
            raise FileExistsError
        fs.move(tmp, at)
        return True
    except OSError:  # somebody was faster
        fs.delete_file(tmp)
        return False


def deliver(path: str, data: bytes) -> None:
    """From a task: the file, whole; one that is there raises."""
    if not claim(path, data):
        raise FileExistsError(path)


def is_there(path: str) -> bool:
    if (at := local(path)) is not None:
        return at.exists()
    fs, at = _arrow(path)
    return fs.get_file_info(at).type.name == "File"


def read(path: str) -> bytes:
    """From a task: a small file's bytes."""
    if (at := local(path)) is not None:
        return at.read_bytes()
    fs, at = _arrow(path)
    with fs.open_input_stream(at) as f:
        return f.read()
