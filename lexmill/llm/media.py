"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

media(df) stores a payload losslessly as the 8-bit samples of a WAV file in a binary column; features(df, root)
reads the stored bytes back. For each segment it has a time span in seconds and a tensor of the
fixed shape (SLICES, MELS), the segment's log-mel frames averaged over SLICES equal parts. Spans and tensors are written to Arrow
files under root, a row a segment, the tensor in Arrow's fixed-shape type; a payload's row names its file, record batch, first row and
number of segments, by which read_tensors() finds them. Every step is a function of the bytes alone. The thresholds of segments are parameters; their
defaults suit payloads whose energy varies by tenths of a dB, as that of text bytes does.

A null payload is the empty text. Silence has no segment: empty spans and tensors. Long payloads are
resampled in blocks, so memory beyond the payload itself is bounded. Other columns stay out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import common as C

RATE, UP, DOWN, TAPS = 8000, 3, 4, 12
FRAME, HOP, MELS, SLICES = 256, 96, 24, 8
#: Segments begin above HIGH dB over the median frame, last while above LOW, and shorter ones than LEAST frames don't count.
HIGH, LOW, LEAST = 0.4, -0.6, 3
BLOCK = 1 << 18


def payload(text: str | None, unit: int = 192) -> bytes:
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b" " * (-len(b) % unit or (unit if not b else 0))


def wav(data: bytes, rate: int = RATE) -> bytes:
    """Mono, unsigned 8 bit."""
    return b"RIFF" + struct.pack("<I", 36 + len(data) + len(data) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def samples(stored: bytes) -> tuple[int, bytes]:
    """(rate, samples) of such a file; walks its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(stored):
        kind, n = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit samples")
        elif kind == b"data":
            return rate, stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _phases() -> np.ndarray:
    """The low-pass filter (windowed sinc) by phases: row p has the taps that make outputs p modulo UP."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(TAPS * UP) * UP / max(UP, DOWN)
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1].astype(np.float32))


PHASES = _phases()


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate: output m is phase m * DOWN % UP applied to the TAPS samples that end at m * DOWN // UP."""
    total = (len(x) * UP + DOWN - 1) // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x])
    view, out = sliding_window_view(padded, TAPS), np.empty(total, np.float32)
    for p in range(UP):
        m = np.arange(p, total, UP)
        phase = p * DOWN % UP
        rows = view[p * DOWN // UP :: DOWN][: len(m)]
        for at in range(0, len(m), BLOCK):
            out[m[at : at + BLOCK]] = rows[at : at + BLOCK] @ PHASES[phase]
    return out


def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    to = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to(60), to(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up, down = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


MEL, HANN = _mel(), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS, energy in dB of each frame); the last frame is filled up with zeros."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    frames = sliding_window_view(y, FRAME)[::HOP][:n]
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, 2048):
        f = frames[at : at + 2048] * HANN
        s = np.fft.rfft(f, axis=1)
        power = (s.real**2 + s.imag**2).astype(np.float32)
        mel[at : at + 2048] = np.log(power @ MEL + 1e-6)
        energy[at : at + 2048] = 10 * np.log10((f * f).mean(axis=1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> np.ndarray:
    """[(first frame, frame after the last)]: runs above low that rise above high somewhere, of at least LEAST frames; a sound without any is one segment."""
    if energy.max() <= -80:
        return np.zeros((0, 2), np.int64)
    e = energy - np.median(energy)
    on = np.r_[0, (e > low).astype(np.int8), 0]
    begin, end = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
    peaks = np.r_[0, np.cumsum(e > high)]
    keep = (end - begin >= LEAST) & (peaks[end] > peaks[begin])
    if not keep.any():
        return np.array([[0, len(energy)]])
    return np.stack([begin[keep], end[keep]], 1)


def describe(stored: bytes, high: float = HIGH, low: float = LOW) -> tuple[list[float], list[float], np.ndarray]:
    """(starts, ends, tensors) of the segments in a stored file; tensors: float32, segments x SLICES x MELS."""
    rate, data = samples(stored)
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x - x.mean()))
    spans = segments(energy, high, low)
    if not len(spans):
        return [], [], np.zeros((0, SLICES, MELS), np.float32)
    b, e = spans[:, 0], spans[:, 1]
    cuts = (b[:, None] + (e - b)[:, None] * np.arange(SLICES + 1) // SLICES).astype(np.int64)
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    lo, hi = cuts[:, :-1], np.maximum(cuts[:, 1:], cuts[:, :-1] + 1)
    tensor = (sums[hi] - sums[lo]) / (hi - lo)[:, :, None]
    step = HOP * DOWN / (UP * rate)
    return (b * step).tolist(), (e * step).tolist(), np.round(tensor, 3).astype(np.float32)


#: A row a segment, as it is written.
SEGMENTS = pa.schema([("doc_id", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", pa.fixed_shape_tensor(pa.float32(), [SLICES, MELS]))])


def segment_batch(rows: list[tuple[int | None, list[float], list[float], np.ndarray]]) -> pa.RecordBatch:
    """(doc_id, starts, ends, tensors) of payloads as a record batch of SEGMENTS."""
    n = [len(r[1]) for r in rows]
    data = np.concatenate([r[3].ravel() for r in rows]) if rows else np.zeros(0, np.float32)
    tensor = pa.FixedShapeTensorArray.from_storage(SEGMENTS.field("tensor").type, pa.FixedSizeListArray.from_arrays(pa.array(data, pa.float32()), SLICES * MELS))
    ids = [r[0] for r, k in zip(rows, n, strict=True) for _ in range(k)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for r in rows for x in r[1]], pa.float64()), pa.array([x for r in rows for x in r[2]], pa.float64()), tensor], schema=SEGMENTS)


def media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media (the WAV file)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, 4 << 20):
            texts = b.column(1).to_pylist()
            n = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([wav(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, file string, batch int, first int, segments int"


def features(stored: DataFrame, root: str, high: float = HIGH, low: float = LOW) -> DataFrame:
    """media()'s rows -> doc_id, n_bytes and what is read back from media: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256; file, batch, first, segments: where its spans and tensors are.

    A task writes a file under root under another name and moves it there when it is whole; a lost attempt leaves none under its name, and another one writes the same. The rows are written, as who asks twice must not write twice.
    """
    fs, at = C.filesystem(root)
    fs.create_dir(at, recursive=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = f"{root}/{TaskContext.get().partitionId():06d}.arrow"
        fs, at = C.filesystem(path)
        tmp, sink, writer, k = f"{at}.{uuid.uuid4().hex}.tmp", None, None, 0
        names = [f.split()[0] for f in _READ.split(", ")]
        for b in C.slices(batches, 4 << 20):
            rows, made, first = [], [], 0
            for i, n, m in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                data = samples(m)[1]
                made.append((i, *describe(m, high, low)))
                rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), path, k, first, len(made[-1][1])))
                first += len(made[-1][1])
            if writer is None:
                sink = fs.open_output_stream(tmp, compression=None)
                writer = pa.ipc.new_file(sink, SEGMENTS, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(segment_batch(made))
            k += 1
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), _READ.split(", "), strict=True)], names)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(tmp, at)

    return C.materialize(stored.select("doc_id", "n_bytes", "media").mapInArrow(read, _READ), "media-features")


def read_tensors(rows: DataFrame) -> DataFrame:
    """features()'s rows with spans and tensors read back from their files: starts, ends (seconds) and tensors (float32, segments x SLICES x MELS, little-endian bytes)."""
    names = [f.name for f in rows.schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file, source, batch = (None, None), None, None, None
        for b in batches:
            out = ([], [], [])
            for path, k, first, n in zip(*(b.column(c).to_pylist() for c in ("file", "batch", "first", "segments")), strict=True):
                if path != held[0]:
                    if source is not None:
                        source.close()
                    fs, at = C.filesystem(path)
                    source = fs.open_input_file(at)
                    file = pa.ipc.open_file(source)
                    if file.schema.field("tensor").type.shape != [SLICES, MELS]:
                        raise ValueError(f"{path} has tensors of another shape")
                if (path, k) != held:
                    held, batch = (path, k), file.get_batch(k)
                t = batch.slice(first, n)
                out[0].append(t.column("start_s").to_pylist())
                out[1].append(t.column("end_s").to_pylist())
                out[2].append(t.column("tensor").to_numpy_ndarray().astype("<f4").tobytes() if n else b"")
            kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*names, "starts", "ends", "tensors"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", starts array<double>, ends array<double>, tensors binary"
    return rows.mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: stores all documents, reads them back, stores spans and tensors, reads those back; feature: segments, their total time and a digest of spans and tensors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = C.materialize(media(docs), "media")
    rows = features(stored, C.new_path(spark, "media-tensors"))
    C.drop(stored)
    out = read_tensors(rows)
    total = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0.0), lambda a, x: a + x["ends"] - x["starts"])
    digest = F.sha2(F.concat(F.coalesce(F.array_join("starts", ","), F.lit("")).cast("binary"), F.lit("|").cast("binary"), F.col("tensors")), 256)
    feature = F.concat_ws("|", F.size("starts").cast("string"), F.format_number(total, 3), digest)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
