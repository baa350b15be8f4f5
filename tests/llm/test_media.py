import hashlib
import zlib

import numpy as np
import pyarrow as pa

from lexmill.llm import common as C
from lexmill.llm import media as M


def features(docs):
    return M.read_tensors(M.features(M.media(docs), C.new_path(docs.sparkSession, "t")))


def test_resample_equals_direct_filter():
    x = np.random.default_rng(0).normal(size=1001).astype(np.float32)
    h = np.empty(M.TAPS * M.UP)
    h.reshape(M.TAPS, M.UP).T[:, ::-1] = M.PHASES
    up = np.zeros(len(x) * M.UP)
    up[:: M.UP] = x
    want = np.convolve(up, h)[: len(up)][:: M.DOWN]
    got = M.resample(x)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)


def test_segments_equal_a_state_machine():
    rng = np.random.default_rng(3)
    for _ in range(50):
        e = np.repeat(rng.normal(-30, 1.5, 30), rng.integers(1, 6, 30))
        m, want, start, high = np.median(e), [], None, False
        for k, x in enumerate([*(e - m), -99.0]):
            if x > M.LOW:
                start, high = (k if start is None else start), high or x > M.HIGH
            elif start is not None:
                if high and k - start >= M.LEAST:
                    want.append([start, k])
                start, high = None, False
        assert M.segments(e).tolist() == (want or [[0, len(e)]])
    assert len(M.segments(np.full(5, -90.0))) == 0


def test_rows(spark):
    texts = [(1, "hello world " * 50), (2, None), (3, ""), (None, "x" * 192), (4, "hello world " * 50), (5, "é" * 40_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = features(docs).collect()
    assert len(rows) == 6
    for r in rows:
        t = next(t for i, t in texts if i == r.doc_id)
        b = (t or "").encode()
        p = b + b" " * ((-len(b)) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes == 44 + len(p) and len(r.tensors) == 4 * len(r.starts) * M.SLICES * M.MELS
        assert all(a < b for a, b in zip(r.starts, r.ends, strict=True))
    one, four = (next(r for r in rows if r.doc_id == k) for k in (1, 4))
    assert one.tensors == four.tensors and one.starts == four.starts
    files = sorted({r.file for r in rows})
    t = pa.concat_tables([pa.ipc.open_file(f.removeprefix("file://")).read_all() for f in files])
    assert t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [M.SLICES, M.MELS]) and t.num_rows == sum(r.segments for r in rows)
    assert sorted(zip(*(t.column(c).to_pylist() for c in ("doc_id", "start_s", "end_s")), strict=True), key=repr) == sorted(((r.doc_id, a, b) for r in rows for a, b in zip(r.starts, r.ends, strict=True)), key=repr)
    assert features(docs.limit(0)).count() == 0


def test_log_mel_equals_plain_transform():
    y = np.random.default_rng(5).normal(size=700).astype(np.float32)
    mel, energy = M.log_mel(y)
    n = -(-(700 - M.FRAME) // M.HOP) + 1
    padded = np.concatenate([y, np.zeros((n - 1) * M.HOP + M.FRAME - 700)])
    assert mel.shape == (n, M.MELS)
    k = np.arange(M.FRAME)
    for i in range(n):
        f = padded[i * M.HOP : i * M.HOP + M.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * k / (M.FRAME - 1)))
        power = [abs(np.sum(f * np.exp(-2j * np.pi * b * k / M.FRAME))) ** 2 for b in range(M.FRAME // 2 + 1)]
        assert np.allclose(mel[i], np.log(np.array(power) @ M.MEL + 1e-6), atol=1e-3)
        assert abs(energy[i] - 10 * np.log10((f**2).mean() + 1e-9)) < 1e-3


def test_describe_averages_frames_of_each_segment():
    data = bytes(np.random.default_rng(6).integers(0, 256, 40_000, dtype=np.uint8)[: 192 * 200])
    starts, ends, tensors = M.describe(M.wav(data))
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = M.log_mel(M.resample(x - x.mean()))
    spans = M.segments(energy)
    t = tensors
    step = M.HOP * M.DOWN / (M.UP * M.RATE)
    assert len(starts) == len(ends) == len(spans)
    for s, (b, e), a, z in zip(t, spans.tolist(), starts, ends, strict=True):
        assert abs(a - b * step) < 1e-9 and abs(z - e * step) < 1e-9
        for j in range(M.SLICES):
            lo, hi = b + (e - b) * j // M.SLICES, b + (e - b) * (j + 1) // M.SLICES
            assert np.allclose(s[j], mel[lo : max(hi, lo + 1)].mean(axis=0), atol=2e-3)


def test_extra_columns_are_ignored(spark):
    d = spark.createDataFrame([(1, "abc", 5, b"x")], "doc_id long, text string, n_bytes int, media binary")
    r = features(d).collect()
    assert len(r) == 1 and r[0].n_bytes == 3 and r[0].payload_bytes == 192
