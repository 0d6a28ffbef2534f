"""Media columns: texts stored as 8-bit WAV files, read back by the wave module, and their spectral fingerprints.

The payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64. A fingerprint is made of the
stored samples: short-time Fourier transforms, the strongest spectral peaks of every frame, and pairs of peaks a few
frames apart, each a code of (first bin, second bin, distance) at the first frame's time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, share_code

PAD, RATE = 64, 8_000
FRAME, HOP = 512, 256
#: Peaks of a frame, and how many frames after it each of them is paired with the peaks of the same rank.
PEAKS, AHEAD = 2, (1, 2)
#: Frames transformed at once.
CHUNK = 2_048
#: Rows whose media leave a task together hold about this many bytes.
BATCH_BYTES = 8 << 20


def store(text: str | None) -> bytes:
    """The WAV file of a text: one channel, 8 bits, RATE samples a second."""
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % PAD or (0 if raw else PAD))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """frames x PEAKS: bins of the strongest local maxima of each frame's spectrum, 0 where there are fewer."""
    x = np.frombuffer(samples, dtype=np.uint8)
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    window, out = np.hanning(FRAME).astype(np.float32), np.zeros((frames, PEAKS), np.int64)
    for at in range(0, frames, CHUNK):
        n = min(CHUNK, frames - at)
        part = x[at * HOP : at * HOP + (n - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        view = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(view * window, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        for k in range(PEAKS):
            top = inner.argmax(axis=1)
            found = inner[np.arange(n), top]
            out[at : at + n, k] = np.where(found > 1e-3, top + 1, 0)
            inner[np.arange(n), top] = 0
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (ms) and codes of all peak pairs, by time, distance and rank."""
    p = peaks(samples)
    times, codes = [], []
    for d in AHEAD:
        a, b = p[:-d], p[d:]
        frame, rank = np.nonzero((a > 0) & (b > 0))
        times.append(frame)
        codes.append(((a[frame, rank] << 16) | (b[frame, rank] << 4) | d) * PEAKS + rank)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order] * HOP * 1000 // RATE, c[order]


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, times array<int>, codes array<long>"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "times", "codes"])

    rows, held = [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            text = t.as_py()
            media = store(text)
            back = load(media)
            times, codes = fingerprint(back)
            rows.append((i.as_py(), len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), media, times, codes))
            held += 2 * len(media)
            if held >= BATCH_BYTES or len(rows) >= 2_000:
                yield batch(rows)
                rows, held = [], 0
    if rows:
        yield batch(rows)


def with_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, text): n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the last 64
    bytes) of the payload as read back, the file itself (media), and its fingerprint: times (ms) and codes, in step.

    A null text is empty; an empty one is 64 zero bytes. Equal texts give equal values, rows that repeat one row each. A text
    of any length is stored and transformed whole, CHUNK frames at a time; an empty table gives none. Other columns are left
    out."""
    share_code(spark)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: digests of every document's stored form and fingerprint."""
    pairs = F.array_join(F.zip_with("times", "codes", lambda t, c: F.concat_ws(":", t, c)), ",")
    feature = F.concat_ws("-", F.size("codes"), F.sha2(pairs.cast("binary"), 256))
    return with_media(spark, read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature")
    )
