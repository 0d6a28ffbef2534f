import hashlib
import zlib

import numpy as np

from motiflake.llm import media

from .data import ODD, documents, texts


def check(rows, found):
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((i or -1, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in found) == sorted(want)
    by = {}
    for r in found:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    check(texts(spark, sf), media.query(spark, sf).collect())


def test_odd_rows_and_empty_table(spark, tmp_path):
    check(ODD, media.query(spark, documents(spark, tmp_path / "odd")).collect())
    assert media.query(spark, documents(spark, tmp_path / "none", [])).collect() == []


def test_round_trip_is_exact():
    for text in ("", "a" * 64, "é" * 33, "x" * 10_000):
        raw = text.encode()
        assert media.load(media.store(text)) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_peaks_follow_a_tone_and_chunks_change_nothing():
    t = np.arange(40_000)
    wave = (128 + 100 * np.sin(2 * np.pi * t * 40 / media.FRAME)).astype(np.uint8).tobytes()
    assert set(media.peaks(wave)[:-2, 0]) == {40}
    times, codes = media.fingerprint(wave)
    assert len(times) == len(codes) and (np.diff(times) >= 0).all()
    whole, media.CHUNK = media.peaks(wave), 7
    try:
        assert (media.peaks(wave) == whole).all()
    finally:
        media.CHUNK = 2_048


def test_files_and_fingerprints_of_the_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in media.with_media(spark, docs).limit(20).collect():
        times, codes = media.fingerprint(media.load(bytes(r.media)))
        assert r.times == times.tolist() and r.codes == codes.tolist()


def plain_fingerprint(samples):
    """Times and codes by the sums that define a Fourier transform, and loops."""
    x = [b - 128 for b in samples]
    frames = max(1, -(-(len(x) - 512) // 256) + 1)
    n = np.arange(512)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / 511)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(257), n) / 512)
    tops = []
    for f in range(frames):
        part = np.array((x[256 * f : 256 * f + 512] + [0] * 512)[:512]) * window
        power = np.abs(basis @ part)
        peaks = [k for k in range(1, 256) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1e-3]
        tops.append(sorted(peaks, key=lambda k: -power[k])[:2])  # noqa: B023
    pairs = []
    for f in range(frames):
        for d in (1, 2):
            if f + d < frames:
                pairs += [(f * 256 * 1000 // 8000, (a * 65_536 + b * 16 + d) * 2 + rank) for rank, (a, b) in enumerate(zip(tops[f], tops[f + d], strict=False))]
    return sorted(pairs)


def test_fingerprints_are_those_of_plain_sums(spark):
    rows = [r[:2] for r in ODD if len(r[1] or "") < 1_000] + [(100 + i, t[:6_000]) for i, (_, t, *_) in enumerate(texts(spark)[:12])]
    rows.append((200, "".join(chr(40 + int(30 * (1 + np.sin(i / 3)) + 9 * (1 + np.sin(i * 1.3)))) for i in range(5_000))))
    found = media.with_media(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = {r.payload_sha256: list(zip(r.times, r.codes, strict=True)) for r in found}
    n = 0
    for _, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want = plain_fingerprint(payload)
        assert sorted(by_text[hashlib.sha256(payload).hexdigest()]) == want
        n += len(want)
    assert n > 300
