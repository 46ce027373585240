from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np

from weir.llm import media
from weir.llm.queries import op7_media_columns


def test_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_media_columns(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    features = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(padded)
        stored = out.getvalue()
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-32:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert features.setdefault(raw, r["feature"]) == r["feature"]
    assert len(set(features.values())) == len(features)


def test_wav_round_trip():
    for n in (0, 1, 576, 577):
        raw = bytes(range(256)) * 3
        assert media.read_wav(media.write_wav(media.pad(raw[:n]))) == media.pad(raw[:n])


def all_frames(samples):
    return media.peaks(samples, media.frame_starts(np.array([len(samples)]))[1])


def test_peaks_of_a_tone():
    t = np.arange(2880)
    tone = np.rint(128 + 60 * np.sin(2 * np.pi * 20 * t / media.FRAME) + 30 * np.sin(2 * np.pi * 50 * t / media.FRAME)).astype(np.uint8)
    found = all_frames(tone)
    assert (found[:, 0] == 20).all() and (found[:, 1] == 50).all()


def slow_feature(payload):
    """Peaks by numpy's own transform of each frame, and pairs by loops; windowed tables are rounded to 1/256 as in the operator."""
    t, f = np.arange(media.FRAME), np.arange(media.FRAME // 2 + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / media.FRAME)
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    tops = []
    for at in range(0, len(samples) - media.FRAME + 1, media.HOP):
        angle = 2 * np.pi * np.outer(f, t) / media.FRAME
        re, im = (np.rint(256 * window * trig(angle)).astype(np.int64) @ samples[at : at + media.FRAME] for trig in (np.cos, np.sin))
        power = re * re + im * im
        local = [k for k in range(1, len(f) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        tops.append(sorted(local, key=lambda k: (-power[k], k))[: media.PEAKS])
    codes = []
    for i, own in enumerate(tops):
        codes += sorted((i, a << 16 | b << 4 | d) for d in range(1, media.REACH + 1) if i + d < len(tops) for a in own for b in tops[i + d])
    return len(tops), codes


def test_fingerprints_against_a_slow_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in media.load(media.store(docs)).select("payload", "frames", "print_frames", "print_codes").collect():
        if len(r["payload"]) <= 1728:
            frames, codes = slow_feature(bytes(r["payload"]))
            assert r["frames"] == frames and list(zip(r["print_frames"], r["print_codes"], strict=True)) == codes


def wav(samples, width=1, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(samples)
    return out.getvalue()


def test_recordings_of_any_length_and_kind(spark):
    rng = np.random.default_rng(0)
    one = rng.integers(0, 256, 1000).astype(np.uint8)
    wide = (one.astype(np.int16) - 128 << 8).astype("<i2")
    files = [wav(one.tobytes()), wav(rng.bytes(1000)), wav(one.tobytes()), wav(b""), wav(one[:287].tobytes()), wav(one.tobytes()), wav(wide.tobytes(), 2), wav(np.repeat(wide, 2).tobytes(), 2, 2), b"no wave", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id long, media binary").coalesce(1)
    got = {r["id"]: r for r in media.load(df).collect()}
    alone = media.load(df.where("id = 0")).first()
    assert alone["frames"] == 5 and alone["print_codes"]
    for i in (2, 5, 6, 7):
        assert (got[i]["frames"], got[i]["print_frames"], got[i]["print_codes"]) == (5, alone["print_frames"], alone["print_codes"])
    assert bytes(got[6]["payload"]) == wide.tobytes()
    assert [got[i]["frames"] for i in (3, 4, 8, 9)] == [0, 0, None, None] and got[8]["payload"] is None


def test_pairs():
    found = np.array([[5, 0], [7, 9], [0, 0], [3, 0]])
    run, frame, code = media.pairs(found, np.array([0, 0, 0, 1]))
    assert list(zip(run, frame, code, strict=True)) == [(0, 0, 5 << 16 | 7 << 4 | 1), (0, 0, 5 << 16 | 9 << 4 | 1)]
    assert all(len(x) == 0 for x in media.pairs(np.zeros((0, 2), np.int32), np.zeros(0, np.int64)))


def test_odd_rows(odd_docs, no_docs, spark):
    rows = media.load(media.store(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert bytes(by[3]["payload"]) == b"\xff" * 576 and by[3]["n_bytes"] == 0
    assert bytes(by[6]["payload"]).rstrip(b"\xff") == b"word " * 60_000
    assert by[6]["frames"] == (len(by[6]["payload"]) - media.FRAME) // media.HOP + 1
    assert media.load(media.store(no_docs)).collect() == []
    null = spark.sql("SELECT 1L AS doc_id, CAST(NULL AS BINARY) AS media, 'x' AS payload")
    r = media.load(null).first()
    assert r["payload"] is None and r["print_codes"] is None and r["frames"] is None
