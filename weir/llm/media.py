"""Media columns: bytes as 8-bit WAV files, and spectral-peak fingerprints.

``store`` writes payloads as WAV files through the wave module; ``load`` reads
them back and fingerprints the samples: a short-time Fourier transform (frames of
288 samples every 144, Hann window), the strongest local maxima of each frame,
and pairs of them at most two frames apart. A fingerprint is kept as two arrays,
the frame number of each pair and its code (both frequencies and the distance).

The transform is a matrix product with a table of whole numbers, whose sums are
all exact. Equal samples therefore give equal fingerprints, whatever stands
beside them in a batch.
"""

from __future__ import annotations

import io
import wave
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, small_slices, text_bytes

UNIT, RATE = 576, 8000
FRAME, HOP, PEAKS, REACH = 288, 144, 2, 2
FRAMES_AT_ONCE = 4096


def write_wav(payload: bytes) -> bytes:
    """A mono WAV file of one byte a sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The stored bytes of a WAV file."""
    return read_samples(media)[0]


def read_samples(media: bytes) -> tuple[bytes, np.ndarray]:
    """(stored bytes, samples of 8 bits) of a WAV file.

    Of wider samples the highest byte is taken, and of several channels the mean.
    """
    with wave.open(io.BytesIO(media), "rb") as w:
        payload, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
    top = np.frombuffer(payload, np.uint8)[width - 1 :: width]
    if width > 1:
        top = top ^ 128  # wider samples are signed
    if channels > 1:
        top = (top[: len(top) // channels * channels].reshape(-1, channels).sum(1, dtype=np.int64) // channels).astype(np.uint8)
    return payload, top


def pad(payload: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of the unit."""
    return payload + b"\xff" * (max(1, -(-len(payload) // UNIT)) * UNIT - len(payload))


@cache
def _table() -> np.ndarray:
    """Windowed cosines and sines of all frequencies, in steps of 1/256: sums of 288 products with bytes stay under 2**24."""
    t, f = np.arange(FRAME)[:, None], np.arange(FRAME // 2 + 1)[None, :]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / FRAME)
    angle = 2 * np.pi * t * f / FRAME
    return np.rint(256 * window * np.concatenate([np.cos(angle), np.sin(angle)], axis=1)).astype(np.float32)


def frame_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(recording, first sample) of all frames of recordings that stand one behind another, each with its own grid."""
    count = np.maximum((sizes - FRAME) // HOP + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, (np.cumsum(sizes) - sizes)[owner] + number * HOP


def peaks(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every frame its strongest local maxima, as frequency numbers; 0 where there are fewer."""
    out = np.zeros((len(starts), PEAKS), np.int32)
    if not len(starts):
        return out
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)
    for k in range(0, len(starts), FRAMES_AT_ONCE):
        both = (frames[starts[k : k + FRAMES_AT_ONCE]].astype(np.float32) - 128) @ _table()
        n = FRAME // 2 + 1
        power = both[:, :n].astype(np.float64) ** 2 + both[:, n:].astype(np.float64) ** 2
        middle = power[:, 1:-1]
        top = np.where((middle > power[:, :-2]) & (middle >= power[:, 2:]), middle, 0)
        for p in range(PEAKS):
            at = top.argmax(1)
            rows = np.arange(len(top))
            out[k : k + FRAMES_AT_ONCE, p] = np.where(top[rows, at] > 0, at + 1, 0)
            top[rows, at] = 0
    return out


def pairs(found: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, frame within its run, code) of all pairs; ``run`` numbers the recording of each frame."""
    first = np.searchsorted(run, run)
    parts = []
    for d in range(1, REACH + 1):
        same = np.flatnonzero(run[d:] == run[:-d]) if len(run) > d else np.zeros(0, np.int64)
        for a in range(PEAKS):
            for b in range(PEAKS):
                at = same[(found[same, a] > 0) & (found[same + d, b] > 0)]
                parts.append((run[at], at - first[at], found[at, a] << 16 | found[at + d, b] << 4 | d))
    run, frame, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((code, frame, run))
    return run[order], frame[order], code[order]


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, media``: every text's bytes, padded, as a WAV file.

    Null texts count as empty and give one unit of bytes 255. Repeated rows are
    given back as often as they come, null ids are kept, empty tables give empty
    results, other columns are ignored. One text has to fit in memory.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Batches) -> Batches:
        for batch in small_slices(batches, "text", 1_000_000):
            raw, off = text_bytes(batch.column(1))
            raw = raw.tobytes()
            files = [write_wav(pad(raw[s:e])) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(files, pa.binary())], names=["id", "n", "media"])

    return arrow_map(texts, run, f"id {dict(texts.dtypes)['id']}, n long, media binary").select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), "media")


def _read(media: bytes | None) -> tuple[bytes | None, np.ndarray]:
    try:
        return read_samples(media) if media is not None else (None, np.zeros(0, np.uint8))
    except (wave.Error, EOFError):
        return None, np.zeros(0, np.uint8)


def load(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """The columns of ``stored`` and ``payload, frames, print_frames, print_codes``, from the files.

    A recording's frames begin with its own first sample, whatever stands beside it
    in a batch. Null media and such as are no WAV file of plain samples give nulls. Columns of these
    four names are replaced.
    """
    new = {"payload": "binary", "frames": "int", "print_frames": "array<int>", "print_codes": "array<int>"}
    kept = [c for c in stored.columns if c not in new]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            at, begin = kept.index(media_col), 0
            sizes = np.cumsum([len(x) for x in (m.as_buffer() or b"" for m in batch.column(at))])
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + 1_000_000, side="right")))
                part = batch.slice(begin, end - begin)
                begin = end
                media = part.column(at).to_pylist()
                read = [_read(m) for m in media]
                payloads = [p for p, _ in read]
                samples = np.concatenate([np.zeros(0, np.uint8), *(x for _, x in read)])
                owner, starts = frame_starts(np.array([len(x) for _, x in read], np.int64))
                run_of, frame, code = pairs(peaks(samples, starts), owner)
                cut = pa.array(np.searchsorted(run_of, np.arange(len(media) + 1)).astype(np.int32))
                null = np.array([p is None for p in payloads])
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32)), mask=pa.array(null)) for x in (frame, code)]
                count = pa.array(np.bincount(owner, minlength=len(media)).astype(np.int32), mask=null)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), count, *lists], names=[*kept, *new])

    schema = stored.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema
    return arrow_map(stored.select(*kept), run, schema)
