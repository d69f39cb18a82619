"""Media columns: bytes as 8-bit WAV files in a binary column, and spectral-peak fingerprints read from them.

`encode` stores a payload losslessly as unsigned 8-bit mono samples. `features` opens the stored bytes with the wave
module, takes a short-time Fourier transform (Hann window, half-overlapping frames), picks in each frame the strongest bin
of each band that also stands above its frequency neighbours and the frame's mean, and pairs each peak (anchor) with the
next `fan` peaks of later frames. The fingerprint is an array of (frame << 40 | anchor bin << 24 | other bin << 8 | gap).

Defined results: a null or empty text is a payload of 576 bytes 255; it has no peaks and an empty array. Equal texts give
equal values, however the rows are batched: every frame is transformed by itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import in_batches, release, text_rows

#: A payload's length is a positive multiple of this.
UNIT = 576
RATE = 8000
FRAME = 1024
HOP = 512
#: First bins of the bands; the last one ends the last band.
BANDS = (4, 16, 48, 120, 256, 512)
FAN = 3
MAX_GAP = 63
WINDOW = np.hanning(FRAME).astype(np.float32)
#: Frames that are transformed at once, so that a very long text takes bounded memory.
CHUNK = 512


def payload_of(data: bytes) -> bytes:
    """The bytes, then bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, by frame, then bin. The last frame is filled with silence."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    at, bins = [], []
    for lo in range(0, frames, CHUNK):
        n = min(CHUNK, frames - lo)
        part = np.full((n - 1) * HOP + FRAME, 255, np.uint8)
        own = x[lo * HOP : lo * HOP + len(part)]
        part[: len(own)] = own
        y = part.astype(np.float32)
        y -= 128
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * WINDOW, axis=1)).astype(np.float32)
        floor = power[:, BANDS[0] : BANDS[-1]].mean(axis=1) + 1e-3
        rows = np.arange(n)
        for low, high in zip(BANDS, BANDS[1:], strict=False):
            best = power[:, low:high].argmax(axis=1) + low
            top = power[rows, best]
            keep = (top > 1.5 * floor) & (top >= power[rows, best - 1]) & (top >= power[rows, best + 1])
            at.append(rows[keep] + lo)
            bins.append(best[keep])
    at, bins = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((bins, at))
    return at[order], bins[order]


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs of peaks as 64-bit numbers, by anchor."""
    at, bins = peaks(samples)
    codes, anchors = [], []
    # The first peak of a later frame, and those after it.
    later = np.searchsorted(at, at, side="right")
    for k in range(FAN):
        other = later + k
        ok = np.flatnonzero(other < len(at))
        o = other[ok]
        gap = at[o] - at[ok]
        near = gap <= MAX_GAP
        ok, o, gap = ok[near], o[near], gap[near]
        codes.append(at[ok].astype(np.int64) << 40 | bins[ok].astype(np.int64) << 24 | bins[o].astype(np.int64) << 8 | gap)
        anchors.append(ok * FAN + k)
    order = np.argsort(np.concatenate(anchors), kind="stable")
    return np.concatenate(codes)[order]


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.list_(pa.int64()))])


def _by_bytes(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of about 8 MB or 512 rows, as long rows hold a lot."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if held_bytes >= 8 << 20 or len(held) == 512:
            yield from in_batches(held, schema)
            held, held_bytes = [], 0
    yield from in_batches(held, schema)


def encode(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, and the WAV file that holds it; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        data = ((doc_id, (text or "").encode("utf-8", "surrogatepass")) for doc_id, text in text_rows(batches))
        yield from _by_bytes(((doc_id, len(b), to_wav(payload_of(b))) for doc_id, b in data), MEDIA, lambda r: len(r[2]))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests of each stored file and of the payload read back from it, and its fingerprint (array of long)."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, n, stored in given:
            payload = from_wav(stored)
            yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), fingerprint(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from _by_bytes(rows(text_rows(batches)), FEATURES, lambda r: r[7].nbytes)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature array<long>")
