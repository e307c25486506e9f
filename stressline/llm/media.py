"""Media columns: text bytes as 8-bit WAV audio with spectral-peak fingerprints.

A text's UTF-8 bytes, padded with zeros to a positive multiple of ``unit``, are the
samples of a mono 8-bit WAV file written by the wave module. The file's bytes are
read back, and a short-time Fourier transform of the samples gives the strongest bin of
each band and frame. Pairs of such peaks, a few frames apart, are packed into
long integers of time code and hash: the fingerprint array.

The files are written as a table in the shared folder and read back from it; the features come from the stored bytes.
Each document is transformed alone, so equal texts give equal values whatever stands
beside them; of equal peaks in a band the lowest bin counts. Null is the empty text: one unit of zeros. Very long texts are
transformed in blocks of frames. Every row gives one row, repeated rows too; an empty table gives none. Other columns,
whatever their names, are not read.
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
from pyspark.sql import functions as F

from .bytehash import document_chunks
from .storage import Scratch

RATE = 8000
FRAME, HOP, REACH = 1024, 512, 3
#: Bands of rising width over the bins of a frame.
BANDS = (1, 9, 25, 57, 121, 249, FRAME // 2 + 1)
_WINDOW = np.hanning(FRAME)


def pad(raw: bytes, unit: int) -> bytes:
    return raw + b"\0" * (-len(raw) % unit if raw else unit)


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(payload: bytes, frames_at_once: int = 1024) -> np.ndarray:
    """Strongest bin (the lowest of equal ones) of each frame (rows) and band (columns), block by block of frames."""
    x = np.frombuffer(payload, np.uint8)
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    out = np.empty((n, len(BANDS) - 1), np.int64)
    for lo in range(0, n, frames_at_once):
        hi = min(n, lo + frames_at_once)
        part = x[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float64) - 128.0
        part = np.concatenate([part, np.zeros((hi - 1 - lo) * HOP + FRAME - len(part))])
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2
        for j, (a, b) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            out[lo:hi, j] = a + power[:, a:b].argmax(axis=1)
    return out


def fingerprint(peak: np.ndarray) -> np.ndarray:
    """time << 32 | first bin << 20 | second bin << 8 | frames between: neighbours in the frame, and the same
    and the next band up to REACH frames later; in rising order."""
    n, bands = peak.shape
    p = peak.astype(np.int64)
    t = np.arange(n, dtype=np.int64)[:, None] << 32
    out = [(t | p[:, :-1] << 20 | p[:, 1:] << 8).ravel()]
    for gap in range(1, min(REACH, n - 1) + 1):
        for shift in (0, 1):
            first, second = p[:-gap, : bands - shift], p[gap:, shift:]
            out.append((t[:-gap] | first << 20 | second << 8 | gap).ravel())
    return np.sort(np.concatenate(out))


def matches(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(time shift of b against a in frames, hashes that agree there): the best alignment of two fingerprints."""
    low = np.int64(0xFFFFFFFF)
    order = np.argsort(b & low, kind="stable")
    hb, tb = (b & low)[order], (b >> 32)[order]
    lo, hi = np.searchsorted(hb, a & low, "left"), np.searchsorted(hb, a & low, "right")
    n = hi - lo
    if not n.sum():
        return 0, 0
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    shift, count = np.unique(tb[at] - np.repeat(a >> 32, n), return_counts=True)
    return int(shift[count.argmax()]), int(count.max())


_STORED = "doc_id long, n_bytes long, media binary"
_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, fingerprint array<long>, media binary"


def _store(unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in document_chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                media = [write_wav(pad(data[a:b].tobytes(), unit)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def _features(with_media: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in document_chunks(batch.column("media")):
                part = batch.slice(lo, hi - lo)
                rows = []
                for doc, size, stored in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), part.column("media"), strict=True):
                    media = stored.as_py()
                    payload = read_wav(media)
                    peak = peaks(payload)
                    code = fingerprint(peak)
                    feature = f"frames={len(peak)};pairs={len(code)};sha256={hashlib.sha256(code.astype('<i8').tobytes()).hexdigest()}"
                    rows.append((doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(peak), code, media if with_media else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def store_media(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """doc_id, n_bytes and media: the table of WAV files, written in the shared folder."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scratch.save(texts.mapInArrow(_store(unit), _STORED), "media")


def media_features(stored: DataFrame, *, with_media: bool = True) -> DataFrame:
    """The digest columns and the fingerprint of each stored file, and with_media the file."""
    out = stored.mapInArrow(_features(with_media), _COLUMNS)
    return out if with_media else out.drop("media")


def media_columns(docs: DataFrame, *, with_media: bool = True, **options) -> DataFrame:
    """Texts stored as WAV files and read back: the digest columns, the fingerprint array and, with_media, the file."""
    return media_features(store_media(docs, Scratch(docs.sparkSession, "media"), **options), with_media=with_media)
