"""Media columns: bytes as WAV samples, spectra, and spectral-peak pair fingerprints.

A payload becomes a mono WAV of 8-bit samples, written and read by the wave module, so a reader gets the same
bytes back. Its short-time Fourier transform takes windows of WINDOW samples, HOP apart, less their mean and under
a Hann window; the last window is filled with the middle level. A window's peak is its strongest bin from LOWEST
up, the lower one of equals; levels are rounded before they are compared. Each peak is paired with the FAN next ones
into a code: its bin, the other's bin and the windows between, stored with the window's number as an array of
(at, code). A last peak, which has no next one, is stored as a code of its own bin and no windows between.

Defined results: a null text is an empty payload; payloads are filled with zero bytes to a positive multiple of
UNIT; equal texts give equal rows; a text of any length is worked on in slices of windows; an empty table gives
an empty result; other columns are not read, whatever their names.
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

from .common import small_batches, table, written

RATE, UNIT = 8000, 64
WINDOW, HOP, FAN, LOWEST = 256, 128, 2, 2
#: Windows that are transformed at once.
SLICE = 512
HANN = np.hanning(WINDOW).astype(np.float32)
MIDDLE = 128


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bin of each window."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    out = np.empty(n, np.int64)
    for a in range(0, n, SLICE):
        m = min(SLICE, n - a)
        own = x[a * HOP : (a + m - 1) * HOP + WINDOW].astype(np.float32) - MIDDLE
        full = np.zeros((m - 1) * HOP + WINDOW, np.float32)
        full[: len(own)] = own
        windows = np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::HOP]
        spectrum = np.fft.rfft((windows - windows.mean(axis=1, keepdims=True)) * HANN, axis=1)[:, LOWEST:]
        out[a : a + m] = np.rint(spectrum.real**2 + spectrum.imag**2).argmax(axis=1) + LOWEST
    return out


def pairs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, code) for each peak and each of the FAN next ones, in their order."""
    at, code = [np.array([len(bins) - 1])], [np.array([bins[-1] << 12])]
    for gap in range(1, FAN + 1):
        if len(bins) > gap:
            at.append(np.arange(len(bins) - gap))
            code.append((bins[:-gap] << 12) | (bins[gap:] << 2) | gap)
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order].astype(np.int32), code[order].astype(np.int32)


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    small_batches(documents.sparkSession)
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame, keep_media: bool = True) -> DataFrame:
    """What media_columns gives, all of it from the bytes of (doc_id, n_bytes, media)."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint", "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ats, codes, ends = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
            for m in b.column(2):
                media = m.as_py()
                back = from_wav(media)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
                at, code = pairs(peaks(back))
                ats.append(at)
                codes.append(code)
                ends.append(ends[-1] + len(at))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            found = pa.StructArray.from_arrays([pa.array(np.concatenate(ats)), pa.array(np.concatenate(codes))], ["at", "code"])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
            kept = b.column(2).cast(pa.binary()) if keep_media else pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), found, kept], names=["doc_id", "n_bytes", *names])

    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<struct<at: int, code: int>>, media binary")


def media_columns(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprint array, media)."""
    return described(encoded(documents, id_col, text_col), keep_media)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored, then read again: nothing below has seen the texts
    out = described(written(encoded(table(spark, sf_dir, "documents")), "media"), keep_media=False)
    feature = F.array_join(F.transform("fingerprint", lambda p: F.concat_ws(":", p["at"].cast("string"), p["code"].cast("string"))), " ")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
