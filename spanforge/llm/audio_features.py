"""Audio columns: polyphase resampling, overlapped log-mel filterbanks and energy segments by hysteresis.

Clips of a fixed number of frames become tensors of one fixed shape with the time span that they cover.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import map_batches

RATE = 16_000
WINDOW_MS, HOP_MS, FFT = 25, 10, 512
MELS, FRAMES = 40, 32
#: Decibels below the loudest frame at which a segment starts, and at which it ends.
ENTER_DB, LEAVE_DB = 20.0, 30.0
_BLOCK = 4096
_SCHEMA = "doc_id bigint, clip int, start_ms int, end_ms int, n_frames int, log_mel array<float>, segments array<struct<start_ms:int,end_ms:int>>"


def decode(payload: bytes, coding: str) -> np.ndarray:
    """Samples from -1 to 1 of 8-bit mu-law ("mulaw") or little-endian 16-bit ("pcm16") mono audio."""
    if coding == "mulaw":
        return _mulaw()[np.frombuffer(payload, np.uint8)]
    if coding == "pcm16":
        return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2").astype(np.float32) / np.float32(32768)
    raise ValueError(f"unknown coding: {coding}")


@lru_cache(maxsize=1)
def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = ((((code & 15).astype(np.int32) << 3) + 132) << ((code >> 4) & 7)) - 132
    return (np.where(code & 128, -size, size) / 32768).astype(np.float32)


@lru_cache(maxsize=8)
def resampling_filter(up: int, down: int, half: int = 12) -> np.ndarray:
    """Low-pass windowed sinc, of ``half`` zero crossings to either side, at ``up`` times the input rate."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    return (np.sinc(t / wide) * np.kaiser(len(t), 8.0) * up / wide).astype(np.float64)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Polyphase: of each output only the filter taps that meet an input sample are computed."""
    if rate == to or not len(x):
        return x
    g = gcd(rate, to)
    up, down = to // g, rate // g
    taps = resampling_filter(up, down)
    centre = len(taps) // 2
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for phase in range(min(up, n)):
        # output k stands at k * down on the fine grid; k = phase, phase + up, ... share their taps
        at = phase * down + centre
        branch = taps[at % up :: up]
        y = np.convolve(x, branch)
        k = np.arange(phase, n, up)
        index = (k * down + centre) // up
        inside = index < len(y)
        out[k] = np.where(inside, y[np.minimum(index, len(y) - 1)], 0)
    return out


@lru_cache(maxsize=4)
def mel_filters(mels: int, fft: int, rate: int) -> np.ndarray:
    """(fft // 2 + 1, mels) triangles, evenly spaced in mel from 0 to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - hz[None, :-2]) / (hz[1:-1] - hz[:-2])
    fall = (hz[None, 2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int = RATE, mels: int = MELS) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies and the frames' energy in decibels; a last partial frame is padded with zeros."""
    width, hop = rate * WINDOW_MS // 1000, rate * HOP_MS // 1000
    if not len(x):
        return np.zeros((0, mels), np.float32), np.zeros(0, np.float32)
    n = 1 + max(0, -(-(len(x) - width) // hop))
    padded = np.zeros((n - 1) * hop + width, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, width)[::hop]
    window, filters = np.hanning(width).astype(np.float32), mel_filters(mels, FFT, rate)
    out, energy = np.empty((n, mels), np.float32), np.empty(n, np.float32)
    for at in range(0, n, _BLOCK):
        part = frames[at : at + _BLOCK]
        spectrum = np.fft.rfft(part * window, FFT, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[at : at + _BLOCK] = np.log(power.astype(np.float32) @ filters + np.float32(1e-10))
        energy[at : at + _BLOCK] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / width + 1e-10)
    return out, energy


def segments(energy: np.ndarray, enter: float = ENTER_DB, leave: float = LEAVE_DB) -> list[tuple[int, int]]:
    """Runs of frames (start, end): one starts at a frame within ``enter`` dB of the loudest and lasts until one below ``leave``."""
    if not len(energy):
        return []
    top = energy.max()
    decided = np.where(energy >= top - enter, 1, np.where(energy < top - leave, 0, -1))
    at = np.maximum.accumulate(np.where(decided >= 0, np.arange(len(energy)), -1))
    on = np.where(at >= 0, decided[np.maximum(at, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def clips(payload: bytes, rate: int, coding: str, frames: int, mels: int) -> list[tuple]:
    """(clip, start_ms, end_ms, n_frames, tensor, segments) of one payload; the last tensor is padded with zeros."""
    values, energy = log_mel(resample(decode(payload, coding), rate, RATE), RATE, mels)
    runs, out = segments(energy), []
    for k in range(0, len(values), frames):
        part = values[k : k + frames]
        n = len(part)
        tensor = part if n == frames else np.vstack([part, np.zeros((frames - n, mels), np.float32)])
        inside = [(max(a, k) * HOP_MS, (min(b, k + n) - 1) * HOP_MS + WINDOW_MS) for a, b in runs if a < k + n and b > k]
        out.append((k // frames, k * HOP_MS, (k + n - 1) * HOP_MS + WINDOW_MS, n, tensor.ravel(), inside))
    return out


def audio_features(media: DataFrame, rate: int = 8_000, coding: str = "mulaw", frames: int = FRAMES, mels: int = MELS, rows: int = 200) -> DataFrame:
    """Clips of the ``audio`` payloads of (doc_id, audio binary).

    Gives (doc_id, clip, start_ms, end_ms, n_frames, log_mel, segments): ``log_mel`` always has frames * mels
    values, by frame and then by filter, its shape is in the column's metadata, and ``tensors`` makes it an
    Arrow tensor. Times are in the recording; a segment that goes over clips is cut at them.

    Null and empty payloads give no rows; a recording of any length gives all its clips. A frame at the very
    threshold is in a segment. Repeated rows and null ids are kept, other columns are ignored, and
    an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, columns, flat = [], [[] for _ in range(5)], []
        for doc_id, payload in zip(batch.column("doc_id").to_pylist(), batch.column("audio").to_pylist()):
            for clip, start, end, n, tensor, inside in clips(payload, rate, coding, frames, mels) if payload else ():
                ids.append(doc_id)
                flat.append(tensor)
                for column, value in zip(columns, (clip, start, end, n, [{"start_ms": a, "end_ms": b} for a, b in inside])):
                    column.append(value)
        values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.float32), pa.float32())
        tensor = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (frames * mels)), values)
        span = pa.list_(pa.struct([("start_ms", pa.int32()), ("end_ms", pa.int32())]))
        arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int32()) for c in columns[:4]), tensor, pa.array(columns[4], span)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "clip", "start_ms", "end_ms", "n_frames", "log_mel", "segments"])

    out = map_batches(media.select("doc_id", "audio"), run, _SCHEMA, rows)
    return out.withColumn("log_mel", F.col("log_mel").alias("log_mel", metadata={"tensor_shape": [frames, mels]}))


def tensors(table: pa.Table, column: str = "log_mel", shape: tuple[int, int] = (FRAMES, MELS)) -> pa.Table:
    """The Arrow table with the column as fixed-shape tensors, without a copy of the values."""
    at = table.schema.get_field_index(column)
    kind = pa.fixed_shape_tensor(pa.float32(), shape)
    chunks = []
    for x in table.column(column).chunks:
        # lists of one length without nulls: flatten() leaves out what a slice left out
        chunks.append(pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(x.flatten().cast(pa.float32()), shape[0] * shape[1])))
    return table.set_column(at, pa.field(column, kind), pa.chunked_array(chunks, kind))


def rendered_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, audio): the tables hold no recordings, so a text's UTF-8 bytes serve as 8-bit mu-law samples."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("audio"))
