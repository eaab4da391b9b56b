"""Media columns: a payload is stored as 8-bit PCM, read back and described by audio features.

The features of one file: polyphase resampling to half the rate, overlapped log-mel filterbanks, and segments of the frame
energy with hysteresis. Files are worked on in pieces of fixed length, so that memory doesn't grow with them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, DOWN = 8000, 2
TAPS = 32
FRAME, HOP, MELS = 256, 128, 24
#: The fixed shape of the stored tensor: time bins x mel bands.
BINS = 16
#: Relative to the mean frame energy in dB: a segment begins above ON and ends below OFF.
ON, OFF = 1.0, -1.0
PIECE = 1 << 18
_SPANS = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))


def wav(payload: bytes) -> bytes:
    """A mono file of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of such a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases of the low-pass filter, window, mel filters."""
    n = np.arange(TAPS) - (TAPS - 1) / 2
    low = np.sinc(n / DOWN) / DOWN * np.hamming(TAPS)
    low = (low / low.sum()).astype(np.float32)
    phases = np.stack([low[p::DOWN] for p in range(DOWN)])
    rate = RATE / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Half the rate: each phase of the filter meets every second sample. x has TAPS samples before its first output."""
    phases, _, _ = tables()
    n = (len(x) - TAPS) // DOWN + 1
    out = np.zeros(n, dtype=np.float32)
    for p in range(DOWN):
        part = x[p::DOWN]
        out += np.lib.stride_tricks.sliding_window_view(part, TAPS // DOWN)[:n] @ phases[p]
    return out


def log_mel(raw: bytes) -> np.ndarray:
    """Frames x mel bands, float32; at least one frame."""
    _, window, bank = tables()
    data, rest, frames = np.frombuffer(raw, dtype=np.uint8), np.zeros(0, dtype=np.float32), []
    edge = np.zeros(TAPS - DOWN, dtype=np.float32)
    for at in range(0, len(data), PIECE):
        x = np.concatenate([edge, (data[at : at + PIECE].astype(np.float32) - 128) / 128])
        edge = x[len(x) - (TAPS - DOWN) :]
        y = np.concatenate([rest, resample(x)])
        if at + PIECE >= len(data):
            # Zeros up to the next whole frame, so that every sample stands in one.
            y = np.concatenate([y, np.zeros(max(FRAME - len(y), (FRAME - len(y)) % HOP), dtype=np.float32)])
        n = max(0, (len(y) - FRAME) // HOP + 1)
        if n:
            cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[: (n - 1) * HOP + 1 : HOP]
            power = np.abs(np.fft.rfft(cut * window, axis=1)).astype(np.float32) ** 2
            frames.append(np.log(power @ bank + np.float32(1e-6)))
        rest = y[n * HOP :]
    return np.concatenate(frames)


def segments(mel: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds whose energy rose above ON and has not fallen below OFF since."""
    level = 10 * np.log10(np.exp(mel.astype(np.float64)).sum(axis=1))
    level -= level.mean()
    mark = np.where(level > ON, 1, np.where(level < OFF, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[np.maximum(last, 0)] == 1), [False]])
    turns = np.flatnonzero(on[1:] != on[:-1])
    step = HOP * DOWN / RATE
    return [(round(a * step, 3), round(b * step, 3)) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]


def pooled(mel: np.ndarray) -> np.ndarray:
    """The mean of the frames of each of BINS equal parts of the time."""
    at = np.arange(BINS) * len(mel) // BINS
    ends = np.maximum((np.arange(BINS) + 1) * len(mel) // BINS, at + 1)
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    return ((sums[ends] - sums[at]) / (ends - at)[:, None]).astype(np.float32)


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (BINS, MELS), dim_names=("time", "mel"))


def _pack(ids: pa.Array, flat: pa.Array, spans: pa.Array) -> bytes:
    """Rows as one Arrow stream, whose schema has the tensors' shape."""
    fixed = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(flat, BINS * MELS))
    rows = pa.RecordBatch.from_arrays([ids, fixed, spans], ["id", "tensor", "spans"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpack(block: bytes) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """ids, tensors as lists of floats and spans of a stored stream. One of another shape is an error."""
    for rows in pa.ipc.open_stream(block):
        if rows.schema.field("tensor").type != tensor_type():
            raise ValueError(f"not a tensor of {BINS} x {MELS}")
        yield rows.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BINS * MELS, pa.int32()), rows.column("tensor").storage.flatten()), rows.column("spans")


def feature(n_frames: int, cuts: list[dict], tensor: np.ndarray) -> str:
    """What is told of a text's sound: its frames, its segments with their seconds, and a digest of its tensor in eighths."""
    voiced = sum(x["stop"] - x["start"] for x in cuts)
    return f"frames={n_frames};segments={len(cuts)};voiced={voiced:.3f};mel={zlib.crc32(np.round(tensor * 8).astype('<i2').tobytes()):08x}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as 8-bit samples, and reads them back.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames long, tensor
    array<float> (BINS x MELS values of one Arrow fixed-shape tensor, row by row), spans array<struct<start, stop>> in seconds,
    feature string, and media binary if with_media. Tensors and spans go through the stored form of tensor_blocks() and come, as does the feature, from what is read back. Rows are independent; equal texts give equal values. A null text is empty: its
    payload is 64 zeros. Null ids and repeated rows pass through, an empty table gives an empty result, other columns are ignored.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "tensor", "spans", "feature", "media"]
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, tensor array<float>, spans array<struct<start: double, stop: double>>, feature string, media binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 256):
                b = whole.slice(k, 256)
                rows, tensors = [], []
                for raw in b.column("raw"):
                    raw = raw.as_py()
                    media = wav(raw + bytes(-len(raw) % 64 or 64 * (not raw)))
                    back = samples(media)
                    mel = log_mel(back)
                    tensors.append(pooled(mel))
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), [{"start": x, "stop": y} for x, y in segments(mel)], media if with_media else None))
                c = [list(x) for x in zip(*rows, strict=True)]
                ((_, listed, spans),) = _unpack(_pack(b.column("id"), pa.array(np.stack(tensors).ravel()), pa.array(c[7], _SPANS)))
                stored = listed.flatten().to_numpy().reshape(len(b), -1)
                said = [feature(n, cuts, tensor) for n, cuts, tensor in zip(c[6], spans.to_pylist(), stored, strict=True)]
                ints = lambda i: pa.array(c[i], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id"), ints(0), ints(1), pa.array(c[2]), ints(3), ints(4), pa.array(c[5]), ints(6), listed, spans, pa.array(said), pa.array(c[8], pa.binary())], names)

    out = source.mapInArrow(work, schema)
    return out.select(F.col("id").alias(id_col), *names[1:-1], *(["media"] if with_media else []))


def tensor_blocks(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of media_columns() as Arrow streams, to be stored in any format: n_rows long, block binary of up to 256 rows each.

    A stream has id, tensor (fixed_shape_tensor of BINS x MELS) and spans (list of start and stop in seconds), so that any Arrow reader finds
    the shape in its schema. An empty table gives no block; null ids and repeated rows are kept; other columns are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 256):
                b = whole.slice(k, 256)
                block = _pack(b.column("id"), b.column("tensor").flatten(), b.column("spans").cast(_SPANS))
                yield pa.RecordBatch.from_pydict({"n_rows": pa.array([len(b)], pa.int64()), "block": pa.array([block], pa.binary())})

    return media.select(F.col(id_col).alias("id"), "tensor", "spans").mapInArrow(work, "n_rows long, block binary")


def read_tensors(blocks: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """The rows of tensor_blocks() again: id_col, tensor array<float>, spans. A block of another shape is an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column("block"):
                for columns in _unpack(block.as_py()):
                    yield pa.RecordBatch.from_arrays(list(columns), ["id", "tensor", "spans"])

    out = blocks.select("block").mapInArrow(work, f"id {id_type}, tensor array<float>, spans array<struct<start: double, stop: double>>")
    return out.select(F.col("id").alias(id_col), "tensor", "spans")
