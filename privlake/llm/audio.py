"""Audio columns: bytes stored as 8-bit WAV, and log-mel features with energy segments read back from them."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type

from . import tokens as tk

#: Bytes before the samples of a stored file.
HEADER = 44
#: Frames that are transformed at once; bounds memory for long recordings.
BLOCK = 4096


@dataclass(frozen=True)
class Settings:
    """Rates in Hz, lengths in samples of the resampled signal, thresholds in dB over the median frame."""

    stored_rate: int = 16000
    rate: int = 8000
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 40
    chunk: int = 16
    high_db: float = 2.0
    low_db: float = 0.5
    pad: int = 64


def write_wav(samples: bytes, rate: int) -> bytes:
    """Unsigned 8-bit mono PCM; `samples` has an even length."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def read_wav(media: bytes) -> tuple[np.ndarray, int]:
    """Samples as stored, and their rate."""
    rate, size = struct.unpack_from("<I", media, 24)[0], struct.unpack_from("<I", media, 40)[0]
    return np.frombuffer(media, dtype=np.uint8, count=size, offset=HEADER), rate


@cache
def _filter(up: int, down: int) -> np.ndarray:
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    return np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1] * up / max(up, down)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """`x` at up / down times its rate: each output phase has its own taps, which are applied at the low rate only."""
    h = _filter(up, down)
    half, count = len(h) // 2, -(-len(x) * up // down)
    y = np.zeros(-(-count // up) * up)
    rows = len(y) // up
    for p in range(up):
        taps, shift = h[(p * down + half) % up :: up], (p * down + half) // up
        for q in range(min(down, len(taps))):
            own = taps[q::down]
            first = shift - q - (len(own) - 1) * down
            at = np.arange(first, first + (rows + len(own) - 1) * down, down)
            part = np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, len(x) - 1)], 0.0)
            y[p::up] += np.convolve(part, own, "valid")
    return y[:count]


@cache
def _mel(s: Settings) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a transform."""
    top = 2595 * np.log10(1 + s.rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, s.mels + 2) / 2595) - 1)
    bins = np.arange(s.fft // 2 + 1) * s.rate / s.fft
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).T


def log_mel(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies of overlapping frames, and the frames' energies in dB. A signal shorter than a frame is padded to one."""
    frames = max(1, 1 + (len(x) - s.frame) // s.hop)
    x = np.concatenate([x, np.zeros(max(0, s.frame - len(x)))])
    windows = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop][:frames]
    out, energy = np.empty((frames, s.mels), np.float32), np.empty(frames)
    for a in range(0, frames, BLOCK):
        part = windows[a : a + BLOCK] * np.hanning(s.frame)
        power = np.abs(np.fft.rfft(part, s.fft)) ** 2
        out[a : a + BLOCK] = np.round(np.log(power @ _mel(s) + 1e-6), 3)
        energy[a : a + BLOCK] = 10 * np.log10(np.mean(part * part, axis=1) + 1e-9)
    return out, energy


def segments(energy: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Runs of frames over the low threshold that reach the high one: (first, after the last)."""
    middle = np.median(energy)
    over = np.concatenate([[False], energy > middle + s.low_db, [False]])
    edges = np.flatnonzero(np.diff(over.astype(np.int8)))
    high = np.concatenate([[0], np.cumsum(energy > middle + s.high_db)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if high[b] > high[a]]


def _tensors(mel: np.ndarray, s: Settings) -> bytes:
    """An Arrow stream of chunks: start and end in seconds, and a fixed-shape tensor of chunk x mels; the last is padded by the floor."""
    chunks = -(-len(mel) // s.chunk)
    full = np.full((chunks * s.chunk, s.mels), np.float32(np.log(1e-6)))
    full[: len(mel)] = mel
    start = np.arange(chunks) * s.chunk * s.hop / s.rate
    end = (np.minimum((np.arange(chunks) + 1) * s.chunk, len(mel)) - 1) * s.hop / s.rate + s.frame / s.rate
    values = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(chunks, s.chunk, s.mels))
    batch = pa.record_batch([pa.array(start), pa.array(end), values], names=["start", "end", "log_mel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def read_tensors(stored: bytes) -> pa.Table:
    """Chunks with start, end and log_mel (a fixed-shape tensor array)."""
    return pa.ipc.open_stream(stored).read_all()


def _encode(s: Settings, id_type: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divisor = int(np.gcd(s.rate, s.stored_rate))
        for whole in batches:
            for batch, data, offsets in tk.steps(whole, "_text", 1 << 20):
                rows: list[tuple] = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n = b - a
                    media = write_wav(data[a:b].tobytes() + bytes(max(s.pad, -(-n // s.pad) * s.pad) - n), s.stored_rate)
                    samples, _ = read_wav(media)
                    x = resample((samples.astype(np.float64) - 128) / 128, s.rate // divisor, s.stored_rate // divisor)
                    mel, energy = log_mel(x, s)
                    found = [{"start": p * s.hop / s.rate, "end": ((q - 1) * s.hop + s.frame) / s.rate} for p, q in segments(energy, s)]
                    rows.append((n, media, len(mel), [float(v) for v in np.round(mel.mean(axis=0), 2)], found, _tensors(mel, s), zlib.crc32(mel.astype("<f4").tobytes())))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.float64()), span, pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_doc").cast(id_type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_doc", "n_bytes", "media", "frames", "mean_log_mel", "segments", "tensors", "mel_crc32"])

    return run


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Each text's bytes as audio: the stored file and what its samples, read back, show.

    The UTF-8 bytes, with zero bytes up to a positive multiple of 64, are the samples of an unsigned 8-bit WAV file. Read back, they are
    resampled by a polyphase filter, cut into overlapping frames and brought to log-mel energies. Frames' energies are cut into segments by two
    thresholds. The log-mel energies are stored as Arrow fixed-shape tensors of `chunk` frames, each with its time span; see read_tensors().

    Result, a row per input row: `id_col`, n_bytes, media (the file), frames, mean_log_mel, segments (array of start, end in seconds), tensors, mel_crc32 (of the energies as little-endian 32-bit floats, frame by frame, whatever stores them).
    Null text is empty: 64 zero samples. Equal texts give equal values; repeated rows stay. Other columns are not looked at. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    id_type = arrow_type(docs, id_col)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    schema = f"_doc {kind}, n_bytes long, media binary, frames long, mean_log_mel array<double>, segments array<struct<start: double, end: double>>, tensors binary, mel_crc32 long"
    return texts.mapInArrow(_encode(settings, id_type), schema).withColumnRenamed("_doc", id_col)
