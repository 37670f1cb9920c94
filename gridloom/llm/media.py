"""Media columns: texts stored as 8-bit audio, and audio features as fixed-shape tensors with time spans."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, slices, texts_of

BLOCK = 192


@dataclass(frozen=True)
class AudioSpec:
    """rate: samples a second of the stored form; up/down: resampling ratio; frames of `frame` samples every `hop`
    samples of the resampled signal; `mels` filters; `chunk` frames make a tensor; segments open at `on` dB above
    the quietest tenth of the frames and close below `off` dB."""

    rate: int = 8000
    up: int = 1
    down: int = 2
    taps: int = 8  # per phase and side
    frame: int = 256
    hop: int = 128
    mels: int = 16
    chunk: int = 32
    on: float = 6.0
    off: float = 3.0


def payload_of(raw: bytes) -> bytes:
    """raw and spaces up to a positive multiple of BLOCK bytes."""
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def encode_wav(payload: bytes, rate: int) -> bytes:
    """RIFF/WAVE, PCM, one channel, unsigned 8-bit samples."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; walks the chunks as RIFF has them."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit PCM is read")
        elif name == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("broken WAVE file")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low pass split into `up` phases of 2 x taps x max(up, down) / up coefficients."""
    half = taps * max(up, down)
    n = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * np.hanning(len(n) + 2)[1:-1]
    h = np.concatenate([h / h.sum() * up, np.zeros(-len(h) % up)])
    return h.reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = 8) -> np.ndarray:
    """Polyphase: output m takes phase (m x down) mod up only; ceil(len(x) x up / down) samples."""
    if len(x) == 0:
        return x.astype(np.float32)
    phases = _phases(up, down, taps)
    half = taps * max(up, down)
    n, width = -(-len(x) * up // down), phases.shape[1]
    wide = np.concatenate([np.zeros(width, np.float32), x.astype(np.float32), np.zeros(width + 1, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(wide, width)
    out = np.empty(n, np.float32)
    at = np.arange(n, dtype=np.int64) * down + half  # position in the upsampled, filtered signal
    for p in range(up):
        own = at % up == p
        out[own] = view[np.minimum(at[own] // up + 1, len(view) - 1)] @ phases[p][::-1]
    return out


@cache
def _mel(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles evenly spaced in mel between 0 and half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float, spec: AudioSpec) -> np.ndarray:
    """Overlapped Hann frames (the last is filled with zeros), frames x mels, natural log."""
    frames = max(1, -(-max(0, len(y) - spec.frame) // spec.hop) + 1)
    wide = np.zeros((frames - 1) * spec.hop + spec.frame, np.float32)
    wide[: len(y)] = y[: len(wide)]
    view = np.lib.stride_tricks.sliding_window_view(wide, spec.frame)[:: spec.hop]
    window, bank = np.hanning(spec.frame).astype(np.float32), _mel(rate, spec.frame, spec.mels)
    out = [np.log((np.abs(np.fft.rfft(view[a : a + 2048] * window).astype(np.complex64)) ** 2) @ bank + 1e-6) for a in range(0, frames, 2048)]
    return np.concatenate(out)


def segments(energy_db: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Frame ranges [start, end): open where the energy reaches the floor + on, until it falls under the floor + off."""
    if len(energy_db) == 0:
        return []
    floor = float(np.sort(energy_db)[len(energy_db) // 10])
    up, down = energy_db >= floor + on, energy_db < floor + off
    marks = np.flatnonzero(up | down)
    out, start = [], None
    for i, rises in zip(marks.tolist(), up[marks].tolist(), strict=True):
        if rises and start is None:
            start = i
        elif not rises and start is not None:
            out.append((start, i))
            start = None
    return out if start is None else [*out, (start, len(energy_db))]


def tensor_type(spec: AudioSpec) -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), [spec.chunk, spec.mels], dim_names=["frame", "mel"])


def tensors(mel: np.ndarray, rate: float, spec: AudioSpec) -> bytes:
    """An Arrow stream of start_ms, end_ms and the fixed-shape tensor of each chunk (the last one zero-filled)."""
    n = -(-len(mel) // spec.chunk)
    full = np.zeros((n * spec.chunk, spec.mels), np.float32)
    full[: len(mel)] = mel
    kind = tensor_type(spec)
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), spec.chunk * spec.mels)
    first = np.arange(n) * spec.chunk
    last = np.minimum(first + spec.chunk, len(mel)) - 1
    batch = pa.RecordBatch.from_arrays(
        [pa.array(first * spec.hop * 1000 / rate), pa.array((last * spec.hop + spec.frame) * 1000 / rate), pa.ExtensionArray.from_storage(kind, values)],
        schema=pa.schema([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("log_mel", kind)]),
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def features_of(media: bytes, spec: AudioSpec) -> tuple[bytes, list[tuple[float, float]], np.ndarray]:
    """Tensor stream, segments in ms and the mean of the log-mel frames, from the stored bytes alone."""
    samples, rate = decode_wav(media)
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y, rate = resample(x, spec.up, spec.down, spec.taps), rate * spec.up / spec.down
    mel = log_mel(y, rate, spec)
    db = 10 / np.log(10) * np.logaddexp.reduce(mel, axis=1)
    ms = spec.hop * 1000 / rate
    return tensors(mel, rate, spec), [(s * ms, e * ms) for s, e in segments(db, spec.on, spec.off)], mel.mean(axis=0, dtype=np.float64)


def audio_columns(docs: DataFrame, spec: AudioSpec = AudioSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row for each document: doc_id, n_bytes, media (a WAV file whose samples are the padded text), payload
    (samples read back from media), tensors (an Arrow stream of fixed-shape log-mel tensors with time spans),
    segments (start_ms, end_ms) and mean_log_mel.

    Null and empty texts are one block of spaces; whole texts are stored, however long; equal texts give equal
    rows; null ids stay null; other columns are ignored."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
        for batch in batches:
            ids, raws = batch.column(0), as_bytes(batch.column(1))
            for a, b in slices([len(r) + 200 for r in raws], 2_000_000):
                media = [encode_wav(payload_of(r), spec.rate) for r in raws[a:b]]
                made = [features_of(m, spec) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(r) for r in raws[a:b]], pa.int64()), pa.array(media, pa.binary()), pa.array([decode_wav(m)[0] for m in media], pa.binary()), pa.array([m[0] for m in made], pa.binary()), pa.array([[{"start_ms": s, "end_ms": e} for s, e in m[1]] for m in made], span), pa.array([m[2].tolist() for m in made], pa.list_(pa.float64()))],
                    names=["doc_id", "n_bytes", "media", "payload", "tensors", "segments", "mean_log_mel"],
                )

    schema = "doc_id long, n_bytes long, media binary, payload binary, tensors binary, segments array<struct<start_ms:double,end_ms:double>>, mean_log_mel array<double>"
    return texts_of(docs, id_col, text_col).mapInArrow(convert, schema)


def digest(made: DataFrame) -> DataFrame:
    """Lengths and hashes; feature: number of segments, and the mean spectrum rounded to tenths. It holds no hash of
    floats: their last bits can differ from one processor's libraries to another's."""
    return made.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("tensors="), F.expr("length(tensors)").cast("string")),
            F.concat(F.lit("segments="), F.size("segments").cast("string")),
            F.concat(F.lit("mel="), F.array_join(F.transform("mean_log_mel", lambda x: F.format_number(x, 1)), "|")),
        ).alias("feature"),
        F.size("segments").cast("long").alias("n_segments"),
    )


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
