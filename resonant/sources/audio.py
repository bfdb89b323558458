"""PCM audio as a source and a sink: WAV files decoded in Arrow batches on the executors, and test signals.

Each file is one partition's row: path, sample rate, channels and mono samples.
Widths of 8, 16, 24 and 32 bits are read; a broken file gives an error column.
"""

from __future__ import annotations

import io
import math
import os
import struct
import uuid
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, sr int, channels int, n long, samples array<float>, error string"


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples by channel, in [-1, 1)."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, sr = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
    if width == 1:
        x = (raw.astype(np.float64) - 128) / 128
    elif width == 3:
        parts = raw.reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = raw.view(f"<i{width}") / 2.0 ** (8 * width - 1)
    return sr, np.asarray(x, np.float32).reshape(-1, channels)


def encode_wav(samples: np.ndarray, sr: int, bits: int = 24) -> bytes:
    """PCM of mono samples, of 16 or 24 bits."""
    top = 2 ** (bits - 1)
    v = np.clip(np.rint(np.asarray(samples, np.float64) * top), -top, top - 1).astype("<i4")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(bits // 8), w.setframerate(sr)
        w.writeframes(v.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes())
    return out.getvalue()


def wav_header(head: bytes, length: int) -> tuple[int, int, float]:
    """Sample rate, channels and seconds from a file's first bytes and its length; no sample is read."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 24 <= len(head):
            form = struct.unpack_from("<HHIIHH", head, at + 8)
        if name == b"data" and form:
            return form[2], form[1], min(size, length - at - 8) / form[4] / form[2]
        at += 8 + size + size % 2
    raise ValueError("no samples announced in the header")


def to_mono(x: np.ndarray) -> np.ndarray:
    """One dimension passes; of two, the channel axis is the first if it has at most eight and is the shorter."""
    if x.ndim == 1:
        return x.astype(np.float32)
    if x.ndim != 2:
        raise ValueError("a signal has one or two dimensions")
    return x.mean(axis=0 if x.shape[0] <= 8 and x.shape[0] < x.shape[1] else 1).astype(np.float32)


def _decode(batches):
    for b in batches:
        rows = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            try:
                sr, x = decode_wav(content)
                rows.append((path, sr, x.shape[1], len(x), to_mono(x).tolist(), None))
            except (wave.Error, EOFError, ValueError) as e:
                rows.append((path, None, None, None, None, str(e) or type(e).__name__))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string()))],
                                         names=["path", "sr", "channels", "n", "samples", "error"])


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """All WAV files below a path of any file system, decoded on the executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return found.select("path", "content").mapInArrow(_decode, SCHEMA)


#: Bytes of a file that hold its header.
HEAD = 1 << 16


def _probe(batches):
    for b in batches:
        rows = []
        for head, length in zip(b.column("head").to_pylist(), b.column("length").to_pylist()):
            try:
                rows.append((*wav_header(head, length), None))
            except (ValueError, struct.error, ZeroDivisionError) as e:
                rows.append((None, None, None, str(e) or type(e).__name__))
        sr, channels, seconds, errors = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(sr, pa.int32()), pa.array(channels, pa.int32()), pa.array(seconds, pa.float64()), pa.array(errors, pa.string())], names=["path", "sr", "channels", "duration_s", "error"])


def probe(spark: SparkSession, path: str) -> DataFrame:
    """path, sr, channels, duration_s and error of all WAV files, from their headers alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return found.select("path", "length", F.substring("content", 1, HEAD).alias("head")).mapInArrow(_probe, "path string, sr int, channels int, duration_s double, error string")


def read_for_analysis(spark: SparkSession, path: str, sr: int = 22050, peak: float = 0.9) -> DataFrame:
    """path, sr and samples of all WAV files: mono, resampled and brought to one peak; broken files keep an error."""
    from ..operators.signal_udf import prepare

    def run(batches):
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    own, x = decode_wav(content)
                    rows.append((name, sr, prepare(to_mono(x), own, sr, peak).tolist(), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((name, None, None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string()))], names=["path", "sr", "samples", "error"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return found.select("path", "content").mapInArrow(run, "path string, sr int, samples array<float>, error string")


def encoded(tracks: DataFrame, peak: float = 0.9, bits: int = 24) -> DataFrame:
    """The rows (sr, samples, ...) with content, actual_duration_s, and the levels before normalisation, which the file no longer tells.

    Samples stay behind. Content may be written as a table, or as files by ``write_files``.
    """
    rest = [f for f in tracks.schema if f.name != "samples"]

    def run(batches):
        for b in batches:
            out = []
            for rate, samples in zip(b.column("sr").to_pylist(), b.column("samples").to_pylist()):
                x = np.asarray(samples or [], np.float32)
                top = float(np.abs(x).max()) if len(x) else 0.0
                scaled = x if top < 1e-8 else x * np.float32(peak / top)
                out.append((encode_wav(scaled, rate, bits), len(x) / rate, top, float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) if len(x) else 0.0))
            made = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.binary(), pa.float64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], *made], names=[*[f.name for f in rest], "content", "actual_duration_s", "orig_peak", "orig_rms"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return tracks.select(*[f"`{f.name}`" for f in rest], "samples").mapInArrow(run, f"{fields}, content binary, actual_duration_s double, orig_peak double, orig_rms double")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (file, content) below a folder that all executors share, under a passing name first; the rows without content, once run."""
    rest = [f for f in rows.schema if f.name != "content"]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist()):
                target = os.path.join(folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(content)
                os.replace(f.name, target)
            yield b.select([f.name for f in rest])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest))


def reference_segments(windows: DataFrame, pieces: DataFrame, peak: float = 0.9) -> DataFrame:
    """The windows (piece, start_s, duration_s, idx) cut from pieces (path, sr, samples), each a file of its own.

    A window that its piece does not fill is left out. Returns the manifest's columns and content.
    """
    p = pieces.select(F.col("path").alias("piece"), "sr", "samples")
    lo, hi = (F.col("start_s") * F.col("sr")).cast("int"), ((F.col("start_s") + F.col("duration_s")) * F.col("sr")).cast("int")
    cut = windows.join(p, "piece").withColumn("n", hi - lo).withColumn("samples", F.slice("samples", lo + 1, F.col("n"))).where(F.size("samples") == F.col("n"))
    stem = F.regexp_replace(F.element_at(F.split("piece", "/"), -1), r"\.[^.]*$", "")
    name = F.format_string("%s_%ds_%ds_%05d.wav", stem, F.col("start_s").cast("int"), F.col("duration_s").cast("int"), F.col("idx"))
    return encoded(cut.select("piece", "start_s", "duration_s", name.alias("file"), "sr", "samples"), peak)


# -- deterministic signals in place of generators


def sine(freq: float, seconds: float, sr: int = 22050, amp: float = 0.5, phase: float = 0.0) -> np.ndarray:
    return (amp * np.sin(2 * math.pi * freq * np.arange(int(sr * seconds)) / sr + phase)).astype(np.float32)


def clicks(seconds: float, bpm: float, sr: int = 22050, offset: float = 0.0) -> np.ndarray:
    """An impulse at each beat, convolved with a short windowed tone."""
    n, length = int(0.03 * sr), int(sr * seconds)
    beats = np.zeros(length)
    beats[np.rint(np.arange(offset, (length - 0.5) / sr, 60.0 / bpm) * sr).astype(int)] = 1
    tone = np.hanning(n) * np.sin(2 * math.pi * 1000 / sr * np.arange(n))
    return np.convolve(beats, tone)[:length].astype(np.float32)


def melody(seconds: float, seed: int = 0, sr: int = 22050) -> np.ndarray:
    """Half-second notes with an envelope and a little noise."""
    rng = np.random.default_rng(seed)
    notes = [261.6, 293.7, 329.6, 349.2, 392.0, 440.0]
    n = sr // 2
    parts = [np.sin(2 * math.pi * rng.choice(notes) * np.arange(n) / sr) * np.exp(-np.arange(n) / (0.3 * n)) for _ in range(math.ceil(seconds * 2))]
    y = np.concatenate(parts)[: int(sr * seconds)]
    return (0.5 * y + rng.normal(0, 0.005, len(y))).astype(np.float32)


def noise(seconds: float, seed: int = 0, sr: int = 22050) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.3, int(sr * seconds)).astype(np.float32)


#: Generators by name; callers may add their own.
GENERATORS = {"sine": lambda s, seed: sine(220.0 + seed, s), "clicks": lambda s, seed: clicks(s, 120.0), "melody": melody, "noise": noise, "drone": lambda s, seed: sine(220.0, s), "silence": lambda s, seed: np.zeros(int(22050 * s), np.float32)}


def generate(plan: DataFrame) -> DataFrame:
    """(generator, seconds, seed, ...) to the same rows with samples, made on the executors."""
    table = dict(GENERATORS)

    def run(batches):
        for b in batches:
            made = [table[g](s, seed).tolist() for g, s, seed in zip(*(b.column(c).to_pylist() for c in ("generator", "seconds", "seed")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*b.schema.names, "samples"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema)
    return plan.mapInArrow(run, f"{fields}, samples array<float>")
