"""Audio: PCM16 WAV, a 40-bit two-tone mark in the signal, and its detection.

Detection measures the power at both tones once for every distinct window offset and reuses it for all phases and frames
that meet there, in numpy over windows; the recurrence keeps its order over samples. Audio is partitioned by clip.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, require
from ..functions.scalars import MESSAGE_BITS, PREAMBLE


@dataclass(frozen=True)
class Policy:
    amplitude_dbfs: float = -42.0
    bit_duration_ms: int = 20
    w1_zero_hz: float = 17500.0
    w1_one_hz: float = 18500.0
    w2_zero_hz: float = 26000.0
    w2_one_hz: float = 28000.0
    w2_minimum_sample_rate: int = 96000
    nyquist_guard_hz: float = 2000.0
    minimum_confidence: float = 0.30

    def finite(self) -> bool:
        return all(math.isfinite(v) for v in (self.amplitude_dbfs, self.w1_zero_hz, self.w1_one_hz, self.w2_zero_hz, self.w2_one_hz, self.nyquist_guard_hz, self.minimum_confidence))

    def bands_safe(self) -> bool:
        return (
            self.finite()
            and 300 <= self.w1_zero_hz < self.w1_one_hz <= 19000
            and 24000 <= self.w2_zero_hz < self.w2_one_hz <= 40000
            and self.w2_minimum_sample_rate >= 96000
            and self.nyquist_guard_hz >= 2000
        )

    def basics(self) -> bool:
        return self.bit_duration_ms > 0 and -120 <= self.amplitude_dbfs <= -6

    def tones(self, band: str) -> tuple[float, float]:
        return (self.w1_zero_hz, self.w1_one_hz) if band == "W1" else (self.w2_zero_hz, self.w2_one_hz)


@dataclass
class Audio:
    sample_rate: int
    channels: int
    samples: np.ndarray  # int16, interleaved

    def frames(self) -> int:
        return len(self.samples) // self.channels if self.channels else 0

    def seconds(self) -> float:
        return self.frames() / self.sample_rate if self.sample_rate else 0.0


def qualified(audio: Audio, band: str, policy: Policy) -> bool:
    if not audio.channels or not audio.sample_rate or len(audio.samples) % audio.channels:
        return False
    if band == "W2" and audio.sample_rate < max(96000, policy.w2_minimum_sample_rate):
        return False
    return policy.tones(band)[1] + policy.nyquist_guard_hz < audio.sample_rate / 2


def crc8(code: int) -> int:
    value = code << 8
    for k in range(15, -1, -1):
        if value >> (k + 8) & 1:
            value ^= 0x107 << k
    return value & 0xFF


def bits_of(code: int) -> list[int]:
    return [int(c) for c in f"{PREAMBLE << 24 | code << 8 | crc8(code):040b}"]


def embed(audio: Audio, code: int, band: str = "W1", policy: Policy = Policy()) -> tuple[Audio, int]:
    """Marked audio and the number of frames embedded. The tail that holds no whole frame stays as it was."""
    require(policy.basics() and policy.finite(), "invalid_argument", "watermark policy is out of range")
    require(policy.bands_safe(), "watermark_path_unqualified", "tones leave the bands that are allowed")
    require(qualified(audio, band, policy), "watermark_path_unqualified", "sample rate is too low for band W2" if band == "W2" else "sample rate is too low for band W1")
    spb = audio.sample_rate * policy.bit_duration_ms // 1000
    require(spb >= 16, "invalid_argument", "a bit has too few samples")
    repeats = audio.frames() // (spb * MESSAGE_BITS)
    require(repeats > 0, "invalid_argument", "audio holds no whole frame")
    n = repeats * spb * MESSAGE_BITS
    tones = np.array(policy.tones(band))
    frequency = np.repeat(np.tile(tones[bits_of(code)], repeats), spb)
    carrier = 32767.0 * 10.0 ** (policy.amplitude_dbfs / 20.0) * np.sin(2.0 * math.pi * frequency * np.arange(n, dtype=float) / audio.sample_rate)
    mixed = audio.samples[: n * audio.channels].reshape(n, audio.channels).astype(float) + carrier[:, None]
    rounded = np.copysign(np.floor(np.abs(mixed) + 0.5), mixed)
    out = audio.samples.copy()
    out[: n * audio.channels] = np.clip(rounded, -32768, 32767).astype(np.int16).reshape(-1)
    return Audio(audio.sample_rate, audio.channels, out), repeats


def accepts(value: int) -> bool:
    """Whether a read message has at most two wrong bits in its preamble and a CRC that fits its code (scalars.accepted as a column)."""
    return ((value >> 24) ^ PREAMBLE).bit_count() <= 2 and value & 0xFF == crc8(value >> 8 & 0xFFFF)


def powers(mono: np.ndarray, offsets: np.ndarray, size: int, frequency: float, rate: int) -> np.ndarray:
    """Power at one frequency of the windows of `size` samples at all offsets, sample after sample."""
    k = 2.0 * math.cos(2.0 * math.pi * frequency / rate)
    p, q = np.zeros(len(offsets)), np.zeros(len(offsets))
    for step in range(size):
        p, q = mono[offsets + step] + k * p - q, p
    return q * q + p * p - k * p * q


def detect(audio: Audio, policy: Policy = Policy()) -> list[dict]:
    """Observations in the order in which phases find them; of several nearby ones the first found stays."""
    sound = audio.channels > 0 and audio.sample_rate > 0 and len(audio.samples) % max(audio.channels, 1) == 0
    require(sound and policy.basics() and policy.bands_safe() and 0 <= policy.minimum_confidence <= 1, "invalid_argument", "audio or policy is out of range")
    spb = audio.sample_rate * policy.bit_duration_ms // 1000
    require(spb >= 16, "invalid_argument", "a bit has too few samples")
    frame = spb * MESSAGE_BITS
    mono = audio.samples.reshape(-1, audio.channels).astype(float).sum(axis=1) / audio.channels
    out: list[dict] = []
    for band in ("W1", "W2"):
        if not qualified(audio, band, policy):
            continue
        starts = np.concatenate([np.arange(phase, len(mono) - frame + 1, frame) for phase in range(0, frame, max(1, spb // 10))])
        if not len(starts):
            continue
        offsets, place = np.unique(starts[:, None] + np.arange(MESSAGE_BITS) * spb, return_inverse=True)
        place = place.reshape(len(starts), MESSAGE_BITS)
        zero, one = (powers(mono, offsets, spb, f, audio.sample_rate)[place] for f in policy.tones(band))
        weight = np.abs(one - zero) / np.maximum(1.0, np.abs(one) + np.abs(zero))
        confidence = np.zeros(len(starts))
        for k in range(MESSAGE_BITS):  # sums in bit order
            confidence += weight[:, k]
        confidence /= MESSAGE_BITS
        packed = (one > zero) @ (1 << np.arange(MESSAGE_BITS - 1, -1, -1))
        kept: dict[int, list[int]] = {}
        for i in np.flatnonzero(confidence >= policy.minimum_confidence).tolist():
            value = int(packed[i])
            if not accepts(value):
                continue
            code, wrong = value >> 8 & 0xFFFF, ((value >> 24) ^ PREAMBLE).bit_count()
            start = int(starts[i])
            if all(abs(start - s) >= spb for s in kept.setdefault(code, [])):
                kept[code].append(start)
                out.append({"band": band, "code": code, "confidence": float(confidence[i]), "start_frame": start, "end_frame": start + frame, "corrected_preamble_bits": wrong})
    return out


def strongest(found: list[dict]) -> list[dict]:
    """Of a clip's observations whose frames overlap in a band, the one with the fewest corrected bits, then the most confident.

    A window that straddles a mark can pass the tolerant preamble and the 8-bit CRC by chance, and the detector reports it
    as it should; one embedding never makes frames that overlap.
    """
    kept: dict[tuple[str, int], dict] = {}  # frames that do not overlap: at most one starts in each cell of a frame's length
    for o in sorted(found, key=lambda o: (o["corrected_preamble_bits"], -o["confidence"])):
        frame = o["end_frame"] - o["start_frame"]
        cell = o["start_frame"] // frame
        rivals = (kept.get((o["band"], c)) for c in (cell - 1, cell, cell + 1))
        if all(r is None or abs(r["start_frame"] - o["start_frame"]) >= frame for r in rivals):
            kept[o["band"], cell] = o
    chosen = {id(o) for o in kept.values()}
    return [o for o in found if id(o) in chosen]


# WAV

MOST_WAV = 1 << 30


def read_wav(data: bytes) -> Audio:
    """PCM16 only; the last fmt and data chunks count, the size in the file's head does not."""
    require(len(data) <= MOST_WAV, "resource_exhausted", "input is too large")
    require(len(data) >= 44 and data[:4] == b"RIFF" and data[8:12] == b"WAVE", "decode", "not a RIFF/WAVE file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        require(size <= len(data) - at, "decode", "truncated WAV chunk")
        if name == b"fmt ":
            require(size >= 16, "decode", "short WAV format chunk")
            form = struct.unpack_from("<HHIIHH", data, at)
        elif name == b"data":
            body = data[at : at + size]
        at += size + size % 2
    require(form is not None and body is not None, "decode", "missing WAV format or data chunk")
    kind, channels, rate, _, align, bits = form
    require(kind == 1 and bits == 16 and channels > 0 and rate > 0 and align == 2 * channels and len(body) % align == 0, "decode", "only PCM16 WAV is supported")
    return Audio(rate, channels, np.frombuffer(body, "<i2").astype(np.int16))


def write_wav(audio: Audio) -> bytes:
    require(audio.sample_rate > 0 and audio.channels > 0 and len(audio.samples) % audio.channels == 0, "invalid_argument", "audio has no whole PCM16 frames")
    size = 2 * len(audio.samples)
    require(size + 36 <= 0xFFFFFFFF, "resource_exhausted", "audio is too large for WAV")
    align = 2 * audio.channels
    return b"RIFF" + struct.pack("<I", size + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, audio.channels, audio.sample_rate, audio.sample_rate * align, align, 16) + b"data" + struct.pack("<I", size) + audio.samples.astype("<i2").tobytes()


# DataFrames of clips

OBSERVATIONS = "audio_id string, band string, code int, confidence double, start_frame long, end_frame long, corrected_preamble_bits int, ordinal int, error_code string"


#: Clips that an operator puts into one batch.
FEW = 64


def few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most FEW, so that memory holds few clips at a time."""
    return (batch.slice(k, FEW) for k in range(0, batch.num_rows, FEW))


def _clips(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    return zip(batch.column("audio_id").to_pylist(), batch.column("wav").to_pylist(), strict=True)


def detect_all(clips: DataFrame, policy: Policy = Policy(), overlapping: bool = True) -> DataFrame:
    """clips: (audio_id, wav binary). Observations of every clip; a clip that cannot be read is one row with its error_code.

    With overlapping false only the strongest of observations that overlap; ordinals are those among all of the clip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in few(whole)):
            rows = []
            for name, wav in _clips(batch):
                try:
                    found = [o | {"ordinal": k} for k, o in enumerate(detect(read_wav(wav or b""), policy))]
                    for o in found if overlapping else strongest(found):
                        rows.append((name, o["band"], o["code"], o["confidence"], o["start_frame"], o["end_frame"], o["corrected_preamble_bits"], o["ordinal"], "ok"))
                except EngineError as e:
                    rows.append((name, *[None] * 7, e.code))
            types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in OBSERVATIONS.split(", ")])

    return clips.select("audio_id", "wav").mapInArrow(run, OBSERVATIONS)


def embed_all(clips: DataFrame, band: str = "W1", policy: Policy = Policy()) -> DataFrame:
    """clips: (audio_id, wav binary, code int). audio_id, wav, frames_embedded, error_code; a failed clip keeps its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in few(whole)):
            rows = []
            for (name, wav), code in zip(_clips(batch), batch.column("code").to_pylist(), strict=True):
                try:
                    marked, n = embed(read_wav(wav or b""), code, band, policy)
                    rows.append((name, write_wav(marked), n, "ok"))
                except EngineError as e:
                    rows.append((name, wav, 0, e.code))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.binary(), pa.int64(), pa.string()], strict=True)], ["audio_id", "wav", "frames_embedded", "error_code"])

    return clips.select("audio_id", "wav", "code").mapInArrow(run, "audio_id string, wav binary, frames_embedded long, error_code string")


def greedy_dedupe(found: DataFrame, distance: int) -> DataFrame:
    """Of observations (audio_id, band, code, start_frame, ordinal) those that no kept earlier one (by ordinal) of the same band and code is near to.

    Order decides, so each (audio_id, band, code) is folded in order, streaming; a fold keeps only the starts it has kept.
    """
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, near = None, {}
        for batch in batches:
            keep = []
            for k in zip(*(batch.column(c).to_pylist() for c in ("audio_id", "band", "code", "start_frame")), strict=True):
                if k[:3] != key:
                    key, near = k[:3], {}
                cell = k[3] // distance
                clash = any(abs(s - k[3]) < distance for c in (cell - 1, cell, cell + 1) for s in near.get(c, ()))
                if not clash:
                    near.setdefault(cell, []).append(k[3])
                keep.append(not clash)
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in names)
    keys = ["audio_id", "band", "code"]
    return found.repartition(*keys).sortWithinPartitions(*keys, "ordinal").mapInArrow(run, schema)


def confirmation_hops(observations: DataFrame) -> DataFrame:
    """How often each (audio_id, band, code) was observed."""
    return observations.groupBy("audio_id", "band", "code").agg(F.count("*").alias("confirmation_hops"))


def fuse(observations: DataFrame, statements: DataFrame) -> DataFrame:
    """Evidence rows: hops of equal (band, code) in a clip, joined with the clip's statement.

    statements: (audio_id, statement_state, feed_uuid, acoustic_code, issuer), at most one for each clip. A mark is a
    signature-bound candidate with a valid statement of its code and three hops or more; nothing is ever authoritative.
    """
    # Counts are aggregated before they are joined, so that a clip of many marks is no single task.
    df = observations.join(confirmation_hops(observations), ["audio_id", "band", "code"]).join(statements, "audio_id", "left")
    bound = F.coalesce((F.col("statement_state") == "valid") & (F.col("acoustic_code") == F.col("code")), F.lit(False))
    return df.select(
        "audio_id", "band", "code", "confidence", "start_frame", "end_frame", "confirmation_hops",
        F.when(bound & (F.col("confirmation_hops") >= 3), "signature_bound_candidate").otherwise("candidate").alias("state"),
        F.lit("goertzel_bin_dominance").alias("detection_statistic"),
        F.lit(False).alias("waveform_spike"),
        F.lit(False).alias("authoritative"),
        F.coalesce("statement_state", F.lit("absent")).alias("statement_state"),
        F.col("feed_uuid").alias("claimed_feed_uuid"),
        F.when(bound, F.col("issuer")).alias("issuer"),
    )


def separate(*_: object) -> None:
    raise EngineError("model_incompatible", "neural separation is not available")
