"""Telephony audio columns: G.711 mu-law and A-law by lookup table, IMA ADPCM with numpy across blocks.

``expand`` turns a binary column of RIFF/WAVE files (mu-law, A-law or IMA ADPCM) into a column of resampled
16-bit PCM files of as many channels. ``store`` makes a column of mu-law files of a column's bytes. ``media_digest``
stores each text with it, writes that table, reads it back, expands it and computes features of what it read.

Edge cases: null text is the empty payload, null media gives null PCM; an empty payload is padded
to 64 zero bytes; damaged files give null PCM; a predictor's step index beyond 88 counts as 88; a
last ADPCM block shorter than its header is dropped; one record's bytes are the unit of memory, as
Spark's row holds them too; repeated rows give equal values; extra columns are kept by ``expand``
(``output`` names its column and replaces one of that name) and ignored by ``media_digest``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage, text_view

UNIT = 64
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17  # RIFF format tags
#: Step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, size = a >> 4 & 7, (a & 15) << 4
    size = np.where(seg == 0, size + 8, size + 264 << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For (index, nibble): the change of the predictor and the next index."""
    step, n = STEPS[:, None], np.arange(16)[None]
    size = (step >> 3) + np.where(n & 1, step >> 2, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 4, step, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[n & 7], 0, len(STEPS) - 1)
    return np.where(n & 8, -size, size).astype(np.int32).ravel(), index.astype(np.int32).ravel()


TABLE = {MULAW: _mulaw_table(), ALAW: _alaw_table()}
CHANGE, NEXT = _adpcm_tables()


def decode_adpcm(data: np.ndarray, block: int, at_once: int = 8192) -> np.ndarray:
    """IMA ADPCM blocks of ``block`` bytes (mono) to int16, (blocks, samples): all blocks step together."""
    n = len(data) // block
    out = np.empty((n, 2 * (block - 4) + 1), np.int16)
    for a in range(0, n, at_once):
        b = data[a * block : min(n, a + at_once) * block].reshape(-1, block)
        head = b[:, :2].astype(np.int32)
        level = (head[:, 0] | head[:, 1] << 8) - (head[:, 1] >> 7 << 16)
        index = np.minimum(b[:, 2].astype(np.int32), len(STEPS) - 1)
        part = np.empty((out.shape[1], len(b)), np.int16)
        part[0] = level
        nibbles = b[:, 4:].T.astype(np.int32)
        for j in range(block - 4):
            for k, n4 in enumerate((nibbles[j] & 15, nibbles[j] >> 4)):
                at = (index << 4) + n4
                level = np.clip(level + CHANGE[at], -32768, 32767)
                index = NEXT[at]
                part[2 * j + k + 1] = level
        out[a : a + len(b)] = part.T
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers from ``rate`` to ``to``; the last sample holds."""
    if rate == to or not len(pcm):
        return pcm
    if to % rate == 0:  # so many samples for each: no index arrays
        k = to // rate
        x = pcm.astype(np.int32)
        rise = np.zeros_like(x)
        rise[:-1] = x[1:] - x[:-1]
        out = np.empty((len(x), k, *x.shape[1:]), np.int16)
        for j in range(k):
            out[:, j] = x + rise * j // k if j else x
        return out.reshape(-1, *x.shape[1:])
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    i, part = at // to, (at % to).reshape(-1, *[1] * (pcm.ndim - 1))
    x = pcm.astype(np.int64)
    return (x[i] + (x[np.minimum(i + 1, len(x) - 1)] - x[i]) * part // to).astype(np.int16)


def wave(data: bytes, tag: int, rate: int = 8000, block: int = 1, bits: int = 8, channels: int = 1) -> bytes:
    """A RIFF/WAVE file around ``data``; ``block`` holds all channels."""
    per_block = 2 * (block // channels - 4) + 1 if tag == IMA else 1
    more = struct.pack("<HH", 2, per_block) if tag == IMA else b"" if tag == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, channels, rate, rate * block // per_block, block, bits) + more
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) // block * per_block)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(file: bytes) -> tuple[int, int, int, memoryview, int]:
    """(format tag, sample rate, block size, data, channels) of a RIFF/WAVE file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", file, at + 8)
            if not channels:
                raise ValueError("no channel")
            form = tag, rate, block
        elif name == b"data":
            if not form or at + 8 + size > len(file):
                raise ValueError("damaged")
            return *form, memoryview(file)[at + 8 : at + 8 + size], channels
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def decode(tag: int, block: int, data, channels: int = 1) -> np.ndarray:
    """16-bit samples of mu-law, A-law, IMA ADPCM or PCM data: (samples,) of one channel, (samples, channels) of more."""
    raw = np.frombuffer(data, np.uint8)
    if channels > 1 and tag == IMA:  # headers of all channels, then four bytes of each in turn
        if block <= 4 * channels or block % (4 * channels):
            raise ValueError("damaged")
        words = raw[: len(raw) // block * block].reshape(-1, block // channels // 4, channels, 4)
        return np.stack([decode(tag, block // channels, words[:, :, c].tobytes()) for c in range(channels)], 1)
    if channels > 1:
        frame = channels * (2 if tag == PCM else 1)
        return decode(tag, block, raw[: len(raw) // frame * frame]).reshape(-1, channels)
    if tag in TABLE:
        return TABLE[tag][raw]
    if tag == IMA and block > 4:
        return decode_adpcm(raw[: len(raw) // block * block], block).ravel()
    if tag == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"format {tag} is not known")


def pcm_file(file: bytes | None, rate: int) -> bytes | None:
    """A file as 16-bit PCM at ``rate``; None where it can't be read."""
    if file is None:
        return None
    try:
        tag, own, block, data, channels = read_wave(file)
        return wave(resample(decode(tag, block, data, channels), own, rate).astype("<i2").tobytes(), PCM, rate, 2 * channels, 16, channels)
    except (ValueError, struct.error):
        return None


def _added(b: pa.RecordBatch, output: str, made: pa.Array) -> pa.RecordBatch:
    names = [n for n in b.schema.names if n != output]
    return pa.RecordBatch.from_arrays([*(b.column(n) for n in names), made], [*names, output])


def expanding(batches: Iterator[pa.RecordBatch], column: str, rate: int, output: str) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, column):
        yield _added(b, output, pa.array([pcm_file(x, rate) for x in b.column(column).to_pylist()], pa.binary()))


def expand(df: DataFrame, column: str = "media", rate: int = 16000, output: str = "pcm") -> DataFrame:
    """``df`` with ``output``: the file in ``column`` as 16-bit PCM at ``rate``; null where it can't be read."""
    return df.mapInArrow(lambda batches: expanding(batches, column, rate, output), _schema(df, output))


def store(df: DataFrame, column: str = "text", output: str = "media") -> DataFrame:
    """``df`` with ``output``: the column's bytes, padded to a multiple of 64, as a mu-law file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column):
            off, raw = text_view(b.column(column))
            yield _added(b, output, pa.array([wave(padded(raw[x:y]).tobytes(), MULAW) for x, y in zip(off.tolist(), off[1:].tolist())], pa.binary()))

    return df.mapInArrow(run, _schema(df, output))


def _schema(df: DataFrame, output: str) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name != output), T.StructField(output, T.BinaryType(), True)])


def padded(raw: np.ndarray) -> np.ndarray:
    """``raw`` with bytes 0 up to a positive multiple of 64."""
    return np.concatenate([raw, np.zeros(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw), np.uint8)])


def features(payloads: list[memoryview], pcm: list[bytes]) -> list[str]:
    """Peak and mean level of each payload in the three codecs, its sign changes, and the CRC-32 of its expanded samples."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    starts = np.cumsum([0, *map(len, payloads)])
    out = [[] for _ in payloads]

    def levels(name: str, x: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        size = np.abs(x.astype(np.int32))
        for o, peak, mean in zip(out, np.maximum.reduceat(size, at).tolist(), (np.add.reduceat(size, at, dtype=np.int64) // n).tolist()):
            o.append(f"{name}:{peak}:{mean}")

    mu = TABLE[MULAW][raw]
    levels("mulaw", mu, starts[:-1], np.diff(starts))
    levels("alaw", TABLE[ALAW][raw], starts[:-1], np.diff(starts))
    blocks = starts // UNIT * (2 * (UNIT - 4) + 1)
    levels("adpcm", decode_adpcm(raw, UNIT).ravel(), blocks[:-1], np.diff(blocks))
    turn = np.r_[(mu[1:] < 0) != (mu[:-1] < 0), False]
    turn[starts[1:] - 1] = False
    turns = np.add.reduceat(turn, starts[:-1], dtype=np.int64).tolist()
    for o, t, x in zip(out, turns, pcm):
        o.append(f"turns:{t};pcm16k:{zlib.crc32(x):08x}")
    return [";".join(o) for o in out]


def media_digest(docs: DataFrame) -> DataFrame:
    """Per document: the stored mu-law file's size and SHA-256, what was read back from it, and its features."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    media = stage(store(rows).select("doc_id", "n_bytes", "media"), "media", narrow=False, compression="zstd")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in expanding(slices(batches, "media", 1 << 19), "media", 16000, "pcm"):
            files = b.column("media").to_pylist()
            read, pcm = ([read_wave(f)[3] for f in some] for some in (files, b.column("pcm").to_pylist()))
            columns = [
                b.column("doc_id"), b.column("n_bytes"), pa.array([len(p) for p in read], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in read]), pa.array([zlib.crc32(p[-UNIT:]) for p in read], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                pa.array(features(read, pcm)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, schema)
