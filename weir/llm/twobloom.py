"""Two Bloom filters over a table's hashes: seen once, seen twice.

Hashes are dealt by their top bits to segments, whose number grows with the table; each segment's
pair of filters is filled where its hashes arrive, so no task holds or sends more than one segment at a time. Only
the twice-seen filter travels on, folded to ``MAX_BITS`` bits over all segments at most, so what is broadcast
is bounded. It may name hashes that occurred once, never misses one that occurred twice. Beyond some
MAX_BITS / 8 repeated hashes more and more once-seen ones are suspected, which costs shuffle, not correctness.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

MAX_BITS = 1 << 28
#: Hashes of a segment, about; bits for each.
SEGMENT, BITS = 1 << 19, 16
#: Hashes that a task reduces before it sends them.
AT_ONCE = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Filter:
    """A Bloom filter in segments: bytes of (segments, bits of a segment / 8), flat. Both are powers of two."""

    data: np.ndarray
    segments: int

    @staticmethod
    def empty(segments: int, bits: int) -> Filter:
        return Filter(np.zeros(segments * bits // 8, np.uint8), segments)

    def _positions(self, h: np.ndarray) -> list[np.ndarray]:
        """Two bit positions of each hash, both in the segment that its top bits name."""
        bits = np.uint64(len(self.data) * 8 // self.segments)
        base = segment_of(h, self.segments) * bits
        return [base + (x & (bits - np.uint64(1))) for x in (h, (h * _ODD) >> np.uint64(20))]

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes the filter may hold."""
        out = np.ones(len(h), bool)
        for p in self._positions(h):
            out &= (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def put(self, h: np.ndarray) -> None:
        for p in self._positions(h):
            np.bitwise_or.at(self.data, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))

    def folded(self, bits: int) -> np.ndarray:
        """One segment's bytes on ``bits`` bits: positions are low bits of the hash, so halves may be laid over each other."""
        data = self.data
        while len(data) * 8 > bits:
            half = len(data) // 2
            data = data[:half] | data[half:]
        return data


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return h >> np.uint64(64 - segments.bit_length() + 1) if segments > 1 else np.zeros(len(h), np.uint64)


def shape(n: int) -> tuple[int, int, int]:
    """(segments, bits of a segment while it is filled, bits of it in the folded filter) for ``n`` hashes."""
    segments = 1 << max(0, (n - 1) // SEGMENT).bit_length()
    segments = min(segments, MAX_BITS // 64)
    bits = 1 << max(6, (BITS * max(1, -(-n // segments)) - 1).bit_length())
    return segments, bits, min(bits, MAX_BITS // segments)


def seen(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], n: int, twice: bool = True) -> Broadcast:
    """The broadcast filter over what ``hashes`` gives for the batches of ``df``, some ``n`` in all: of those seen twice, or of all."""
    segments, bits, few = shape(n)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, count = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(segment_of(u, segments), np.arange(segments + 1)) if segments <= len(u) else np.r_[np.flatnonzero(np.r_[True, np.diff(segment_of(u, segments)) != 0]), len(u)]
        own = [(a, b) for a, b in zip(cuts.tolist(), cuts[1:].tolist()) if a < b]
        for i in range(0, len(own), 1024):
            some = own[i : i + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(segment_of(u[a : a + 1], segments)[0]) for a, _ in some], pa.int32()), pa.array([u[a:b].tobytes() for a, b in some], pa.binary()), pa.array([np.packbits(count[a:b] > 1).tobytes() for a, b in some], pa.binary())],
                ["segment", "hashes", "again"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(hashes(b))
            size += len(held[-1])
            if size > AT_ONCE:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, more = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(more if twice else once).folded(few).tobytes()], pa.binary())], ["segment", "bits"])

        for b in batches:
            for s, data, again in zip(b.column("segment").to_pylist(), b.column("hashes"), b.column("again")):
                if s != now:
                    if now is not None:
                        yield out()
                    now, once, more = s, Filter.empty(1, bits), Filter.empty(1, bits)
                h = np.frombuffer(data.as_py(), np.uint64)
                seen_here = np.unpackbits(np.frombuffer(again.as_py(), np.uint8), count=len(h)).astype(bool)
                more.put(h[seen_here | once.has(h)])
                once.put(h)
        if now is not None:
            yield out()

    parts = df.mapInArrow(deal, "segment int, hashes binary, again binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(fill, "segment int, bits binary")
    whole = Filter.empty(segments, few)
    for r in parts.collect():  # MAX_BITS / 8 bytes at most
        whole.data[r["segment"] * few // 8 : (r["segment"] + 1) * few // 8] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole)
