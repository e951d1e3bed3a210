"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers, floor(scale * x). Index rows are dealt to cells of bounded
size; queries, in blocks of bounded size, visit every cell. In a cell each dimension's value,
less its smallest, is cut to ``SLICES`` high bits and stored as bit slices over the rows. A query
weighs dimensions by its own high digits; slices shifted by the weights' set bits are added with
carry-save adders, bitmaps against bitmaps, which gives a coarse score as slices. From the most
significant slice downward the k-th largest coarse score is found, a bound on what the cut bits
can add widens it, and the rows that remain are scored exactly. A cell's best k per query meet
in a final top-k by query.

Edge cases: vectors that are null or empty, or hold a null, NaN or infinite component, take no
part; a component's code, or a score to be returned, beyond 64 bits is an error, as in SQL; a query meets only vectors of its own
dimension; rows with a query's vec_id are its own rows and no candidates for it; equal rows count
once; null vec_id takes no part; ties go to the smaller vec_id; with fewer than k candidates all are
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SCALE = 1024
#: High bits of each dimension that are sliced; high digits of a query's weights.
SLICES, DIGITS = 9, 9
CELL_ROWS, QUERY_ROWS = 16_384, 4_096


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, codes (little-endian int64 values of floor(scale * x)), once for each distinct pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            col = b.column("embedding")
            flat = col.flatten() if col.null_count < len(col) else pa.array([], pa.float64())
            flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null reads as NaN
            fine = np.isfinite(flat)
            with np.errstate(over="ignore"):
                x = np.floor(np.where(fine, flat, 0) * scale)
            held = np.abs(x) < 2.0**63
            size = np.nan_to_num(np.array(col.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
            end = np.cumsum(size)
            codes = np.where(held, x, 0).astype("<i8")
            bad, wide = np.r_[0, np.cumsum(~fine)], np.r_[0, np.cumsum(~held)]
            for i, e, n in zip(b.column("vec_id").to_pylist(), end.tolist(), size.tolist()):
                if n and i is not None and bad[e] == bad[e - n]:
                    if wide[e] != wide[e - n]:
                        raise OverflowError(f"vec_id {i}: a component times {scale} is beyond 64 bits")
                    ids.append(i)
                    out.append(codes[e - n : e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "codes"])

    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "embedding").mapInArrow(run, "vec_id long, codes binary")
    return rows.distinct()


class BitSlices:
    """A bit-sliced index of an integer matrix (rows, dimensions)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes.astype(np.int64)
        self.n, self.dims = codes.shape
        self.low = self.codes.min(0)
        self.most = max(int(self.codes.max(initial=0)), -int(self.codes.min(initial=0)))
        above = self.codes.view(np.uint64) - self.low.view(np.uint64)  # may take all 64 bits
        self.cut = max(0, int(above.max(initial=0)).bit_length() - SLICES)
        high = (above >> np.uint64(self.cut)).astype(np.int64)
        pad = -self.n % 64
        bits = ((high.T[:, None, :] >> np.arange(SLICES)[:, None]) & 1).astype(np.uint8)
        bits = np.pad(bits, ((0, 0), (0, 0), (0, pad)))
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)  # (dims, SLICES, words)
        self.every = np.packbits(np.r_[np.ones(self.n, np.uint8), np.zeros(pad, np.uint8)], bitorder="little").view(np.uint64)
        rest = (above - (high.view(np.uint64) << np.uint64(self.cut))).astype(np.int64) - ((1 << self.cut) - 1) / 2
        self.rest = float(np.sqrt((rest**2).sum(1)).max(initial=0))  # longest vector of cut bits, about their middle
        self.top = (1 << SLICES) - 1
        middle = (high - self.top / 2) * float(1 << self.cut)
        self.high = float(np.sqrt((middle**2).sum(1)).max(initial=0))

    def coarse(self, q: np.ndarray) -> tuple[list[np.ndarray], int, float]:
        """Slices of sum(w_d * high_d) up to a constant, least significant first; w's cut; bound on the error of a score."""
        cut = max(0, int(np.abs(q).max(initial=0)).bit_length() - DIGITS)
        w = np.rint(q / (1 << cut)).astype(np.int64)
        size = np.abs(w)
        columns: list[list[np.ndarray]] = [[] for _ in range(SLICES + DIGITS + 2)]
        for digit in range(int(size.max(initial=0)).bit_length()):
            plus, minus = (size >> digit & 1 & (w > 0)).astype(bool), (size >> digit & 1 & (w < 0)).astype(bool)
            # A negative weight counts the complement's slices: a constant more for every row.
            part = np.concatenate([self.slices[plus], ~self.slices[minus] & self.every])
            for s in range(SLICES):
                columns[digit + s].append(part[:, s])
        out, carried = [], None
        at = 0
        while at < len(columns) or carried is not None:
            have = columns[at] if at < len(columns) else []
            bits = np.concatenate([*have, *([carried] if carried is not None else [])]) if have or carried is not None else np.zeros((0, len(self.every)), np.uint64)
            carries = []
            while len(bits) > 1:  # full adders on thirds, a half adder on a last pair
                third = len(bits) // 3
                if third:
                    a, b, c = bits[:third], bits[third : 2 * third], bits[2 * third : 3 * third]
                    x = a ^ b
                    carries.append((a & b) | (x & c))
                    bits = np.concatenate([x ^ c, bits[3 * third :]])
                else:
                    carries.append(bits[:1] & bits[1:])
                    bits = bits[:1] ^ bits[1:]
            out.append(bits[0] if len(bits) else np.zeros_like(self.every))
            carried = np.concatenate(carries) if carries else None
            at += 1
        short = q - (w << cut)
        error = float(np.sqrt((q.astype(np.float64) ** 2).sum()) * self.rest + np.sqrt((short.astype(np.float64) ** 2).sum()) * self.high)
        return out, cut, error

    def candidates(self, q: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Row numbers that hold the k best of the allowed rows (a bitmap), and maybe more."""
        slices, cut, error = self.coarse(q)
        sure, tied, value = np.zeros_like(allowed), allowed.copy(), 0
        for i in range(len(slices) - 1, -1, -1):
            more = sure | (tied & slices[i])
            if int(np.bitwise_count(more).sum()) >= k:
                tied, value = tied & slices[i], value | 1 << i
            else:
                sure, tied = more, tied & ~slices[i]
        # value: the k-th largest coarse score (0 with fewer rows). Rows may trail it by twice the error.
        least = value - int(np.ceil(2 * error / (1 << (self.cut + cut)))) - 1
        if least <= 0:
            keep = allowed
        else:
            above, equal = np.zeros_like(allowed), allowed
            for i in range(max(len(slices), least.bit_length()) - 1, -1, -1):
                s = slices[i] if i < len(slices) else np.zeros_like(allowed)
                if least >> i & 1:
                    equal = equal & s
                else:
                    above, equal = above | (equal & s), equal & ~s
            keep = above | equal
        return np.flatnonzero(np.unpackbits(keep.view(np.uint8), bitorder="little")[: self.n])

    def search(self, ids: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the k best rows but those whose id is ``own``."""
        allowed = self.every
        mine = np.flatnonzero(ids == own)
        if len(mine):
            allowed = allowed.copy()
            for i in mine.tolist():
                allowed[i >> 6] &= ~np.uint64(1 << (i & 63))
        rows = self.candidates(q, k, allowed)
        if self.dims * self.most * int(np.abs(q).max(initial=0)) >= 2**63:  # products or sums may not fit
            return self._ranked(ids[rows], self.codes[rows], q, k)
        score = self.codes[rows] @ q
        best = np.lexsort((ids[rows], -score))[:k]
        return ids[rows[best]], score[best]

    @staticmethod
    def _ranked(ids: np.ndarray, codes: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``, in integers of any size."""
        score = (codes.astype(object) @ q.astype(object)).tolist()
        best = sorted(zip(score, ids.tolist()), key=lambda s: (-s[0], s[1]))[:k]
        if any(not -(2**63) <= s < 2**63 for s, _ in best):
            raise OverflowError("a score is beyond 64 bits")
        return np.array([i for _, i in best], np.int64), np.array([s for s, _ in best], np.int64)


def _tables(ids: pa.Array, codes: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Dimension -> (ids, matrix)."""
    by: dict[int, tuple[list, list]] = {}
    for i, c in zip(ids.to_pylist(), codes.to_pylist()):
        a, b = by.setdefault(len(c) // 8, ([], []))
        a.append(i)
        b.append(c)
    return {d: (np.array(a, np.int64), np.frombuffer(b"".join(b), "<i8").reshape(-1, d)) for d, (a, b) in by.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of each query's codes with other rows'.

    ``queries`` has rows (vec_id, embedding) as ``vectors`` has.
    """
    index, asked = stage(quantise(vectors, scale), "codes"), stage(quantise(queries, scale), "queries")
    cells, blocks = max(1, -(-index.count() // CELL_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = index.select("vec_id", "codes", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(cells)).cast("int").alias("cell"), numbers(blocks).alias("block"))
    asked = asked.select("vec_id", "codes", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(blocks)).cast("int").alias("block"), numbers(cells).alias("cell"))

    def search(rows: pa.Table, qs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        have = {d: (i, BitSlices(m)) for d, (i, m) in _tables(rows["vec_id"], rows["codes"]).items()} if qs.num_rows else {}
        for d, (ids, matrix) in _tables(qs["vec_id"], qs["codes"]).items():
            if d in have:
                own_ids, slices = have[d]
                for q, code in zip(ids.tolist(), matrix.astype(np.int64)):
                    found, score = slices.search(own_ids, q, code, k)
                    for o, x in zip(out, (np.full(len(found), q), found, score)):
                        o.append(x)
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for n, o in zip(("query_id", "vec_id", "score"), out)})

    parts = index.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    # Unequal rows of one vec_id are candidates of their own; equal (id, score) pairs of a query count once.
    parts = parts.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
