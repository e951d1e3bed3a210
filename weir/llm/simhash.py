"""SimHash near-duplicates, linked by generalised pigeonhole.

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. The bits are split into m
parts, correlated bits together, and each part i gets a threshold t_i (-1: not probed) with
sum(t_i) >= distance - m + 1; then linked fingerprints lie within t_i of each other in some part.
Thresholds and m come from a dynamic programme over estimated candidate counts: how often parts
of sampled fingerprints lie within t of each other (a bounded sample; it decides cost, not
results). A part is probed from both sides: fingerprints within 2r in a part have a common value
within r of both, so each emits its ball of radius r.

Distinct fingerprints that meet in a value are verified in that group, and only edges that span
the group's components leave it. Groups of more than ``GROUP`` members are split again: of
``distance`` + 1 parts of all bits linked members share one, so each member goes to as many smaller
groups, never to all others. Components are found by star rounds on distinct fingerprints.

Edge cases: null text counts as empty; texts without words have fingerprint zero and link like
others; repeated rows and equal texts share a fingerprint; null doc_id is the name of a component
only where no other id is in it; an empty table gives an empty result; extra columns are ignored
by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, packed, settle, slices, stage, staged, texts
from .components import components
from .substring import mix

SAMPLE = 2048
#: Members of a group that are verified together; larger groups are split by further bits.
GROUP = 8192
#: Tasks over which the members of one component are spread.
SALT = 16
#: The primes of XXH64.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
#: Groups up to this size are compared pair by pair in bulk, larger ones by search from member to member.
BULK = 8


def xxh64(raw: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte ranges of ``raw`` at once: each step of the hash is one numpy operation over all ranges that take it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in PRIMES)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each position
    half = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    step = lambda acc, x: turn(acc + x * p2, 31) * p1
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + p5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), x, np.uint64) for x in (s + p1 + p2, s + p2, s, s - p1)]
            at, left = start[long], size[long] // 32
            for stripe in range(int(left.max())):
                on = np.flatnonzero(left > stripe)
                for i, lane in enumerate(lanes):
                    lane[on] = step(lane[on], wide[at[on] + (32 * stripe + 8 * i)])
            one = sum(turn(lane, n) for lane, n in zip(lanes, (1, 7, 12, 18)))
            for lane in lanes:
                one = (one ^ step(np.uint64(0), lane)) * p1 + p4
            h[long] = one
        h += size.astype(np.uint64)
        at, left = start + size // 32 * 32, size % 32
        for n in range(3):
            on = np.flatnonzero(left >= 8 * (n + 1))
            h[on] = turn(h[on] ^ step(np.uint64(0), wide[at[on] + 8 * n]), 27) * p1 + p4
        at, left = at + left // 8 * 8, left % 8
        on = np.flatnonzero(left >= 4)
        h[on] = turn(h[on] ^ half[at[on]].astype(np.uint64) * p1, 23) * p2 + p3
        at, left = at + left // 4 * 4, left % 4
        for n in range(3):
            on = np.flatnonzero(left > n)
            h[on] = turn(h[on] ^ raw[at[on] + n].astype(np.uint64) * p5, 11) * p1
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)


def fingerprints_of(found: list[bytes], words_in: int = 4) -> np.ndarray:
    """The 64-bit SimHash of each text's word shingles; 0 without words."""
    split = [t.translate(LOWER).split() for t in found]
    n_words = np.array([*map(len, split)], np.int64)
    flat = b" ".join([w for ws in split for w in ws])
    size = np.fromiter((len(w) for ws in split for w in ws), np.int64, int(n_words.sum()))
    end = np.cumsum(size + 1) - 1  # of each word in flat
    n = np.where(n_words > 0, np.maximum(1, n_words - words_in + 1), 0)  # shingles
    out = np.zeros(len(found), np.uint64)
    some = np.flatnonzero(n)
    heads = np.cumsum(n[some]) - n[some]
    text = np.repeat(some, n[some])
    first = (np.cumsum(n_words) - n_words)[text] + np.arange(len(text)) - np.repeat(heads, n[some])
    last = first + np.minimum(words_in, n_words[text]) - 1
    start = end[first] - size[first]
    h = xxh64(np.frombuffer(flat, np.uint8), start, end[last] - start, 42)
    count = np.zeros((len(some), 64), np.int64)
    for a in range(0, len(h), 1 << 16):  # a long text passes in parts
        b = min(len(h), a + (1 << 16))
        bits = np.unpackbits(h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = np.searchsorted(heads, np.arange(a, b), "right") - 1
        cut = np.flatnonzero(np.r_[True, np.diff(own) != 0])
        count[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    if len(some):
        out[some] = np.packbits(2 * count > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp (the fingerprint's bits as a long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            fp = fingerprints_of(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


@dataclass
class Probe:
    """Parts to probe: the bits of each and the radius of the ball that is emitted."""

    parts: list[list[int]]
    radii: list[int]


def _grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m parts of equal size, correlated bits together."""
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    np.fill_diagonal(c, 0)
    left, out = list(range(64)), []
    for i in range(m):
        size = 64 * (i + 1) // m - 64 * i // m
        part = [left.pop(int(c[np.ix_(left, left)].sum(1).argmax()))]
        while len(part) < size:
            part.append(left.pop(int(c[np.ix_(left, part)].mean(1).argmax())))
        out.append(sorted(part))
    return out


def plan(sample: np.ndarray, n: int, distance: int, emit_cost: float = 3e-6, pair_cost: float = 2e-8) -> Probe:
    """The parts and radii with the least estimated cost for n fingerprints like the sample's."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    best: tuple[float, Probe] | None = None
    for m in range(1, distance + 2):
        parts = _grouped_bits(bits, m)
        # cost[i][t + 1]: of giving part i the threshold t
        cost = []
        for part in parts:
            w, one = len(part), bits[:, part].astype(np.float32)
            apart = np.rint(one.sum(1)[:, None] + one.sum(1)[None] - 2 * one @ one.T).astype(np.int64)
            near = np.bincount(apart.ravel(), minlength=w + 1)
            near[0] -= len(bits)  # a fingerprint and itself
            row = [0.0]
            for t in range(distance + 1):
                ball = sum(comb(w, j) for j in range(t + 1))
                p = max(near[: t + 1].sum() / max(1, len(bits) * (len(bits) - 1)), ball / 2.0**w)
                row.append(n * sum(comb(w, j) for j in range((t + 1) // 2 + 1)) * emit_cost + n * n / 2 * p * pair_cost)
            cost.append(row)
        # Thresholds t_i >= -1 with sum(t_i) = distance - m + 1, that is sum(t_i + 1) = distance + 1.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t in range(-1, distance + 1):
                    to = min(distance + 1, s + t + 1)
                    if to not in new or c + row[t + 1] < new[to][0]:
                        new[to] = (c + row[t + 1], [*ts, t])
            table = new
        c, ts = table[distance + 1]
        if best is None or c < best[0]:
            use = [(p, (t + 1) // 2) for p, t in zip(parts, ts) if t >= 0]
            best = (c, Probe([p for p, _ in use], [r for _, r in use]))
    return best[1]


def _balls(probe: Probe) -> list[tuple[np.uint64, np.ndarray, np.uint64]]:
    """(mask, flips, salt) of each part."""
    out = []
    for i, (part, r) in enumerate(zip(probe.parts, probe.radii)):
        one = [1 << b for b in part]
        flips = [0]
        level = [(0, -1)]
        for _ in range(r):
            level = [(f | one[j], j) for f, last in level for j in range(last + 1, len(one))]
            flips += [f for f, _ in level]
        out.append((np.uint64(sum(one)), np.array(flips, np.uint64), np.uint64(i)))
    return out


def _spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join the members of a group as links do: from each member reached to new ones."""
    left, out = np.unique(fps), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            root, front = front[0], front[1:]
            near = np.bitwise_count(left ^ root) <= distance
            found = left[near]
            out += [(root, f) for f in found]
            front, left = np.concatenate([front, found]), left[~near]
    return out


def _verify(distance: int, limit: int | None):
    """From rows (key, cell, fp) sorted by key and cell: edges, and the rows of groups over ``limit``."""

    def table(a, b, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64) if x is not None else [None] * len(b), pa.int64()) for x in (a, b, key)], ["a", "b", "key"])

    def edges(fp: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
        """``heads``: where groups start in fp."""
        size = np.diff(np.r_[heads, len(fp)])
        a, b = [], []
        of = np.repeat(np.where(size <= BULK, np.arange(len(heads)), -1), size)
        for step in range(1, min(BULK, int(size.max(initial=0)))):
            x, y = fp[:-step], fp[step:]
            near = (of[:-step] == of[step:]) & (of[step:] >= 0) & (x != y)
            near[near] = np.bitwise_count(x[near] ^ y[near]) <= distance
            a.append(x[near])
            b.append(y[near])
        far = [e for i in np.flatnonzero(size > BULK) for e in _spanning(fp[heads[i] : heads[i] + size[i]], distance)]
        a.append(np.array([e[0] for e in far], np.uint64))
        b.append(np.array([e[1] for e in far], np.uint64))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            both = np.unique(np.stack([a, b], 1), axis=0)
            a, b = both[:, 0], both[:, 1]
        return table(a.view(np.int64), b.view(np.int64), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, cell, fp, over = none, none, none.view(np.uint64), False
        for b in batches:
            key = np.r_[key, b.column("key").to_numpy()]
            cell = np.r_[cell, b.column("cell").to_numpy()]
            fp = np.concatenate([fp, b.column("fp").to_numpy().view(np.uint64)])
            heads = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(cell) != 0)])
            last = heads[-1]  # this group may go on
            if over and len(heads) > 1:
                yield table(None, fp[: heads[1]].view(np.int64), key[: heads[1]])
                key, cell, fp, over = key[heads[1] :], cell[heads[1] :], fp[heads[1] :], False
                heads, last = heads[1:] - heads[1], last - heads[1]
            if not over and last:
                yield from whole(key[:last], fp[:last], heads[:-1])
                key, cell, fp = key[last:], cell[last:], fp[last:]
            if limit and (over or len(fp) > limit):
                yield table(None, fp.view(np.int64), key)
                over = True
                key, cell, fp = key[-1:], cell[-1:], fp[-1:]  # one is kept to know the group; it is named twice
        if len(fp) and not over:
            yield from whole(key, fp, np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(cell) != 0)]))

    def whole(key, fp, heads) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.r_[heads, len(fp)])
        big = size > limit if limit else np.zeros(len(size), bool)
        of = np.repeat(big, size)
        if big.any():
            yield table(None, fp[of].view(np.int64), key[of])
        some = np.repeat((size > 1) & ~big, size)
        kept = size[(size > 1) & ~big]
        if len(kept):
            yield edges(fp[some], np.cumsum(kept) - kept)

    return run


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges a, b between the fingerprints (column fp) of ``distinct`` that connect all linked ones."""
    n = distinct.count()
    sample = [r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    balls = _balls(plan(np.array(sample, np.int64).view(np.uint64), n, distance))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                fp = b.column("fp")[i : i + 4096].to_numpy().view(np.uint64)
                for mask, flips, salt in balls:
                    for j in range(0, len(flips), 128):
                        f = flips[j : j + 128]
                        key = mix(((fp & mask)[:, None] ^ f[None]) * np.uint64(2) + np.uint64(1) + mix(np.full(1, salt, np.uint64)))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(fp, len(f)).view(np.int64))], ["key", "fp"])

    rows = distinct.select("fp").mapInArrow(emit, "key long, fp long").withColumn("cell", F.lit(0).cast("long"))
    out = "a long, b long, key long"
    first = stage(rows.repartition("key").sortWithinPartitions("key", "cell").mapInArrow(_verify(distance, GROUP), out), "links")
    edges = first.where("a is not null").select("a", "b")
    large = first.where("key is not null").select("key", F.col("b").alias("fp")).distinct()
    if large.limit(1).count():
        masks = [sum(1 << b for b in range(i, 64, distance + 1)) for i in range(distance + 1)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        cell = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]))
        cells = large.select("key", cell.alias("cell"), "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
        edges = edges.unionByName(cells.mapInArrow(_verify(distance, None), out).select("a", "b"))
    return edges


def grouped(docs: DataFrame, distance: int) -> DataFrame:
    """doc_id, th, fp, root (names the component), component_id of every document."""
    own = stage(fingerprints(docs), "fingerprints", narrow=False)
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    before = staged()
    stars = components(links(distinct, distance))
    settle(docs.sparkSession, before, stars)
    # Only fingerprints with links need their component's name; a component with a third of them meets it in SALT tasks.
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    members = stage(members.join(distinct, "fp"), "members")
    names = members.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    named = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int")).join(names, ["root", "salt"])
    alone = distinct.join(members.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("rep").alias("component_id"))
    return own.join(alone.unionByName(named.select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return grouped(docs, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4) -> DataFrame:
    """``docs`` with one document of each component: of those with its smallest doc_id the one of smallest text hash.

    Of several rows with that doc_id and text one stays, any of them if they differ in other columns.
    """
    before = staged()
    rows = stage(grouped(docs, distance).groupBy("root", "component_id", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")), "components")
    # Documents with another id than their component's go; of the others there are several only where ids repeat or are null.
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.where(named).groupBy("root").agg(F.min("th").alias("first"))
    judged = rows.where(named).join(first, "root").select("doc_id", "th", "n", (F.col("th") == F.col("first")).alias("stays"))
    judged = stage(judged.unionByName(rows.where(~named).select("doc_id", "th", "n", F.lit(False).alias("stays"))), "kept")
    settle(docs.sparkSession, before, judged)
    gone = judged.where("not stays").select(F.col("doc_id").alias("gone"), F.col("th").alias("gone_th"))
    out = packed(docs, docs.columns, id=F.col("doc_id").cast("long"), th=F.xxhash64("text"))
    out = out.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("th") == F.col("gone_th")), "left_anti")
    if judged.where("stays and n > 1").limit(1).count():  # a document that is there several times stays once
        out = out.dropDuplicates(["id", "th"])  # reduced before the shuffle, so its copies don't meet in one task
    return out.select("row.*")
