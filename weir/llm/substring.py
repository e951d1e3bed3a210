"""Substring dedup: repeated windows of words, by suffix subtrees over prefix-partitioned groups.

A suffix starts at every word that has ``window`` words before its text ends. One path at every size:

1. Partition. Of the k-word grams in a suffix's first ``window`` words, the one of smallest hash is its
   anchor; equal windows have equal anchors, so the hash range of the anchor is the suffix's group. Groups are
   so many that one fits in memory. Neighbouring suffixes mostly share an anchor and travel as one piece of
   text: about 3.4 times the text, where suffixes by literal first words would need 20 times. Where a sample
   shows an anchor to be hot, its suffixes get a longer key: all words of the window.
2. Pre-aggregation. A task ships equal pieces once, with their earliest place; the others are repeats at once. Its
   pieces for a group are packed and compressed; where it has hardly more than one for each group, as on huge tables, they are rows.
3. Subtrees. In a group, pieces whose anchor no other piece has are passed over. Over the rest the suffix tree
   is evaluated top down, from depth ``window`` on: suffixes below one node of that depth are equal
   windows, and all but the earliest are repeats. ``maximal_repeats`` goes on to the deeper nodes, each
   of which is a repeat that no longer one replaces.

Repeats go back to their documents as intervals of words; one that runs through several groups
is the union of theirs. Hashes partition and propose; equality is decided on words.

Edge cases: null or empty text has no words; texts shorter than a window lose nothing; rows of
equal doc_id and text are one document (what one keeps, all keep), rows of equal doc_id and other
text follow each other by text hash; null doc_id comes first; an empty table gives an empty
result; extra columns stay as they are in ``dedup_passages``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, packed, slices, text_view, texts, unpacked

GRAM = 6
#: Pieces from which an anchor's suffixes are grouped by their whole window (a millionth of all, if that is more).
HOT = 4096
#: One document in so many is looked at for hot anchors. This decides cost, never results.
SAMPLED = 16
#: Suffixes of one piece, at most; bytes of text that a task turns into pieces at once.
RUN, CHUNK = 256, 12 << 20
#: Pieces that a task must have for a group, on average, to pack them; fewer travel as rows of their own.
FEW = 8
#: Bytes of pieces in a group, about; bytes from which a group's equal pieces are reduced before all have come.
GROUP, AT_ONCE = 12 << 20, 48 << 20

_ZSTD = pa.Codec("zstd", 5)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, text number, hash) of every word of the texts."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(raw)), out=sums[1:])
    h = mix((sums[end] - sums[start]) * _powers(_B_INV, len(raw))[start])
    return start, end, np.searchsorted(off, start, "right") - 1, h


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _C
        out += h[j : j + n]
    return mix(out)


def _smallest(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive items."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


class Anchors:
    """The suffixes of one slice of texts: ``low`` is each window's smallest gram hash, ``valid`` says which windows lie in one text."""

    def __init__(self, off: np.ndarray, raw: np.ndarray, window: int):
        self.start, self.end, self.text, self.hash = words_of(off, raw)
        k = min(GRAM, window)
        self.span = window - k + 1  # grams in a window
        self.grams = _rolling(self.hash, k)
        self.low = _smallest(self.grams, self.span)
        n = len(self.low)
        self.valid = self.text[:n] == self.text[window - 1 : window - 1 + n]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of the runs of valid windows with one anchor, at most RUN long."""
        at = np.flatnonzero(self.valid)
        if not len(at):
            return at, at
        new = np.r_[True, (np.diff(at) > 1) | (self.low[at[1:]] != self.low[at[:-1]]) | (self.text[at[1:]] != self.text[at[:-1]])]
        number = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= number % RUN == 0
        first = np.flatnonzero(new)
        return at[first], at[np.r_[first[1:] - 1, len(at) - 1]]

    def loops(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which runs meet their anchor more than once, so that they may repeat themselves."""
        if not len(first):
            return np.zeros(0, bool)
        n = last - first + self.span
        head = np.cumsum(n) - n
        at = np.repeat(first - head, n) + np.arange(int(n.sum()))
        return np.add.reduceat(self.grams[at] == np.repeat(self.low[first], n), head, dtype=np.int64) > 1


@dataclass
class Pieces:
    """Pieces of text and where they are: key, id (0 for null), known (id is not null), th (text hash), first word; loops: may repeat itself.

    Packing keeps the low 32 bits of the key; the high ones are the group's.
    """

    text: list[bytes]
    key: np.ndarray
    id: np.ndarray
    known: np.ndarray
    th: np.ndarray
    first: np.ndarray
    loops: np.ndarray

    def __len__(self) -> int:
        return len(self.text)

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces([self.text[i] for i in at.tolist()], self.key[at], self.id[at], self.known[at], self.th[at], self.first[at], self.loops[at])

    def places(self) -> np.ndarray:
        """A number for each piece: equal for equal places, smaller for earlier ones."""
        order = np.lexsort((self.first, self.th, self.id, self.known))
        new = np.zeros(len(order), bool)
        for c in (self.first, self.th, self.id, self.known):
            new[1:] |= c[order[1:]] != c[order[:-1]]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    @staticmethod
    def join(parts: list[Pieces]) -> Pieces:
        return Pieces([t for p in parts for t in p.text], *(np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "id", "known", "th", "first", "loops")))

    def pack(self) -> bytes:
        """All as compressed bytes; numbers by byte of significance, since the high ones hardly differ."""
        base = int(self.id.min())
        numbers = ((self.id - base).view("<u8"), self.th.astype("<i8"), self.first.astype("<u4"), np.array([*map(len, self.text)], "<u4"), self.key.astype("<u4"), self.known + 2 * self.loops.astype("u1"))
        flat = b"".join([np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in numbers])
        text = b"".join(self.text)
        small, body = _ZSTD.compress(flat, asbytes=True), _ZSTD.compress(text, asbytes=True)  # apart, since they differ in kind
        return b"".join([np.array([len(self), len(small), len(text)], "<u4").tobytes(), np.array([base], "<i8").tobytes(), small, body])

    @staticmethod
    def unpack(data: bytes) -> Pieces:
        n, small, size = np.frombuffer(data, "<u4", 3).tolist()
        kinds = ("<u8", "<i8", "<u4", "<u4", "<u4", "u1")
        flat = _ZSTD.decompress(data[20 : 20 + small], n * sum(np.dtype(k).itemsize for k in kinds), asbytes=True)
        text = _ZSTD.decompress(data[20 + small :], size, asbytes=True)
        at, columns = 0, []
        for kind in kinds:
            width = np.dtype(kind).itemsize
            columns.append(np.ascontiguousarray(np.frombuffer(flat, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
            at += n * width
        cuts = np.cumsum(np.r_[0, columns[3]]).tolist()
        base = np.frombuffer(data, "<i8", 1, 12)
        return Pieces([text[a:b] for a, b in zip(cuts, cuts[1:])], columns[4], columns[0].view("<i8") + base, (columns[5] & 1).astype(bool), columns[1], columns[2].astype(np.int64), columns[5] > 1)


def _distinct(p: Pieces) -> tuple[Pieces, Pieces]:
    """(each distinct text with its earliest place, the pieces that repeat one from another place)."""
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(t, i) for i, t in enumerate(p.text)], np.int64)
    if len(number) == len(p):
        return p, p.take(np.zeros(0, np.int64))
    place = p.places()
    order = np.lexsort((place, same))
    head = np.r_[True, np.diff(same[order]) != 0]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return p.take(np.sort(order[head])), p.take(order[place[order] != place[lead]])


class Subtree:
    """The deep part of the suffix tree over some pieces, evaluated top down: nodes at least ``window`` words deep.

    ``ids`` are the words of all pieces as numbers, ``sizes`` the pieces' numbers of words. Suffixes end
    with their piece. ``node[i]`` names the node that suffix i passes at depth ``window``, -1 where it is alone there.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, window: int):
        self.ids, self.window = ids, window
        ends = np.cumsum(sizes)
        n = np.maximum(sizes - window + 1, 0)
        self.piece = np.repeat(np.arange(len(sizes)), n)
        self.inner = np.arange(len(self.piece)) - np.repeat(np.cumsum(n) - n, n)
        self.start = (ends - sizes)[self.piece] + self.inner
        self.end = ends[self.piece]
        h = _rolling(mix(ids.astype(np.uint64)), window)[self.start]
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order[1:]] != h[order[:-1]]] if len(order) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1 if len(order) else new
        order, group = order[many], group[many]
        self.node = np.full(len(self.start), -1, np.int64)
        if len(order):
            words = self.start[order]
            lead = words[np.maximum.accumulate(np.where(np.r_[True, np.diff(group) != 0], np.arange(len(group)), 0))]
            equal = np.ones(len(order), bool)
            for d in range(window):
                equal &= ids[words + d] == ids[lead + d]
            if not equal.all():  # different windows of one hash: name them by their words
                group = np.unique(ids[words[:, None] + np.arange(window)], axis=0, return_inverse=True)[1].ravel()
                kept = np.bincount(group)[group] > 1
                order, group = order[kept], group[kept]
            self.node[order] = group

    def branching(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, a suffix below each node, number of suffixes below it) of the branching nodes, level by level."""
        at = np.flatnonzero(self.node >= 0)
        node = np.unique(self.node[at], return_inverse=True)[1]
        depth = self.window
        while len(at):
            inside = self.start[at] + depth < self.end[at]
            word = np.where(inside, self.ids[np.minimum(self.start[at] + depth, len(self.ids) - 1)], -1 - np.arange(len(at)))  # ends differ from each other
            order = np.lexsort((word, node))
            a, n, w = at[order], node[order], word[order]
            top = np.r_[True, n[1:] != n[:-1]]
            child = np.cumsum(top | np.r_[True, w[1:] != w[:-1]]) - 1
            children = np.bincount(n, np.r_[True, child[1:] != child[:-1]], minlength=n.max() + 1)
            split = children[n[top]] > 1
            if split.any():
                yield depth, a[top][split], np.bincount(n)[n[top]][split]
            go = np.bincount(child)[child] > 1
            at, node = a[go], np.unique(child[go], return_inverse=True)[1]
            depth += 1


def _tree(p: Pieces, window: int) -> Subtree:
    number: dict[bytes, int] = {}
    sizes = np.array([t.count(b" ") + 1 for t in p.text], np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for t in p.text for w in t.split(b" ")), np.int64, int(sizes.sum()))
    return Subtree(ids, sizes, window)


def _shared(p: Pieces) -> Pieces:
    """The pieces whose key another piece has too, or that may repeat themselves."""
    _, back, n = np.unique(p.key, return_inverse=True, return_counts=True)
    return p.take(np.flatnonzero((n[back] > 1) | p.loops))


def repeats_in(p: Pieces, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, first word, last word + 1) of the windows in distinct pieces that are equal to an earlier one."""
    tree = _tree(p, window)
    at = np.flatnonzero(tree.node >= 0)
    if not len(at):
        return at, at, at
    row, first = tree.piece[at], tree.inner[at] + p.first[tree.piece[at]]
    place = Pieces([b""] * len(at), row, p.id[row], p.known[row], p.th[row], first, row > -1).places()
    order = np.lexsort((place, tree.node[at]))
    head = np.r_[True, np.diff(tree.node[at][order]) != 0]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    hit = np.sort(order[place[order] != place[lead]])  # back in order of rows and words
    return row[hit], first[hit], first[hit] + window


def _spans(p: Pieces, row: np.ndarray, first: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    """Intervals of words in the documents of pieces, those that touch joined."""
    place = np.lexsort((first, p.th[row], p.id[row], p.known[row]))
    row, first, to = row[place], first[place], to[place]
    if len(row):
        new = np.r_[True, (p.id[row[1:]] != p.id[row[:-1]]) | (p.known[row[1:]] != p.known[row[:-1]]) | (p.th[row[1:]] != p.th[row[:-1]])]
        doc = np.cumsum(new)
        far = int(to.max()) + 1  # documents one after the other on one axis
        reach = np.maximum.accumulate(to + doc * far)
        new[1:] |= (first + doc * far)[1:] > reach[:-1]
        at = np.flatnonzero(new)
        to = reach[np.r_[at[1:] - 1, len(row) - 1]] - doc[at] * far
        row, first = row[at], first[at]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(p.id[row], pa.int64(), mask=~p.known[row]), pa.array(p.th[row], pa.int64()), pa.array(first, pa.int64()), pa.array(to, pa.int64()),
            pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.binary()),
        ],
        COLUMNS,
    )


SPANS = "id long, th long, from long, to long"
#: Of rows in the shuffle: spans (no pieces), packed pieces (bucket, pieces), single pieces (all but "to"; key has ``loops`` as bit 32).
COLUMNS = ["id", "th", "from", "to", "bucket", "key", "pieces"]


def _single(p: Pieces, bucket: np.ndarray) -> pa.RecordBatch:
    """Each piece as a row of its own."""
    key = (p.key.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64) | p.loops.astype(np.int64) << 32
    return pa.RecordBatch.from_arrays(
        [pa.array(p.id, pa.int64(), mask=~p.known), pa.array(p.th, pa.int64()), pa.array(p.first, pa.int64()), pa.nulls(len(p), pa.int64()), pa.array(bucket, pa.int32()), pa.array(key), pa.array(p.text, pa.binary())],
        COLUMNS,
    )


def _from_rows(b: pa.RecordBatch) -> Pieces:
    """The pieces of such rows."""
    numbers = {c: b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("id", "th", "from", "key")}
    known = b.column("id").is_valid().to_numpy(zero_copy_only=False)
    return Pieces(b.column("pieces").to_pylist(), (numbers["key"] & 0xFFFFFFFF).astype(np.uint64), numbers["id"], known, numbers["th"], numbers["from"], numbers["key"] >> 32 > 0)


def _cut_up(b: pa.RecordBatch, window: int, hot: np.ndarray) -> Pieces:
    """The pieces of one slice of texts."""
    off, raw = text_view(b.column("text"))
    a = Anchors(off, raw, window)
    first, last = a.runs()
    key, loops = mix(a.low[first]), a.loops(first, last)  # minima are small numbers; scrambled, they spread over the groups
    often = np.isin(a.low[first], hot)
    if often.any():  # a longer key: the whole window
        one = np.concatenate([np.arange(x, y + 1) for x, y in zip(first[often], last[often])])
        key = np.concatenate([key[~often], _rolling(a.hash, window)[one]])
        first, last = np.concatenate([first[~often], one]), np.concatenate([last[~often], one])
        loops = np.r_[loops[~often], np.zeros(len(one), bool)]
    whole = raw.tobytes()
    cuts = off.tolist()
    flat = b" ".join([w for t in (whole[x:y].split() for x, y in zip(cuts, cuts[1:])) for w in t])
    at = np.r_[0, np.cumsum(a.end - a.start + 1)]
    text = a.text[first]
    known = b.column("id").is_valid().to_numpy(zero_copy_only=False)
    ids, ths = b.column("id").fill_null(0).to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)
    return Pieces(
        [flat[x:y] for x, y in zip(at[first].tolist(), (at[last + window] - 1).tolist())], key, ids[text], known[text], ths[text],
        first - np.searchsorted(a.text, text), loops,
    )


def _shipped(only: DataFrame, window: int) -> DataFrame:
    """Rows of two kinds: spans that repeat a text of the same task, and groups' pieces (bucket, pieces)."""
    size = only.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = max(1, window - min(GRAM, window) + 2) / 2  # suffixes of a piece, on average
    pieces = int(size / 6 / each)  # a word and its blank take 6 bytes or more
    tasks = int(only.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, min(1 << 30, round(size * (window - 1 + each) / each / GROUP)))
    hot = _hot(only, window, max(HOT, pieces // 1_000_000))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches, most=1 << 20):
            held.append(_cut_up(b, window, hot.value))
            n += sum(map(len, held[-1].text))
            if n > CHUNK * 4:
                yield from drain(held)
                held, n = [], 0
        if held:
            yield from drain(held)

    def drain(held: list[Pieces]) -> Iterator[pa.RecordBatch]:
        p, again = _distinct(Pieces.join(held))
        if len(again):
            yield _spans(again, np.arange(len(again)), again.first, again.first + np.array([t.count(b" ") + 1 for t in again.text]))
        key = p.key.view(np.uint64)
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else order
        if len(order) < FEW * len(heads):
            for i in range(0, len(order), 10_000):
                yield _single(p.take(order[i : i + 10_000]), bucket[order[i : i + 10_000]])
            return
        for i in range(0, len(heads), 256):
            own = heads[i : i + 256]
            ends = [*heads[i + 1 : i + 257].tolist(), len(order)][: len(own)]
            packed = [p.take(order[x:y]).pack() for x, y in zip(own.tolist(), ends)]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(bucket[order[own]], pa.int32()), none, pa.array(packed, pa.binary())], COLUMNS)

    return only.mapInArrow(ship, SPANS + ", bucket int, key long, pieces binary")


def _hot(only: DataFrame, window: int, least: int):
    """Broadcast anchors that have ``least`` pieces or more, as far as the sample tells: a million at most, since ``least`` grows with the text."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            a = Anchors(*text_view(b.column("text")), window)
            key, n = np.unique(a.low[a.runs()[0]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    some = only.where(F.pmod(F.xxhash64(F.lit("hot"), "id", "th"), F.lit(SAMPLED)) == 0).select("text")
    counts = some.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least / SAMPLED)
    found = counts.select("key").toArrow()["key"].to_numpy()
    return only.sparkSession.sparkContext.broadcast(np.sort(found.view(np.uint64)))


def _by_group(shipped: DataFrame, judge, schema: str) -> DataFrame:
    """``judge`` on each group's distinct pieces; rows that are spans already go to ``judge.pass_on``."""
    spread = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("id", "th", "from"), F.lit(1 << 30)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Pieces] = []
        now, size = None, 0
        for b in batches:
            done = b.filter(b.column("pieces").is_null())
            if done.num_rows:
                yield from judge(None, done)
            b = b.filter(b.column("pieces").is_valid())
            for k, came in runs(b):
                if held and k != now:
                    yield from whole(held)
                    held, size = [], 0
                now = k
                held.append(came)
                size += sum(map(len, held[-1].text))
                if size > AT_ONCE and len(held) > 1:
                    p, again = _distinct(Pieces.join(held))
                    yield from judge(again, None)
                    held, size = [p], sum(map(len, p.text)) // 2  # what is left counts half, lest it be reduced at every step
        if held:
            yield from whole(held)

    def runs(b: pa.RecordBatch) -> Iterator[tuple[int, Pieces]]:
        """(bucket, pieces) of packed rows one by one, of single rows as many as follow each other."""
        bucket = b.column("bucket").to_numpy(zero_copy_only=False)
        single = b.column("key").is_valid().to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | ~single[1:] | ~single[:-1]]) if len(bucket) else bucket
        for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)]):
            yield int(bucket[x]), _from_rows(b.slice(x, y - x)) if single[x] else Pieces.unpack(b.column("pieces")[x].as_py())

    def whole(held: list[Pieces]) -> Iterator[pa.RecordBatch]:
        p, again = _distinct(_shared(Pieces.join(held)))
        yield from judge(again, None)
        p = _shared(p)
        if len(p):
            yield from judge(p, None, True)

    return shipped.withColumn("__b", spread).repartition("__b").sortWithinPartitions("__b").drop("__b").mapInArrow(run, schema)


def repeated_intervals(docs: DataFrame, window: int) -> DataFrame:
    """id, th (text hash), spans: the word intervals [from, to) that repeat earlier text."""

    def judge(p: Pieces | None, done: pa.RecordBatch | None, tree: bool = False) -> Iterator[pa.RecordBatch]:
        if p is None:
            out = done
        elif tree:
            out = _spans(p, *repeats_in(p, window))
        else:
            out = _spans(p, np.arange(len(p)), p.first, p.first + np.array([t.count(b" ") + 1 for t in p.text], np.int64))
        if out.num_rows:
            yield out.select(["id", "th", "from", "to"])

    found = _by_group(_shipped(_named(docs), window), judge, SPANS)
    return found.groupBy("id", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def maximal_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """passage, n_words, n_texts: the branching nodes of all subtrees, as far as a group's pieces reach.

    Each is a run of words that at least two distinct pieces share and that no longer run with as many
    replaces; ``n_texts`` counts suffixes of distinct pieces. Equal pieces are one here, and a repeat that
    runs through several groups shows as its parts in each.
    """

    def judge(p: Pieces | None, done: pa.RecordBatch | None, tree: bool = False) -> Iterator[pa.RecordBatch]:
        if not tree:
            return
        t = _tree(p, window)
        for depth, one, n in t.branching():
            split = {i: p.text[i].split(b" ") for i in set(t.piece[one].tolist())}
            passage = [b" ".join(split[i][x : x + depth]).decode() for i, x in zip(t.piece[one].tolist(), t.inner[one].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(passage, pa.string()), pa.array([depth] * len(one), pa.int64()), pa.array(n, pa.int64())], ["passage", "n_words", "n_texts"])

    return _by_group(_shipped(_named(docs), window), judge, "passage string, n_words long, n_texts long")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")


def _cut(text: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """(words outside the spans, words, removed words)."""
    words = text.split()
    if not spans:
        return b" ".join(words), len(words), 0
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s["from"] for s in spans], 1)
    np.add.at(change, [s["to"] for s in spans], -1)
    kept = [w for w, d in zip(words, np.cumsum(change)[:-1].tolist()) if not d]
    return b" ".join(kept), len(words), len(words) - len(kept)


def dedup_passages(docs: DataFrame, window: int = 20, digest: bool = False) -> DataFrame:
    """``docs`` with ``text`` reduced to the words outside repeated windows, joined by one space (unchanged where none is removed).

    With ``digest`` instead: doc_id, n_words, n_removed, kept_sha256.
    """
    spans = repeated_intervals(docs, window).select(F.col("id").alias("__i"), F.col("th").alias("__t"), "spans")
    names = list(docs.columns)
    kept = ["text"] if digest else names
    rows = packed(docs, kept, id=F.col("doc_id").cast("long"), th=F.xxhash64("text"))
    rows = rows.join(spans, F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")), "left").select("id", "row", "spans")
    if digest:
        schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()))])
    else:
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(unpacked(batches, kept)):
            own = b.column(OWN + "spans").to_pylist()
            made = [_cut(t, s) for t, s in zip(texts(b.column("text")), own)]
            if digest:
                yield pa.RecordBatch.from_arrays(
                    [b.column(OWN + "id"), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )
                continue
            text = pa.array([m[0].decode() if m[2] else t for m, t in zip(made, b.column("text").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(i) for i, c in enumerate(names)], names)

    return rows.mapInArrow(run, schema)
