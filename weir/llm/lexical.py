"""Ranked lexical search: an inverted index in compressed blocks, searched by Block-Max WAND.

``build_index`` cuts the documents, where they lie, into shards of some ``SHARD`` bytes of text. A shard
numbers its documents and holds, for each of its terms, the postings (document, occurrences) in blocks of
``BLOCK``: gaps and counts as variable-length bytes, beside them the block's first and last document and the
largest impact in it. Nothing is shuffled to build it; a hot term has blocks in every shard.

``search`` takes items in blocks of bounded size. Of the index it reads the blocks of an item block's terms,
moves them to one task a shard and searches the shard once for each item:

1. Shallow moves: the pointers of the item's terms go from block bound to block bound, by the bounds alone. The
   maxima of the blocks under them add up to what a document of the range between two stops can reach.
2. Ranges that stay below the threshold, the score of the k-th best so far, are skipped; their blocks are never decompressed
   unless a neighbouring range needs them.
3. The others are opened, those of the highest bounds first, so that the threshold rises early; the postings in them are
   scored exactly.

All of a shard's shallow moves are one pass over arrays, and so is scoring: document-at-a-time pointers in Python took 35 times as long.
Thresholds go on from shard to shard of a task. Each task's k best of an item meet in a last top-k.

Scores are integers: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))) and gives
weight * (10^9 tf div (1000 tf + 20 m)), where m = 50 + 50 n N div L.

Edge cases: null and empty texts have no terms and no rank; an item without terms, or whose terms no document has, gets no
rows; rows of one item_id are one item with the terms of all; a null item_id or doc_id is an id like others, a null
doc_id last among equal scores; repeated rows are documents of their own, each with a rank; empty tables give an
empty result; extra columns are ignored. Texts are cut into terms a part of ``PART`` bytes at a time; a single item is never
split, so its terms must fit a task. With more than 2^31 documents in a shard or occurrences of a term in
one document the index overflows, far beyond ``SHARD``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, slices, stage, text_view

#: Terms are runs of ASCII letters and digits and of all bytes beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_CUT = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Postings of a block; bytes of text of a shard; bytes of a text cut into terms at once; bytes of items searched at once.
BLOCK, SHARD, PART, ITEM_BYTES = 128, 16 << 20, 1 << 20, 4 << 20
#: Stands for a null doc_id, after all others.
_LAST = (1 << 63) - 1
INDEX = "shard long, term binary, n int, first int, last int, impact int, postings binary, ids array<long>, m array<long>"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased terms of a text, part by part."""
    at = 0
    while at < len(text):
        to = _CUT.search(text, at + PART)
        to = to.start() if to else len(text)
        yield TERM.findall(text[at:to].translate(LOWER))
        at = to


def impact(tf, m):
    """What an occurrence count gives in a document of relative length ``m``, per unit of weight; numbers or arrays."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(n: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms in all)."""
    word = np.zeros(256, bool)
    word[np.frombuffer(b"".join(bytes([i]) for i in range(256) if TERM.fullmatch(bytes([i]))), np.uint8)] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in slices(batches):
            off, raw = text_view(b.column("text"))
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                own = 0
                for at in range(a, z, PART):
                    inside = word[raw[at : min(z, at + PART)]]
                    own += int(np.count_nonzero(inside[1:] > inside[:-1])) + int(inside[0] and (at == a or not word[raw[at - 1]]))
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    row = docs.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


class _Shard:
    """Documents taken in one after the other, then the blocks of their postings."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[int | None] = []
        self.n: list[int] = []
        self.postings: list[np.ndarray] = []  # rows (term, document, occurrences)
        self.bytes = 0

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        number, seen, docs = self.numbers, [], []
        for i, text in zip(ids, texts):
            n = 0
            for part in terms(text):
                seen.append(np.fromiter(map(number.__getitem__, part), np.int64, len(part)))
                docs.append((len(self.ids), len(part)))
                n += len(part)
            if n:
                self.ids.append(i)
                self.n.append(n)
            self.bytes += len(text)
        if seen:
            at = np.repeat(*np.array(docs, np.int64).T)
            key, tf = np.unique(np.concatenate(seen) << 32 | at, return_counts=True)
            self.postings.append(np.stack([key, tf]))

    def rows(self, shard: int, n: int, total: int) -> Iterator[pa.RecordBatch]:
        """One row of documents, then a row for each block, ordered by term."""
        schema = ["shard", "term", "n", "first", "last", "impact", "postings", "ids", "m"]
        m = 50 + 50 * np.array(self.n, np.int64) * n // total
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int32()) for _ in range(4)), pa.nulls(1, pa.binary()), pa.array([self.ids], lists), pa.array([m.tolist()], lists)], schema
        )
        names = sorted(self.numbers)
        order = np.empty(len(names), np.int64)
        order[[self.numbers[t] for t in names]] = np.arange(len(names))
        key, tf = np.concatenate(self.postings, 1)
        key = order[key >> 32] << 32 | (key & 0xFFFFFFFF)
        by = np.argsort(key)
        key, tf = key[by], tf[by]
        same = np.r_[False, key[1:] == key[:-1]]  # a long text's parts meet here
        if same.any():
            tf = np.add.reduceat(tf, np.flatnonzero(~same))
            key = key[~same]
        term, doc = key >> 32, key & 0xFFFFFFFF
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        place = np.arange(len(term)) - np.repeat(starts, np.diff(np.r_[starts, len(term)]))
        cuts = np.flatnonzero(place % BLOCK == 0)
        sizes = np.diff(np.r_[cuts, len(term)])
        gap = np.r_[0, np.diff(doc)]
        gap[cuts] = 0
        data, ends = encode(np.stack([gap, tf], 1).ravel())
        off = np.r_[0, ends[2 * (cuts + sizes) - 1]]
        most = np.maximum.reduceat(impact(tf, m[doc]), cuts)
        int32 = lambda x: pa.array(x.astype(np.int32))
        own = pa.array(names, pa.binary()).take(pa.array(term[cuts]))
        blobs = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        for a in range(0, len(cuts), 50_000):
            z = min(len(cuts), a + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(z - a, shard)), own[a:z], int32(sizes[a:z]), int32(doc[cuts[a:z]]), int32(doc[cuts[a:z] + sizes[a:z] - 1]), int32(most[a:z]), blobs[a:z].cast(pa.binary()), pa.nulls(z - a, lists), pa.nulls(z - a, lists)],
                schema,
            )


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative numbers, seven bits a byte, low bits first, the last byte's top bit set; where each number ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >> bits > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > i)
        out[ends[has] - size[has] + i] = values[has] >> 7 * i & 0x7F
    out[ends - 1] |= 0x80
    return out, ends


def decode(data: bytes) -> np.ndarray:
    """The numbers of ``encode``."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw & 0x80)
    starts = np.r_[0, ends + 1][:-1]
    out = (raw[starts] & 0x7F).astype(np.int64)
    for i in range(1, int((ends - starts).max(initial=0)) + 1):
        has = np.flatnonzero(starts + i <= ends)
        out[has] |= (raw[starts[has] + i] & 0x7F).astype(np.int64) << 7 * i
    return out


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The staged index of doc_id and text, its number of documents with terms, and of their terms.

    A row is a block of a term's postings in a shard or, with a null term, a shard's documents: ids and m.
    """
    n, total = lengths(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, now = TaskContext.get().partitionId() << 32, _Shard()
        for b in slices(batches):
            off, raw = text_view(b.column("text"))
            whole, cuts = raw.tobytes(), off.tolist()
            now.add(b.column("doc_id").to_pylist(), [whole[x:y] for x, y in zip(cuts, cuts[1:])])
            if now.bytes >= SHARD:
                if now.ids:
                    yield from now.rows(shard, n, total)
                shard, now = shard + 1, _Shard()
        if now.ids:
            yield from now.rows(shard, n, total)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(build, INDEX)
    return stage(rows, "index", narrow=False, compression="zstd"), n, total


class Postings:
    """One term's blocks in a shard: their bounds, and their postings still compressed."""

    def __init__(self, n: list[int], first: list[int], last: list[int], impact: list[int], data: list[bytes]):
        self.n, self.first, self.last, self.impact = (np.array(x, np.int64) for x in (n, first, last, impact))
        self.data = data


class Walk:
    """Block-Max WAND of one item over one shard. ``best``: (scores, document ids) of the k best so far, best first, which goes on."""

    def __init__(self, lists: list[tuple[Postings, int]], ids: np.ndarray, m: np.ndarray, k: int):
        self.ids, self.m, self.k = ids, m, k
        join = lambda x: np.concatenate([getattr(p, x) for p, _ in lists])
        self.n, self.first, self.last = join("n"), join("first"), join("last")
        self.weight = np.repeat([w for _, w in lists], [len(p.n) for p, _ in lists])
        self.most = self.weight * join("impact")
        self.data = [d for p, _ in lists for d in p.data]
        self.opened = 0

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Where shallow pointers stop, the first document of each range between, and the sum of the maxima of the blocks under them there."""
        stops = np.unique(np.concatenate([self.first, self.last + 1]))
        change = np.zeros(len(stops), np.int64)
        np.add.at(change, np.searchsorted(stops, self.first), self.most)
        np.subtract.at(change, np.searchsorted(stops, self.last + 1), self.most)
        return stops, np.cumsum(change)

    def scores(self, stops: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Exact scores of the documents in the chosen ranges, 0 elsewhere; opens only blocks that reach into them."""
        upto = np.r_[0, np.cumsum(chosen)]
        blocks = np.flatnonzero(upto[np.searchsorted(stops, self.last + 1)] > upto[np.searchsorted(stops, self.first)])
        self.opened += len(blocks)
        values = decode(b"".join([self.data[b] for b in blocks.tolist()]))
        sizes = self.n[blocks]
        doc, tf = np.cumsum(values[::2]), values[1::2]
        doc += np.repeat(self.first[blocks] - doc[np.cumsum(sizes) - sizes], sizes)
        part = np.repeat(self.weight[blocks], sizes) * impact(tf, self.m[doc])
        inside = chosen[np.searchsorted(stops, doc, "right") - 1]
        out = np.zeros(len(self.m), np.int64)
        np.add.at(out, doc[inside], part[inside])
        return out

    def run(self, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        stops, reach = self.bounds()
        width = np.diff(np.r_[stops, stops[-1]])
        order = np.argsort(-reach, kind="stable")
        at, take = 0, self.k
        while at < len(order):
            least = max(1, int(best[0][-1])) if len(best[0]) == self.k else 1
            # The ranges of the highest bounds that hold some ``take`` documents; those below the threshold are never opened.
            to = at + 1 + int(np.searchsorted(np.cumsum(width[order[at:]]), take))
            some = order[at:to]
            some = some[reach[some] >= least]
            if not len(some):
                break
            chosen = np.zeros(len(stops), bool)
            chosen[some] = True
            score = self.scores(stops, chosen)
            new = np.flatnonzero(score >= least)
            best = ranked(np.r_[best[0], score[new]], np.r_[best[1], self.ids[new]], self.k)
            at, take = to, 32 * take
        return best


def ranked(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id."""
    by = np.lexsort((ids, -score))[:k]
    return score[by], ids[by]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each item's terms, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            off, raw = text_view(b.column("text"))
            whole, cuts = raw.tobytes(), off.tolist()
            for i, x, y in zip(b.column("item_id").to_pylist(), cuts, cuts[1:]):
                for part in terms(whole[x:y]):
                    own = list(set(part))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.binary())], ["item_id", "term"])

    return items.selectExpr("cast(item_id as long) item_id", "text").mapInArrow(run, "item_id long, term binary").distinct()


def _search_block(index: DataFrame, asked: list, n: int, k: int) -> DataFrame:
    """item_id, doc_id, score of each task's k best of the items of ``asked``, rows (item_id, term)."""
    spark = index.sparkSession
    own = sorted({r["term"] for r in asked})
    names = F.broadcast(spark.createDataFrame([(t,) for t in own], "term binary"))
    found = index.where("term is not null").join(names, "term", "left_semi")
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # at most the item block's terms
    by: dict = {}
    for r in asked:
        if r["term"] in df and weight(n, df[r["term"]]):
            by.setdefault(r["item_id"], []).append(r["term"])
    want = spark.sparkContext.broadcast(({bytes(t): weight(n, c) for t, c in df.items()}, {i: [bytes(t) for t in ts] for i, ts in by.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = want.value
        best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in items}
        for ids, m, lists in _shards(batches):
            for item, own in items.items():
                if pointers := [(lists[t], weights[t]) for t in own if t in lists]:
                    best[item] = Walk(pointers, ids, m, k).run(best[item])
        rows = [(i, None if d == _LAST else d, s) for i, (scores, docs) in best.items() for s, d in zip(scores.tolist(), docs.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    rows = found.unionByName(index.where("term is null")).repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first(), "first")
    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[bytes, Postings]]]:
    """Each shard's document ids, relative lengths, and postings by term; a shard's row of documents comes first, terms in order."""
    shard, ids, m, lists, held = None, None, None, {}, None

    def close() -> None:
        if held:
            lists[held[0]] = Postings(*held[1:])

    for b in batches:
        columns = [b.column(c) for c in ("shard", "term", "n", "first", "last", "impact", "postings")]
        for at, (s, term, *rest) in enumerate(zip(*(c.to_pylist() for c in columns))):
            if s != shard:
                close()
                if lists:
                    yield ids, m, lists
                shard, lists, held = s, {}, None
            if term is None:
                ids = np.array([_LAST if i is None else i for i in b.column("ids")[at].as_py()], np.int64)
                m = np.array(b.column("m")[at].as_py(), np.int64)
                continue
            if held is None or held[0] != term:
                close()
                held = (term, [], [], [], [], [])
            for x, value in zip(held[1:], rest):
                x.append(value)
    close()
    if lists:
        yield ids, m, lists


def search(index: tuple[DataFrame, int, int], items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents of ``build_index``'s index, ties to the smaller doc_id."""
    blocks, n, _ = index
    asked = stage(item_terms(items), "items")
    size = asked.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    out = None
    for i in range(parts):  # each with terms of some ITEM_BYTES
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).collect()
        found = _search_block(blocks, some, n, k) if some else None
        out = found if out is None else out.unionByName(found) if found is not None else out
    if out is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
