"""Best-fit packing by linear grouping.

Documents are tokenised, ended by id 0, and only longer ones are cut. Then, on the histogram of
piece lengths (at most ``capacity`` counts, whatever the corpus), the driver plans:

1. Lengths over ``capacity / 8`` are large. Sorted, they form groups of equal cardinality; each is
   rounded up to its group's largest length, which leaves few sizes.
2. Configurations of those sizes are chosen one after the other, each the fullest that the rest of
   the demand allows, and used as often as the demand allows.
3. Actual pieces take the slots of their group, the n-th piece the n-th slot. That is a join on
   ranks, which distributed prefix counts give.
4. What the substitution leaves free in each sequence is counted; small pieces, longest first, go
   to the fullest sequences that hold them, again on counts, then to sequences of their own.

Only counts and plans of bounded size (lengths, groups, configurations) reach the driver; pieces
and sequences stay distributed.

Edge cases: null text packs as the empty text, one token (id 0); an empty table gives an empty
result; equal lengths are ordered by id hash, id and piece; repeated rows are packed once each;
null doc_id is an id like others; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, hold, slices, stage, texts, unstage

CAPACITY = 2048
GROUPS = 192
#: Words whose ids a worker keeps.
CACHED_WORDS = 350_000
#: Rows of one class that are ranked in one task, about.
RANK_ROWS = 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary(dict):
    """Chunks of text -> numbers, in order of arrival; ``ids`` from ``start[n]`` to ``start[n + 1]`` are chunk n's."""

    def __init__(self):
        self.chunks: list[bytes] = []
        self.ids, self.start = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)
        self.full = 0  # chunks whose ids are known

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self.chunks)
        self.chunks.append(chunk)
        return n

    def fill(self, made: list[bytes]) -> None:
        """Ids of the chunks that have none yet, in order."""
        n, at = self.full, int(self.start[self.full])
        ends = at + np.cumsum([len(m) // 4 for m in made])
        while len(self.start) <= n + len(made):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while len(self.ids) < at + sum(map(len, made)) // 4:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[n + 1 : n + 1 + len(made)] = ends
        new = np.frombuffer(b"".join(made), "<u4")
        self.ids[at : at + len(new)] = new
        self.full = n + len(made)

    def of(self, chunk: bytes) -> bytes:
        n = self[chunk]
        return self.ids[self.start[n] : self.start[n + 1]].tobytes()

    def cut(self, most: int) -> None:
        """Forget the chunks after the first ``most``: the first seen are the frequent ones."""
        for chunk in self.chunks[most:]:
            del self[chunk]
        del self.chunks[most:]
        self.full = min(self.full, most)


@lru_cache(1)
def _tokenizer(path: str):
    """The tokenizer, which of its ids end a word, and the encodings kept so far."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    vocabulary = tok.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    kept = Vocabulary()
    marks = (b"", b".", b",")
    for m in marks:
        kept[m]
    kept.fill([array("I", e.ids).tobytes() for e in tok.encode_batch([m.decode() for m in marks], add_special_tokens=False)])
    hold("packing", _tokenizer.cache_clear)
    return tok, ends, kept


#: Ends of a chunk that are a pre-token of their own after a letter.
_STOPS = (".", ",")


def _stays_letters(word: str) -> bool:
    """Whether the tokenizer's normalizer leaves letters only: İ and letters that NFC takes apart end in a mark, which joins the next one."""
    return word.isascii() or normalize("NFC", word.lower()).isalpha()


def _encode_words(tok, ends: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of words of letters only. They are encoded as one text: each gives ids up to one that ends a word."""
    out = []
    for i in range(0, len(words), 2000):
        part = words[i : i + 2000]
        ids = np.array(tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) == len(part):
            raw = ids.tobytes()
            at = (4 * cut).tolist()
            out += [raw[x:y] for x, y in zip([0, *at], at)]
        else:
            out += [array("I", e.ids).tobytes() for e in tok.encode_batch(part, add_special_tokens=False)]
    return out


def encode(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Ids of each UTF-8 text, little-endian unsigned 32-bit.

    The tokenizer ignores ASCII case, never joins across a space or newline, and splits a mark off
    the letters before it. So each lower-cased chunk between spaces is encoded once; a word with a
    last full stop or comma is the word's ids and the mark's, unless normalization puts a mark in the word.
    """
    tok, ends, kept = _tokenizer(path)
    number, numbers = kept.__getitem__, []
    for t in texts:  # special tokens are matched before lower-casing, so text that may hold one keeps its case
        part = (t if b"<|" in t else t.translate(LOWER)).replace(b"\n", b" ").split(b" ")
        numbers.append(np.fromiter(map(number, part), np.int64, len(part)))
    made: dict[bytes, bytes] = {}
    words, marked, other = [], [], []
    for w in kept.chunks[kept.full :]:
        c = w.decode()
        if c.isalpha():
            words.append(w)
        elif c[-1:] in _STOPS and c[:-1].isalpha() and _stays_letters(c[:-1]):
            marked.append(w)
        else:
            other.append(w)
    new = set(words)
    words += {w[:-1] for w in marked if w[:-1] not in new and (w[:-1] not in kept or kept[w[:-1]] >= kept.full)}
    made.update(zip(words, _encode_words(tok, ends, [w.decode() for w in words])))
    made.update(zip(other, (array("I", e.ids).tobytes() for e in tok.encode_batch_fast([w.decode() for w in other], add_special_tokens=False))))
    mark = {m: kept.of(m) for m in (b".", b",")}
    for w in marked:
        base = w[:-1]
        made[w] = (made[base] if base in made else kept.of(base)) + mark[w[-1:]]
    kept.fill([made[w] for w in kept.chunks[kept.full :]])
    out = []
    for n in numbers:
        first = kept.start[n]
        size = kept.start[n + 1] - first
        end = np.cumsum(size)
        out.append(kept.ids[np.repeat(first - end + size, size) + np.arange(end[-1])])
    kept.cut(CACHED_WORDS)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=3 << 20, cache="packing"):
            rows = [[] for _ in names]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(texts(b.column("text")), path)):
                ids = ids.tobytes() + b"\0\0\0\0"
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for r, v in zip(rows, (doc, i, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        r.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def groups_of(counts: dict[int, int], n_groups: int) -> list[tuple[int, int, int]]:
    """(smallest, largest length, count) of groups of equal cardinality; a length is never split."""
    total, out, low, have = sum(counts.values()), [], None, 0
    for length in sorted(counts):
        low = length if low is None else low
        have += counts[length]
        if have * n_groups >= total:
            out.append((low, length, have))
            low, have = None, 0
    if have:
        out.append((low, max(counts), have))
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(slots by size index, times used), the fullest first, until the demand is met.

    Every configuration starts with the largest size left, and a bounded knapsack over what the
    demand allows fills the rest, so the awkward large sizes go first.
    """
    left, out = list(demand), []
    while any(left):
        first = max(i for i, n in enumerate(left) if n)
        left[first] -= 1
        room = capacity - sizes[first]
        came = np.full(room + 1, -1, np.int64)  # the size that first reached each filling
        came[0] = -2
        for i in range(first, -1, -1):
            for _ in range(min(left[i], room // sizes[i])):  # each pass adds one more of this size to any filling
                reached = np.flatnonzero((came[: room + 1 - sizes[i]] != -1) & (came[sizes[i] :] == -1))
                if not len(reached):
                    break
                came[reached + sizes[i]] = i
            if came[room] != -1:
                break
        at = int(np.flatnonzero(came != -1).max())
        slots = [0] * len(sizes)
        slots[first] = 1
        while at:
            slots[came[at]] += 1
            at -= sizes[came[at]]
        left[first] += 1
        times = min(m // n for n, m in zip(slots, left) if n)
        out.append((slots, times))
        left = [m - n * times for n, m in zip(slots, left)]
    return out


def place_small(rooms: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit on counts. (length, first rank, room class, first sequence in it, offset in the free part), and new sequences.

    Each entry holds until the next first rank of its length. Sequences of room class ``capacity``
    that were not among ``rooms`` are new.
    """
    # free part still open -> spans of sequences (room class, first, count) with that much open
    spans: dict[int, list[list[int]]] = {}
    for room, n in rooms.items():
        if room and n:
            spans.setdefault(room, []).append([room, 0, n])
    order = sorted(spans)
    out, fresh = [], 0
    for length in sorted(small, reverse=True):
        rank, todo = 0, small[length]
        while todo:
            at = bisect_left(order, length)
            if at == len(order):
                n = -(-todo // (capacity // length))
                spans.setdefault(capacity, []).append([capacity, fresh, n])
                order.append(capacity)
                fresh += n
                continue
            room = order[at]
            span = spans[room].pop()
            n = min(todo, span[2])
            out.append((length, rank, span[0], span[1], span[0] - room))
            if n < span[2]:
                spans[room].append([span[0], span[1] + n, span[2] - n])
            if not spans[room]:
                del spans[room]
                order.pop(at)
            if room > length:
                if room - length not in spans:
                    order.insert(bisect_left(order, room - length), room - length)
                    spans[room - length] = []
                spans[room - length].append([span[0], span[1], n])
            rank, todo = rank + n, todo - n
    return out, fresh


def ranked(rows: DataFrame, by: str, order: list[str], total: int, name: str) -> DataFrame:
    """``rows`` with ``name``: their rank from 0 among rows of equal ``by``.

    Hash buckets of each class get prefix counts, so a class with a third of all rows is ranked in many tasks.
    """
    buckets = max(1, -(-total // RANK_ROWS))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(by, "__b", (F.sum("__n").over(Window.partitionBy(by).orderBy("__b")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order)) - 1
    return rows.join(before, [by, "__b"]).withColumn(name, local + F.col("__before")).drop("__b", "__before")


def pack(rows: DataFrame, capacity: int = CAPACITY, n_groups: int = GROUPS) -> DataFrame:
    """``rows`` (doc_id, piece, length, ...; staged) with sequence_id and offset."""
    spark = rows.sparkSession
    counts = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    least = capacity // 8
    groups = groups_of({k: n for k, n in counts.items() if k > least}, n_groups)
    small = {k: n for k, n in counts.items() if k <= least}
    configs = configurations([g[1] for g in groups], [g[2] for g in groups], capacity) if groups else []

    # Slots: group, first rank, first sequence, slot's place, slots of that group in the configuration, times.
    slots, used, base = [], [0] * len(groups), 0
    for config, times in configs:
        place = 0
        for g, n in enumerate(config):
            if n:
                slots.append((g, used[g], base, place, n))
                used[g] += n * times
                place += n
        base += times
    group = F.lit(None).cast("int")
    if groups:
        group = F.element_at(F.array(*[F.lit(i) for i in _by_length(groups, capacity, least)]), F.col("length").cast("int"))
    rows = rows.withColumn("__class", F.when(F.col("length") > least, group).otherwise(-F.col("length").cast("int") - 1))
    rows = stage(ranked(rows, "__class", ["doc_id", "piece", "ids_crc32"], total, "__rank"), "pack-ranked")

    slot_table = spark.createDataFrame(slots or [(-1, 0, 0, 0, 1)], "__class int, __from long, __base long, __place int, __n int")
    after = F.lead("__from", 1, 2**62).over(Window.partitionBy("__class").orderBy("__from"))
    slot_table = slot_table.withColumn("__to", after)
    large = rows.where(F.col("length") > least).join(F.broadcast(slot_table), "__class").where("__from <= __rank and __rank < __to")
    nth = F.col("__rank") - F.col("__from")
    large = large.withColumn("__seq", F.col("__base") + F.floor(nth / F.col("__n"))).withColumn("__place", F.col("__place") + nth % F.col("__n"))
    in_seq = Window.partitionBy("__seq").orderBy("__place")
    large = large.withColumn("offset", F.sum("length").over(in_seq) - F.col("length"))
    large = large.withColumn("__room", F.lit(capacity) - F.sum("length").over(Window.partitionBy("__seq")))
    large = stage(large.select("doc_id", "piece", "start", "length", "ids_crc32", *_rest(rows), "__seq", "offset", "__room"), "pack-large")
    done = large.select(*[c for c in large.columns if c not in ("__seq", "offset", "__room")], F.col("__seq").alias("sequence_id"), "offset")
    if not small:
        return done

    opened = large.where("offset = 0").select("__seq", "__room")
    rooms = {int(r["__room"]): r["n"] for r in opened.groupBy("__room").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = place_small(rooms, small, capacity)
    table = spark.createDataFrame(table, "__l long, __from long, __room long, __first long, __off long")
    table = table.withColumn("__to", F.lead("__from", 1, 2**62).over(Window.partitionBy("__l").orderBy("__from")))
    rest = rows.where(F.col("length") <= least).join(F.broadcast(table), F.col("length") == F.col("__l")).where("__from <= __rank and __rank < __to")
    rest = rest.withColumn("__nth", F.col("__first") + F.col("__rank") - F.col("__from"))
    places = ranked(opened.where("__room > 0"), "__room", ["__seq"], max(rooms.values(), default=1), "__nth")
    rest = rest.join(places, ["__room", "__nth"], "left")
    rest = rest.select(
        *done.columns[:-2],
        F.coalesce(F.col("__seq"), F.lit(base) + F.col("__nth")).alias("sequence_id"),
        F.when(F.col("__seq").isNull(), F.col("__off")).otherwise(F.lit(capacity) - F.col("__room") + F.col("__off")).alias("offset"),
    )
    return done.unionByName(rest)


def _rest(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("doc_id", "piece", "start", "length", "ids_crc32", "__class", "__rank")]


def _by_length(groups: list[tuple[int, int, int]], capacity: int, least: int) -> list[int]:
    """For each length from 1: the index of the first group whose largest length holds it."""
    tops = [g[1] for g in groups]
    return [min(bisect_left(tops, n), len(tops) - 1) if n > least else -1 for n in range(1, capacity + 1)]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece."""
    made = stage(pieces(docs, capacity, path, with_ids), "pack-pieces", narrow=False)
    out = pack(made, capacity)  # which has staged what it reads
    unstage(made)
    return out
