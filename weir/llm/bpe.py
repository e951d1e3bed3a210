"""Byte-level BPE: texts to ids of a public rank file and back, by replaying merges over a whole slice of the corpus.

Each task encodes the distinct words of its texts together. ``replay`` lays their symbols out in one chain
and keeps an inverted index from token pair, named by the rank that joins it, to the places where it stands. Ranks are
taken in order; every place of a rank is merged, from left to right, and only its two neighbours are looked up again
and entered under their new ranks. Where a merge makes a pair of the same or a lower rank in its word, the rest of the word waits for
that one, so each word is merged exactly as if it were encoded alone: always its lowest rank, leftmost first.

A word's ids depend on nothing but the word, so tasks share nothing and nothing is shuffled: a word table of the whole
corpus would have to be sent to every slice again, beside the text. A worker keeps the ids of ``KEPT`` bytes of words.

Words are the matches of the public split pattern. They are found with arrays: each code point gets its class (letter, number, white space,
other), and each place of the pattern at which a match begins follows from the classes around it. The classes are
those of the tiktoken library itself, read from it once a worker, because Unicode versions differ between libraries.

Edge cases: null and empty texts have no tokens, and decode to nothing; bytes of any text come back; special tokens' strings
are ordinary text; repeated rows are encoded each; a null doc_id is kept; extra columns are kept, whatever their names;
an empty table gives an empty result. A long text is split ``WINDOW`` bytes at a time and encoded ``AT_ONCE`` words at a time; its
ids are one value of 4 bytes a token. One match is one word, however long: its replay takes some 150 bytes a byte in one task.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import OWN, hold, packed, slices, text_view, unpacked

#: Bytes split at once; words encoded at once; bytes of words that a replay lays out; bytes of words whose ids a worker keeps; ids digested at once.
WINDOW, AT_ONCE, CHAIN, KEPT, DIGEST = 1 << 20, 100_000, 1 << 20, 6 << 20, 1 << 16
#: Code points beside a window that decide where its first and last words begin.
MARGIN = 8
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def ranks_path() -> str:
    """The rank file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Ranks:
    """A rank file: token bytes by id, ids by bytes, and the rank that joins two ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.decimal = {i: str(i) for i in self.tokens}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = i
        self.first = np.full((256, 256), -1, np.int64)  # ranks of byte pairs, by byte
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.ids.get(bytes([a, b]), -1)


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, as the tiktoken library has it: an encoder drops what its pattern doesn't match."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\s", _SPACE), (r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        matched = bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(matched.decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def _begins(point: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which code points begin a match; ``first`` and ``last`` mark those of texts.

    A run of letters, numbers or others takes one blank before it along. Of longer white space before a run, the last
    character stands alone or goes along; white space at the end of a text is one match. An apostrophe that begins a
    match takes one of s t m d re ve ll with it.
    """
    kind = classes()[point]
    space = kind == _SPACE
    before = np.r_[np.uint8(255), kind[:-1]]
    after_blank = np.r_[False, point[:-1] == 0x20]
    ends = ~np.r_[space[1:], True] & ~last  # a run follows in the same text
    out = first | np.where(space, (before != _SPACE) | ends, (kind != before) & ~after_blank)
    size = len(point)
    quote = np.flatnonzero((point == 0x27) & out & ~last)
    quote = quote[quote + 1 < size]
    if len(quote):
        one = point[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        room = ~last[quote + 1] & (quote + 2 < size)
        two = point[np.minimum(quote + 2, size - 1)]
        long = room & ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        out[quote[short | long] + 1] = False
        for at, width in ((quote[short], 2), (quote[long], 3)):
            at = at + width
            out[at[at < size]] = True
    return out


def words(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Where the matches begin in the UTF-8 bytes of texts laid end to end, which begin at ``off[:-1]`` and end at ``off[-1]``."""
    out = []
    bounds = np.unique(off)
    head = raw & 0xC0 != 0x80
    for a in range(0, len(raw), WINDOW):
        z = min(len(raw), a + WINDOW)
        lo, hi = max(0, a - 4 * MARGIN), min(len(raw), z + 4 * MARGIN)
        while not head[lo]:
            lo += 1
        while hi < len(raw) and not head[hi]:
            hi -= 1
        point = np.frombuffer(raw[lo:hi].tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero(head[lo:hi]) + lo
        edges = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")]
        first, last = np.zeros(len(place), bool), np.zeros(len(place), bool)
        first[np.searchsorted(place, edges[edges < hi])] = True
        last[np.searchsorted(place, edges[edges > lo]) - 1] = True
        begins = place[_begins(point, first, last)]
        out.append(begins[(begins >= a) & (begins < z)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def replay(some: list[bytes], table: Ranks) -> list[bytes]:
    """The ids (little-endian uint32) of distinct words, merged together in rank order."""
    sizes = np.array([len(w) for w in some], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(some), np.uint8)
    n = len(raw)
    if not n:
        return [b""] * len(some)
    after = np.arange(1, n + 1)
    after[ends - 1] = -1
    ahead = np.arange(-1, n - 1)
    ahead[ends - sizes] = -1
    rank = np.full(n, -1, np.int64)
    rank[:-1] = table.first[raw[:-1], raw[1:]]
    rank[ends - 1] = -1
    # The inverted index: places of each pair, in order.
    order = np.argsort(rank, kind="stable")
    order = order[np.searchsorted(rank[order], 0) :]
    heap, cuts = np.unique(rank[order], return_index=True)
    cuts, at = [*cuts.tolist(), len(order)], order.tolist()
    heap = heap.tolist()
    places = {r: at[a:z] for r, a, z in zip(heap, cuts, cuts[1:])}
    heapify(heap)
    symbol, following, leading, now = table.byte[raw].tolist(), after.tolist(), ahead.tolist(), rank.tolist()
    bounds, pairs = ends.tolist(), table.pairs
    while heap:
        r = heappop(heap)
        here = places.pop(r)
        here.sort()
        waits, until = [], -1
        for i in here:
            if now[i] != r:
                continue
            if i < until:
                waits.append(i)
                continue
            j = following[i]
            k = following[j]
            symbol[i], symbol[j], now[j] = r, -1, -1
            following[i] = k
            new = -1
            if k >= 0:
                leading[k] = i
                new = pairs.get(r << 32 | symbol[k], -1)
                if new >= 0:
                    if new in places:
                        places[new].append(i)
                    else:
                        places[new] = [i]
                        heappush(heap, new)
                    if new <= r:
                        until = bounds[bisect_right(bounds, i)]
            now[i] = new
            h = leading[i]
            if h >= 0:
                new = now[h] = pairs.get(symbol[h] << 32 | r, -1)
                if new >= 0:
                    if new in places:
                        places[new].append(h)
                    else:
                        places[new] = [h]
                        heappush(heap, new)
                    if new <= r:
                        until = bounds[bisect_right(bounds, i)]
        if waits:
            if r in places:
                places[r] += waits
            else:
                places[r] = waits
                heappush(heap, r)
    left = np.array(symbol, np.int64)
    upto = np.r_[0, np.cumsum(left >= 0)]
    data = left[left >= 0].astype("<u4").tobytes()
    return [data[4 * a : 4 * z] for a, z in zip(upto[ends - sizes].tolist(), upto[ends].tolist())]


_kept: dict[bytes, bytes] = {}
_kept_bytes = [0]


def _forget() -> None:
    _kept.clear()
    _kept_bytes[0] = 0


def encode_texts(off: np.ndarray, raw: np.ndarray, path: str) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text of a column's offsets and bytes."""
    table, begins = ranks(path), words(off, raw)
    whole = raw.tobytes()
    cuts = [*begins.tolist(), len(whole)]
    upto = np.searchsorted(begins, off).tolist()  # words before each text
    parts: list[bytes] = []
    text = 0
    for a in range(0, max(1, len(begins)), AT_ONCE):
        z = min(len(begins), a + AT_ONCE)
        own = [whole[x:y] for x, y in zip(cuts[a:z], cuts[a + 1 : z + 1])]
        ids = _ids_of(own, table)
        while text < len(off) - 1 and upto[text + 1] <= z:
            parts.append(b"".join(ids[max(0, upto[text] - a) : upto[text + 1] - a]))
            yield np.frombuffer(b"".join(parts), "<u4")
            parts, text = [], text + 1
        if text < len(off) - 1 and upto[text] < z:
            parts.append(b"".join(ids[max(0, upto[text] - a) :]))


def _ids_of(own: list[bytes], table: Ranks) -> list[bytes]:
    """The ids of words; those that this worker doesn't know are merged together, and kept."""
    if _kept_bytes[0] > KEPT:
        _forget()
    out = list(map(_kept.get, own))
    new = list(dict.fromkeys(w for w, i in zip(own, out) if i is None))
    if not new:
        return out
    todo = []
    for w in new:
        if (i := table.ids.get(w)) is None:
            todo.append(w)
        else:  # a word that is a token is that token
            _kept[w] = i.to_bytes(4, "little")
    at = 0
    while at < len(todo):
        to, size = at, 0
        while to < len(todo) and (to == at or size + len(todo[to]) <= CHAIN):
            size += len(todo[to])
            to += 1
        _kept.update(zip(todo[at:to], replay(todo[at:to], table)))
        at = to
    _kept_bytes[0] += sum(map(len, new))
    return list(map(_kept.__getitem__, own))


def decode_ids(ids: np.ndarray, path: str) -> Iterator[bytes]:
    """The bytes of ids, part by part."""
    tokens = ranks(path).tokens
    for a in range(0, len(ids), DIGEST):
        yield b"".join(map(tokens.__getitem__, ids[a : a + DIGEST].tolist()))


def _with(docs: DataFrame, column: str, own, kinds: str) -> DataFrame:
    """``docs`` with more columns from ``own(offsets, bytes)``, which gives lists or arrays of values, a batch of ``column`` at a time."""
    names, columns = [x.split()[0] for x in kinds.split(", ")], docs.columns
    schema = docs.select(*[f"`{c}`" for c in columns]).schema
    out = T.StructType(schema.fields + [T.StructField(OWN + f.name, f.dataType) for f in T.StructType.fromDDL(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", _forget)

        def more() -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "own", cache="bpe"):
                yield pa.RecordBatch.from_arrays([b.column("row"), *own(*text_view(b.column("own")))], ["row", *names])

        yield from unpacked(more(), columns)

    made = packed(docs, columns, own=docs[column]).mapInArrow(run, out)
    for n in names:
        if n in columns:
            raise ValueError(f"there is a column {n} already")
        made = made.withColumnRenamed(OWN + n, n)
    return made


def _lists(ids: list[np.ndarray]) -> pa.Array:
    off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None, column: str = "text", output: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``column``, array<int>."""
    path = path or ranks_path()
    return _with(docs, column, lambda off, raw: [_lists(list(encode_texts(off, raw, path)))], f"{output} array<int>")


def decode(tokens: DataFrame, path: str | None = None, column: str = "ids", output: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of the ids in ``column``; a null list decodes to null, an id that is no token is an error."""
    path, columns = path or ranks_path(), tokens.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def more() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    some = b.slice(at, 64)
                    values = [None if not x.is_valid else b"".join(decode_ids(x.values.to_numpy(zero_copy_only=False), path)) for x in some.column("own")]
                    yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(values, pa.binary())], ["row", output])

        yield from unpacked(more(), columns)

    out = T.StructType([*tokens.schema.fields, T.StructField(OWN + output, T.BinaryType())])
    return packed(tokens, columns, own=tokens[column]).mapInArrow(run, out).withColumnRenamed(OWN + output, output)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes decoded from them; ids stay in the task."""
    path = path or ranks_path()

    def digest(off: np.ndarray, raw: np.ndarray) -> list[pa.Array]:
        rows = []
        for ids in encode_texts(off, raw, path):
            decimal, joined = ranks(path).decimal, hashlib.sha256()
            for a in range(0, len(ids), DIGEST):
                joined.update(("," * (a > 0) + ",".join(map(decimal.__getitem__, ids[a : a + DIGEST].tolist()))).encode())
            decoded = hashlib.sha256()
            for part in decode_ids(ids, path):
                decoded.update(part)
            rows.append((len(ids), joined.hexdigest(), decoded.hexdigest()))
        n, i, d = zip(*rows) if rows else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]

    return _with(docs.select("doc_id", "text"), "text", digest, "n_tokens long, ids_sha256 string, decoded_sha256 string").drop("text")
