"""Line dedup across documents.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Two Bloom
filters tell which key hashes may occur in two documents; only those keys are shuffled, counted
exactly as text, and the keys found in ``min_docs`` documents lose their lines: all of them, or
with ``keep_first`` all but the first line of the first document.

The keys found in the most documents are broadcast, up to ``broadcast_bytes``. Where there are more,
a filter of the others tells which lines may be among them, and only those lines are joined; but for
lines too long for the broadcast, none of them is in more documents than the least of the broadcast ones.

Edge cases: null or empty text is one empty line, and null text without dropped lines stays null;
empty keys are never dropped; a key counts once a document; every row is a document, also rows
with equal doc_id; the first document is the one of smallest doc_id, then text hash, and equal
rows are that document together; an empty table gives an empty result; extra columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import twobloom
from .common import LOWER, OWN, SPACES, packed, slices, stage, texts, unpacked, unstage

#: Bytes of dropped keys that are broadcast; others are joined.
BROADCAST_BYTES = 8 << 20


def keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACES) for line in text.translate(LOWER).split(b"\n")]


def _doc_keys(text: bytes) -> set[bytes]:
    out = set(keys(text))
    out.discard(b"")
    return out


def _hash(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    return _hash([k for b in slices(iter([batch])) for t in texts(b.column("text")) for k in _doc_keys(t)])


def repeated_keys(docs: DataFrame, min_docs: int) -> DataFrame:
    """key, n, first (id, th) of the keys found in at least ``min_docs`` documents."""
    only = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    lines = F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    twice = twobloom.seen(only.select("text"), _hashes, docs.agg(lines).first()[0] or 0)
    schema = "key binary, id long, th long, n long"

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [sorted(_doc_keys(t)) for t in texts(b.column("text"))]
            flat = [k for ks in own for k in ks]
            doc = np.repeat(np.arange(len(own)), [len(ks) for ks in own])
            at = np.flatnonzero(twice.value.has(_hash(flat))).tolist() if flat else []
            count = Counter(flat[i] for i in at)
            first: dict[bytes, tuple] = {}
            ids, ths = b.column("id").to_pylist(), b.column("th").to_pylist()
            for i in at:
                mine = (ids[doc[i]] is not None, ids[doc[i]], ths[doc[i]])
                if flat[i] not in first or mine < first[flat[i]]:
                    first[flat[i]] = mine
            got = list(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(got, pa.binary()), pa.array([first[k][1] for k in got], pa.int64()), pa.array([first[k][2] for k in got], pa.int64()), pa.array([count[k] for k in got], pa.int64())],
                ["key", "id", "th", "n"],
            )

    found = only.mapInArrow(suspects, schema).groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("id", "th")).alias("first"))
    return found.where(F.col("n") >= min_docs).select("key", "n", "first.id", "first.th")


def _cut(text: bytes, drop: dict, own: dict, here: tuple | None) -> tuple[bytes, int, int]:
    """(kept text, lines, dropped lines). ``here``: this document, if first occurrences stay."""
    lines, ks = text.split(b"\n"), keys(text)
    gone = [k in drop or k in own for k in ks]
    if here is not None and any(gone):
        seen: set[bytes] = set()
        for i, k in enumerate(ks):
            if gone[i] and (drop[k] if k in drop else own[k]) == here and k not in seen:
                seen.add(k)
                gone[i] = False
    n = sum(gone)
    return (b"\n".join([x for x, g in zip(lines, gone) if not g]) if n else text), len(lines), n


def _hottest(found: DataFrame, most: int) -> dict[bytes, tuple]:
    """The keys found in the most documents, as many as fit in ``most`` bytes (a key counts 100 more than it has)."""
    name = F.xxhash64("key").alias("name")
    some, size = [], 0
    for r in found.select("n", F.octet_length("key").alias("size"), name).orderBy(F.desc("n"), "name").limit(most // 100).collect():
        if size + r["size"] + 100 <= most:
            size += r["size"] + 100
            some.append((r["name"],))
    if not some:
        return {}
    names = found.sparkSession.createDataFrame(some, "name long")
    rows = found.withColumn("name", name).join(F.broadcast(names), "name", "left_semi").collect()
    return {bytes(r["key"]): (r["id"], r["th"]) for r in rows}


def _own_keys(docs: DataFrame, found: DataFrame, n: int, hot: Broadcast) -> DataFrame:
    """id, th, own: each document's keys among the ``n`` of ``found`` that aren't hot, with the first documents of the keys."""

    def hashes(b: pa.RecordBatch) -> np.ndarray:
        return _hash([k for k in texts(b.column("key")) if k not in hot.value])

    some = twobloom.seen(found.select("key"), hashes, n, twice=False)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [sorted(k for k in _doc_keys(t) if k not in hot.value) for t in texts(b.column("text"))]
            flat = [k for ks in own for k in ks]
            at = np.repeat(np.arange(len(own)), [len(ks) for ks in own])
            maybe = some.value.has(_hash(flat))
            take = pa.array(at[maybe])
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("th").take(take), pa.array([flat[i] for i in np.flatnonzero(maybe).tolist()], pa.binary())], ["id", "th", "key"])

    only = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    pairs = only.mapInArrow(mine, "id long, th long, key binary").join(found.select("key", F.struct("id", "th").alias("first")), "key")
    return pairs.groupBy("id", "th").agg(F.collect_set(F.struct("key", F.col("first.id").alias("f"), F.col("first.th").alias("t"))).alias("own"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, broadcast_bytes: int = BROADCAST_BYTES, digest: bool = False) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``.

    With ``digest`` instead: doc_id, n_lines, n_dropped, kept_sha256.
    """
    found = stage(repeated_keys(docs, min_docs), "line-keys")
    hot = docs.sparkSession.sparkContext.broadcast(_hottest(found, broadcast_bytes))
    more = found.count() - len(hot.value)
    if not more:
        unstage(found)
    names = list(docs.columns)
    kept = ["text"] if digest else names
    rows = packed(docs, kept, id=F.col("doc_id").cast("long"), th=F.xxhash64("text"))
    if more:
        lists = _own_keys(docs, found, more, hot).select(F.col("id").alias("__i"), F.col("th").alias("__t"), "own")
        rows = rows.join(lists, F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")), "left").drop("__i", "__t")

    if digest:
        out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        out = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(unpacked(batches, kept)):
            here = list(zip(b.column(OWN + "id").to_pylist(), b.column(OWN + "th").to_pylist())) if keep_first else [None] * b.num_rows
            own = [{x["key"]: (x["f"], x["t"]) for x in d or ()} for d in b.column(OWN + "own").to_pylist()] if more else [{}] * b.num_rows
            made = [_cut(t, hot.value, d, h) for t, d, h in zip(texts(b.column("text")), own, here)]
            if digest:
                yield pa.RecordBatch.from_arrays(
                    [b.column(OWN + "id"), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2)), pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string())],
                    names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
                )
                continue
            null = b.column("text").is_null().to_pylist()
            text = pa.array([None if x else m[0].decode() for x, m in zip(null, made)], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(i) for i, c in enumerate(names)], names)

    done = rows.mapInArrow(cut, out)
    if not digest and "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done
