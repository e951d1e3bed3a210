"""Language ID by prediction by partial matching.

For each language a byte context tree of order 3 is counted on labelled text. A byte's code
length in a context is that of PPM with escape method C and exclusion: seen bytes share
n / (n + d), the escape d / (n + d) is shared by the unseen bytes as the next shorter context
predicts them, and below order 0 every byte costs 8 bits. With frozen statistics that length
depends on the byte and its context alone, so the trees are flattened into tables
(context, byte) -> code length, and scoring a text is table lookups and a sum. Languages of like
scripts share a table of bounded size; the model grows as the sum of the languages' own contexts.

Fitting sample (a documented bound): of each language the documents with the smallest hashes,
about ``SAMPLE_DOCS`` of them (with more than ``MANY_LANGS`` languages an equal share of as many rows),
one at least, and of each its first ``SAMPLE_CHARS`` characters (fewer, if all would be more than
``SAMPLE_TEXT``). Every label is learned; the table grows with their number. Scoring takes every whole text.

Edge cases: null text, or text without a letter, is ``und`` with score 0; so is everything if no
labelled text is left; null doc_id counts as the empty text in the fold; equal code lengths go
to the label that sorts first; repeated rows are scored alike; extra columns are ignored by
``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_view

SAMPLE_DOCS = 400
SAMPLE_CHARS = 32_768
#: Characters of the whole sample.
SAMPLE_TEXT = 64 << 20
#: Bytes of a text that are scored at once.
PART = 1 << 20
#: Languages that get SAMPLE_DOCS each.
MANY_LANGS = 64
#: Bytes of all tables, about; of one table of several languages at least.
MODEL_BYTES, BLOCK_BYTES = 128 << 20, 4 << 20
HELD_OUT = 2
FOLDS = 4
#: Bits per byte from which a text counts as noise in every known language (8 is incompressible).
NOISE_BITS = 7.5
PAD, OTHER = 0, 1


@dataclass
class Block:
    """Some languages' trees as one table, over the bytes and contexts that occur in them."""

    langs: list[int]  # their places among all languages
    classes: np.ndarray  # byte -> class
    context: np.ndarray  # class triple -> row of cost
    cost: np.ndarray  # (context * classes + class, language) -> bits


@dataclass
class Model:
    langs: list[str]
    blocks: list[Block]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every (three bytes before, byte) with its count; 256 stands for what is before a text."""
    parts = [np.r_[256, 256, 256, np.frombuffer(t, np.uint8).astype(np.int64)] for t in texts if t]
    c = np.concatenate(parts) if parts else np.zeros(3, np.int64)
    g = ((c[:-3] * 257 + c[1:-2]) * 257 + c[2:-1]) * 257 + c[3:]
    return np.unique(g[c[3:] != 256], return_counts=True)


def _lead(gram: tuple[np.ndarray, np.ndarray]) -> int:
    """The lead byte of two or more that a language uses most: languages of one script have equal or near ones."""
    last, n = gram[0] % 257, gram[1]
    return int(np.bincount(np.where(last >= 0xC0, last, 0), n, 257)[1:].argmax())


def fit(samples: dict[str, list[bytes]], rare: int = 2, block_bytes: int | None = None) -> Model:
    """Context trees of order 3. Order-3 contexts seen fewer than ``rare`` times in all languages fall to order 2.

    Languages share a table as long as it takes ``block_bytes`` or less (an equal share of MODEL_BYTES, but BLOCK_BYTES at least): it
    has a cell for each of their contexts and bytes, so tables of their own are smaller, if slower, and the model grows as their sum.
    """
    langs = sorted(samples)
    if block_bytes is None:
        block_bytes = max(BLOCK_BYTES, MODEL_BYTES // max(1, len(langs)))
    grams = [_grams(samples[lang]) for lang in langs]
    every = np.concatenate([g for g, _ in grams]) // 257 if langs else np.zeros(0, np.int64)
    weight = np.concatenate([n for _, n in grams]) if langs else np.zeros(0, np.int64)
    contexts, back = np.unique(every, return_inverse=True)
    kept = contexts[np.bincount(back, weight, len(contexts)) >= rare]
    blocks: list[Block] = []
    todo = [sorted(range(len(langs)), key=lambda i: (_lead(grams[i]), i))] if langs else []
    while todo:
        some = todo.pop()
        g = np.concatenate([grams[i][0] for i in some])
        rows = sum(len(np.unique(g // 257 % 257**order)) for order in range(4))
        if len(some) > 1 and rows * len(np.unique(g % 257)) * len(some) * 4 > block_bytes:
            todo += [some[: len(some) // 2], some[len(some) // 2 :]]
        else:
            blocks.append(_block(some, [grams[i] for i in some], kept))
    return Model(langs, blocks)


def _block(langs: list[int], raw: list[tuple[np.ndarray, np.ndarray]], kept: np.ndarray) -> Block:
    """The table of some languages; order-3 contexts are those of ``kept``."""
    seen = np.unique(np.concatenate([g % 257 for g, _ in raw]))
    classes = np.full(257, OTHER, np.int64)
    classes[seen] = np.arange(len(seen)) + 2
    classes[256] = PAD
    a, unseen = len(seen) + 2, max(1, 256 - len(seen))
    grams = []
    for g, n in raw:
        code = np.zeros(len(g), np.int64)
        for back in (257**3, 257**2, 257, 1):
            code = code * a + classes[g // back % 257]
        grams.append((code, n, np.isin(g // 257, kept)))
    flat = np.full(a, 1 / 256)
    flat[PAD], flat[OTHER] = 0, (256 - len(seen)) / 256
    probs = [np.zeros((0, a)) for _ in langs]  # rows: contexts of all orders so far
    rows = np.zeros(1, np.int64)  # context value at the shorter order -> row
    for order in range(4):
        span = a**order
        values = np.unique(np.concatenate([np.zeros(int(order == 0), np.int64), *((g if order < 3 else g[known]) // a % span for g, _, known in grams)]))
        at = np.full(span, -1, np.int64)
        at[values] = np.arange(len(values))
        for k, (g, n, _) in enumerate(grams):
            r = at[g // a % span]
            ok = r >= 0
            count = np.bincount(r[ok] * a + (g % a)[ok], n[ok], len(values) * a).reshape(len(values), a)
            base = probs[k][rows[values % a ** (order - 1)]] if order else np.repeat(flat[None], len(values), 0)
            distinct, total = (count > 0).sum(1, keepdims=True), count.sum(1, keepdims=True)
            rest = np.where(count > 0, 0, base)
            left = rest.sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen_p = np.where(left > 0, count / (total + distinct), count / total)
                p = np.where(count > 0, seen_p, distinct / (total + distinct) * rest / left)
            probs[k] = np.concatenate([probs[k], np.where(total > 0, np.nan_to_num(p), base)])
        rows = rows[np.arange(span) % a ** (order - 1)] if order else np.zeros(1, np.int64)
        rows[values] = np.arange(len(values)) + (len(probs[0]) - len(values))
    cost = np.empty((len(probs[0]), a, len(langs)), np.float32)
    for k in range(len(langs)):
        bits, probs[k] = -np.log2(np.maximum(probs[k], 1e-12)), None
        bits[:, PAD] = 0
        bits[:, OTHER] += np.log2(unseen)
        cost[:, :, k] = bits
    return Block(langs, classes[:256], rows.astype(np.uint16 if len(cost) < 1 << 16 else np.int32), cost.reshape(len(cost) * a, len(langs)))


def code_lengths(model: Model, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Bits of each text in each language: (texts, languages). Long texts are scored part by part, with the bytes before each."""
    if len(raw) <= 2 * PART:
        return _lengths(model, off, raw)
    out = np.zeros((len(off) - 1, len(model.langs)))
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        for at in range(a, z, PART):
            before = min(3, at - a)
            part = raw[at - before : min(z, at + PART)]
            out[i] += _lengths(model, np.array([0, len(part)]), part, before)[0]
    return out


def _lengths(model: Model, off: np.ndarray, raw: np.ndarray, before_first: int = 0) -> np.ndarray:
    """``code_lengths`` at once; of the first text, ``before_first`` bytes are only what comes before."""
    out = np.zeros((len(off) - 1, len(model.langs)))
    if not len(raw) or not model.langs:
        return out
    some = np.flatnonzero(np.diff(off) > 0)
    starts, ends = off[:-1][some], off[1:][some]
    for block in model.blocks:
        a = round(len(block.context) ** (1 / 3))
        sym = block.classes[raw]
        row = np.zeros(len(raw), np.int64)
        for back in (3, 2, 1):
            before = np.zeros(len(raw), np.int64)
            before[back:] = sym[:-back]
            for i in range(back):  # the first bytes of a text have no bytes before them
                before[np.minimum(starts + i, ends - 1)[starts + i < ends]] = PAD
            row *= a
            row += before
        row = block.context[row].astype(np.int64)
        row *= a
        row += sym
        cost = block.cost[row]
        cost[:before_first] = 0
        out[np.ix_(some, block.langs)] = np.add.reduceat(cost, starts, 0, np.float64)
    return out


def sample(docs: DataFrame) -> dict[str, list[bytes]]:
    """The bounded fitting sample of labelled documents outside the held-out fold."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = docs.where((fold != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    whole = 1 << 30
    rows = rows.select("lang", "text", "doc_id", F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(whole)).alias("u"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("least")).collect()
    if not counts:
        return {}
    each = max(1, SAMPLE_DOCS * min(MANY_LANGS, len(counts)) // len(counts))
    cuts = [(r["lang"], max(r["least"] + 1, min(whole, whole * each // r["n"]))) for r in counts]
    cuts = docs.sparkSession.createDataFrame(cuts, "lang string, cut long")
    chars = max(1, min(SAMPLE_CHARS, SAMPLE_TEXT // (each * len(counts))))
    found = rows.join(F.broadcast(cuts), "lang").where("u < cut").select("lang", F.substring("text", 1, chars).alias("text"), "doc_id").distinct().collect()
    out: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in sorted(found, key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"], r["text"])):
        out[r["lang"]].append(r["text"].encode())
    return {k: v for k, v in out.items() if v}


def _letters(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _scores(model: Model, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, posterior probability of the label, and its bits per byte, for each text."""
    off, raw = text_view(col)
    bits = code_lengths(model, off, raw)
    letters = _letters(col)
    if not model.langs:
        return ["und"] * len(col), np.zeros(len(col)), np.zeros(len(col))
    best = bits.argmin(1)
    low = bits[np.arange(len(best)), best]
    score = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(1)
    names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters, score, 0.0), np.where(letters, low / np.maximum(np.diff(off), 1), 0.0)


def predict(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, bits_per_byte."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs)))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            names, score, bits = _scores(model.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return docs.select(F.col("doc_id").cast("long"), (fold == HELD_OUT).alias("held_out"), "text").mapInArrow(run, schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without texts that are ``und`` or noise (NOISE_BITS a byte or more) in every language.

    Where no label is left to learn from, nothing can be judged but whether a text has a letter.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            names, _, bits = _scores(model.value, b.column("text"))
            keep = np.array([n != "und" for n in names]) & (bits < NOISE_BITS) if model.value.langs else _letters(b.column("text"))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
