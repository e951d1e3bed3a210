"""Spelling variants: each word's near words and the far more frequent one among them, without pairs.

Near words differ by one inserted, deleted or replaced code point. Words are numbered by falling frequency
(ties by code points), so of several near words the best is the smallest number.

* Replacements: a word stands in one group for each place, named by the place, the prefix before and the suffix after. Members of a
  group are near each other and in no second group together. A group keeps its size and its two best words: a
  member has size - 1 near words there, the best of which is the first, for the first itself the second.
* Insertions and deletions: a word less one code point joins the vocabulary where that is a word. Each such link gives the longer word
  a near word and the shorter one; there are at most as many as code points in the vocabulary.

Both give rows (word, near words, best of them), summed by word; no pairs are made, and as a group's words
differ at one place only, it has no more of them than the alphabet has letters. ``root`` follows forms by
doubling: a form is at least ``ratio`` times as frequent, so paths are short.

A name of ``LITERAL`` code points or more is a polynomial hash of 127 bits, as places and names of a long word would take the square of its length
otherwise; shorter names are the text itself.

Edge cases: null and empty texts have no words; repeated rows count each; ``doc_id`` null reads as the
empty string in the hash; words found once are no words; an empty table gives an empty result; extra columns are ignored. Texts
are searched ``PART`` bytes at a time, and a run is never cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, slices, stage, text_view

LETTERS = r"A-Za-zÀ-ÿ"
_CUT = re.compile(rb"[^A-Za-z\x80-\xff]")
#: Bytes of a text searched at once; bytes of words counted before they are sent; code points from which names are hashed; rows of names sent at once.
PART, COUNTED, LITERAL, NAMES = 1 << 20, 4 << 20, 64, 20_000
_PRIME, _BASE = (1 << 127) - 1, 0x1F3D5B79_2C4E6A80_13579BDF_02468ACF


def typo(doc_id: object, run: str, every: int) -> str:
    """``run`` less one code point for one of ``every`` hashes of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, every: int = 31, shortest: int = 7) -> DataFrame:
    """word, n: what the runs of letters of all texts come to, of ``shortest`` code points at least."""
    runs = re.compile(rf"[{LETTERS}]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in slices(batches):
            off, raw = text_view(b.column("text"))
            whole, cuts = raw.tobytes(), off.tolist()
            for i, at, end in zip(b.column("doc_id").to_pylist(), cuts, cuts[1:]):
                while at < end:
                    to = _CUT.search(whole, at + PART, end)
                    to = to.start() if to else end
                    for run, n in Counter(runs.findall(whole[at:to].translate(LOWER).decode())).items():
                        word = typo(i, run, every)
                        if len(word) >= shortest:
                            if word not in held:
                                size += len(word) + 100
                            held[word] += n
                    at = to
                    if size > COUNTED:
                        yield send()
                        held.clear()
                        size = 0
        if held:
            yield send()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hashed(length: int, place: int, *parts: int) -> bytes:
    return b"\xff%d:%d:" % (length, place) + b"".join(p.to_bytes(16, "little") for p in parts)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) % _PRIME
    return h


def word_name(word: str) -> bytes:
    """The name under which deletions find a word."""
    return word.encode() if len(word) < LITERAL else _hashed(len(word), 0, _hash(word))


def names(word: str) -> tuple[list[bytes], list[bytes]]:
    """A word's (wildcard groups, names of its distinct deletions); a letter that equals the one before gives no new deletion."""
    n = len(word)
    fresh = [i == 0 or word[i] != word[i - 1] for i in range(n)]
    if n < LITERAL:
        wild = [f"{word[:i]}\0{word[i + 1 :]}".encode() for i in range(n)]
        return wild, [f"{word[:i]}{word[i + 1 :]}".encode() for i in range(n) if fresh[i]]
    before, after, power = [0] * (n + 1), [0] * (n + 1), 1
    for i, c in enumerate(word):
        before[i + 1] = (before[i] * _BASE + ord(c) + 1) % _PRIME
    powers = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        powers[n - 1 - i] = power  # _BASE to the number of code points after i
        after[i] = ((ord(word[i]) + 1) * power + after[i + 1]) % _PRIME
        power = power * _BASE % _PRIME
    wild = [_hashed(n, i + 1, before[i], after[i + 1]) for i in range(n)]
    if n - 1 < LITERAL:
        return wild, [f"{word[:i]}{word[i + 1 :]}".encode() for i in range(n) if fresh[i]]
    return wild, [_hashed(n - 1, 0, (before[i] * powers[n - 1 - i] + after[i + 1]) % _PRIME) for i in range(n) if fresh[i]]


def _named(words: DataFrame) -> DataFrame:
    """id, kind (w wildcard group, d deletion, v word), name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kinds, own = [], [], []

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(own, pa.binary())], ["id", "kind", "name"])

        for b in batches:
            for i, word in zip(b.column("id").to_pylist(), b.column("word").to_pylist()):
                wild, less = names(word)
                for kind, some in (("w", wild), ("d", less), ("v", [word_name(word)])):
                    ids += [i] * len(some)
                    kinds += [kind] * len(some)
                    own += some
                if len(ids) > NAMES:
                    yield send()
                    ids, kinds, own = [], [], []
        yield send()

    return words.select("id", "word").mapInArrow(run, "id long, kind string, name binary")


def _near(named: DataFrame) -> DataFrame:
    """id, n_near, best: each word that has near words."""
    group = Window.partitionBy("name")
    wild = named.where("kind = 'w'").select("name", "id")
    wild = wild.select("id", F.count("*").over(group).alias("size"), F.min("id").over(group).alias("first"), F.nth_value("id", 2).over(group.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"))
    replaced = wild.where("size > 1").select("id", (F.col("size") - 1).alias("n_near"), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    less, whole = (named.where(F.col("kind") == k).select("name", F.col("id").alias(c)) for k, c in (("d", "longer"), ("v", "shorter")))
    links = less.join(whole, "name").select(F.explode(F.array(F.struct(F.col("longer").alias("id"), F.col("shorter").alias("best")), F.struct(F.col("shorter").alias("id"), F.col("longer").alias("best")))).alias("x"))
    moved = links.select("x.id", F.lit(1).cast("long").alias("n_near"), "x.best")
    return replaced.unionByName(moved).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and their counts, word and n.

    ``form`` is the most frequent near word (ties: the smallest), if it is ``ratio`` (2 at least) times as frequent as the word.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, or they need not end")
    # Range partitions follow one another, and so do the numbers given in them.
    words = stage(words.select("word", "n").orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "words", narrow=False)
    near = _near(stage(_named(words), "names", narrow=False))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    out = words.join(near, "id", "left").join(best, "best", "left")
    short = F.col("form_n") < ratio * F.col("n")
    out = out.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(~short, F.col(c)).alias(c) for c in ("form", "form_n")], F.when(~short, F.col("best")).alias("up"))
    out = stage(out, "forms", narrow=False)
    # Words that have a form, and the end of the way from each, found by doubling.
    way = out.where("up is not null").select("id", "up")
    while True:
        onward = way.select(F.col("id").alias("up"), F.col("up").alias("further"))
        longer = stage(way.join(onward, "up", "left").select("id", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "way")
        way = longer.select("id", "up")
        if not longer.where("moved").limit(1).count():
            break
    ends = words.select(F.col("id").alias("up"), F.col("word").alias("root"))
    roots = way.join(ends, "up").select("id", "root")
    return out.drop("up").join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, every: int = 31, shortest: int = 7, least: int = 2, ratio: int = 10) -> DataFrame:
    """``variants`` of the words of documents that occur ``least`` times."""
    return variants(count_words(docs, every, shortest).where(F.col("n") >= least), ratio)
