import random
import unicodedata
import zlib

import numpy as np
import pytest
from helpers import edge_docs, frame, real_docs

from weir.llm import packing


@pytest.fixture(scope="module")
def tok():
    return packing._tokenizer(packing.tokenizer_path())[0]


def check(rows, capacity=2048):
    """Pieces lie gapless in sequences within the capacity; gives the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_equal_the_tokenizer(spark, tok):
    rows = edge_docs() + real_docs()[:50]
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pieces(frame(spark, rows)).collect()), key=repr)
    want = []
    for r in rows:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
    assert got == sorted(want, key=repr)


def test_encode_equals_the_tokenizer_on_odd_texts(tok, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 60)
    r = random.Random(5)
    letters = ["a", "B", "é", "É", "İ", "ß", "ς", "Σ", "1", "٣", " ", " ", "\n", "\t", "\x85", "\x1c", ".", ",", "'s", "'", "’", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", "ﬁ", "́", "中", "😀", "_", "-", "\0", "ǅ", " "]
    for _ in range(200):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(40)]
        got = packing.encode([t.encode() for t in texts], packing.tokenizer_path())
        assert [g.tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_letters_that_nfc_takes_apart(tok, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 60)
    apart = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and not unicodedata.normalize("NFC", c.lower()).isalpha()]
    assert {"\u09df", "\u0958", "\u0a33", "\ufb1d", "İ"} <= set(apart)
    texts = [t.format(c) for c in apart for t in ("{}", "{},", "a{}.", "{}a,", "{0}{0}.", "x {0}, {0}. y")] + ["\u09b9\u09df, \u09b8\u09ae\u09df."]
    r = random.Random(6)
    letters = [*apart, "a", "B", "中", " ", " ", ",", ".", "́", "1", "'s"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    got = packing.encode([t.encode() for t in texts], packing.tokenizer_path())
    assert [g.tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("rank_rows", [10**6, 20])
def test_packs_real_documents(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    df = frame(spark, edge_docs() + real_docs())
    pieces = packing.pieces(df).collect()
    rows = packing.pack_documents(df).collect()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, pieces))
    assert check(rows) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [[2048] * 5, [1] * 5000, [1025] * 40, [700] * 30 + [600] * 30, [257, 256, 255] * 50, [5], [1024] * 7 + [3] * 900])
def test_packs_awkward_lengths(spark, lengths):
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(lengths)))
    n = check(out)
    big = sum(x > 1024 for x in lengths)
    assert n <= max(big, -(-sum(lengths) // 2048)) + 2


def test_configurations_meet_demand():
    r = random.Random(1)
    for _ in range(20):
        sizes = sorted(r.sample(range(257, 2049), r.randint(1, 30)))
        demand = [r.randint(1, 50) for _ in sizes]
        done = [0] * len(sizes)
        for slots, times in packing.configurations(sizes, demand, 2048):
            assert times > 0 and sum(n * s for n, s in zip(slots, sizes)) <= 2048
            done = [d + n * times for d, n in zip(done, slots)]
        assert done == demand


def test_groups_are_even():
    counts = {n: 3 for n in range(300, 400)}
    groups = packing.groups_of(counts, 10)
    assert len(groups) == 10 and sum(g[2] for g in groups) == 300 and max(g[2] for g in groups) <= 33
