import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import edge_docs, frame, real_docs, rows_of

from weir.llm import bpe
from weir.llm.common import text_view


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.ranks_path()).ids, special_tokens={})


def ids_of(texts):
    return [x.tolist() for x in bpe.encode_texts(*text_view(pa.array(texts, pa.string())), bpe.ranks_path())]


LETTERS = ["a", "b", "th", "e", " ", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "'re", "'ll", "'v", "ve", "é", "É", "1", "23", "٣", "½", "中", "文", "😀", "\x85", "\x1c", " ", " ", ".", "!", "_", "-", "́", "ǅ", "s", "t", "re", "l", "\0", "ꟍ", "\U00010d40", "<|endoftext|>"]


@pytest.mark.parametrize(("window", "at_once", "chain"), [(1 << 20, 100_000, 1 << 20), (32, 7, 40), (65, 1, 1)])
def test_ids_equal_the_library(library, monkeypatch, window, at_once, chain):
    for name, value in (("WINDOW", window), ("AT_ONCE", at_once), ("CHAIN", chain), ("KEPT", 2000)):
        monkeypatch.setattr(bpe, name, value)
    r = random.Random(window)
    for _ in range(12):
        texts = ["".join(r.choice(LETTERS) for _ in range(r.choice([0, 3, 20, 90]))) for _ in range(150)]
        texts += [" ".join("".join(r.choice("aeionrst") for _ in range(r.randint(1, 30))) for _ in range(9)) for _ in range(20)]
        assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_ids_equal_the_library_on_every_character(library):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = ["".join(every[i : i + 997]) for i in range(0, len(every), 997)] + [f"a{c} {c}b" for c in every[:0x3100]]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_replay_waits_for_lower_ranks(monkeypatch):
    """Ranks made so that merges lead to pairs of lower and of equal rank; against the definition, word by word."""
    r = random.Random(7)

    def lowest_first(word, ids):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
            if not found:
                return [ids[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(60):
        tokens = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(r.randint(3, 40))})
        r.shuffle(tokens)
        table = object.__new__(bpe.Ranks)
        table.ids = {bytes([b]): 1000 + b for b in range(256)} | {t: i for i, t in enumerate(tokens)}
        table.byte = bpe.np.array([1000 + b for b in range(256)])
        table.pairs = {table.ids[a] << 32 | table.ids[b]: table.ids[a + b] for a in table.ids for b in table.ids if a + b in table.ids}
        table.first = bpe.np.array([[table.ids.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        some = list({bytes(r.choice(b"abc") for _ in range(r.randint(1, 24))) for _ in range(80)})
        got = [bpe.np.frombuffer(x, "<u4").tolist() for x in bpe.replay(some, table)]
        assert got == [lowest_first(w, table.ids) for w in some]


def test_round_trip_equals_the_library(spark, library):
    rows = edge_docs() + real_docs()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    out = bpe.round_trip(frame(spark, rows))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows_of(out, *out.columns) == sorted(want, key=repr)


def test_encode_and_decode_keep_columns(spark, library):
    rows = edge_docs() + real_docs()[:20]
    df = frame(spark, rows).withColumnsRenamed({"key": "own", "size": "row", "id": "a.b"})
    out = bpe.decode(bpe.encode(df))
    assert out.columns == [*df.columns, "ids", "decoded"]
    got = sorted(((r["doc_id"], r["row"], r["a.b"], tuple(r["ids"]), bytes(r["decoded"]).decode()) for r in out.collect()), key=repr)
    assert got == sorted(((r["doc_id"], "s", 1, tuple(library.encode_ordinary(r["text"] or "")), r["text"] or "") for r in rows), key=repr)
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(df.withColumn("ids", df["row"]))
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "n long, ids array<int>")
    tokens = bpe.ranks(bpe.ranks_path()).tokens
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in bpe.decode(nulls).orderBy("n").collect()] == [None, b"", tokens[0] + tokens[1]]


def test_long_text_and_long_word(spark, library):
    r = random.Random(2)
    word = "".join(r.choice("abcdefghij") for _ in range(300_000))
    texts = [word, ("many words, " * 200_000) + "end", " " * 300_000 + "x"]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_empty(spark):
    df = frame(spark, [])
    assert bpe.round_trip(df).count() == 0 and bpe.encode(df).count() == 0 and bpe.decode(bpe.encode(df)).count() == 0
