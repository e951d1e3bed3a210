import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import edge_docs, frame, lower, real_docs

from weir.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, term string, shard long"


def found(text):
    return TERM.findall(lower(text or ""))


def brute(rows, items, k):
    """(item_id, rank, doc_id, score) by definition."""
    docs = [(r["doc_id"], Counter(found(r["text"]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    want = {}
    for i, text in items:
        want.setdefault(i, set()).update(found(text))
    out = []
    for i, own in want.items():
        scored = [(-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * x * n // total))) for t in own if t in c), d is None, d or 0) for d, c, x in docs]
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return out


def got(spark, rows, items, k):
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    out = lexical.search(lexical.build_index(frame(spark, rows).repartition(3)), asked, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in out.collect()]


def items_of(rows):
    r = random.Random(3)
    own = [(i, " ".join(r.sample((x["text"] or "").split(), min(12, len((x["text"] or "").split()))))) for i, x in enumerate(rows[::9])]
    return [*own, (None, "same text"), (500, None), (501, "... !"), (502, "nowhere_to_be_found0"), (503, "SAME same École 日本語"), (503, "tail"), (503, "tail"), (504, "na")]


@pytest.mark.parametrize("shard", [lexical.SHARD, 30_000])
@pytest.mark.parametrize("k", [5, 50])
def test_search_equals_brute_force(spark, monkeypatch, shard, k):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK", 128 if shard > 10**6 else 4)
    monkeypatch.setattr(lexical, "PART", 1000)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 4 << 20 if k == 5 else 2000)
    rows = edge_docs() + real_docs() + real_docs()[:40]
    items = items_of(rows)
    assert sorted(got(spark, rows, items, k), key=repr) == sorted(brute(rows, items, k), key=repr)


def test_many_equal_scores(spark, monkeypatch):
    """A third of all rows are copies: of equal scores the smaller ids stay, in whatever shard they lie."""
    monkeypatch.setattr(lexical, "SHARD", 4000)
    rows = [{"doc_id": (i * 7919) % 3001, "text": "hot words here" if i % 3 else f"own {i} words", "lang": None, "source": None} for i in range(900)]
    items = [(1, "hot words"), (2, "words"), (3, "own 7")]
    assert sorted(got(spark, rows, items, 50)) == sorted(brute(rows, items, 50))


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")], 5) == []
    assert got(spark, real_docs()[:5], [], 5) == []
    assert got(spark, [{"doc_id": 1, "text": None, "lang": None, "source": None}], [(1, "a")], 5) == []


def test_variable_length_numbers():
    r = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 0, 2**40], r.integers(0, 1 << r.integers(1, 45, 5000))):
        data, ends = lexical.encode(np.array(values, np.int64))
        assert lexical.decode(data.tobytes()).tolist() == list(values) and (not len(ends) or ends[-1] == len(data))


def test_blocks_below_the_threshold_stay_closed():
    """Documents that hold a rare word lie together: the blocks of a common one elsewhere aren't decompressed."""
    shard = lexical._Shard()
    texts = [b"common rare" if 400 <= i < 460 else b"common other" for i in range(20_000)]
    shard.add(list(range(len(texts))), texts)
    ids, m, lists = next(lexical._shards(shard.rows(0, len(texts), 2 * len(texts))))
    walk = lexical.Walk([(lists[b"common"], 5), (lists[b"rare"], 9000)], ids, m, 50)
    score, docs = walk.run((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert docs.tolist() == list(range(400, 450)) and len(set(score.tolist())) == 1
    assert walk.opened < 10 < len(walk.n)


def test_a_long_text_is_one_document(spark):
    text = "alpha beta " * 300_000 + "x" * 3_000_000 + " gamma"
    rows = [{"doc_id": 1, "text": text, "lang": None, "source": None}, *real_docs()[:20]]
    items = [(1, "alpha gamma"), (2, "x" * 3_000_000)]
    assert sorted(got(spark, rows, items, 3)) == sorted(brute(rows, items, 3))
