import random
import re
import zlib
from collections import Counter

import pytest
from helpers import edge_docs, frame, lower, real_docs

from weir.llm import spelling


def brute_words(rows, every, shortest):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    return n


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def brute(n, ratio):
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w in n:
        own = [v for k in (-1, 0, 1) for v in by.get(len(w) + k, []) if near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        count[w], form[w] = len(own), best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n.get(form[w])))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("part", "counted"), [(1 << 20, 4 << 20), (50, 500)])
def test_query_equals_brute_force(spark, monkeypatch, part, counted):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "COUNTED", counted)
    rows = edge_docs() + real_docs() + [{"doc_id": i, "text": "Receive receive RECEIVE, received! recieve÷ÀÉé", "lang": None, "source": None} for i in range(300)]
    n = brute_words(rows, 31, 7)
    want = brute({w: c for w, c in n.items() if c >= 2}, 10)
    assert got(spelling.variant_groups(frame(spark, rows).repartition(5))) == want
    assert any(r[1] for r in want) and max(r[4] for r in want) > 5


@pytest.mark.parametrize("literal", [64, 5, 9])
@pytest.mark.parametrize("ratio", [2, 10])
def test_variants_of_dense_words(spark, monkeypatch, literal, ratio):
    """Words over a few letters: full groups, doubled letters, ties, long ways to a root; names as text, hashed, and both."""
    monkeypatch.setattr(spelling, "LITERAL", literal)
    monkeypatch.setattr(spelling, "NAMES", 100)
    r = random.Random(literal + ratio)
    words = {"".join(r.choice("abß") for _ in range(r.randint(3, 10))) for _ in range(700)} | {"a" * i for i in range(3, 12)}
    n = {w: int(10 ** r.uniform(0.3, 7)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert got(spelling.variants(df, ratio)) == brute(n, ratio)


def test_long_ways(spark):
    """Each word's form is the next, ten times as frequent."""
    word, n = list("abcdefghijkl"), {}
    for i in range(12):
        n["".join(word)] = 2 * 10**i
        word[i] = "z"
    out = got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out == brute(n, 10) and {r[2] for r in out} == {"zzzzzzzzzzzl"}


def test_long_words(spark):
    """Names of a long word take space in proportion to its length."""
    r = random.Random(4)
    word = "".join(r.choice("acgt") for _ in range(20_000))
    other = word[:9000] + "x" + word[9001:]
    n = {word: 100, other: 3, word[:500] + word[501:]: 5, word + "a": 7}
    assert sum(map(len, spelling.names(word)[0])) < 100 * len(word)
    assert got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n, 10)
    rows = [{"doc_id": i, "text": f"{w}, {w}", "lang": None, "source": None} for i, w in enumerate(n)]
    assert {r[0] for r in got(spelling.variant_groups(frame(spark, rows), every=1 << 40))} == set(n)


def test_empty(spark):
    assert got(spelling.variant_groups(frame(spark, []))) == []
    assert got(spelling.variant_groups(frame(spark, [{"doc_id": 1, "text": None, "lang": None, "source": None}]))) == []
    with pytest.raises(ValueError, match="frequent"):
        spelling.variants(spark.createDataFrame([], "word string, n long"), 1)
