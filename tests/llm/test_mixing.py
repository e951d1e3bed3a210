from collections import defaultdict

import pytest
from helpers import edge_docs, frame, real_docs, rows_of, words

from weir.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def docs():
    return edge_docs() + real_docs() + [{"doc_id": 8000 + i, "text": "w " * (i % 7), "lang": None, "source": "big"} for i in range(900)]


def test_words_meet_targets(spark):
    rows = docs()
    out = mixing.mix_words(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    copies = 2  # the edge documents have one row twice
    assert all(abs(taken[s] - want[s]) <= copies for s in sizes)
    again = mixing.mix_words(frame(spark, rows[::-1]).repartition(5))
    assert rows_of(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in out), key=repr)


def test_order_is_random_but_fixed(spark):
    rows = real_docs()
    a = {r["doc_id"]: r["taken"] for r in mixing.mix_words(frame(spark, rows)).collect()}
    b = {r["doc_id"]: r["taken"] for r in mixing.mix_words(frame(spark, rows), seed=1).collect()}
    assert a != b


def test_mix_repeats_whole_documents(spark):
    df = frame(spark, docs())
    out = mixing.mix(df)
    assert out.columns == df.columns
    words_of = {r["doc_id"]: r for r in mixing.mix_words(df).where("doc_id < 10000 or doc_id > 10020").collect()}
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    off = [i for i, r in words_of.items() if r["size"] and abs(n.get(i, 0) - r["taken"] / r["size"]) > 0.5]
    assert not off
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_words(df.limit(0)).count() == 0


def test_one_row_repeated_many_times(spark):
    df = frame(spark, [{"doc_id": 1, "text": "a b c", "lang": "x", "source": "s"}] * 500 + [{"doc_id": 2, "text": "d", "lang": "x", "source": "t"}])
    out = mixing.mix_words(df).collect()
    assert len({r["taken"] for r in out if r["doc_id"] == 1}) == 1
    assert sum(r["taken"] for r in out if r["doc_id"] == 1) == pytest.approx(out[0]["target"] if out[0]["doc_id"] == 1 else out[-1]["target"], abs=500)
