import random

import numpy as np
import pytest
import xxhash
from helpers import edge_docs, frame, lower, real_docs, rows_of, words

from weir.llm import simhash
from weir.llm.components import components


def brute(text):
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, d):
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                par[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_documents_equal_brute_force(spark):
    rows = [*edge_docs(), *real_docs()]
    near = dict(real_docs()[3])
    rows.append({**near, "doc_id": 5000, "text": near["text"] + " more"})
    fps = [brute(r["text"]) for r in rows]
    root = closure(fps, 4)
    low = {}
    for r, c in zip(rows, root):
        ids = [x["doc_id"] for x, k in zip(rows, root) if k == c and x["doc_id"] is not None]
        low[c] = min(ids, default=None)
    expected = sorted(((r["doc_id"], f"{f:016x}", low[c]) for r, f, c in zip(rows, fps, root)), key=repr)
    assert rows_of(simhash.near_duplicates(frame(spark, rows)), "doc_id", "fingerprint", "component_id") == expected


@pytest.mark.parametrize("group, bulk", [(8192, 8), (6, 3)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, group, bulk):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "BULK", bulk)
    r = random.Random(group)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = {0}
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    root = closure(fps, 4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    stars = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4))
    to = {r["a"]: r["b"] for r in stars.collect()}
    got, want = {}, {}
    for f, c in zip(signed, root):
        got.setdefault(to.get(f, f), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    size = np.r_[np.arange(140), rng.integers(0, 60, 300)]
    start = rng.integers(0, len(raw) - 140, len(size))
    start[-1], size[-1] = len(raw) - 37, 37
    want = [xxhash.xxh64_intdigest(raw[a : a + n].tobytes(), 42) for a, n in zip(start.tolist(), size.tolist())]
    assert simhash.xxh64(raw, start, size, 42).tolist() == want
    assert len(simhash.xxh64(raw[:0], start[:0], size[:0], 42)) == 0


def test_fingerprints_of_long_texts_and_none():
    texts = ["", "one", " ".join(f"w{i % 7919}" for i in range(90_000)), "a b c d", " ", "x " * 70_000, "A b C d e"]
    assert simhash.fingerprints_of([t.encode() for t in texts]).tolist() == [brute(t) for t in texts]
    assert simhash.fingerprints_of([]).tolist() == [] and simhash.fingerprints_of([b"", b" "]).tolist() == [0, 0]


def test_any_column_names(spark):
    df = frame(spark, edge_docs() + edge_docs()).withColumnsRenamed({"key": "gone", "spans": "__gone", "pii": "th", "size": "row", "id": "first"})
    out = simhash.keep_one(df)
    assert out.columns == df.columns and 0 < out.count() < df.count()


def test_plan_meets_the_pigeonhole_bound():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**10):
        p = simhash.plan(rng.integers(0, 2**63, 300, dtype=np.uint64), n, 4)
        # A ball of radius r finds distance 2r; some part must always lie within its threshold.
        spare = sum(2 * r + 1 for r in p.radii)
        assert spare >= 5 and sum(map(len, p.parts)) <= 64


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 6)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rows = edge_docs() + real_docs()
    rows.append({**rows[-1], "text": "another text under the same id"})
    rows.append({**real_docs()[4], "doc_id": 3})  # id 3 again, a copy of document 4
    df = frame(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    fps = {}
    for r, c in zip(rows, closure([brute(r["text"]) for r in rows], 4)):
        fps.setdefault(c, set()).add((r["doc_id"], r["text"]))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(fps)
    low = lambda g: min((i for i, _ in g if i is not None), default=None)
    assert all(len(set(got) & g) == 1 and (set(got) & g).pop()[0] == low(g) for g in fps.values())
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
