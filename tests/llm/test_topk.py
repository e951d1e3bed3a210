import math

import numpy as np
import pytest

from weir.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, codes string"


def brute(rows, k):
    quantised = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        quantised.setdefault((i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)))
    out = []
    for q, a in quantised:
        if q % 100 == 0:
            scores = {(-sum(x * y for x, y in zip(a, b)), i) for i, b in quantised if i != q and len(a) == len(b)}
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cell, block", [(16_384, 4_096), (50, 3)])
def test_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(topk, "CELL_ROWS", cell)
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [rows[100], rows[100], (401, None), (500, []), (600, [1.0, None]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (None, [1.0] * 6), (900, [0.5, 0.25]), (901, [1.0, 1.0]), (0, [0.0] * 6)][:-1]
    df = spark.createDataFrame([(i, v, None, "s", "r", "c") for i, v in rows], SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows, 10)


def test_empty_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, none).count() == 0
    few = spark.createDataFrame([(0, [1.0], 1, "", "", ""), (1, [-1.0], 1, "", "", "")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, -1048576)]


def test_slices_on_extremes():
    rng = np.random.default_rng(2)
    for n, d, lo, hi in ((1, 1, 0, 1), (130, 5, -3, 4), (500, 16, -(10**6), 10**6), (65, 2, 9, 10)):
        m, ids = rng.integers(lo, hi, (n, d)), np.arange(n)
        s = topk.BitSlices(m)
        for i in range(min(n, 25)):
            score = m @ m[i]
            want = [j for j in np.lexsort((ids, -score)) if j != i][:7]
            got, exact = s.search(ids, i, m[i], 7)
            assert got.tolist() == want and exact.tolist() == score[want].tolist()


def test_large_components_take_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_ROWS", 50)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=3))]) for i in range(300)]
    rows += [(400, [2.5e6, 1.0, 0.0]), (401, [-2.5e6, 0.5, 3.0]), (402, [2.2e6, -9.0, 2.0]), (500, [3e6, 0.25]), (501, [-0.5, 3e6]), (502, [9e14, 0.0]), (600, [4e12, 0.5, 0.5, 1.0]), (601, [0.5, 4e12, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, None, "s", "r", "c") for i, v in rows if i != 502], SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute([r for r in rows if r[0] != 502], 10)
    for more in ((502, [9e14, 0.0]), (503, [1e17, 0.0])):  # with 500 a score of 2.8e27; a code of 1e20
        wide = spark.createDataFrame([(i, v, None, "s", "r", "c") for i, v in (rows[303], more)], SCHEMA)
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.top_k(wide, wide.where("vec_id = 500")).collect()


def test_slices_on_all_64_bits():
    rng = np.random.default_rng(3)
    m, ids = rng.integers(-(2**63) + 1, 2**63 - 1, (200, 3)), np.arange(200)
    m[100:] >>= 40
    s = topk.BitSlices(m)
    for i in range(0, 200, 9):
        q = m[i] >> 62 if i < 100 else m[i]
        score = m.astype(object) @ q.astype(object)
        want = [j for j in sorted(ids.tolist(), key=lambda j: (-score[j], j)) if j != i][:7]
        if all(abs(score[j]) < 2**63 for j in want):
            got, exact = s.search(ids, i, q, 7)
            assert got.tolist() == want and exact.tolist() == [score[j] for j in want]
        else:
            with pytest.raises(OverflowError):
                s.search(ids, i, q, 7)
