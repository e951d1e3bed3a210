import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import WS, edge_docs, frame, lower, real_docs, rows_of

from weir.llm import linededup, twobloom


def brute(rows, min_docs, first=False):
    key = lambda line: lower(line).strip(WS)
    n = Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    drop = {k for k, c in n.items() if c >= min_docs}
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0))
    seen, out = {}, {}
    for i in order:
        text = rows[i]["text"] or ""
        here, kept = (rows[i]["doc_id"], text), []
        mine = set()
        for line in text.split("\n"):
            k = key(line)
            if k in drop:
                owner = seen.setdefault(k, here)
                if not first or owner != here or k in mine:
                    continue
                mine.add(k)
            kept.append(line)
        out[i] = (len(text.split("\n")), len(text.split("\n")) - len(kept), "\n".join(kept))
    return [out[i] for i in range(len(rows))]


def docs():
    rows = edge_docs() + real_docs()
    return rows + [{"doc_id": 7000 + i, "text": f"  Shared LINE {'x' if i % 2 else 'X'}\t\nown {i}\nshared line x", "lang": "en", "source": "s"} for i in range(6)]


@pytest.mark.parametrize("limit", [32 << 20, 0])
@pytest.mark.parametrize("min_docs", [2, 5])
def test_digest_equals_brute_force(spark, limit, min_docs):
    rows = docs()
    want = sorted(((r["doc_id"], n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (n, d, t) in zip(rows, brute(rows, min_docs))), key=repr)
    out = linededup.dedup_lines(frame(spark, rows), min_docs, broadcast_bytes=limit, digest=True)
    assert rows_of(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_keep_first_keeps_other_columns(spark, limit):
    rows = [r for r in docs() if r["text"] != "same id, other text"]
    df = frame(spark, rows)
    out = linededup.dedup_lines(df, 3, keep_first=True, broadcast_bytes=limit)
    assert out.columns == df.columns
    want = sorted(((r["doc_id"], None if r["text"] is None else t, "k") for r, (_, _, t) in zip(rows, brute(rows, 3, True))), key=repr)
    assert rows_of(out, "doc_id", "text", "key") == want
    assert out.where("text is not null and n_chars <> length(text)").count() == 0


def test_empty(spark):
    df = frame(spark, [])
    assert linededup.dedup_lines(df).count() == 0 and linededup.dedup_lines(df, digest=True).count() == 0


def test_two_filters_never_miss(spark, monkeypatch):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows = np.concatenate([h, h[:50], h[1900:2000], h[:7]])
    df = spark.createDataFrame([(int(x),) for x in rows.view(np.int64)], "h long").repartition(3)
    hashes = lambda b: b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
    again = np.concatenate([h[:50], h[1900:2000]])
    for segment, most in ((1 << 19, 1 << 28), (100, 1 << 28), (100, 1 << 14), (1, 1 << 10)):
        monkeypatch.setattr(twobloom, "SEGMENT", segment)
        monkeypatch.setattr(twobloom, "MAX_BITS", most)
        twice = twobloom.seen(df, hashes, len(rows)).value
        assert len(twice.data) * 8 <= most and twice.has(again).all()
        assert most < 1 << 20 or twice.has(h).mean() < 0.1
        assert twobloom.seen(df, hashes, len(rows), twice=False).value.has(h).all()
    assert twobloom.seen(df.limit(0), hashes, 0).value.has(h).sum() == 0


def test_hot_line_beside_many_others(spark):
    """Some keys are broadcast, the others joined; the hottest are the broadcast ones."""
    rows = [{"doc_id": i, "text": f"hot\nline {i % 40}\n{i}\n" + "long " * 300 * (i % 50 == 0), "lang": "en", "source": "s"} for i in range(400)]
    want = sorted(((r["doc_id"], n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (n, d, t) in zip(rows, brute(rows, 8))), key=repr)
    for limit in (110, 1000):
        out = linededup.dedup_lines(frame(spark, rows), 8, broadcast_bytes=limit, digest=True)
        assert rows_of(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    found = linededup.repeated_keys(frame(spark, rows), 8)
    assert set(linededup._hottest(found, 110)) == {b"hot"}


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_any_column_names(spark, limit):
    df = frame(spark, docs()).withColumnsRenamed({"key": "__id", "spans": "__th", "pii": "own", "size": "row", "id": "__i"})
    out = linededup.dedup_lines(df, 3, broadcast_bytes=limit)
    assert out.columns == df.columns and rows_of(out, "doc_id", "__id", "row") == rows_of(df, "doc_id", "__id", "row")
