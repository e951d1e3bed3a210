import hashlib
import random

import numpy as np
import pytest
from helpers import edge_docs, frame, real_docs, rows_of, words

from weir.llm import substring


def brute(rows, window):
    """Rows of equal id and text are one document; others of one id follow by text hash, which no test needs."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0))
    seen, out = {}, {}
    for i in order:
        w = words(rows[i]["text"])
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            place = (rows[i]["doc_id"], rows[i]["text"], s)
            if seen.setdefault(tuple(w[s : s + window]), place) != place:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return [out[i] for i in range(len(rows))]


def docs():
    r = random.Random(9)
    rows = [x for x in edge_docs() if x["text"] != "same id, other text"] + real_docs()[:60]
    passage = " ".join(r.choice("alpha beta gamma delta eps".split()) + str(r.randrange(50)) for _ in range(70))
    for i in range(12):
        rows.append({"doc_id": 900 + i, "text": f"start{i} " * i + passage + f"\nend{i}" * i, "lang": "en", "source": "s"})
    rows.append({"doc_id": 950, "text": "ab " * 30 + "x " + "ab " * 25, "lang": "en", "source": "s"})
    return rows


@pytest.mark.parametrize("window", [20, 5, 1])
def test_digest_equals_brute_force(spark, window):
    rows = docs()
    want = sorted(((r["doc_id"], n, g, hashlib.sha256(t.encode()).hexdigest()) for r, (n, g, t) in zip(rows, brute(rows, window))), key=repr)
    assert rows_of(substring.dedup_passages(frame(spark, rows), window, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("change", [{"HOT": 2, "SAMPLED": 1}, {"CHUNK": 100, "GROUP": 500}, {"AT_ONCE": 2000, "CHUNK": 100, "GROUP": 1 << 40}, {"FEW": 1 << 40}, {"FEW": 1 << 40, "HOT": 2, "SAMPLED": 1}, {"FEW": 9, "CHUNK": 4000, "GROUP": 3000}])
def test_hot_anchors_and_small_groups(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(substring, name, value)
    rows = docs()
    want = sorted(((r["doc_id"], g) for r, (_, g, _) in zip(rows, brute(rows, 20))), key=repr)
    assert rows_of(substring.dedup_passages(frame(spark, rows), 20, digest=True), "doc_id", "n_removed") == want


def test_texts_keep_columns(spark):
    df = frame(spark, docs())
    out = substring.dedup_passages(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("text is null").count() == df.where("text is null").count()
    assert substring.dedup_passages(df.limit(0)).count() == 0


def pieces(rng, n, words):
    text = [b" ".join(b"ab"[x : x + 1] for x in rng.integers(0, 2, rng.integers(3, words))) for _ in range(n)]
    text = list(dict.fromkeys(text))
    k = np.arange(len(text))
    return substring.Pieces(text, k.astype(np.uint64), k // 3 - 2, k > 4, k % 2, 5 * k, k % 3 == 1)


def test_subtrees_equal_brute_force():
    rng = np.random.default_rng(3)
    for window in (3, 4, 7):
        p = pieces(rng, 40, 25)
        split = [t.split() for t in p.text]
        where = {}
        for i, w in enumerate(split):
            for x in range(len(w) - window + 1):
                where.setdefault(tuple(w[x : x + window]), []).append((bool(p.known[i]), int(p.id[i]), int(p.th[i]), int(p.first[i]) + x))
        want = sorted(place for places in where.values() for place in places if place != min(places))
        row, first, to = substring.repeats_in(p, window)
        assert sorted((bool(p.known[i]), int(p.id[i]), int(p.th[i]), f) for i, f in zip(row.tolist(), first.tolist())) == want
        assert (to - first == window).all()
        # Branching nodes: runs of words that are followed by different words, or by an end, at least twice.
        next_words = {}
        for i, w in enumerate(split):
            for x in range(len(w) - window + 1):
                for y in range(x + window, len(w) + 1):
                    next_words.setdefault(tuple(w[x:y]), []).append(w[y] if y < len(w) else (i, x))
        nodes = sorted((len(r), r, len(n)) for r, n in next_words.items() if len(set(n)) > 1)
        tree = substring._tree(p, window)
        got = [(d, tuple(split[tree.piece[a]][tree.inner[a] : tree.inner[a] + d]), int(n)) for d, one, count in tree.branching() for a, n in zip(one, count)]
        assert sorted(got) == nodes


def test_windows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(substring, "_rolling", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    p = pieces(np.random.default_rng(5), 20, 12)
    tree = substring._tree(p, 3)
    name = [tuple(p.text[i].split()[x : x + 3]) for i, x in zip(tree.piece.tolist(), tree.inner.tolist())]
    named = {(n, w) for n, w in zip(tree.node.tolist(), name) if n >= 0}
    assert len(named) == len({n for n, _ in named}) == len({w for _, w in named})


def test_pieces_survive_packing():
    p = pieces(np.random.default_rng(1), 30, 9)
    q = substring.Pieces.unpack(p.pack())
    assert p.text == q.text and all((getattr(p, c) == getattr(q, c)).all() for c in ("key", "id", "known", "th", "first", "loops"))


def test_pieces_survive_rows():
    p = pieces(np.random.default_rng(1), 30, 9)
    q = substring._from_rows(substring._single(p, np.zeros(len(p), np.int64)))
    known = p.known
    assert p.text == q.text and all((getattr(p, c) == getattr(q, c)).all() for c in ("key", "known", "th", "first", "loops")) and (p.id[known] == q.id[known]).all()


def test_maximal_repeats(spark):
    a, b = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(25))
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "s"} for i, t in enumerate([f"x {a} y", f"z {a} w {b}", f"u {b} v", "nothing else"])]
    got = substring.maximal_repeats(frame(spark, rows), 20).collect()
    assert got and all(r["n_texts"] == 2 and r["n_words"] == len(r["passage"].split()) >= 20 and (r["passage"] in a or r["passage"] in b) for r in got)
    assert substring.maximal_repeats(frame(spark, [])).count() == 0


def test_any_column_names(spark):
    df = frame(spark, docs()).withColumnsRenamed({"key": "__id", "spans": "__th", "pii": "__spans", "size": "row", "id": "__i"})
    out = substring.dedup_passages(df)
    assert out.columns == df.columns and rows_of(out, "doc_id", "__id", "row") == rows_of(df, "doc_id", "__id", "row")
