import zlib

import numpy as np
from helpers import edge_docs, frame, real_docs, rows_of

from weir.llm import langid


def brute_bits(samples, text):
    """Code length of ``text`` by the definition: walk from the longest context, exclude what was seen."""
    seen = sorted(set(b"".join(b for t in samples.values() for b in t)))
    trees, total3 = {}, {}
    for lang, docs in samples.items():
        tree = trees.setdefault(lang, {})
        for d in docs:
            for i, c in enumerate(d):
                for k in range(4):
                    if i - k < 0 and k:
                        ctx = (None,) * (k - i) + tuple(d[:i])
                    else:
                        ctx = tuple(d[i - k : i])
                    tree.setdefault(ctx, {}).setdefault(c, 0)
                    tree[ctx][c] += 1
                    if k == 3:
                        total3[ctx] = total3.get(ctx, 0) + 1

    known = {}

    def p(tree, ctx, c):
        if (id(tree), ctx, c) not in known:
            known[id(tree), ctx, c] = share(tree, ctx, c)
        return known[id(tree), ctx, c]

    def share(tree, ctx, c):
        lower = (lambda x: p(tree, ctx[1:], x)) if ctx else (lambda x: 1 / 256)
        if len(ctx) == 3 and total3.get(ctx, 0) < 2:
            return lower(c)
        counts = tree.get(ctx)
        if not counts:
            return lower(c)
        n, d = sum(counts.values()), len(counts)
        left = 1 - sum(lower(x) for x in counts)
        if c in counts:
            return counts[c] / (n + d)
        return d / (n + d) * lower(c) / left

    out = []
    for lang in sorted(samples):
        bits = 0.0
        for i, c in enumerate(text):
            ctx = (None,) * max(0, 3 - i) + tuple(text[max(0, i - 3) : i])
            bits -= np.log2(p(trees[lang], ctx, c))
        out.append(bits)
    assert seen
    return out


def test_code_lengths_equal_the_definition():
    samples = {"x": [b"abab abba", b"ab"], "y": [b"cdc cd ddc a"]}
    model = langid.fit(samples)
    texts = [b"abba cd", b"", b"zq\xff", b"a", b"dcd abab"]
    off = np.cumsum([0, *map(len, texts)])
    got = langid.code_lengths(model, off, np.frombuffer(b"".join(texts), np.uint8))
    for g, t in zip(got, texts):
        assert np.allclose(g, brute_bits(samples, t), rtol=1e-4)


def test_tables_apart_give_the_same_code_lengths():
    samples = {"x": [b"abab abba", b"ab", b"xyz xyz"], "y": [b"cdc cd ddc a"], "z": ["да нет да".encode() * 3], "w": [b"abc cba"], "none": [b""]}
    texts = ["abba cd да нет", "", "zq\u00ff", "a", "dcd abab xyz", "ж"]
    raws = [t.encode() for t in texts]
    off, raw = np.cumsum([0, *map(len, raws)]), np.frombuffer(b"".join(raws), np.uint8)
    whole, apart = langid.fit(samples, block_bytes=1 << 30), langid.fit(samples, block_bytes=0)
    assert len(whole.blocks) == 1 and len(apart.blocks) == 5
    assert np.allclose(langid.code_lengths(whole, off, raw), langid.code_lengths(apart, off, raw), rtol=1e-5)


def test_tables_are_bounded_and_grow_as_a_sum():
    rng = np.random.default_rng(0)
    text = lambda i: "".join(chr(x) for x in 0x4E00 + 60 * i + rng.integers(0, 40, 3000)).encode()
    fit = lambda n: langid.fit({f"l{i:02d}": [text(i)] for i in range(n)}, block_bytes=1 << 20).blocks
    size = lambda blocks: sum(b.cost.nbytes + b.context.nbytes for b in blocks)
    small, large = fit(16), fit(64)
    assert all(b.cost.nbytes <= 1.2 * (1 << 20) or len(b.langs) == 1 for b in large)
    assert sorted(i for b in large for i in b.langs) == list(range(64))
    assert size(large) < 5 * size(small)


def test_probabilities_sum_to_one():
    model = langid.fit({"x": [b"hello there", b"hello world"], "y": [b"guten tag"]})
    (block,) = model.blocks
    a = round(len(block.context) ** (1 / 3))
    p = np.exp2(-block.cost.reshape(-1, a, 2).astype(float))
    unseen = 256 - (a - 2)
    p[:, langid.OTHER] *= unseen
    assert np.allclose(p[:, 1:].sum(1), 1, atol=1e-4)


def test_predictions_equal_the_definition(spark):
    """Label and score from code lengths by the definition, on the sample that the operator takes."""
    rows = [{"doc_id": i, "text": t, "lang": la, "source": "s"} for i, (t, la) in enumerate([("abab abba", "x"), ("cdc cd ddc", "y"), ("ab abba ba", "x"), ("dcd cdd", "y"), ("aacc", None), ("bab", None), ("12", "x")] * 6)]
    df = frame(spark, rows)
    samples = langid.sample(df)
    assert sum(map(len, samples.values())) <= len(rows) and set(samples) == {"x", "y"}
    for r in langid.predict(df).collect():
        text = rows[r["doc_id"]]["text"]
        if text == "12":
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x, y = brute_bits(samples, text.encode())
        assert r["lang_pred"] == ("x" if x <= y else "y") and np.isclose(r["score"], 1 / (1 + 2.0 ** -abs(x - y)), rtol=1e-3)


def test_held_out_accuracy_and_fold(spark):
    rows = real_docs()
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edges(spark):
    df = frame(spark, edge_docs() + real_docs())
    out = langid.predict(df)
    assert out.count() == df.count()
    und = {r["doc_id"] for r in out.where("lang_pred = 'und'").collect()}
    assert und >= {10_001, 10_002, 10_003, 10_010} and 10_007 not in und
    assert langid.predict(df.limit(0)).count() == 0
    unlabelled = langid.predict(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.where("doc_id = 10010 or text is null or text = ''").count() == 0
    assert len(rows_of(kept.where("n_chars > 200"), "doc_id")) >= 0.97 * df.where("n_chars > 200").count()


def test_every_label_is_learned(spark):
    names = [f"l{i:03d}" for i in range(70)]
    word = lambda i: "".join(chr(0x4E00 + 40 * i + j) for j in range(6)) + " "
    rows = [(100 * i + j, word(i) * 3, lang) for i, lang in enumerate(names) for j in range(3 if i == 7 else 8)]
    rows += [(20_000 + j, word(99) * 5000, "long") for j in range(8)]
    rows += [(None, word(98) + str(j), "no ids") for j in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.sample(df)) == {*names, "long", "no ids"}
    assert all(len(t.decode()) <= langid.SAMPLE_CHARS for t in langid.sample(df)["long"])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(df).collect()}
    assert got == {(i, lang) for i, _, lang in rows}


def test_long_texts_are_scored_in_parts(monkeypatch):
    model = langid.fit({"a": [b"the cat sat on the mat", b"a hat"], "b": "größer als über ärger".encode().split(b" ")})
    raw = np.frombuffer(b"the cat \xc3\xbc on a mat, " * 40 + b"xyz", np.uint8)
    off = np.array([0, 5, 5, 300, len(raw)])
    whole = langid.code_lengths(model, off, raw)
    for part in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "PART", part)
        assert np.allclose(langid.code_lengths(model, off, raw), whole, rtol=1e-9)


def test_a_text_of_64_mb_takes_little_memory():
    import tracemalloc

    model = langid.fit({"a": [b"the cat sat on the mat"], "b": [b"der hund lief weg"]})
    raw = np.frombuffer(b"the cat lief on the mat " * (1 << 21) + b"x" * (16 << 20), np.uint8)
    tracemalloc.start()
    try:
        langid.code_lengths(model, np.array([0, len(raw)]), raw)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TEXT", 4000)
    rows = [(i, "abcdefgh" * 100, f"l{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.sample(docs)
    assert len(found) == 5 and sum(len(t) for own in found.values() for t in own) <= 4000
