import random
import zlib
from collections import Counter, defaultdict

import tokenizers
from helpers import SF, edge_docs, frame, real_docs, words
from pyspark.sql import functions as F
from test_langid import brute_bits
from test_linededup import brute as brute_lines
from test_mixing import brute_targets
from test_simhash import brute as brute_fingerprint
from test_simhash import closure

import corpus_pipeline
from weir.llm import common, packing

STAGE = dict(corpus_pipeline.STAGES)


def corpus():
    """Two languages, noise, repeated lines, copies and near copies, a source of a third of the rows, long and short texts."""
    r = random.Random(11)
    vocabulary = {"aa": "ba na ta ra la mana rana bata lata nara".split(), "oo": "gos dof hos fog god sod hog dos fos gof".split()}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text(lang, r.randint(4, 40)), lang if i % 5 else None, r.choice("abc")) for i, lang in enumerate(["aa", "oo"] * 20)]
    rows += [(100 + i, f"ba na shared line\n{text('aa', 12)}\n", "aa", "a") for i in range(11)]
    long = text("oo", 3000).split()
    for i in range(4):  # near copies
        rows.append((200 + i, " ".join([*long[:-1], "gos dof hos fog".split()[i]]), "oo", "b"))
    rows += [(300 + i, rows[3][1], "oo", "c") for i in range(3)]
    rows += [(400, "".join(chr(0x3400 + r.randrange(5000)) for _ in range(60)), None, "a"), (401, "123 456", "aa", "a"), (402, "", "aa", "b"), (403, None, "oo", "b"), (404, text("aa", 5), "aa", None)]
    return [dict(zip(("doc_id", "text", "lang", "source"), x)) for x in rows]


def test_every_stage_equals_brute_force(spark):
    rows = corpus()
    df = frame(spark, rows)
    known = lambda d: sorted((r["doc_id"], r["text"]) for r in d.collect())

    samples = defaultdict(list)
    for r in rows:
        if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            samples[r["lang"]].append(r["text"].encode())
    stays = [r for r in rows if any(c.isalpha() for c in r["text"] or "") and min(brute_bits(samples, r["text"].encode())) / len(r["text"].encode()) < 7.5]
    one = STAGE["language_id"](spark, df, SF)
    assert known(one) == sorted((r["doc_id"], r["text"]) for r in stays) and 400 not in {r["doc_id"] for r in stays} and len(stays) == len(rows) - 4

    two = STAGE["line_dedup"](spark, one, SF)
    rows = [{**r, "text": t} for r, (_, _, t) in zip(stays, brute_lines(stays, 10))]
    assert known(two) == sorted((r["doc_id"], r["text"]) for r in rows) and not any("shared line" in r["text"] for r in rows)

    three = STAGE["near_duplicates"](spark, two, SF)
    group = closure([brute_fingerprint(r["text"]) for r in rows], 4)
    first = {}
    for r, g in zip(rows, group):
        first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    rows = [r for r, g in zip(rows, group) if first[g] == r["doc_id"]]
    assert known(three) == sorted((r["doc_id"], r["text"]) for r in rows)
    kept = {r["doc_id"] for r in rows}
    assert 3 in kept and not kept & {300, 301, 302} and len(kept & {200, 201, 202, 203}) == 1

    four = STAGE["mix_sources"](spark, three, SF).cache()
    ids = spark.createDataFrame([(i,) for i in kept], "doc_id long")
    key = {r[0]: r[1] for r in ids.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(0), "doc_id"), 1)).collect()}
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r["doc_id"])
    target = brute_targets({s: sum(size[i] for i in own) for s, own in sources.items()})
    want = Counter()
    for s, own in sources.items():
        total, budget = sum(size[i] for i in own), int(target[s] + 0.5)
        rest = budget - budget // total * total
        for i in sorted(own, key=lambda i: key[i]):
            want[i] += budget // total + (rest > 0 and 2 * min(rest, size[i]) >= size[i])
            rest -= min(rest, size[i])
    assert Counter(r["doc_id"] for r in four.collect()) == +want

    packed = STAGE["pack"](spark, four, SF).collect()
    tokens = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in rows}
    pieces = Counter()
    for i, n in (+want).items():
        ids = tokens.encode(text[i] or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            pieces[i, p, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    # No packing needs fewer than the volume; this one stays near it.
    assert len(places) <= -(-sum(r["length"] for r in packed) // 2048) + 2


def test_stages_keep_columns_of_awkward_rows(spark):
    docs = frame(spark, real_docs() + edge_docs())
    now = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, SF).cache()
        assert now.columns == docs.columns, name
    assert 0 < now.count()
    assert STAGE["pack"](spark, now, SF).where("piece = 0").count() == now.count()


def test_empty_tables(spark):
    docs = frame(spark, [])
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert STAGE["pack"](spark, docs, SF).count() == 0


def test_without_labels_texts_with_letters_stay(spark):
    rows = [{**r, "lang": None} for r in edge_docs()]
    got = sorted(str(r["text"]) for r in STAGE["language_id"](spark, frame(spark, rows), SF).collect())
    assert got == sorted(r["text"] for r in rows if any(c.isalpha() for c in r["text"] or ""))


def test_run_leaves_only_what_its_result_reads(spark):
    before = common.staged()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "pack"]
    left = {p.rsplit("/stage-", 1)[1].rsplit("-", 1)[0] for p in common.staged() - before}
    assert left <= {"mix_sources", "pack-ranked", "pack-large"}
