"""Documents with every awkward case, and brute-force helpers."""

from __future__ import annotations

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id int, key string, fingerprint string, spans string, pii string"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in WS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def real_docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def edge_docs():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows."""
    long_text = " ".join(f"w{i % 977}{'X' * (i % 3)}" for i in range(40_000))
    rows = [
        (None, "one two three four five six", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", "a"), (4, long_text, "en", "b"), (5, long_text, "en", "b"),
        (6, "same text here\nÉcole ÄÖ", "fr", None), (6, "same text here\nÉcole ÄÖ", "fr", None), (6, "same id, other text", "fr", "c"), (7, "tail", None, "c"),
        (8, "a\n\nb\n", "en", ""), (None, None, None, None), (9, "na " * 60, "en", "c"), (10, "12345 !!! ...", "en", "c"), (11, "日本語 テキスト 😀", "ja", "a"),
    ]
    ids = lambda i: None if i is None else 10_000 + i
    return [dict(zip(("doc_id", "text", "lang", "source"), (ids(r[0]), *r[1:]))) for r in rows]


def frame(spark, rows):
    """A documents table with extra columns whose names operators might use."""
    data = [(r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"] or ""), "s", 1, "k", "f", "x", "p") for r in rows]
    return spark.createDataFrame(data, DOC_SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
