from duck import against_duckdb

from weir.llm import chat
from weir.llm.queries import ORACLE_SQL

SCHEMA = "conv_id long, turn long, role string, text string, n int, h string, i string"


def turns(*conversations):
    return [(c, t, r, x, 1, "h", "i") for c, rows in conversations for t, (r, x) in enumerate(rows)]


def brute(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t, r, x))
    key = lambda row: tuple((v is not None, v) for v in row)
    seqs = {c: tuple((r, x) for _, r, x in sorted(v, key=key)) for c, v in by.items()}
    kept = {}
    for c, s in seqs.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            kept.setdefault(s, []).append(c)
    return sorted((min(cs, key=lambda c: (c is None, c)), len(s), len(cs)) for s, cs in kept.items())


def test_equals_brute_force(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "so?")
    rows = turns((1, [a]), (2, [a, b]), (3, [a, b, c]), (4, [a, b, c]), (5, [b]), (6, [("user", None)]), (7, [("user", "")]), (8, [(None, "x")]), (9, [a, c]), (10, [b, a]))
    rows += [(11, 5, "user", "tie", 1, "", ""), (11, 5, "user", "tie", 1, "", ""), (11, None, None, None, 1, "", ""), (12, 0, "user", "L" * 100_000, 1, "", "")]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["conv_id"], r["n_turns"], r["n_copies"]) for r in out.collect()) == brute(rows)
    text = {r["conv_id"]: r["rendered"] for r in out.collect()}
    assert text[3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nso?<|im_end|>"
    assert text[6] == text[7]


def test_null_conversation_and_empty_table(spark):
    one = spark.createDataFrame([(None, 0, "user", "a", 1, "", ""), (None, 1, "user", "b", 1, "", "")], SCHEMA)
    assert [(r["conv_id"], r["n_turns"]) for r in chat.format_chats(one).collect()] == [(None, 2)]
    assert chat.format_chats(one.limit(0)).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame(turns((1, [("user", "a")])), SCHEMA)
    plan = chat.prefix_hashes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_oracle(spark, sf):
    against_duckdb(chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet")), ORACLE_SQL["op9_chat_format"], sf)
