import io
import random
import re
from contextlib import redirect_stdout

import pytest

from weir.sources.contracts import schema
from weir.streaming.serving_table import ServingTable, start_upserts

ROWS = schema("k string, part int, v int, ingest_version bigint, is_deleted tinyint")


def table(spark, path, name, **options):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return ServingTable(spark, name, str(path), ROWS, ("k", "part"), **{"buckets": 2, "fan": 3, **options})


def plan(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def state(t):
    return {(r["k"], r["part"]): r["v"] for r in t.read().collect()}


def test_files_stay_bounded_and_reads_need_no_exchange(spark, tmp_path):
    t, r, want = table(spark, tmp_path, "served"), random.Random(1), {}
    for batch in range(20):
        rows = {(f"k{r.randint(0, 30)}", r.randint(0, 1)): (batch, int(r.random() < 0.2)) for _ in range(12)}
        want |= {k: None if gone else v for k, (v, gone) in rows.items()}
        t.upsert(spark.createDataFrame([(*k, v, batch, gone) for k, (v, gone) in rows.items()], ROWS), batch)
        runs = t.runs()
        assert len(runs) <= 2 * 3 and [x[1] for x in runs][0] == 0 and all(a[2] + 1 == b[1] for a, b in zip(runs, runs[1:]))
    assert state(t) == {k: v for k, v in want.items() if v is not None}
    assert len(list(tmp_path.glob("level=*/first=*/last=*/*.parquet"))) <= 2 * len(t.runs())
    assert "Exchange" not in plan(t.read()) and "Bucketed: true" in plan(t.read())
    # Another session's table over the same files, and a batch that is run again, merged or not.
    again = table(spark, tmp_path, "served_again")
    before = state(again)
    for batch in (3, 19):
        again.upsert(spark.createDataFrame([("new", 0, 1, 10**6, 0)], ROWS), batch)
        assert (("new", 0) in state(again)) == (batch == 19)
    assert before == state(t) or set(before) - set(state(t)) <= {k for k, v in want.items() if v == 19}


def test_a_stream_upserts(spark, tmp_path):
    t = table(spark, tmp_path / "rows", "streamed", fan=2)
    for i in range(3):
        spark.createDataFrame([("a", 0, i, i, 0), (f"k{i}", 0, i, i, 0)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_upserts(stream, t, str(tmp_path / "check"), availableNow=True).awaitTermination()
    assert state(t) == {("a", 0): 2, ("k0", 0): 0, ("k1", 0): 1, ("k2", 0): 2} and [r[:3] for r in t.runs()] == [(1, 0, 1), (0, 2, 2)]


def test_a_delete_hides_older_runs_until_it_meets_the_oldest(spark, tmp_path):
    t = table(spark, tmp_path, "deletes", fan=2)
    one = lambda v, gone: spark.createDataFrame([("a", 0, v, v, gone), ("b", 0, v, v, 0)], ROWS)
    for batch, gone in enumerate((0, 0, 1, 0, 1)):
        t.upsert(one(batch, gone), batch)
        assert state(t) == ({("b", 0): batch} if gone else {("a", 0): batch, ("b", 0): batch})
    t.upsert(one(5, 1), 5)
    t.upsert(one(6, 1), 6)
    t.upsert(one(7, 1), 7)
    assert spark.table("deletes").where("k = 'a'").count() == 0 and state(t) == {("b", 0): 7}


@pytest.mark.parametrize("crash", ["before", "after"])
def test_a_crash_in_a_merge_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, crash):
    t = table(spark, tmp_path, f"crash_{crash}", fan=2)
    t.upsert(spark.createDataFrame([("a", 0, 1, 1, 0), ("c", 0, 1, 1, 0)], ROWS), 0)
    write = ServingTable._write

    def broken(self, rows, level, first, last):
        if level and crash == "before":
            raise OSError("lost")
        write(self, rows, level, first, last)
        if level:
            raise OSError("lost")

    monkeypatch.setattr(ServingTable, "_write", broken)
    batch = spark.createDataFrame([("a", 0, 2, 2, 0), ("b", 0, 2, 2, 1)], ROWS)
    with pytest.raises(OSError, match="lost"):
        t.upsert(batch, 1)
    monkeypatch.setattr(ServingTable, "_write", write)
    assert state(t) == {("a", 0): 2, ("c", 0): 1}
    t.upsert(batch, 1)
    t.upsert(spark.createDataFrame([("c", 0, 3, 3, 0)], ROWS), 2)
    assert state(t) == {("a", 0): 2, ("c", 0): 3} and not re.search(r"Exchange", plan(t.read()))
