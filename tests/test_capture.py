import sqlite3
from contextlib import closing
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weir.operators import changelog
from weir.sources import capture
from weir.sources.contracts import CONTRACTS

CONTRACT = CONTRACTS["order_info"]
NAMES = CONTRACT.schema.names


class Database:
    """Orders with their table of changes, filled by triggers."""

    def __init__(self, path):
        self.path = str(path)
        names, new, old = ", ".join(NAMES), ", ".join(f"NEW.{n}" for n in NAMES), ", ".join(f"OLD.{n}" for n in NAMES)
        entry = f"INSERT INTO order_info_changes(op, {names}) VALUES"
        self.run(
            f"CREATE TABLE order_info ({names}, PRIMARY KEY (order_id))", f"CREATE TABLE order_info_changes (position INTEGER PRIMARY KEY AUTOINCREMENT, op, {names})",
            f"CREATE TRIGGER c AFTER INSERT ON order_info BEGIN {entry} ('c', {new}); END", f"CREATE TRIGGER u AFTER UPDATE ON order_info BEGIN {entry} ('u', {new}); END",
            f"CREATE TRIGGER d AFTER DELETE ON order_info BEGIN {entry} ('d', {old}); END",
        )

    def run(self, *statements):
        with closing(sqlite3.connect(self.path)) as db:
            for s in statements:
                db.execute(s) if isinstance(s, str) else db.execute(*s)
            db.commit()

    def insert(self, *ids, amount="9.90"):
        self.run(*[(f"INSERT INTO order_info VALUES ({', '.join('?' * len(NAMES))})", (i, 1, 2, "CREATED", "app", amount, None, "2024-01-01 10:00:00", "2024-01-01 10:00:00", 1)) for i in ids])

    def rows(self):
        with closing(sqlite3.connect(self.path)) as db:
            return {r[0]: (r[1], Decimal(r[2])) for r in db.execute("SELECT order_id, order_status, order_amount FROM order_info")}


@pytest.fixture
def db(tmp_path):
    return Database(tmp_path / "db")


def run(spark, db, root, **options):
    spark.dataSource.register(capture.CaptureSource)
    stream = spark.readStream.format("weir_capture").options(**capture.capture_options("sqlite3", {"database": db.path}, CONTRACT, slices=3, **options)).load()
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def state(log):
    return {r["order_id"]: (r["order_status"], r["order_amount"]) for r in changelog.fold(log, ["order_id"]).collect()}


def test_a_changing_table_over_restarts(spark, db, tmp_path):
    db.insert(*[f"O{i:03d}" for i in range(40)])
    log = run(spark, db, tmp_path)
    assert log.where("op <> 'r'").count() == 0 and log.count() == 40 and state(log) == db.rows()
    first = log.first()
    assert isinstance(first["value"]["create_time"], datetime) and first["value"]["order_amount"] == Decimal("9.90")
    db.insert("O900", "O901")
    db.run("UPDATE order_info SET order_status = 'PAID', order_amount = '10.00' WHERE order_id < 'O010'", "DELETE FROM order_info WHERE order_id = 'O005'", "UPDATE order_info SET order_status = 'REFUNDED' WHERE order_id = 'O006'")
    log = run(spark, db, tmp_path)
    changes = log.where("op <> 'r'").select("op", "offset").collect()
    assert sorted(r["offset"] for r in changes) == list(range(41, 55)) and [r["op"] for r in changes].count("d") == 1
    assert state(log) == db.rows()
    # Nothing new: nothing is read again. Then a row that was deleted comes back.
    assert run(spark, db, tmp_path).count() == log.count()
    db.insert("O005", amount="1")
    assert state(run(spark, db, tmp_path)) == db.rows()


def test_a_batch_that_is_run_again_leaves_no_row_twice(spark, db, tmp_path):
    db.insert("a", "b", "c")
    run(spark, db, tmp_path)
    db.run("UPDATE order_info SET order_status = 'PAID'")
    log = run(spark, db, tmp_path)
    newest = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    db.insert("d")
    run(spark, db, tmp_path)  # the batch whose commit is lost
    again = run(spark, db, tmp_path)
    assert sorted(map(tuple, again.select("order_id", "op", "offset").collect())) == sorted([*map(tuple, log.select("order_id", "op", "offset").collect()), ("d", "c", 7)])
    assert state(again) == db.rows()


def test_changes_while_the_snapshot_is_read(spark, db, tmp_path):
    """The snapshot may show later states than its position; the fold is right all the same."""
    db.insert(*[f"O{i}" for i in range(9)])
    reader = capture.CaptureSource(capture.capture_options("sqlite3", {"database": db.path}, CONTRACT, slices=3, before=True)).streamReader(None)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    rows = list(reader.read(parts[0]))
    db.run("DELETE FROM order_info WHERE order_id IN ('O1', 'O7')", "UPDATE order_info SET order_status = 'PAID' WHERE order_id = 'O8'")
    for p in parts[1:]:
        rows += reader.read(p)
    later = reader.latestOffset()
    for p in reader.partitions(end, later):
        rows += reader.read(p)
    assert len(parts) == 3 and reader.partitions(later, later) == []
    assert {r[0]: r[6][0] for r in rows if r[1] == "d"} == {"O1": "O1", "O7": "O7"}
    log = spark.createDataFrame(rows, capture.CaptureSource(capture.capture_options("sqlite3", {}, CONTRACT, before=True)).schema())
    assert state(log.drop("before")) == db.rows()
    assert log.where(F.col("before").isNotNull()).count() == 2


def test_empty_table(spark, db, tmp_path):
    assert run(spark, db, tmp_path).count() == 0
    db.insert("a")
    assert state(run(spark, db, tmp_path)) == db.rows()
