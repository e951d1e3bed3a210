from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from weir.streaming import keyed

DAY = datetime(2024, 1, 1)


class Orders:
    """A stream that is run batch by batch over changes given as short tuples."""

    def __init__(self, spark, root):
        self.spark, self.root, self.position = spark, str(root), 0
        self.spark.createDataFrame([], keyed.CHANGES).write.parquet(f"{self.root}/in")

    def run(self, *changes, days=0):
        rows = []
        for order, entity, n, *values in changes:
            self.position += 1
            deleted = values == ["d"]
            channel, status, date, amount = (None, None, None, None) if deleted else values if entity == "order_info" else (None, None, None, *(values or (None,)))
            rows.append((order, entity, f"{order}-{n}", 128, self.position, 0, DAY + timedelta(days=days, seconds=self.position), deleted, channel, status, date, None if amount is None else Decimal(amount)))
        return self.deliver(rows)

    def deliver(self, rows):
        self.spark.createDataFrame(rows, T.StructType.fromDDL(keyed.CHANGES)).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        keyed.start(keyed.read_changes(self.spark, f"{self.root}/in"), f"{self.root}/out", f"{self.root}/check", 30, availableNow=True).awaitTermination()
        return rows

    def daily(self):
        out = keyed.metrics(self.spark.read.schema(keyed.SIGNED).parquet(f"{self.root}/out"), "order_date", "channel")
        return {(r["order_date"], r["channel"]): (r["total_orders"], r["paid_orders"], r["refunded_orders"], int(r["order_amount"]), int(r["paid_amount"]), int(r["refund_amount"])) for r in out.collect()}


@pytest.fixture
def orders(spark, tmp_path):
    return Orders(spark, tmp_path)


def header(order, status="PAID", amount=10, channel="web"):
    return (order, "order_info", 0, channel, status, "2024-01-01", amount)


def test_retractions_and_forgetting(orders):
    first = orders.run(header("a"), ("a", "order_detail", 1), ("a", "order_detail", 2), ("a", "payment_info", 1, 10), header("b", "CREATED", 5), ("b", "order_detail", 1), header("c", "CREATED", 7))
    both = {("2024-01-01", "web"): (2, 1, 0, 15, 10, 0)}
    assert orders.daily() == both  # c has no line
    orders.run(("c", "order_detail", 1), header("b", "CREATED", 5, "app"), ("a", "order_detail", 1, "d"))
    assert orders.daily() == {("2024-01-01", "web"): (2, 1, 0, 17, 10, 0), ("2024-01-01", "app"): (1, 0, 0, 5, 0, 0)}
    orders.run(("b", "order_info", 0, "d"), ("a", "refund_info", 1, 4), header("a", "REFUNDED"))
    now = {("2024-01-01", "web"): (2, 1, 1, 17, 10, 4)}
    assert orders.daily() == now
    # What is older than the state knows, or repeated, changes nothing.
    orders.deliver(first)
    assert orders.daily() == now
    # Another order moves the time on; the others are forgotten, and nothing is taken back.
    orders.run(header("x", "CREATED", 1), days=100)
    orders.run(("x", "order_detail", 1), days=101)
    now["2024-01-01", "web"] = (3, 1, 1, 18, 10, 4)
    assert orders.daily() == now
    # Old changes again: late. The deleted order stays deleted.
    orders.deliver(first)
    assert orders.daily() == now
    # A late payment, then the header without lines: not enough to tell, so the row stays as given out.
    orders.run(("c", "payment_info", 1, 7), days=102)
    orders.run(header("a", "PAID", 11), days=102)
    assert orders.daily() == now
    # Header and a line are known again; the forgotten payment and refund keep their amounts.
    orders.run(("a", "order_detail", 9), days=103)
    now["2024-01-01", "web"] = (3, 1, 0, 19, 10, 4)
    assert orders.daily() == now


def test_changes_from_a_log(spark):
    value = "struct<order_id:string,payment_amount:decimal(12,2),update_time:timestamp>"
    rows = [("P1", "c", 128, 0, 5, ("O1", Decimal("3.50"), DAY)), ("P1", "d", 128, 0, 6, None)]
    log = spark.createDataFrame(rows, f"payment_id string, op string, epoch int, partition int, offset long, value {value}")
    assert [r["id"] for r in keyed.of_log("payment_info", log).collect()] == ["P1"]
    from pyspark.sql import functions as F

    out = keyed.of_log("payment_info", log, F.lit("O1"), F.lit(DAY)).orderBy("position").collect()
    assert [(r["order_id"], r["deleted"], r["amount"]) for r in out] == [("O1", False, Decimal("3.50")), ("O1", True, None)]


def test_state_is_one_value_that_reads_back():
    known = {("order_info", "a"): keyed.Known(128, 5, 0, False, "web", "PAID", "2024-01-01", Decimal("10.50")), ("order_detail", "a-1"): keyed.Known(128, 6, 0, True, None, None, None, None)}
    assert keyed._read_known(keyed._write_known(known)) == known
    assert keyed._read_given(None) is None


def test_batches_have_the_files_of_their_tasks(spark, tmp_path):
    from weir.plans import queries

    seen = []

    class Ended:
        def awaitTermination(self):
            pass

    def start(log):
        seen.append((spark.read.parquet(log).count(), len(spark.read.parquet(log).inputFiles())))
        return Ended()

    queries._deliver([spark.range(0, 40, 1, 4), spark.range(40, 60, 1, 2)], str(tmp_path / "log"), start)
    assert seen == [(40, 4), (60, 6)]


class Grouped(Orders):
    """The same with all orders in one group of a state of two partitions."""

    def deliver(self, rows):
        self.spark.createDataFrame(rows, T.StructType.fromDDL(keyed.CHANGES)).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        keyed.start(keyed.read_changes(self.spark, f"{self.root}/in"), f"{self.root}/out", f"{self.root}/check", 30, groups=1, partitions=2, availableNow=True).awaitTermination()
        return rows


def test_orders_of_a_group_age_one_by_one(spark, tmp_path):
    orders = Grouped(spark, tmp_path)
    first = orders.run(header("a"), ("a", "order_detail", 1), ("a", "payment_info", 1, 10), header("tab\tand\nline", "CREATED", 5), ("tab\tand\nline", "order_detail", 1))
    orders.run(header("b", "CREATED", 3), ("b", "order_detail", 1), header("tab\tand\nline", "CREATED", 6), days=20)
    # a is forgotten, the others aren't: a header alone changes b and not a.
    orders.run(header("x", "CREATED", 1), days=45)
    orders.deliver(first)
    orders.run(header("a", "PAID", 11), header("b", "PAID", 4), days=46)
    assert orders.daily() == {("2024-01-01", "web"): (3, 2, 0, 20, 10, 0)}
    # Nothing is known of any of them but what was given out.
    orders.run(header("x", "CREATED", 1), days=90)
    orders.run(header("a", "PAID", 12), header("b", "PAID", 5), header("tab\tand\nline", "CREATED", 7), ("b", "order_detail", 1), days=91)
    assert orders.daily() == {("2024-01-01", "web"): (3, 2, 0, 21, 10, 0)}
    assert len(list((tmp_path / "check/state/0").glob("[0-9]*"))) == 2
