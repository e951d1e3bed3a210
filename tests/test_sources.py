import http.server
import json
import threading
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weir.sources import readers
from weir.sources.contracts import schema

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def db(spark):
    """An in-memory database with orders and payments."""
    url = "jdbc:derby:memory:weir;create=true"
    rows = [(f"O{i:03d}", f"2024-01-{1 + i % 20:02d} 10:00:00", Decimal(i)) for i in range(60)]
    orders = spark.createDataFrame(rows, "order_id string, t string, order_amount decimal(12,2)").select("order_id", F.col("t").cast("timestamp").alias("create_time"), "order_amount")
    payments = orders.where("order_amount % 2 = 0").select(F.concat(F.lit("P"), "order_id").alias("payment_id"), "order_id", F.col("order_amount").alias("payment_amount"))
    for name, df in (("order_info", orders), ("payment_info", payments)):
        # Derby folds unquoted names, so tables and columns have upper-case names.
        df.select(*[F.col(c).alias(c.upper()) for c in df.columns]).write.jdbc(url, name.upper(), "overwrite", {"createTableColumnTypes": ", ".join(f"{c.upper()} VARCHAR(20)" for c in df.columns if c.endswith("_id"))})
    return url


def test_jdbc_range_is_read_in_slices(spark, db):
    span = date(2024, 1, 3), date(2024, 1, 11)
    orders = readers.read_jdbc_range(spark, db, "order_info", ["order_id", "order_amount"], *span, slices=4)
    assert orders.columns == ["order_id", "order_amount"] and orders.rdd.getNumPartitions() == 4
    want = {f"O{i:03d}" for i in range(60) if 3 <= 1 + i % 20 < 11}
    assert {r["order_id"] for r in orders.collect()} == want and orders.count() == len(want)
    payments = readers.read_jdbc_range(spark, db, "payment_info", ["payment_id", "payment_amount"], *span, slices=100)
    assert payments.rdd.getNumPartitions() == 8  # a day is the least slice
    assert {r["payment_id"] for r in payments.collect()} == {f"P{o}" for o in want if int(o[1:]) % 2 == 0}


def test_jdbc_lookup_is_read_again_when_old(spark, db):
    now = [0.0]
    lookup = readers.jdbc_lookup(spark, db, "order_info", ["order_id", "order_amount"], ttl_s=60, clock=lambda: now[0])
    n = lookup().count()
    add = spark.createDataFrame([("NEW", Decimal(1))], "ORDER_ID string, ORDER_AMOUNT decimal(12,2)").withColumn("CREATE_TIME", F.lit("2025-01-01").cast("timestamp"))
    add.write.jdbc(db, "ORDER_INFO", "append")
    now[0] = 59
    assert lookup().count() == n == 60 and lookup().columns == ["order_id", "order_amount"]
    now[0] = 60
    assert lookup().count() == n + 1


def test_kafka_reads_all_topics_at_once(spark):
    """Without the connector: the options that it would get, and the columns of what it gives."""
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def options(self, **options):
            seen.update(options)
            return self

        def load(self):
            return spark.createDataFrame([(b"k", b"v", "t", 1, 2, 0)], "key binary, value binary, topic string, partition int, offset long, timestampType int")

    class Session:
        readStream = Reader()

    got = readers.stream_kafka(Session(), "host:9092", ["a", "b"], "latest")
    assert got.columns == ["key", "value", "topic", "partition", "offset"] and tuple(got.first()) == ("k", "v", "t", 1, 2)
    assert (seen["format"], seen["subscribe"], seen["startingOffsets"], seen["failOnDataLoss"]) == ("kafka", "a,b", "latest", "true")


def test_http_rows(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            day = self.path.strip("/")
            self.send_response(200 if day != "none" else 404)
            self.end_headers()
            lines = [json.dumps({"order_date": day, "total_orders": str(i) if i % 2 else i}) for i in range(3)] + ["", "{oops"]
            self.wfile.write("\n".join(lines).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    columns = schema("order_date date, total_orders bigint")
    got = readers.read_http_rows(spark, [f"{at}/2024-01-01", f"{at}/2024-01-02"], columns)
    assert got.schema.names == columns.names and sorted((str(r[0]), r[1]) for r in got.collect()) == [(f"2024-01-0{d}", i) for d in (1, 2) for i in range(3)]
    assert readers.read_http_rows(spark, [], columns).count() == 0
    with pytest.raises(Exception, match="404"):
        readers.read_http_rows(spark, [f"{at}/none"], columns).count()
    server.shutdown()
