import pytest
from duck import against_duckdb

from weir.plans.oracle import ORACLE_SQL
from weir.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, sf, name):
    against_duckdb(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_envelopes_hide_payloads(spark, sf):
    out = QUERIES["dlq_envelopes"](spark, sf)
    assert not [c for c in out.columns if "base64" in c]
    assert out.where("length(message_id) <> 64 or status <> 'pending'").count() == 0
    assert out.select("message_id").distinct().count() == out.count()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_lines_are_shuffled_without_what_is_not_shown(spark, sf):
    text = plan(QUERIES["dwd_order_detail"](spark, sf))
    assert "l_extendedprice" in text and "l_shipdate" not in text and "l_discount" not in text


def test_logs_are_dealt_before_they_are_grouped(spark, sf):
    lines = plan(QUERIES["order_info_current"](spark, sf)).splitlines()
    grouped = [i for i, x in enumerate(lines) if "SortAggregate" in x]
    assert grouped and max(grouped) < next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)


def test_order_lines_are_counted_in_one_pass(spark, sf):
    scans = [x for x in plan(QUERIES["table_counts"](spark, sf)).splitlines() if "FileScan" in x and "lineitem" in x]
    assert len([x for x in scans if "l_linenumber" in x]) == 1 and not [x for x in scans if "l_extendedprice" in x]
