"""Comparison with DuckDB."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(value):
    """Values of both engines in one form."""
    import datetime
    import decimal
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def against_duckdb(df, sql: str, sf_dir: str):
    """Asserts that a DataFrame and DuckDB SQL over the same tables have the same rows."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((repr(tuple(comparable(r[names.index(c)]) for c in sorted(names))) for r in out.fetchall()))
    got = sorted(repr(tuple(comparable(r[c]) for c in sorted(names))) for r in df.collect())
    assert got == expected
