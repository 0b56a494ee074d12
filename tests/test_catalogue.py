"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from leafmill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    relation = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in relation.description]
    theirs = relation.fetchall()
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    ours = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(tuple(map(shown, r)) for r in ours) == sorted(tuple(map(shown, r)) for r in theirs)


def test_entry_needs_no_optional_part(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
