"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(found):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    assert rows(df.select(*cols).collect()) == rows(duck.sql(registry.ORACLE_SQL[name]).select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["stall_name", "product_name", "spec", "size_text", "quantity", "remark"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
