"""The text queries against their SQL in DuckDB, and the others' row counts, on the smallest tables."""

import duckdb
import pytest

from tallyloom.llm.oracles import ORACLE_SQL
from tallyloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((list(r) for r in df.select(*cols).collect()), key=repr)
    with duckdb.connect() as c:
        for t in ("documents", "pages", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        if name in ORACLE_SQL:
            assert got == sorted((list(r) for r in c.sql(ORACLE_SQL[name]).select(*[f'"{x}"' for x in cols]).fetchall()), key=repr)
        else:
            assert len(got) == c.sql("SELECT count(*) FROM documents").fetchall()[0][0]
