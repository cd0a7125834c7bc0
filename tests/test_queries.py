"""Every registered query of the table engine against its SQL."""

import duckdb
import pytest

from tidemark import queries

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert mine == sorted((tuple(r) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()), key=str)
