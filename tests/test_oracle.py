"""Every named query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from chatlens.sources.tables import TABLES
from tools.oracle_check import digest

from conftest import SF0001

# Spark type -> DuckDB type of the same column.
SAME_TYPE = {'bigint': 'BIGINT', 'boolean': 'BOOLEAN', 'int': 'INTEGER', 'double': 'DOUBLE', 'string': 'VARCHAR',
             'timestamp_ntz': 'TIMESTAMP', 'date': 'DATE', 'array<string>': 'VARCHAR[]'}


@pytest.fixture(scope='module')
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize('name', sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    d_types = {d[0]: str(d[1]) for d in res.description}
    for f in df.schema.fields:
        assert SAME_TYPE.get(f.dataType.simpleString()) == d_types[f.name], (f.name, f.dataType, d_types[f.name])
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]
