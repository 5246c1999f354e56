"""The operators' results against what SQL says of them."""

import duckdb
import pytest

from sheafwork.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    done = connection.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert ours == sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in done.fetchall()) and ours
