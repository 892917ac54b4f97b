"""The training-data queries against their DuckDB SQL, on the smallest tables."""

import duckdb
import pytest
from graphloom.llm import queries

TABLES = "documents benchmark pages conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    df = queries.QUERIES[name](spark, tiny)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    plain = lambda v: int(v) if isinstance(v, (int, float)) or hasattr(v, "quantize") else v
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
