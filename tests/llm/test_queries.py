"""Registered queries of the subpackage against their SQL."""

from pathlib import Path

import duckdb
import pytest

from lodegraph.llm import queries as llm

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = llm.QUERIES[name](spark, str(DATA)), con.sql(llm.ORACLE_SQL[name])
    order, other = sorted(df.columns), sorted(want.columns)
    assert order == other
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in other) for r in want.fetchall()), key=str)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 11))
