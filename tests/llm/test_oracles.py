"""Queries that SQL can express against their DuckDB oracle, and the registry."""
import duckdb
import pytest

import __spark_entry__ as entry
from cohortkit.llm import queries

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle_parity(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema} == dict(zip(want.columns, map(str, want.types)))
    cols = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=repr)
    assert len(rows) >= 50


def test_every_operator_is_registered_once():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14))
    assert "pipeline" in entry.queries()


def test_nothing_else_imports_the_package():
    import pathlib
    import re
    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*llm", p.read_text(), re.M), p
