"""Each registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from rasterloom import plans  # noqa: F401
from rasterloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLES:
        assert got.num_columns
        return
    want = engine.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = [sorted(zip(*[t[c].to_pylist() for c in columns]), key=repr) for t in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert all(_same(x, y) for a, b in zip(*rows) for x, y in zip(a, b))
