"""Every query that has oracle SQL against DuckDB over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gristmill.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return names, sorted((tuple(map(plain, r)) for r in zip(*[table[n].to_pylist() for n in names])), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, sf_dir, duck, name):
    ours = rows(registry.QUERIES[name](spark, sf_dir).toArrow())
    theirs = rows(duck.execute(registry.ORACLE[name]).to_arrow_table())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
