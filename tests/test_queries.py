"""Every analytics query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pitchline.functions import formulas as fx
from pitchline.operators import asof, ratings
from pitchline.plans import features, outcomes, queries, relational

QUERIES = queries.QUERIES | relational.QUERIES | features.QUERIES | outcomes.QUERIES
ORACLE = queries.ORACLE | relational.ORACLE | features.ORACLE | outcomes.ORACLE
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(x, y) -> bool:
    if isinstance(x, float) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rel = duck.sql(ORACLE[name])
    assert cols == sorted(rel.columns)
    order = lambda r: tuple((v is not None, round(v, 3) if isinstance(v, float) else v) for v in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=order)
    b = sorted(duck.sql(f"select {', '.join(cols)} from ({ORACLE[name].rstrip()})").fetchall(), key=order)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, 5), (1, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 3, 30), (1, 5, 50)], "k long, t long, v long")
    out = {r.t: r.v for r in asof.asof_before(left, right, "k", "t", "t", right.v, "v").collect()}
    assert out == {5: 30, 3: None}


def test_elo_is_zero_sum(spark):
    m = spark.createDataFrame([("a", 1, 1, 2, 1.0), ("a", 2, 2, 1, 1.0)], "league string, at long, h long, w long, s double")
    rows = ratings.elo_scan(m, "league", ["at"], "h", "w", "s").collect()
    assert rows[0].change == 10.0 and rows[1].home_before + rows[1].away_before == 2800.0


def test_uniform_does_not_depend_on_partitions(spark):
    a = spark.range(50).repartition(7)
    b = spark.range(50).coalesce(1)
    draw = lambda d: {r[0]: r[1] for r in d.select("id", fx.uniform(1, d.id)).collect()}
    assert draw(a) == draw(b) and all(0 <= v < 1 for v in draw(a).values())
