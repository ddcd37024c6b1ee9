"""Every catalogue query against its DuckDB oracle at the smallest scale."""

import os

import duckdb
import pytest

from veilspark.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_oracle(spark, duck, name):
    found, wanted = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    out = catalogue.flagship(spark, DIR).toPandas()
    assert len(out) == 2 and out.o_totalprice.between(0, 1).all()
