"""Every registered query of the search engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from foliant.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or str(v) in ("NaT", "<NA>") or isinstance(v, float) and math.isnan(v):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(str([plain(v) for v in r]) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
