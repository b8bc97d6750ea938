"""Every query of the sensor part against the SQL that says the same. $GRIDWEAVE_SF chooses the tables, 0.001 by default."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from gridweave.plans import catalog

DATA = Path("/root/testdata") / f"sf{os.environ.get('GRIDWEAVE_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def answers(spark, request):
    """Results of the chosen queries to come: most are many small jobs, so some run at a time."""
    names = [i.callspec.params["name"] for i in request.session.items if i.module is request.module]
    pool = ThreadPoolExecutor(4)
    yield {n: pool.submit(lambda n=n: catalog.QUERIES[n](spark, str(DATA)).toPandas()) for n in names}
    pool.shutdown(cancel_futures=True)


def normal(frame):
    columns = sorted(frame.columns)
    out = frame[columns].copy()
    for c in columns:
        if out[c].dtype != object:
            out[c] = out[c].astype(float)
    return sorted(out.astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(answers, duck, name):
    got = answers[name].result()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
