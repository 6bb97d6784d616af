import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from litloom.plans import catalog


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return float(v) if hasattr(v, "is_integer") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    d = catalog.QUERIES[name](spark, sf)
    q = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in q.description]
    assert sorted(cols) == sorted(d.columns)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in q.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in d.collect()), key=repr)
    assert got == want


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
