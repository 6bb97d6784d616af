import glob
import os

import duckdb
import pytest

from litloom.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    d = catalog.QUERIES[name](spark, sf)
    q = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in q.description]
    assert sorted(cols) == sorted(d.columns)
    want, got = ([tuple(r[cols.index(c)] for c in sorted(cols)) for r in q.fetchall()], [tuple(r[c] for c in sorted(cols)) for r in d.collect()])
    assert sorted(want, key=repr) == sorted(got, key=repr)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.endswith("_found")])
def test_found_queries_have_the_stated_columns(spark, sf, name):
    want = {
        "p1_found": {"group_id": "bigint", "field_name": "string", "record_id": "bigint"}, "p2_found": {"cite_id_a": "bigint", "cite_id_b": "bigint"},
        "p4_found": {"field_name": "string", "row_id": "bigint", "pos": "bigint", "ref_id": "bigint"}, "p5_found": {"item_kind": "string", "item_a": "string", "item_b": "string"},
        "p6_found": {"paper_id": "string", "dim": "string", "label": "string"}, "p7_found": {"term": "string", "band": "string"}, "p10_found": {"doc_id": "bigint"},
    }[name]
    d = catalog.QUERIES[name](spark, sf)
    assert dict(d.dtypes) == want and d.count() == d.distinct().count() > 0
