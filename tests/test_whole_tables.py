"""Queries of outputs and actions over whole tables of a larger size."""

import math

import duckdb
import pytest

from facetflow.plans import catalog

SF = "/root/testdata/sf0.01"


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["consolidated", "shown_outputs", "result_priority", "action_plan", "dense_records"])
def test_whole_tracks(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and found == expected
