"""A few registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical
from docstrata.sources.fixtures import TABLES
from workload.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["flatten_events", "field_presence", "variant_analysis", "mask_table", "schema_drift", "fk_context"]

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="bundled tables are not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)
