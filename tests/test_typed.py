"""Path rows of typed tables: planned from the schema, equal to those of the VARIANT way."""

import os

import pytest
from pyspark.sql import functions as F

from docstrata.operators import fields
from docstrata.operators.flatten import flatten_documents
from docstrata.operators.typed import OUTPUTS, flatten_table, is_static, table_totals
from docstrata.options import ProfileOptions
from docstrata.sources.readers import documents_from_table

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="bundled tables are not here")

NESTED = """
select * from values
 (1L, 'x', 1Y, 7, 3000000000L, 1.5D, float('2.0'), 12.50BD, true, date'2024-02-29', timestamp'2024-02-29 12:34:56.789', X'00FF',
  named_struct('b', 1, 'a', 'y', 'in', named_struct('k', array(1L, null, 5000000000L))), array(named_struct('p', 'q', 'r', 2.25D), null), array(array(1, 2), array())),
 (2L, null, null, null, null, double('NaN'), null, 100.00BD, null, null, null, null, null, null, null),
 (3L, '', 2Y, -8, -1L, 1e21D, float('0.1'), -0.05BD, false, date'1969-12-31', timestamp'1969-12-31 23:59:59', X'',
  named_struct('b', null, 'a', null, 'in', null), array(), array(null, array(3))),
 (null, 'n', 2Y, -8, -1L, 1e-7D, float('3e8'), 7BD, false, null, null, X'01', named_struct('b', 2, 'a', 'z', 'in', named_struct('k', array())), array(named_struct('p', null, 'r', double('infinity'))), null),
 (null, 'n', 2Y, -8, -1L, -2.0D, float('3e8'), 7BD, false, null, null, X'01', null, null, null)
 as t(id, s, tiny, i, `l.o$ng`, d, f, dec, bool, `dat e`, ts, bin, obj, `[3]`, deep)"""


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select("collection", "doc_id", *OUTPUTS, "keys_refused", "depth_cut").collect())


@pytest.mark.parametrize(
    "options",
    [
        ProfileOptions(),
        ProfileOptions(max_depth=1),
        ProfileOptions(max_depth=2),
        ProfileOptions(max_depth=3),
        ProfileOptions(max_array_sample=1),
        ProfileOptions(typed_decimals=True),
    ],
    ids=["plain", "depth1", "depth2", "depth3", "array1", "decimals"],
)
def test_rows_are_those_of_the_variant_way(spark, options):
    table = spark.sql(NESTED)
    assert is_static(table.schema, options)
    got = rows_of(flatten_table(table, "c", "id", options))
    assert got == rows_of(flatten_documents(documents_from_table(table, "c", "id"), options))


def test_fields_and_outputs(spark):
    table = spark.sql(NESTED)
    whole = flatten_table(table, "c", "id")
    part = flatten_table(table, "c", "id", fields=["s", "obj.in"], outputs=["path", "type"])
    assert part.columns == ["collection", "doc_id", "path", "type", "keys_refused", "depth_cut"]
    want = whole.where("path in ('s', 'obj') or path like 'obj.in%'").select("doc_id", "path", "type")
    assert sorted(map(repr, part.select("doc_id", "path", "type").collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        flatten_table(table, "c", "id", outputs=["nothing"])
    assert flatten_table(table.limit(0), "c", "id").count() == 0


def test_schemas_that_cannot_be_planned(spark):
    table = spark.sql("select 1L as id, map('k', 1) as m, parse_json('{\"a\":1}') as v, named_struct('$oid', 'ff') as o")
    assert not is_static(table.schema)
    assert rows_of(flatten_table(table, "c", "id")) == rows_of(flatten_documents(documents_from_table(table, "c", "id")))
    assert is_static(table.select("id").schema) and not is_static(table.select("id").schema, ProfileOptions(max_keys_per_doc=3))


def test_rows_without_an_id_are_documents_of_their_own(spark):
    table = spark.sql("select cast(null as bigint) as id, array(named_struct('b', 1), named_struct('b', 2)) as a from range(3)")
    for paths in (flatten_table(table, "c", "id"), flatten_documents(documents_from_table(table, "c", "id"))):
        found = {r.path: r.present_count for r in fields.field_presence(paths, table_totals(table, "c")).collect()}
        assert found == {"id": 3, "a": 3, "a.[*].b": 3}


@needs_data
def test_only_wanted_columns_are_read(spark):
    lineitem = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    paths = flatten_table(lineitem, "lineitem", "l_orderkey", fields=["l_quantity", "l_returnflag"])
    plan = fields.type_distribution(paths)._jdf.queryExecution().toString()
    read = plan[plan.rindex("ReadSchema") :].splitlines()[0]
    assert "l_quantity" in read and "l_returnflag" in read and "l_comment" not in read and "l_tax" not in read
    assert "variant" not in plan.lower()


@needs_data
@pytest.mark.parametrize("name,key", [("lineitem", "l_orderkey"), ("documents", "doc_id"), ("pages", "page_id"), ("orders", "o_orderkey")])
def test_bundled_tables(spark, name, key):
    table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
    static, variant = flatten_table(table, name, key), flatten_documents(documents_from_table(table, name, key))
    kept = ["doc_id", *OUTPUTS]
    assert static.select(*kept).exceptAll(variant.select(*kept)).count() == 0
    assert variant.select(*kept).exceptAll(static.select(*kept)).count() == 0
    profile = fields.profile_collection(static, table_totals(table, name))
    assert profile.where(F.col("present_count") == 0).count() == 0
