"""Document collections built row by row from the bundled tables.

Each document is JSON text made of integers and short plain strings, with members
in name order, so that any engine builds the same text. Absent members are NULLs
skipped by `concat_ws`. Rows are never grouped or collected to build a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.sources.readers import documents_from_json

MIXED = """
select event_id as doc_id, concat('{', concat_ws(',',
    concat('"event_id":', event_id),
    concat('"props":', props),
    concat('"type":"', event_type, '"'),
    case when event_id % 13 = 0 then null
         when event_id % 11 = 0 then '"value":null'
         when event_id % 7 = 0 then concat('"value":"s', event_id, '"')
         when event_id % 2 = 0 then concat('"value":', event_id)
         else concat('"value":', event_id, '.5') end), '}') as j
from events
"""

# An earlier version of the mixed documents: other members, one type per member.
EVENTS_V1 = """
select event_id as doc_id, concat('{"event_id":', event_id, ',"props":', props, ',"source":"web","value":', event_id, '}') as j
from events
"""

ORDERS = """
select o_orderkey as doc_id, concat('{', concat_ws(',',
    case when o_orderkey % 4 = 0 then null else concat('"charges":[', concat_ws(',',
        concat('{"cents":', cast(round(o_totalprice * 100) as bigint), ',"kind":"net"}'),
        case when o_orderkey % 4 > 1 then concat('{"cents":', o_orderkey, ',"kind":"tax"}') end,
        case when o_orderkey % 4 > 2 then concat('{"cents":', o_custkey, ',"kind":"fee","note":"late"}') end), ']') end,
    concat('"customer":{"id":', o_custkey, ',"nation":"', coalesce(n_name, 'none'), '","segment":"',
        coalesce(c_mktsegment, 'none'), '"}'),
    concat('"order_id":', o_orderkey),
    concat('"placed_at":"', substr(cast(o_orderdate as string), 1, 10), '"'),
    concat('"status":"', o_orderstatus, '"'),
    concat('"total_cents":', cast(round(o_totalprice * 100) as bigint))), '}') as j
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey
"""

CONTACTS = """
select c_custkey as doc_id, concat('{', concat_ws(',',
    concat('"_id":', c_custkey),
    concat('"address":{', concat_ws(',', concat('"city":"city', c_nationkey, '"'),
        case when c_custkey % 4 <> 0 then concat('"zip":"', 10000 + c_custkey % 90000, '"') end), '}'),
    case when c_custkey % 10 <> 0 then
        concat('"email":"user', c_custkey, '@mail', c_custkey % 5, '.example.com"') end,
    concat('"name":"', c_name, '"'),
    case when c_custkey % 7 = 0 then '"phone":null' else
        concat('"phone":"+1-555-', 100 + c_custkey % 900, '-', 1000 + c_custkey % 9000, '"') end,
    case when c_custkey % 2 = 0 then concat('"score":', c_custkey) else concat('"score":', c_custkey, '.5') end,
    case c_custkey % 4 when 0 then null when 1 then '"tags":["t1"]' when 2 then '"tags":["t1",2]'
        else '"tags":["t1",2,"t3"]' end), '}') as j
from customer
"""

DEEP = """
select c_custkey as doc_id, case c_custkey % 6
    when 0 then concat('{"a":', c_custkey, '}')
    when 1 then concat('{"a":{"b":', c_custkey, '}}')
    when 2 then concat('{"a":{"b":{"c":', c_custkey, '}}}')
    when 3 then concat('{"a":{"b":{"c":{"d":', c_custkey, '}}}}')
    when 4 then concat('{"a":{"b":{"c":{"d":{"e":', c_custkey, '}}}}}')
    else concat('{"a":{"b":{"c":{"d":{"e":{"f":[', c_custkey, ',[{"g":1}]]}}}}}}') end as j
from customer
"""


def _wide() -> str:
    members = ", ".join(
        f"case when c_custkey % 40 > {i} then concat('\"m{i:02d}\":', c_custkey + {i}) end" for i in range(40)
    )
    return f"select c_custkey as doc_id, concat('{{', concat_ws(',', {members}), '}}') as j from customer"


STATEMENTS = {
    "event_props": "select event_id as doc_id, props as j from events",
    "events_v1": EVENTS_V1,
    "mixed_docs": MIXED,
    "order_docs": ORDERS,
    "contact_docs": CONTACTS,
    "deep_docs": DEEP,
    "wide_docs": _wide(),
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are documents or texts, i.e. expensive per row.

    A bundled table is one file of one row group, which no split size divides; larger tables are read as they lie.
    """
    rows = table(spark, folder, name)
    return rows.repartition(spark.sparkContext.defaultParallelism) if len(rows.inputFiles()) == 1 else rows


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """documents(collection, doc_id, v) of a fixture collection."""
    used = [t for t in ("events", "orders", "customer", "nation") if f"from {t}" in STATEMENTS[name] or f"join {t}" in STATEMENTS[name]]
    sources = {t: spread_table(spark, folder, t) if f"from {t}" in STATEMENTS[name] else table(spark, folder, t) for t in used}
    return documents_from_json(_run(spark, STATEMENTS[name], sources), name, "doc_id", "j")


def _run(spark: SparkSession, statement: str, sources: dict[str, DataFrame]) -> DataFrame:
    # Braces belong to the JSON text; tables are passed as parameters.
    statement = statement.replace("{", "{{").replace("}", "}}")
    for t in sources:
        for word in ("from", "join"):
            statement = statement.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(statement, **sources)
