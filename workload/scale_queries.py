"""Typed tables, similar path sets, screened keys, mergeable and incremental profiles, rows without ids, locale order."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from docstrata.functions import paths as P
from docstrata.operators import fields as A
from docstrata.operators import sampling as S
from docstrata.operators import similar as M
from docstrata.operators import variants as V
from docstrata.operators.flatten import flatten_documents
from docstrata.operators.typed import flatten_table, table_totals
from docstrata.session import cut_lineage, shared_folder
from docstrata.sources import readers, store
from docstrata.sources.fixtures import STATEMENTS, fixture, spread_table, table
from docstrata.sources.readers import documents_from_json
from docstrata.streaming import increments
from workload import oracle as O
from workload.registry import OPTIONS, documents, paths_of, query

# --- typed tables ------------------------------------------------------------------------------

_WHOLE = "case when {c} between -2147483648 and 2147483647 then 'int' else 'long' end"
_KINDS = {
    "bigint": ("case when {c} is null then 'null' else " + _WHOLE + " end", "cast({c} as double)"),
    "double": ("case when {c} is null then 'null' when {c} = floor({c}) then " + _WHOLE + " else 'double' end", "{c}"),
    "string": ("case when {c} is null then 'null' else 'string' end", "cast(null as double)"),
    "time": ("case when {c} is null then 'null' else 'date' end", "cast(null as double)"),
}
_TYPED = {
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "bigint", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
        "l_shipdate": "time",
    },
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
}


def _typed_sql() -> str:
    rows = [
        f"select '{t}' as collection, '{c}' as path, {_KINDS[k][0].format(c=c)} as type, {_KINDS[k][1].format(c=c)} as num from {t}"
        for t, columns in _TYPED.items()
        for c, k in columns.items()
    ]
    return f"""with v as ({' union all '.join(rows)}),
p as (select collection, path, count(*) as present_count, round(min(num), 6) as low, round(max(num), 6) as high, round(avg(num), 4) as mean from v group by 1, 2),
t as (select collection, path, string_agg(type || ':' || n, ' ' order by type) as types
 from (select collection, path, type, count(*) as n from v group by 1, 2, 3) s group by 1, 2)
select * from p join t using (collection, path)"""


@query(_typed_sql())
def profile_typed_table(spark, sf):
    profiles = []
    for name, columns in _TYPED.items():
        rows = spread_table(spark, sf, name)
        paths = flatten_table(rows, name, next(iter(columns)))
        profiles.append(A.profile_collection(paths, table_totals(rows, name), OPTIONS, examples=False))
    union = profiles[0].unionByName(profiles[1]).unionByName(profiles[2])
    return union.select(
        "collection", "path", "present_count",
        F.round("stats.min", 6).alias("low"), F.round("stats.max", 6).alias("high"), F.round("stats.avg", 4).alias("mean"),
        F.array_join(F.array_sort(F.transform("types", lambda t: F.concat_ws(":", t["type"], t["n"].cast("string")))), " ").alias("types"),
    )


# --- rows without an id ------------------------------------------------------------------------


def _without_ids(spark, sf, name):
    """A fixture whose ids are known for one document in three only."""
    rows = spread_table(spark, sf, "customer")
    some = spark.sql(
        f"select if(doc_id % 3 = 0, doc_id, null) as doc_id, j from ({STATEMENTS[name].replace('{', '{{').replace('}', '}}').replace('from customer', 'from {customer}')})",
        customer=rows,
    )
    return documents_from_json(some, name, "doc_id", "j")


@query(O.with_flat(f"select path, count(distinct doc_id) as present_count from ({O.FIELD_ROWS}) s group by 1", "contact_docs"))
def profile_without_ids(spark, sf):
    docs = _without_ids(spark, sf, "contact_docs")
    found = A.profile_collection(flatten_documents(docs, OPTIONS), A.document_counts(docs), OPTIONS)
    return found.select("path", "present_count")


@query(
    O.with_flat(
        """select path, type, count(*) as n from (select *, row_number() over (partition by doc_id order by id) as r from flat) s
 where r <= 10 group by 1, 2""",
        "wide_docs",
    )
)
def cap_keys_without_ids(spark, sf):
    docs = _without_ids(spark, sf, "wide_docs")
    rows = flatten_documents(docs, replace(OPTIONS, max_keys_per_doc=10))
    return rows.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


# --- similar sets ------------------------------------------------------------------------------


def _pairs_sql(sets: str, threshold: float) -> str:
    return f"""select a.name as a, b.name as b, round(len(list_intersect(a.paths, b.paths)) / len(list_distinct(list_concat(a.paths, b.paths))), 6) as similarity
from {sets} a join {sets} b on a.name < b.name
where len(list_intersect(a.paths, b.paths)) >= {threshold} * len(list_distinct(list_concat(a.paths, b.paths))) - 1e-9"""


@query(
    f"""with {O.flat('wide_docs', 'mixed_docs', 'order_docs', 'contact_docs', 'deep_docs')}, {O.shapes('')},
sets as (select signature as name, any_value(paths) as paths from signed group by 1) {_pairs_sql('sets', 0.6)}"""
)
def similar_shapes(spark, sf):
    shapes = V.shapes(documents(spark, sf, "wide_docs", "mixed_docs", "order_docs", "contact_docs", "deep_docs"))
    return M.similar_sets(cut_lineage(M.shape_sets(shapes)), 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


_COLLECTIONS = ("contact_docs", "order_docs", "mixed_docs", "events_v1", "event_props", "deep_docs", "wide_docs")


@query(
    f"""with {O.flat(*_COLLECTIONS)}, names as (select distinct collection, path from ({O.FIELD_ROWS}) s),
sets as (select collection as name, list(path) as paths from names group by 1) {_pairs_sql('sets', 0.1)}"""
)
def similar_collections(spark, sf):
    found = A.field_names(documents(spark, sf, *_COLLECTIONS))
    return M.similar_sets(cut_lineage(M.collection_paths(found)), 0.1).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"""with {O.flat('wide_docs', 'order_docs', 'contact_docs')}, {O.shapes('')},
sets as (select signature as name, any_value(paths) as paths from signed group by 1), pairs as ({_pairs_sql('sets', 0.9)})
select count(*) as pairs, true as recalled from pairs"""
)
def similar_shapes_by_bands(spark, sf):
    """How many pairs there are, and whether bands chosen for 0.95 find as many as they promise, less a tenth."""
    sets = cut_lineage(M.shape_sets(V.shapes(documents(spark, sf, "wide_docs", "order_docs", "contact_docs"))))
    exact, banded = (M.similar_sets(sets, 0.9, bands=b) for b in (None, M.bands_for(0.9, 0.95)))
    hit = exact.join(banded.select("a", "b", F.lit(1).alias("found")), ["a", "b"], "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), (F.coalesce(F.sum("found"), F.lit(0)) >= 0.85 * F.count(F.lit(1))).alias("recalled"))


# --- keys --------------------------------------------------------------------------------------

_KEYS = {
    "order_line": ("lineitem", ["l_orderkey", "l_linenumber"]),
    "part_supplier": ("lineitem", ["l_partkey", "l_suppkey"]),
    "quantity": ("lineitem", ["l_quantity"]),
}


def _key_sql(name: str, source: str, columns: list[str]) -> str:
    listed, keys = ", ".join(columns), ", ".join(f"{c}: 1" for c in columns)
    present = " and ".join(f"{c} is not null" for c in columns)
    return f"""select '{name}' as name, '{keys}' as keys, (select count(*) from {source}) as "rows",
 (select count(*) from {source} where not ({present})) as absent,
 coalesce((select max(n) = 1 from (select count(*) as n from {source} where {present} group by {listed}) s), true) as "unique\""""


@query(" union all ".join(_key_sql(name, *key) for name, key in _KEYS.items()))
def screened_keys(spark, sf):
    return readers.screened_keys(table(spark, sf, "lineitem"), {name: columns for name, (_, columns) in _KEYS.items()})


# --- profiles in parts -------------------------------------------------------------------------


def _halves(docs):
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs.where(late), docs.where(~late)


@query(
    O.with_flat(
        f"""select collection, path, count(*) as n, true as near from ({O.FIELD_ROWS}) s where type in ('int', 'long', 'double') group by 1, 2""",
        "order_docs",
        "contact_docs",
    )
)
def merged_percentile(spark, sf):
    """The 90th percentile from merged sketches: is its rank within one hundredth of the values?"""
    docs = documents(spark, sf, "order_docs", "contact_docs")
    merged = A.merge_quantiles(*[A.partial_quantiles(flatten_documents(half, OPTIONS)) for half in _halves(docs)])
    found = A.sketched_percentile(merged, 90)
    numbers = A.numeric_values(flatten_documents(docs, OPTIONS)).join(F.broadcast(found), ["collection", "path"])
    below, upto = F.count_if(F.col("num") < F.col("percentile")), F.count_if(F.col("num") <= F.col("percentile"))
    n = F.count(F.lit(1))
    # equal values share a range of ranks
    near = (below <= 0.91 * n + 1) & (upto >= 0.89 * n - 1) & (F.max("n") == n)
    return numbers.groupBy("collection", "path").agg(n.alias("n"), near.alias("near"))


@query(
    f"""with {O.flat('mixed_docs', 'order_docs')}, {O.shapes('')}
select collection, rank, signature, n as count, round(ratio, 6) as ratio from top"""
)
def merged_variants(spark, sf):
    docs = documents(spark, sf, "mixed_docs", "order_docs")
    merged = V.merge_shapes(*[V.shapes(half) for half in _halves(docs)])
    return V.top_variants(merged, 10).select("collection", F.col("rank").cast("bigint").alias("rank"), "signature", "count", F.round("ratio", 6).alias("ratio"))


@query(
    O.with_flat(
        f"""select path, type, count(*) as n, count(distinct doc_id) as docs, (select count(*) from flat_docs) as all_docs
 from ({O.FIELD_ROWS}) s group by 1, 2""",
        "order_docs",
    )
)
def stream_profile(spark, sf):
    """Documents arrive as files, two to a micro-batch; the stored batches together are the profile."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = fixture(spark, sf, "order_docs").select("doc_id", F.to_json("v").alias("j"))
    docs.select(F.to_json(F.struct("doc_id", "j")).alias("value")).repartition(6).write.text(f"{folder}/in")

    def to_documents(batch):
        rows = batch.select(F.from_json("value", "doc_id bigint, j string").alias("r")).select("r.*")
        return documents_from_json(rows, "order_docs", "doc_id", "j")

    lines = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{folder}/in")
    increments.profile_stream(lines, to_documents, f"{folder}/profile").trigger(availableNow=True).start().awaitTermination()
    totals = increments.read_profile(spark, f"{folder}/profile", "documents")
    types = increments.read_profile(spark, f"{folder}/profile", "types")
    return types.join(totals.withColumnRenamed("docs", "all_docs"), "collection").select("path", "type", "n", "docs", "all_docs")


@query(
    f"""with {O.flat('contact_docs', 'order_docs')}, names as (select collection, path, count(distinct doc_id) as n from ({O.FIELD_ROWS}) s group by 1, 2),
half as (select path, count(distinct doc_id) as n from ({O.FIELD_ROWS}) s where collection = 'contact_docs' and doc_id % 2 = 0 group by 1)
select 'report' as kind, collection, path, n from names where collection = 'order_docs'
union all select 'report', 'contact_docs', path, n from half
union all select 'schema', collection, path, n from names where collection = 'order_docs'
union all select 'schema', 'contact_docs', path, n from half"""
)
def update_profile(spark, sf):
    """Two collections are stored, one of them again with fewer documents: the other stays as it was."""
    folder = f"{shared_folder(spark)}/updated-{uuid.uuid4().hex}"

    def save(docs):
        fields = cut_lineage(A.profile_collection(flatten_documents(docs, OPTIONS), A.document_counts(docs), OPTIONS))
        store.update_reports(folder, {"fields": fields.select("collection", "path", "present_count")})
        store.update_schema_json(f"{folder}/schema", fields, V.variant_analysis(docs, OPTIONS))

    save(documents(spark, sf, "contact_docs", "order_docs"))
    save(fixture(spark, sf, "contact_docs").where("doc_id % 2 = 0"))
    report = spark.read.parquet(f"{folder}/fields").select(F.lit("report").alias("kind"), "collection", "path", F.col("present_count").alias("n"))
    schema = store.stored_fields(store.load_schema_json(spark, f"{folder}/schema"))
    return report.unionByName(schema.select(F.lit("schema").alias("kind"), "collection", "path", F.col("present_count").alias("n")))


@query("select event_id, event_type from events where ('0x' || substr(md5('7:' || event_id), 1, 8))::bigint < cast(0.05 * 4294967296 as bigint)")
def keyed_fraction(spark, sf):
    return S.keyed_fraction(table(spark, sf, "events"), 0.05, "event_id", "7").select("event_id", "event_type")


@query("select event_type, true as within from events group by 1")
def fraction_sample(spark, sf):
    """Of every type of event, does a sample of three tenths hold about that share?"""
    events = table(spark, sf, "events").select("event_type")
    whole = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    some = S.fraction_sample(events, 0.3, 7).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
    off = F.abs(F.coalesce("kept", F.lit(0)) - 0.3 * F.col("n"))
    return whole.join(some, "event_type", "left").select("event_type", (off <= 6 * F.sqrt(0.21 * F.col("n")) + 1).alias("within"))


# --- locale order ------------------------------------------------------------------------------

#: Beginnings of names in the order that the root collation gives them; those of one line are equal to it.
_ORDERED = (("_x",), ("-x",), ("[x",), ("@x",), ("#x",), ("$x",), ("",), ("a b", "Á b"), ("a_b", "A_B"), ("a-b",), ("Ab", "áb", "aB"), ("É", "e", "ê"), ("Item", "ítem"), ("ñ", "N"), ("z", "Ž"), ("日",))
_BEGINNINGS = [(text, rank) for rank, texts in enumerate(_ORDERED) for text in texts]
#: Digits that follow the number of a row, so that some numbers are longer than any integer type.
_ZEROS = "000000000000000000000000"


def _names_sql() -> str:
    values = ", ".join(f"({i}, '{text}', {rank})" for i, (text, rank) in enumerate(_BEGINNINGS))
    return f"""begins as (select * from (values {values}) s(i, text, base)),
names as (select p_partkey, p_brand, text, base, p_partkey || case when p_partkey % 5 = 0 then '{_ZEROS}' else '' end as digits
 from part join begins on i = (p_partkey * 7) % {len(_BEGINNINGS)})"""


def _names(spark, sf, between: str = ""):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _BEGINNINGS]), (F.col("p_partkey") * 7 % len(_BEGINNINGS) + 1).cast("int"))
    digits = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, F.lit(_ZEROS)).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(text, F.lit(between), digits).alias("name"))


@query(f"with {_names_sql()} select p_partkey, text || digits as name, row_number() over (partition by p_brand order by base, length(digits), digits, p_partkey) as rank from names")
def locale_sort(spark, sf):
    order = Window.partitionBy("p_brand").orderBy(P.natural_order(F.col("name")), "p_partkey")
    return _names(spark, sf).select("p_partkey", "name", F.row_number().over(order).cast("bigint").alias("rank"))


@query(
    f"""with {_names_sql()}
select p_brand, string_agg(base || '.' || digits, ' ' order by text <> '', base, length(digits), digits) as sorted from names group by 1"""
)
def locale_path_sort(spark, sf):
    """Paths of two segments in order, with the rank of the first segment in its place."""
    ranks = F.create_map(*[F.lit(x) for text, rank in _BEGINNINGS for x in (text, str(rank))])
    listed = _names(spark, sf, ".").groupBy("p_brand").agg(P.sort_paths(F.collect_list("name")).alias("paths"))
    spelled = F.transform("paths", lambda p: F.concat_ws(".", F.element_at(ranks, F.substring_index(p, ".", 1)), F.substring_index(p, ".", -1)))
    return listed.select("p_brand", F.array_join(spelled, " ").alias("sorted"))
