"""Flattening, field statistics, variants and personal data over document collections."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from docstrata.functions import masks, paths as P, pii, text as X
from docstrata.operators import fields as A
from docstrata.operators import variants as V
from docstrata.operators.flatten import flatten_documents, normalize_wildcards, value_type
from docstrata.operators.typed import flatten_table, table_totals
from docstrata.session import shared_folder
from docstrata.sources.fixtures import spread_table, table
from docstrata.sources.readers import documents_from_json, documents_from_table, duplicate_ids, read_documents, rejected_documents
from workload import oracle as O
from workload.registry import OPTIONS, documents, paths_of, query

R6 = lambda c: F.round(c, 6)


# --- flatten -----------------------------------------------------------------------------------


@query(O.with_flat("select collection, doc_id, path, type, text, size from flat", "event_props"))
def flatten_events(spark, sf):
    return paths_of(spark, sf, "event_props").select("collection", "doc_id", "path", "type", "text", "size")


@query(O.with_flat("select collection, doc_id, path, type, text, size from flat", "order_docs"))
def flatten_orders(spark, sf):
    return paths_of(spark, sf, "order_docs").select("collection", "doc_id", "path", "type", "text", "size")


@query(O.with_flat("select collection, doc_id, path, type, text, size from flat", "contact_docs"))
def flatten_contacts(spark, sf):
    return paths_of(spark, sf, "contact_docs").select("collection", "doc_id", "path", "type", "text", "size")


@query(O.with_flat("select path, type, count(*) as n from flat group by 1, 2", "order_docs", "contact_docs"))
def normalize_wildcards_query(spark, sf):
    raw = paths_of(spark, sf, "order_docs", "contact_docs", raw_paths=True)
    return normalize_wildcards(raw).groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query(O.with_flat("select path, text, count(*) as n from flat where type = 'array' or path like '%[*]%' group by 1, 2", "order_docs", "contact_docs"))
def array_paths(spark, sf):
    rows = paths_of(spark, sf, "order_docs", "contact_docs", arrays_only=True)
    return rows.groupBy("path", "text").agg(F.count(F.lit(1)).alias("n"))


@query(O.with_flat(f"select path, count(*) as n from ({O.FIELD_ROWS}) group by 1", "order_docs", "contact_docs"))
def drop_marker_paths(spark, sf):
    rows = paths_of(spark, sf, "order_docs", "contact_docs", markers=True)
    return A.drop_marker_paths(rows).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(O.with_flat("select doc_id, type as value_type from flat where path = 'value'", "mixed_docs"))
def value_type_query(spark, sf):
    docs = documents(spark, sf, "mixed_docs").select("doc_id", F.expr("try_variant_get(v, '$.value', 'variant')").alias("w"))
    return docs.where("w is not null").select("doc_id", value_type("w").alias("value_type"))


@query(
    O.with_flat(
        """select path, type, count(*) as n from flat
 where not regexp_matches(fullkey_of, '\\[[1-9]') group by 1, 2""".replace("fullkey_of", "fk"),
        "contact_docs",
    ).replace("select collection, doc_id, id, parent,", "select collection, doc_id, id, parent, fullkey as fk,")
)
def cap_array_elements(spark, sf):
    rows = paths_of(spark, sf, "contact_docs", options=replace(OPTIONS, max_array_sample=1))
    return rows.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    O.with_flat(
        """select case when levels = 4 then path || '.[TRUNCATED]' else path end as path,
 case when levels = 4 then 'null' else type end as type, count(*) as n
 from (select *, len(string_split(path, '.')) as levels from flat) s where levels <= 4 group by 1, 2""",
        "deep_docs",
    )
)
def cap_depth(spark, sf):
    rows = paths_of(spark, sf, "deep_docs", options=replace(OPTIONS, max_depth=3))
    return rows.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    O.with_flat(
        """select doc_id, path, type from (select *, row_number() over (partition by doc_id order by id) as r from flat) s
 where r <= 10""",
        "wide_docs",
    )
)
def cap_keys_per_doc(spark, sf):
    return paths_of(spark, sf, "wide_docs", options=replace(OPTIONS, max_keys_per_doc=10)).select("doc_id", "path", "type")


_TRUNCATION = """counts as (
 select 'deep_docs' as collection, count(*) filter (where len(string_split(path, '.')) = 4) as depth_truncated,
  0 as keys_truncated, 0 as arrays_truncated from flat where collection = 'deep_docs'
 union all
 select 'wide_docs', 0, cast(sum(greatest(n - 10, 0)) as bigint), 0
  from (select doc_id, count(*) as n from flat where collection = 'wide_docs' group by 1) s
 union all
 select 'contact_docs', 0, 0, count(*) filter (where type = 'array' and size > 2) from flat where collection = 'contact_docs')
select collection, cast(sum(depth_truncated) as bigint) as depth_truncated,
 cast(sum(keys_truncated) as bigint) as keys_truncated, cast(sum(arrays_truncated) as bigint) as arrays_truncated
from counts group by rollup (collection)"""


@query("with " + O.flat("deep_docs", "wide_docs", "contact_docs") + ", " + _TRUNCATION)
def truncation_counters(spark, sf):
    o = replace(OPTIONS, max_array_sample=2)
    paths = A.merge_paths(
        paths_of(spark, sf, "deep_docs", options=replace(o, max_depth=3)),
        paths_of(spark, sf, "wide_docs", options=replace(o, max_keys_per_doc=10)),
        paths_of(spark, sf, "contact_docs", options=o),
    )
    return A.truncation_counters(paths, o)


@query(
    O.with_flat(
        """select a.path || '.[*]' as path, e.type, count(distinct (a.doc_id, a.id)) as arrays, count(distinct a.doc_id) as docs
 from flat a join flat e on e.collection = a.collection and e.doc_id = a.doc_id and e.parent = a.id
 where a.type = 'array' group by 1, 2""",
        "order_docs",
        "contact_docs",
        "deep_docs",
    )
)
def array_element_types(spark, sf):
    rows = paths_of(spark, sf, "order_docs", "contact_docs", "deep_docs", markers=True, leaves=False)
    return A.array_element_types(rows).select("path", "type", "arrays", "docs")


@query(
    O.with_flat(
        f"""select path, type, count(*) as n, count(distinct doc_id) as docs,
 round(sum(case when type in ('int', 'double') then cast(text as double) end), 3) as num_sum from ({O.FIELD_ROWS}) group by 1, 2""",
        "order_docs",
    )
)
def merge_paths(spark, sf):
    docs = documents(spark, sf, "order_docs")
    late = F.expr("coalesce(try_variant_get(v, '$.placed_at', 'string') >= '1997-01-01', false)")
    parts = [A.partial_profile(flatten_documents(docs.where(side), OPTIONS)) for side in (late, ~late)]
    merged = A.merge_profiles(*parts)
    return merged.select("path", "type", "n", "docs", F.round("num_sum", 3).alias("num_sum"))


# --- field statistics --------------------------------------------------------------------------


_PRESENCE = """select collection, path, present_count, absent_count, round(present_ratio, 6) as present_ratio from fields"""


@query(f"with {O.flat('order_docs', 'contact_docs')}, {O.fields()} {_PRESENCE}")
def field_presence(spark, sf):
    docs = documents(spark, sf, "order_docs", "contact_docs")
    rows = A.field_presence(paths_of(spark, sf, "order_docs", "contact_docs"), A.document_counts(docs), OPTIONS)
    return rows.select("collection", "path", "present_count", "absent_count", R6("present_ratio").alias("present_ratio"))


@query(f"with {O.flat('contact_docs')}, {O.fields()} select path, optional from fields")
def field_optional(spark, sf):
    docs = documents(spark, sf, "contact_docs")
    rows = A.field_presence(paths_of(spark, sf, "contact_docs"), A.document_counts(docs), OPTIONS)
    return rows.select("path", "optional")


@query(O.with_flat(f"select collection, path, type, count(*) as n from ({O.FIELD_ROWS}) group by 1, 2, 3", "mixed_docs", "order_docs"))
def type_distribution(spark, sf):
    return A.type_distribution(paths_of(spark, sf, "mixed_docs", "order_docs"))


@query(
    O.with_flat(
        f"""select path, type, round(n / sum(n) over (partition by path), 6) as ratio
 from (select path, type, count(*) as n from ({O.FIELD_ROWS}) group by 1, 2) s""",
        "mixed_docs",
    )
)
def type_ratio(spark, sf):
    counted = A.type_distribution(paths_of(spark, sf, "mixed_docs"))
    return A.type_ratio(counted).select("path", "type", R6("ratio").alias("ratio"))


@query(f"with {O.flat('mixed_docs')}, {O.fields()} select path, mixed_type from fields")
def mixed_types(spark, sf):
    return A.mixed_types(A.type_distribution(paths_of(spark, sf, "mixed_docs"))).select("path", "mixed_type")


@query(
    f"""with {O.flat('mixed_docs', 'contact_docs')}, {O.fields()},
best as (select collection, path, type from fields_types where type <> 'null'
 qualify row_number() over (partition by collection, path order by n desc, first) = 1)
select f.collection, f.path, b.type as primary_type from fields f left join best b using (collection, path)"""
)
def primary_type(spark, sf):
    return A.primary_type(A.type_counts(paths_of(spark, sf, "mixed_docs", "contact_docs")))


@query(
    f"""with {O.flat('mixed_docs', 'order_docs')}, {O.fields()} select collection, path, lo as min, hi as max,
 round(av, 4) as avg from fields where lo is not null"""
)
def numeric_stats(spark, sf):
    rows = A.numeric_stats(paths_of(spark, sf, "mixed_docs", "order_docs"))
    return rows.withColumn("avg", F.round("avg", 4))


_NUMERIC = f"select path, cast(text as double) as num from ({O.FIELD_ROWS}) where type in ('int', 'long', 'double')"


@query(O.with_flat(f"select path, round(quantile_cont(num, 0.9), 4) as p90 from ({_NUMERIC}) group by 1", "order_docs"))
def field_percentile(spark, sf):
    rows = A.field_percentile(paths_of(spark, sf, "order_docs"), 90)
    return rows.select("path", F.round("percentile", 4).alias("p90"))


@query(O.with_flat(f"select path, round(stddev_pop(num), 3) as stddev from ({_NUMERIC}) group by 1", "mixed_docs"))
def field_stddev(spark, sf):
    return A.field_stddev(paths_of(spark, sf, "mixed_docs")).select("path", F.round("stddev", 3).alias("stddev"))


@query(
    f"""with {O.flat('contact_docs', 'mixed_docs')}, {O.rendered()}, {O.examples()}
select collection, path, type, rank, shown as example from ex"""
)
def examples_per_type(spark, sf):
    found = A.examples_per_type(paths_of(spark, sf, "contact_docs", "mixed_docs"), OPTIONS)
    return found.select("collection", "path", "type", F.col("rank").cast("bigint").alias("rank"), F.col("rendered").alias("example"))


@query(
    f"""with {O.flat('contact_docs')}, all_hints as (select *, {O.hint_list('path', O.STRING_VALUE)} as hints from ({O.FIELD_ROWS}) r),
rendered as (select *, case type when 'string' then {O.mask_string('text', strict=True)} else {O.masked('hints')} end as shown from (
 select * replace (case when list_contains(hints, 'email') or list_contains(hints, 'phone') then hints else [] end as hints) from all_hints
 where not (type = 'string' and (list_contains(hints, 'email') or list_contains(hints, 'phone')))
 ) s union all select *, {O.masked('hints')} as shown from all_hints
 where type = 'string' and (list_contains(hints, 'email') or list_contains(hints, 'phone'))),
{O.examples()} select collection, path, type, rank, shown as example from ex"""
)
def examples_all_masked_strict(spark, sf):
    o = replace(OPTIONS, redact="all", redact_mode="strict")
    found = A.examples_per_type(paths_of(spark, sf, "contact_docs"), o)
    return found.select("collection", "path", "type", F.col("rank").cast("bigint").alias("rank"), F.col("rendered").alias("example"))


_PROFILE = f"""{O.fields()}, {O.rendered()}, {O.examples()}, {O.field_hints()}
select f.path, f.present_count, f.absent_count, round(f.present_ratio, 6) as present_ratio, f.optional,
 array_to_string(list_transform(list_zip(f.type_list, f.n_list), lambda z: z[1] || ':' || z[2]), ', ') as types,
 f.mixed_type, f.lo as min, f.hi as max, round(f.av, 4) as avg, coalesce(h.hints, '') as hints,
 array_to_string(e.shown_list, ' | ') as examples
from fields f left join fh_text h using (collection, path) left join ex_list e using (collection, path)"""


def _profile_columns(fields):
    return fields.select(
        "path", "present_count", "absent_count", R6("present_ratio").alias("present_ratio"), "optional",
        F.array_join(F.transform("types", lambda t: F.concat_ws(":", t["type"], t["n"].cast("string"))), ", ").alias("types"),
        "mixed_type", F.col("stats.min").alias("min"), F.col("stats.max").alias("max"),
        F.round("stats.avg", 4).alias("avg"), F.array_join("hints", ", ").alias("hints"),
        F.array_join(F.transform("examples", lambda e: e["value"]), " | ").alias("examples"),
    )


@query(f"with {O.flat('order_docs')}, {_PROFILE}")
def profile_collection(spark, sf):
    docs = documents(spark, sf, "order_docs")
    return _profile_columns(A.profile_collection(paths_of(spark, sf, "order_docs"), A.document_counts(docs), OPTIONS))


@query(f"with {O.flat('contact_docs')}, {_PROFILE}")
def profile_contacts(spark, sf):
    docs = documents(spark, sf, "contact_docs")
    return _profile_columns(A.profile_collection(paths_of(spark, sf, "contact_docs"), A.document_counts(docs), OPTIONS))


@query(f"with {O.flat('order_docs')}, {_PROFILE} where f.path = 'charges.[*].cents'")
def profile_field(spark, sf):
    docs = documents(spark, sf, "order_docs")
    paths = paths_of(spark, sf, "order_docs")
    return _profile_columns(A.profile_field(paths, A.document_counts(docs), "charges.[*].cents", OPTIONS))


# --- variants ----------------------------------------------------------------------------------


@query(f"with {O.flat('contact_docs')}, {O.shapes('contact_docs')} select doc_id, array_to_string(paths, '|') as paths from shape")
def shape_paths(spark, sf):
    docs = documents(spark, sf, "contact_docs")
    return docs.select("doc_id", F.array_join(P.sort_paths(V.shape_paths("v")), "|").alias("paths"))


@query(f"with {O.flat('deep_docs')}, {O.shapes('deep_docs')} select signature, count(*) as n from shape group by 1")
def shape_signature(spark, sf):
    docs = documents(spark, sf, "deep_docs")
    signed = docs.select(V.shape_signature(V.shape_paths("v")).alias("signature"))
    return signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {O.flat('contact_docs', 'order_docs')}, {O.shapes('')}
select collection, rank, signature, left(signature, 8) as short_signature, n as count, round(ratio, 6) as ratio, array_to_string(paths, '|') as paths,
 array_to_string(added, '|') as added, array_to_string(missing, '|') as missing from diffed"""
)
def variant_analysis(spark, sf):
    found = V.variant_analysis(documents(spark, sf, "contact_docs", "order_docs"), OPTIONS)
    return found.select(
        "collection", F.col("rank").cast("bigint").alias("rank"), "signature", "short_signature", "count", R6("ratio").alias("ratio"),
        F.array_join(P.sort_paths(F.col("paths")), "|").alias("paths"), F.array_join("added", "|").alias("added"),
        F.array_join("missing", "|").alias("missing"),
    )


@query(
    f"""with {O.flat('wide_docs')}, {O.shapes('')}
select rank, signature, n as count, first_doc from ranked where rank <= 5"""
)
def top_variants(spark, sf):
    top = V.top_variants(V.shapes(documents(spark, sf, "wide_docs")), 5)
    return top.select(F.col("rank").cast("bigint").alias("rank"), "signature", "count", "first_doc")


@query(
    f"""with {O.flat('deep_docs', 'contact_docs')}, {O.shapes('')}
select collection, signature, array_to_string(added, '|') as added, array_to_string(missing, '|') as missing from diffed"""
)
def variant_diff(spark, sf):
    top = V.top_variants(V.shapes(documents(spark, sf, "deep_docs", "contact_docs")), OPTIONS.variant_top)
    return V.variant_diff(top).select(
        "collection", "signature", F.array_join("added", "|").alias("added"), F.array_join("missing", "|").alias("missing")
    )


@query(
    f"""with {O.flat('contact_docs')}, {O.shapes('')}
select signature, len(added) as added_count, len(missing) as missing_count,
 case when rank = 1 then '-' else {O.diff_text()} end as diff from diffed"""
)
def path_diff(spark, sf):
    top = V.variant_diff(V.top_variants(V.shapes(documents(spark, sf, "contact_docs")), OPTIONS.variant_top))
    return top.select(
        "signature", F.size("added").cast("bigint").alias("added_count"), F.size("missing").cast("bigint").alias("missing_count"),
        X.format_diff(F.col("added"), F.col("missing")).alias("diff"),
    )


@query(
    f"""with {O.flat('contact_docs', 'wide_docs')}, {O.shapes('')}
select collection, signature, round(len(list_intersect(paths, base)) / greatest(len(list_distinct(paths || base)), 1)
 + case when len(paths || base) = 0 then 1 else 0 end, 6) as similarity from diffed"""
)
def shape_similarity(spark, sf):
    top = V.top_variants(V.shapes(documents(spark, sf, "contact_docs", "wide_docs")), OPTIONS.variant_top)
    found = V.similarity_to_primary(top)
    return found.select("collection", "signature", R6("similarity").alias("similarity"))


# --- personal data -----------------------------------------------------------------------------


@query(
    O.with_flat(
        f"""select doc_id, path, text, {O.joined(O.hint_list('path', O.STRING_VALUE))} as hints from ({O.FIELD_ROWS}) r""",
        "contact_docs",
    )
)
def detect_pii(spark, sf):
    rows = A.field_rows(paths_of(spark, sf, "contact_docs"))
    value = F.when(F.col("type") == "string", F.col("text"))
    return rows.select("doc_id", "path", "text", F.array_join(pii.detect_pii(F.col("path"), value), ", ").alias("hints"))


@query(
    O.with_flat(
        f"""select path, count(*) as n, count(*) filter (where len({O.hint_list('path', O.STRING_VALUE)}) > 0) as hits
 from ({O.FIELD_ROWS}) r group by 1""",
        "contact_docs",
        "order_docs",
    )
)
def has_pii(spark, sf):
    rows = A.field_rows(paths_of(spark, sf, "contact_docs", "order_docs"))
    value = F.when(F.col("type") == "string", F.col("text"))
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pii.has_pii(F.col("path"), value)).alias("hits")
    )


@query(
    O.with_flat(
        f"""select collection, path, len({O.hint_list('path', None)}) > 0 as is_pii,
 {O.joined(O.hint_list('path', None))} as hints from (select distinct collection, path from flat) r""",
        "contact_docs",
        "order_docs",
        "mixed_docs",
    )
)
def is_pii_field(spark, sf):
    rows = paths_of(spark, sf, "contact_docs", "order_docs", "mixed_docs").select("collection", "path").distinct()
    hints = pii.hints_of(pii.path_hint_mask(F.col("path")))
    return rows.select("collection", "path", pii.is_pii_field(F.col("path")).alias("is_pii"), F.array_join(hints, ", ").alias("hints"))


_CUSTOM = ("customer.*", "charges.*", "order_id")


@query(
    O.with_flat(
        f"""select path, count(*) as n, {O.custom_match('path', 'customer.*')} as below_customer,
 {O.custom_match('path', 'order_id')} as is_order_id, {O.joined(O.hint_list('path', None, _CUSTOM))} as hints
 from flat group by path""",
        "order_docs",
    )
)
def custom_pattern(spark, sf):
    rows = paths_of(spark, sf, "order_docs").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    path = F.col("path")
    return rows.select(
        "path", "n", pii.custom_match(path, "customer.*").alias("below_customer"),
        pii.custom_match(path, "order_id").alias("is_order_id"),
        F.array_join(pii.hints_of(pii.path_hint_mask(path, _CUSTOM), _CUSTOM), ", ").alias("hints"),
    )


def _warning_sql(hints: str) -> str:
    cases = " ".join(f"when '{h}' then '{w}'" for h, w in pii.WARNINGS.items())
    return (
        f"nullif(array_to_string(list_transform({hints}, lambda h: case h {cases} else 'PII: ' || h end), ', '), '')"
    )


@query(
    O.with_flat(
        f"""select warning, count(*) as n from (select {_warning_sql(O.hint_list('path', O.STRING_VALUE))} as warning
 from ({O.FIELD_ROWS}) r) s group by 1""",
        "contact_docs",
    )
)
def pii_warning(spark, sf):
    rows = A.field_rows(paths_of(spark, sf, "contact_docs"))
    value = F.when(F.col("type") == "string", F.col("text"))
    warned = rows.select(pii.pii_warning(pii.detect_pii(F.col("path"), value)).alias("warning"))
    return warned.groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


_SCAN = f"""each as (select collection, doc_id, path, unnest({O.hint_list('path', O.STRING_VALUE)}) as hint from (SOURCE) r),
total as (select collection, count(*) as docs from DOCS group by 1)
select collection, path, hint, count(distinct doc_id) as docs_hit, round(count(distinct doc_id) / any_value(docs), 6) as hit_ratio
from each join total using (collection) group by 1, 2, 3"""


@query(f"with {O.flat('contact_docs', 'order_docs')}, " + _SCAN.replace("SOURCE", O.FIELD_ROWS).replace("DOCS", "flat_docs"))
def pii_scan(spark, sf):
    names = ("contact_docs", "order_docs")
    found = A.pii_scan(paths_of(spark, sf, *names), A.document_counts(documents(spark, sf, *names)), OPTIONS)
    return found.select("collection", "path", "hint", "docs_hit", R6("hit_ratio").alias("hit_ratio"))


_LONG = """long as (select 'conversations' as collection, conv_id * 1000 + turn as doc_id, unnest(['who', 'says', 'reply', 'text', 'role']) as path,
 unnest([case when turn % 3 = 0 then role || conv_id || '@mail.example.org' else role end, '192.168.' || (conv_id % 256) || '.' || (turn % 256),
 'm' || turn, text, role]) as text, 'string' as type from conversations
 union all select 'documents', doc_id, unnest(['text', 'lang', 'source']), unnest([text, lang, source]), 'string' from documents),
docs as (select 'conversations' as collection from conversations union all select 'documents' from documents)"""


@query(f"with {_LONG}, " + _SCAN.replace("SOURCE", "long").replace("DOCS", "docs"))
def pii_scan_documents(spark, sf):
    """Turns of conversations, with addresses in some of them, and whole documents, as typed tables."""
    turns = spread_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("number"),
        F.when(F.col("turn") % 3 == 0, F.concat("role", "conv_id", F.lit("@mail.example.org"))).otherwise(F.col("role")).alias("who"),
        F.concat(F.lit("192.168."), F.col("conv_id") % 256, F.lit("."), F.col("turn") % 256).alias("says"),
        F.concat(F.lit("m"), "turn").alias("reply"),
        "text",
        "role",
    )
    texts = spread_table(spark, sf, "documents")
    paths = A.merge_paths(flatten_table(turns, "conversations", "number"), flatten_table(texts, "documents", "doc_id"))
    totals = table_totals(turns, "conversations").unionByName(table_totals(texts, "documents"))
    return A.pii_scan(paths, totals, OPTIONS).select("collection", "path", "hint", "docs_hit", R6("hit_ratio").alias("hit_ratio"))


@query(f"with {O.flat('contact_docs')}, {O.fields()}, {O.field_hints()} select path, hints from fh_text")
def field_hints(spark, sf):
    rows = A.field_hints(paths_of(spark, sf, "contact_docs", strings=True), OPTIONS).where(F.size("hints") > 0)
    return rows.select("path", F.array_join("hints", ", ").alias("hints"))


@query(
    f"""with {O.flat('contact_docs', 'mixed_docs', 'order_docs')}, {O.fields()}, {O.field_hints()}
select collection, array_to_string(list(path order by {O.path_key('path')}, path), ', ') as paths, count(*) as pii_field_count
from fh_text group by 1"""
)
def pii_fields(spark, sf):
    names = ("contact_docs", "mixed_docs", "order_docs")
    found = A.pii_fields(A.field_hints(paths_of(spark, sf, *names, strings=True), OPTIONS))
    return found.select("collection", F.array_join("paths", ", ").alias("paths"), "pii_field_count")


@query(
    O.with_flat(
        f"""select doc_id, path, {O.joined('list_distinct_in_order')} as hints from (select *,
 list_concat({O.hint_list('path', None)}, list_filter({O.hint_list("'x'", O.STRING_VALUE)},
 lambda h: not list_contains({O.hint_list('path', None)}, h))) as list_distinct_in_order from ({O.FIELD_ROWS}) r) s""",
        "contact_docs",
    )
)
def hint_union(spark, sf):
    rows = A.field_rows(paths_of(spark, sf, "contact_docs"))
    value = F.when(F.col("type") == "string", F.col("text"))
    by_name = pii.hints_of(pii.path_hint_mask(F.col("path")))
    by_value = pii.hints_of(pii.value_hint_mask(value))
    return rows.select("doc_id", "path", F.array_join(F.array_distinct(F.concat(by_name, by_value)), ", ").alias("hints"))


# --- masks -------------------------------------------------------------------------------------


@query(f"select p_partkey, {O.mask_string('p_name')} as masked, {O.mask_string('p_brand')} as brand from part")
def mask_string_balanced(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", masks.mask_string(F.col("p_name")).alias("masked"), masks.mask_string(F.col("p_brand")).alias("brand")
    )


@query(f"select doc_id, {O.mask_string('text', strict=True)} as masked, {O.mask_string('lang', strict=True)} as lang from documents")
def mask_string_strict(spark, sf):
    return spread_table(spark, sf, "documents").select(
        "doc_id", masks.mask_string(F.col("text"), "strict").alias("masked"), masks.mask_string(F.col("lang"), "strict").alias("lang")
    )


def _by_path(path: str, expression: str) -> str:
    return O.with_flat(f"select doc_id, {expression} as masked from flat where path = '{path}' and type <> 'null'", "contact_docs")


def _values(spark, sf, path):
    return paths_of(spark, sf, "contact_docs").where((F.col("path") == path) & (F.col("type") != "null"))


@query(_by_path("email", O.mask_email("text")))
def mask_email(spark, sf):
    return _values(spark, sf, "email").select("doc_id", masks.mask_email(F.col("text")).alias("masked"))


@query(_by_path("phone", O.mask_phone("text")))
def mask_phone(spark, sf):
    return _values(spark, sf, "phone").select("doc_id", masks.mask_phone(F.col("text")).alias("masked"))


@query(_by_path("score", O.mask_number("text")))
def mask_number(spark, sf):
    return _values(spark, sf, "score").select("doc_id", masks.mask_number(F.col("text")).alias("masked"))


@query(
    f"""with {O.flat('contact_docs', 'order_docs')}, hinted as (select *, {O.hint_list('path', O.STRING_VALUE)} as hints from flat)
select collection, doc_id, path, type, {O.masked('hints')} as masked from hinted"""
)
def mask_value(spark, sf):
    rows = paths_of(spark, sf, "contact_docs", "order_docs")
    value = F.when(F.col("type") == "string", F.col("text"))
    rows = rows.withColumn("value_mask", pii.value_hint_mask(value))
    # Only two hints matter here, so two patterns replace the whole name list.
    email, phone = (
        pii.name_suggests(F.col("path"), hint) | pii.has_hint(F.col("value_mask"), hint) for hint in ("email", "phone")
    )
    shown = masks.mask_value(F.col("type"), F.col("text"), F.col("size"), email, phone)
    return rows.select("collection", "doc_id", "path", "type", shown.alias("masked"))


@query(
    f"""with {O.flat('contact_docs')}, {O.rendered()} select doc_id, path, shown, len(hints) > 0 as should_mask from rendered"""
)
def should_mask(spark, sf):
    rows = A.rendered_rows(paths_of(spark, sf, "contact_docs"), OPTIONS)
    hit = pii.is_pii_field(F.col("path")) | (F.col("value_mask") != 0)
    return rows.select("doc_id", "path", F.col("rendered").alias("shown"), masks.should_mask("pii", hit).alias("should_mask"))


@query(
    f"""select c_custkey, {O.mask_string('c_name')} as c_name, c_nationkey, c_acctbal, c_mktsegment from customer"""
)
def mask_table(spark, sf):
    return masks.mask_table(table(spark, sf, "customer"), OPTIONS)


# --- text --------------------------------------------------------------------------------------


def _redact_sql(x: str) -> str:
    patterns = [
        r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        r"\+?\d{1,4}[-.\s]?\(?\d{1,3}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
        r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b",
        r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
        r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
    ]
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x


@query(f"select doc_id, {_redact_sql('text')} as redacted from documents")
def redact_text_documents(spark, sf):
    return spread_table(spark, sf, "documents").select("doc_id", X.redact_text(F.col("text")).alias("redacted"))


@query(f"select conv_id, turn, role, {_redact_sql('text')} as redacted from conversations")
def redact_text_conversations(spark, sf):
    return spread_table(spark, sf, "conversations").select("conv_id", "turn", "role", X.redact_text(F.col("text")).alias("redacted"))


@query(f"select page_id, {_redact_sql('html')} as redacted from pages")
def redact_text_pages(spark, sf):
    return spread_table(spark, sf, "pages").select("page_id", X.redact_text(F.col("html")).alias("redacted"))


@query(
    r"""select page_id, regexp_replace(replace(url, '://', '://user' || page_id || ':pw@'), '//[^:]+:[^@]+@', '//***:***@') as uri,
 regexp_replace(url, '//[^:]+:[^@]+@', '//***:***@') as url from pages"""
)
def redact_uri_credentials(spark, sf):
    pages = spread_table(spark, sf, "pages")
    uri = F.replace("url", F.lit("://"), F.concat(F.lit("://user"), F.col("page_id").cast("string"), F.lit(":pw@")))
    return pages.select(
        "page_id", X.redact_uri_credentials(uri).alias("uri"), X.redact_uri_credentials(F.col("url")).alias("url")
    )


# --- nothing is cut off --------------------------------------------------------------------------


_SUPPLIED = """select l_suppkey as doc_id, to_json(struct(collect_list(struct(l_linenumber as line, l_orderkey as number,
 concat('part', l_partkey, '@parts.example.com') as contact)) as lines)) as j from {lineitem} group by l_suppkey"""


def _supplied(spark, sf):
    """A document per supplier, with an element for each of its thousands of order lines."""
    return documents_from_json(spark.sql(_SUPPLIED, lineitem=table(spark, sf, "lineitem")), "supplied", "doc_id", "j")


@query(
    """select 'lines' as path, 'array' as type, count(distinct l_suppkey) as n from lineitem
 union all select 'lines.[*]', 'object', count(*) from lineitem
 union all select 'lines.[*].line', 'int', count(*) from lineitem union all select 'lines.[*].number', 'int', count(*) from lineitem
 union all select 'lines.[*].contact', 'string', count(*) from lineitem"""
)
def long_arrays(spark, sf):
    rows = flatten_documents(_supplied(spark, sf), OPTIONS)
    return rows.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select 'lines.[*].contact' as path, 'email' as hint, count(distinct l_suppkey) as docs_hit from lineitem"""
)
def pii_in_long_arrays(spark, sf):
    docs = _supplied(spark, sf)
    found = A.pii_scan(flatten_documents(docs, OPTIONS), A.document_counts(docs), OPTIONS)
    return found.select("path", "hint", "docs_hit")


@query(
    """select o_orderkey as doc_id, array_to_string(list_transform(range(1, n + 1), lambda i: 'a'), '.') as path,
 case when n = 12 then 'int' else 'object' end as type from orders, range(1, 13) r(n)"""
)
def deep_documents(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit('{"a":' * 12), "o_orderkey", F.lit("}" * 12)).alias("j"))
    return flatten_documents(documents_from_json(rows, "deep", "o_orderkey", "j"), OPTIONS).select("doc_id", "path", "type")


@query(
    """select o_orderkey as doc_id, 'a' as path, 'int' as type, cast(o_custkey as varchar) as text from orders
 union all select o_orderkey, 'b', 'string', 'last' from orders"""
)
def duplicate_members(spark, sf):
    text = F.concat(F.lit('{"a":"first","b":1,"a":'), "o_custkey", F.lit(',"b":"last"}'))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("j"))
    return flatten_documents(documents_from_json(rows, "doubled", "o_orderkey", "j"), OPTIONS).select("doc_id", "path", "type", "text")


def _broken(spark, sf):
    """Every fifth document is cut short, every seventh has no member `a`."""
    whole = F.when(F.col("o_orderkey") % 7 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"a":'), "o_custkey", F.lit("}")))
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit('{"a":')).otherwise(whole)
    return documents_from_json(table(spark, sf, "orders").select("o_orderkey", text.alias("j")), "broken", "o_orderkey", "j")


@query(
    """select 'broken' as collection, count(*) filter (where o_orderkey % 5 = 0) as rejected, count(*) as documents,
 count(*) filter (where o_orderkey % 5 <> 0) as profiled,
 count(*) filter (where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0) as present from orders"""
)
def rejected_documents_query(spark, sf):
    docs = _broken(spark, sf)
    present = A.field_presence(flatten_documents(docs, OPTIONS), A.document_counts(docs), OPTIONS)
    counted = rejected_documents(docs).join(A.document_counts(docs).withColumnRenamed("docs", "profiled"), "collection")
    return counted.join(present.select("collection", F.col("present_count").alias("present")), "collection")


@query(
    """select case when o_orderkey % 7 = 0 then '' else 'a' end as paths, count(*) as count,
 row_number() over (order by count(*) desc) as rank from orders where o_orderkey % 5 <> 0 group by 1"""
)
def variants_without_rejected(spark, sf):
    found = V.variant_analysis(_broken(spark, sf), OPTIONS)
    return found.select(F.array_join("paths", "|").alias("paths"), "count", F.col("rank").cast("bigint").alias("rank"))


@query(
    """select 'conversations' as collection, conv_id as doc_id, count(*) as documents from conversations
 group by conv_id having count(*) > 1"""
)
def duplicate_ids_query(spark, sf):
    return duplicate_ids(documents_from_table(spread_table(spark, sf, "conversations"), "conversations", "conv_id"))


@query(
    """select 'number' as path, count(*) as present_count, cast(0 as bigint) as absent_count from orders
 union all select 'lines', count(*), cast(0 as bigint) from orders
 union all select 'lines.[*].quantity', count(distinct l_orderkey), (select count(*) from orders) - count(distinct l_orderkey) from lineitem"""
)
def read_json_documents(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("quantity"))).alias("lines"))
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stored = f"{shared_folder(spark)}/read-json-{uuid.uuid4().hex}"
    none = F.array().cast("array<struct<quantity:double>>")
    orders.select(F.col("o_orderkey").alias("number"), F.coalesce("lines", none).alias("lines")).write.json(stored)
    docs = read_documents(spark, stored, "orders")
    rows = A.field_presence(flatten_documents(docs, OPTIONS), A.document_counts(docs), OPTIONS)
    return rows.select("path", "present_count", "absent_count")


@query(
    """select path, type, n from (select 'doc_id' as path, 'int' as type, count(doc_id) as n from documents
 union all select 'text', 'string', count(text) from documents union all select 'lang', 'string', count(lang) from documents
 union all select 'source', 'string', count(source) from documents union all select 'n_chars', 'int', count(n_chars) from documents) s"""
)
def read_typed_table(spark, sf):
    docs = documents_from_table(spread_table(spark, sf, "documents"), "documents", "doc_id")
    return A.type_distribution(flatten_documents(docs, OPTIONS)).select("path", "type", "n")
