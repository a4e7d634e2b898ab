"""Samples, catalog, relations between profiles, description tables and reports."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from docstrata.functions import paths as P
from docstrata.functions import text as X
from docstrata.operators import describe as D
from docstrata.operators import drift as R
from docstrata.operators import fields as A
from docstrata.operators import relate as K
from docstrata.operators import reports as T
from docstrata.operators import sampling as S
from docstrata.operators import tree as N
from docstrata.operators import variants as V
from docstrata.operators.flatten import flatten_documents, look
from docstrata.plans.run import profile_documents, write_profile
from docstrata.session import cut_lineage, shared_folder
from docstrata.sources import readers, store
from docstrata.sources.fixtures import TABLES, fixture, spread_table, table
from workload import oracle as O
from workload.registry import OPTIONS, documents, paths_of, query

AS_OF = dt.datetime(2024, 1, 31)


def profile(spark, sf, *names, examples=False, options=OPTIONS):
    """A profile stored once: one row per field, read several times by what follows."""
    docs = documents(spark, sf, *names)
    return cut_lineage(A.profile_collection(flatten_documents(docs, options), A.document_counts(docs), options, examples))


# --- samples and filters -----------------------------------------------------------------------


@query("select event_id, user_id, event_type from events order by md5('7:' || event_id), event_id limit 100")
def random_sample(spark, sf):
    return S.random_sample(table(spark, sf, "events"), 100, "event_id", "7").select("event_id", "user_id", "event_type")


@query(
    f"""with {O.flat('mixed_docs', 'contact_docs', 'order_docs')}
select collection, doc_id from flat_docs qualify row_number() over (partition by collection order by md5('7:' || doc_id), doc_id) <= 20"""
)
def per_collection_sample(spark, sf):
    docs = documents(spark, sf, "mixed_docs", "contact_docs", "order_docs").select("collection", "doc_id")
    return S.per_collection_sample(docs, 20, seed="7")


@query(
    """select event_id, event_type, 'random' as strategy, true as fallback from events
order by md5('7:' || event_id), event_id limit 50"""
)
def sample_with_fallback(spark, sf):
    rows = S.sample_with_fallback(
        table(spark, sf, "events"), 50, "event_id", "7", condition="event_type = 'no such type'", time_field="ts",
        time_window_days=7, as_of=AS_OF,
    )
    return rows.select("event_id", "event_type", "strategy", "fallback")


@query("select event_id, event_type, user_id from events where ts >= timestamp '2024-01-31' - interval 7 day")
def time_window_filter(spark, sf):
    return table(spark, sf, "events").where(S.time_window("ts", 7, AS_OF)).select("event_id", "event_type", "user_id")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) >= 50")
def match_filter(spark, sf):
    docs = fixture(spark, sf, "event_props").where(S.match("try_variant_get(v, '$.k', 'bigint') >= 50"))
    return docs.select(F.col("doc_id").alias("event_id"), F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"))


@query(
    """select event_id, event_type, 'filtered' as strategy, false as fallback from events
where ts >= timestamp '2024-01-31' - interval 14 day and event_type = 'purchase'
order by md5('7:' || event_id), event_id limit 200"""
)
def conjunctive_filter(spark, sf):
    rows = S.sample_with_fallback(
        table(spark, sf, "events"), 200, "event_id", "7", time_field="ts", time_window_days=14,
        condition=F.col("event_type") == "purchase", as_of=AS_OF,
    )
    return rows.select("event_id", "event_type", "strategy", "fallback")


# --- catalog -----------------------------------------------------------------------------------


def _counts(names) -> str:
    return " union all ".join(f"select '{n}' as collection, count(*) as est_count from {n}" for n in names)


@query(_counts(TABLES))
def catalog_scan(spark, sf):
    return readers.catalog_scan({n: table(spark, sf, n) for n in TABLES})


@query(_counts(["conversations", "customer", "orders", "pages"]))
def filter_collections(spark, sf):
    catalog = readers.catalog_scan({n: table(spark, sf, n) for n in TABLES})
    return readers.filter_collections(catalog, include="{c,o,p}*s*", exclude="part?").where("collection <> 'none'")


@query("select count(*) as est_count from lineitem")
def estimated_count(spark, sf):
    return readers.catalog_scan({"lineitem": table(spark, sf, "lineitem")}).select("est_count")


def _key_sql(source: str, name: str, columns: list[str]) -> str:
    values = ", ".join(columns)
    present = " and ".join(f"{c} is not null" for c in columns)
    keys = ", ".join(f"{c}: 1" for c in columns)
    return f"""select '{name}' as name, '{keys}' as keys, cast(sum(n) as bigint) as rows, count(*) as distinct_values,
 max(n) = 1 as "unique" from (select {values}, count(*) as n from {source} where {present} group by {values}) s"""


@query(
    " union all ".join(
        [
            _key_sql("lineitem", "order_line", ["l_orderkey", "l_linenumber"]),
            _key_sql("lineitem", "part_supplier", ["l_partkey", "l_suppkey"]),
            _key_sql("lineitem", "order_part_line", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]),
        ]
    )
)
def key_profile(spark, sf):
    keys = {
        "order_line": ["l_orderkey", "l_linenumber"],
        "part_supplier": ["l_partkey", "l_suppkey"],
        "order_part_line": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    }
    found = readers.key_profile(table(spark, sf, "lineitem"), keys)
    return found.select("name", "keys", "rows", "distinct_values", "unique")


@query(
    f"""with {O.flat('mixed_docs', 'contact_docs', 'order_docs')},
entries as (select distinct collection, path || ':' || type as entry from ({O.FIELD_ROWS}) r),
buckets as (select collection, left(sha256(entry), 3) as bucket, sha256(string_agg(entry, '|' order by entry)) as digest
 from entries group by 1, 2)
select collection, sha256(string_agg(digest, '|' order by bucket)) as fingerprint from buckets group by 1"""
)
def schema_fingerprint(spark, sf):
    return R.schema_fingerprint(A.type_distribution(paths_of(spark, sf, "mixed_docs", "contact_docs", "order_docs")))


# --- relations ---------------------------------------------------------------------------------

_ALL = ("mixed_docs", "contact_docs", "order_docs")
_FIELDS = f"with {O.flat(*_ALL)}, names as (select distinct collection, path from ({O.FIELD_ROWS}) r)"


def _field_names(spark, sf, *names):
    return cut_lineage(A.field_names(documents(spark, sf, *names)))


def _fields(spark, sf):
    return _field_names(spark, sf, *_ALL)


_CANDIDATES = f"""cands as (select collection || '.' || path as candidate, {O.last_segment('path')} as name from names
 where regexp_matches({O.last_segment('path')}, '(?i)(?:Id|_id|Uuid)$'))"""


@query(f"{_FIELDS}, {_CANDIDATES} select candidate from cands")
def fk_candidates(spark, sf):
    return K.fk_candidates(_fields(spark, sf)).select("candidate")


@query(
    f"""{_FIELDS}, {_CANDIDATES}
select n.collection, n.path, coalesce(string_agg(c.candidate, ', ' order by c.candidate), '') as context from names n
left join cands c on contains(lower({O.last_segment('n.path')}), lower(c.name)) or contains(lower(c.name), lower({O.last_segment('n.path')}))
group by 1, 2"""
)
def fk_context(spark, sf):
    fields = _fields(spark, sf)
    found = K.fk_context(fields, K.fk_candidates(fields))
    return found.select("collection", "path", F.array_join("context", ", ").alias("context"))


# --- earlier and later profiles ----------------------------------------------------------------

# The earlier profile describes an older version of the same documents.
_BEFORE_AFTER = (
    f"with {O.flat('events_v1', name='old', label='events')}, {O.flat('mixed_docs', name='flat', label='events')}"
)


def _relabel(docs, name="events"):
    return docs.withColumn("collection", F.lit(name))


def _versions(spark, sf):
    old, new = _relabel(fixture(spark, sf, "events_v1")), _relabel(fixture(spark, sf, "mixed_docs"))
    return old, new


def _types(docs):
    return A.type_distribution(flatten_documents(docs, OPTIONS))


def _descriptions(docs):
    rows = _types(docs).select("collection", "path").distinct()
    return rows.withColumn("description", F.concat(F.lit("About "), F.col("path")))


@query(
    f"""{_BEFORE_AFTER},
b as (select collection, path, string_agg(distinct type, ', ' order by type) as before from old where path not like '%.[*]' group by 1, 2),
a as (select collection, path, string_agg(distinct type, ', ' order by type) as after from flat where path not like '%.[*]' group by 1, 2)
select collection, path, before, after, case when before is null then 'added' when after is null then 'removed' else 'type-changed' end as status
from b full join a using (collection, path) where before is distinct from after"""
)
def schema_drift(spark, sf):
    old, new = _versions(spark, sf)
    return R.schema_drift(_types(old), _types(new))


def _entries(name: str, *sources: tuple[str, str]) -> str:
    """CTEs: the set of path:type entries of every collection, as one text per collection."""
    flats = ", ".join(O.flat(f, name=f"{name}{i}", label=label) for i, (f, label) in enumerate(sources))
    union = " union all ".join(f"select collection, path, type from {name}{i}" for i in range(len(sources)))
    return f"""{flats}, {name} as (select collection, string_agg(distinct path || ':' || type, '|' order by path || ':' || type) as entries
 from ({union}) u where path not like '%.[*]' group by 1)"""


@query(
    f"""with {_entries('b', ('events_v1', 'events'), ('contact_docs', 'contact_docs'), ('deep_docs', 'deep_docs'))},
{_entries('a', ('mixed_docs', 'events'), ('contact_docs', 'contact_docs'), ('event_props', 'event_props'))}
select collection, case when b.entries is null then 'added' when a.entries is null then 'removed'
 when a.entries <> b.entries then 'changed' else 'same' end as status from b full join a using (collection)"""
)
def changed_collections(spark, sf):
    old, new = _versions(spark, sf)
    contacts, deep, props = (fixture(spark, sf, n) for n in ("contact_docs", "deep_docs", "event_props"))
    before = R.schema_fingerprint(_types(old.unionByName(contacts).unionByName(deep)))
    after = R.schema_fingerprint(_types(new.unionByName(contacts).unionByName(props)))
    return R.changed_collections(before, after)


@query(
    f"""{_BEFORE_AFTER}, prev as (select distinct collection, path, 'About ' || path as description from old)
select n.collection, n.path, p.description from (select distinct collection, path from flat) n left join prev p using (collection, path)"""
)
def carry_descriptions(spark, sf):
    old, new = _versions(spark, sf)
    return R.carry_descriptions(_types(new).select("collection", "path").distinct(), _descriptions(old))


@query(
    f"""with {O.flat('events_v1', name='old', label='events')}, {O.flat('mixed_docs', name='flat', label='events')}, {O.fields()}
select collection, path from fields where path not in (select path from old)"""
)
def fields_needing_description(spark, sf):
    old, new = _versions(spark, sf)
    fields = A.field_presence(flatten_documents(new, OPTIONS), A.document_counts(new), OPTIONS)
    return R.fields_needing_description(D.top_fields_by_presence(fields, 10), _descriptions(old)).select("collection", "path")


@query(
    f"""with {O.flat('contact_docs', 'order_docs')}, {O.fields()}
select collection, path, round(present_ratio, 6) as present_ratio from fields
qualify row_number() over (partition by collection order by present_ratio desc, {O.path_key('path')}, path) <= 5"""
)
def top_fields_by_presence(spark, sf):
    docs = documents(spark, sf, "contact_docs", "order_docs")
    seen = look(docs, OPTIONS, counted=True)
    fields = A.field_presence(flatten_documents(docs, OPTIONS, seen=seen), seen.totals, OPTIONS)
    return D.top_fields_by_presence(fields, 5).select("collection", "path", F.round("present_ratio", 6).alias("present_ratio"))


@query(
    f"""with {O.flat('order_docs')}, names as (select distinct collection, path from flat where path not like '%.[*]')
select collection, path, 'Said of ' || replace(path, '.[*].', '.*.') as description from names"""
)
def apply_descriptions(spark, sf):
    fields = _field_names(spark, sf, "order_docs")
    loose = F.replace("path", F.lit(".[*]."), F.lit(".*."))
    older = fields.select("collection", "path", F.lit("older").alias("description"), F.lit(1).alias("seq"))
    newer = fields.select("collection", loose.alias("path"), F.concat(F.lit("Said of "), loose).alias("description"), F.lit(2).alias("seq"))
    return D.apply_descriptions(fields, older.unionByName(newer))


_INPUT_TEXT = f"""{O.fields()}, {O.rendered()}, {O.examples()},
inputs as (select f.collection, f.path,
 array_to_string(list_transform(list_zip(f.type_list, f.n_list), lambda z: z[1] || '(' || cast(round(z[2] / f.occurrences * 100) as bigint) || '%)'), ', ') as types,
 {O.percent('f.present_ratio')} as presence, array_to_string(e.shown_list[1:3], ', ') as examples
 from fields f left join ex_list e using (collection, path))"""


def _inputs(spark, sf, *names):
    fields = profile(spark, sf, *names, examples=True)
    return D.description_inputs(fields, K.fk_context(fields, K.fk_candidates(fields)))


@query(
    f"""with {O.flat('contact_docs')}, {_INPUT_TEXT}, names as (select collection, path from inputs), {_CANDIDATES}
select i.collection, i.path, i.types, i.presence, i.examples, coalesce(string_agg(c.candidate, ', ' order by c.candidate), '') as fk_context
from inputs i left join cands c on contains(lower({O.last_segment('i.path')}), lower(c.name)) or contains(lower(c.name), lower({O.last_segment('i.path')}))
group by 1, 2, 3, 4, 5"""
)
def description_inputs(spark, sf):
    return _inputs(spark, sf, "contact_docs")


def _queue_key(x: str) -> str:
    members = ", ".join(f"'\"{c}\":\"' || {x}.{c} || '\"'" for c in ("collection", "path", "presence", "types"))
    return f"sha256('{{' || concat_ws(',', {members}) || '}}')"


@query(
    f"""with {O.flat('events_v1', name='old', label='events')}, {O.flat('mixed_docs', name='flat', label='events')},
{O.fields()}, {O.fields('oldf', 'old', 'old_docs')},
said as (select collection, path, {O.percent('present_ratio')} as presence, type_list[1] as types from fields),
done as (select collection, path, {O.percent('present_ratio')} as presence, type_list[1] as types from oldf)
select s.collection, s.path, {_queue_key('s')} as key from said s where {_queue_key('s')} not in (select {_queue_key('d')} from done d)"""
)
def description_work_queue(spark, sf):
    def inputs(docs):
        fields = A.profile_collection(flatten_documents(docs, OPTIONS), A.document_counts(docs), OPTIONS, examples=False)
        return fields.select("collection", "path", X.percent(F.col("present_ratio")).alias("presence"), D.first_type().alias("types"))

    old, new = _versions(spark, sf)
    before = inputs(old)
    answers = before.select(D.input_key(before.columns).alias("key"))
    return D.description_work_queue(inputs(new), answers).select("collection", "path", "key")


@query(
    """select distinct event_type || '-' || user_id || '-' || event_id % 97 as collection, 'Preserved from previous run' as warnings from events
where event_id < (select max(event_id) from events) / 2 and event_type || '-' || user_id || '-' || event_id % 97 not in
 (select event_type || '-' || user_id || '-' || event_id % 97 from events where event_id >= (select max(event_id) from events) / 2)"""
)
def removed_collections(spark, sf):
    """A collection per event type, user and remainder; the earlier run saw the first half of the events, this one the second."""
    events = table(spark, sf, "events").select("event_id", F.concat_ws("-", "event_type", "user_id", F.col("event_id") % 97).alias("collection"))
    late = F.col("event_id") >= F.col("last") / 2
    events = events.join(F.broadcast(events.agg(F.max("event_id").alias("last"))))
    current, previous = events.where(late).select("collection"), events.where(~late).select("collection")
    return R.removed_collections(current, previous).select("collection", F.array_join("warnings", ", ").alias("warnings"))


# --- summaries ---------------------------------------------------------------------------------


@query(
    f"""with {O.flat(*_ALL)}, {O.fields()}
select collection, type_list[1] as type, count(*) as field_count from fields group by 1, 2"""
)
def type_summary(spark, sf):
    return D.type_summary(profile(spark, sf, *_ALL))


@query(
    f"""with {O.flat('contact_docs', 'order_docs')}, {O.fields()},
kinds as (select collection, type_list[1] as type, count(*) as n from fields group by 1, 2),
summary as (select collection, string_agg(type || ':' || n, ', ' order by type || ':' || n) as type_summary, cast(sum(n) as bigint) as field_count
 from kinds group by 1),
firsts as (select collection, path, row_number() over (partition by collection order by {O.path_key('path')}, path) as r from fields)
select s.collection, s.field_count, t.docs as sample_count, string_agg(f.path, ', ' order by f.r) as first_paths, s.type_summary
from summary s join fields_totals t using (collection) join firsts f using (collection) where f.r <= 20 group by 1, 2, 3, 5"""
)
def summary_inputs(spark, sf):
    totals = A.document_counts(documents(spark, sf, "contact_docs", "order_docs"))
    fields = profile(spark, sf, "contact_docs", "order_docs")
    found = D.summary_inputs(fields, totals)
    return found.select(
        "collection", "field_count", "sample_count", F.array_join("first_paths", ", ").alias("first_paths"),
        F.array_join("type_summary", ", ").alias("type_summary"),
    )


@query(
    f"""with {O.flat('events_v1', name='old', label='events')}, {O.flat('mixed_docs', name='flat', label='events')}
select collection, path, coalesce('About ' || any_value(o), path || ' 필드이다.') as description
from (select distinct f.collection, f.path, o.path as o from flat f left join (select distinct path from old) o using (path)) s group by 1, 2"""
)
def default_descriptions(spark, sf):
    old, new = _versions(spark, sf)
    carried = R.carry_descriptions(_types(new).select("collection", "path").distinct(), _descriptions(old))
    return D.default_descriptions(carried)


@query(
    f"""with {O.flat(*_ALL)}, {O.fields()}
select collection, collection || ' 컬렉션이다. ' || count(*) || '개의 필드로 구성되어 있다.' as summary from fields group by 1"""
)
def default_summaries(spark, sf):
    docs = documents(spark, sf, *_ALL)
    # a summary needs no numbers, hints or examples: only types in the order of their first occurrence
    counts = A.type_counts(flatten_documents(docs, OPTIONS))
    listed = F.array_sort(F.collect_list(F.struct("first", "type"))).alias("types")
    fields = cut_lineage(counts.groupBy("collection", "path").agg(listed))
    return D.default_summaries(D.summary_inputs(fields, A.document_counts(docs)))


@query(
    f"""with {O.flat(*_ALL)}, {O.fields()}, {O.field_hints()}, {O.shapes('')},
f as (select collection, count(*) as fields from fields group by 1), v as (select collection, count(*) as variants from top group by 1),
w as (select collection, count(*) as hits from fh_text group by 1)
select t.collection, case when t.docs >= 1000 then '~' || cast(round(t.docs / 1000) as bigint) || 'K' else '~' || t.docs end as documents,
 t.docs as sampled, f.fields, v.variants, case when w.hits > 0 then 'PII detected' else '-' end as warnings
from fields_totals t join f using (collection) join v using (collection) left join w using (collection)"""
)
def collection_overview(spark, sf):
    docs = documents(spark, sf, *_ALL)
    totals = A.document_counts(docs)
    fields = profile(spark, sf, *_ALL)
    hits = A.pii_fields(fields).select("collection", "pii_field_count")
    run = totals.select("collection", F.col("docs").alias("sampled"), F.lit(False).alias("fallback"))
    warnings = A.collection_warnings(run.join(hits, "collection", "left"))
    catalog = totals.withColumnRenamed("docs", "est_count")
    return T.collection_overview(totals, fields, V.variant_analysis(docs, OPTIONS), warnings, catalog)


@query(
    f"""with {O.flat('event_props', 'contact_docs')}, {O.fields()}, {O.field_hints()}
select t.collection, concat_ws(', ', case when t.collection = 'event_props' then 'Fallback to random sampling' end,
 case when count(h.path) > 0 then 'PII detected' end) as warnings
from fields_totals t left join fh_text h using (collection) group by 1
union all select 'empty_docs', 'Empty collection'"""
)
def collection_warnings(spark, sf):
    docs = documents(spark, sf, "event_props", "contact_docs")
    hits = A.pii_fields(A.field_hints(flatten_documents(docs, OPTIONS, strings=True), OPTIONS)).select("collection", "pii_field_count")
    totals = A.document_counts(docs)
    none = totals.where("collection = 'event_props'").select(F.lit("empty_docs").alias("collection"), F.lit(0).cast("bigint").alias("docs"))
    run = totals.unionByName(none).select(
        "collection", F.col("docs").alias("sampled"), (F.col("collection") == "event_props").alias("fallback")
    )
    found = A.collection_warnings(run.join(hits, "collection", "left"))
    return found.select("collection", F.array_join("warnings", ", ").alias("warnings"))


@query(
    f"""with {O.flat('contact_docs', 'mixed_docs')}
select collection, count(*) as docs, case when collection = 'contact_docs' then (select count(*) from customer) else 0 end as est_count,
 case when collection = 'contact_docs' then 2 else 0 end as key_count from flat_docs group by 1"""
)
def attach_catalog(spark, sf):
    totals = A.document_counts(documents(spark, sf, "contact_docs", "mixed_docs"))
    customer = table(spark, sf, "customer")
    catalog = readers.catalog_scan({"contact_docs": customer, "unused": table(spark, sf, "nation")})
    keys = readers.key_profile(customer, {"id": ["c_custkey"], "name": ["c_name"]})
    return R.attach_catalog(totals, catalog, keys.withColumn("collection", F.lit("contact_docs")))


# --- field tree and reports --------------------------------------------------------------------

_NODES = f"""names as (select distinct collection, path from ({O.FIELD_ROWS}) r),
segs as (select collection, path, list_filter(string_split(path, '.'), lambda s: s <> '[*]') as segs from names),
nodes as (select collection, path as full_path, segs, len(segs) as depth, segs[-1] as segment from segs),
spans as (select n.collection, n.full_path, count(*) as rowspan from nodes n join nodes d
 on d.collection = n.collection and d.segs[1:len(n.segs)] = n.segs group by 1, 2)"""


@query(
    f"""with {O.flat('order_docs', 'contact_docs')}, {_NODES}
select collection, full_path, segment, depth, true as has_field from nodes"""
)
def field_tree(spark, sf):
    tree = N.field_tree(_field_names(spark, sf, "order_docs", "contact_docs"))
    return tree.select("collection", "full_path", "segment", F.col("depth").cast("bigint").alias("depth"), "has_field")


@query(f"with {O.flat('order_docs', 'deep_docs')}, {_NODES} select collection, full_path, rowspan from spans")
def subtree_rows(spark, sf):
    tree = N.field_tree(_field_names(spark, sf, "order_docs", "deep_docs"))
    return tree.select("collection", "full_path", F.col("rowspan").cast("bigint").alias("rowspan"))


@query(
    f"""with {O.flat('order_docs', 'contact_docs')}, {_NODES}
select collection, full_path, row_number() over (partition by collection order by array_to_string(list_transform(segs, lambda s: lower(s)), chr(1)), full_path) as place
from nodes"""
)
def tree_preorder(spark, sf):
    tree = N.field_tree(_field_names(spark, sf, "order_docs", "contact_docs"))
    place = F.row_number().over(Window.partitionBy("collection").orderBy("order_key", "full_path"))
    return N.tree_preorder(tree).select("collection", "full_path", place.cast("bigint").alias("place"))


@query(
    f"""with {O.flat('order_docs', 'contact_docs')}, {O.fields()}, {O.rendered()}, {O.examples()}, {O.field_hints()}, {_NODES},
ratio as (select collection, path, type, n / sum(n) over (partition by collection, path) as r, first from fields_types),
typed as (select collection, path, case when count(*) = 1 then any_value(type) else
 string_agg(type || '(' || cast(round(r * 100) as bigint) || '%)', ', ' order by r desc, first) end as types from ratio group by 1, 2)
select f.collection, f.path, n.segment, n.depth, s.rowspan, max(n.depth) over (partition by f.collection) as max_depth,
 {O.percent('f.present_ratio')} as present, t.types, case when f.optional then 'Yes' else 'No' end as optional,
 array_to_string(e.shown_list[1:3], ', ') as examples, '-' as description,
 coalesce(nullif(concat_ws(' | ', case when f.mixed_type then 'Mixed' end, 'PII: ' || h.hints,
 'min: ' || format('{{:.2f}}', f.lo) || ', max: ' || format('{{:.2f}}', f.hi)), ''), '-') as notes
from fields f join nodes n on n.collection = f.collection and n.full_path = f.path join spans s on s.collection = f.collection and s.full_path = f.path
join typed t on t.collection = f.collection and t.path = f.path left join ex_list e on e.collection = f.collection and e.path = f.path
left join fh_text h on h.collection = f.collection and h.path = f.path"""
)
def field_report(spark, sf):
    report = T.field_report(profile(spark, sf, "order_docs", "contact_docs", examples=True))
    whole = {c: F.col(c).cast("bigint").alias(c) for c in ("depth", "rowspan", "max_depth")}
    return report.select(*[whole.get(c, F.col(c)) for c in report.columns if c != "order_key"])


@query(
    """select 'id' as name, 'c_custkey: 1' as keys, case when count(*) = count(distinct c_custkey) then 'Yes' else 'No' end as "unique",
 'No' as sparse, '-' as ttl from customer
union all select 'rich', 'rich: 1', case when count(rich) = count(distinct rich) then 'Yes' else 'No' end,
 case when count(rich) < count(*) then 'Yes' else 'No' end, '-' from (select case when c_acctbal > 0 then c_custkey end as rich from customer) s
union all select 'segment', 'c_nationkey: 1, c_mktsegment: 1', case when count(*) = count(distinct (c_nationkey, c_mktsegment)) then 'Yes' else 'No' end,
 'No', '-' from customer"""
)
def key_report(spark, sf):
    keys = {"id": ["c_custkey"], "rich": ["rich"], "segment": ["c_nationkey", "c_mktsegment"]}
    rows = table(spark, sf, "customer").withColumn("rich", F.when(F.col("c_acctbal") > 0, F.col("c_custkey")))
    return T.key_report(readers.key_profile(rows, keys))


@query(
    f"""with {O.flat('contact_docs', 'wide_docs')}, {O.shapes('')}
select collection, rank, '#' || rank || case when rank = 1 then ' (primary)' else '' end as variant, {O.percent('ratio')} as ratio,
 case when rank = 1 then '-' else {O.preview(O.diff_text(count_rest=False))} end as diff from diffed"""
)
def variant_report(spark, sf):
    report = T.variant_report(V.variant_analysis(documents(spark, sf, "contact_docs", "wide_docs"), OPTIONS))
    return report.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""with {O.flat('contact_docs', 'deep_docs', 'order_docs')}, {O.fields()}, {O.field_hints()},
p as (select collection, string_agg(path, ', ' order by {O.path_key('path')}, path) as paths from fh_text group by 1),
capped as (select count(*) as n from flat where type = 'array' and size > 2)
select 'options' as section, 1 as position, 'Strategy: all' as line union all select 'options', 2, 'Sample Size: all'
union all select 'options', 3, 'Redaction: pii' union all select 'options', 4, 'Max Depth: 9'
union all select 'collections', 1, 'Collections: ' || count(distinct collection) from flat_docs
union all select 'truncation', 3, 'Arrays truncated: ' || n || ' arrays exceeded sample limit' from capped where n > 0
union all select 'warnings', row_number() over (order by {O.natural_key('collection')}, collection), '[' || collection || '] PII-suspected fields detected: ' || paths from p"""
)
def overview_report(spark, sf):
    docs = documents(spark, sf, "contact_docs", "deep_docs", "order_docs")
    capped = replace(OPTIONS, max_array_sample=2, max_depth=9)
    seen = look(docs, OPTIONS, counted=True)
    truncation = A.truncation_counters(flatten_documents(docs, capped, leaves=False, seen=seen), capped)
    found = A.pii_fields(A.field_hints(flatten_documents(docs, OPTIONS, strings=True, seen=seen), OPTIONS))
    report = T.overview_report(truncation, found, seen.totals, capped)
    return report.withColumn("position", F.col("position").cast("bigint"))


# --- names, paths and short texts --------------------------------------------------------------


@query(f"select p_partkey, p_name, {O.natural_key('p_name')} as sort_key, {O.natural_key('p_brand')} as brand_key from part")
def natural_sort(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", "p_name", P.natural_key(F.col("p_name")).alias("sort_key"), P.natural_key(F.col("p_brand")).alias("brand_key")
    )
    return parts.orderBy("brand_key", "sort_key", "p_partkey")


@query(f"{_FIELDS} select collection, string_agg(path, ' ' order by {O.path_key('path')}, path) as sorted from names group by 1")
def path_sort(spark, sf):
    listed = _fields(spark, sf).groupBy("collection").agg(F.collect_list("path").alias("paths"))
    return listed.select("collection", F.array_join(P.sort_paths(F.col("paths")), " ").alias("sorted"))


_ESC = r"replace(replace(replace({x}, '\', '\\'), '.', '\.'), '$', '\$')"


@query(f"select doc_id, {_ESC.format(x='text')} as escaped from documents")
def escape_key(spark, sf):
    return spread_table(spark, sf, "documents").select("doc_id", P.escape_key(F.col("text")).alias("escaped"))


@query("select doc_id, text as unescaped from documents")
def unescape_key(spark, sf):
    return spread_table(spark, sf, "documents").select("doc_id", P.unescape_key(P.escape_key(F.col("text"))).alias("unescaped"))


@query(
    r"""select page_id, array_to_string(regexp_extract_all(url, '((?:\\.|[^.\\])+)'), '|') as segments,
 len(regexp_extract_all(url, '((?:\\.|[^.\\])+)')) as n from pages"""
)
def split_path(spark, sf):
    segments = P.split_path(F.col("url"))
    return spread_table(spark, sf, "pages").select(
        "page_id", F.array_join(segments, "|").alias("segments"), F.size(segments).cast("bigint").alias("n")
    )


@query("select page_id, array_to_string(list_filter(string_split(url, '/'), lambda s: s <> ''), '.') as joined from pages")
def join_path(spark, sf):
    return spread_table(spark, sf, "pages").select("page_id", P.join_path(F.split("url", "/")).alias("joined"))


@query(
    """select l_orderkey, l_linenumber, case when l_returnflag = 'R' then l_returnflag
 when l_quantity > 40 then '[' || l_returnflag || ']' else '[' || l_linenumber || ']' end as formatted,
 not (l_returnflag = 'R' or l_quantity > 40) as is_index,
 case when not (l_returnflag = 'R' or l_quantity > 40) then cast(l_linenumber as bigint) end as parsed,
 case when l_returnflag = 'R' then l_returnflag when l_quantity > 40 then '[' || l_returnflag || ']' else '[*]' end as normalized
from lineitem"""
)
def array_index_ops(spark, sf):
    """Index segments, plain names and names in brackets."""
    lines = table(spark, sf, "lineitem")
    index = F.when(F.col("l_quantity") > 40, F.concat(F.lit("["), "l_returnflag", F.lit("]"))).otherwise(P.format_array_index(F.col("l_linenumber")))
    index = F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")).otherwise(index)
    return lines.select(
        "l_orderkey", "l_linenumber", index.alias("formatted"), P.is_array_index(index).alias("is_index"),
        P.parse_array_index(index).alias("parsed"), P.normalize_array_index(index).alias("normalized"),
    )


@query("select doc_id, sha256(text) as sha256, left(sha256(text), 8) as short_hash from documents")
def short_hash(spark, sf):
    digest = F.sha2("text", 256)
    return spread_table(spark, sf, "documents").select("doc_id", digest.alias("sha256"), F.left(digest, F.lit(8)).alias("short_hash"))


@query(
    f"""with {O.flat('contact_docs', 'deep_docs')}, {O.shapes('')}
select collection, signature, {O.diff_text()} as diff, {O.diff_text(count_rest=False)} as short_diff from diffed"""
)
def format_diff(spark, sf):
    top = V.variant_diff(V.top_variants(V.shapes(documents(spark, sf, "contact_docs", "deep_docs")), OPTIONS.variant_top))
    added, missing = F.col("added"), F.col("missing")
    return top.select(
        "collection", "signature", X.format_diff(added, missing).alias("diff"), X.format_diff(added, missing, False).alias("short_diff")
    )


@query(f"select doc_id, {O.preview('text')} as preview from documents")
def preview_text(spark, sf):
    return spread_table(spark, sf, "documents").select("doc_id", X.preview_text(F.col("text")).alias("preview"))


@query(
    f"""select lang, case when sum(n_chars) >= 1000 then '~' || cast(round(sum(n_chars) / 1000) as bigint) || 'K' else '~' || cast(sum(n_chars) as bigint) end as chars,
 {O.percent('count(*) / (select count(*) from documents)')} as share from documents group by 1"""
)
def format_counts(spark, sf):
    docs = spread_table(spark, sf, "documents")
    per_lang = docs.groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    # One row per language is left here.
    total = F.sum("n").over(Window.partitionBy())
    return per_lang.select(
        "lang", X.format_count(F.col("chars")).alias("chars"), X.percent(F.col("n") / total).alias("share")
    )


@query(
    """select conv_id, turn, concat_ws(' ', role, text, case when role = 'user' then 'asked' end) as summary from conversations"""
)
def compose_summary(spark, sf):
    notes = F.when(F.col("role") == "user", F.lit("asked")).when(F.col("role") == "system", F.lit(""))
    return spread_table(spark, sf, "conversations").select(
        "conv_id", "turn", X.compose_summary(F.col("role"), F.col("text"), notes).alias("summary")
    )


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def extract_json_block(spark, sf):
    reply = F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nDone."))
    rows = table(spark, sf, "events").select("event_id", X.extract_json_block(reply).alias("block"))
    return rows.select("event_id", F.expr("try_variant_get(block, '$.k', 'bigint')").alias("k"))


# --- stored profiles ---------------------------------------------------------------------------


def _scratch(spark) -> str:
    """A new folder below the session's shared folder."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@query(
    f"with {O.flat('order_docs', 'contact_docs')}, {O.fields()}, {O.field_hints()} select f.collection, f.path, f.present_count,"
    " round(f.present_ratio, 6) as present_ratio, f.mixed_type, f.lo as min, f.hi as max, coalesce(h.hints, '') as hints"
    " from fields f left join fh_text h using (collection, path)"
)
def schema_json_round_trip(spark, sf):
    folder = _scratch(spark)
    fields = profile(spark, sf, "order_docs", "contact_docs", examples=True)
    store.write_schema_json(folder, fields, V.variant_analysis(documents(spark, sf, "order_docs", "contact_docs"), OPTIONS))
    back = store.stored_fields(store.load_schema_json(spark, folder))
    return back.select(
        "collection", "path", "present_count", F.round("present_ratio", 6).alias("present_ratio"), "mixed_type",
        F.col("stats.min").alias("min"), F.col("stats.max").alias("max"), F.array_join("hints", ", ").alias("hints"),
    )


@query(
    f"""with {O.flat('contact_docs', 'order_docs')}, {O.shapes('')}
select collection, rank, '#' || rank || case when rank = 1 then ' (primary)' else '' end as variant, {O.percent('ratio')} as ratio from diffed"""
)
def write_reports(spark, sf):
    folder = _scratch(spark)
    report = T.variant_report(V.variant_analysis(documents(spark, sf, "contact_docs", "order_docs"), OPTIONS))
    store.write_reports(folder, {"variants": report})
    back = spark.read.parquet(f"{folder}/variants")
    return back.select("collection", F.col("rank").cast("bigint").alias("rank"), "variant", "ratio")


# --- a whole run -------------------------------------------------------------------------------


@query(
    f"""with {O.flat('order_docs', 'contact_docs')}, {O.fields()}, {O.field_hints()}
select f.collection, f.path, f.present_count, round(f.present_ratio, 6) as present_ratio, f.mixed_type, f.lo as min, f.hi as max,
 coalesce(h.hints, '') as hints from fields f left join fh_text h using (collection, path)"""
)
def run_fields(spark, sf):
    found = profile_documents(documents(spark, sf, "order_docs", "contact_docs"), OPTIONS).fields
    return found.select(
        "collection", "path", "present_count", F.round("present_ratio", 6).alias("present_ratio"), "mixed_type",
        F.col("stats.min").alias("min"), F.col("stats.max").alias("max"), F.array_join("hints", ", ").alias("hints"),
    )


@query(
    f"""with {O.flat('order_docs', 'contact_docs')}, {O.fields()}, {O.field_hints()},
found as (select collection, count(*) as n from fh_text group by 1), total as (select collection, count(*) as docs from flat_docs group by 1)
select collection, docs as sampled, n as pii_field_count, 'PII detected' as warnings from total join found using (collection)"""
)
def run_warnings(spark, sf):
    found = profile_documents(documents(spark, sf, "order_docs", "contact_docs"), OPTIONS).warnings
    return found.select("collection", "sampled", "pii_field_count", F.array_join("warnings", ", ").alias("warnings"))


@query(
    f"""{_BEFORE_AFTER},
old_rows as (select * from old where path not like '%.[*]'), new_rows as (select * from flat where path not like '%.[*]'),
b as (select path, string_agg(distinct type, ', ' order by type) as before from old_rows group by 1),
a as (select path, string_agg(distinct type, ', ' order by type) as after from new_rows group by 1)
select path, case when a.after is not null and b.before is not null and contains(path, 'v') then 'about ' || path else '' end as description,
 case when b.before is null then 'added' when a.after is null then 'removed' when b.before <> a.after then 'type-changed' else 'same' end as status,
 'gone' as preserved from a full join b using (path)"""
)
def run_second_round(spark, sf):
    """The later documents against the stored profile of the earlier ones, whose descriptions are carried on."""
    earlier = fixture(spark, sf, "events_v1").withColumn("collection", F.lit("events"))
    gone = fixture(spark, sf, "contact_docs").withColumn("collection", F.lit("gone"))
    first = profile_documents(earlier.unionByName(gone), OPTIONS)
    answers = first.fields.where(F.contains("path", F.lit("v"))).select(
        "collection", "path", F.concat(F.lit("about "), "path").alias("description"), F.lit(1).alias("seq")
    )
    folder = _scratch(spark)
    write_profile(replace(first, fields=D.apply_descriptions(first.fields, answers)), folder)
    later = fixture(spark, sf, "mixed_docs").withColumn("collection", F.lit("events"))
    second = profile_documents(later, OPTIONS, previous=store.load_schema_json(spark, f"{folder}/schema"))
    described = second.fields.select("path", F.coalesce("description", F.lit("")).alias("description"))
    changed = second.drift.select("path", F.col("status").alias("change"))
    rows = described.join(changed, "path", "full_outer").select(
        "path", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("change", F.lit("same")).alias("status")
    )
    return rows.join(F.broadcast(second.preserved.select(F.col("collection").alias("preserved"))))
