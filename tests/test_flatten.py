from pyspark.sql import functions as F

from docstrata.operators import fields as A
from docstrata.operators.flatten import MARKER, flatten_documents, look, normalize_wildcards
from docstrata.options import ProfileOptions

SMALL = ProfileOptions(max_depth=4)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_containers_leaves_and_tags(docs_of):
    docs = docs_of('{"a":{"b":1},"t":["x",2,null],"d":95.5,"i":88.0,"l":12345678901,"e":1e3,"f":true,"n":null}')
    found = rows(flatten_documents(docs, SMALL), "path", "type", "text")
    assert found == sorted([
        ("a", "object", "{b}"), ("a.b", "int", "1"), ("t", "array", "[Array(3)]"), ("t.[*]", "string", "x"),
        ("t.[*]", "int", "2"), ("t.[*]", "null", "null"), ("d", "double", "95.5"), ("i", "int", "88"),
        ("l", "long", "12345678901"), ("e", "int", "1000"), ("f", "boolean", "true"), ("n", "null", "null"),
    ])


def test_extended_json_values_are_leaves(docs_of):
    docs = docs_of(
        '{"id":{"$oid":"507f1f77bcf86cd799439011"},"at":{"$date":"2024-01-15T10:30:00Z"},"p":{"$numberDecimal":"1.50"},'
        '"plain":{"$oid":"x","y":1}}'
    )
    found = rows(flatten_documents(docs, SMALL), "path", "type", "text")
    assert ("id", "objectId", "507f1f77bcf86cd799439011") in found
    assert ("at", "date", "2024-01-15T10:30:00.000Z") in found
    assert ("p", "decimal", "1.50") in found
    assert ("plain", "object", "{$oid, y}") in found and ("plain.y", "int", "1") in found


def test_keys_are_escaped_and_empty_keys_add_no_segment(docs_of):
    docs = docs_of('{"a.b":{"$x":1,"":{"x":1},"x":2}}')
    found = rows(flatten_documents(docs, SMALL), "path", "type")
    assert found == sorted([("a\\.b", "object"), ("a\\.b", "object"), ("a\\.b.\\$x", "int"), ("a\\.b.x", "int"), ("a\\.b.x", "int")])
    presence = rows(A.presence_counts(flatten_documents(docs, SMALL)), "path", "present_count")
    assert all(n == 1 for _, n in presence)


def test_depth_cap_cuts_once(docs_of):
    docs = docs_of({"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}})
    paths = flatten_documents(docs, ProfileOptions(max_depth=3))
    assert ("a.b.c.d.[TRUNCATED]", "null") in rows(paths, "path", "type")
    assert paths.agg(F.sum("depth_cut")).first()[0] == 1


def test_depth_cap_keeps_scalar_elements(docs_of):
    docs = docs_of('{"a":{"b":[1,{"x":1}]}}')
    found = rows(flatten_documents(docs, ProfileOptions(max_depth=2)), "path", "type")
    assert found == sorted([("a", "object"), ("a.b", "array"), ("a.b.[*]", "int"), ("a.b.[*].[TRUNCATED]", "null")])


def test_key_budget_counts_refused_rows(docs_of):
    docs = docs_of({f"k{i:03d}": i for i in range(200)}, {"k": 1})
    paths = flatten_documents(docs, ProfileOptions(max_depth=4, max_keys_per_doc=50))
    assert paths.where("doc_id = 0").count() == 50
    assert paths.where("doc_id = 1").count() == 1
    assert paths.agg(F.sum("keys_refused")).first()[0] == 150


def test_key_budget_skips_children_of_refused_rows(docs_of):
    docs = docs_of('{"a":1,"b":{"x":1,"y":2},"c":{"z":{"w":1}}}')
    paths = flatten_documents(docs, ProfileOptions(max_depth=4, max_keys_per_doc=3))
    assert rows(paths, "path") == [("a",), ("b",), ("b.x",)]
    assert paths.agg(F.sum("keys_refused")).first()[0] == 2


def test_array_cap_is_counted_once_per_array(docs_of):
    docs = docs_of({"v": list(range(100))})
    options = ProfileOptions(max_depth=4, max_array_sample=10)
    paths = flatten_documents(docs, options)
    assert paths.where("path = 'v.[*]'").count() == 10
    counters = A.truncation_counters(paths, options).where("collection is null").first()
    assert counters["arrays_truncated"] == 1


def test_markers_list_element_types(docs_of):
    docs = docs_of({"t": ["a", 1, "b"]}, {"t": [2]}, {"t": []})
    paths = flatten_documents(docs, SMALL, markers=True)
    assert rows(paths.where(F.col("kind") == MARKER), "doc_id", "text") == [(0, "[int]"), (0, "[string]"), (1, "[int]")]
    assert rows(A.array_element_types(paths), "type", "arrays", "docs") == [("int", 2, 2), ("string", 1, 1)]


def test_deep_and_plain_documents_together(docs_of):
    deep = '{"a":' * 12 + "1" + "}" * 12
    paths = flatten_documents(docs_of(deep, {"a": 1}), ProfileOptions(max_depth=20))
    assert paths.where("doc_id = 0").agg(F.max("depth")).first()[0] == 12
    assert paths.where("doc_id = 1").count() == 1


def test_raw_paths_normalise_to_wildcards(docs_of):
    docs = docs_of('{"a":[{"b":1},{"b":2}],"x.[0]":3}')
    raw = flatten_documents(docs, SMALL, raw_paths=True)
    assert ("a.[1].b",) in rows(raw, "path")
    found = rows(normalize_wildcards(raw), "path")
    assert found.count(("a.[*].b",)) == 2 and ("x\\.[0]",) in found


def test_unparsable_and_null_documents_have_no_rows(docs_of):
    assert flatten_documents(docs_of("{broken", "null", {}), SMALL).count() == 0


def test_collections_of_plain_documents_are_not_filtered_by_levels(docs_of):
    deep = '{"a":' * 12 + "1" + "}" * 12
    docs = docs_of(deep, {"a": 1}, collection="mixed").unionByName(docs_of({"b": 1}, {"b": {"c": 2}}, collection="plain"))
    paths = flatten_documents(docs)
    found = {r["collection"]: r["n"] for r in paths.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {"mixed": 13, "plain": 3}


def test_plain_keys_are_known_from_all_documents(docs_of):
    plain = docs_of('{"a":{"b":[1,"x-y",{"c":2.5}]},"e":"","t":["a.b",1]}')
    assert look(plain).plain_keys and look(plain).depths == (5, None, None)
    for odd in ('{"a.b":1}', '{"t":[1,{"$x":1}]}', '{"t":[1,{"":1}]}', '{"t":[1,{"[0]":1}]}', r'{"t":[1,{"a\"b":1}]}', '{"t":[1,{"é":1}]}'):
        assert not look(plain.unionByName(docs_of(odd))).plain_keys
    found = rows(flatten_documents(plain), "path", "type", "solo")
    assert found == sorted([
        ("a", "object", True), ("a.b", "array", True), ("a.b.[*]", "int", False), ("a.b.[*]", "string", False),
        ("a.b.[*]", "object", False), ("a.b.[*].c", "double", False), ("e", "string", True), ("t", "array", True),
        ("t.[*]", "string", False), ("t.[*]", "int", False),
    ])


def test_containers_alone_give_the_same_markers_and_counters(docs_of):
    docs = docs_of('{"a":{"b":[1,"x",[2,{"c":[]}]]},"n":null}', {"t": [[1, 2, 3], [], [None]], "s": 1}, {"a": {"b": {"c": {"d": {"e": 1}}}}})
    capped = ProfileOptions(max_depth=3, max_array_sample=2)
    seen = look(docs)
    for options in (ProfileOptions(), capped):
        whole, containers = (flatten_documents(docs, options, markers=True, leaves=leaves, seen=seen) for leaves in (True, False))
        assert rows(containers, "path").count(("s",)) == 0
        assert sorted(A.array_element_types(whole).collect()) == sorted(A.array_element_types(containers).collect())
        assert A.truncation_counters(whole, options).where("collection is null").collect() == A.truncation_counters(containers, options).where("collection is null").collect()
    assert A.truncation_counters(flatten_documents(docs, capped, leaves=False), capped).where("collection is null").first()["depth_truncated"] > 0


def test_hints_of_texts_alone(docs_of):
    docs = docs_of('{"mail":"a@b.example.com","n":5,"t":["1.2.3.4",7],"z":null}', {"mail": 3, "x": {"$oid": "a@b.example.com"}})
    whole, texts = flatten_documents(docs), flatten_documents(docs, strings=True)
    assert rows(A.field_hints(texts), "path", "hints") == rows(A.field_hints(whole), "path", "hints")


def test_a_look_counts_the_documents_that_parse(docs_of):
    docs = docs_of("{broken", "null", {"a": 1}, {"a": 2}).unionByName(docs_of("{broken", collection="none"))
    seen = look(docs, counted=True)
    assert rows(seen.totals, "collection", "docs") == rows(A.document_counts(docs), "collection", "docs") == [("c", 3)]


def test_arrays_alone_are_those_of_all_rows(docs_of):
    # An odd key in one document makes all of them take the way of odd keys.
    plain = docs_of('{"a":{"c":[1,{"d":"x","e":[]}],"s":"ARRAY"},"o":{"ARRAY":1},"n":null,"t":["x",null]}', "[1,[2]]", {"k": 1}, "{broken", "null", "7")
    odd = docs_of('{"x[*]y":1,"[0]":{"z":true},"q[1":{"w":1},"":[1,{"":[2]}],"w":{"$oid":"x"},"v":[{"$date":"2024-01-15T10:30:00Z"}]}', collection="odd")
    columns = ["collection", "doc_id", "path", "pos", "depth", "type", "text", "size", "num", "kind", "solo"]
    inside = (F.col("type") == "array") | F.contains("path", F.lit("[*]"))
    deep = docs_of('{"a":' * 8 + "[1]" + "}" * 8, {"k": {"l": 1}})
    cases = [
        (plain, ProfileOptions(), True), (plain.unionByName(odd), ProfileOptions(), False), (deep, ProfileOptions(), False),
        (plain, ProfileOptions(max_depth=2, max_array_sample=1), True), (plain.unionByName(odd), ProfileOptions(max_keys_per_doc=4), False),
    ]
    for docs, options, markers in cases:
        whole = flatten_documents(docs, options, markers=markers)
        arrays = flatten_documents(docs, options, markers=markers, arrays_only=True)
        # As text, for missing numbers have no order.
        expected, found = (sorted(str(tuple(r)) for r in df.select(*columns).collect()) for df in (whole.where(inside), arrays))
        assert expected and found == expected
    raw = flatten_documents(plain, raw_paths=True)
    expected = rows(raw.where((F.col("type") == "array") | F.col("path").rlike(r"\[[0-9]+\]")), "doc_id", "path", "text")
    assert expected and rows(flatten_documents(plain, raw_paths=True, arrays_only=True), "doc_id", "path", "text") == expected


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_arrays_reads_a_schema_text_a_few_times_at_most(docs_of):
    docs = docs_of({"a": {"b": [1, {"c": "x"}]}, "s": 1})
    found = _plan(flatten_documents(docs, arrays_only=True).groupBy("path", "text").count())
    filters = [line for line in found.splitlines() if "Filter " in line]
    assert filters and max(line.count("schemaOfVariant(") for line in filters) <= 2
    # Values outside arrays are dropped at each level, not after the last one alone.
    assert sum("ARRAY" in line for line in filters) == look(docs).depths[0]


def test_a_look_groups_documents_by_schema_text_first(spark, docs_of, monkeypatch):
    plans, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "first", lambda self, first=frame.first: plans.append(_plan(self)) or first(self))
    look(docs_of({"a": 1}, {"a": {"b": 2}}))
    # By schema text, by collection, and of all collections.
    assert sum("Aggregate [" in line for line in plans[0].splitlines()) == 3
