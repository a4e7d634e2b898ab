import random

import pytest
from pyspark.sql import functions as F

from docstrata.operators import fields as A
from docstrata.operators.flatten import flatten_documents
from docstrata.options import ProfileOptions

SMALL = ProfileOptions(max_depth=4)


@pytest.fixture(scope="module")
def mixed(docs_of):
    docs = docs_of({"v": "text", "n": 10}, {"v": 12345, "n": 20}, {"v": None, "n": 30}, {"v": 1.5})
    return docs, flatten_documents(docs, SMALL)


def test_profile(mixed):
    docs, paths = mixed
    found = {r["path"]: r for r in A.profile_collection(paths, A.document_counts(docs), SMALL).collect()}
    v, n = found["v"], found["n"]
    assert v["mixed_type"] and not n["mixed_type"]
    assert (n["present_count"], n["absent_count"], n["present_ratio"], n["optional"]) == (3, 1, 0.75, True)
    assert (n["stats"]["min"], n["stats"]["max"], n["stats"]["avg"]) == (10, 30, 20)
    assert [t["type"] for t in v["types"]] == ["string", "int", "null", "double"]
    assert sum(t["ratio"] for t in v["types"]) == 1
    assert [e["value"] for e in n["examples"]] == ["10", "20", "30"]


def test_primary_type_ignores_null(docs_of):
    paths = flatten_documents(docs_of({"a": None}, {"a": None}, {"a": 1}, {"b": None}), SMALL)
    found = {r["path"]: r["primary_type"] for r in A.primary_type(A.type_counts(paths)).collect()}
    assert found == {"a": "int", "b": None}


def test_percentile_and_stddev(docs_of):
    paths = flatten_documents(docs_of(*[{"x": i, "one": 7} for i in range(1, 11)]), SMALL)
    p90 = {r["path"]: r["percentile"] for r in A.field_percentile(paths, 90).collect()}
    assert p90["x"] == pytest.approx(9.1) and p90["one"] == 7
    p0 = {r["path"]: r["percentile"] for r in A.field_percentile(paths, 0).collect()}
    assert p0["x"] == 1
    sd = {r["path"]: r["stddev"] for r in A.field_stddev(paths).collect()}
    assert sd["one"] == 0 and sd["x"] == pytest.approx(2.8722813)


def test_presence_counts_documents_not_occurrences(docs_of):
    docs = docs_of({"a": [{"k": 1}, {"k": 2}]}, {"a": [{"k": 3}]}, {"a": []}, {"a": [{"j": 1}, {"k": 1}]})
    found = {r["path"]: r["present_count"] for r in A.presence_counts(flatten_documents(docs, SMALL)).collect()}
    assert found == {"a": 4, "a.[*]": 3, "a.[*].k": 3, "a.[*].j": 1}


def test_first_distinct_examples_against_brute_force(spark):
    rng = random.Random(1)
    data = []
    for i in range(3000):
        data.append(("c", "constant", "string", "same", 0, i))
        data.append(("c", "late", "string", "same" if i < 2500 else f"v{i}", 0, i))
        data.append(("c", "few", "string", rng.choice("abcd"), 0, i))
        data.append(("c", "unique", "string", f"u{(i * 7919) % 3000}", 0, i))
    rows = spark.createDataFrame(data, "collection string, path string, type string, rendered string, value_mask bigint, at bigint")
    rows = rows.withColumn("h", F.xxhash64("rendered"))
    got = {}
    for r in A.first_distinct(rows, A.FIELD_TYPE, 3).orderBy("path", "rank").collect():
        got.setdefault(r["path"], []).append(r["rendered"])
    want = {}
    for _, path, _, value, _, _ in data:
        seen = want.setdefault(path, [])
        if value not in seen and len(seen) < 3:
            seen.append(value)
    assert got == want


def test_merged_profiles_equal_the_whole(docs_of):
    everything = [{"a": i, "b": [{"c": i}] * (i % 3)} for i in range(30)]
    docs = docs_of(*everything)
    whole = A.partial_profile(flatten_documents(docs, SMALL))
    halves = [A.partial_profile(flatten_documents(docs.where(c), SMALL)) for c in ("doc_id < 11", "doc_id >= 11")]
    merged = A.merge_profiles(*halves)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.select(*whole.columns).collect()))


def test_examples_are_masked_under_policy(docs_of):
    docs = docs_of({"email": "john.doe@example.com", "note": "hello", "card": "4111-1111-1111-1111"})
    paths = flatten_documents(docs, SMALL)

    def shown(policy):
        o = ProfileOptions(max_depth=4, redact=policy)
        return {r["path"]: r["rendered"] for r in A.examples_per_type(paths, o).collect()}

    assert shown("pii") == {"email": "j***@e***.com", "note": "hello", "card": "411**********111"}
    assert shown("off")["email"] == "john.doe@example.com"
    assert shown("all")["note"] == "h***o"


def test_custom_patterns_reach_masks_and_hints(docs_of):
    docs = docs_of({"vendor": {"id": "abcdef"}, "other": "abcdef"})
    paths = flatten_documents(docs, SMALL)
    o = ProfileOptions(max_depth=4, pii_patterns=("vendor.*",))
    shown = {r["path"]: r["rendered"] for r in A.examples_per_type(paths, o).collect()}
    assert shown["vendor.id"] == "a****f" and shown["other"] == "abcdef"
    hints = {r["path"]: r["hints"] for r in A.field_hints(paths, o).collect()}
    assert hints["vendor.id"] == ["vendor"] and hints["vendor"] == []


def test_field_names_are_those_of_all_path_rows(docs_of):
    """Names come from schema texts; texts that hide paths, and keys that look like types, must lose none."""
    docs = docs_of(
        {"a": 1, "STRING": "x", "OBJECT": {"ARRAY": [[1.5], []]}, "_id": True},
        {"a": [{"b": None}, {"c": {"d": []}}, None], "e": {}},
        {"a": [1, {"hidden": 2}]},
        {"two words": 1, "x.y": {"z": 1}, "": [3]},
        [], [None], [[1]], 5, "null", "{broken",
        {"w": {"$oid": "1"}, "l": [{"$oid": "1"}, {"k": 1}]},
        {"[0]": {"k": 1}, "d": {"D": {"e": {"f": {"g": {"h": {"i": {"j": 1}}}}}}}},
    )
    every = {(r["collection"], r["path"]) for r in A.field_rows(flatten_documents(docs)).select("collection", "path").collect()}
    found = [(r["collection"], r["path"]) for r in A.field_names(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == every


def test_field_names_flatten_one_document_per_schema_text(docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(A, "flatten_documents", lambda documents, *a: seen.append(documents.count()) or flatten_documents(documents, *a))
    assert A.field_names(docs_of(*[{"a": i, "b": {"c": [str(i)]}} for i in range(50)])).count() == 3
    assert seen == [1]
