import pytest
from pyspark.sql import functions as F

from docstrata.operators import describe as D
from docstrata.operators import drift as R
from docstrata.operators import relate as K
from docstrata.operators import sampling as S
from docstrata.operators import tree as N
from docstrata.operators import variants as V
from docstrata.options import ProfileOptions
from docstrata.plans.run import description_queue, profile_documents, write_profile
from docstrata.sources import store

SMALL = ProfileOptions(max_depth=4)


def names(spark, *paths, collection="c"):
    return spark.createDataFrame([(collection, p) for p in paths], "collection string, path string")


def test_variants(docs_of):
    docs = docs_of({"a": 1, "b": {}}, {"a": 2}, {"a": 1, "c": {"d": {"e": {"f": 1}}}}, {"c": [1]}, {"a": 3})
    found = V.variant_analysis(docs, SMALL).orderBy("rank").collect()
    assert [(r["count"], r["paths"]) for r in found] == [(3, ["a"]), (1, ["a", "c.d.e"]), (1, ["c"])]
    assert (found[2]["added"], found[2]["missing"]) == (["c"], ["a"]) and found[0]["ratio"] == 0.6


def test_signature_ignores_order(spark):
    df = spark.createDataFrame([(["a", "b.c"],), (["b.c", "a"],)], "p array<string>")
    assert df.select(V.shape_signature(F.col("p"))).distinct().count() == 1


def test_similarity(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(V.shape_similarity(F.col("x"), F.col("y"))).collect()] == [pytest.approx(1 / 3), 1.0]


def test_tree(spark):
    tree = N.field_tree(names(spark, "a", "a.b", "a.c", "v.x.y", "p", "p.[*].id", "p.[*].q", "p.[*].q.[*].z"))
    got = {r["full_path"]: (r["depth"], r["has_field"], r["rowspan"]) for r in tree.collect()}
    assert got["a"] == (1, True, 3) and got["v"] == (1, False, 1) and got["v.x.y"] == (3, True, 1)
    assert got["p"] == (1, True, 4) and got["p.[*].id"] == (2, True, 1) and got["p.[*].q.[*].z"] == (3, True, 1)
    order = [r["full_path"] for r in N.tree_preorder(tree).collect()]
    assert order.index("a") < order.index("a.b") < order.index("a.c") < order.index("p") < order.index("p.[*].id")


def test_tree_clash_drops_the_lifted_subtree(spark):
    tree = N.field_tree(names(spark, "p", "p.x", "p.[*].x", "p.[*].x.y", "p.[*].z"))
    assert sorted(r["full_path"] for r in tree.collect()) == ["p", "p.[*].z", "p.x"]


def test_fk_context_matches_nested_loop(spark):
    fields = names(spark, "userId", "user_id", "id", "_id", "order.userId", "name", "paid", "guid", "ownerUuid")
    cands = K.fk_candidates(fields)
    got = {r["path"]: r["context"] for r in K.fk_context(fields, cands).collect()}
    keys = [r["path"] for r in cands.collect()]
    for path, context in got.items():
        low = path.split(".")[-1].lower()
        want = sorted(f"c.{k}" for k in keys if k.split(".")[-1].lower() in low or low in k.split(".")[-1].lower())
        assert context == want


def test_descriptions(spark):
    fields = names(spark, "a", "b", "t.[*].x")
    earlier = spark.createDataFrame([("c", "a", "old a")], "collection string, path string, description string")
    assert [r["path"] for r in R.fields_needing_description(fields, earlier).orderBy("path").collect()] == ["b", "t.[*].x"]
    answers = spark.createDataFrame(
        [("c", "t.*.x", "new", 1), ("c", "a", "newer a", 1), ("c", "b", "", 1)], "collection string, path string, description string, seq int"
    )
    got = {r["path"]: r["description"] for r in D.apply_descriptions(R.carry_descriptions(fields, earlier), answers).collect()}
    assert got == {"a": "newer a", "b": None, "t.[*].x": "new"}


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    assert S.random_sample(df, 10).count() == 10
    got = S.sample_with_fallback(df, 5, condition="doc_id > 1000").collect()
    assert len(got) == 5 and all(r["fallback"] and r["strategy"] == "random" for r in got)
    with pytest.raises(ValueError):
        S.sample_with_fallback(df, 5, condition="doc_id > 1000", strict=True)


def test_whole_run_and_its_second_round(spark, docs_of, tmp_path):
    first = docs_of({"name": "Ann", "age": 3}, {"name": "Bob", "age": 4, "tags": ["x"]}, collection="people")
    answers = spark.createDataFrame([("people", "age", "Age in years", 1)], "collection string, path string, description string, seq int")
    run = profile_documents(first, SMALL, answers=answers)
    write_profile(run, str(tmp_path))
    earlier = store.load_schema_json(spark, f"{tmp_path}/schema")
    assert store.stored_descriptions(earlier).collect()[0]["description"] == "Age in years"
    assert spark.read.parquet(f"{tmp_path}/fields").count() == 3
    second = docs_of({"name": "Ann", "age": "3", "x": 1}, collection="people")
    again = profile_documents(second, SMALL, previous=earlier)
    drifted = {
        r["path"]: r["status"]
        for r in R.schema_drift(_types(run.fields), _types(again.fields)).collect()
    }
    assert drifted == {"age": "type-changed", "x": "added", "tags": "removed"}
    assert R.changed_collections(run.fingerprints, again.fingerprints).first()["status"] == "changed"
    waiting = description_queue(again, spark.createDataFrame([], "key string"))
    assert sorted(r["path"] for r in waiting.collect()) == ["name", "x"]


def test_a_run_over_some_collections_keeps_the_others(spark, docs_of, tmp_path):
    people, places = docs_of({"name": "Ann"}, collection="people"), docs_of({"city": "Bonn"}, {"city": "Ulm"}, collection="places")
    write_profile(profile_documents(people.unionByName(places), SMALL), str(tmp_path), update=True)
    earlier = store.load_schema_json(spark, f"{tmp_path}/schema")
    write_profile(profile_documents(docs_of({"town": "Trier"}, collection="places"), SMALL, previous=earlier), str(tmp_path), update=True)
    fields = store.stored_fields(store.load_schema_json(spark, f"{tmp_path}/schema"))
    assert sorted((r["collection"], r["path"], r["present_count"]) for r in fields.collect()) == [("people", "name", 1), ("places", "town", 1)]
    for report in ("fields", "variants", "overview"):
        assert sorted(r["collection"] for r in spark.read.parquet(f"{tmp_path}/{report}").collect()) == ["people", "places"]


def _types(fields):
    return fields.select("collection", "path", F.explode("types").alias("t")).select("collection", "path", "t.type")


def test_missing_profile_is_empty(spark, tmp_path):
    assert store.load_schema_json(spark, f"{tmp_path}/nowhere").count() == 0


def test_readers(spark, tmp_path):
    from docstrata.operators.flatten import flatten_documents
    from docstrata.sources import readers

    (tmp_path / "people.json").write_text('{"_id":"a","n":1}\n{"_id":"b","n":{"x":2.5}}\n')
    docs = readers.read_documents(spark, str(tmp_path / "people.json"), "people")
    assert sorted((r["doc_id"], r["path"]) for r in flatten_documents(docs, SMALL).where("path like 'n%'").collect()) == [
        ("a", "n"), ("b", "n"), ("b", "n.x")]
    spark.sql("select 1 as id, timestamp'2024-01-02 03:04:05' as at, X'00ff' as raw, array(1, 2) as xs").write.parquet(f"{tmp_path}/t")
    typed = readers.read_documents(spark, f"{tmp_path}/t", "t", "parquet", "id")
    found = {r["path"]: (r["type"], r["text"]) for r in flatten_documents(typed, SMALL).where("path not like '%*%'").collect()}
    assert found == {"id": ("int", "1"), "at": ("date", "2024-01-02T03:04:05.000Z"), "raw": ("binData", "00ff"), "xs": ("array", "[Array(2)]")}
    bad = spark.createDataFrame([("{}",), ("{x",), (None,)], "j string")
    assert tuple(readers.count_corrupt(bad, "j").first()) == (1, 3)
    catalog = readers.catalog_scan({"b": docs, "a": typed, "system.x": typed})
    assert [tuple(r) for r in catalog.collect()] == [("a", 1), ("b", 2)]
    keys = readers.key_profile(spark.sql("select * from values (1, 'x'), (2, 'x'), (3, null) t(id, s)"), {"id": ["id"], "s": ["s"]})
    assert {r["name"]: (r["unique"], r["sparse"], r["absent"]) for r in keys.collect()} == {"id": (True, False, 0), "s": (False, True, 1)}


def test_string_document_ids_order_first_seen(spark):
    from docstrata.operators import fields as A
    from docstrata.operators.flatten import flatten_documents
    from docstrata.sources.readers import documents_from_json

    rows = spark.createDataFrame([("k2", '{"v":2}'), ("k1", '{"v":"x"}'), ("k3", '{"v":2}')], "id string, j string")
    docs = documents_from_json(rows, "c", "id", "j")
    found = A.profile_collection(flatten_documents(docs, SMALL), A.document_counts(docs), SMALL).first()
    assert [(t["type"], t["n"]) for t in found["types"]] == [("string", 1), ("int", 2)]
    assert [e["value"] for e in found["examples"]] == ["x", "2"]


def test_run_without_caps_expands_documents_once(docs_of, monkeypatch):
    from docstrata.operators import fields

    docs = docs_of({"a": [1]}, "{broken", {}, collection="c").unionByName(docs_of({}, [], 5, collection="empty")).unionByName(docs_of([None], collection="l"))
    counted = {(r[0], r[1], r[2], r[3]) for r in fields.truncation_counters(fields.flatten_documents(docs)).collect()}
    monkeypatch.setattr(fields, "truncation_counters", None)
    run = profile_documents(docs)
    assert {tuple(r) for r in run.truncation.collect()} == counted == {("c", 0, 0, 0), ("l", 0, 0, 0), (None, 0, 0, 0)}
    assert [tuple(r) for r in run.rejected.collect()] == [("c", 1, 3)]
    assert sorted(tuple(r) for r in run.catalog.collect()) == [("c", 2), ("empty", 3), ("l", 1)]
