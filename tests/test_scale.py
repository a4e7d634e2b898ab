"""Similar sets, sketches, streams, stored increments, samples and locale order against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docstrata.functions import paths as P
from docstrata.operators import fields as A
from docstrata.operators import sampling as S
from docstrata.operators import similar as M
from docstrata.operators import variants as V
from docstrata.operators.flatten import flatten_documents
from docstrata.sources import readers, store
from docstrata.sources.readers import documents_from_json
from docstrata.streaming import increments


def random_sets(n, seed=1):
    rng = random.Random(seed)
    bases = [rng.sample(range(200), rng.randint(1, 25)) for _ in range(8)]
    sets = {}
    for i in range(n):
        paths = set(rng.choice(bases)) | {900, 901}
        for _ in range(rng.choice([0, 1, 2, 6])):
            paths ^= {rng.randrange(200)}
        sets[f"s{i:03d}"] = {f"p{p}" for p in paths}
    return sets | {"e1": set(), "e2": set()}


def expected_pairs(sets, threshold):
    out = {}
    for a in sets:
        for b in sets:
            union = sets[a] | sets[b]
            similarity = len(sets[a] & sets[b]) / len(union) if union else 1.0
            if a < b and similarity >= threshold - 1e-12:
                out[a, b] = similarity
    return out


@pytest.mark.parametrize("threshold,chunk", [(0.5, 1000), (0.8, 1000), (0.8, 3), (1.0, 1000), (0.1, 7)])
def test_similar_sets_against_brute_force(spark, threshold, chunk):
    sets = random_sets(70)
    table = spark.createDataFrame([*((k, sorted(v)) for k, v in sets.items()), (None, ["p1"])], "name string, paths array<string>")
    got = {(r.a, r.b): r.similarity for r in M.similar_sets(table, threshold, chunk_rows=chunk).collect()}
    want = expected_pairs(sets, threshold)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert M.similar_sets(table.limit(0), threshold).count() == 0


def test_bands_find_what_they_promise(spark):
    sets = random_sets(150, seed=2)
    table = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "name string, paths array<string>")
    want = expected_pairs(sets, 0.8)
    bands = M.bands_for(0.8, 0.98)
    assert M.band_recall(0.8, bands) >= 0.98 > M.band_recall(0.8, bands - 1)
    got = {(r.a, r.b) for r in M.similar_sets(table, 0.8, bands=bands).collect()}
    assert got <= want.keys() and len(got) >= 0.93 * len(want)
    with pytest.raises(ValueError):
        M.similar_sets(table, 0)


def test_screen_groups_only_keys_that_may_be_unique(spark, monkeypatch):
    rows = spark.range(5000).select("id", (F.col("id") % 50).alias("few"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("gaps"), F.lit(None).cast("int").alias("none"))
    rows = rows.withColumn("twice", F.when(F.col("id") == 4999, 0).otherwise(F.col("id")))
    keys = {"id": ["id"], "few": ["few"], "gaps": ["gaps"], "none": ["none"], "twice": ["twice"], "both": ["few", "id"]}
    grouped, exact = [], readers.key_profile
    monkeypatch.setattr(readers, "key_profile", lambda df, some: grouped.extend(some) or exact(df, some))
    columns = ["name", "keys", "rows", "absent", "unique"]
    got = sorted(map(tuple, readers.screened_keys(rows, keys).select(columns).collect()))
    assert got == sorted(map(tuple, exact(rows, keys).select(columns).collect()))
    assert "few" not in grouped and {"id", "gaps", "both", "twice"} <= set(grouped)
    halves = [readers.key_estimates(rows.where(c), keys) for c in ("id % 2 = 0", "id % 2 = 1")]
    merged = {r["name"]: r for r in readers.spelled_estimates(readers.merge_estimates(*halves), keys).collect()}
    assert abs(merged["id"]["estimate"] - 5000) < 250 and merged["few"]["estimate"] == 50 and merged["gaps"]["absent"] == 556


def test_merged_sketches_are_near_the_exact_percentile(docs_of):
    rng = random.Random(3)
    values = [rng.gauss(0, 100) for _ in range(4000)]
    docs = docs_of(*[{"x": v, "one": 7} for v in values])
    halves = [A.partial_quantiles(flatten_documents(docs.where(c))) for c in ("doc_id < 900", "doc_id >= 900")]
    for p in (0, 10, 50, 99, 100):
        found = {r.path: r for r in A.sketched_percentile(A.merge_quantiles(*halves), p).collect()}
        rank = sum(v <= found["x"].percentile for v in values) / len(values)
        assert found["x"].n == 4000 and abs(rank - p / 100) < 0.01 and found["one"].percentile == 7


def test_stream_in_batches_equals_the_whole(spark, tmp_path):
    everything = [{"a": i, "b": [{"c": i}] * (i % 3), **({"d": "x"} if i % 4 else {})} for i in range(60)]
    source, target = tmp_path / "in", str(tmp_path / "profile")
    source.mkdir()

    def arrive(part):
        (source / f"{part}.txt").write_text("\n".join(json.dumps({"id": i, "d": everything[i]}) for i in range(part * 20, part * 20 + 20)))

    def to_documents(batch):
        return documents_from_json(batch.selectExpr("get_json_object(value, '$.id') as id", "get_json_object(value, '$.d') as j"), "c", "id", "j")

    def run():
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
        increments.profile_stream(lines, to_documents, target).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(ValueError):
        increments.read_profile(spark, target, "types")
    arrive(0), arrive(1), run()
    assert increments.read_profile(spark, target, "documents").first().docs == 40
    # a batch that is done again replaces itself
    again = spark.read.text(str(source / "0.txt"))
    increments.store_batch(to_documents(again), 0, target)
    arrive(2), run()
    docs = to_documents(spark.read.text(str(source)))
    for name, table in increments.partial_tables(docs).items():
        if name == "quantiles":
            continue
        got = increments.read_profile(spark, target, name).select(*table.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, table.collect()))
    counts = increments.field_counts(increments.read_profile(spark, target, "types"), increments.read_profile(spark, target, "documents"))
    assert {r.path: r.share for r in counts.where("type = 'string'").collect()} == {"d": 0.75}


def test_updates_keep_other_collections(spark, tmp_path, docs_of):
    folder = str(tmp_path / "out")

    def save(docs):
        fields = A.profile_collection(flatten_documents(docs), A.document_counts(docs))
        store.update_schema_json(f"{folder}/schema", fields, V.variant_analysis(docs))
        store.update_reports(folder, {"fields": fields.select("collection", "path"), "run": spark.range(1)})

    save(docs_of({"a": 1}, collection="x").unionByName(docs_of({"b": 1}, {"b": 2}, collection="y")))
    save(docs_of({"c": 1}, collection="x"))
    fields = store.stored_fields(store.load_schema_json(spark, f"{folder}/schema"))
    assert {(r.collection, r.path, r.present_count) for r in fields.collect()} == {("x", "c", 1), ("y", "b", 2)}
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/fields").select("collection", "path").collect()} == {("x", "c"), ("y", "b")}
    assert spark.read.parquet(f"{folder}/run").count() == 1


def test_fractions(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    assert abs(S.fraction_sample(rows, 0.25, 1).count() - 5000) < 350
    assert S.fraction_sample(rows, 0).count() == 0 and S.fraction_sample(rows, 1).count() == 20_000
    strata = {r.kind: r["count"] for r in S.stratified_fraction(rows, "kind", {"even": 0.5}, 1).groupBy("kind").count().collect()}
    assert set(strata) == {"even"} and abs(strata["even"] - 5000) < 350
    small, large = (S.keyed_fraction(rows, f, "id") for f in (0.1, 0.2))
    assert small.subtract(large).count() == 0 and abs(large.count() - 4000) < 350
    for wrong in (S.fraction_sample, S.keyed_fraction):
        with pytest.raises(ValueError):
            wrong(rows, 1.5)
    plan = S.fraction_sample(rows, 0.25)._jdf.queryExecution().executedPlan().toString()
    assert "Sample" in plan and "Exchange" not in plan


def test_locale_order(spark):
    wanted = ["", "_x", "-x", "[x]", "@b", "#c", "$x", "009", "9", "10", "99999999999999999999999", "a b", "a_b", "a-b", "a.b", "á1", "a2", "Ä10", "Ab", "ae", "É1", "e2", "é3", "item2", "Item10", "n", "ñ1", "x01y3", "x1y10", "z", "日本"]
    shuffled = random.Random(4).sample(wanted, len(wanted))
    table = spark.createDataFrame([(s,) for s in shuffled], "s string")
    assert [r.s for r in table.orderBy(P.natural_order(F.col("s")), "s").collect()] == wanted
    paths = ["a", "a.b", "a.B2", "a.b10", "a b", "a-b.c", "é", "É.a", "f.[*]", "f.[*].x", "f.x"]
    listed = table.limit(1).select(P.sort_paths(F.array(*[F.lit(p) for p in reversed(paths)])).alias("l")).first().l
    assert listed == paths
