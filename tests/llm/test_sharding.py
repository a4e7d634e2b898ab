import zlib
from collections import Counter

from docstrata.llm import sharding
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def test_every_row_once_in_even_shards(spark):
    texts = [(i, "text " * (i % 50), "en", "s") for i in range(700)] + [(7, "again", "en", "s")] * 30 + edges.EDGES
    docs = edges.frame(spark, texts)
    placed = sharding.shard_documents(docs, shards=13, bucket_bytes=4000).collect()
    assert edges.same([tuple(r.record) for r in placed], edges.rows(texts))
    counts = Counter(r.shard for r in placed)
    assert len(counts) == 13 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(n))


def test_order_depends_on_the_seed_and_not_on_the_partitions(spark):
    docs = spark.createDataFrame([(i, f"t{i % 90}") for i in range(500)], "doc_id long, text string")

    def order(frame, seed):
        rows = sharding.shard_documents(frame, 4, seed, 2000).select("record.doc_id", "shard", "slot").collect()
        return [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]

    first = order(docs, 1)
    assert first == order(docs.repartition(5), 1)
    assert first != order(docs, 2) and first != sorted(first)
    # neighbours in the input are no longer neighbours
    assert sum(abs(a - b) == 1 for a, b in zip(first, first[1:], strict=False)) < 20


def test_equal_rows_fill_all_buckets(spark):
    docs = spark.createDataFrame([(1, "the same row")] * 5000, "doc_id long, text string").repartition(3)
    shuffled, buckets = sharding.shuffle_records(docs, bucket_bytes=5000 * 28 // 20)
    counts = Counter(r.bucket for r in shuffled.collect())
    assert buckets == 20 and len(counts) == 20 and max(counts.values()) < 400
    placed = sharding.shard_documents(docs, 7, bucket_bytes=5000 * 28 // 20)
    assert {r["count"] for r in placed.groupBy("shard").count().collect()} <= {714, 715}


def test_empty_table_and_files(spark, tmp_path):
    docs = edges.frame(spark)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    sharding.write_shards(sharding.shard_documents(docs, 3), str(tmp_path / "out"), files=5)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_query(spark, bundled):
    docs = spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op7_sharding"](spark, bundled).collect()
    want = [(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs]
    assert edges.same([(r.doc_id, r["size"], r.text_crc32) for r in got], want)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
