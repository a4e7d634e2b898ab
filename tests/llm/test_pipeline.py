import corpus_pipeline
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def test_stages_keep_columns_and_clean_documents(spark, bundled):
    docs = spark.read.parquet(f"{bundled}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, bundled).cache()
        assert docs.columns == names
        assert docs.where("n_chars <> length(text)").count() == 0
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    labels = spark.read.parquet(f"{bundled}/labels.parquet").where("quality = 0")
    assert docs.join(labels, "doc_id").count() < 0.2 * labels.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, bundled)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_odd_documents(spark):
    docs = edges.frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0
        docs = stage(spark, docs, "").cache()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("length < 1").count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
