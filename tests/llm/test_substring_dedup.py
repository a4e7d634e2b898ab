import hashlib
import random

import pytest

from docstrata.llm import substring_dedup
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def expected(docs):
    """(doc_id, n_words, n_removed, kept_sha256) with every window's earliest start looked up."""
    last = 2**63 - 1
    first = {}
    for i, t in docs:
        words = edges.words(t)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            first[window] = min(first.get(window, (last, last)), (last if i is None else i, k))
    out = []
    for i, t in docs:
        words = edges.words(t)
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if first[tuple(words[k : k + 20])] != (last if i is None else i, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeating(seed=8):
    random.seed(seed)
    vocabulary = [f"v{i}" for i in range(50)]
    passages = [[random.choice(vocabulary) for _ in range(random.randint(15, 70))] for _ in range(12)]
    docs = []
    for i in range(80):
        words = []
        for _ in range(random.randint(0, 4)):
            words += random.choice(passages) if random.random() < 0.5 else [random.choice(vocabulary) for _ in range(random.randint(0, 40))]
        docs.append((i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))))
    return [*docs, (200, "same " * 400)]


@pytest.mark.parametrize("group_rows", [2000, 2])
def test_passages_against_brute_force(spark, group_rows):
    docs = repeating()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert edges.same([tuple(r) for r in substring_dedup.passage_digests(df, group_rows).collect()], expected(docs))


@pytest.mark.parametrize("seed", [8, 9])
def test_texts_that_share_an_id(spark, seed):
    docs = [((None, 7, i)[i % 3], text) for i, text in repeating(seed)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert edges.same([tuple(r) for r in substring_dedup.passage_digests(df, 2).collect()], expected(docs))


def test_odd_documents(spark):
    docs = edges.frame(spark)
    want = expected([(i, t) for i, t, _, _ in edges.EDGES])
    assert edges.same([tuple(r) for r in substring_dedup.passage_digests(docs).collect()], want)
    assert substring_dedup.passage_digests(docs.limit(0)).count() == 0
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    got = [(r.doc_id, hashlib.sha256(" ".join(edges.words(r.text)).encode()).hexdigest()) for r in cut.collect()]
    assert edges.same(got, [(w[0], w[3]) for w in want])
    assert {(r.text is None, r.n_chars) for r in cut.where("text is null or n_chars is null").collect()} == {(True, None)}
    assert cut.where("n_chars <> length(text)").count() == 0


def test_query_against_brute_force(spark, bundled):
    docs = [tuple(r) for r in spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()]
    assert edges.same([tuple(r) for r in QUERIES["op4_substring_dedup"](spark, bundled).collect()], expected(docs))
