import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docstrata.llm import ngram_join
from docstrata.llm.queries import QUERIES
from tests.llm import edges

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = edges.words((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected(docs):
    """(doc_id, n_shingles, component) by comparing all texts that share a shingle."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, common = defaultdict(list), Counter()
    for row, (i, members) in enumerate(sets):
        if i is not None:
            for s in members:
                holders[s].append(row)
    for rows in holders.values():
        for x in range(len(rows)):
            for y in range(x):
                common[rows[y], rows[x]] += 1
    for (x, y), n in common.items():
        (i, a), (j, b) = sets[x], sets[y]
        if 100 * n >= 80 * (len(a) + len(b) - n):
            i, j = sorted((root(i), root(j)))
            parent[j] = i
    return [(i, len(members), None if i is None else root(i)) for i, members in sets]


def near_copies(seed=3):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[random.choice(vocabulary) for _ in range(random.choice([6, 30, 90, 200, 330]))] for _ in range(8)]
    docs = []
    for i in range(120):
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 1, 1, 2, 4, 8])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        if random.random() < 0.2:
            words += random.choice(bases)[:20]
        docs.append((i, " ".join(w.upper() if random.random() < 0.1 else w for w in words)))
    return docs


@pytest.mark.parametrize("block_rows", [1000, 4])
def test_components_against_brute_force(spark, block_rows):
    docs = near_copies() + [(500 + i, t) for i, t in near_copies()[:10]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert edges.same([tuple(r) for r in ngram_join.link_documents(df, block_rows).collect()], expected(docs))


def test_odd_documents(spark):
    docs = edges.frame(spark)
    got = [tuple(r) for r in ngram_join.link_documents(docs).collect()]
    assert edges.same(got, expected([(i, t) for i, t, _, _ in edges.EDGES]))
    assert ngram_join.link_documents(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    gone = {i for i, _, c in expected([(i, t) for i, t, _, _ in edges.EDGES]) if c != i}
    assert edges.same([tuple(r) for r in kept.collect()], [r for r in edges.rows() if r[0] is None or r[0] not in gone])


@pytest.mark.parametrize("block_rows", [1000, 3])
def test_texts_that_share_an_id(spark, block_rows):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(3, a), (7, a), (7, b), (9, b.replace("b30", "other")), (11, "one two three four five six")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert edges.same([tuple(r) for r in ngram_join.link_documents(df, block_rows).collect()], expected(docs))
    for seed in (5, 6):
        docs = [(i % 40, t) for i, t in near_copies(seed)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert edges.same([tuple(r) for r in ngram_join.link_documents(df, block_rows).collect()], expected(docs))


def test_order_of_shingles():
    rng = np.random.default_rng(8)
    hashes = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    order = ngram_join.Order(hashes[::7])
    sets = [np.sort(rng.choice(hashes, n, replace=False)) for n in (0, 1, 5, 200)] + [hashes[::7]]
    first = set(hashes[::7].tolist())
    for plain, (arranged, keys) in zip(sets, zip(*order.sorted(sets), strict=True), strict=True):
        assert arranged.tolist() == sorted(plain.tolist(), key=lambda h: (h in first, h))
        assert (np.diff(keys) > 0).all() and (keys >= 0).all()
    assert not ngram_join.Order(hashes[:0]).is_frequent(hashes).any()


def boilerplate(n, seed=9):
    """Texts of their own words around one passage, some of them near copies of another."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [[*(f"u{i}_{k}" for k in range(40)), passage, *(f"v{i}_{k}" for k in range(40))] for i in range(n)]
    for i in range(0, n, 10):
        texts[i] = list(texts[i // 2])
        texts[i][rng.randrange(30)] = "other"
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_a_common_passage_deals_out_few_rows(spark, monkeypatch):
    """The tree's rows grow with the documents, not with the square of those that share a passage."""
    monkeypatch.setattr(ngram_join, "SAMPLE_SHARE", 8)
    dealt, stored = {}, ngram_join.stored

    def counted(df, name, *args):
        out = stored(df, name, *args)
        if name == "shingles-groups":
            dealt[len(dealt)] = out.groupBy("key").count().agg({"count": "max"}).first()[0]
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    for n in (200, 600):
        docs = boilerplate(n)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert edges.same([tuple(r) for r in ngram_join.link_documents(df, 50).collect()], expected(docs))
    assert max(dealt.values()) < 30


def test_tree_loses_no_pair_that_may_link():
    random = np.random.default_rng(4)
    sizes = random.integers(5, 60, 200)
    vectors = np.stack([np.bincount(random.integers(0, 64, n), minlength=64) for n in sizes]).astype(np.int32)
    vectors[100:] = np.maximum(vectors[:100] + random.integers(-1, 2, (100, 64)) * (random.random((100, 64)) < 0.05), 0)
    sizes = vectors.sum(axis=1)
    parts = random.integers(0, 150, 200)
    rests = sizes - random.integers(0, np.maximum(sizes // 5, 1))
    a, b = ngram_join.CountTree(vectors, sizes, parts, rests).pairs()
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(200):
        for j in range(i):
            bound = np.minimum(vectors[i], vectors[j]).sum()
            fits = 9 * bound >= 4 * (sizes[i] + sizes[j]) and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])
            fits &= 9 * min(rests[i], rests[j]) >= 4 * (sizes[i] + sizes[j])
            assert ((j, i) in got) == (fits and parts[i] != parts[j])


def test_query_against_brute_force(spark, bundled):
    docs = [tuple(r) for r in spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()]
    assert edges.same([tuple(r) for r in QUERIES["op2_ngram_jaccard_join"](spark, bundled).collect()], expected(docs))
