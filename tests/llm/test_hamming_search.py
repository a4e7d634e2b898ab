import random

import pytest
from pyspark.sql import functions as F

from docstrata.llm import hamming_search
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def expected(vectors, asked, k, dimensions):
    codes = {
        (i, tuple(x > 0 for x in v)) for i, v in vectors if i is not None and v is not None and len(v) == dimensions and all(x is not None and x == x for x in v)
    }
    out = []
    for q, a in codes:
        if asked(q):
            near = sorted({(sum(x != y for x, y in zip(a, b, strict=True)), i) for i, b in codes if i != q})[:k]
            out += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("dimensions", [64, 40, 8])
def test_nearest_against_brute_force(spark, dimensions):
    random.seed(dimensions)
    centres = [[random.gauss(0, 1) for _ in range(dimensions)] for _ in range(6)]
    vectors = [(i, [x + random.gauss(0, 0.4) for x in random.choice(centres)]) for i in range(400)]
    # many rows of one code
    vectors += [(1000 + i, centres[0]) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    got = hamming_search.search_vectors(df, F.col("id") % 50 == 0, 5, dimensions=dimensions)
    assert edges.same([tuple(r) for r in got.collect()], expected(vectors, lambda i: i % 50 == 0, 5, dimensions))


def test_odd_vectors(spark):
    whole = [0.5, -1.0] * 8
    vectors = [(0, whole), (0, whole), (1, whole), (2, None), (None, whole), (3, whole[:5]), (4, [None, *whole[1:]]), (5, [float("nan"), *whole[1:]]), (50, [-x for x in whole]), (6, [0.0] * 16)]
    df = spark.createDataFrame([(*v, "x", 1, 2) for v in vectors], "vec_id long, embedding array<float>, code string, id int, segment int")
    got = hamming_search.search_vectors(df, F.col("id") % 50 == 0, 10, dimensions=16)
    assert edges.same([tuple(r) for r in got.collect()], expected(vectors, lambda i: i % 50 == 0, 10, 16))
    assert hamming_search.search_vectors(df.limit(0), F.col("id") % 50 == 0, 10, dimensions=16).count() == 0


def test_query_against_brute_force(spark, bundled):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{bundled}/embeddings.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op5_hamming_search"](spark, bundled).collect()]
    assert edges.same(got, expected(vectors, lambda i: i % 50 == 0, 10, 64))
