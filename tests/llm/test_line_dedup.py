import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstrata.llm import line_dedup
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def changed(text, edits):
    text = list(text)
    for _ in range(edits):
        at = random.randrange(len(text) + 1)
        kind = random.choice("iud")
        if kind == "i":
            text.insert(at, random.choice("abcé"))
        elif text and kind == "u":
            text[min(at, len(text) - 1)] = random.choice("abcé")
        elif text:
            text.pop(min(at, len(text) - 1))
    return "".join(text)


def expected(docs):
    """(doc_id, n_lines, n_removed, removed numbers) by comparing all lines of like length."""
    places = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if edges.words(line):
                places.setdefault(line, []).append((2**63 - 1 if i is None else i, k))
    lines = sorted(places, key=len)
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(lines):
        for b in lines[n + 1 :]:
            if len(b) - len(a) > 2:
                break
            if len(a) >= 20 and root(a) != root(b) and distance(a, b) <= 2:
                parent[root(a)] = root(b)
    first = {}
    for x in lines:
        first[root(x)] = min(first.get(root(x), (2**63, 0)), min(places[x]))
    out = []
    for i, t in docs:
        found = [(k, x) for k, x in enumerate((t or "").split("\n")) if edges.words(x)]
        gone = [k for k, x in found if first[root(x)] != (2**63 - 1 if i is None else i, k)]
        out.append((i, len(found), len(gone), gone))
    return out


def test_edits_against_the_table_method():
    random.seed(1)
    lefts = ["".join(random.choices("abé", k=random.randint(0, 30))) for _ in range(800)]
    rights = [changed(a, random.randint(0, 4)) for a in lefts]
    assert line_dedup.within_edits(lefts, rights).tolist() == [distance(a, b) <= 2 for a, b in zip(lefts, rights, strict=True)]


def test_a_long_pair_is_verified_alone(monkeypatch):
    random.seed(4)
    texts = ["".join(random.choices("abc ", k=n)) for n in [30] * 600 + [30_000]]
    seen, edits = [], line_dedup.within_edits
    monkeypatch.setattr(line_dedup, "within_edits", lambda a, b: seen.append(len(a) * max(map(len, a + b))) or edits(a, b))
    batch = pa.RecordBatch.from_pydict({"a": range(601), "b": range(601), "text_a": texts, "text_b": [t[1:] + "d" for t in texts]})
    assert sum(part.num_rows for part in line_dedup._verified([batch])) == 601
    assert max(seen) <= line_dedup.POINTS


@pytest.mark.parametrize("group_rows", [2000, 3])
def test_lines_against_brute_force(spark, group_rows):
    random.seed(2)
    bases = ["".join(random.choices("abcdefgh ", k=random.randint(15, 60))) for _ in range(25)]
    docs = []
    for i in range(80):
        lines = [changed(random.choice(bases), random.choice([0, 0, 1, 2, 3, 5])) if random.random() < 0.8 else random.choice(["", "  ", "x", "short"]) for _ in range(random.randint(0, 5))]
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert edges.same([tuple(r) for r in line_dedup.line_decisions(df, group_rows).collect()], expected(docs))


def template_lines(n):
    return [f"Order {random.randrange(10**8):08d} has been shipped to the customer" for _ in range(n)]


def test_large_template_groups_against_brute_force(spark):
    random.seed(5)
    docs = [(i, x) for i, x in enumerate(template_lines(150) + [changed(x, 2) for x in template_lines(50) * 2])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert edges.same([tuple(r) for r in line_dedup.line_decisions(df, 10).collect()], expected(docs))


def test_no_cell_of_a_template_group_is_large(spark):
    random.seed(6)
    docs = spark.createDataFrame(list(enumerate(template_lines(2000))), "id long, t string").withColumn("tag", F.xxhash64("t"))
    dealt = docs.mapInArrow(line_dedup._segment_rows, "key long, line long, letters long, own boolean")
    texts = docs.mapInArrow(line_dedup._line_rows, "line long, id long, tag long, number int").join(docs, ["id", "tag"]).select("line", F.col("t").alias("text"))
    cells = line_dedup.cells(dealt.withColumnRenamed("key", "whole"), texts, 100)
    assert cells.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] <= 300
    # whole groups are met: each pair of a group once
    assert cells.where("i = j").groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > 300


def test_odd_documents(spark):
    docs = edges.frame(spark)
    want = expected([(i, t) for i, t, _, _ in edges.EDGES])
    assert edges.same([tuple(r) for r in line_dedup.line_decisions(docs).collect()], want)
    assert line_dedup.line_decisions(docs.limit(0)).count() == 0
    left = line_dedup.remove_lines(docs)
    assert left.columns == docs.columns
    assert left.where("n_chars <> length(text)").count() == 0
    assert edges.same([r.doc_id for r in left.collect()], [w[0] for w in want if w[1] == 0 or w[2] < w[1]])


def test_query_against_brute_force(spark, bundled):
    docs = [tuple(r) for r in spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()]
    assert edges.same([tuple(r) for r in QUERIES["op6_line_dedup"](spark, bundled).collect()], expected(docs))
