import hashlib
import random
import zlib

import numpy as np
import pytest

from docstrata.llm import periodic_runs
from docstrata.llm.common import mix
from docstrata.llm.queries import QUERIES, with_planted_runs
from tests.llm import edges


def all_runs(words, least=12):
    """(start, length, period) by definition."""
    n, spans = len(words), {}
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            if j - i >= period:
                spans.setdefault((i, j + period), period)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in spans.items() if e - s >= max(least, 2 * p))


def found_runs(texts, least=12):
    hashes = mix(np.array([w for t in texts for w in t], np.uint64) + np.uint64(77))
    rows = periodic_runs.find_runs(hashes, np.array([len(t) for t in texts]), least)
    out = [[] for _ in texts]
    for text, *run in zip(*(c.tolist() for c in rows), strict=True):
        out[text].append(tuple(run))
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def planted(rng):
    """A text with stretches that repeat, some inside others, some with a word changed."""
    words = [rng.randrange(rng.choice([2, 3, 9, 500])) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(1, 4)):
        root = (words or [1])[-rng.randint(1, 40) :]
        if rng.random() < 0.4:
            inner = root[: rng.randint(1, 3)]
            root = inner * rng.randint(2, 20) + root[: rng.randint(0, 3)]
        words += root * rng.randint(1, 4) + root[: rng.randrange(len(root) + 1)]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = rng.randrange(5)
        words += [rng.randrange(500) for _ in range(rng.randint(0, 3))]
    return words[: rng.randint(1, 400)]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_are_those_of_the_definition(least):
    rng = random.Random(12)
    texts = [planted(rng) for _ in range(400)]
    texts += [[rng.randrange(k) for _ in range(rng.randint(0, 200))] for k in (1, 2, 2, 3, 4) for _ in range(30)]
    texts += [fibonacci(350), thue_morse(350), [0, 1] * 60 + [0] + [0, 1] * 60 + [0], ([0, 1] * 30 + [0]) * 3, ([0] * 40 + [1]) * 4, [0, 0, 1] * 50 + [0, 0, 1, 1] * 30]
    texts += [([0, 1, 2] * k + [0] * r) * m for k in (5, 12, 30) for r in (1, 2) for m in (2, 3, 4)]
    rng.shuffle(texts)
    for text, got in zip(texts, found_runs(texts, least), strict=True):
        assert got == all_runs(text, least), text


def test_long_texts():
    rng = random.Random(13)
    texts = []
    for q in (97, 500, 1999):
        root = [rng.randrange(3) for _ in range(q)]
        texts.append([7] * 5 + (root * 3)[: 2 * q + q // 3] + [8, 9])
        texts.append([rng.randrange(50) for _ in range(300)] + root * 2 + [5])
    half = [0, 1, 1] * 400 + [0, 1]
    texts.append(half * 2)
    for text, got in zip(texts, found_runs(texts), strict=True):
        assert got == all_runs(text)


def expected(doc_id, text):
    words, runs = edges.words(text), None
    runs = all_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def planted_text(doc_id, text):
    words, h = edges.words(text), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def test_odd_documents(spark):
    texts = [*edges.EDGES, (20, "a b\tc " * 9 + "d", "en", "s"), (21, "é ñ\x1c x " * 5, "en", "s"), (22, "u v w x y z u v w x y z", "en", "s")]
    texts = [(i, " ".join(t.split(" ")[:2500]) if t else t, a, b) for i, t, a, b in texts]
    docs = edges.frame(spark, texts)
    assert edges.same([tuple(r) for r in periodic_runs.run_digests(docs).collect()], [expected(i, t) for i, t, _, _ in texts])
    runs = [(i, *r) for i, t, _, _ in texts for r in all_runs(edges.words(t))]
    assert edges.same([tuple(r) for r in periodic_runs.periodic_runs(docs).collect()], runs)
    assert periodic_runs.run_digests(docs.limit(0)).count() == 0
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    root = " ".join(f"w{i * i % 7919}" for i in range(300_000))
    row = periodic_runs.run_digests(edges.frame(spark, [(1, f"first {root} {root} last " + "x y " * 100_000, "en", "s")])).collect()[0]
    assert row.n_runs >= 2 and (row.start, row.length, row.period) == (1, 600_000, 300_000) or row.period == 7919


def test_query(spark, bundled):
    docs = spark.read.parquet(f"{bundled}/documents.parquet").where("length(text) < 9000").select("doc_id", "text")
    texts = [(i, planted_text(i, t)) for i, t in (tuple(r) for r in docs.collect())]
    assert edges.same([(i, edges.words(t)) for i, t in (tuple(r) for r in with_planted_runs(docs).collect())], [(i, edges.words(t)) for i, t in texts])
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, bundled).collect()}
    assert len(got) == spark.read.parquet(f"{bundled}/documents.parquet").count()
    for doc_id, text in texts:
        assert got[doc_id] == expected(doc_id, text)
