import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from docstrata.llm import spelling_variants
from docstrata.llm.queries import QUERIES
from tests.llm import edges

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(docs, least_length=6, least_count=5, slip_every=0):
    out = Counter()
    for doc_id, text in docs:
        for word in LETTERS.findall(text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slip_every and h % slip_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def variants(words, ratio=5):
    """By a plain table of all words with one letter left out or masked."""
    slots, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            slots[w[:i] + "*" + w[i + 1 :]].add(w)
    for group in slots.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in words:
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return rows


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("chunk", [1 << 15, 40])
def test_near_words_are_those_of_the_definition(spark, chunk):
    random.seed(13)
    words = set()
    while len(words) < 700:
        w = "".join(random.choices("abcéñ", k=random.randint(6, 9)))
        words.add(w)
    words |= {"x" * 70, "x" * 71, "x" * 72, "y" + "x" * 69, "abcdefgh", "abcdefg", "abdcefgh", "éabcdef", "ùabcdef", "õabcdef"}
    words = {w: random.choice([5, 6, 24, 25, 125, 130, 3000]) for w in sorted(words)}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert edges.same(rows_of(spelling_variants.group_variants(table, chunk_bytes=chunk)), variants(words))


def test_forms_lead_to_roots(spark):
    words = {"abcdef" + "g" * k: 5 * 6**k for k in range(9)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(spelling_variants.group_variants(table))
    assert edges.same(got, variants(words)) and {r[2] for r in got} == {"abcdef" + "g" * 8}


@pytest.mark.parametrize("slip", [0, 3])
def test_odd_documents(spark, slip):
    texts = [*edges.EDGES, (30, "Écoute×ÉCOUTE écoute'colour Colour COLOUR colours" * 6, "fr", "s"), (31, "z" * 200 + " " + "z" * 199, "en", "s"), (32, "naïve日naïvesĀnaïve " * 9, "en", "s")]
    docs = edges.frame(spark, texts)
    words = spelling_variants.count_words(docs, 3, 1, slip)
    want = counted([(i, t) for i, t, _, _ in texts], 3, 1, slip)
    assert edges.same([tuple(r) for r in words.collect()], list(want.items()))
    assert edges.same(rows_of(spelling_variants.group_variants(words)), variants(want))
    empty = spelling_variants.count_words(docs.limit(0))
    assert empty.count() == 0 and spelling_variants.group_variants(empty).count() == 0


def test_a_very_long_text(spark):
    texts = [(1, "abcdefgh abcdefg " * 400_000, "en", "s"), (2, "q" * 3_000_000, "en", "s")]
    words = {r.word: r.n for r in spelling_variants.count_words(edges.frame(spark, texts), 6, 1).collect()}
    assert words == {"abcdefgh": 400_000, "abcdefg": 400_000, "q" * 3_000_000: 1}


def test_query(spark, bundled):
    docs = [tuple(r) for r in spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, bundled)
    assert edges.same(rows_of(got), variants(counted(docs, slip_every=199)))
