import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docstrata.llm import quality_rules
from docstrata.llm.queries import QUERIES
from tests.llm import edges


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = edges.words(text)
    lines = [x for x in text.split("\n") if edges.words(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            repeated.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_odd_documents(spark):
    docs = edges.frame(spark, [*edges.EDGES, (20, "a b c d e a b c d e f g\nx\n\nx", "en", "s"), (21, "w " * 9 + "#$ \x1c é", "en", "s")])
    judged = quality_rules.judge_documents(docs)
    want = [(i, *base(t)) for i, t, *_ in [tuple(r) for r in docs.collect()]]
    assert edges.same([tuple(r) for r in judged.select(*COLUMNS).collect()], want)
    assert judged.where("kept and base_failed").count() == 0
    assert quality_rules.judge_documents(docs.limit(0)).count() == 0
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == judged.where("kept").count()


def test_estimation_finds_the_good_rules(spark):
    """Votes drawn from known accuracies: the fit comes near them, and the posterior separates the classes."""
    random.seed(7)
    rows = []
    for _ in range(4000):
        good = random.random() < 0.8
        votes = []
        for _ in quality_rules.RULES:
            if random.random() < 0.2:
                votes.append(0)
            elif good:
                votes.append(1 if random.random() < 0.95 else -1)
            else:
                votes.append(-1 if random.random() < 0.7 else 1)
        rows.append((good, votes))
    voted = spark.createDataFrame(rows, "good boolean, votes array<tinyint>")
    prior, accuracy = quality_rules.fit(voted)
    assert abs(prior - 0.8) < 0.03
    assert all(abs(g - 0.95) < 0.03 and abs(b - 0.7) < 0.06 for g, b in accuracy)
    posterior = quality_rules._posterior(F.col("votes"), F.lit(prior), quality_rules._accuracies(accuracy))
    right = voted.where((posterior >= 0.5) == F.col("good")).count()
    assert right > 0.97 * len(rows)


def test_query_against_brute_force_and_labels(spark, bundled):
    docs = spark.read.parquet(f"{bundled}/documents.parquet").select("doc_id", "text").collect()
    result = QUERIES["op9_quality_rules"](spark, bundled)
    plan = result._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert edges.same([tuple(r) for r in result.select(*COLUMNS).collect()], [(i, *base(t)) for i, t in docs])
    rated = result.join(spark.read.parquet(f"{bundled}/labels.parquet"), "doc_id").where("not base_failed")
    assert rated.where("quality = 1 and kept").count() >= 0.95 * rated.where("quality = 1").count()
    assert rated.where("quality = 0 and not kept").count() >= 0.8 * rated.where("quality = 0").count()
