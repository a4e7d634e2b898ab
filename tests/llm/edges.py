"""Documents with everything that can be odd about them, and plain helpers to compare with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, key int, tag long, bucket int"

PASSAGE = " ".join(f"word{i}" for i in range(40))
EDGES = [
    (1, None, "en", None),
    (2, "", None, "s"),
    (3, " \t\n  \x0b", "en", "s"),
    (4, "one two", "en", "s"),
    (5, "one two", "en", "s"),
    (6, PASSAGE + " and the end of it", "en", "s"),
    (7, "before it " + PASSAGE + " and after", "de", "s"),
    (7, "the same id, another text " + PASSAGE, "de", "s"),
    (8, "twice " + PASSAGE + " x " + PASSAGE, "de", "s"),
    (9, "équipe naïve \U0001f600 日本 ▁ <s> <|endoftext|>   x y\n\nÉ", "fr", "s"),
    (None, PASSAGE + " and the end of it", None, None),
    (None, None, None, None),
    (10, "long " * 3000 + PASSAGE, "en", "s"),
    (11, "x" * 20000, "en", "s"),
    (12, "one two", "en", "s"),
    (12, "one two", "en", "s"),
]


def rows(texts=EDGES):
    """With extra columns whose names the operators use themselves."""
    return [(i, t, lang, source, None if t is None else len(t), "r", "t", 1, 2, 3) for i, t, lang, source in texts]


def frame(spark, texts=EDGES):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")


def same(got, want):
    """Equal as multisets, nulls included."""
    return sorted(map(repr, got)) == sorted(map(repr, want))
