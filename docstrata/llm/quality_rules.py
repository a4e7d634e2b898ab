"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them. Native functions only.

A document's statistics are row-local expressions over its whole text. Eight rules turn them into votes (1 keep, -1
reject, 0 abstain). Only counts per vote pattern, at most 3^8 rows, are needed to estimate each rule's accuracy in both
classes; the posterior of a pattern then replaces an all-must-pass filter.

Defined cases: a null or empty text has zero counts and fails the base rule (fewer than ten words). Repeated rows are
scored alike, each on its own. A text of any length is judged whole; no rule ranks rows, so there are no ties. An empty table gives an empty result. Columns beyond doc_id and text pass through `keep` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import stored, text_of

#: What the statistics count.
SYMBOLS = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

RULES = ("symbols_per_word", "symbols_per_char", "small_letters", "capitals", "marks", "lines", "repeats", "variety")
ROUNDS = 15
#: A good document trips few rules; a bad one trips some of them.
START_GOOD, START_BAD, START_PRIOR, SMOOTHING = 0.95, 0.5, 0.85, 2.0


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`, also inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more in the text; `hashes` of its words, in order."""

    windows = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)]),
    )

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(placed(windows), covered))

    def placed(windows: Column) -> Column:
        # positions, in order, of the windows that have an equal one: neighbours once sorted by hash
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def doubled(rows: Column) -> Column:
            same = F.filter(
                rows,
                lambda x, i: ((i > 0) & (F.get(rows, i - 1)["h"] == x["h"])) | F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        return _let(ordered, doubled)

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0),
            lambda total, n: total + n,
        )

    return F.when(F.size(hashes) < WINDOW + 1, F.lit(0)).otherwise(_let(windows, of_windows))


def statistics(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """doc_id and the statistics of every whole text; `keep` is carried along as `kept_row`."""
    text = F.col("t")
    base = docs.select(
        "doc_id",
        text_of(docs).alias("t"),
        *([keep.alias("kept_row")] if keep is not None else []),
    )
    carried = ["kept_row"] if keep is not None else []
    hashes = F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(SPACES)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    def of_lines(s: Column) -> Column:
        return F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    return base.select(
        "doc_id",
        *carried,
        _let(hashes, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        (F.length(text) - count(SPACE)).alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count(r"\p{Lu}").alias("n_capitals"),
        count(r"[^\p{L}\x20\x09-\x0D]").alias("n_other"),
    ).select(
        "doc_id", *carried, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct", "l.n_lines", "n_capitals", "n_other"
    )


def votes() -> dict[str, Column]:
    """Each rule's vote over the statistics: 1 keep, -1 reject, 0 abstain."""
    words, chars = F.col("n_words"), F.col("word_chars")

    def vote(reject: Column, accept: Column) -> Column:
        return F.when(reject, F.lit(-1)).when(accept, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")

    return {
        "symbols_per_word": vote(F.col("n_symbols") * 10 > words, F.col("n_symbols") * 50 <= words),
        "symbols_per_char": vote(F.col("n_symbols") * 50 > chars, F.col("n_symbols") * 200 <= chars),
        "small_letters": vote((F.col("n_other") + F.col("n_capitals")) * 4 > chars, (F.col("n_other") + F.col("n_capitals")) * 10 <= chars),
        "capitals": vote(F.col("n_capitals") * 4 > chars, F.col("n_capitals") * 10 <= chars),
        "marks": vote((F.col("n_other") - F.col("n_symbols")) * 10 > words * 8, (F.col("n_other") - F.col("n_symbols")) * 10 <= words * 4),
        "lines": vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 2)),
        "repeats": vote(F.col("n_repeat_words") * 10 > words * 2, F.col("n_repeat_words") * 20 <= words),
        "variety": vote((words >= 20) & (F.col("n_distinct") * 10 < words * 2), (words < 200) & (F.col("n_distinct") * 2 > words)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)


def _posterior(votes: Column, prior: Column, accuracy: Column) -> Column:
    """P(good | votes). accuracy, per rule: P(vote 1 | good, not abstaining) and P(vote -1 | bad, not abstaining)."""
    evidence = F.zip_with(
        votes,
        accuracy,
        lambda v, a: F.when(v == 1, F.log(a["good"] / (1 - a["bad"]))).when(v == -1, F.log((1 - a["good"]) / a["bad"])).otherwise(F.lit(0.0)),
    )
    odds = F.aggregate(evidence, F.log(prior / (1 - prior)), lambda total, e: total + e)
    return 1 / (1 + F.exp(-odds))


def _accuracies(pairs: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(g).alias("good"), F.lit(b).alias("bad")) for g, b in pairs])


def _round(patterns: Column, model: Column) -> Column:
    """One step of expectation-maximisation over (votes, n) patterns."""

    def maximise(weighed: Column) -> Column:
        def total(of) -> Column:
            return F.aggregate(weighed, F.lit(0.0), lambda t, x: t + of(x))

        def rule(r: Column) -> Column:
            def given(vote: int, weight: str) -> Column:
                return total(lambda x: F.when(F.get(x["votes"], r) == vote, x[weight]).otherwise(F.lit(0.0)))

            return F.struct(
                ((given(1, "good") + START_GOOD * SMOOTHING) / (given(1, "good") + given(-1, "good") + SMOOTHING)).alias("good"),
                ((given(-1, "bad") + START_BAD * SMOOTHING) / (given(1, "bad") + given(-1, "bad") + SMOOTHING)).alias("bad"),
            )

        good, bad = total(lambda x: x["good"]), total(lambda x: x["bad"])
        return F.struct(
            ((good + SMOOTHING) / (good + bad + 2 * SMOOTHING)).alias("prior"),
            F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), rule).alias("accuracy"),
        )

    def expect(x: Column) -> Column:
        return _let(
            _posterior(x["votes"], model["prior"], model["accuracy"]),
            lambda p: F.struct(x["votes"].alias("votes"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad")),
        )

    return _let(F.transform(patterns, expect), maximise)


def fit(voted: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over `votes`: a prior and two accuracies per rule.

    Documents are counted per vote pattern; the at most 3^8 patterns become one row, in which all rounds are folded. Only
    the model's 17 numbers reach the driver.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    start = F.struct(F.lit(START_PRIOR).alias("prior"), _accuracies([(START_GOOD, START_BAD)] * len(RULES)).alias("accuracy"))
    rows = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda model, _: _round(F.col("patterns"), model))
    model = rows.select(fold.alias("model")).first()["model"]
    return model["prior"], [(a["good"], a["bad"]) for a in model["accuracy"]]


def judge_documents(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """Statistics, votes, posterior and verdict of every document.

    The statistics are written once to the shared folder, then read narrow for the pattern counts and once for the verdict.
    """
    voted = stored(statistics(docs, keep).withColumn("votes", F.array(*votes().values())), "quality")
    prior, accuracy = fit(voted)
    return voted.withColumns({"base_failed": base_failed(), "posterior": _posterior(F.col("votes"), F.lit(prior), _accuracies(accuracy))}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all their columns, that the rules keep."""
    names = docs.columns
    judged = judge_documents(docs, F.struct(*[F.col(f"`{c}`") for c in names]))
    return judged.where("kept").select(*[F.col("kept_row")[c].alias(c) for c in names])
