"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the whole text scores a document; ordered thresholds turn the score into
P(grade >= k) = logistic(score - threshold k), hence an expected grade and the tail probability that selection uses.
Features are the distinct words (runs of letters, lower case), their beginnings of four and five bytes, and buckets of a few
shares (distinct words, capitals, marks, symbols), each present or not.

The model is fitted in one task on a bounded sample, the `sample_rows` labelled documents of least hash; the fit reads
nothing else. Every document is scored by the same 2^`bits` weights, a table of fixed size.

Defined cases: labels with a null id or null ratings are not used; different grades of one id all count, and of texts that share
an id the one of least hash is learned. Null and empty texts have the bucket features alone. Without labels all weights are
zero and nothing is selected. A document is selected if its chance of the top grade is above one half; at one half exactly it
is not. Repeated rows are scored alike. A text of any length is read whole. An empty table gives an empty result. Other columns
pass through `select_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import Words, mix, slices, text_of

BITS = 20
SAMPLE_ROWS = 20_000
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.1, 1e-4
#: A feature counts if it goes with some grade beyond so many standard deviations of chance: by the logarithm of the rows
#: divided by the second number, since few rows cannot deviate far, and no more than the first.
MOST_DEVIATION, DEVIATION_SCALE = 6.0, 1.5
#: Letters are ASCII letters and every byte of a code point beyond ASCII.
NO_LETTER = ~np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
CAPITAL = np.isin(np.arange(256), range(65, 91))
MARK = np.isin(np.arange(256), list(b".,;:!?"))
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@^~=+_{}[]\\"))


def grade(quality: Column, toxic: Column) -> Column:
    """0 poor, 1 well written but toxic, 2 good."""
    return F.when(quality == 0, F.lit(0)).when(toxic == 1, F.lit(1)).otherwise(F.lit(2))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first place of each text): the distinct features of each text."""
    words = Words(texts, lower=True, parting=NO_LETTER)
    text = np.repeat(np.arange(len(texts)), words.counts)
    # a text's distinct words, by one of their places
    order = np.lexsort((words.hashes, text))
    first = np.ones(len(order), bool)
    first[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    chosen = order[first]
    distinct = np.bincount(text[chosen], minlength=len(texts))
    owners, hashes = [text[chosen]], [words.hashes[chosen]]
    starts, sizes = words.starts[chosen], (words.ends - words.starts)[chosen]
    beginning = np.zeros(len(chosen), np.uint64)
    for k in range(5):
        has = sizes > k
        byte = words.data[np.where(has, starts + k, 0)] if len(words.data) else np.zeros(0, np.uint8)
        beginning = beginning * np.uint64(257) + np.where(has, byte.astype(np.uint64) + np.uint64(1), np.uint64(0))
        if k >= 3:
            owners.append(text[chosen])
            hashes.append(mix(beginning * np.uint64(5) + np.uint64(k)))
    raw = Words(texts).data
    at = words.text_at
    letters = np.maximum(words.word_at[1:] - words.word_at[:-1], 1)
    for number, (kind, whole) in enumerate(((CAPITAL, 4), (MARK, 1), (SYMBOL, 1))):
        sums = np.concatenate([[0], np.cumsum(kind[raw])])
        share = (sums[at[1:]] - sums[at[:-1]]) / (letters * whole)
        owners.append(np.arange(len(texts)))
        hashes.append(mix(np.minimum(share * 10, 12).astype(np.uint64) + np.uint64(1000 * (number + 1))))
    owners += [np.arange(len(texts))] * 2
    hashes.append(mix((10 * distinct / letters).astype(np.uint64) + np.uint64(5000)))
    hashes.append(mix(np.log2(letters).astype(np.uint64) + np.uint64(6000)))
    code = (np.concatenate(owners).astype(np.uint64) << np.uint64(bits)) | (mix(np.concatenate(hashes)) >> np.uint64(64 - bits))
    code = np.unique(code)
    places = np.searchsorted(code, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(bits))
    return (code & np.uint64(2**bits - 1)).astype(np.int32), places


def _feature_rows(bits: int):
    def run(batches):
        for batch in batches:
            for part in slices([batch], "t"):
                found, places = features(part.column("t"), bits)
                lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("order", "grade", "tag")], lists], ["order", "grade", "tag", "features"])

    return run


def least_deviation(rows: int) -> float:
    return min(MOST_DEVIATION, np.log(max(rows, 2)) / DEVIATION_SCALE)


def likelihood_steps(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of each row's log-likelihood: by its score, and by every threshold."""
    bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
    above, beyond = (1 / (1 + np.exp(-np.clip(score - bounds[grades + k], -60, 60))) for k in (0, 1))
    chance = np.maximum(above - beyond, 1e-9)
    by_bound = np.zeros((len(score), len(bounds)))
    rows = np.arange(len(score))
    by_bound[rows, grades] = -above * (1 - above) / chance
    by_bound[rows, grades + 1] += beyond * (1 - beyond) / chance
    return 1 - above - beyond, by_bound[:, 1:-1]


def fit(grades: np.ndarray, found: np.ndarray, places: np.ndarray, top: int, bits: int, seed: int = 3) -> Model:
    """Adaptive gradient steps on the log-likelihood of the grades 0 to `top`, rare grades weighing more.

    Every row takes part: one whose features go with no grade has the score 0, and thresholds start at the grades' shares,
    so that without informative features a document gets the shares as its chances. Other features keep the weight zero.
    """
    n = len(grades)
    owner = np.repeat(np.arange(n), np.diff(places))
    counts = np.bincount(grades, minlength=top + 1)
    share = counts / n
    weight = np.maximum(share, 1e-3) ** -0.25
    seen, useful = np.bincount(found, minlength=2**bits), np.zeros(2**bits, bool)
    for k in range(top + 1):
        expected = seen * share[k]
        useful |= np.abs(np.bincount(found, grades[owner] == k, 2**bits) - expected) > least_deviation(n) * np.sqrt(expected * (1 - share[k]) + 1e-9)
    # what occurs once says nothing
    kept = (useful & (seen > 1))[found]
    found, places = found[kept], np.concatenate([[0], np.cumsum(kept)])[places]
    weights, squares = np.zeros(2**bits, np.float32), np.full(2**bits, 1e-3, np.float32)
    # thresholds are a first one and positive gaps, so that they stay in order; half a row is added to each grade
    low = np.cumsum(counts + 0.5)[:-1]
    start = np.log(low / (n + 0.5 * (top + 1) - low))
    place, place_squares = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))]), np.full(top, 1e-3)
    random = np.random.default_rng(seed)

    def thresholds() -> np.ndarray:
        return place[0] + np.concatenate([[0.0], np.cumsum(np.exp(place[1:]))])

    for _ in range(EPOCHS if kept.any() else 0):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            sizes = places[rows + 1] - places[rows]
            each = found[np.repeat(places[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            row = np.repeat(np.arange(len(rows)), sizes)
            slope, of_bounds = likelihood_steps(np.bincount(row, weights[each], len(rows)), thresholds(), grades[rows])
            rows_weight = weight[grades[rows]] / len(rows)
            which, back = np.unique(each, return_inverse=True)
            gradient = np.bincount(back, (slope * rows_weight)[row], len(which)).astype(np.float32) - DECAY * weights[which]
            squares[which] += gradient**2
            weights[which] += RATE * gradient / np.sqrt(squares[which])
            of_bounds = rows_weight @ of_bounds
            step = np.concatenate([[of_bounds.sum()], [of_bounds[k:].sum() * np.exp(place[k]) for k in range(1, top)]])
            place_squares += step**2
            place += RATE * step / np.sqrt(place_squares)
    return Model(weights, thresholds())


def _fit_rows(top: int, bits: int):
    def run(batches):
        rows = pa.Table.from_batches(list(batches), pa.schema([("order", pa.int64()), ("grade", pa.int32()), ("features", pa.list_(pa.int32()))]))
        if not rows.num_rows:
            model = Model(np.zeros(2**bits, np.float32), np.arange(top) + 10.0)
        else:
            rows = rows.sort_by([("order", "ascending"), ("grade", "ascending")]).combine_chunks()
            lists = rows.column("features").chunk(0)
            model = fit(rows.column("grade").to_numpy(), lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64), top, bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.thresholds.tolist()])], ["weights", "thresholds"])

    return run


def train(docs: DataFrame, rated: DataFrame, top: int = 2, sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> Model:
    """`rated`: doc_id and grade (0 to `top`). The model of at most `sample_rows` rated documents; it alone reaches the driver."""
    sample = rated.where("doc_id is not null and grade is not null").select("doc_id", F.col("grade").cast("int").alias("grade"), F.xxhash64(F.lit(11), "doc_id").alias("order"))
    sample = sample.orderBy("order", "doc_id", "grade").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("t"))
    # at most sample_rows rows of three numbers
    rows = texts.join(F.broadcast(sample), "doc_id").select("order", "grade", F.xxhash64("t").alias("tag"), "t")
    rows = rows.mapInArrow(_feature_rows(bits), "order long, grade int, tag long, features array<int>")
    rows = rows.groupBy("order", "grade").agg(F.min_by("features", "tag").alias("features"))
    row = rows.repartition(1).mapInArrow(_fit_rows(top, bits), "weights binary, thresholds array<double>").first()
    return Model(np.frombuffer(bytes(row["weights"]), np.float32), np.array(row["thresholds"]))


def _score_rows(model, bits: int, carried: list[str]):
    def run(batches):
        fitted = model.value
        for batch in batches:
            for part in slices([batch], "t"):
                found, places = features(part.column("t"), bits)
                tails = fitted.tails(np.add.reduceat(fitted.weights[found], places[:-1]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*carried, "expected_grade", "top_probability"])

    return run


def score_documents(docs: DataFrame, model: Model, carry: Column | None = None, bits: int = BITS) -> DataFrame:
    """doc_id, expected_grade, top_probability (and `carry` as `row`) of every whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("t"), *([carry.alias("row")] if carry is not None else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in texts.columns if c != "t"]
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in carried)
    return texts.mapInArrow(_score_rows(shared, bits, carried), f"{schema}, expected_grade double, top_probability double")


def select_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """All columns of the rows whose probability of the top grade reaches `least`."""
    scored = score_documents(docs, model, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return scored.where(F.col("top_probability") > least).select(*[F.col("row")[c].alias(c) for c in docs.columns])
