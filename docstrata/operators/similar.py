"""Similar path sets: all pairs of shapes, or of collections, whose Jaccard similarity reaches a threshold.

Comparing every shape with every other takes the square of their number. Two ways give candidates instead, and each pair
of them is compared on the whole sets:

* exact, by a prefix filter: with paths in a fixed order, rarest first, two sets of similarity t share one of the first
  `size - ceil(t size) + 1` paths of each. No pair is lost. Rare paths are in few sets, so few meet there.
* by MinHash bands: sets that agree in a band of minima meet. A pair of similarity s is found with probability
  1 - (1 - s^rows)^bands (see `band_recall`); the work follows the number of sets even if they share most of their paths.

Equal sets of one group meet as one row before any of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.operators.variants import shape_similarity

#: Rows that a group of candidates may have in one task; larger ones are cut into chunks that meet pair by pair.
CHUNK_ROWS = 1000


def collection_paths(fields: DataFrame) -> DataFrame:
    """sets(name, paths) of the fields(collection, path) of each collection."""
    return fields.groupBy(F.col("collection").alias("name")).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def shape_sets(shapes: DataFrame) -> DataFrame:
    """sets(name, paths) of shapes(collection, signature, paths): a shape is named by its signature, whatever collections have it."""
    return shapes.groupBy(F.col("signature").alias("name")).agg(F.min(F.array_sort("paths")).alias("paths"))


def _prefix_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, name, size) by the rarest paths of each set."""
    listed = sets.select("name", F.size("paths").alias("size"), F.explode("paths").alias("path"))
    frequency = listed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("name").orderBy("n", "path")
    ranked = listed.join(frequency, "path").withColumn("rank", F.row_number().over(order))
    # a share of a size that is whole but for rounding must not be rounded up
    first = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)) + 1
    return ranked.where(F.col("rank") <= first).select(F.xxhash64("path").alias("key"), "name", "size")


def _band_keys(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, name, size) by bands of minima over differently seeded hashes."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform("paths", lambda p: F.xxhash64(F.lit(seed), p)))

    minima = sets.where(F.size("paths") > 0).select("name", F.size("paths").alias("size"), F.array(*[least(i) for i in range(bands * rows)]).alias("m"))
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("m")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    return minima.select(F.explode(keys).alias("key"), "name", "size")


def _meeting(keys: DataFrame, threshold: float, chunk_rows: int) -> DataFrame:
    """Distinct pairs (a < b) of names that share a key and whose sizes allow the threshold.

    The rows of a key are dealt into chunks; every two chunks of it meet in a join of their own.
    """
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk_rows).cast("int")
    dealt = keys.join(counts, "key").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int"))
    left = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "chunk", F.col("name").alias("a"), F.col("size").alias("size_a"))
    right = dealt.select("key", F.col("chunk").alias("other"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("name").alias("b"), F.col("size").alias("size_b"))
    pairs = left.join(right, ["key", "chunk", "other"]).where("a < b")
    fits = F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - F.lit(1e-9)
    return pairs.where(fits).select("a", "b").distinct()


def similar_sets(
    sets: DataFrame, threshold: float, bands: int | None = None, rows: int = 4, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """sets(name, paths) -> (a, b, similarity) of all pairs a < b with at least `threshold`, above 0.

    Exact without `bands`; with them a pair is found with the probability that `band_recall` gives. Two empty sets are
    equal (similarity 1); an empty one and another have nothing in common. Null names take no part. `sets` is read several
    times; store it first where it is costly to make.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must lie in (0, 1], got {threshold}")
    sets = sets.where("name is not null").select("name", F.array_distinct("paths").alias("paths"))
    found = _prefix_keys(sets, threshold) if bands is None else _band_keys(sets, bands, rows)
    empty = sets.where(F.size("paths") == 0).select(F.lit(0).cast("bigint").alias("key"), "name", F.lit(0).alias("size"))
    pairs = _meeting(found.unionByName(empty), threshold, chunk_rows)
    of_a, of_b = (sets.select(F.col("name").alias(side), F.col("paths").alias(f"paths_{side}")) for side in "ab")
    compared = pairs.join(of_a, "a").join(of_b, "b").withColumn("similarity", shape_similarity(F.col("paths_a"), F.col("paths_b")))
    return compared.where(F.col("similarity") >= threshold - 1e-9).select("a", "b", "similarity")


def band_recall(similarity: float, bands: int, rows: int = 4) -> float:
    """The chance that a pair of this similarity shares a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(threshold: float, recall: float, rows: int = 4) -> int:
    """Bands needed to find pairs at the threshold with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
