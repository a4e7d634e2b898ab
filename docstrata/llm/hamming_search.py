"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its coordinates, cut into segments of sixteen bits; every segment has an index from its
value to the codes that have it. A query probes all values at radius 0, 1, 2, ... of each of its m segments. A code within
distance m (r + 1) - 1 has some segment within radius r, so once radius r is done and the k-th nearest verified code lies
within that distance, the query is answered; only the others go on to the next radius.

Equal codes are one entry, with their k + 1 smallest ids: no answer needs more of them. Ties go to the smaller id.

Defined cases: rows with a null id, or a vector that is null, of another length or has a null or NaN coordinate, are
neither found nor queries. Rows with equal ids and vectors are one. A query is not its own neighbour. Fewer than k others
give fewer rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import stored

SEGMENT_BITS = 16


def _segments(vector: Column, dimensions: int) -> Column:
    """The signs of the coordinates as numbers, one per segment."""
    bits = F.transform(vector, lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)))
    return F.array(
        *[F.aggregate(F.slice(bits, at + 1, min(SEGMENT_BITS, dimensions - at)), F.lit(0), lambda code, bit: code * 2 + bit) for at in range(0, dimensions, SEGMENT_BITS)]
    )


def binary_codes(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int) -> DataFrame:
    """(id, code) of the rows that have one; code: an array of segments."""
    vector = F.col(vector_column)
    whole = F.coalesce(F.size(vector) == dimensions, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    rows = vectors.where(F.col(id_column).isNotNull() & whole)
    return rows.select(F.col(id_column).cast("long").alias("id"), _segments(vector, dimensions).alias("code")).distinct()


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int, dimensions: int) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) of the k nearest codes (id, code) of every query (id, code)."""
    spark = codes.sparkSession
    widths = [min(SEGMENT_BITS, dimensions - at) for at in range(0, dimensions, SEGMENT_BITS)]
    # Spark limits each task's rows of a code before they are shuffled
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = codes.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = stored(entries.select("code", "ids", F.posexplode("code").alias("segment", "value")), "hamming-index")
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query_code"))
    waiting, best, answers = stored(asked, "hamming-queries"), None, None
    nearest = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")

    for radius in range(max(widths) + 1):
        # C(16, radius) masks at most, whatever the tables
        masks = [(s, sum(1 << b for b in chosen)) for s, width in enumerate(widths) for chosen in combinations(range(width), radius)]
        if not masks:
            break
        masks = spark.createDataFrame(masks, "segment int, mask int")
        probes = waiting.select("query_id", "query_code", F.posexplode("query_code").alias("segment", "own"))
        probes = probes.join(F.broadcast(masks), "segment").select("query_id", "query_code", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(index, ["segment", "value"]).select("query_id", _distance("query_code", "code").alias("distance"), "ids")
        met = met.select("query_id", "distance", F.explode("ids").alias("neighbor_id")).where("query_id <> neighbor_id").distinct()
        if best is not None:
            met = met.union(best).distinct()
        ranked = stored(met.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k), "hamming-best")
        covered = len(widths) * (radius + 1) - 1
        done = ranked.where((F.col("rank") == k) & (F.col("distance") <= covered)).select("query_id")
        last = radius == max(widths)
        found = ranked if last else ranked.join(done, "query_id", "left_semi")
        answers = found if answers is None else answers.union(found)
        waiting = stored(waiting.join(done, "query_id", "left_anti"), "hamming-queries")
        if last or waiting.isEmpty():
            break
        best = ranked.join(done, "query_id", "left_anti").select("query_id", "distance", "neighbor_id")
    return answers.select("query_id", "neighbor_id", "distance", "rank")


def search_vectors(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = 64) -> DataFrame:
    """The k nearest rows of every row for which `is_query` (over its `id`) holds."""
    codes = stored(binary_codes(vectors, id_column, vector_column, dimensions), "hamming-codes")
    return nearest_codes(codes, codes.where(is_query), k, dimensions)
