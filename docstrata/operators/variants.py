"""Shape variants: documents grouped by the set of paths they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.paths import sort_paths
from docstrata.options import ProfileOptions

# Path segments that make up a shape, characters of a signature shown.
SHAPE_SEGMENTS = 3
SHOWN_SIGNATURE = 8


def shape_paths(v: str = "v") -> Column:
    """Leaf paths of a document down to three segments, as a Column over the VARIANT `v`.

    Arrays are leaves, an object at the third segment is a leaf, `{}` has no path, keys are not
    escaped, an empty key at the root adds no segment and an empty path is never listed.
    """
    return F.expr(f"filter({_below(v, _quote(''), 1)}, p -> p <> '')")


def _quote(text: str) -> str:
    return f"'{text}'"


def _below(v: str, prefix: str, segment: int) -> str:
    e = f"e{segment}"
    path = f"if({prefix} = '', {e}.key, concat({prefix}, '.', {e}.key))"
    if segment == SHAPE_SEGMENTS:
        rows = f"array({path})"
    else:
        nested = f"try_variant_get({e}.value, '$', 'map<string,variant>')"
        inner = _below(f"{e}.value", path, segment + 1)
        opaque = f"{nested} is null or {_is_wrapper(nested)}"
        rows = f"if({opaque}, array({path}), {inner})"
    return f"flatten(transform(map_entries(try_variant_get({v}, '$', 'map<string,variant>')), {e} -> {rows}))"


def _is_wrapper(entries: str) -> str:
    from docstrata.operators.flatten import EXTENDED_TAGS

    known = ", ".join(f"'{k}'" for k in EXTENDED_TAGS)
    return f"(size({entries}) = 1 and map_keys({entries})[0] in ({known}))"


def shape_signature(paths: Column) -> Column:
    """SHA-256 of the sorted paths; independent of their order."""
    return F.sha2(F.array_join(sort_paths(paths), "|"), 256)


def shapes(documents: DataFrame) -> DataFrame:
    """One row per (collection, shape): signature, paths, count, first document.

    Documents meet as path lists, pre-aggregated per task, so a shape shared by most of the
    documents costs one row per task; hashing and sorting happen once per distinct list.
    """
    listed = documents.where("v is not null").select(
        "collection", "doc_id", F.coalesce(shape_paths("v"), F.array().cast("array<string>")).alias("paths")
    )
    per_list = listed.groupBy("collection", "paths").agg(
        F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("first_doc")
    )
    signed = per_list.withColumn("signature", shape_signature(F.col("paths")))
    return signed.groupBy("collection", "signature").agg(
        F.sum("count").alias("count"),
        F.min("first_doc").alias("first_doc"),
        F.min_by("paths", "first_doc").alias("paths"),
    )


def merge_shapes(*parts: DataFrame) -> DataFrame:
    """Add up the shapes of disjoint document sets, fresh or read back from a table: the shapes of them all."""
    union = parts[0]
    for other in parts[1:]:
        union = union.unionByName(other)
    return union.groupBy("collection", "signature").agg(
        F.sum("count").alias("count"), F.min("first_doc").alias("first_doc"), F.min_by("paths", "first_doc").alias("paths")
    )


def top_variants(shapes_: DataFrame, n: int) -> DataFrame:
    """The n most frequent shapes of each collection, first seen on ties, with rank and ratio.

    The rank is alone in its window, so that each task keeps its first n only before they meet; totals are a sum of their own.
    """
    order = Window.partitionBy("collection").orderBy(F.desc("count"), "first_doc", "signature")
    ranked = shapes_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    totals = shapes_.groupBy("collection").agg(F.sum("count").alias("docs"))
    return ranked.join(totals, "collection").withColumn("ratio", F.col("count") / F.col("docs")).drop("docs")


def variant_diff(variants: DataFrame) -> DataFrame:
    """Paths added and missing against the primary (rank 1) shape of the same collection."""
    primary = F.max(F.when(F.col("rank") == 1, F.col("paths"))).over(Window.partitionBy("collection"))
    return (
        variants.withColumn("primary_paths", primary)
        .withColumn("added", path_diff(F.col("primary_paths"), F.col("paths")))
        .withColumn("missing", path_diff(F.col("paths"), F.col("primary_paths")))
        .drop("primary_paths")
    )


def path_diff(base: Column, compare: Column) -> Column:
    """Paths of `compare` that `base` lacks, sorted."""
    return sort_paths(F.array_except(compare, base))


def shape_similarity(left: Column, right: Column) -> Column:
    """Shared share of two path sets; two empty sets are equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def similarity_to_primary(variants: DataFrame) -> DataFrame:
    primary = F.max(F.when(F.col("rank") == 1, F.col("paths"))).over(Window.partitionBy("collection"))
    return (
        variants.withColumn("primary_paths", primary)
        .withColumn("similarity", shape_similarity(F.col("primary_paths"), F.col("paths")))
        .drop("primary_paths")
    )


def variant_analysis(documents: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """variants(collection, rank, signature, short_signature, count, ratio, paths, added, missing)."""
    ranked = variant_diff(top_variants(shapes(documents), options.variant_top))
    return ranked.select(
        "collection",
        "rank",
        "signature",
        F.left("signature", F.lit(SHOWN_SIGNATURE)).alias("short_signature"),
        "count",
        "ratio",
        "paths",
        "added",
        "missing",
    )
