"""Field tree: fields nested by path segment, array levels folded into their parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions.paths import WILDCARD, split_path
from docstrata.session import cut_lineage

_SEPARATOR = "\x01"


def _folded(segments: Column) -> Column:
    return F.filter(segments, lambda s: s != WILDCARD)


def _lifts(segments: Column) -> Column:
    """For every plain segment: how many `[*]` stand directly before it."""
    start = F.struct(F.array().cast("array<int>").alias("lifts"), F.lit(0).alias("run"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == WILDCARD, F.struct(acc["lifts"].alias("lifts"), (acc["run"] + 1).alias("run"))).otherwise(
            F.struct(F.concat(acc["lifts"], F.array(acc["run"])).alias("lifts"), F.lit(0).alias("run"))
        )

    return F.aggregate(segments, start, step, lambda acc: acc["lifts"])


def _node_key(segments: Column) -> Column:
    return F.array_join(segments, _SEPARATOR)


def field_tree(fields: DataFrame) -> DataFrame:
    """fields(collection, path) -> nodes, including parents that are no field themselves.

    A node reached both directly and through `[*]` is taken from the way with fewer `[*]` at the
    first place they differ; the other way is dropped with everything below it.
    Columns: collection, full_path, segment, segments, depth, has_field, rowspan, order_key.
    """
    raw = fields.select("collection", F.col("path").alias("field_path"), split_path(F.col("path")).alias("raw"))
    levels = F.transform(F.sequence(F.lit(1), F.size("raw")), lambda i: F.slice("raw", F.lit(1), i))
    prefixes = raw.where(F.size("raw") > 0).select("collection", "field_path", F.explode(levels).alias("raw"))
    prefixes = prefixes.where(F.element_at("raw", -1) != WILDCARD)
    ways = prefixes.groupBy("collection", "raw").agg(
        F.bool_or(F.array_join("raw", ".") == F.col("field_path")).alias("has_field")
    )
    ways = ways.withColumn("segments", _folded(F.col("raw"))).withColumn("lifts", _lifts(F.col("raw")))
    best = ways.groupBy("collection", _node_key(F.col("segments")).alias("node")).agg(
        F.min(F.struct("lifts", "segments", "raw", "has_field")).alias("way")
    )
    # One row per field from here on, and read several times.
    best = cut_lineage(best.select("collection", "node", "way.*"))
    # A way survives if each of its ancestors was chosen by the same way.
    steps = F.transform(
        F.sequence(F.lit(1), F.size("segments")),
        lambda i: F.struct(
            _node_key(F.slice("segments", F.lit(1), i)).alias("above"),
            F.slice("lifts", F.lit(1), i).alias("lifts_above"),
        ),
    )
    climbed = best.select("collection", "node", F.inline(steps))
    chosen = best.select("collection", F.col("node").alias("above"), F.col("lifts").alias("lifts_chosen"))
    kept = (
        climbed.join(chosen, ["collection", "above"])
        .groupBy("collection", "node")
        .agg(F.bool_and(F.col("lifts_above") == F.col("lifts_chosen")).alias("kept"))
        .where("kept")
    )
    nodes = cut_lineage(best.join(kept.select("collection", "node"), ["collection", "node"], "left_semi"))
    nodes = nodes.join(subtree_rows(nodes), ["collection", "node"], "left")
    return nodes.select(
        "collection",
        F.array_join("raw", ".").alias("full_path"),
        F.element_at("segments", -1).alias("segment"),
        "segments",
        F.size("segments").alias("depth"),
        "has_field",
        F.greatest(F.coalesce("field_rows", F.lit(0)), F.lit(1)).cast("int").alias("rowspan"),
        _node_key(F.transform("segments", lambda s: F.lower(s))).alias("order_key"),
    )


def subtree_rows(nodes: DataFrame) -> DataFrame:
    """Fields in the subtree of every node, itself included."""
    levels = F.transform(
        F.sequence(F.lit(1), F.size("segments")), lambda i: _node_key(F.slice("segments", F.lit(1), i))
    )
    return (
        nodes.where("has_field")
        .select("collection", F.explode(levels).alias("node"))
        .groupBy("collection", "node")
        .agg(F.count(F.lit(1)).alias("field_rows"))
    )


def tree_preorder(tree: DataFrame) -> DataFrame:
    """Nodes parent first, siblings by name: segment-wise order is depth-first order."""
    return tree.orderBy("collection", "order_key", "full_path")
