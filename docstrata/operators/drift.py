"""Comparing a profile with an earlier one and carrying descriptions forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD = ["collection", "path"]


def schema_fingerprint(types: DataFrame) -> DataFrame:
    """types(collection, path, type) -> SHA-256 of each collection's observed schema.

    `path:type` entries are digested in buckets named by three hex characters of their own hash,
    and the fingerprint digests the bucket digests, so no task holds a whole schema.
    """
    entry = F.concat_ws(":", "path", "type")
    entries = types.select("collection", entry.alias("entry")).distinct()
    buckets = entries.groupBy("collection", F.left(F.sha2("entry", 256), F.lit(3)).alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "|"), 256).alias("digest")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda b: b["digest"])
    return buckets.groupBy("collection").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("fingerprint"))


def changed_collections(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fingerprints of two runs -> status of every collection."""
    b = before.select("collection", F.col("fingerprint").alias("before"))
    a = after.select("collection", F.col("fingerprint").alias("after"))
    status = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .when(F.col("before") != F.col("after"), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return b.join(a, "collection", "full_outer").select("collection", status.alias("status"))


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """types(collection, path, type) of two runs -> added, removed and type-changed paths."""

    def listed(types: DataFrame, name: str) -> DataFrame:
        # At most one entry per type tag.
        return types.groupBy(*FIELD).agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias(name))

    status = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .when(F.col("before") != F.col("after"), F.lit("type-changed"))
    )
    joined = listed(before, "before").join(listed(after, "after"), FIELD, "full_outer")
    return joined.withColumn("status", status).where(F.col("status").isNotNull())


def carry_descriptions(fields: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """Attach earlier descriptions(collection, path, description) to fields, unless forced anew."""
    if force:
        return fields.withColumn("description", F.lit(None).cast("string"))
    return fields.join(previous.select(*FIELD, "description"), FIELD, "left")


def fields_needing_description(wanted: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """Fields without an earlier description."""
    if force:
        return wanted
    known = previous.where("description is not null and description <> ''")
    return wanted.join(known.select(*FIELD), FIELD, "left_anti")


def removed_collections(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Collections only the earlier profile has, marked as preserved."""
    gone = previous.select("collection").distinct().join(current.select("collection").distinct(), "collection", "left_anti")
    return gone.withColumn("warnings", F.array(F.lit("Preserved from previous run")))


def keep_removed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current profile plus the earlier rows of collections that are gone (pruning off)."""
    gone = removed_collections(current, previous).select("collection")
    return current.unionByName(previous.join(gone, "collection", "left_semi"), allowMissingColumns=True)


def attach_catalog(profile: DataFrame, catalog: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Add est_count (0 when unknown) and, if given, the number of measured keys."""
    out = profile.join(catalog.select("collection", "est_count"), "collection", "left")
    out = out.withColumn("est_count", F.coalesce("est_count", F.lit(0)))
    if keys is None:
        return out
    per_collection = keys.groupBy("collection").agg(F.count(F.lit(1)).alias("key_count"))
    out = out.join(per_collection, "collection", "left")
    return out.withColumn("key_count", F.coalesce("key_count", F.lit(0)))
