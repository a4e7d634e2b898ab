"""Foreign-key candidates and the fields that look related to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions.paths import last_segment

# Fixed value: endings of a field name that suggest a reference to another collection.
KEY_ENDINGS = r"(?i)(?:Id|_id|Uuid)\z"


def fk_candidates(fields: DataFrame) -> DataFrame:
    """Fields named like a key, as `collection.path`."""
    named = fields.select("collection", "path").where(last_segment(F.col("path")).rlike(KEY_ENDINGS))
    return named.withColumn("candidate", F.concat_ws(".", "collection", "path"))


def _pieces(name: Column) -> Column:
    """All distinct substrings of a short name."""
    size = F.length(name)
    starts = F.sequence(F.lit(1), size)
    return F.array_distinct(
        F.flatten(
            F.transform(
                starts,
                lambda a: F.transform(F.sequence(F.lit(1), size - a + 1), lambda n: F.substr(name, a, n)),
            )
        )
    )


def _key_pieces(name: Column) -> Column:
    """The distinct substrings of a name that end in "id", as every key name does: one per start before each such end."""
    ends = F.filter(F.sequence(F.lit(1), F.length(name)), lambda e: F.substr(name, e, F.lit(2)) == "id")
    return F.array_distinct(
        F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), e), lambda a: F.substr(name, a, e - a + 2))))
    )


def related_names(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, candidate_name) pairs where one name contains the other, ignoring case.

    Containment becomes equality: the substrings of the distinct names on one side are joined
    with the distinct names on the other, so no pair is formed that does not match. Of a field name only substrings that end
    like a key are made; all are of the key names, which are few.
    """
    names = fields.select(F.lower(last_segment(F.col("path"))).alias("name")).distinct()
    keys = candidates.select(F.lower(last_segment(F.col("path"))).alias("candidate_name")).distinct()
    name_pieces = names.select("name", F.explode(_key_pieces(F.col("name"))).alias("candidate_name"))
    name_holds = name_pieces.join(keys, "candidate_name")
    key_pieces = keys.select("candidate_name", F.explode(_pieces(F.col("candidate_name"))).alias("name"))
    key_holds = key_pieces.join(names, "name")
    return name_holds.select("name", "candidate_name").union(key_holds.select("name", "candidate_name")).distinct()


def fk_context(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """context(collection, path, context array): candidates related to each field, itself included.

    Lists are built once per distinct field name and attached to the fields of that name.
    """
    pairs = related_names(fields, candidates)
    keyed = candidates.select(F.lower(last_segment(F.col("path"))).alias("candidate_name"), "candidate")
    per_name = (
        pairs.join(keyed, "candidate_name")
        .groupBy("name")
        .agg(F.array_sort(F.collect_list("candidate")).alias("context"))
    )
    named = fields.select("collection", "path", F.lower(last_segment(F.col("path"))).alias("name"))
    empty = F.array().cast("array<string>")
    return named.join(per_name, "name", "left").select(
        "collection", "path", F.coalesce("context", empty).alias("context")
    )
