"""Reading documents and describing the collections they come from."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ids given to rows without one, where ids are whole numbers: upward from the least.
_LEAST_ID = -(2**63)


def document_id(df: DataFrame, doc_id: str) -> Column:
    """The id of each row; a row without one gets an id of its own from its place in the table.

    Statistics count documents by id, so rows must not share a null. Places are those of a scan, the same each time it is read.
    """
    column, kind = F.col(f"`{doc_id}`"), df.schema[doc_id].dataType
    place = F.monotonically_increasing_id()
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(column.cast("bigint"), F.lit(_LEAST_ID).cast("bigint") + place)
    if isinstance(kind, T.StringType):
        return F.coalesce(column, F.concat(F.lit("row:"), place.cast("string")))
    return column


def documents_from_json(df: DataFrame, collection: str, doc_id: str, json: str) -> DataFrame:
    """Parse a JSON text column. Text that does not parse becomes a NULL document (see `rejected_documents`).

    Of a member that is named twice the last one counts, in sessions that set spark.sql.variant.allowDuplicateKeys as
    `local_session` does; otherwise such text does not parse.
    """
    return df.select(
        F.lit(collection).alias("collection"),
        document_id(df, doc_id).alias("doc_id"),
        F.try_parse_json(F.col(json)).alias("v"),
    )


def documents_from_table(df: DataFrame, collection: str, doc_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn the rows of a typed table into documents of all or some columns; their types survive in the VARIANT.

    `flatten_table` gives the path rows of such documents without them.
    """
    return df.select(
        F.lit(collection).alias("collection"),
        document_id(df, doc_id).alias("doc_id"),
        F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns])).alias("v"),
    )


def read_documents(spark: SparkSession, path: str, collection: str, file_format: str = "json", doc_id: str = "_id",
                   **options: str) -> DataFrame:
    """Documents of one collection from files: JSON lines keep their own shape, tables become objects.

    JSON documents are keyed by the text of their `doc_id` member, those without one by their file and place in it.
    """
    if file_format == "json":
        raw = spark.read.options(singleVariantColumn="v", **options).json(path)
        place = F.concat_ws(":", F.lit("row"), F.col("_metadata.file_name"), F.monotonically_increasing_id())
        key = F.coalesce(F.expr(f"try_variant_get(v, '$.{doc_id}', 'string')"), place)
        return raw.select(F.lit(collection).alias("collection"), key.alias("doc_id"), "v")
    return documents_from_table(spark.read.format(file_format).options(**options).load(path), collection, doc_id)


def rejected_documents(documents: DataFrame) -> DataFrame:
    """Documents that did not parse, per collection with any; they are left out of totals and shapes."""
    counts = documents.groupBy("collection").agg(F.count_if(F.col("v").isNull()).alias("rejected"), F.count(F.lit(1)).alias("documents"))
    return counts.where("rejected > 0")


def duplicate_ids(documents: DataFrame) -> DataFrame:
    """Ids that several documents of a collection share; a profile would take these for one document."""
    return documents.groupBy("collection", "doc_id").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")


def count_corrupt(df: DataFrame, json: str) -> DataFrame:
    """How many rows of a JSON text column do not parse (and are therefore not profiled)."""
    bad = F.col(json).isNotNull() & F.try_parse_json(F.col(json)).isNull()
    return df.agg(F.count_if(bad).alias("corrupt"), F.count(F.lit(1)).alias("rows"))


# --- catalog ---------------------------------------------------------------------------------


def catalog_scan(collections: Mapping[str, DataFrame], include: str | None = None, exclude: str | None = None) -> DataFrame:
    """catalog(collection, est_count) of the collections passing the filter, by name.

    Counting a Parquet table reads row-group footers only.
    """
    kept = [(name, df) for name, df in collections.items() if matches_filter(name, include, exclude)]
    spark = next(iter(collections.values())).sparkSession
    if not kept:
        return spark.createDataFrame([], "collection string, est_count bigint")
    counted = [
        df.agg(F.count(F.lit(1)).alias("est_count")).select(F.lit(name).alias("collection"), "est_count")
        for name, df in kept
    ]
    union = counted[0]
    for one in counted[1:]:
        union = union.unionByName(one)
    return union.orderBy("collection")


def matches_filter(name: str, include: str | None, exclude: str | None) -> bool:
    if name.startswith("system."):
        return False
    if include and not re.fullmatch(glob_to_regex(include), name):
        return False
    return not (exclude and re.fullmatch(glob_to_regex(exclude), name))


def filter_collections(catalog: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """The same filter over a catalog table."""
    name = F.col("collection")
    kept: Column = ~F.startswith(name, F.lit("system."))
    if include:
        kept = kept & name.rlike(rf"\A(?:{glob_to_regex(include)})\z")
    if exclude:
        kept = kept & ~name.rlike(rf"\A(?:{glob_to_regex(exclude)})\z")
    return catalog.where(kept)


def glob_to_regex(glob: str) -> str:
    """`*`, `?`, `[abc]`, `[!abc]` and `{a,b}` of a file-name pattern as a regular expression.

    A leading wildcard does not match a leading dot, and `/` is never matched by one.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("(?!\\.)[^/]*" if i == 0 else "[^/]*")
        elif c == "?":
            out.append("(?!\\.)[^/]" if i == 0 else "[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[^" + body[1:] + "]" if body[0] in "!^" else "[" + body + "]")
            i = end
        elif c == "{" and "}" in glob[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def key_estimates(df: DataFrame, keys: Mapping[str, Sequence[str]], precision: int = 14) -> DataFrame:
    """One row of sketches: per candidate key the rows with all parts present, the absent rows and a HyperLogLog sketch.

    All keys are screened in one scan, with map-side merging. Rows of disjoint sets of rows are merged by `merge_estimates`.
    """
    columns = [F.count(F.lit(1)).alias("rows")]
    for i, parts in enumerate(keys.values()):
        present = _all_present(parts)
        # parts are told apart and typed; equal hashes of different keys are beyond a sketch's error
        value = F.xxhash64(*[F.col(c) for c in parts])
        columns += [F.count_if(present).alias(f"present_{i}"), F.hll_sketch_agg(F.when(present, value), F.lit(precision)).alias(f"sketch_{i}")]
    return df.agg(*columns)


def merge_estimates(*parts: DataFrame) -> DataFrame:
    """The sketches of all rows from those of disjoint sets of them, fresh or read back from a table."""
    union = parts[0]
    for other in parts[1:]:
        union = union.unionByName(other)
    merged = [F.hll_union_agg(c).alias(c) if c.startswith("sketch_") else F.sum(c).alias(c) for c in union.columns]
    return union.agg(*merged)


def spelled_estimates(estimates: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """keys(name, keys, rows, absent, estimate) from a row of sketches."""
    listed = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(_spelled(parts)).alias("keys"),
            "rows",
            (F.col("rows") - F.col(f"present_{i}")).alias("absent"),
            F.col(f"present_{i}").alias("present"),
            F.hll_sketch_estimate(f"sketch_{i}").alias("estimate"),
        )
        for i, (name, parts) in enumerate(keys.items())
    ]
    return estimates.select(F.inline(F.array(*listed)))


def screened_keys(df: DataFrame, keys: Mapping[str, Sequence[str]], precision: int = 14, margin: float = 4.0) -> DataFrame:
    """name, keys, rows, absent, unique of every candidate key; only those that may be unique are grouped exactly.

    A sketch of 2^p buckets is off by 1.04 / sqrt(2^p) as a rule. A key whose estimate stays `margin` times that below its
    present rows is not unique; all others, and so every unique key but for an error beyond the margin, are grouped (see
    `key_profile`). One small row decides, so the exact jobs are planned after the screen has run.
    """
    allowed = 1 - margin * 1.04 / math.sqrt(2**precision)
    screened = spelled_estimates(key_estimates(df, keys, precision), keys)
    # one row per candidate key, and the exact ones are chosen by it
    rows = screened.collect()
    maybe = [r["name"] for r in rows if r["estimate"] >= allowed * r["present"]]
    schema = "name string, keys string, rows bigint, absent bigint, unique boolean"
    decided = [(r["name"], r["keys"], r["rows"], r["absent"], False) for r in rows if r["name"] not in maybe]
    found = df.sparkSession.createDataFrame(decided, schema)
    if maybe:
        exact = key_profile(df, {name: keys[name] for name in maybe})
        found = found.unionByName(exact.select("name", "keys", "rows", "absent", "unique"))
    return found


def key_profile(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each candidate key: is it unique, and is it absent (any part NULL) in some rows?

    Each key groups its own columns, as they are typed. Equal keys meet as one pre-aggregated row, so a
    key value holding most of the table costs one row per task.
    """
    profiles = []
    for name, columns in keys.items():
        present = _all_present(columns)
        per_value = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
        profiles.append(
            per_value.agg(
                F.sum("_rows").alias("rows"),
                F.coalesce(F.sum(F.when(~present, F.col("_rows"))), F.lit(0)).alias("absent"),
                F.count_if(present).alias("distinct_values"),
                (F.coalesce(F.max(F.when(present, F.col("_rows"))), F.lit(0)) <= 1).alias("unique"),
                F.coalesce(F.bool_or(~present), F.lit(False)).alias("sparse"),
            ).select(F.lit(name).alias("name"), F.lit(_spelled(columns)).alias("keys"), "*")
        )
    union = profiles[0]
    for more in profiles[1:]:
        union = union.unionByName(more)
    return union.where("rows is not null")


def _spelled(columns: Sequence[str]) -> str:
    return ", ".join(f"{c}: 1" for c in columns)


def _all_present(columns: Sequence[str]) -> Column:
    present = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        present = present & F.col(c).isNotNull()
    return present
