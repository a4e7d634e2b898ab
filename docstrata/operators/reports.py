"""Report tables over profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.functions.paths import natural_order
from docstrata.functions.text import (
    format_count,
    format_diff,
    format_examples,
    format_notes,
    format_type_ratio,
    percent,
    preview_text,
)
from docstrata.operators.tree import field_tree
from docstrata.options import ProfileOptions


def yes_no(flag: str):
    return F.when(F.col(flag), F.lit("Yes")).otherwise(F.lit("No"))


def field_report(fields: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Data dictionary rows in tree order; parents that are no field are left out.

    max_depth is the deepest node of the collection, virtual ones included.
    """
    tree = field_tree(fields)
    deepest = tree.groupBy("collection").agg(F.max("depth").alias("max_depth"))
    rows = tree.where("has_field").join(deepest, "collection")
    rows = rows.join(fields, [rows["collection"] == fields["collection"], rows["full_path"] == fields["path"]]).drop(
        fields["collection"]
    )
    if descriptions is not None:
        rows = rows.join(descriptions.select("collection", "path", "description"), ["collection", "path"], "left")
    elif "description" not in rows.columns:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    return rows.select(
        "collection",
        "path",
        "segment",
        "depth",
        "rowspan",
        "max_depth",
        "order_key",
        percent(F.col("present_ratio")).alias("present"),
        format_type_ratio(F.col("types")).alias("types"),
        yes_no("optional").alias("optional"),
        format_examples(F.col("examples")).alias("examples"),
        F.coalesce("description", F.lit("-")).alias("description"),
        format_notes(F.col("mixed_type"), F.col("hints"), F.col("stats.min"), F.col("stats.max")).alias("notes"),
    )


def key_report(keys: DataFrame) -> DataFrame:
    return keys.select(
        "name", "keys", yes_no("unique").alias("unique"), yes_no("sparse").alias("sparse"), F.lit("-").alias("ttl")
    )


def variant_report(variants: DataFrame) -> DataFrame:
    number = F.concat(F.lit("#"), F.col("rank").cast("string"))
    label = F.when(F.col("rank") == 1, F.concat(number, F.lit(" (primary)"))).otherwise(number)
    diff = preview_text(format_diff(F.col("added"), F.col("missing"), count_rest=False))
    return variants.select(
        "collection",
        "rank",
        label.alias("variant"),
        percent(F.col("ratio")).alias("ratio"),
        F.when(F.col("rank") == 1, F.lit("-")).otherwise(diff).alias("diff"),
    )


def collection_overview(
    totals: DataFrame, fields: DataFrame, variants: DataFrame, warnings: DataFrame, catalog: DataFrame
) -> DataFrame:
    """One row per collection: documents, profiled documents, fields, variants, warnings; by name."""
    field_counts = fields.groupBy("collection").agg(F.count(F.lit(1)).alias("fields"))
    variant_counts = variants.groupBy("collection").agg(F.count(F.lit(1)).alias("variants"))
    joined = (
        catalog.select("collection", "est_count")
        .join(totals, "collection", "left")
        .join(field_counts, "collection", "left")
        .join(variant_counts, "collection", "left")
        .join(warnings.select("collection", "warnings"), "collection", "left")
    )
    text = F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), ", ")
    return joined.select(
        "collection",
        format_count(F.col("est_count")).alias("documents"),
        F.coalesce("docs", F.lit(0)).alias("sampled"),
        F.coalesce("fields", F.lit(0)).alias("fields"),
        F.coalesce("variants", F.lit(0)).alias("variants"),
        F.when(text == "", F.lit("-")).otherwise(text).alias("warnings"),
    ).orderBy(natural_order(F.col("collection")), "collection")


def overview_report(
    truncation: DataFrame,
    pii: DataFrame,
    collections: DataFrame,
    options: ProfileOptions = ProfileOptions(),
    strategy: str = "all",
    sample_size: int | None = None,
) -> DataFrame:
    """Run report as (section, position, line): options, truncation warnings if any, PII warnings.

    `strategy` and `sample_size` are what the run did; without a sample it profiled every document.
    """
    spark = truncation.sparkSession
    heads = [
        f"Strategy: {strategy}",
        f"Sample Size: {'all' if sample_size is None else sample_size}",
        f"Redaction: {options.redact}",
        f"Max Depth: {'none' if options.max_depth is None else options.max_depth}",
    ]
    head = spark.createDataFrame([(i + 1, line) for i, line in enumerate(heads)], "position int, line string")
    head = head.select(F.lit("options").alias("section"), "position", "line")
    counted = collections.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("collections").alias("section"),
        F.lit(1).alias("position"),
        F.concat(F.lit("Collections: "), F.col("n").cast("string")).alias("line"),
    )
    total = truncation.where(F.col("collection").isNull())
    cuts = [
        ("Depth truncated: ", "depth_truncated", " paths exceeded max depth"),
        ("Keys truncated: ", "keys_truncated", " keys exceeded per-doc limit"),
        ("Arrays truncated: ", "arrays_truncated", " arrays exceeded sample limit"),
    ]
    warned = total.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("position"),
                        F.when(
                            F.col(name) > 0, F.concat(F.lit(before), F.col(name).cast("string"), F.lit(after))
                        ).alias("line"),
                    )
                    for i, (before, name, after) in enumerate(cuts)
                ]
            )
        )
    ).where(F.col("line").isNotNull())
    warned = warned.select(F.lit("truncation").alias("section"), "position", "line")
    line = F.concat(F.lit("["), F.col("collection"), F.lit("] PII-suspected fields detected: "), F.array_join("paths", ", "))
    # one short line per collection, in order
    lines = F.array_sort(F.collect_list(F.struct(natural_order(F.col("collection")).alias("k"), "collection", line.alias("line"))))
    placed = pii.agg(lines.alias("lines")).select(F.posexplode("lines").alias("at", "entry"))
    named = placed.select(F.lit("warnings").alias("section"), (F.col("at") + 1).alias("position"), F.col("entry.line").alias("line"))
    return head.unionByName(counted).unionByName(warned).unionByName(named)
