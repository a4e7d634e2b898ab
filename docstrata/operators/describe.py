"""Tables around the description stage: its inputs, its work queue, its answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.paths import path_key
from docstrata.functions.text import compose_summary, extract_json_block, percent

FIELD = ["collection", "path"]
# Fixed value: paths listed in a collection's summary input.
SUMMARY_PATHS = 20
# Fixed value: examples in a field's description input.
INPUT_EXAMPLES = 3
# Texts used when no answer is supplied.
DEFAULT_PURPOSE = " 컬렉션이다."
DEFAULT_STRUCTURE = "개의 필드로 구성되어 있다."
DEFAULT_FIELD = " 필드이다."


def top_fields_by_presence(fields: DataFrame, n: int | None) -> DataFrame:
    """The n most present fields of each collection; all of them without a limit."""
    if n is None:
        return fields
    order = Window.partitionBy("collection").orderBy(F.desc("present_ratio"), path_key(F.col("path")), "path")
    return fields.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def first_type(types: str = "types") -> Column:
    return F.try_element_at(F.col(types), F.lit(1))["type"]


def type_summary(fields: DataFrame) -> DataFrame:
    """Fields per first-listed type and collection."""
    typed = fields.select("collection", first_type().alias("type"))
    return typed.groupBy("collection", "type").agg(F.count(F.lit(1)).alias("field_count"))


def summary_inputs(fields: DataFrame, totals: DataFrame) -> DataFrame:
    """Per collection: field count, documents profiled, first paths, fields per type."""
    key = path_key(F.col("path"))
    order = Window.partitionBy("collection").orderBy(key, "path")
    ranked = fields.select("collection", "path", F.row_number().over(order).alias("rank"))
    first = ranked.where(F.col("rank") <= SUMMARY_PATHS).groupBy("collection").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda p: p["path"]).alias("first_paths")
    )
    types = type_summary(fields).groupBy("collection").agg(
        F.sum("field_count").alias("field_count"),
        F.array_sort(F.collect_list(F.concat_ws(":", "type", F.col("field_count").cast("string")))).alias("type_summary"),
    )
    return (
        types.join(first, "collection")
        .join(totals.withColumnRenamed("docs", "sample_count"), "collection")
        .select("collection", "field_count", "sample_count", "first_paths", "type_summary")
    )


def description_inputs(fields: DataFrame, context: DataFrame) -> DataFrame:
    """Per field: types with shares, presence, a few examples as rendered, related keys."""
    types = F.array_join(
        F.transform("types", lambda t: F.concat(t["type"], F.lit("("), percent(t["ratio"]), F.lit(")"))), ", "
    )
    values = F.transform(F.slice("examples", 1, INPUT_EXAMPLES), lambda e: e["value"])
    return fields.join(context, FIELD, "left").select(
        *FIELD,
        types.alias("types"),
        percent(F.col("present_ratio")).alias("presence"),
        F.coalesce(F.array_join(values, ", "), F.lit("")).alias("examples"),
        F.coalesce(F.array_join("context", ", "), F.lit("")).alias("fk_context"),
    )


def input_key(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON (columns in name order) of an input."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def description_work_queue(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """Inputs whose key has no answer(key, ...) yet."""
    keyed = inputs.withColumn("key", input_key(inputs.columns))
    return keyed.join(answers.select("key"), "key", "left_anti")


def apply_descriptions(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Attach answers(collection, path, description, seq); `.*.` in an answer means `.[*].`.

    The answer with the highest seq wins over others and over the field's own description.
    """
    exact = answers.withColumn("path", F.regexp_replace("path", r"\.\*\.", ".[*]."))
    latest = exact.groupBy(*FIELD).agg(
        F.max(F.when(F.col("description") != "", F.struct("seq", "description")))["description"].alias("answer")
    )
    joined = fields.join(latest, FIELD, "left")
    kept = F.coalesce("answer", "description") if "description" in fields.columns else F.col("answer")
    return joined.withColumn("description", kept).drop("answer")


def default_descriptions(described: DataFrame) -> DataFrame:
    """Fill missing field descriptions with the fixed text."""
    fallback = F.concat(F.col("path"), F.lit(DEFAULT_FIELD))
    return described.withColumn("description", F.coalesce("description", fallback))


def default_summaries(inputs: DataFrame) -> DataFrame:
    """Summary text of collections for which no answer was supplied."""
    purpose = F.concat("collection", F.lit(DEFAULT_PURPOSE))
    structure = F.concat(F.col("field_count").cast("string"), F.lit(DEFAULT_STRUCTURE))
    return inputs.select(
        "collection", compose_summary(purpose, structure, F.lit(None).cast("string")).alias("summary")
    )


def parse_summary_answers(answers: DataFrame) -> DataFrame:
    """answers(collection, text) -> summary, NULL where no JSON block parses."""
    block = extract_json_block(F.col("text"))
    parsed = answers.withColumn("block", block)
    purpose, structure, notes = (
        F.expr(f"try_variant_get(block, '$.{name}', 'string')") for name in ("purpose", "structure", "notes")
    )
    summary = F.when(F.col("block").isNotNull(), compose_summary(purpose, structure, notes))
    return parsed.select("collection", summary.alias("summary"))
