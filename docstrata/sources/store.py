"""Writing profiles and reports, and reading an earlier profile back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: One line per field, variant or summary, so that no line grows with its collection.
PROFILE_SCHEMA = (
    "collection string, "
    "field struct<absent_count bigint, description string, "
    "examples array<struct<hints array<string>, type string, value string>>, hints array<string>, "
    "mixed_type boolean, optional boolean, path string, present_count bigint, present_ratio double, "
    "stats struct<avg double, max double, min double>, types array<struct<n bigint, ratio double, type string>>>, "
    "summary string, "
    "variant struct<added array<string>, count bigint, missing array<string>, paths array<string>, "
    "rank int, ratio double, signature string>"
)


def profile_rows(fields: DataFrame, variants: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """The rows of a stored profile; members are in name order throughout."""
    if "description" not in fields.columns:
        fields = fields.withColumn("description", F.lit(None).cast("string"))
    stats = F.when(F.col("stats").isNotNull(), F.struct("stats.avg", "stats.max", "stats.min"))
    types = F.transform("types", lambda t: F.struct(t["n"].alias("n"), t["ratio"].alias("ratio"), t["type"].alias("type")))
    examples = F.transform(
        "examples", lambda e: F.struct(e["hints"].alias("hints"), e["type"].alias("type"), e["value"].alias("value"))
    )
    field = F.struct(
        "absent_count", "description", examples.alias("examples"), "hints", "mixed_type", "optional", "path",
        "present_count", "present_ratio", stats.alias("stats"), types.alias("types"),
    )
    shape = F.struct("added", "count", "missing", "paths", "rank", "ratio", "signature")
    rows = fields.select("collection", field.alias("field")).unionByName(
        variants.select("collection", shape.alias("variant")), allowMissingColumns=True
    )
    if summaries is not None:
        rows = rows.unionByName(summaries.select("collection", "summary"), allowMissingColumns=True)
    return rows


def write_schema_json(
    path: str, fields: DataFrame, variants: DataFrame, summaries: DataFrame | None = None, mode: str = "overwrite"
) -> None:
    profile_rows(fields, variants, summaries).write.mode(mode).json(path)


def update_schema_json(path: str, fields: DataFrame, variants: DataFrame, summaries: DataFrame | None = None) -> None:
    """Replace the collections of a run in a stored profile and keep all others.

    Such a profile has one folder per collection from its first writing on; `load_schema_json` reads both forms.
    """
    _update(profile_rows(fields, variants, summaries), path, "json")


def update_reports(path: str, reports: dict[str, DataFrame], file_format: str = "parquet") -> None:
    """Replace the collections of a run in the reports written by `write_reports` and keep all others.

    Reports without a collection column describe a run; they are replaced as a whole.
    """
    for name, report in reports.items():
        target = f"{path.rstrip('/')}/{name}"
        if "collection" in report.columns:
            _update(report, target, file_format)
        else:
            report.write.mode("overwrite").format(file_format).save(target)


def _update(rows: DataFrame, path: str, file_format: str) -> None:
    # only the partitions that have rows are overwritten
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("collection").format(file_format).save(path)


def load_schema_json(spark: SparkSession, path: str) -> DataFrame:
    """An earlier profile; a missing folder gives no rows, an unreadable line an error when it is read."""
    try:
        loaded = spark.read.schema(PROFILE_SCHEMA).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PROFILE_SCHEMA)
    return loaded.where(F.col("collection").isNotNull())


def stored_fields(profile: DataFrame) -> DataFrame:
    return profile.where("field is not null").select("collection", "field.*")


def stored_descriptions(profile: DataFrame) -> DataFrame:
    """descriptions(collection, path, description) of an earlier profile."""
    rows = stored_fields(profile).select("collection", "path", "description")
    return rows.where("description is not null and description <> ''")


def stored_summaries(profile: DataFrame) -> DataFrame:
    return profile.select("collection", "summary").where("summary is not null and summary <> ''")


def write_reports(path: str, reports: dict[str, DataFrame], file_format: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per report; reports with a collection column get one subfolder per collection."""
    for name, report in reports.items():
        writer = report.write.mode(mode).format(file_format)
        if "collection" in report.columns:
            writer = writer.partitionBy("collection")
        writer.save(f"{path.rstrip('/')}/{name}")
