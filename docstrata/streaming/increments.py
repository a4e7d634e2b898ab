"""Profiles that grow with a stream of documents.

Each micro-batch is profiled on its own and its partial tables are stored under its number: counts and sums per type, shapes
with their counts, quantile sketches and document counts. They add up, because a document is in one batch only; reading the
profile merges them. A batch that is run again after a failure overwrites what it had written, so nothing is counted twice.
No state is kept between batches, and the stored tables grow with paths and shapes, not with documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docstrata.operators import fields, variants
from docstrata.operators.flatten import flatten_documents
from docstrata.options import ProfileOptions

#: The stored tables, and how those of several batches become one.
MERGED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "types": fields.merge_profiles,
    "shapes": variants.merge_shapes,
    "quantiles": fields.merge_quantiles,
    "documents": lambda t: t.groupBy("collection").agg(F.sum("docs").alias("docs")),
}


def partial_tables(documents: DataFrame, options: ProfileOptions = ProfileOptions()) -> dict[str, DataFrame]:
    """What is stored of a set of documents(collection, doc_id, v)."""
    paths = flatten_documents(documents, options)
    return {
        "types": fields.partial_profile(paths),
        "shapes": variants.shapes(documents),
        "quantiles": fields.partial_quantiles(paths),
        "documents": fields.document_counts(documents),
    }


def store_batch(documents: DataFrame, number: int, folder: str, options: ProfileOptions = ProfileOptions()) -> None:
    """Profile the documents of one batch and replace what the folder holds under its number."""
    documents.persist()
    try:
        for name, table in partial_tables(documents, options).items():
            table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/batch={number}")
    finally:
        documents.unpersist()


def profile_stream(
    lines: DataFrame,
    to_documents: Callable[[DataFrame], DataFrame],
    folder: str,
    options: ProfileOptions = ProfileOptions(),
) -> DataStreamWriter:
    """A writer that profiles each micro-batch of a stream; set its trigger and start it.

    `to_documents` makes documents(collection, doc_id, v) of the rows of one batch. Progress is kept in the folder, so that a
    stream that is started again goes on where it ended.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store_batch(to_documents(batch), number, folder, options)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder.rstrip('/')}/progress")


def read_profile(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables in `MERGED`, over all batches stored so far."""
    try:
        stored = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"no batch has been stored in {folder}") from error
        raise
    return MERGED[name](stored.drop("batch"))


def field_counts(types: DataFrame, totals: DataFrame) -> DataFrame:
    """types(n, docs per collection, path, type) of `read_profile` with the share of the documents that have each type."""
    return types.join(totals.withColumnRenamed("docs", "all_docs"), "collection").withColumn("share", F.col("docs") / F.col("all_docs")).drop("all_docs")
