"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of id and text. Pass two Fisher-Yates
shuffles each bucket in memory and writes it. Buckets in order are one uniform permutation of all records; it is cut into
shards whose row counts are at most one apart (law `rows`). The number of buckets follows the bytes of the table, so a task
always holds about `bucket_bytes` (or one longer text), and a bucket's order depends on its content and the seed only, so a task
that is repeated after a lost executor writes the same rows. Hot sources or copied texts do not matter: the id is hashed too.
A row that is repeated so often that its copies would crowd a bucket is scattered by its place in the table as well; `docs` must
then keep its order when it is read again, as tables do.

Defined cases: a null text has no bytes (size 16, crc 0). Null ids and repeated rows are records of their own; equal rows
are in no particular order among themselves. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import stored

RECORD_OVERHEAD = 16
#: Equal rows crowd a bucket if they fill this part of it.
CROWD_SHARE = 4


def _shuffle_bucket(seed: int):
    def run(batches):
        batches = list(batches)
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        if not rows.num_rows:
            return
        bucket = rows.column("bucket")[0].as_py()
        order = np.lexsort((rows.column("tie").to_numpy(), rows.column("null_id").to_numpy(), rows.column("id").to_numpy()))
        # Generator.permutation is a Fisher-Yates shuffle
        order = order[np.random.default_rng([seed, bucket]).permutation(len(order))]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # Rows are sent on as they came, each with its place: no second copy of the texts
        at = 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(place[at : at + n]), batch.column("record")], ["bucket", "place", "record"])
            at += n

    return run


def shuffle_records(docs: DataFrame, seed: int = 7, bucket_bytes: int = 32 << 20) -> tuple[DataFrame, int]:
    """(bucket, place, record) of all rows, stored in the shared folder, and the number of buckets."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_OVERHEAD)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_OVERHEAD
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    crowds = docs.groupBy(hashed.alias("hash")).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > bucket_bytes // CROWD_SHARE)
    rows = docs.select(
        hashed.alias("hash"),
        F.monotonically_increasing_id().alias("at"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.col("doc_id").isNull().cast("int").alias("null_id"),
        F.xxhash64(F.lit(~seed), "text").alias("tie"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
    )
    rows = rows.join(stored(crowds, "crowds"), "hash", "left")
    spread = F.when(F.col("bytes").isNotNull(), F.xxhash64("hash", "at")).otherwise(F.col("hash"))
    bucket = F.pmod(spread, F.lit(buckets)).cast("int").alias("bucket")
    scattered = rows.select(bucket, "id", "null_id", "tie", "record").repartitionById(buckets, "bucket")
    record = scattered.schema["record"].dataType
    shuffled = scattered.mapInArrow(_shuffle_bucket(seed), f"bucket int, place long, record {record.simpleString()}")
    return stored(shuffled, "shuffled"), buckets


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7, bucket_bytes: int = 32 << 20) -> DataFrame:
    """record, shard and slot of every row. Shard s holds the global places from ceil(s n / shards) on."""
    shuffled, _ = shuffle_records(docs, seed, bucket_bytes)
    # one row per bucket, that is per 32 MB of text
    sizes = shuffled.groupBy("bucket").agg(F.count("*").alias("rows"))
    before = sizes.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("before"))
    n = sizes.agg(F.sum("rows")).first()[0] or 1
    place = shuffled.join(before, "bucket").withColumn("at", F.col("before") + F.col("place"))
    shard = F.expr(f"at * {shards} div {n}").cast("int")
    first = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return place.withColumn("shard", shard).select("record", "shard", (F.col("at") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Write the records as Parquet, a folder per shard; range partitions keep slot order within and across a shard's files."""
    rows = sharded.select("record", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows.repartitionByRange(files, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
