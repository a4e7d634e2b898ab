"""Helpers shared by the operators: stored tables, word hashing inside Arrow batches, components of links."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import docstrata
from docstrata.session import shared_folder

#: The characters that part words in every operator: space and U+0009 to U+000D.
SPACE_BYTES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER_BYTES = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is not installed."""
    context = spark.sparkContext
    package = Path(docstrata.__path__[0])
    archive = Path(tempfile.gettempdir(), f"{package.name}-{context.applicationId}.zip")
    if archive.exists():
        return
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table into the folder that all executors share and read it again: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _check_offsets(texts: pa.Array) -> None:
    if texts.type not in (pa.string(), pa.binary()):
        raise TypeError(f"texts must have 32-bit offsets, not {texts.type}: unset spark.sql.execution.arrow.useLargeVarTypes")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about `most_bytes` of text; a longer text stands alone, whole.

    Texts with 64-bit offsets, as sessions with spark.sql.execution.arrow.useLargeVarTypes send them, are refused: raw buffers are
    read here, and rows go back with 32-bit ones.
    """
    for batch in batches:
        texts = batch.column(column)
        _check_offsets(texts)
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most_bytes, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of a batch of texts: byte ranges in `data`, a 64-bit hash each, and where each text's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False, parting: np.ndarray = SPACE_BYTES):
        _check_offsets(texts)
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.text_at = offsets - offsets[0]
        if lower:
            self.data = LOWER_BYTES[self.data]
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~parting[self.data]
        here = inside[1:-1]
        first, last = here & ~inside[:-2], here & ~inside[2:]
        cut = self.text_at[(self.text_at > 0) & (self.text_at < len(self.data))]
        first[cut] = here[cut]
        last[cut - 1] = here[cut - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.word_at = np.searchsorted(self.starts, self.text_at)
        self.counts = np.diff(self.word_at)
        self.hashes = self._hash(here)

    def _hash(self, here: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = _BYTE_VALUES[self.data[here]] * _powers(int(sizes.max()))[within]
        return mix(np.add.reduceat(values, np.cumsum(sizes) - sizes) ^ sizes.astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, power in enumerate(_powers(width + 1)[1:]):
        out += hashes[i : i + n] * power
    return mix(out)


def flat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of start and count, one after another."""
    counts = np.maximum(counts, 0)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of (a, b) links, the component named by its smallest node.

    Alternates large-star and small-star steps until nothing changes. Each step is a pre-aggregated minimum per node and a
    join with it, written to the shared folder; no component is ever gathered in one task.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = stored(edges, f"{name}-links"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # the next line reads `large` twice: it is written first
        large = stored(large, f"{name}-large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select("v", "v").distinct())
