"""Packing by best-fit decreasing.

Texts are tokenized where they lie. A document longer than a window is first cut into full windows, each a sequence of its
own; at most one shorter piece is left. Pieces are stored with a number each, and dealt by its hash into groups of about
`group_pieces`, equal rows like others; within a
group every piece, longest first, goes into the tightest open window, which a segment tree indexed by remaining capacity
finds. Groups hold tens of thousands of pieces of all lengths, so that padding stays near nothing while a task's memory
stays bounded; the number of groups follows the table.

Defined cases: a null or empty text is the end id alone. Rows with equal or null ids are packed each on its own. A text
of any length is tokenized whole. Of pieces of equal length the smaller id comes first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import stored, text_of
from docstrata.llm.token_ids import byte_tokenizer

WINDOW = 1024
END_ID = 0
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("place", pa.int64())])


class CapacityTree:
    """Which remaining capacities have an open window; finds the least that is large enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window of at least this capacity, which is then no longer open."""
        node = least + self.leaves
        if not self.count[node]:
            # up to the first subtree on the right that has a window, then down its left side
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece; `lengths` are in decreasing order, the longest at most `window`."""
    tree, numbers, offsets, opened = CapacityTree(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        found = tree.take(length)
        if found is None:
            found, opened = (window, opened), opened + 1
        left, number = found[0] - length, found[1]
        numbers[i], offsets[i] = number, window - found[0]
        if left:
            tree.add(left, number)
    return numbers, offsets


def _cut(ranks: str, window: int):
    def run(batches):
        tokenizer, place = byte_tokenizer(ranks), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                ids = np.append(np.frombuffer(tokenizer.ids(text.as_py()), "<u2").astype("<u4"), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for column, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), place), strict=True):
                        column.append(value)
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=PIECES)

    return run


def _pack_group(window: int):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        length, crc, start, doc = (rows.column(c).fill_null(-1).to_numpy() for c in ("length", "ids_crc32", "start", "doc_id"))
        order = np.lexsort((crc, start, doc, -length))
        numbers, offsets = best_fit_decreasing(length[order], window)
        rows = rows.take(pa.array(order))
        group = rows.column("group").to_numpy().astype(np.int64)
        yield from (
            rows.drop_columns(["group", "place"])
            .append_column("sequence_id", pa.array((group << 32) + numbers))
            .append_column("offset", pa.array(offsets))
            .to_batches(max_chunksize=50_000)
        )

    return run


def cut_documents(docs: DataFrame, ranks: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens, and a number of its own."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("t"))
    return texts.mapInArrow(_cut(ranks, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long")


def pack_documents(docs: DataFrame, ranks: str, window: int = WINDOW, group_pieces: int = 50_000) -> DataFrame:
    """Every piece with its sequence and its offset there. Sequence ids are unique, the group in their high 32 bits."""
    pieces = stored(cut_documents(docs, ranks, window), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int"))
    return dealt.repartitionById(groups, "group").mapInArrow(
        _pack_group(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
