"""Token ids in training order, as binary shards.

Texts are tokenized once, where they lie; each document's ids and an end id follow one another and are cut into sequences of
a fixed length (the last of each input partition is padded with end ids). The sequences are stored, and number themselves
by the counts of the partitions before theirs. A keyed Feistel permutation over the next power of four, walked until it
falls below the number of sequences, gives each its global slot in training order. A shard is a range of slots: one task
takes its sequences and writes a file of fixed stride, so that slot s is at byte (s mod shard size) * stride of shard
s div shard size, and a reader can start anywhere and read on.

Ids are little-endian and 16 bits wide; the stored and shuffled runs of sequences are compressed, the shards are not. A
task writes under a name of its own and renames it at the end, so one that is repeated replaces its file.

Defined cases: a null or empty text is the end id alone. Null ids and repeated rows do not matter, as every row is
tokenized, whole, whatever its length; sequences of equal content keep slots of their own. An empty table gives no shards. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import mix, stored, text_of
from docstrata.llm.token_ids import END_OF_TEXT_ID, byte_tokenizer
from docstrata.session import shared_folder

LENGTH = 2048
SHARD_SEQUENCES = 8192
RUN_SEQUENCES = 512
ROUNDS = 6


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1, applied to some of its numbers."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    low, shift = np.uint64(2**half - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = numbers.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> shift, out[walking] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[walking] = (left << shift) | right
        walking = out >= n
    return out.astype(np.int64)


def _sequence_rows(ranks: str, length: int):
    """Runs of sequences of one input partition: (part, first, count, tokens, ids compressed)."""

    def packed(stream: bytes, first: int, tokens: int) -> pa.RecordBatch:
        count = len(stream) // (2 * length)
        blob = zstandard.ZstdCompressor(level=3).compress(stream)
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([first]), pa.array([count]), pa.array([tokens]), pa.array([blob], pa.binary())], ["part", "first", "count", "tokens", "ids"]
        )

    def run(batches):
        tokenizer = byte_tokenizer(ranks)
        end = END_OF_TEXT_ID.to_bytes(2, "little")
        most = RUN_SEQUENCES * length * 2
        stream, first = bytearray(), 0
        for batch in batches:
            for text in batch.column("t"):
                stream += tokenizer.ids(text.as_py())
                stream += end
                while len(stream) >= most:
                    yield packed(bytes(stream[:most]), first, most // 2)
                    first += RUN_SEQUENCES
                    del stream[:most]
        if stream:
            tokens = len(stream) // 2
            stream += end * (-tokens % length)
            yield packed(bytes(stream), first, tokens)

    return run


def _slotted_rows(n: int, key: int, length: int, shard_sequences: int):
    """Each run's sequences by shard: (shard, slots, ids compressed)."""

    def run(batches):
        for batch in batches:
            for number, count, blob in zip(batch.column("number").to_pylist(), batch.column("count").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), "<u2").reshape(count, length)
                slots = feistel(number + np.arange(count), n, key)
                shard = slots // shard_sequences
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                groups = np.split(order, cuts[1:])
                press = zstandard.ZstdCompressor(level=3)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[order[cuts]].astype(np.int32)),
                        pa.array([slots[g].tolist() for g in groups], pa.list_(pa.int64())),
                        pa.array([press.compress(ids[g].tobytes()) for g in groups], pa.binary()),
                    ],
                    ["shard", "slots", "ids"],
                )

    return run


def _written(folder: str, length: int, shard_sequences: int, n: int):
    """Writes the shard of each partition; a row per sequence."""

    def run(batches: Iterator[pa.RecordBatch]):
        shard, ids, present = None, None, None
        for batch in batches:
            for number, slots, blob in zip(batch.column("shard").to_pylist(), batch.column("slots").to_pylist(), batch.column("ids"), strict=True):
                if shard is None:
                    shard = number
                    size = min(shard_sequences, n - shard * shard_sequences)
                    ids, present = np.zeros((size, length), "<u2"), np.zeros(size, bool)
                at = np.array(slots) - shard * shard_sequences
                ids[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), "<u2").reshape(len(slots), length)
                present[at] = True
        if shard is None:
            return
        if not present.all():
            raise ValueError(f"shard {shard} lacks sequences")
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        target, draft = f"{path}/shard-{shard:08d}.bin", f"{path}/.draft-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            for at in range(0, len(ids), 1024):
                out.write(ids[at : at + 1024].tobytes())
        files.move(draft, target)
        slots = shard * shard_sequences + np.arange(len(ids))
        crcs = [zlib.crc32(row.tobytes()) for row in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(np.full(len(ids), shard, np.int32)), pa.array(np.arange(len(ids)) * length * 2), pa.array(crcs, pa.int64())],
            ["slot", "shard", "byte_offset", "ids_crc32"],
        )

    return run


def write_training_order(docs: DataFrame, ranks: str, folder: str, key: int = 17, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """Write the shards below `folder` (a URI that all executors reach); a row per sequence, with its slot and crc."""
    texts = docs.select(text_of(docs).alias("t"))
    runs = texts.mapInArrow(_sequence_rows(ranks, length), "part int, first long, count long, tokens long, ids binary")
    runs = stored(runs, "sequences")
    # a row per input partition
    sizes = runs.groupBy("part").agg(F.sum("count").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = sizes.agg(F.sum("n"), F.count("*")).first()
    n, parts = total[0] or 0, total[1]
    if parts <= 100_000:
        before = F.broadcast(before)
    shards = max(1, math.ceil(n / shard_sequences))
    numbered = runs.join(before, "part").select((F.col("before") + F.col("first")).alias("number"), "count", "ids")
    slotted = numbered.mapInArrow(_slotted_rows(n, key, length, shard_sequences), "shard int, slots array<long>, ids binary")
    written = slotted.repartitionById(shards, "shard").mapInArrow(_written(folder, length, shard_sequences, n), "slot long, shard int, byte_offset long, ids_crc32 long")
    return stored(written, "sequence-slots")


def read_sequences(folder: str, start: int, count: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """The ids of `count` sequences in training order from slot `start` on: one seek, then sequential reads."""
    files, path = fs.FileSystem.from_uri(folder)
    slot, stop, stride = start, start + count, 2 * length
    while slot < stop:
        shard, at = divmod(slot, shard_sequences)
        with files.open_input_file(f"{path}/shard-{shard:08d}.bin") as source:
            source.seek(at * stride)
            while slot < stop and slot // shard_sequences == shard:
                ids = source.read(stride)
                if not ids:
                    return
                yield np.frombuffer(ids, "<u2")
                slot += 1


def new_folder(spark) -> str:
    folder = shared_folder(spark)
    return f"{folder if '://' in folder else 'file://' + folder}/training-order-{uuid.uuid4().hex}"
