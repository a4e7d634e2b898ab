"""Best-fit packing with large-item matching, over the whole table at once.

Texts are tokenized where they lie; only documents longer than a window are cut, into full windows and a rest. How pieces go
together depends on their lengths alone, so the plan is made for the histogram of lengths, which has at most `window` rows
however large the table is, and is the one plan for all rows:

* Pieces above a third of the window go at most two to a sequence. Greedy matching takes the longest that is left and gives
  it the longest other that still fits, which pairs as many as can be paired; the others stand alone.
* Smaller pieces, longest first, go into the tightest gap that holds them; where there is none, a new sequence is opened.

Equal pieces and equal gaps are handled as ranges, so the plan takes time and space by the number of distinct lengths. A piece
then finds its place by its length and its rank among the pieces of that length. Ranks are counts: pieces are numbered
within their task as they are cut, and the sums of the tasks before are added. No sort, and a length that a third of all rows
share is spread over all tasks.

Defined cases: a null or empty text is the end id alone. Rows with equal or null ids are packed each on its own. Which of
several pieces of equal length gets which of their places follows their order in the table. A text of any length is cut
whole, in memory. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import slices, stored, text_of
from docstrata.llm.word_ids import word_tokenizer

WINDOW = 2048
END_ID = 0
CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Gaps:
    """Ranges of sequences by the room they have left."""

    def __init__(self):
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if not count or not room:
            return
        if room not in self.ranges:
            insort(self.rooms, room)
            self.ranges[room] = []
        self.ranges[room].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(room, first, count) of a range with the least room that is enough; it is no longer there."""
        at = bisect_left(self.rooms, least)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, count = self.ranges[room].pop()
        if not self.ranges[room]:
            del self.ranges[room], self.rooms[at]
        return room, first, count


class Plan:
    """Where the pieces of each length go: rows (length, rank, sequence, offset, per sequence), each in force from its rank on."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window, self.rows, self.used, self.gaps = window, [], 0, Gaps()
        self.ranks = dict.fromkeys(counts, 0)
        large = {n: c for n, c in counts.items() if 3 * n > window and c}
        self._match(dict(large))
        for length in sorted((n for n, c in counts.items() if c and n not in large), reverse=True):
            self._fit(length, counts[length])

    def _put(self, length: int, count: int, sequence: int, offset: int, per_sequence: int = 1) -> None:
        self.rows.append((length, self.ranks[length], sequence, offset, per_sequence))
        self.ranks[length] += count

    def _match(self, left: dict[int, int]) -> None:
        lengths = sorted(left)
        while lengths:
            longest = lengths[-1]
            at = bisect_right(lengths, self.window - longest) - 1
            if at >= 0 and lengths[at] == longest and left[longest] == 1:
                at -= 1
            partner = lengths[at] if at >= 0 else None
            if partner is None:
                pairs, room = left[longest], self.window - longest
                self._put(longest, pairs, self.used, 0)
                left[longest] = 0
            elif partner == longest:
                pairs, room = left[longest] // 2, self.window - 2 * longest
                self._put(longest, 2 * pairs, self.used, 0, 2)
                left[longest] -= 2 * pairs
            else:
                pairs, room = min(left[longest], left[partner]), self.window - longest - partner
                self._put(longest, pairs, self.used, 0)
                self._put(partner, pairs, self.used, longest)
                left[longest] -= pairs
                left[partner] -= pairs
                if not left[partner]:
                    lengths.remove(partner)
            self.gaps.add(room, self.used, pairs)
            self.used += pairs
            if not left[longest]:
                lengths.remove(longest)

    def _fit(self, length: int, count: int) -> None:
        while count:
            found = self.gaps.take(length)
            if found is None:
                room, first, sequences = self.window, self.used, -(-count // (self.window // length))
                self.used += sequences
            else:
                room, first, sequences = found
            each, offset = room // length, self.window - room
            full = min(sequences, count // each)
            if full:
                self._put(length, full * each, first, offset, each)
                self.gaps.add(room - each * length, first, full)
                count -= full * each
            if full < sequences and count:
                self._put(length, count, first + full, offset, count)
                self.gaps.add(room - count * length, first + full, 1)
                full, count = full + 1, 0
            self.gaps.add(room, first + full, sequences - full)


def _cut(file: str, window: int):
    def run(batches):
        tokenizer, task, seen = word_tokenizer(file), TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            for part in slices([batch], "t"):
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("t"), strict=True):
                    ids = np.append(np.frombuffer(tokenizer.ids(text.as_py()), np.uint16), np.uint16(END_ID)).astype("<u4")
                    for number, start in enumerate(range(0, len(ids), window)):
                        piece = ids[start : start + window]
                        n = len(piece)
                        for column, value in zip(out, (doc_id, number, start, n, zlib.crc32(piece.data), seen[n]), strict=True):
                            column.append(value)
                        seen[n] += 1
                doc, number, start, length, crc, nth = out
                tasks = np.full(len(doc), task, np.int32)
                columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array(tasks), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def _place(rows: list[tuple], window: int):
    lengths, ranks, sequences, offsets, each = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
    # plan rows of each length follow one another, by rank
    begin = np.searchsorted(lengths, np.arange(window + 2))

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                low, high = begin[length[order[a]]], begin[length[order[a]] + 1]
                row[order[a:b]] = low + np.searchsorted(ranks[low:high], rank[order[a:b]], "right") - 1
            into = rank - ranks[row]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequences[row] + into // each[row]), pa.array(offsets[row] + into % each[row] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def cut_documents(docs: DataFrame, file: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of at most `window` ids, numbered among the pieces of its length in its task."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("t"))
    return texts.mapInArrow(_cut(file, window), CUT)


def place_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every piece of a stored `cut_documents` with its sequence and its offset there. Sequences are numbered without gaps."""
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # a length has one row per task of the table's scan
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    counts = stored(counts.withColumn("before", before).drop("n"), "packing-ranks")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = pieces.join(counts, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(Plan(histogram, window).rows, window), PLACED)


def pack_documents(docs: DataFrame, file: str, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return place_pieces(stored(cut_documents(docs, file, window), "packing-pieces"), window)
