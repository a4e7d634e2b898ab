"""Line dedup with a segment-partition edit join.

Lines within `EDITS` edits (code points inserted, deleted or changed) of one another link; a line's class is what its links
reach, and of each class only the first line of the corpus (by document, then place) stays. Lines under `MIN_LENGTH` code
points have only equal ones in their class; lines without a word always stay.

A line is cut into `EDITS + 1` even segments. After that many edits one segment is left whole, and lies at most a few
places off. So each line is dealt out by its own segments and by those of its substrings that may equal a segment of a
line of the same or a slightly smaller length; lines that meet are candidates. Each row carries a line's letter counts in
sixteen buckets, since every edit moves them by two at most; that ends most chance meetings. Where more than `group_rows`
different lines share a segment they are dealt out again, by segment and by five parts of their counts, one of which has to
be equal; groups still larger are cut into chunks of that size, and each two chunks meet in a task's cell of their own, where
lines already joined are not compared again. Candidates are verified on the whole lines with a banded, bit-parallel automaton.

Defined cases: a null or empty text has no lines with a word. Null ids come after all others. Rows with an equal id and
text are one document and get the same result; rows with an equal id and other texts count by line numbers alone, and a
line at an equal number is not later. A very long text is worked on alone, whole, and a very long line verified alone. An empty table gives an empty result. Columns beyond doc_id and text pass through
`remove_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import components, mix, slices, stored, text_of

EDITS = 2
MIN_LENGTH = 20
BUCKETS = 16
PAIRS, POINTS = 512, 1 << 20
LAST_ID = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Lines:
    """The lines of a batch of texts as ranges of code points, with hashes of any part of them."""

    def __init__(self, texts: pa.Array):
        joined = "\n".join(texts.to_pylist())
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.points)
        breaks = np.flatnonzero(self.points == 10)
        self.starts = np.concatenate([[0], breaks + 1])
        self.ends = np.concatenate([breaks, [n]])
        counts = np.array([t.as_py().count("\n") + 1 for t in texts])
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        blank = (self.points == 32) | ((self.points >= 9) & (self.points <= 13))
        self.worded = np.concatenate([[0], np.cumsum(~blank)])[self.ends] > np.concatenate([[0], np.cumsum(~blank)])[self.starts]
        self.inverse = _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = np.cumsum(mix(self.points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] ^ (stop - start).astype(np.uint64))

    def letter_counts(self, line: np.ndarray) -> np.ndarray:
        """Counts of code points in sixteen buckets, each modulo 16, four bits each."""
        out = np.zeros(len(line), np.uint64)
        bucket = mix(self.points.astype(np.uint64)) % np.uint64(BUCKETS)
        for b in range(BUCKETS):
            sums = np.concatenate([[0], np.cumsum(bucket == b)])
            out |= ((sums[self.ends[line]] - sums[self.starts[line]]) % 16).astype(np.uint64) << np.uint64(4 * b)
        return out


def segment_keys(lines: Lines, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index into `line`, own): a key for each segment of each line, and for each substring that may equal one."""
    start, length = lines.starts[line], (lines.ends - lines.starts)[line]
    keys, rows, owns = [], [], []
    parts = EDITS + 1
    for shorter in range(parts):
        indexed = length - shorter
        small, longer = indexed // parts, indexed % parts
        for part in range(parts):
            size = small + (part >= parts - longer)
            place = part * small + np.maximum(0, part - (parts - longer))
            left, right = part, EDITS - part
            for shift in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                at = place + shift
                fits = (at >= 0) & (at + size <= length) & (indexed >= MIN_LENGTH)
                hashed = lines.hashes(np.where(fits, start + at, start), np.where(fits, start + at + size, start))
                key = mix(hashed + (indexed * parts + part).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                keys.append(key[fits])
                rows.append(np.flatnonzero(fits))
                owns.append(np.full(int(fits.sum()), shorter == 0 and shift == 0))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(owns)


def _line_rows(batches):
    for batch in batches:
        for part in slices([batch], "t", 1 << 20):
            lines = Lines(part.column("t"))
            line = np.flatnonzero(lines.worded)
            text = lines.text[line]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lines.hashes(lines.starts[line], lines.ends[line]).view(np.int64)),
                    pa.array(part.column("id").to_numpy()[text]),
                    pa.array(part.column("tag").to_numpy()[text]),
                    pa.array(lines.number[line].astype(np.int32)),
                ],
                ["line", "id", "tag", "number"],
            )


def _segment_rows(batches):
    for batch in batches:
        for part in slices([batch], "t", 1 << 20):
            lines = Lines(part.column("t"))
            line = np.flatnonzero(lines.worded & (lines.ends - lines.starts >= MIN_LENGTH))
            named = lines.hashes(lines.starts[line], lines.ends[line])
            _, once = np.unique(named, return_index=True)
            line, named = line[once], named[once]
            keys, rows, owns = segment_keys(lines, line)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(named[rows].view(np.int64)), pa.array(lines.letter_counts(line)[rows].view(np.int64)), pa.array(owns)],
                ["key", "line", "letters", "own"],
            )


def _near(letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of letter counts are at most two per edit apart."""
    x, y = letters[a], letters[b]
    total = np.zeros(len(a), np.int64)
    for bucket in range(BUCKETS):
        shift, low = np.uint64(4 * bucket), np.uint64(15)
        apart = (((x >> shift) & low).astype(np.int64) - ((y >> shift) & low).astype(np.int64)) % 16
        total += np.minimum(apart, 16 - apart)
    return total <= 2 * EDITS


ROWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("letters", pa.int64()), ("own", pa.bool_())])


def _met(line: np.ndarray, letters: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Pairs of one group, at least one of them by its own segment, whose letters are near."""
    out = []
    for i in range(0, len(line) - 1, 256):
        a, b = np.divmod(np.arange(min(256, len(line) - i) * len(line)), len(line))
        a = a + i
        keep = (a < b) & (line[a] != line[b]) & (own[a] | own[b])
        a, b = a[keep], b[keep]
        near = _near(letters, a, b)
        out.append(np.stack([np.minimum(line[a], line[b])[near], np.maximum(line[a], line[b])[near]]))
    return out


def _meetings(group_rows: int):
    """Rows sorted by key: candidate pairs (a, b), or the rows of a group that is too large, as they came."""

    def emit(pairs: list[np.ndarray]):
        if pairs:
            both = np.concatenate(pairs, axis=1)
            both = pa.table({"a": both[0], "b": both[1]}).group_by(["a", "b"]).aggregate([])
            n = both.num_rows
            if n:
                nulls = [pa.nulls(n, f.type) for f in ROWS][2:]
                yield from pa.table([both.column("a"), both.column("b"), *nulls], schema=ROWS).to_batches()

    def rows_of(table: pa.Table):
        n = table.num_rows
        yield from pa.table([table.column("line"), pa.nulls(n, pa.int64()), table.column("key"), table.column("letters"), table.column("own")], schema=ROWS).to_batches()

    def whole(table: pa.Table):
        key, line, own = (table.column(c).to_numpy() for c in ("key", "line", "own"))
        letters = table.column("letters").to_numpy().view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(cuts)
        pairs: list[np.ndarray] = []
        # groups of two, nearly all of those that matter, at once
        two = cuts[:-1][sizes == 2]
        if len(two):
            keep = (line[two] != line[two + 1]) & (own[two] | own[two + 1])
            two = two[keep]
            near = two[_near(letters, two, two + 1)]
            pairs.append(np.stack([np.minimum(line[near], line[near + 1]), np.maximum(line[near], line[near + 1])]))
        for start, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            of = slice(start, start + n)
            names, at = np.unique(line[of], return_index=True)
            if len(names) < 2:
                continue
            mine = np.zeros(len(names), bool)
            np.logical_or.at(mine, np.searchsorted(names, line[of]), own[of])
            if mine.any():
                pairs += _met(names, letters[of][at], mine)
        yield from emit(pairs)

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        large = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*waiting, batch])
            key = table.column("key").to_numpy()
            if large is not None:
                passed = int(np.searchsorted(key, large, "right"))
                yield from rows_of(table.slice(0, passed))
                table, key, large = table.slice(passed), key[passed:], large if passed == len(key) else None
            if len(key):
                last = int(np.searchsorted(key, key[-1]))
                yield from whole(table.slice(0, last))
                table = table.slice(last)
                if table.num_rows > group_rows:
                    large = int(key[-1])
                    yield from rows_of(table)
                    table = table.slice(table.num_rows)
            waiting = table.to_batches()
        if waiting:
            yield from whole(pa.Table.from_batches(waiting))

    return run


def within_edits(lefts: list[str], rights: list[str], edits: int = EDITS) -> np.ndarray:
    """Which pairs are at most `edits` apart: an automaton of `edits + 1` state words, a bit per diagonal of the band.

    Bit k of word d after column j: the first j + k - edits code points of the left are within d edits of the first j of the
    right. All pairs advance together.
    """
    n = len(lefts)
    sizes_a, sizes_b = np.array([len(s) for s in lefts], np.int64), np.array([len(s) for s in rights], np.int64)
    width_b = int(sizes_b.max(initial=0))
    a = np.zeros((n, int(sizes_a.max(initial=0)) + width_b + 2 * edits + 1), np.uint32)
    b = np.zeros((n, width_b + 1), np.uint32)
    for row, (x, y) in enumerate(zip(lefts, rights, strict=True)):
        a[row, edits : edits + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        b[row, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return _advanced(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), sizes_a, sizes_b, edits)


def _advanced(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, edits: int) -> np.ndarray:
    """`within_edits` of the columns of `a` (code points from row `edits` on) and `b`, zeros around them."""
    n, band, width_b = len(sizes_a), 2 * edits + 1, int(sizes_b.max(initial=0))
    found = np.zeros(n, bool)
    mask = np.uint32((1 << band) - 1)
    states = [np.full(n, (((1 << (d + 1)) - 1) << edits) & int(mask), np.uint32) for d in range(edits + 1)]
    ending = sizes_a - sizes_b + edits
    possible = np.abs(sizes_a - sizes_b) <= edits

    def record(column: int) -> None:
        done = np.flatnonzero((sizes_b == column) & possible)
        found[done] = (states[edits][done] >> ending[done].astype(np.uint32)) & 1

    record(0)
    for column in range(width_b):
        match = np.zeros(n, np.uint32)
        for k in range(band):
            match |= (a[column + k] == b[column]).astype(np.uint32) << np.uint32(k)
        before, new = None, []
        for state in states:
            now = state & match
            if before is not None:
                now |= before | (before >> np.uint32(1)) | (new[-1] << np.uint32(1))
            new.append(now & mask)
            before = state
        states = new
        record(column + 1)
    return found


def alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The indices of all sizes in runs of like ones: at most `PAIRS`, and padded to the longest at most `POINTS`, or one alone."""
    order = np.argsort(sizes, kind="stable")
    ordered, start = sizes[order], 0
    while start < len(order):
        padded = ordered[start : start + PAIRS] * np.arange(1, len(ordered[start : start + PAIRS]) + 1)
        stop = start + max(1, int(np.searchsorted(padded, POINTS, "right")))
        yield order[start:stop]
        start = stop


def _verified(batches):
    for batch in batches:
        for part in slices([batch], "text_a", 1 << 20):
            lefts, rights = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
            # pairs of like lengths advance together, a very long one alone
            sizes = np.array([max(len(x), len(y)) for x, y in zip(lefts, rights, strict=True)], np.int64)
            keep = np.zeros(len(lefts), bool)
            for rows in alike(sizes):
                keep[rows] = within_edits([lefts[i] for i in rows], [rights[i] for i in rows])
            yield part.select(["a", "b"]).filter(pa.array(keep))


def _wanted_lines(batches):
    for batch in batches:
        for wanted, text in zip(batch.column("wanted").to_pylist(), batch.column("t"), strict=True):
            lines = text.as_py().split("\n")
            wanted = [w for w in wanted if w["number"] < len(lines)]
            if wanted:
                yield pa.RecordBatch.from_arrays([pa.array([w["line"] for w in wanted], pa.int64()), pa.array([lines[w["number"]] for w in wanted], pa.string())], ["line", "text"])


PARTS = ((0, 3), (3, 3), (6, 3), (9, 3), (12, 4))
CHUNK_POINTS = 4 << 20


def cells(large: DataFrame, texts: DataFrame, group_rows: int) -> DataFrame:
    """The rows of groups that were too large, with their texts, in cells (key, i, j) that hold two chunks of a group at most.

    A group is dealt by its segment and each part of the letter counts (at most 2 * EDITS buckets differ, so one part is
    equal); what is still over `group_rows` is cut into chunks, and each two chunks meet in a cell of their own.
    """
    sizes = large.groupBy("whole").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any").drop("any")
    equal = [F.struct(F.xxhash64("whole", F.lit(i), F.shiftrightunsigned("letters", 4 * at).bitwiseAND(16**n - 1)).alias("key"), F.lit(i).alias("part")) for i, (at, n) in enumerate(PARTS)]
    one = F.array(F.struct(F.col("whole").alias("key"), F.lit(0).alias("part")))
    dealt = large.join(sizes, "whole").select(F.explode(F.when(F.col("n") > group_rows, F.array(*equal)).otherwise(one)).alias("to"), "line", "letters", "own")
    dealt = dealt.join(texts, "line").select("to.key", "to.part", "line", "letters", "own", "text")
    groups = dealt.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any"), F.sum(F.length("text")).alias("points")).where("n > 1 and any")
    chunks = F.greatest(F.ceil(F.col("n") / group_rows), F.ceil(F.col("points") / CHUNK_POINTS)).cast("int")
    dealt = dealt.join(groups.select("key", chunks.alias("chunks")), "key")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("line", "key"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "part", "chunk", "line", "letters", "own", "text")


def _cell_links(cell: pa.Table) -> pa.Table:
    """Links of the two chunks of a cell, or of one chunk with itself, that join what no earlier one has joined."""
    chunk, own = cell.column("chunk").to_numpy(), cell.column("own").to_numpy()
    line, letters = cell.column("line").to_numpy(), cell.column("letters").to_numpy().view(np.uint64)
    i, j, part = (cell.column(c)[0].as_py() for c in ("i", "j", "part"))
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    links: list[tuple[int, int]] = []
    if len(left) and len(right) and len(line) > 1:
        texts = cell.column("text").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        width = int(sizes.max())
        points = np.zeros((len(texts), 2 * width + 2 * EDITS + 1), np.uint32)
        for row, text in enumerate(texts):
            points[row, EDITS : EDITS + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        points = np.ascontiguousarray(points.T)
        counts = np.stack([(letters >> np.uint64(4 * b) & np.uint64(15)).astype(np.uint8) for b in range(BUCKETS)])
        counts = counts[(counts != counts[:, :1]).any(axis=1)]
        names = np.arange(len(line))
        most = max(1, POINTS // width)
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            meet = (names[rows][:, None] != names[right]) & (own[rows][:, None] | own[right])
            if i == j:
                meet &= rows[:, None] < right
            if not meet.any():
                continue
            apart = np.zeros(meet.shape, np.uint8)
            for count in counts:
                one = (count[rows][:, None] - count[right]) & np.uint8(15)
                apart += np.minimum(one, np.uint8(16) - one)
            a, b = np.nonzero(meet & (apart <= 2 * EDITS))
            a, b = rows[a], right[b]
            # a pair with an earlier part equal meets in that part's cells
            for place, n in PARTS[:part]:
                differ = ((letters[a] ^ letters[b]) >> np.uint64(4 * place)) & np.uint64(16**n - 1) != 0
                a, b = a[differ], b[differ]
            while len(a):
                x, y = a[:most], b[:most]
                near = _advanced(points[:, x], points[EDITS:, y], sizes[x], sizes[y], EDITS)
                for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    if names[p] != names[q]:
                        links.append((min(line[p], line[q]), max(line[p], line[q])))
                        names[names == names[q]] = names[p]
                a, b = a[most:], b[most:]
                apart_still = names[a] != names[b]
                a, b = a[apart_still], b[apart_still]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def line_links(docs: DataFrame, first: DataFrame, group_rows: int) -> DataFrame:
    """(a, b) links of different lines, of groups that were too large as many as join them; `first` has a place (id, tag, number) of each line."""
    met = "a long, b long, key long, letters long, own boolean"
    dealt = docs.mapInArrow(_segment_rows, "key long, line long, letters long, own boolean")
    found = stored(dealt.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_meetings(group_rows), met), "lines-meetings")
    large = found.where("key is not null").groupBy(F.col("key").alias("whole"), F.col("a").alias("line"), "letters").agg(F.max("own").alias("own"))
    large = stored(large, "lines-large")
    pairs = stored(found.where("key is null").select("a", "b").distinct(), "lines-pairs")

    lines = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(large.select("line")).distinct()
    wanted = first.join(lines, "line").groupBy("id", "tag").agg(F.collect_set(F.struct("line", "number")).alias("wanted"))
    texts = docs.join(wanted, ["id", "tag"]).select("wanted", "t").mapInArrow(_wanted_lines, "line long, text string").distinct()
    texts = stored(texts, "lines-texts")
    sided = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("text_a")), "a")
    sided = sided.join(texts.select(F.col("line").alias("b"), F.col("text").alias("text_b")), "b")
    links = sided.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    met = cells(large, texts, group_rows).repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(_cell_links, "a long, b long")
    return stored(links.union(met), "lines-links")


def _identified(documents: DataFrame, *more) -> DataFrame:
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_of(documents).alias("t"), *more)
    return docs.withColumn("tag", F.xxhash64("t"))


def repeated_lines(documents: DataFrame, group_rows: int = 2000) -> DataFrame:
    """(id, tag, removed): the numbers (from 0) of each document's lines that repeat an earlier line of the corpus."""
    docs = _identified(documents)
    lines = stored(docs.mapInArrow(_line_rows, "line long, id long, tag long, number int"), "lines")
    place = F.struct("id", "number", "tag")
    first = stored(lines.groupBy("line").agg(F.min(place).alias("first")).select("line", "first.*"), "lines-first")
    links = line_links(docs, first, group_rows)
    classes = stored(components(links, "lines"), "lines-classes")
    # of a class, the first line of all its members
    starts = first.join(classes, first["line"] == classes["node"]).groupBy("component").agg(F.min(place).alias("start"))
    linked = classes.join(starts, "component").select(F.col("node").alias("line"), "start")
    firsts = first.select("line", place.alias("own")).join(linked, "line", "left").select("line", F.coalesce("start", "own").alias("start"))
    later = lines.join(firsts, "line").where("id <> start.id or number <> start.number")
    return later.groupBy("id", "tag").agg(F.sort_array(F.collect_set("number")).alias("removed"))


def line_decisions(documents: DataFrame, group_rows: int = 2000) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the removed lines' numbers of every row."""
    counted = F.size(F.filter(F.split("t", "\n", -1), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != "")).cast("long")
    docs = _identified(documents, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", "id", "tag", counted.alias("n_lines"))
    removed = stored(repeated_lines(documents, group_rows), "lines-removed")
    joined = docs.join(removed, ["id", "tag"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return joined.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("removed_lines"))


def remove_lines(documents: DataFrame, group_rows: int = 2000) -> DataFrame:
    """All columns, `text` without its repeated lines (and n_chars, where there is one, of what is left).

    A document that had lines with a word and has lost all of them goes.
    """
    names = documents.columns
    removed = stored(repeated_lines(documents, group_rows), "lines-removed")
    docs = _identified(documents, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    left = F.array_join(F.filter(F.split("t", "\n", -1), lambda s, i: ~F.array_contains("removed", i)), "\n")
    docs = docs.join(removed, ["id", "tag"], "left").withColumn("kept", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left))
    kept = docs.where(F.col("removed").isNull() | (F.btrim("kept", F.lit(" \t\n\x0b\x0c\r")) != ""))
    return kept.select(*[F.col("kept").alias(c) if c == "text" else F.length("kept").cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in names])
