"""Exact removal of repeated passages with prefix-partitioned suffix trees.

A window of `WINDOW` words is a suffix cut at that depth: deeper branches do not matter, since words are removed once their
window has started earlier. Suffixes are split by variable-length prefixes:

1. Every window has a content-determined anchor, the least hash among its five-word runs. Equal windows have equal anchors
   at the same place, so windows whose anchor occurs once in the corpus cannot repeat and go no further. About one word
   in nine is an anchor.
2. Suffixes whose anchor repeats are dealt by it, each with the words it spans. A group builds its subtree: suffixes
   sorted by five-word runs, neighbours' common prefixes, and the internal nodes at full depth, whose leaves are one
   repeated window. Every leaf but the earliest is repeated text.
3. An anchor with more than `group_rows` occurrences is too large a group. Occurrences that span the same words are first
   reduced to their earliest, a pre-aggregated minimum: all windows of the others are repeated. If there are still more
   than `group_rows` different spans, their suffixes are split by the prefix at full depth, where a group is one leaf set
   and its earliest leaf again a minimum.

Defined cases: null and empty texts, and those under `WINDOW` words, keep all they have. A null id comes after all others.
Rows with an equal id and text are one document and get the same result; rows with an equal id and other texts count by
their starts alone, and a window at an equal start is not earlier. A very long text is worked on alone, whole. An empty
table gives an empty result. Columns beyond
doc_id and text are not read by `repeated_windows` and pass through `remove_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import Words, flat_ranges, slices, stored, text_of, window_hashes

WINDOW = 20
RUN = 5
RUNS = WINDOW - RUN + 1
LAST_ID = 2**63 - 1


def _anchored(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every text, in order: its first word, its anchor's word, and the hashes of all runs."""
    runs = window_hashes(words.hashes, RUN)
    if len(runs) < RUNS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    value, at = runs, np.arange(len(runs))
    # the leftmost least of 2, 4, 8 and 16 runs
    for step in (1, 2, 4, 8):
        later = value[step:] < value[:-step]
        value = np.where(later, value[step:], value[:-step])
        at = np.where(later, at[step:], at[:-step])
    first = flat_ranges(words.word_at[:-1], words.counts - WINDOW + 1)
    return first, at[first], runs


def _anchor_rows(batches):
    for batch in batches:
        for part in slices([batch], "t"):
            words = Words(part.column("t"))
            first, anchor, runs = _anchored(words)
            # a text's anchors never move back, and no window spans two texts
            anchor = anchor[np.flatnonzero(np.diff(anchor, prepend=-1))]
            text = np.searchsorted(words.word_at, anchor, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(runs[anchor].view(np.int64)),
                    pa.array(part.column("id").to_numpy()[text]),
                    pa.array(part.column("tag").to_numpy()[text]),
                    pa.array((anchor - words.word_at[text]).astype(np.int32)),
                ],
                ["prefix", "id", "tag", "place"],
            )


SUFFIXES = "prefix long, id long, tag long, start int, windows int, large boolean, words string"


def _suffix_rows(batches):
    """One row per repeated anchor, with the words that its windows span."""
    for batch in batches:
        for part in slices([batch], "t", 1 << 20):
            words = Words(part.column("t"))
            first, anchor, runs = _anchored(words)
            cut = np.flatnonzero(np.diff(anchor, prepend=-1))
            begin, anchor, windows = first[cut], anchor[cut], np.diff(cut, append=len(first))
            text = np.searchsorted(words.word_at, anchor, "right") - 1
            # the text's repeated anchors, as a set of (text, place)
            places = part.column("places")
            counts = np.diff(places.offsets.to_numpy())
            items = places.flatten()
            wanted = np.repeat(words.word_at[:-1], counts) + items.field("place").to_numpy()
            owner = np.repeat(np.arange(len(places)), counts)
            if not len(wanted) or not len(anchor):
                continue
            order = np.argsort(wanted, kind="stable")
            hit = order[np.minimum(np.searchsorted(wanted[order], anchor), len(order) - 1)]
            found = (wanted[hit] == anchor) & (owner[hit] == text)
            begin, anchor, windows, text = begin[found], anchor[found], windows[found], text[found]
            large = items.field("large").to_numpy(zero_copy_only=False)[hit[found]]
            data = words.data.tobytes()
            spans = [data[a:b].decode() for a, b in zip(words.starts[begin].tolist(), words.ends[begin + windows + WINDOW - 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(runs[anchor].view(np.int64)),
                    pa.array(part.column("id").to_numpy()[text]),
                    pa.array(part.column("tag").to_numpy()[text]),
                    pa.array((begin - words.word_at[text]).astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                    pa.array(large.astype(bool)),
                    pa.array(spans, pa.string()),
                ],
                ["prefix", "id", "tag", "start", "windows", "large", "words"],
            )


def _window_rows(batches):
    """A row per window, by its prefix at full depth."""
    for batch in batches:
        for part in slices([batch], "words"):
            words = Words(part.column("words"))
            windows = part.column("windows").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(windows)), windows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(window_hashes(words.hashes, WINDOW)[flat_ranges(words.word_at[:-1], windows)].view(np.int64)),
                    pa.array(part.column("id").to_numpy()[row]),
                    pa.array(part.column("tag").to_numpy()[row]),
                    pa.array(flat_ranges(part.column("start").to_numpy().astype(np.int64), windows).astype(np.int32)),
                ],
                ["prefix", "id", "tag", "start"],
            )


class SuffixForest:
    """The subtrees of several prefix groups, down to `WINDOW` words, as sorted suffixes and common prefixes of neighbours."""

    def __init__(self, group: np.ndarray, runs: np.ndarray, suffix: np.ndarray):
        blocks = [runs[suffix + k] for k in range(0, WINDOW, RUN)]
        self.order = np.lexsort((*blocks[::-1], group))
        self.common = np.zeros(len(suffix), np.int64)
        if len(suffix) > 1:
            same = (group[self.order][1:] == group[self.order][:-1]).astype(np.int64)
            for block in blocks:
                ordered = block[self.order]
                same &= ordered[1:] == ordered[:-1]
                self.common[1:] += RUN * same

    def deep_nodes(self, depth: int) -> np.ndarray:
        """A number for each suffix, in input order: those below one node of this depth share it."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def _later_leaves(rows: pa.Table):
    """(id, tag, start, windows) runs of windows that are not the earliest leaf of their node."""
    if not rows.num_rows:
        return
    prefix, ids, tags, start, windows = (rows.column(c).to_numpy() for c in ("prefix", "id", "tag", "start", "windows"))
    texts = rows.column("words").combine_chunks()
    words = Words(texts)
    runs = window_hashes(words.hashes, RUN)
    row = np.repeat(np.arange(len(windows)), windows)
    suffix = flat_ranges(words.word_at[:-1], windows.astype(np.int64))
    begin = flat_ranges(start.astype(np.int64), windows.astype(np.int64))
    node = SuffixForest(prefix[row], runs, suffix).deep_nodes(WINDOW)
    order = np.lexsort((begin, ids[row], node))
    ordered = node[order]
    opens = np.flatnonzero(np.diff(ordered, prepend=-1))
    earliest = np.repeat(order[opens], np.diff(opens, append=len(order)))
    later = np.zeros(len(order), bool)
    later[order] = (ids[row][order] != ids[row][earliest]) | (begin[order] != begin[earliest])
    # consecutive windows of one row that are repeated become one run
    here = np.flatnonzero(later)
    if not len(here):
        return
    breaks = np.flatnonzero((np.diff(here, prepend=-2) != 1) | (np.diff(row[here], prepend=-1) != 0))
    at, count = here[breaks], np.diff(breaks, append=len(here))
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[row[at]]), pa.array(tags[row[at]]), pa.array(begin[at].astype(np.int32)), pa.array(count.astype(np.int32))], ["id", "tag", "start", "windows"]
    )


def _subtrees(batches):
    """Rows sorted by prefix: whole groups are taken together, some batches at a time."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if batch.column("prefix")[0].as_py() != batch.column("prefix")[batch.num_rows - 1].as_py():
            rows = pa.Table.from_batches(waiting)
            prefix = rows.column("prefix").to_numpy()
            last = int(np.searchsorted(prefix, prefix[-1]))
            yield from _later_leaves(rows.slice(0, last))
            waiting = rows.slice(last).to_batches()
    if waiting:
        yield from _later_leaves(pa.Table.from_batches(waiting))


def _identified(documents: DataFrame, *more) -> DataFrame:
    text = text_of(documents)
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text.alias("t"), *more)


def repeated_windows(documents: DataFrame, group_rows: int = 2000) -> DataFrame:
    """(id, tag, start, windows): runs of windows of a document that have started earlier. tag: a hash of its text."""
    docs = _identified(documents).withColumn("tag", F.xxhash64("t"))
    anchors = docs.mapInArrow(_anchor_rows, "prefix long, id long, tag long, place int")
    counts = anchors.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    # a text's own places: as many as its anchors at most
    places = anchors.join(counts, "prefix").groupBy("id", "tag").agg(F.collect_set(F.struct("place", (F.col("n") > group_rows).alias("large"))).alias("places"))
    places = stored(places, "passages-anchors")
    suffixes = docs.join(places, ["id", "tag"]).select("id", "t", "tag", "places").mapInArrow(_suffix_rows, SUFFIXES)
    suffixes = stored(suffixes, "passages-suffixes")

    rows = ["prefix", "id", "tag", "start", "windows", "words"]
    large = suffixes.where("large").withColumn("span", F.xxhash64("words"))
    spans = stored(large.groupBy("prefix", "span").agg(F.min(F.struct("id", "start")).alias("earliest")), "passages-spans")
    copies = large.join(spans, ["prefix", "span"]).where("id <> earliest.id or start <> earliest.start").select("id", "tag", "start", "windows")
    first = spans.select("prefix", "span", "earliest.id", "earliest.start")
    many = spans.groupBy("prefix").agg((F.count("*") > group_rows).alias("many"))
    first = large.join(first, ["prefix", "span", "id", "start"]).join(many, "prefix").select(*rows, "many")

    small = suffixes.where("not large").select(*rows).union(first.where("not many").select(*rows))
    later = small.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_subtrees, "id long, tag long, start int, windows int")
    windows = first.where("many").select(*rows).mapInArrow(_window_rows, "prefix long, id long, tag long, start int")
    earliest = windows.groupBy("prefix").agg(F.min(F.struct("id", "start")).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    hot = windows.join(earliest, "prefix").where("id <> earliest.id or start <> earliest.start").select("id", "tag", "start", F.lit(1).alias("windows"))
    return stored(later.union(copies).union(hot), "passages-repeats")


def _covered(words: Words, runs: pa.ListArray) -> np.ndarray:
    """Which words of a batch of texts lie in a repeated window."""
    counts = np.diff(runs.offsets.to_numpy())
    items = runs.flatten()
    begin = np.repeat(words.word_at[:-1], counts) + items.field("start").to_numpy()
    change = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + items.field("windows").to_numpy() + WINDOW - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _digest_rows(batches):
    for batch in batches:
        for part in slices([batch], "t"):
            words = Words(part.column("t"))
            gone = _covered(words, part.column("runs"))
            data = words.data.tobytes()
            hashes, removed = [], []
            for a, n in zip(words.word_at[:-1].tolist(), words.counts.tolist(), strict=True):
                left = np.flatnonzero(~gone[a : a + n]) + a
                removed.append(n - len(left))
                kept = b" ".join([data[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)])
                hashes.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(hashes)], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )


def _cut_rows(batches):
    """The text without its repeated words; what parts the words that stay is left as it was."""
    for batch in batches:
        for part in slices([batch], "t"):
            words = Words(part.column("t"))
            gone = _covered(words, part.column("runs"))
            # bytes from a repeated word to the next word, or to the text's end, go
            stop = np.append(words.starts, len(words.data))[1:]
            last = words.word_at[1:][words.counts > 0] - 1
            stop[last] = words.text_at[1:][words.counts > 0]
            change = np.zeros(len(words.data) + 1, np.int64)
            change[words.starts[gone]] += 1
            np.add.at(change, stop[gone], -1)
            kept = np.cumsum(change[:-1]) == 0
            sizes = np.concatenate([[0], np.cumsum(kept)])[words.text_at].astype(np.int32)
            text = pa.StringArray.from_buffers(len(sizes) - 1, pa.py_buffer(sizes), pa.py_buffer(words.data[kept].tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("row"), text], ["row", "text"])


def _with_runs(documents: DataFrame, repeats: DataFrame, *more) -> DataFrame:
    runs = repeats.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "windows")).alias("found"))
    docs = _identified(documents, *more).withColumn("tag", F.xxhash64("t"))
    empty = F.array().cast("array<struct<start:int,windows:int>>")
    return docs.join(runs, ["id", "tag"], "left").withColumn("runs", F.coalesce("found", empty)).drop("found", "id", "tag")


def passage_digests(documents: DataFrame, group_rows: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    marked = _with_runs(documents, repeated_windows(documents, group_rows), F.col("doc_id").cast("long").alias("doc_id"))
    return marked.mapInArrow(_digest_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(documents: DataFrame, group_rows: int = 2000) -> DataFrame:
    """All rows and columns, `text` without its repeated words (and n_chars, where there is one, of what is left)."""
    names = documents.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"])
    marked = _with_runs(documents, repeated_windows(documents, group_rows), row.alias("row"), F.col("text").isNull().alias("none"))
    marked = marked.withColumn("row", F.struct("row", "none"))
    cut = marked.select("row", "t", "runs").mapInArrow(_cut_rows, f"row {marked.schema['row'].dataType.simpleString()}, text string")
    text = F.when(F.col("row.none"), F.lit(None)).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.length(text).cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row.row")[c].alias(c) for c in names])
