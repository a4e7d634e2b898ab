"""Runs of repeated words by string synchronising sets.

A run is a stretch of words with smallest period q, at least `least` and at least two periods long, that no neighbouring
word extends. All runs of a text are found, in time near n log n:

* Hashes of every 2^k words come from those of 2^(k-1). They answer how far two places agree, by halving steps.
* Periods below `SMALLEST` are read off directly, by comparing each word with the q-th before.
* Scale t = 2^k finds the periods from 3t to 6t. Its synchronising set holds each place whose t words have the least hash of
  the t + 1 places from there on, or share it with the last of them; places in highly periodic regions (a period of at most
  t / 3, known from smaller scales) have none. The set depends on 2t words only, so a stretch that repeats is marked alike.
  A run of period q has a marked place in its first period whose 2t words occur again q later: places of equal context at most
  6t apart propose their distance. No such context occurs more than eighteen times in that distance.
* Only a run whose whole first period is one highly periodic region escapes: there two such regions of equal period meet, and
  every distance that aligns them is proposed.
* Each proposal is extended both ways; the runs are those that reach two periods, by their least period.

Every text is worked on in one task, with neighbours of about a megabyte; a longer text stands alone, whole, with some 8 bytes
per word and doubling. Hashes are 64 bits wide.

Defined cases: a null or empty text has no words and no runs. Rows with equal or null ids are judged each on its own. A tie of
the greatest length goes to the smallest start, then period. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import Words, flat_ranges, mix, slices, text_of

LEAST = 12
SMALLEST = 6
_TURN = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)
COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _unique(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows, sorted by the columns in order."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def _by_least_period(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    """All (start, end, period), of one stretch that with the least period."""
    start, end, period = _unique(*[np.concatenate(c) for c in zip(*found, strict=True)])
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return [start[new], end[new], period[new]]


class Repeats:
    """Agreement of places in a row of word hashes, in which each text ends with a hash of its own."""

    def __init__(self, hashes: np.ndarray, longest: int):
        self.n, self.levels = len(hashes), [hashes]
        while 2 << len(self.levels) - 1 <= longest:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(mix(last[:-half] * _TURN + last[half:]) if len(last) > half else last[:0])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b > a on are equal."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            hashes = self.levels[k]
            x, y = a + found, b + found
            inside = y < len(hashes)
            same = inside & (hashes[np.where(inside, x, 0)] == hashes[np.where(inside, y, 0)]) if len(hashes) else inside
            found += same.astype(np.int64) << k
        return found

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b > a are equal."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            hashes, size = self.levels[k], 1 << k
            x, y = a - found - size, b - found - size
            inside = (x >= 0) & (y < len(hashes))
            same = inside & (hashes[np.where(inside, x, 0)] == hashes[np.where(inside, y, 0)]) if len(hashes) else inside
            found += same.astype(np.int64) << k
        return found

    def runs(self, place: np.ndarray, period: np.ndarray) -> list[np.ndarray]:
        """(start, end, period) of the stretches around each proposal that have at least two periods."""
        # an agreement is at most `longest` words long: one of two periods holds the proposal or is no run
        after, before = self.forward(place, place + period), self.backward(place, place + period)
        good = after + before >= period
        return _unique((place - before)[good], (place + period + after)[good], period[good])


def _direct(hashes: np.ndarray, period: int) -> list[np.ndarray]:
    """(start, end, period) of all stretches with a period of this length, by comparing words."""
    same = np.flatnonzero(hashes[:-period] == hashes[period:]) if len(hashes) > period else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(same, prepend=-2) > 1)
    sizes = np.diff(first, append=len(same))
    long = sizes >= period
    start = same[first[long]]
    return [start, start + sizes[long] + period, np.full(len(start), period, np.int64)]


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` + 1 values from each place on; `width` is a power of two."""
    out, size = values, 1
    while size < width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:-1], values[width:])


def _marked(hashes: np.ndarray, scale: int, regions: list[np.ndarray]) -> np.ndarray:
    """The synchronising set of a scale: `hashes` are those of `scale` words, `regions` the known runs."""
    ids = hashes.copy()
    start, end, period = regions
    high = (3 * period <= scale) & (end - start >= scale)
    ids[flat_ranges(start[high], end[high] - scale - start[high] + 1)] = _NONE
    if len(ids) <= scale:
        return np.zeros(0, np.int64)
    least = _least_ahead(ids, scale)
    return np.flatnonzero((least != _NONE) & ((ids[: len(least)] == least) | (ids[scale:] == least)))


def _equal_contexts(contexts: np.ndarray, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of pairs of marked places with equal contexts, at least 3 and less than 6 scales apart."""
    bits = np.uint64(int(places[-1]).bit_length()) if len(places) else np.uint64(0)
    # contexts in the high bits, places in the low ones: one sort of plain numbers. Contexts that meet by chance fail later
    keys = np.sort((contexts[places] >> bits << bits) | places.astype(np.uint64))
    low = (np.uint64(1) << bits) - np.uint64(1)
    group, place = keys >> bits, (keys & low).astype(np.int64)
    at, step, out = np.arange(len(keys)), 1, []
    while True:
        at = at[at + step < len(keys)]
        gap = place[at + step] - place[at]
        near = (group[at + step] == group[at]) & (gap < 6 * scale)
        at, gap = at[near], gap[near]
        if not len(at):
            break
        wide = gap >= 3 * scale
        out.append((place[at[wide]], gap[wide]))
        step += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([g for _, g in out])


def _meeting_regions(repeats: Repeats, scale: int, regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of all ways to align two highly periodic regions of equal period that meet."""
    start, end, period = regions
    long = (3 * period <= scale) & (end - start >= 3 * scale)
    period, start, end = _unique(period[long], start[long], end[long])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    # runs of equal period overlap by less than it: only neighbours can meet
    meets = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]))
    for i in meets.tolist():
        p, first, last = int(period[i]), int(start[i]), int(end[i])
        limit = min(last - first, int(end[i + 1]) - int(start[i + 1])) + p
        # one distance of each remainder: do the regions agree there for a period's length?
        shifts = np.arange(3 * scale, 3 * scale + p)
        shifts = shifts[shifts <= last]
        inside = last - shifts
        agree = repeats.forward(inside, inside + shifts) + repeats.backward(inside, inside + shifts) >= p
        for shift in shifts[agree].tolist():
            distance = np.arange(shift, min(limit, 6 * scale - 1) + 1, p)
            out.append((last - distance, distance))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, distance = np.concatenate([a for a, _ in out]), np.concatenate([d for _, d in out])
    valid = (place >= 0) & (place + distance < repeats.n)
    return place[valid], distance[valid]


def find_runs(hashes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; `counts` says how many words each text has."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    # texts by length, each followed by a hash that occurs once
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    row = np.empty(int(at[-1]), np.uint64)
    row[flat_ranges(at[:-1], sizes)] = hashes[flat_ranges(begin, sizes)]
    row[at[1:] - 1] = mix(np.arange(len(sizes)).astype(np.uint64) + np.uint64(0x1234567))
    longest = int(sizes[0]) if len(sizes) else 0
    repeats = Repeats(row, longest)

    found = [_direct(row, q) for q in range(1, SMALLEST)]
    scale = 2
    while 6 * scale <= longest:
        # only texts that can hold two of the scale's least periods, and they come first
        upto = int(at[np.searchsorted(-sizes, -6 * scale, "right")])
        found = [_by_least_period(found)]
        known = [c[found[0][0] < upto] for c in found[0]]
        k = scale.bit_length() - 1
        places = _marked(repeats.levels[k][:upto], scale, known)
        contexts = repeats.levels[k + 1][:upto]
        pairs = _equal_contexts(contexts, places[places < len(contexts)], scale)
        more = _meeting_regions(repeats, scale, known)
        found.append(repeats.runs(np.concatenate([pairs[0], more[0]]), np.concatenate([pairs[1], more[1]])))
        scale *= 2

    start, end, period = _by_least_period(found)
    enough = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[enough], end[enough], period[enough]
    text = np.searchsorted(at, start, "right") - 1
    text, start, length, period = order[text], start - at[text], end - start, period
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _digests(least: int):
    def run(batches):
        for batch in batches:
            for part in slices([batch], "t", 1 << 20):
                words = Words(part.column("t"))
                text, start, length, period = find_runs(words.hashes, words.counts, least)
                cut = np.searchsorted(text, np.arange(len(words.counts) + 1))
                out: list[list] = [[], [], [], [], [], [], []]
                texts = part.column("t")
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    kept = texts[i].as_buffer().to_pybytes().split() if words.counts[i] else []
                    best, lines = (None,) * 4, b""
                    if b > a:
                        s, n, q = start[a:b], length[a:b], period[a:b]
                        top = int(np.argmax(n))
                        best = (int(s[top]), int(n[top]), int(q[top]), int(1000 * n[top] // q[top]))
                        lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist(), strict=True)).encode()
                        change = np.zeros(len(kept) + 1, np.int64)
                        np.add.at(change, s + q, 1)
                        np.add.at(change, s + n, -1)
                        kept = [w for w, covered in zip(kept, np.cumsum(change[:-1]).tolist(), strict=True) if not covered]
                    digests = hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
                    for column, value in zip(out, (b - a, *best, *digests), strict=True):
                        column.append(value)
                columns = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:5]], *[pa.array(c, pa.string()) for c in out[5:]]]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def _run_rows(least: int):
    def run(batches):
        for batch in batches:
            for part in slices([batch], "t", 1 << 20):
                words = Words(part.column("t"))
                text, start, length, period = find_runs(words.hashes, words.counts, least)
                doc = part.column("doc_id").take(pa.array(text))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), pa.array(period)], ["doc_id", "start", "length", "period"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("t"))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, length, period of every run of every row, in words."""
    return _texts(docs).mapInArrow(_run_rows(least), "doc_id long, start long, length long, period long")


def run_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row the number of runs, its longest one, and digests of all runs and of the text with each run cut to one period."""
    return _texts(docs).mapInArrow(_digests(least), COLUMNS)
