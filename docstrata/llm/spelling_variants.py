"""Spelling variants by blocked Gram matrices of letter counts.

Words of the whole table are counted; those that are long and frequent enough are compared. Two words are near if one
inserted, deleted or replaced letter makes the one the other. Such an edit moves the letter counts little: their squared
distance is 1 for an insertion and 2 for a replacement. The search is exact:

* The letters form `GROUPS` fixed groups, and a word's counts of them are its block; its length is their sum. An edit leads to
  the same block, to one of the same length with a letter moved between two groups, or to one a letter longer.
* A word stays in its block and visits the neighbouring ones, each pair of blocks in one direction.
* In a block, products of the count matrices of residents and visitors give all squared distances at once. Pairs at 1
  (lengths differ by one) or 2 (equal lengths) are verified on the letters: equal beginning and equal end cover all but one.

Blocks are dealt in chunks of at most `CHUNK_BYTES` of letters by a hash of the word, every chunk of residents meeting every chunk of
visitors, so memory is bounded whatever a block holds. Only pairs that are near leave a task; per word they are merged into a
count and the best form before the shuffle. Forms are followed to their roots by doubling: each has five times the count of the word before.

Defined cases: a null or empty text has no words. A null id stands as an empty string where a rule depends on the id. Repeated
rows count as often as they occur. Ties for the form go to the smallest in code-point order. An empty table gives an empty
result. A text of any length is read whole, with neighbours of some megabytes. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import LOWER_BYTES, Words, flat_ranges, slices, stored, text_of

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
GROUPS = 5
CHUNK_BYTES = 1 << 15
#: Letters are A-Z, a-z and U+00C0 to U+00FF, which UTF-8 writes as this byte and one more.
LATIN_LEAD = 0xC3
ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Columns of the count matrix: a letter each for a to z, six for what is beyond.
COUNT_COLUMNS = np.array([c - 97 if 97 <= c < 123 else 26 + c % 6 for c in range(256)])
#: A step of the checksum for each byte.
CRC_STEPS = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
#: Blocks are numbered by sums of these over the letters, so that a neighbour's number is a sum too.
GROUP_NUMBERS = np.random.default_rng(13).integers(1, 2**63, GROUPS, dtype=np.uint64)
CELLS = "block long, host int, guest int, role int, word string, n long"
HOST, VISITOR, SECOND = 0, 1, 2


def _letter_runs(texts: pa.Array) -> Words:
    """The maximal runs of letters, A to Z lowered."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    lead = data == LATIN_LEAD
    letter = ASCII_LETTER[data] | lead
    letter[1:] |= lead[:-1]
    shown = np.where(letter, LOWER_BYTES[data], np.uint8(32))
    return Words(pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(shown.tobytes())]))


def _checksums(words: Words, ids: list) -> np.ndarray:
    """crc32 of `id:word` for each word; `ids` has one id per text."""
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32) ^ np.uint32(0xFFFFFFFF)
    state = np.repeat(heads, words.counts)
    sizes = words.ends - words.starts
    order = np.argsort(-sizes, kind="stable")
    left, at = np.searchsorted(-sizes[order], -np.arange(1, 65), "right"), words.starts[order]
    state = state[order]
    for step, n in enumerate(left.tolist()):
        if not n:
            break
        state[:n] = CRC_STEPS[(state[:n] ^ words.data[at[:n] + step]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    # beyond 64 bytes one by one
    for i in range(int(left[-1])):
        a, b = int(at[i]) + 64, int(words.ends[order[i]])
        state[i] = zlib.crc32(words.data[a:b], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[flat_ranges(starts, sizes)].tobytes()))


def _word_counts(least_length: int, slip_every: int):
    def run(batches):
        for batch in batches:
            for part in slices([batch], "t"):
                words = _letter_runs(part.column("t"))
                leads = np.concatenate([[0], np.cumsum(words.data == LATIN_LEAD)])
                sizes = words.ends - words.starts
                length = sizes - (leads[words.ends] - leads[words.starts])
                slips = np.zeros(len(sizes), bool)
                if slip_every:
                    sums = _checksums(words, part.column("doc_id").to_pylist())
                    slips = sums % slip_every == 0
                plain = (length >= least_length) & ~slips
                slips &= length > least_length
                hashes, starts, sizes = words.hashes[plain], words.starts[plain], sizes[plain]
                _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_strings(words.data, starts[first], sizes[first]), pa.array(counts.astype(np.int64))], ["word", "n"])
                if slips.any():
                    cut = []
                    for i in np.flatnonzero(slips).tolist():
                        word = words.data[words.starts[i] : words.ends[i]].tobytes().decode()
                        at = int(sums[i]) % len(word)
                        cut.append(word[:at] + word[at + 1 :])
                    yield pa.RecordBatch.from_arrays([pa.array(cut), pa.array(np.ones(len(cut), np.int64))], ["word", "n"])

    return run


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip_every: int = 0) -> DataFrame:
    """(word, n) of the frequent words, stored. `slip_every`: a word whose checksum with its id it divides loses a letter first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("t"))
    counted = texts.mapInArrow(_word_counts(least_length, slip_every), "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "spelling-words")


class Letters:
    """The words of a batch, a byte per letter: `flat` with `starts` and `sizes`."""

    def __init__(self, words: pa.Array):
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
        lead = data == LATIN_LEAD
        letters = data.copy()
        letters[1:][lead[:-1]] += 0x40
        before = np.concatenate([[0], np.cumsum(lead)])
        at = (offsets - offsets[0]).astype(np.int64)
        at -= before[at]
        self.flat, self.starts, self.sizes = letters[~lead], at[:-1], np.diff(at)

    def counts(self, a: int, b: int, dtype) -> np.ndarray:
        """The count matrix of words a to b."""
        flat = self.flat[self.starts[a] : self.starts[b - 1] + self.sizes[b - 1]]
        cell = np.repeat(np.arange(b - a) * 32, self.sizes[a:b]) + COUNT_COLUMNS[flat]
        return np.bincount(cell, minlength=32 * (b - a)).reshape(b - a, 32).astype(dtype)

    def padded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.uint8)
        sizes = self.sizes[rows]
        out.reshape(-1)[flat_ranges(np.arange(len(rows)) * width, sizes)] = self.flat[flat_ranges(self.starts[rows], sizes)]
        return out


def _deal(batches):
    """Each word in its block, and as a visitor of the neighbouring ones."""
    steps = [(HOST, np.zeros(1, np.uint64))]
    steps += [(VISITOR, GROUP_NUMBERS[[a]] - GROUP_NUMBERS[[b]]) for a in range(GROUPS) for b in range(a)]
    steps += [(VISITOR, GROUP_NUMBERS[[a]]) for a in range(GROUPS)]
    for batch in batches:
        if not batch.num_rows:
            continue
        letters = Letters(batch.column("word"))
        blocks = np.add.reduceat(GROUP_NUMBERS[COUNT_COLUMNS[letters.flat] % GROUPS], letters.starts)
        size = pa.array(letters.sizes)
        for role, step in steps:
            role = pa.array(np.full(batch.num_rows, role, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array((blocks + step).view(np.int64)), role, size, batch.column("word"), batch.column("n")], ["block", "role", "size", "word", "n"])


def _near(letters: Letters, hosts: np.ndarray, guests: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are one edit apart; hosts have `length` letters, guests as many or one less."""
    same = letters.sizes[guests] == length
    x, y = letters.padded(hosts, length), letters.padded(guests, length)
    differs = x != y
    # a letter less: they agree before some place, and from there on moved by one
    first = np.where(differs.any(1), differs.argmax(1), length)
    shifted = x[:, 1:] != y[:, :-1]
    last = np.where(shifted.any(1), length - 2 - shifted[:, ::-1].argmax(1), -1)
    good = np.where(same, differs.sum(1) == 1, first > last)
    return hosts[good], guests[good]


def _meet(letters: Letters, roles: np.ndarray, a: int, b: int, split: bool):
    """Near pairs of hosts with guests among the rows a to b of one cell, in which hosts come first.

    In the cell of an undivided block hosts meet one another too; in a divided one they come once more among the guests.
    """
    hosts = np.searchsorted(roles[a:b], HOST, "right")
    if not hosts or hosts == b - a == 1:
        return
    length = int(letters.sizes[a])
    # products are exact: sums of squares stay below 2^24 in the shorter form
    counts = letters.counts(a, b, np.float32 if length < 4000 else np.float64)
    guest_from = hosts if split else 0
    guests = counts[guest_from:]
    norms = (counts * counts).sum(1)
    for top in range(0, hosts, 256):
        tile = counts[top : min(top + 256, hosts)]
        distance = norms[top : top + len(tile), None] + norms[None, guest_from:] - 2 * (tile @ guests.T)
        i, j = np.nonzero(distance <= 2)
        i, j = i + top + a, j + guest_from + a
        if not split:
            once = i < j
            i, j = i[once], j[once]
        for cut in range(0, len(i), 1 << 16):
            yield _near(letters, i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)], length)


def _compare(batches):
    rest = None
    for batch in _with_end(batches):
        if batch is not None:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest.num_rows < 20_000:
                continue
        if rest is None or not rest.num_rows:
            return
        rows = rest.combine_chunks().to_batches()[0]
        block, host, guest, roles = (rows.column(c).to_numpy() for c in ("block", "host", "guest", "role"))
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (host[1:] != host[:-1]) | (guest[1:] != guest[:-1])]))
        ends = np.append(new[1:], len(block))
        # the last cell may go on in the next batch
        whole = len(new) - (batch is not None)
        letters, n, words = Letters(rows.column("word")), rows.column("n").to_numpy(), rows.column("word")
        pairs = [p for a, b in zip(new[:whole].tolist(), ends[:whole].tolist(), strict=True) for p in _meet(letters, roles, a, b, host[a] >= 0)]
        if pairs:
            i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            # residents of a split block meet twice: the pair is kept once
            second = roles[j] == SECOND
            if second.any():
                keep = ~second
                keep[second] = np.array([words[x].as_py() < words[y].as_py() for x, y in zip(i[second].tolist(), j[second].tolist(), strict=True)], bool)
                i, j = i[keep], j[keep]
            both, other = np.concatenate([i, j]), np.concatenate([j, i])
            columns = [words.take(pa.array(both)), pa.array(n[both]), words.take(pa.array(other)), pa.array(n[other])]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])
        rest = rest.slice(int(new[-1])) if batch is not None else None


def _with_end(batches):
    yield from batches
    yield None


def near_words(words: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of near words of a stored (word, n)."""
    dealt = stored(words.mapInArrow(_deal, "block long, role int, size long, word string, n long"), "spelling-blocks")
    letters = [F.sum(F.when(F.col("role") == role, F.col("size")).otherwise(0)) for role in (HOST, VISITOR)]
    sizes = dealt.groupBy("block").agg(letters[0].alias("hosts"), (letters[0] + letters[1]).alias("guests")).where("hosts > 0")
    chunks = sizes.select("block", *[F.ceil(F.col(c) / chunk_bytes).cast("int").alias(c) for c in ("hosts", "guests")])
    dealt = dealt.join(stored(chunks, "spelling-chunks"), "block")
    own = F.pmod(F.xxhash64("word"), F.col("hosts")).cast("int")
    met = F.pmod(F.xxhash64("word", F.lit(1)), F.col("guests")).cast("int")
    each = ["block", "word", "n"]
    whole = dealt.where("guests = 1").select("block", F.lit(-1).alias("host"), F.lit(-1).alias("guest"), "role", "word", "n")
    large = dealt.where("guests > 1")
    hosts = large.where(F.col("role") == HOST).select(*each, own.alias("host"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("guest"), F.lit(HOST).alias("role"))
    role = F.when(F.col("role") == HOST, SECOND).otherwise(VISITOR).alias("role")
    guests = large.select(*each, F.explode(F.sequence(F.lit(0), F.col("hosts") - 1)).alias("host"), met.alias("guest"), role)
    cells = whole.unionByName(hosts).unionByName(guests)
    cells = cells.repartition("block", "host", "guest").sortWithinPartitions("block", "host", "guest", "role")
    return cells.select("block", "host", "guest", "role", "word", "n").mapInArrow(_compare, "word string, n long, near string, near_n long")


def group_variants(words: DataFrame, ratio: int = FORM_RATIO, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of a stored (word, n)."""
    near = near_words(words, chunk_bytes).unionByName(words, allowMissingColumns=True)
    best = F.min(F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))))
    found = near.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    found = stored(found.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "spelling-forms")
    paths, left = found.where("form is not null").select("word", F.col("form").alias("root")), 1
    while left:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = stored(paths.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        left = paths.where("moved").limit(1).count()
        paths = paths.drop("moved")
    return found.join(paths, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
