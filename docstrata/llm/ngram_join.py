"""Jaccard self-join over five-word shingles with a count-vector R-tree.

A document is the set of its distinct shingle hashes. Two documents link when intersection / union >= 0.8.

1. Equal sets fall together by digest; their class is its smallest document.
2. Documents at that similarity share one of their first `size - ceil(0.8 size) + 1` hashes, in any order that is the same for
   all. Hashes that many documents have come last: those of one document in `SAMPLE_SHARE` are counted, and the most frequent
   (at most `FREQUENT_ROWS`) are put behind all others, so that a passage that many documents share seldom deals them out. The
   order only saves work; no result depends on it. First hashes are dealt out; one that only one document has is dropped where
   it lies.
3. A first round compares every document of such a group with the group's smallest one only. Linked documents form
   components, so the many copies of one text cost one comparison each and never all pairs.
4. What is left are groups with several components. Hashes dealt into token groups make a document a point of counts. An
   R-tree over the points bounds the overlap of two boxes by the summed minima of their upper corners, and boxes (or
   points) that cannot reach the overlap needed, or lie in one component, are dropped. So are those that cannot reach it
   with what their sets hold from the group's hash on: a pair is looked at where its first common hash is. Groups of more than `block_rows`
   documents are cut into chunks, and each pair of chunks is a block of its own.
5. Surviving pairs are bounded once more with finer counts, verified on the whole sets, and components are taken again.

Each (distinct) pair that may link is verified or already connected, so the components are exact.

Defined cases: null and empty texts, and texts without words, have the empty set (n_shingles 0) and link with nothing;
fewer than five words are one shingle. Rows with equal ids are texts of one document, which links when any of them does;
each is a row of the result. A null id links with nothing and has a null component. A very
long text is worked on alone, whole; its set is held in memory. Ties do not arise: a component has the name of its smallest id. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import Words, components, mix, slices, stored, text_of, window_hashes

WIDTH = 5
TOKEN_GROUPS = 128
#: Shingles per group of the fine counts that surviving pairs are bounded with before their sets are fetched.
FINE_SHARE = 4
BROADCAST_NODES = 100_000
FANOUT = 16
BUNDLE_ROWS = 30_000
SAMPLE_SHARE, LEAST_SAMPLED, FREQUENT_ROWS = 64, 3, 200_000

# ---------------------------------------------------------------- sets


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    # all windows of the batch at once; those that run over the end of a text are skipped
    windows = window_hashes(words.hashes, WIDTH)
    out = []
    for start, n in zip(words.word_at[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= WIDTH:
            out.append(np.unique(windows[start : start + n - WIDTH + 1]))
        elif n:
            out.append(window_hashes(words.hashes[start : start + n], n) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def count_vector(shingles: np.ndarray, groups: int = TOKEN_GROUPS) -> np.ndarray:
    """How many shingles each token group has; `groups` is a power of two, so that finer counts fold into coarser ones."""
    return np.bincount((mix(shingles) & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def fine_counts(shingles: np.ndarray) -> bytes:
    groups = max(TOKEN_GROUPS, 1 << (len(shingles) // FINE_SHARE).bit_length())
    return count_vector(shingles, groups).astype("<u2").tobytes()


def fine_bound(a: bytes, b: bytes) -> int:
    """The summed minima of two fine counts, the finer one folded."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    groups = min(len(x), len(y))
    x, y = (v.reshape(-1, groups).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum())


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _digests(batches):
    for batch in batches:
        for part in slices([batch], "t"):
            sets = shingle_sets(part.column("t"))
            # two sums over differently mixed members: equal sets, and in practice only those, have equal digests
            sums = [(int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in sums], pa.int64()),
                    pa.array([b for _, b in sums], pa.int64()),
                    _lists([count_vector(s) for s in sets], pa.int32()),
                    pa.array([fine_counts(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest_a", "digest_b", "vector", "fine"],
            )


def _sampled_shingles(batches):
    for batch in batches:
        for part in slices([batch], "t"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(part.column("t"))).view(np.int64))], ["shingle"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The sorted hashes that come last in the order of shingles, at most FREQUENT_ROWS of them."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_SHARE)) == 0).select("t")
    counts = sample.mapInArrow(_sampled_shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    most = counts.where(F.col("n") >= LEAST_SAMPLED).orderBy(F.desc("n"), "shingle").limit(FREQUENT_ROWS)
    return np.sort(np.array([r["shingle"] for r in most.select("shingle").collect()], np.int64).view(np.uint64))


class Order:
    """The order of shingles: the frequent ones last, else by hash."""

    def __init__(self, frequent: np.ndarray):
        self.frequent, self.low = frequent, np.zeros(1 << 22, bool)
        self.low[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def is_frequent(self, shingles: np.ndarray) -> np.ndarray:
        out = self.low[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.frequent, shingles[at]), len(self.frequent) - 1)
            out[at] = self.frequent[place] == shingles[at]
        return out

    def sorted(self, sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each sorted set in this order, and its keys: numbers in the same order."""
        flags = self.is_frequent(np.concatenate(sets)) if sets else np.zeros(0, bool)
        out, keys, at = [], [], 0
        for s in sets:
            last = flags[at : at + len(s)]
            at += len(s)
            if last.any():
                s, last = np.concatenate([s[~last], s[last]]), np.sort(last)
            out.append(s)
            keys.append((s >> np.uint64(2)).astype(np.int64) | (last.astype(np.int64) << 62))
        return out, keys


def _postings(frequent):
    def run(batches):
        order = Order(frequent.value)
        for batch in batches:
            for part in slices([batch], "t"):
                sets, keys = order.sorted(shingle_sets(part.column("t")))
                sizes = np.array([len(s) for s in sets])
                counts = np.array([prefix_size(n) for n in sizes.tolist()])
                ranks = np.concatenate([np.arange(n) for n in counts])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([k[:n] for k, n in zip(keys, counts.tolist(), strict=True)])),
                        pa.array(np.repeat(part.column("doc_id").to_numpy(), counts)),
                        pa.array(np.repeat(sizes, counts).astype(np.int32)),
                        pa.array(ranks.astype(np.int32)),
                    ],
                    ["key", "doc", "size", "rank"],
                )

    return run


def _whole_sets(batches):
    for batch in batches:
        for part in slices([batch], "t"):
            sets = shingle_sets(part.column("t"))
            yield pa.RecordBatch.from_arrays([part.column("node"), _lists([s.view(np.int64) for s in sets], pa.int64())], ["node", "shingles"])


# ---------------------------------------------------------------- tree


class CountTree:
    """Bulk-loaded R-tree over count vectors.

    A node keeps its upper corner, its range of sizes, its component if it has one, and the most hashes that one of its sets
    has from the group's on (`rests`).
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, parts: np.ndarray, rests: np.ndarray):
        self.order = np.lexsort((vectors[:, 1], vectors[:, 0], sizes // 8, parts))
        self.levels = [(vectors[self.order], sizes[self.order], sizes[self.order], parts[self.order], rests[self.order])]
        while len(self.levels[-1][1]) > 1:
            corner, low, high, part, rest = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first, last = np.minimum.reduceat(part, at), np.maximum.reduceat(part, at)
            upper = [np.maximum.reduceat(x, at) for x in (corner, high, rest)]
            self.levels.append((upper[0], np.minimum.reduceat(low, at), upper[1], np.where(first == last, first, -1), upper[2]))

    def pairs(self, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points, by their place, that may link and are not in one component; with `split`, across it only."""
        sides = None if split is None else split[self.order]
        left = right = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            if depth < len(self.levels) - 1:
                n = len(self.levels[depth][1])
                left, right = self._children(left, right, n)
            left, right = self._possible(depth, left, right)
        if sides is not None:
            crossing = sides[left] != sides[right]
            left, right = left[crossing], right[crossing]
        return self.order[left], self.order[right]

    def _children(self, left, right, n):
        i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
        a, b = (left[:, None] * FANOUT + i).ravel(), (right[:, None] * FANOUT + j).ravel()
        keep = (a < n) & (b < n) & (a <= b)
        return a[keep], b[keep]

    def _possible(self, depth, left, right):
        corner, low, high, part, rest = self.levels[depth]
        if not depth:
            apart = left < right
            left, right = left[apart], right[apart]
        fits = (part[left] != part[right]) | (part[left] < 0)
        fits &= (5 * high[right] >= 4 * low[left]) & (5 * high[left] >= 4 * low[right])
        fits &= 9 * np.minimum(rest[left], rest[right]) >= 4 * (low[left] + low[right])
        left, right = left[fits], right[fits]
        kept = [np.zeros(0, bool)]
        for at in range(0, len(left), 50_000):
            a, b = left[at : at + 50_000], right[at : at + 50_000]
            bound = np.minimum(corner[a], corner[b]).sum(axis=1)
            kept.append(9 * bound >= 4 * (low[a] + low[b]))
        kept = np.concatenate(kept)
        return left[kept], right[kept]


def _tree_join(batches):
    """Rows sorted by bundle and block; a block may run over several batches, and holds at most two chunks of documents.

    The blocks of a bundle have much the same pairs, which are given once, as far as `BUNDLE_ROWS` go.
    """
    waiting: list[pa.RecordBatch] = []

    def joined(rows: pa.Table):
        if not rows.num_rows:
            return
        block = rows.column("block").to_numpy()
        node, size, rank, part, side = (rows.column(c).to_numpy() for c in ("node", "size", "rank", "component", "side"))
        size = size.astype(np.int64)
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, TOKEN_GROUPS)
        cuts = np.flatnonzero(np.diff(block)) + 1
        out: list[np.ndarray] = []
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if stop - start > 1:
                of = slice(start, stop)
                _, parts = np.unique(part[of], return_inverse=True)
                sides = side[of]
                a, b = CountTree(vectors[of], size[of], parts, (size - rank)[of]).pairs(sides if sides.any() else None)
                x, y = node[of][a], node[of][b]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        if out:
            a, b = np.concatenate(out, axis=1)
            both = pa.table({"a": a, "b": b}).group_by(["a", "b"]).aggregate([])
            yield from both.to_batches()

    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        held += batch.num_rows
        name = "bundle" if batch.column("bundle")[0].as_py() != batch.column("bundle")[batch.num_rows - 1].as_py() else "block"
        if name == "bundle" or held > BUNDLE_ROWS:
            rows = pa.Table.from_batches(waiting)
            names = rows.column(name).to_numpy()
            last = int(np.flatnonzero(names != names[-1])[-1]) + 1 if names[0] != names[-1] else 0
            yield from joined(rows.slice(0, last))
            waiting = rows.slice(last).to_batches()
            held = rows.num_rows - last
    if waiting:
        yield from joined(pa.Table.from_batches(waiting))


# ---------------------------------------------------------------- join


def _verified(batches):
    for batch in batches:
        keep = []
        of_a, of_b = batch.column("set_a"), batch.column("set_b")
        for x, y in zip(of_a, of_b, strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _possible(batches):
    for batch in batches:
        keep = []
        for size_a, size_b, a, b in zip(*(batch.column(c).to_pylist() for c in ("size_a", "size_b", "fine_a", "fine_b")), strict=True):
            keep.append(9 * fine_bound(a, b) >= 4 * (size_a + size_b))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def possible_pairs(pairs: DataFrame, digests: DataFrame, name: str) -> DataFrame:
    """Those (a, b) pairs that sizes and fine counts allow."""
    for side in ("a", "b"):
        counts = digests.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("fine").alias(f"fine_{side}"))
        pairs = pairs.join(counts, side)
    pairs = pairs.where("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")
    return stored(pairs.select("a", "b", "size_a", "size_b", "fine_a", "fine_b").mapInArrow(_possible, "a long, b long").distinct(), f"{name}-pairs")


def verified_links(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those (a, b) pairs whose whole sets reach the similarity."""
    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{name}-nodes")
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    texts = docs.join(nodes, docs["doc_id"] == nodes["node"]).select("node", "t")
    sets = stored(texts.mapInArrow(_whole_sets, "node long, shingles array<long>"), f"{name}-sets")
    sided = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    sided = sided.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return stored(sided.select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a long, b long"), f"{name}-links")


def link_documents(documents: DataFrame, block_rows: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(documents).alias("t"))
    with_id = docs.where("doc_id is not null")
    digests = stored(docs.mapInArrow(_digests, "doc_id long, n_shingles long, digest_a long, digest_b long, vector array<int>, fine binary"), "shingles-digests")
    classes = digests.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "digest_a", "digest_b").agg(F.min("doc_id").alias("class"))
    copies = stored(
        digests.join(classes, ["n_shingles", "digest_a", "digest_b"]).where("doc_id <> class").select(F.col("doc_id").alias("doc"), "class").distinct(), "shingles-copies"
    )
    # a document is compared in the name of its class only if it has no other text
    per_id = digests.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id")
    several = per_id.agg(*[(F.min(c) != F.max(c)).alias(c) for c in ("digest_a", "digest_b")]).where("digest_a or digest_b").select(F.col("doc_id").alias("doc"))
    several = stored(several, "shingles-several").withColumn("several", F.lit(True))
    renamed = stored(copies.join(several, "doc", "left_anti"), "shingles-renamed")

    # Documents that share one of their first hashes, with the smallest document that does.
    group = Window.partitionBy("key")
    # at most FREQUENT_ROWS numbers
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(with_id))
    postings = with_id.mapInArrow(_postings(frequent), "key long, doc long, size int, rank int")
    shared = postings.withColumns({"center": F.min("doc").over(group), "last": F.max("doc").over(group)}).where("center <> last").drop("last")
    shared = stored(shared, "shingles-shared")
    # A copy's place is its class's.
    shared = shared.join(renamed, "doc", "left").join(several, "doc", "left").select("key", F.coalesce("class", "doc").alias("node"), "size", "rank", "center", "several")
    shared = shared.join(renamed.select(F.col("doc").alias("center"), F.col("class").alias("of")), "center", "left")
    shared = shared.select("key", "node", "size", "rank", F.coalesce("of", "center").alias("center"), "several").distinct()
    shared = stored(shared, "shingles-groups")

    stars = shared.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = verified_links(with_id, possible_pairs(stars, digests, "shingles-star"), "shingles-star")
    found = stored(components(links, "shingles-star"), "shingles-component")

    pairs = remaining_pairs(shared, found, digests, block_rows)
    more = verified_links(with_id, possible_pairs(pairs, digests, "shingles-rest"), "shingles-rest")
    everything = links.union(more).union(copies.select("doc", "class"))
    found = components(everything, "shingles-all")
    joined = digests.join(found, digests["doc_id"] == found["node"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def remaining_pairs(shared: DataFrame, found: DataFrame, digests: DataFrame, block_rows: int) -> DataFrame:
    """Distinct pairs of different components within groups that the tree cannot rule out."""
    members = shared.join(found, "node", "left").select("key", "node", "size", "rank", "several", F.coalesce("component", "node").alias("component"))
    # of groups with the same members, as the hashes of a shared passage have, the least hash is every pair's first;
    # a document with several texts may be there for another one each time
    groups = members.groupBy("key").agg(
        F.min("node").alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"),
        F.max(F.when(F.col("several"), F.col("key"))).alias("own"),
    )
    groups = groups.where("low <> high").groupBy("rows", "members", "own").agg(F.min("key").alias("key"), F.min("lead").alias("lead"))
    chunks = F.ceil(F.col("rows") / block_rows).cast("int")
    rows = members.join(groups, "key").withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("node"), chunks).cast("int")})
    # a chunk meets itself and every other chunk of its group, each pair once: side tells the two chunks of a block apart
    met = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.struct(F.least("chunk", other).alias("i"), F.greatest("chunk", other).alias("j"), (other < F.col("chunk")).cast("int").alias("side")),
    )
    rows = rows.select("key", "lead", "node", "size", "rank", "component", F.explode(met).alias("m"))
    rows = rows.join(digests.select(F.col("doc_id").alias("node"), "vector"), "node").select(F.xxhash64("lead", "m.i", "m.j").alias("bundle"), F.xxhash64("key", "m.i", "m.j").alias("block"), "node", "size", "rank", "component", "m.side", "vector")
    rows = rows.repartition("bundle").sortWithinPartitions("bundle", "block")
    return rows.mapInArrow(_tree_join, "a long, b long").distinct()


def one_of_each_group(documents: DataFrame, block_rows: int = 1000) -> DataFrame:
    """All columns of the rows that stay: of each component the rows of its smallest id.

    Rows without a shingle or without an id stay.
    """
    names = documents.columns
    found = stored(link_documents(documents, block_rows), "shingles-found").select(F.col("doc_id").alias("of"), "component_id")
    # rows of one id are in one component
    gone = found.where("component_id <> of").select("of").distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, rows["id"] == gone["of"], "left_anti").select(*[F.col("row")[c].alias(c) for c in names])
