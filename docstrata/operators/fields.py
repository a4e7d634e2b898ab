"""Field statistics over path rows: presence, types, numbers, examples, hints.

Groups are keyed by path (and type), so one group can hold a value of every
document. All aggregates used here combine on the map side to one row per group
and task; buffers are fixed width wherever the document id is a number, so they
run as hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import masks, pii
from docstrata.functions.paths import TRUNCATED, WILDCARD, path_key
from docstrata.operators.flatten import MARKER, SPLIT_COLLECTIONS, VALUE, flatten_documents
from docstrata.options import ProfileOptions
from docstrata.session import cut_lineage

EMPTY_TYPES = ("null", "undefined")

FIELD = ["collection", "path"]
FIELD_TYPE = ["collection", "path", "type"]

# Rendered values are spread over this many slots to bound the search for first examples.
EXAMPLE_SLOTS = 16
# Size of quantile sketches.
QUANTILE_SIZE = 1000
# One document in so many is looked at for the bounds of that search, and so many bounds are kept at most.
BOUND_SHARE, BOUND_ROWS = 64, 100_000


def field_rows(paths: DataFrame) -> DataFrame:
    """Rows that describe fields: no type markers, depth cuts or bare array elements."""
    return drop_marker_paths(paths).where(F.col("kind") == VALUE)


def drop_marker_paths(paths: DataFrame) -> DataFrame:
    path = F.col("path")
    return paths.where(~F.endswith(path, F.lit(f".{WILDCARD}")) & ~F.endswith(path, F.lit(f".{TRUNCATED}")))


# Schema texts that do not settle which paths a document has: quoted keys, elements of several kinds, an array that may be empty.
_UNSETTLED = "(contains(s, '`') or contains(s, 'VARIANT') or s = 'ARRAY<VOID>')"


def field_names(documents: DataFrame) -> DataFrame:
    """Distinct (collection, path) of the field rows of documents flattened without caps.

    Documents of one schema text have the same paths, so one made-up document is flattened for each text, in which an array
    is an object whose only key is an index. Documents whose text leaves their paths open are flattened themselves.
    """
    described = documents.withColumn("s", F.expr("schema_of_variant(v)"))
    # no filter here: it would read every document twice
    texts = cut_lineage(described.select("collection", F.expr(f"if({_UNSETTLED}, '', s)").alias("s")).distinct())
    like = "s"
    for pattern, made in ((r"(\w+): ", '"$1":'), ("OBJECT<", "{"), ("ARRAY<", '{"[0]":'), (">", "}"), (r":[A-Z][A-Z_ ]*(\([0-9, ]*\))?", ":0")):
        like = F.regexp_replace(like, pattern, made)
    made_up = texts.where("s <> ''").select("collection", F.lit(0).cast("bigint").alias("doc_id"), F.try_parse_json(like).alias("v"))
    names = field_rows(flatten_documents(made_up)).select(*FIELD)
    unsettled = [r[0] for r in texts.where("s = ''").select("collection").limit(SPLIT_COLLECTIONS + 1).collect()]
    if unsettled:
        # collections without such documents are not read again
        if len(unsettled) <= SPLIT_COLLECTIONS:
            described = described.where(F.coalesce(F.col("collection").isin([c for c in unsettled if c is not None]), F.lit(None in unsettled)))
        own = described.where(_UNSETTLED).select("collection", "doc_id", "v")
        names = names.unionByName(field_rows(flatten_documents(own)).select(*FIELD))
    return names.distinct()


def document_counts(documents: DataFrame) -> DataFrame:
    """Documents per collection; those that did not parse are counted by `rejected_documents` instead."""
    return documents.where("v is not null").groupBy("collection").agg(F.count(F.lit(1)).alias("docs"))


def position(df: DataFrame) -> Column:
    """Orders occurrences by (doc_id, pos); a plain decimal when the id is a whole number."""
    if isinstance(df.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        wide = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)")
        return (wide + F.col("pos")).cast("decimal(38,0)")
    return F.struct("doc_id", "pos")


# --- presence ----------------------------------------------------------------------------------


def presence_counts(paths: DataFrame) -> DataFrame:
    """Distinct documents per path.

    Rows that cannot repeat within their document are simply counted; only paths inside arrays
    of two or more elements need their document ids compared.
    """
    repeated = F.when(~F.col("solo"), F.col("doc_id"))
    return paths.groupBy(*FIELD).agg(
        (F.count_if("solo") + F.count_distinct(repeated)).alias("present_count")
    )


def field_presence(paths: DataFrame, totals: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    counted = presence_counts(field_rows(paths)).join(totals, "collection")
    ratio = F.col("present_count") / F.col("docs")
    return counted.select(
        *FIELD,
        "present_count",
        (F.col("docs") - F.col("present_count")).alias("absent_count"),
        ratio.alias("present_ratio"),
        (ratio < options.optional_threshold).alias("optional"),
    )


# --- types -------------------------------------------------------------------------------------


def type_counts(paths: DataFrame) -> DataFrame:
    """Occurrences per (path, type), with the position of the first one."""
    return field_rows(paths).groupBy(*FIELD_TYPE).agg(
        F.count(F.lit(1)).alias("n"), F.min(position(paths)).alias("first")
    )


def type_distribution(paths: DataFrame) -> DataFrame:
    return field_rows(paths).groupBy(*FIELD_TYPE).agg(F.count(F.lit(1)).alias("n"))


def type_ratio(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*FIELD))
    return counts.withColumn("ratio", F.col("n") / total)


def mixed_types(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*FIELD).agg((F.count_if(~F.col("type").isin(*EMPTY_TYPES)) > 1).alias("mixed_type"))


def primary_type(counts: DataFrame) -> DataFrame:
    """Most frequent real type, the first seen on ties; NULL when there is none."""
    real = ~F.col("type").isin(*EMPTY_TYPES)
    rank = F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("type"))
    return counts.groupBy(*FIELD).agg(F.min(F.when(real, rank))["type"].alias("primary_type"))


# --- numbers -----------------------------------------------------------------------------------


def numeric_values(paths: DataFrame) -> DataFrame:
    """Numeric occurrences, their value in `num`; NaN is dropped."""
    return field_rows(paths).where("num is not null")


def numeric_stats(paths: DataFrame) -> DataFrame:
    return numeric_values(paths).groupBy(*FIELD).agg(
        F.min("num").alias("min"), F.max("num").alias("max"), F.avg("num").alias("avg")
    )


def field_stddev(paths: DataFrame) -> DataFrame:
    """Population standard deviation, 0 for a single value."""
    return numeric_values(paths).groupBy(*FIELD).agg(F.coalesce(F.stddev_pop("num"), F.lit(0.0)).alias("stddev"))


def field_percentile(paths: DataFrame, p: float) -> DataFrame:
    """Exact linearly interpolated percentile, without gathering the values of a field.

    Distinct values are range-partitioned by (field, value), counted per partition, and the two
    values around the target rank are picked by running counts. A field's values spread over as
    many partitions as they need.
    """
    distinct = numeric_values(paths).groupBy(*FIELD, "num").agg(F.count(F.lit(1)).alias("n"))
    ranged = distinct.repartitionByRange(*FIELD, "num").withColumn("part", F.spark_partition_id())
    # Both uses below must see the same partition numbers.
    ranged = cut_lineage(ranged)
    per_part = ranged.groupBy(*FIELD, "part").agg(F.sum("n").alias("part_n"))
    by_field = Window.partitionBy(*FIELD)
    offsets = per_part.select(
        *FIELD,
        "part",
        (F.sum("part_n").over(by_field.orderBy("part")) - F.col("part_n")).alias("before"),
        F.sum("part_n").over(by_field).alias("total"),
    )
    running = F.sum("n").over(Window.partitionBy(*FIELD, "part").orderBy("num"))
    ranked = ranged.withColumn("running", running).join(offsets, [*FIELD, "part"])
    last = F.col("before") + F.col("running")
    target = F.lit(p / 100.0) * (F.col("total") - 1)
    low, high = F.floor(target) + 1, F.ceil(target) + 1
    first = last - F.col("n") + 1
    hit_low, hit_high = low.between(first, last), high.between(first, last)
    picked = ranked.where(hit_low | hit_high).select(
        *FIELD,
        F.when(hit_low, F.col("num")).alias("low"),
        F.when(hit_high, F.col("num")).alias("high"),
        (target - F.floor(target)).alias("fraction"),
    )
    lower, upper, fraction = F.max("low"), F.max("high"), F.max("fraction")
    return picked.groupBy(*FIELD).agg((lower * (1 - fraction) + upper * fraction).alias("percentile"))


def partial_quantiles(paths: DataFrame, size: int = QUANTILE_SIZE) -> DataFrame:
    """A quantile sketch of the numbers of each field, which adds up across disjoint sets of documents.

    The rank of a value read from a sketch of size k is off by some 2.3 / k^0.9 of the values (1.3 % for 200, 0.3 % for 1000)
    with 99 % confidence, for one set or many. It takes one map-side combined pass and no sort; see `field_percentile` for
    exact percentiles.
    """
    return numeric_values(paths).groupBy(*FIELD).agg(F.kll_sketch_agg_double("num", F.lit(size)).alias("sketch"))


def merge_quantiles(*parts: DataFrame) -> DataFrame:
    """Sketches of all documents from those of disjoint sets, fresh or read back from a table."""
    union = parts[0]
    for other in parts[1:]:
        union = union.unionByName(other)
    return union.groupBy(*FIELD).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentile(quantiles: DataFrame, p: float) -> DataFrame:
    """A value near the p-th percentile of each field, and of how many numbers."""
    return quantiles.select(
        *FIELD,
        F.kll_sketch_get_n_double("sketch").alias("n"),
        F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0)).alias("percentile"),
    )


# --- examples and hints ------------------------------------------------------------------------


def rendered_rows(paths: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Field rows with the text shown for them under the options' policy, and their value hints."""
    custom = options.pii_patterns
    value = F.when(F.col("type") == "string", F.col("text"))
    rows = field_rows(paths).withColumn("value_mask", pii.value_hint_mask(value, custom))
    shown = masks.render_example(
        F.col("path"), F.col("type"), F.col("text"), F.col("size"), F.col("value_mask"),
        options.redact, options.redact_mode, custom, options.mask_short,
    )
    return rows.withColumn("rendered", shown)


def example_bounds(paths: DataFrame, k: int, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """bounds(collection, path, type, bound): a position by which k distinct rendered values have been seen.

    Looks at one document in `BOUND_SHARE` only. Values are hashed into slots: k different slots prove k different values,
    so the k-th earliest slot of any documents is behind the k-th value of all. Types that show too few values there have
    no bound, nor have those beyond the `BOUND_ROWS` most frequent, so the table is small enough to be broadcast.
    """
    some = rendered_rows(paths.where(F.pmod(F.xxhash64("doc_id"), F.lit(BOUND_SHARE)) == 0), options)
    slot = F.pmod(F.xxhash64("rendered"), F.lit(max(EXAMPLE_SLOTS, 4 * k))).alias("slot")
    slots = some.groupBy(*FIELD_TYPE, slot).agg(F.min(position(paths)).alias("at"), F.count(F.lit(1)).alias("n"))
    earliest = F.sort_array(F.collect_list("at"))
    bounds = slots.groupBy(*FIELD_TYPE).agg(F.sum("n").alias("n"), F.try_element_at(earliest, F.lit(k)).alias("bound"))
    return bounds.where("bound is not null").orderBy(F.desc("n"), *FIELD_TYPE).limit(BOUND_ROWS).drop("n")


def near_rows(paths: DataFrame, k: int, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Field rows with `at`, and `near`: may this be one of the first k distinct values of its type?"""
    rows = field_rows(paths).withColumn("at", position(paths))
    rows = rows.join(F.broadcast(example_bounds(paths, k, options)), FIELD_TYPE, "left")
    return rows.withColumn("near", F.col("bound").isNull() | (F.col("at") <= F.col("bound"))).drop("bound")


def examples_per_type(paths: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """The first k distinct rendered values of every (path, type), in (doc_id, pos) order.

    Shuffling every distinct value would move most of the data for unique fields. Only rows up to a bound that some of the
    documents give are compared (see `example_bounds`); the result is exact.
    """
    k = options.examples_per_type
    near = rendered_rows(near_rows(paths, k, options).where("near"), options)
    return first_distinct(near.select(*FIELD_TYPE, "rendered", "value_mask", "at"), FIELD_TYPE, k)


def first_distinct(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows(keys, rendered, value_mask, at) -> rank, rendered, value_mask of the first k distinct."""
    distinct = rows.groupBy(*keys, "rendered").agg(
        F.min("at").alias("at"), F.min_by("value_mask", "at").alias("value_mask")
    )
    order = Window.partitionBy(*keys).orderBy("at", "rendered")
    ranked = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(*keys, "rank", "rendered", "value_mask", "at")


def field_hints(paths: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Distinct hints of every field over all of its values, in report order.

    Paths flattened with `strings` cost less: only texts are read.
    """
    custom = options.pii_patterns
    value = F.col("string") if "string" in paths.columns else F.when(F.col("type") == "string", F.col("text"))
    per_field = (
        field_rows(paths)
        .groupBy(*FIELD)
        .agg(F.bit_or(pii.value_hint_mask(value, custom)).alias("value_mask"))
    )
    mask = F.col("value_mask").bitwiseOR(pii.path_hint_mask(F.col("path"), custom))
    return per_field.select(*FIELD, pii.hints_of(mask, custom).alias("hints"))


# --- whole profiles ----------------------------------------------------------------------------


# What a row of `_profile_rows` stands for.
_OCCURRENCE, _IN_DOCUMENT, _EXAMPLE = 0, 1, 2


def _profile_rows(paths: DataFrame, options: ProfileOptions, examples: bool) -> DataFrame:
    """Every field row once for its type, once for its document if others may share it, once more if it may be an example."""
    k, custom = options.examples_per_type, options.pii_patterns
    rows = near_rows(paths, k, options) if examples else field_rows(paths).withColumn("at", position(paths))
    mask = pii.value_hint_mask(F.when(F.col("type") == "string", F.col("text")), custom)
    rows = rows.withColumn("mask", mask)
    no_doc, no_value = F.lit(None).cast(paths.schema["doc_id"].dataType), F.lit(None).cast("string")

    def entry(kind: int, doc: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), doc.alias("doc"), value.alias("value"))

    kinds = [entry(_OCCURRENCE, no_doc, no_value), F.when(~F.col("solo"), entry(_IN_DOCUMENT, F.col("doc_id"), no_value))]
    if examples:
        # only the rows that may be shown are rendered
        shown = masks.render_example(
            F.col("path"), F.col("type"), F.col("text"), F.col("size"), F.col("mask"),
            options.redact, options.redact_mode, custom, options.mask_short,
        )
        kinds.append(F.when(F.col("near"), entry(_EXAMPLE, no_doc, shown)))
    return rows.select(*FIELD_TYPE, "at", "num", "mask", "solo", F.inline(F.array_compact(F.array(*kinds))))


def profile_collection(
    paths: DataFrame, totals: DataFrame, options: ProfileOptions = ProfileOptions(), examples: bool = True
) -> DataFrame:
    """fields: one row per (collection, path), markers dropped.

    `types` lists struct<type, n, ratio> in first-seen order; `examples` follow the same order. Path rows are expanded once:
    the first aggregate counts occurrences per type, documents per path and examples per value side by side, each combined on
    the map side, and the further ones merge its rows. No job runs while the plan is built.
    """
    k, custom = options.examples_per_type, options.pii_patterns
    type_ = F.when(F.col("kind") != _IN_DOCUMENT, F.col("type"))
    numbers = [F.min("num").alias("low"), F.max("num").alias("high"), F.sum("num").alias("total"), F.count("num").alias("numbers")]
    first = _profile_rows(paths, options, examples).groupBy("collection", "path", "kind", type_.alias("type"), "doc", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("solo").alias("alone"),
        F.min("at").alias("at"),
        F.min_by("mask", "at").alias("mask_at"),
        F.bit_or("mask").alias("mask"),
        *numbers,
    )
    is_ = {kind: F.col("kind") == kind for kind in (_OCCURRENCE, _IN_DOCUMENT, _EXAMPLE)}
    shown = F.struct("at", "value", F.col("mask_at").alias("mask"))
    merged_numbers = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("numbers").alias("numbers")]
    sums = [F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.min("at").alias("at"), F.bit_or("mask").alias("mask"), *merged_numbers]
    # examples meet in slots first, so that no list holds all values of a type
    slot = F.when(is_[_EXAMPLE], F.pmod(F.xxhash64("value"), F.lit(EXAMPLE_SLOTS)))
    by_slot = first.groupBy("collection", "path", "kind", "type", slot.alias("slot")).agg(
        *sums, F.count(F.lit(1)).alias("rows"), F.slice(F.array_sort(F.collect_list(F.when(is_[_EXAMPLE], shown))), 1, k).alias("shown")
    )
    per_type = by_slot.groupBy("collection", "path", "kind", "type").agg(
        *sums, F.sum("rows").alias("rows"), F.slice(F.array_sort(F.flatten(F.collect_list("shown"))), 1, k).alias("shown")
    )
    only = lambda c: F.when(is_[_OCCURRENCE], F.col(c))
    per_field = per_type.groupBy(*FIELD).agg(
        (F.sum(only("alone")) + F.coalesce(F.sum(F.when(is_[_IN_DOCUMENT], F.col("rows"))), F.lit(0))).alias("present_count"),
        F.array_sort(F.collect_list(F.when(is_[_OCCURRENCE], F.struct("at", "type", "n")))).alias("listed"),
        F.sum(only("n")).alias("occurrences"),
        (F.count_if(is_[_OCCURRENCE] & ~F.col("type").isin(*EMPTY_TYPES)) > 1).alias("mixed_type"),
        F.when(
            F.sum(only("numbers")) > 0,
            F.struct(
                F.min("low").alias("min"),
                F.max("high").alias("max"),
                (F.sum(only("total")) / F.sum(only("numbers"))).alias("avg"),
            ),
        ).alias("stats"),
        F.bit_or("mask").alias("value_mask"),
        F.array_sort(F.collect_list(F.when(is_[_EXAMPLE], F.struct("at", "type", "shown")))).alias("shown"),
    )
    path_mask = pii.path_hint_mask(F.col("path"), custom)
    ratio = F.col("present_count") / F.col("docs")
    fields = per_field.join(totals, "collection").withColumn("path_mask", path_mask).select(
        *FIELD,
        ratio.alias("present_ratio"),
        "present_count",
        (F.col("docs") - F.col("present_count")).alias("absent_count"),
        (ratio < options.optional_threshold).alias("optional"),
        F.transform(
            "listed",
            lambda t: F.struct(t["type"].alias("type"), t["n"].alias("n"), (t["n"] / F.col("occurrences")).alias("ratio")),
        ).alias("types"),
        "mixed_type",
        "stats",
        pii.hints_of(F.col("value_mask").bitwiseOR(F.col("path_mask")), custom).alias("hints"),
        "shown",
        "path_mask",
    )
    if not examples:
        return fields.drop("shown", "path_mask")

    def entries(t: Column) -> Column:
        return F.transform(
            t["shown"],
            lambda e: F.struct(
                e["value"].alias("value"), t["type"].alias("type"), pii.hints_of(e["mask"].bitwiseOR(F.col("path_mask")), custom).alias("hints")
            ),
        )

    return fields.withColumn("examples", F.flatten(F.transform("shown", entries))).drop("shown", "path_mask")


def profile_field(paths: DataFrame, totals: DataFrame, path: str, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    return profile_collection(paths.where(F.col("path") == path), totals, options)


def in_path_order(fields: DataFrame) -> DataFrame:
    return fields.orderBy("collection", path_key(F.col("path")), "path")


# --- arrays, truncation, merging ---------------------------------------------------------------


def array_element_types(paths: DataFrame) -> DataFrame:
    """Per array path and element type: arrays containing it and documents containing it.

    Needs paths flattened with markers (one marker row per array and element type).
    """
    markers = paths.where(F.col("kind") == MARKER)
    return markers.groupBy(*FIELD_TYPE).agg(
        F.count(F.lit(1)).alias("arrays"), F.count_distinct("doc_id").alias("docs")
    )


def truncation_counters(paths: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Truncated depths, keys and arrays per collection; the NULL collection is the total."""
    capped = F.lit(False)
    if options.max_array_sample is not None:
        capped = (F.col("type") == "array") & (F.col("kind") == VALUE) & (F.col("size") > options.max_array_sample)
    per_collection = paths.groupBy("collection").agg(
        F.sum(F.col("depth_cut").cast("bigint")).alias("depth_truncated"),
        F.sum("keys_refused").alias("keys_truncated"),
        F.count_if(capped).alias("arrays_truncated"),
    )
    # The total is added up from one row per collection, so path rows are not expanded.
    return per_collection.rollup("collection").agg(
        *[F.sum(c).alias(c) for c in ("depth_truncated", "keys_truncated", "arrays_truncated")]
    )


def nothing_truncated(collections: DataFrame) -> DataFrame:
    """`truncation_counters` of collections whose documents are flattened without caps."""
    none = [F.lit(0).cast("bigint").alias(c) for c in ("depth_truncated", "keys_truncated", "arrays_truncated")]
    per_collection = collections.select("collection", *none)
    return per_collection.rollup("collection").agg(*[F.sum(c).alias(c) for c in ("depth_truncated", "keys_truncated", "arrays_truncated")])


def partial_profile(paths: DataFrame) -> DataFrame:
    """Counts that add up across disjoint sets of documents: n, num_n, num_sum, num_min, num_max.

    `docs` adds up too, because every document is in one set only.
    """
    rows = field_rows(paths)
    repeated = F.when(~F.col("solo"), F.col("doc_id"))
    return rows.groupBy(*FIELD_TYPE).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if("solo") + F.count_distinct(repeated)).alias("docs"),
        F.count("num").alias("num_n"),
        F.sum("num").alias("num_sum"),
        F.min("num").alias("num_min"),
        F.max("num").alias("num_max"),
    )


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Add up partial profiles of disjoint document sets, fresh or read back from a table."""
    union = profiles[0]
    for other in profiles[1:]:
        union = union.unionByName(other)
    return union.groupBy(*FIELD_TYPE).agg(
        F.sum("n").alias("n"),
        F.sum("docs").alias("docs"),
        F.sum("num_n").alias("num_n"),
        F.sum("num_sum").alias("num_sum"),
        F.min("num_min").alias("num_min"),
        F.max("num_max").alias("num_max"),
    )


def merge_paths(*paths: DataFrame) -> DataFrame:
    """Path rows of several document sets as one relation."""
    union = paths[0]
    for other in paths[1:]:
        union = union.unionByName(other)
    return union


# --- personal data -----------------------------------------------------------------------------


def pii_scan(paths: DataFrame, totals: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Per (collection, path, hint): documents hit and their share.

    A hint that follows from the path hits every document having it. Path rows are expanded once: rows that are alone in
    their document are counted by hint, those in arrays of two or more elements are first merged by document.
    """
    custom = options.pii_patterns
    names = pii.hint_order(custom)
    by_value = list(dict.fromkeys(hint for _, hint in pii.VALUE_PATTERNS))
    value = F.when(F.col("type") == "string", F.col("text"))
    rows = field_rows(paths).withColumn("mask", pii.value_hint_mask(value, custom))
    doc = F.when(~F.col("solo"), F.col("doc_id")).alias("doc")
    hit = {h: pii.has_hint(F.col("mask"), h, custom) for h in by_value}
    per_doc = rows.groupBy(*FIELD, doc).agg(
        F.count_if("solo").alias("alone"),
        F.bit_or(F.when(~F.col("solo"), F.col("mask"))).alias("mask"),
        *[F.count_if(F.col("solo") & hit[h]).alias(f"hit_{i}") for i, h in enumerate(by_value)],
    )
    in_arrays = F.coalesce(F.col("mask"), F.lit(0).cast("bigint"))
    per_field = per_doc.withColumn("mask", in_arrays).groupBy(*FIELD).agg(
        (F.sum("alone") + F.count("doc")).alias("present"),
        *[(F.sum(f"hit_{i}") + F.count_if(hit[h])).alias(f"hit_{i}") for i, h in enumerate(by_value)],
    )
    path_mask = pii.path_hint_mask(F.col("path"), custom)
    counts = [F.when(pii.has_hint(F.col("path_mask"), h, custom), F.col("present")).otherwise(F.col(f"hit_{by_value.index(h)}") if h in by_value else F.lit(0)) for h in names]
    listed = F.array(*[F.struct(F.lit(h).alias("hint"), F.lit(i + 1).cast("bigint").alias("hint_rank"), n.alias("docs_hit")) for i, (h, n) in enumerate(zip(names, counts, strict=True))])
    hits = per_field.withColumn("path_mask", path_mask).select(*FIELD, F.inline(listed)).where("docs_hit > 0")
    return hits.join(totals, "collection").select(
        *FIELD, "hint", "hint_rank", "docs_hit", (F.col("docs_hit") / F.col("docs")).alias("hit_ratio")
    )


def pii_fields(fields: DataFrame) -> DataFrame:
    """Per collection: its fields with hints, in path order, and the `PII detected` flag."""
    found = fields.where(F.size("hints") > 0)
    entry = F.struct(path_key(F.col("path")).alias("k"), F.col("path").alias("p"))
    return found.groupBy("collection").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["p"]).alias("paths"),
        F.count(F.lit(1)).alias("pii_field_count"),
    )


def collection_warnings(overview: DataFrame) -> DataFrame:
    """overview(collection, sampled, fallback, pii_field_count) -> its warnings, in fixed order."""
    return overview.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(F.col("fallback"), F.lit("Fallback to random sampling")),
                F.when(F.col("sampled") == 0, F.lit("Empty collection")),
                F.when(F.coalesce(F.col("pii_field_count"), F.lit(0)) > 0, F.lit("PII detected")),
            )
        ),
    )
