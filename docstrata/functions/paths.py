"""Path notation as Column expressions: escaping, splitting, ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "[*]"
TRUNCATED = "[TRUNCATED]"

# Segments are runs of escaped pairs or of characters other than dot.
_SEGMENT = r"((?:\\.|[^.])+)"
# Root collation, without case and accents.
COLLATION = "UNICODE_CI_AI"
# A digit run is preceded by its number of digits, in so many places.
_COUNT_WIDTH = 8


def escape_key(key: Column) -> Column:
    key = F.replace(key, F.lit("\\"), F.lit("\\\\"))
    key = F.replace(key, F.lit("."), F.lit("\\."))
    return F.replace(key, F.lit("$"), F.lit("\\$"))


def unescape_key(key: Column) -> Column:
    hold = F.lit("\x00")
    key = F.replace(key, F.lit("\\\\"), hold)
    key = F.replace(key, F.lit("\\$"), F.lit("$"))
    key = F.replace(key, F.lit("\\."), F.lit("."))
    return F.replace(key, hold, F.lit("\\"))


def join_path(segments: Column) -> Column:
    return F.array_join(F.filter(segments, lambda s: s != ""), ".")


def split_path(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(_SEGMENT), F.lit(1))


def last_segment(path: Column) -> Column:
    """Text after the last dot (escape-unaware); the whole path when that is empty."""
    tail = F.substring_index(path, ".", -1)
    return F.when(tail == "", path).otherwise(tail)


def format_array_index(index: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("]"))


def is_array_index(segment: Column) -> Column:
    return segment.rlike(r"\A\[[0-9]+\]\z")


def parse_array_index(segment: Column) -> Column:
    digits = F.regexp_extract(segment, r"\A\[([0-9]+)\]\z", 1)
    return F.when(digits != "", digits.cast("bigint"))


def normalize_array_index(segment: Column) -> Column:
    return F.when(is_array_index(segment), F.lit(WILDCARD)).otherwise(segment)


def normalize_path(path: Column) -> Column:
    """``a.[3].b`` becomes ``a.[*].b``; paths without an index are left alone."""
    rebuilt = join_path(F.transform(split_path(path), normalize_array_index))
    return F.when(F.contains(path, F.lit("[")), rebuilt).otherwise(path)


def natural_key(text: Column) -> Column:
    """Sortable text: case-folded, digit runs preceded by their length so they order as numbers of any size."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def ordered(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        counted = F.concat(F.lpad(F.length(digits).cast("string"), _COUNT_WIDTH, "0"), digits)
        return F.when(run.rlike(r"\A[0-9]"), counted).otherwise(run)

    return F.array_join(F.transform(runs, ordered), "")


def natural_order(text: Column) -> Column:
    """Order by base letters: case and accents are ignored, marks come before digits and digits before letters, runs of digits
    order as numbers. Texts that differ in case or accents only are equal; order by the text itself after it.
    """
    return F.collate(natural_key(text), COLLATION)


def path_key(path: Column) -> Column:
    """Natural order of each dot-separated segment in turn; a shorter path sorts before its extensions."""
    return F.transform(F.split(path, r"\."), natural_order)


def sort_paths(paths: Column) -> Column:
    keyed = F.transform(paths, lambda p: F.struct(path_key(p).alias("k"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])
