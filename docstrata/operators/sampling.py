"""Row filters and deterministic samples of documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_window(field: str, days: int, as_of: dt.datetime) -> Column:
    """`field` lies within `days` days before `as_of` or later."""
    return F.col(field) >= F.lit(as_of - dt.timedelta(days=days))


def match(condition: str | Column) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition


def filters(
    time_field: str | None = None,
    time_window_days: int | None = None,
    condition: str | Column | None = None,
    as_of: dt.datetime | None = None,
) -> tuple[Column | None, str]:
    """Conjunction of the given filters and the strategy label it implies."""
    combined, strategy = None, "random"
    if time_field and time_window_days:
        combined = time_window(time_field, time_window_days, as_of or dt.datetime.now(dt.timezone.utc))
        strategy = "time-window"
    if condition is not None:
        combined = match(condition) if combined is None else combined & match(condition)
        strategy = "filtered"
    return combined, strategy


def sample_order(key: Column | str, seed: str = "0") -> Column:
    """A fixed pseudo-random order of rows that any engine can reproduce."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def random_sample(df: DataFrame, size: int, key: str = "doc_id", seed: str = "0") -> DataFrame:
    """`size` rows without replacement: a top-k per task, merged; no full sort."""
    return df.orderBy(sample_order(key, seed), key).limit(size)


def fraction_sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Each row with this chance, decided where it is read: no shuffle, no count of the table."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must lie in [0, 1], got {fraction}")
    return df.sample(withReplacement=False, fraction=float(fraction), seed=seed)


def stratified_fraction(df: DataFrame, column: str, fractions: dict, seed: int = 0) -> DataFrame:
    """Each row with the chance that its value of a column has; rows of other values are left out."""
    return df.sampleBy(column, fractions, seed)


def keyed_fraction(df: DataFrame, fraction: float, key: str = "doc_id", seed: str = "0") -> DataFrame:
    """The rows whose key falls into a fixed share of all keys: the same ones on every run, in every engine and whatever
    else is in the table, so that samples of growing tables grow with them. A larger fraction keeps the rows of a smaller one.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must lie in [0, 1], got {fraction}")
    digits = 8
    return df.where(F.conv(F.left(sample_order(key, seed), F.lit(digits)), 16, 10).cast("bigint") < int(fraction * 16**digits))


def per_collection_sample(df: DataFrame, size: int, key: str = "doc_id", seed: str = "0") -> DataFrame:
    """`size` rows of every collection. Each task keeps only its own first rows of a collection."""
    order = Window.partitionBy("collection").orderBy("_order", key)
    ranked = df.withColumn("_order", sample_order(key, seed)).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= size).drop("_order", "_rank")


def sample_with_fallback(
    df: DataFrame,
    size: int,
    key: str = "doc_id",
    seed: str = "0",
    time_field: str | None = None,
    time_window_days: int | None = None,
    condition: str | Column | None = None,
    as_of: dt.datetime | None = None,
    strict: bool = False,
) -> DataFrame:
    """A filtered sample; when nothing matches, an unfiltered one marked as fallback, or an error if strict.

    Adds the columns strategy and fallback.
    """
    combined, strategy = filters(time_field, time_window_days, condition, as_of)
    if combined is None:
        return _labelled(random_sample(df, size, key, seed), strategy, False)
    filtered = df.where(combined)
    # One match is enough to decide, so this stops at the first one.
    if not filtered.isEmpty():
        return _labelled(random_sample(filtered, size, key, seed), strategy, False)
    if strict:
        raise ValueError("no documents match the given filters")
    return _labelled(random_sample(df, size, key, seed), "random", True)


def _labelled(df: DataFrame, strategy: str, fallback: bool) -> DataFrame:
    return df.withColumn("strategy", F.lit(strategy)).withColumn("fallback", F.lit(fallback))
