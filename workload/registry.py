"""Registered queries: name -> Spark callable and, where SQL can state it, the same query in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstrata.operators.flatten import flatten_documents
from docstrata.options import ProfileOptions
from docstrata.sources.fixtures import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OPTIONS = ProfileOptions()


def query(oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
            return fn(spark, folder)

        QUERIES[fn.__name__.removesuffix("_query")] = in_utc
        if oracle is not None:
            ORACLES[fn.__name__.removesuffix("_query")] = oracle
        return in_utc

    return register


def documents(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    union = fixture(spark, folder, names[0])
    for name in names[1:]:
        union = union.unionByName(fixture(spark, folder, name))
    return union


def paths_of(spark: SparkSession, folder: str, *names: str, options: ProfileOptions = OPTIONS, **kw) -> DataFrame:
    return flatten_documents(documents(spark, folder, *names), options, **kw)
