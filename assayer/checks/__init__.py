"""Named queries over the test tables, each with the SQL that must give the same rows where SQL can."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ROW_ID, read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent where one exists."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str, row_id: bool = False) -> DataFrame:
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"), row_id)


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Table whose natural key gives the row order."""
    df = table(spark, sf_dir, name)
    return df.withColumn(ROW_ID, F.col(key).cast("bigint"))


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles rounded for comparison; summation order differs between engines."""
    return df.select(*[
        F.round(F.col("`" + f.name + "`"), decimals).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col("`" + f.name + "`") for f in df.schema.fields])


def load_all() -> None:
    from . import (associations, drivers, history, imports, outliers, profiling, quality, reporting,  # noqa: F401
                   statistics, verbs)
