"""Column and table profiles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent
from ..sources.tables import ROW_ID, data_columns, quoted
from .digest import _present, column_facts, facts_frame, first_values
from .roles import NUMERIC, Inference


def role_table(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Roles as a small table (one row per column)."""
    rows = [(i, c, roles[c]) for i, c in enumerate(data_columns(df))]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, role string")


def numeric_extent(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, min, max, mean, std) over present values; the deviation of a single value is 0."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _present(df, c).cast("double").alias("v")) for c in cols])
    return (df.select(F.explode(cells).alias("s")).select("s.*").where("v is not null").groupBy("column")
            .agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
                 F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std")))


def sample_values(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, sample): the first ``k`` distinct values in row order, joined by commas."""
    names = F.array(*[F.lit(c) for c in data_columns(df)])
    return (first_values(df, k).groupBy("ordinal")
            .agg(F.array_sort(F.collect_list(F.struct("first_row", "value"))).alias("v"))
            .select(F.element_at(names, F.col("ordinal") + 1).alias("column"),
                    F.array_join(F.transform("v", lambda s: s["value"]), ", ").alias("sample")))


def profile_columns(df: DataFrame, roles: dict[str, str], samples: bool = False, facts: list | None = None) -> DataFrame:
    """One row per column: counts, distinct values, and extent of numeric columns; known facts are not counted again."""
    facts = (facts_frame(df.sparkSession, facts) if facts else column_facts(df)).join(F.broadcast(role_table(df, roles).drop("column")), "ordinal")
    out = facts.select(
        "ordinal", F.col("column").alias("name"), "role", "dtype", "non_null",
        F.when(F.col("rows") > 0, F.round(100 * (1 - F.col("non_null") / F.col("rows")), 2)).otherwise(0.0).alias("null_pct"),
        F.col("distinct").alias("unique"))
    numeric = [c for c, r in roles.items() if r == NUMERIC]
    if numeric:
        extent = numeric_extent(df, numeric).withColumnRenamed("column", "name")
        out = out.join(extent, "name", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean", "std")])
    if samples and ROW_ID in df.columns:
        out = out.join(sample_values(df).withColumnRenamed("column", "name"), "name", "left")
    order = ["ordinal", "name", "role", "dtype", "non_null", "null_pct", "unique", "min", "max", "mean", "std"]
    return out.select(*order, *([c for c in ("sample",) if c in out.columns]))


def profile_of(known: Inference, samples: bool = False) -> DataFrame:
    """Column profile of an inferred table, from the facts it already has."""
    return profile_columns(known.clean, known.roles, samples, known.facts)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one (null equals null).

    Rows are compared by a 128-bit fingerprint with a null mask, so only 16 bytes per distinct row are shuffled.
    """
    cols = [quoted(c) for c in data_columns(df)]
    mask = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    keyed = df.select(F.xxhash64(mask, *cols).alias("h1"), F.xxhash64(F.lit(7), mask, *cols).alias("h2"))
    copies = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def profile_table(df: DataFrame) -> DataFrame:
    """One row of table counters."""
    cols = data_columns(df)
    nulls = [_present(df, c).isNull().cast("int") for c in cols]
    missing = nulls[0]
    for x in nulls[1:]:
        missing = missing + x
    counted = df.select(missing.alias("missing")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum((F.col("missing") > 0).cast("bigint")), F.lit(0)).alias("rows_with_missing"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"))
    # two single-row results as one: the values never meet in a join
    a = counted.select("row_count", "rows_with_missing", "missing_cells", F.lit(None).cast("bigint").alias("duplicate_rows"))
    none = F.lit(None).cast("bigint")
    b = duplicate_rows(df).select(none.alias("row_count"), none.alias("rows_with_missing"),
                                  none.alias("missing_cells"), "duplicate_rows")
    one = a.unionByName(b).agg(*[F.max(c).alias(c) for c in a.columns])
    cells = F.col("row_count") * len(cols)
    return one.select(
        "row_count", F.lit(len(cols)).cast("bigint").alias("col_count"), cells.alias("cell_count"),
        "rows_with_missing", "missing_cells", percent(F.col("missing_cells"), cells).alias("missing_cell_pct"),
        "duplicate_rows")


def role_counts(roles: DataFrame) -> DataFrame:
    return roles.groupBy("role").agg(F.count("*").alias("columns"))


def column_summary(profile: DataFrame, summary: DataFrame, column: str) -> DataFrame:
    """The statistics row of a column if it has one, else its profile entry, else a row saying it is unknown."""
    p = profile.where(F.col("name") == column)
    s = summary.where(F.col("column") == column)
    asked = profile.sparkSession.createDataFrame([(column,)], "asked string")
    found = (asked.join(p, F.col("asked") == F.col("name"), "left")
             .join(s.select(F.col("column").alias("_c"), "count", "median", "skew"), F.col("asked") == F.col("_c"), "left"))
    return found.select(
        F.col("asked").alias("column"),
        F.when(F.col("_c").isNotNull(), "summary").when(F.col("name").isNotNull(), "profile")
        .otherwise("column not found").alias("source"),
        "role", F.coalesce("count", "non_null").alias("count"), "null_pct", "unique", "mean", "std", "min", "max",
        "median", "skew")
