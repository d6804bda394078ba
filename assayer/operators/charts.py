"""Data behind charts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ROW_ID, quoted
from . import stats
from .drivers import top_values
from .ordering import exact_quantiles
from .outliers import fences
from .roles import CATEGORICAL, NUMERIC

BINS, SCATTER_ROWS = 12, 500


def chart_specs(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """(position, type, x, y, r): which charts to draw."""
    from pyspark.sql import Window as W
    ranked = profile.where(F.col("role").isin(NUMERIC, CATEGORICAL)).withColumn(
        "k", F.row_number().over(W.partitionBy("role").orderBy("ordinal")))
    none, no_r = F.lit(None).cast("string"), F.lit(None).cast("double")
    numeric = ranked.where((F.col("role") == NUMERIC) & (F.col("k") <= 6))
    parts = [numeric.select((F.col("k") * 2 + at).alias("position"), F.lit(kind).alias("type"), F.col("name").alias("x"), none.alias("y"), no_r.alias("r"))
             for at, kind in ((0, "histogram"), (1, "box"))]
    parts.append(ranked.where((F.col("role") == CATEGORICAL) & (F.col("k") <= 4)).select(
        (F.col("k") + 20).alias("position"), F.lit("bar").alias("type"), F.col("name").alias("x"), none.alias("y"), no_r.alias("r")))
    parts.append(stats.top_pairs(pairs, 1).select(F.lit(30).alias("position"), F.lit("scatter").alias("type"), F.col("a").alias("x"), F.col("b").alias("y"), "r"))
    heat = profile.where(F.col("role") == NUMERIC).agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]), ", ").alias("x"))
    parts.append(heat.where("n >= 2").select(F.lit(31).alias("position"), F.lit("heatmap").alias("type"), "x", none.alias("y"), no_r.alias("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram(df: DataFrame, cols: list[str], bins: int = BINS, ranges: dict | None = None) -> DataFrame:
    """(column, bin, centre, count): equal bins from minimum to maximum, the last one closed; empty bins included."""
    ranges = {c: r for c, r in (ranges or stats.column_ranges(df, cols)).items() if r["count"] and c in cols}
    used = list(ranges)
    if not used:
        return df.sparkSession.createDataFrame([], "column string, bin int, centre double, count bigint")
    limits = {c: (r["min"], r["max"]) if r["min"] < r["max"] else (r["min"] - 0.5, r["max"] + 0.5) for c, r in ranges.items()}
    x = stats.as_numbers(df, used)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.least(
        F.floor((F.col(f"c{i}") - limits[c][0]) / (limits[c][1] - limits[c][0]) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        for i, c in enumerate(used)])
    counts = x.select(F.inline(cells)).where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("count"))
    frame = df.sparkSession.createDataFrame(
        [(c, b, limits[c][0] + (limits[c][1] - limits[c][0]) * (b + 0.5) / bins) for c in used for b in range(bins)],
        "column string, bin int, centre double")
    return frame.join(counts, ["column", "bin"], "left").select(
        "column", "bin", F.round("centre", 3).alias("centre"), F.coalesce("count", F.lit(0)).alias("count"))


def scatter(df: DataFrame, a: str, b: str, row_id: str = ROW_ID, limit: int = SCATTER_ROWS) -> DataFrame:
    """The first complete rows of a column pair."""
    return (df.select(quoted(a).cast("double").alias("x"), quoted(b).cast("double").alias("y"), F.col(row_id).alias("r"))
            .where("x is not null and y is not null and not isnan(x) and not isnan(y)").orderBy("r").limit(limit).select("x", "y"))


def box(df: DataFrame, cols: list[str]) -> DataFrame:
    """Five-number summary and fences per column."""
    q = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0])
    limits = fences(df, cols, q)
    rows = [(c, *[q[c][p] for p in (0.0, 0.25, 0.5, 0.75, 1.0)], *limits.get(c, (None, None))) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, p25 double, median double, p75 double, max double, lower_fence double, upper_fence double")


def bars(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Most frequent values per column."""
    return top_values(df, cols, k)


def heatmap(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, other, r) in both directions with the diagonal; undefined entries are 0."""
    pairs = stats.correlation_pairs(df, cols).select("a", "b", F.round(F.coalesce("r", F.lit(0.0)), 4).alias("r"))
    ranges = stats.column_ranges(df, cols)
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, 0.0 if ranges[c]["min"] == ranges[c]["max"] else 1.0) for c in cols], "a string, b string, r double")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diagonal).select(
        F.col("a").alias("column"), F.col("b").alias("other"), "r")
