"""Numeric summaries, normality verdicts and linear correlation."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normality import shapiro_wilk
from ..sources.tables import ROW_ID, quoted
from .ordering import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]
NORMALITY_SAMPLE = 5_000
TOP_PAIRS = 15
#: Pairs whose sums are still written out as one aggregate; wider tables take blocks of matrix products.
PAIRS_PER_PASS = 200
#: Groups of tasks whose blocks are added first, and rows of a batch that are multiplied at once.
BLOCK_TREE, BLOCK_ROWS = 64, 8_192


def as_numbers(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Columns as doubles named c0, c1, …; NaN becomes null."""
    out = []
    for i, c in enumerate(cols):
        v, t = quoted(c).cast("double"), df.schema[c].dataType
        whole = isinstance(t, (T.IntegralType, T.DecimalType, T.BooleanType))
        out.append((v if whole else F.when(~F.isnan(v), v)).alias(f"c{i}"))
    return df.select(*keep, *out)


def column_ranges(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """count, min, max and mean per column: one row, used to centre later sums."""
    if not cols:
        return {}
    row = as_numbers(df, cols).agg(*[e for i in range(len(cols)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"),
        F.max(f"c{i}").alias(f"hi{i}"), F.avg(f"c{i}").alias(f"m{i}"))]).first()
    return {c: {"count": row[f"n{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"], "mean": row[f"m{i}"]}
            for i, c in enumerate(cols)}


def numeric_summary(df: DataFrame, cols: list[str], normality: bool = False,
                    quantiles: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """One row per numeric column with at least three values.

    Power sums of centred values give all moments in one pass; quartiles are exact.
    """
    ranges = ranges or column_ranges(df, cols)
    used = [c for c in cols if ranges[c]["count"] >= 3]
    schema = ("column string, count bigint, mean double, std double, min double, p25 double, median double, "
              "p75 double, max double, skew double, kurtosis double, cv double, is_normal boolean")
    if not used:
        return df.sparkSession.createDataFrame([], schema)
    quantiles = quantiles or exact_quantiles(df, used, QUARTILES, ranges=ranges)
    x = as_numbers(df, used)
    sums = []
    for i, c in enumerate(used):
        d = F.col(f"c{i}") - F.lit(ranges[c]["mean"])
        sums += [F.sum(d * d).alias(f"s2_{i}"), F.sum(d * d * d).alias(f"s3_{i}"), F.sum(d * d * d * d).alias(f"s4_{i}")]
    cells = []
    for i, c in enumerate(used):
        r, q = ranges[c], quantiles[c]
        n, mean = float(r["count"]), r["mean"]
        s2, s3, s4 = F.col(f"s2_{i}"), F.col(f"s3_{i}"), F.col(f"s4_{i}")
        constant = r["min"] == r["max"]
        none = F.lit(None).cast("double")
        std = F.lit(0.0) if constant else F.sqrt(s2 / (n - 1))
        g1 = F.lit(n ** 0.5) * s3 / F.pow(s2, F.lit(1.5))
        g2 = F.lit(n) * s4 / (s2 * s2) - 3
        skew = none if constant else g1 * ((n * (n - 1)) ** 0.5 / (n - 2))
        kurt = none if constant else (g2 if n == 3 else ((n + 1) * g2 + 6) * ((n - 1) / ((n - 2) * (n - 3))))
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(r["count"]).cast("bigint").alias("count"), F.lit(mean).alias("mean"),
            std.alias("std"), F.lit(r["min"]).alias("min"), F.lit(q[0.25]).alias("p25"), F.lit(q[0.5]).alias("median"),
            F.lit(q[0.75]).alias("p75"), F.lit(r["max"]).alias("max"), skew.alias("skew"), kurt.alias("kurtosis"),
            (none if mean == 0 else std / F.lit(mean)).alias("cv")))
    summary = x.agg(*sums).select(F.inline(F.array(*cells)))
    if normality:
        verdict = normality_verdict(df, used, {c: ranges[c]["count"] for c in used}).select("column", "is_normal")
        # one row per column on both sides
        return summary.join(F.broadcast(verdict), "column", "left")
    return summary.withColumn("is_normal", F.lit(None).cast("boolean"))


def capped_sample(df: DataFrame, cols: list[str], counts: dict[str, int], size: int = NORMALITY_SAMPLE,
                  seed: int = 0, row_id: str = ROW_ID) -> DataFrame:
    """(column, value): per column the ``size`` values whose row hashes lowest; the same under any partitioning.

    A hash threshold lets through slightly more than ``size`` rows per column before anything is sorted.
    """
    x = as_numbers(df, cols, [F.xxhash64(F.lit(seed), F.col(row_id)).alias("h")])
    cells = []
    for i, c in enumerate(cols):
        v = F.col(f"c{i}")
        n = counts[c]
        if n > size * 2:
            share = (size * 1.2 + 500) / n
            v = F.when(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)), v)
            order = F.pmod("h", F.lit(1 << 40))
        else:
            order = F.pmod("h", F.lit(1 << 40))
        cells.append(F.struct(F.lit(c).alias("column"), order.alias("o"), v.alias("value")))
    w = W.partitionBy("column").orderBy("o", "value")
    return (x.select(F.inline(F.array(*cells))).where("value is not null")
            .withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)
            .select("column", "value"))


def normality_verdict(df: DataFrame, cols: list[str], counts: dict[str, int] | None = None,
                      row_id: str = ROW_ID) -> DataFrame:
    """Shapiro-Wilk on a capped sample of each column: (column, n, w, z, is_normal)."""
    counts = counts or {c: r["count"] for c, r in column_ranges(df, cols).items()}
    return shapiro_wilk(capped_sample(df, cols, counts, row_id=row_id), "column", "value")


_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def gram_blocks(x: DataFrame, columns: int) -> DataFrame:
    """``i`` and for every column j, as arrays, sums over the rows that have both: n, x, y, xx, yy, xy (x of column i, y of j).

    One scan for all pairs: with values X (0 where absent) and presence M, a batch adds the products MᵀM, XᵀM, MᵀX, X²ᵀM, MᵀX² and XᵀX.
    A task keeps one block, and blocks are added in two levels.
    """
    names = [f"c{i}" for i in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns[:columns]])
                there = ~np.isnan(values)
                m, v = there.astype(np.float64), np.where(there, values, 0.0)
                w = v * v
                sums = np.stack([m.T @ m, v.T @ m, m.T @ v, w.T @ m, m.T @ w, v.T @ v])
                total = sums if total is None else total + sums
        if total is not None:
            rows = pa.array(np.arange(columns, dtype=np.int32))
            offsets = pa.array(np.arange(columns + 1, dtype=np.int32) * columns)
            yield pa.RecordBatch.from_arrays([rows, *[pa.ListArray.from_arrays(offsets, pa.array(t.ravel())) for t in total]], ["i", *_SUMS])

    schema = "i int, " + ", ".join(f"{k} array<double>" for k in _SUMS)

    def added(df: DataFrame, *keys: str) -> DataFrame:
        zeros = F.array_repeat(F.lit(0.0), columns)
        return df.groupBy(*keys).agg(*[F.aggregate(F.collect_list(k), zeros, lambda a, b: F.zip_with(a, b, lambda p, q: p + q)).alias(k) for k in _SUMS])

    blocks = x.select(*names).mapInArrow(run, schema).withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(BLOCK_TREE)))
    return added(added(blocks, "i", "_task"), "i")


def _centre(found: dict) -> float:
    """The mean to take away, unless values without end left none."""
    mean = found["mean"]
    return mean if mean is not None and math.isfinite(mean) else 0.0


def _correlated(sums: dict[str, Column], flat: Column, n: Column) -> tuple[Column, Column]:
    """Correlation (null where undefined) and covariance from the sums of a pair."""
    sx, sy, sxx, syy, sxy = (sums[k] for k in ("x", "y", "xx", "yy", "xy"))
    vx, vy = sxx - F.try_divide(sx * sx, n), syy - F.try_divide(sy * sy, n)
    cxy = sxy - F.try_divide(sx * sy, n)
    defined = ~flat & (vx > sxx * 1e-12) & (vy > syy * 1e-12)
    r = F.when(defined, F.greatest(F.least(cxy / F.sqrt(vx * vy), F.lit(1.0)), F.lit(-1.0)))
    return r, F.when(n > 1, cxy / (n - 1))


def correlation_pairs(df: DataFrame, cols: list[str], ranges: dict | None = None, per_pass: int = PAIRS_PER_PASS) -> DataFrame:
    """(i, j, a, b, n, r) for every column pair; r is null where undefined. Infinite values count as absent.

    Centred product sums over pairwise complete rows, in one scan for all pairs: one aggregate of a narrow table, blocks of
    matrix products (``gram_blocks``) of a wide one.
    """
    schema = "i int, j int, a string, b string, n bigint, r double, cov double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    ranges = ranges or column_ranges(df, cols)
    endless = [r["count"] and math.inf in (r["max"], -r["min"]) for r in (ranges[c] for c in cols)]
    x = as_numbers(df, cols)
    x = x.select(*[F.when(F.abs(f"c{i}") < math.inf, F.col(f"c{i}")).alias(f"c{i}") if e else f"c{i}" for i, e in enumerate(endless)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if len(pairs) > per_pass:
        x = x.select(*[(F.col(f"c{i}") - F.lit(_centre(ranges[c]))).alias(f"c{i}") for i, c in enumerate(cols)])
        found = gram_blocks(x, len(cols)).select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("j", "s")).where("j > i").select("i", "j", "s.*")
        one = F.array(*[F.lit(ranges[c]["min"] == ranges[c]["max"]) for c in cols])
        names = F.array(*[F.lit(c) for c in cols])
        n = F.col("n").cast("bigint")
        r, cov = _correlated({k: F.col(k) for k in _SUMS}, F.coalesce(one[F.col("i")], F.lit(True)) | F.coalesce(one[F.col("j")], F.lit(True)), n)
        return found.select("i", "j", names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), n.alias("n"), r.alias("r"), cov.alias("cov"))
    rows = max((r["count"] for r in ranges.values()), default=0)
    full = x.count() == min(r["count"] for r in ranges.values()) if rows and not any(endless) else False
    x = x.select(*[(F.col(f"c{i}") - F.lit(_centre(ranges[c]))).alias(f"c{i}") for i, c in enumerate(cols)])
    aggs: dict[str, Column] = {}
    for i, j in pairs:
        a, b = F.col(f"c{i}"), F.col(f"c{j}")
        aggs[f"xy_{i}_{j}"] = F.sum(a * b)
        if full:
            for k in (i, j):
                aggs[f"x_{k}"] = F.sum(f"c{k}")
                aggs[f"xx_{k}"] = F.sum(F.col(f"c{k}") * F.col(f"c{k}"))
        else:
            pa_, pb = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
            aggs[f"n_{i}_{j}"] = F.count(pa_)
            aggs[f"x_{i}_{j}"], aggs[f"y_{i}_{j}"] = F.sum(pa_), F.sum(pb)
            aggs[f"xx_{i}_{j}"], aggs[f"yy_{i}_{j}"] = F.sum(pa_ * pa_), F.sum(pb * pb)
    total = x.agg(*[e.alias(k) for k, e in aggs.items()])
    cells = []
    for i, j in pairs:
        ra, rb = ranges[cols[i]], ranges[cols[j]]
        if full:
            n = F.lit(rows).cast("bigint")
            sums = {"x": f"x_{i}", "y": f"x_{j}", "xx": f"xx_{i}", "yy": f"xx_{j}"}
        else:
            n = F.col(f"n_{i}_{j}")
            sums = {k: f"{k}_{i}_{j}" for k in ("x", "y", "xx", "yy")}
        flat = F.lit(ra["min"] == ra["max"] or rb["min"] == rb["max"])
        r, cov = _correlated({k: F.col(v) for k, v in (sums | {"xy": f"xy_{i}_{j}"}).items()}, flat, n)
        cells.append(F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"),
            n.alias("n"), r.alias("r"), cov.alias("cov")))
    return total.select(F.inline(F.array(*cells)))


def top_pairs(pairs: DataFrame, limit: int = TOP_PAIRS) -> DataFrame:
    """Pairs by absolute correlation; equal strengths keep column order."""
    return (pairs.where("r is not null").withColumn("abs_r", F.abs("r"))
            .orderBy(F.desc("abs_r"), "i", "j").limit(limit).select("i", "j", "a", "b", "r", "abs_r"))


def _square(pairs: DataFrame, cols: list[str], value: str, diagonal: DataFrame) -> DataFrame:
    both = pairs.select("i", F.col("a").alias("column"), F.col("b").alias("other"), F.col(value).alias("v")).unionByName(
        pairs.select(F.col("j").alias("i"), F.col("b").alias("column"), F.col("a").alias("other"), F.col(value).alias("v")))
    return (both.unionByName(diagonal).groupBy("i", "column").pivot("other", cols).agg(F.first("v")).drop("i"))


def correlation_matrix(df: DataFrame, cols: list[str], decimals: int | None = 4, ranges: dict | None = None,
                       pairs: DataFrame | None = None) -> DataFrame:
    """Square matrix, one row per column; with ``decimals`` undefined entries are 0, otherwise null."""
    ranges = ranges or column_ranges(df, cols)
    pairs = correlation_pairs(df, cols, ranges) if pairs is None else pairs
    diagonal = df.sparkSession.createDataFrame(
        [(i, c, c, None if ranges[c]["min"] == ranges[c]["max"] else 1.0) for i, c in enumerate(cols)],
        "i int, column string, other string, v double")
    square = _square(pairs, cols, "r", diagonal)
    if decimals is None:
        return square
    return square.select("column", *[F.coalesce(F.round(quoted(c), decimals), F.lit(0.0)).alias(c) for c in cols])


def covariance_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    ranges = column_ranges(df, cols)
    x = as_numbers(df, cols)
    own = x.agg(*[F.var_samp(f"c{i}").alias(f"v{i}") for i in range(len(cols))])
    diagonal = own.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(c).alias("other"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(cols)])))
    return _square(correlation_pairs(df, cols, ranges), cols, "cov", diagonal)
