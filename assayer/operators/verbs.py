"""Ad-hoc dataframe verbs with explicit order columns.

Aggregates skip nulls, group keys drop null keys and come out sorted, nulls sort last in either direction.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import divide, half_even
from ..functions.parsing import parse_datetime, parse_number
from ..functions.text import strip as strip_text
from ..session import materialise
from ..sources.tables import ROW_ID, quoted
from . import associations, ordering, stats

MAX_RESULT_ROWS = 1_000


# --- projection and filters -------------------------------------------------------------------------------
def select(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in cols])


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the condition is true; an unknown one keeps nothing, so plain conditions reach the scan."""
    return df.where(predicate)


def mask(condition: Column) -> Column:
    """Condition as a true/false column; unknown is false."""
    return F.coalesce(condition, F.lit(False))


def query(df: DataFrame, text: str) -> DataFrame:
    """Rows where a condition in Spark SQL holds, such as ``region in ('N', 'S') and amount > 5``."""
    return where(df, F.expr(text))


def compare(df: DataFrame, name: str, op: str, other) -> Column:
    """eq ne lt le gt ge; on numbers and dates a null differs from everything, on text it is unknown."""
    c = quoted(name)
    o = other if isinstance(other, Column) else F.lit(other)
    found = {"eq": c == o, "ne": c != o, "lt": c < o, "le": c <= o, "gt": c > o, "ge": c >= o}[op]
    if isinstance(df.schema[name].dataType, T.StringType):
        return found
    return F.coalesce(found, F.lit(op == "ne"))


def between(c: Column, low, high) -> Column:
    return c.between(low, high)


def isin(c: Column, values: list) -> Column:
    return c.isin(list(values))


def keep_listed(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Membership in a long list, as a semi join."""
    listed = values.select(F.col(values.columns[0]).alias(name)).distinct()
    return df.join(listed, name, "left_semi")


def isna(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def notna(df: DataFrame, name: str) -> Column:
    return ~isna(df, name)


def astype(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Strict cast: a value that does not fit is an error."""
    return df.withColumns({c: quoted(c).cast(t) for c, t in types.items()})


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[quoted(c).alias(prefix + c) for c in df.columns])


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[quoted(c).alias(c + suffix) for c in df.columns])


def fillna(df: DataFrame, values) -> DataFrame:
    return df.fillna(values)


def dropna(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    return df.dropna(how, subset=subset)


def loc(df: DataFrame, predicate: Column, cols: list[str] | None = None) -> DataFrame:
    found = where(df, predicate)
    return select(found, cols) if cols else found


def iloc(df: DataFrame, start: int, stop: int, order_by: list[str], rows_per_slice: int = ordering.ROWS_PER_SLICE) -> DataFrame:
    """Rows by position; deep ones are found by a positional index."""
    return ordering.page(df, order_by, start, stop, rows_per_slice)


def sample(df: DataFrame, key: str, n: int | None = None, frac: float | None = None, seed: int = 0) -> DataFrame:
    """Random rows chosen by a hash of a row key, the same under any partitioning."""
    h = F.pmod(F.xxhash64(F.lit(seed), quoted(key)), F.lit(1 << 40))
    if frac is not None:
        return df.where(h < int(frac * (1 << 40)))
    rows = df.count()
    if rows > 4 * n:
        df = df.where(h < int((n * 1.2 + 500) / rows * (1 << 40)))
    return df.orderBy(h, quoted(key)).limit(n)


def drop_duplicates(df: DataFrame, subset: list[str], order_by: list[str], keep: str | bool = "first") -> DataFrame:
    """First or last row of each key in the given order, or (``keep=False``) only rows whose key is unique.

    Map tasks send one candidate per key, or one count.
    """
    if keep is False:
        # null keys are equal to each other
        counts = df.groupBy(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(subset)]).agg(F.count("*").alias("_n")).where("_n = 1")
        on = F.lit(True)
        for i, c in enumerate(subset):
            on = on & quoted(c).eqNullSafe(F.col(f"_k{i}"))
        return df.join(counts, on, "left_semi")
    order = [F.desc(c) if keep == "last" else F.asc(c) for c in order_by]
    w = W.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def reindex(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return keys.join(df, key, "left")


def columns(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, column string")


def dtypes(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column string, dtype string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def empty(df: DataFrame) -> DataFrame:
    return df.limit(1).agg((F.count("*") == 0).alias("empty"))


def transpose(df: DataFrame, key: str, limit: int = MAX_RESULT_ROWS) -> DataFrame:
    """Rows become columns; only results of at most ``limit`` rows can be turned."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"transpose needs at most {limit} rows")
    # Spark turns 500 rows unless told otherwise
    conf, name = df.sparkSession.conf, "spark.sql.transposeMaxValues"
    before = conf.get(name)
    conf.set(name, str(max(limit, int(before))))
    try:
        return df.transpose(quoted(key))
    finally:
        conf.set(name, before)


# --- aggregation ------------------------------------------------------------------------------------------
_SIMPLE = {
    "mean": lambda c: F.avg(c), "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "count": lambda c: F.count(c),
    "size": lambda c: F.count("*"), "std": lambda c: F.stddev_samp(c), "var": lambda c: F.var_samp(c),
    "min": lambda c: F.min(c), "max": lambda c: F.max(c), "nunique": lambda c: F.count_distinct(c),
    "any": lambda c: F.coalesce(F.bool_or(c), F.lit(False)), "all": lambda c: F.coalesce(F.bool_and(c), F.lit(True)),
}


def _downwards(df: DataFrame, name: str) -> Column:
    """A value that falls as the column rises."""
    c, t = quoted(name), df.schema[name].dataType
    if isinstance(t, T.DateType):
        return -F.unix_date(c)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(c.cast("timestamp"))
    return ~c if isinstance(t, T.BooleanType) else -c


def _ordered_aggregate(df: DataFrame, name: str, fn: str, order_by: str) -> Column:
    """first, last: the present value with the least or greatest order key. idxmax, idxmin: the order key of the extreme, the least of several.

    A task holds one candidate for each group, beside its sums.
    """
    v, o = quoted(name), quoted(order_by)
    seen = F.when(v.isNotNull(), o)
    if fn in ("first", "last"):
        return (F.min_by if fn == "first" else F.max_by)(v, seen)
    place = _downwards(df, name) if fn == "idxmax" else v
    return F.min(F.when(v.isNotNull(), F.struct(place.alias("v"), o.alias("k"))))["k"]


def _modes(rows: DataFrame, keys: list[str], name: str, out: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several: counted by value before groups meet."""
    v = quoted(name)
    counts = rows.where(v.isNotNull()).groupBy(*[quoted(k) for k in keys], v.alias("_v")).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))["v"].alias(out)
    return counts.groupBy(*[quoted(k) for k in keys]).agg(best) if keys else counts.agg(best)


def _uniques(rows: DataFrame, keys: list[str], name: str, out: str, order_by: str) -> DataFrame:
    """The distinct values of each group, null included, in order of first appearance."""
    firsts = rows.groupBy(*[quoted(k) for k in keys], quoted(name).alias("_v")).agg(F.min(quoted(order_by)).alias("_o"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_v").alias("v")))), lambda x: x["v"]).alias(out)
    return firsts.groupBy(*[quoted(k) for k in keys]).agg(seen) if keys else firsts.agg(seen)


_ORDERED = ("first", "last", "idxmax", "idxmin")


def aggregate(df: DataFrame, keys: list[str], named: dict[str, tuple[str, str]], order_by: str | None = None) -> DataFrame:
    """Named aggregation {output: (column, function)}.

    Functions are those of _SIMPLE, and first, last, idxmax, idxmin by ``order_by``, which run in one pass beside them; median, quantile:p
    and mode are read off value counts, unique off first appearances, so no group is gathered in one task.
    """
    rows = df
    for k in keys:
        rows = rows.where(quoted(k).isNotNull())
    simple: dict[str, Column] = {}
    ranked: dict[str, dict[str, float]] = {}
    apart: dict[str, DataFrame] = {}
    for n, (c, fn) in named.items():
        if fn in (*_ORDERED, "unique") and order_by is None:
            raise ValueError(f"{fn} needs an order")
        if fn in _SIMPLE:
            simple[n] = _SIMPLE[fn](quoted(c)).alias(n)
        elif fn in _ORDERED:
            simple[n] = _ordered_aggregate(df, c, fn, order_by).alias(n)
        elif fn == "median":
            ranked.setdefault(c, {})[n] = 0.5
        elif fn.startswith("quantile:"):
            ranked.setdefault(c, {})[n] = float(fn.split(":")[1])
        elif fn == "mode":
            apart[n] = _modes(rows, keys, c, n)
        elif fn == "unique":
            apart[n] = _uniques(rows, keys, c, n, order_by)
        else:
            raise ValueError(f"unknown aggregate {fn}")
    if not keys:
        literal = {}
        for c, probs in ranked.items():
            found = ordering.exact_quantiles(rows, [c], list(probs.values()))[c]
            literal.update({n: F.lit(found[p]).cast("double").alias(n) for n, p in probs.items()})
        out = rows.agg(F.count("*").alias("_rows"), *[simple[n] if n in simple else F.max(literal[n]).alias(n) for n in named if n not in apart])
        for found in apart.values():
            out = out.join(F.broadcast(found))  # one row each
        return out.select(*[quoted(n) for n in named])
    # every group stays, also one without a value
    out = rows.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("_rows"), *simple.values())
    for c, probs in ranked.items():
        out = out.join(ordering.grouped_quantiles(rows, c, keys, probs), keys, "left")
    for found in apart.values():
        out = out.join(found, keys, "left")
    return out.select(*[quoted(c) for c in (*keys, *named)]).orderBy(*[quoted(k) for k in keys])


def agg(df: DataFrame, keys: list[str], spec: str | list[str] | dict[str, str | list[str]], order_by: str | None = None) -> DataFrame:
    """Aggregation by one function, a list of functions, or a mapping of columns to either.

    One function a column keeps the column's name; with a list the output is ``column_function``. Without a mapping every column but the
    keys and the order is meant.
    """
    if not isinstance(spec, dict):
        spec = {c: spec for c in df.columns if c not in keys and c != order_by}
    named = {(f"{c}_{fn}" if isinstance(fns, list) else c): (c, fn) for c, fns in spec.items() for fn in (fns if isinstance(fns, list) else [fns])}
    return aggregate(df, keys, named, order_by)


def group_first_last(df: DataFrame, keys: list[str], value: str, order_by: str) -> DataFrame:
    """First and last present value per group in the given order."""
    v, o = quoted(value), quoted(order_by)
    seen = F.when(v.isNotNull(), o)
    return (df.dropna("any", subset=keys).groupBy(*keys)
            .agg(F.min_by(v, seen).alias("first"), F.max_by(v, seen).alias("last")).orderBy(*keys))


def index_of_extreme(df: DataFrame, value: str, key: str, by: list[str] = ()) -> DataFrame:
    """Row key of the largest and the smallest value, a key of any type; ties go to the smallest key, null groups are left out."""
    v, by = quoted(value), list(by)
    present = df.where(v.isNotNull()).dropna("any", subset=by) if by else df.where(v.isNotNull())
    # one key per value first, so that the extremes have no ties
    steps = present.groupBy(*[quoted(b) for b in by], v.alias("_v")).agg(F.min(quoted(key)).alias("_k"))
    agg = [F.max_by("_k", "_v").alias("idxmax"), F.min_by("_k", "_v").alias("idxmin")]
    return steps.groupBy(*[quoted(b) for b in by]).agg(*agg) if by else steps.agg(*agg)


# --- rows and counts of groups ----------------------------------------------------------------------------
def _group_rows(df: DataFrame, by: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """First ``n`` rows of each group; the limit is applied in the map tasks, rows of null groups are left out."""
    w = W.partitionBy(*[quoted(b) for b in by]).orderBy(*order)
    return df.dropna("any", subset=by).withColumn(out, F.row_number().over(w)).where(F.col(out) <= n).drop(out)


def group_head(df: DataFrame, by: list[str], order_by: list[str], n: int = 5) -> DataFrame:
    return _group_rows(df, by, [F.asc(c) for c in order_by], n, "_place")


def group_tail(df: DataFrame, by: list[str], order_by: list[str], n: int = 5) -> DataFrame:
    return _group_rows(df, by, [F.desc(c) for c in order_by], n, "_place")


def group_nlargest(df: DataFrame, by: list[str], value: str, order_by: list[str], n: int = 5) -> DataFrame:
    return _group_rows(df.where(quoted(value).isNotNull()), by, [quoted(value).desc(), *[F.asc(c) for c in order_by]], n, "_place")


def group_nsmallest(df: DataFrame, by: list[str], value: str, order_by: list[str], n: int = 5) -> DataFrame:
    return _group_rows(df.where(quoted(value).isNotNull()), by, [quoted(value).asc(), *[F.asc(c) for c in order_by]], n, "_place")


def group_value_counts(df: DataFrame, by: list[str], name: str) -> DataFrame:
    counts = df.dropna("any", subset=[*by, name]).groupBy(*[quoted(b) for b in by], quoted(name).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(*by, F.desc("count"), "value")


def group_describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of a value per group."""
    named = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "quantile:0.25", "50%": "median", "75%": "quantile:0.75", "max": "max"}
    return aggregate(df, by, {k: (value, fn) for k, fn in named.items()})


def describe_other(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, unique, top and freq of text, boolean and date columns, one row per column; of equally frequent values the smallest is on top.

    Values are counted once for all columns, with a partial count in every task.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    counts = df.select(F.inline(cells)).groupBy("position", "column", "value").agg(F.count("*").alias("n"))
    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value"))))
    return counts.groupBy("position", "column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("unique"),
        top["value"].alias("top"), (-top["n"]).alias("freq")).orderBy("position").drop("position")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max as rows; one column per described column."""
    ranges = stats.column_ranges(df, cols)
    q = ordering.exact_quantiles(df, cols, stats.QUARTILES)
    x = stats.as_numbers(df, cols)
    std = x.agg(*[F.stddev_samp(f"c{i}").alias(f"c{i}") for i in range(len(cols))])

    def row(place: int, name: str, values: list) -> Column:
        return F.struct(F.lit(place).alias("position"), F.lit(name).alias("statistic"),
                        *[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(c) for c, v in zip(cols, values)])

    rows = [row(0, "count", [float(ranges[c]["count"]) for c in cols]), row(1, "mean", [ranges[c]["mean"] for c in cols]),
            row(2, "std", [F.col(f"c{i}") for i in range(len(cols))]), row(3, "min", [ranges[c]["min"] for c in cols])]
    rows += [row(4 + k, name, [q[c][p] for c in cols]) for k, (name, p) in enumerate(zip(("25%", "50%", "75%"), stats.QUARTILES))]
    rows.append(row(7, "max", [ranges[c]["max"] for c in cols]))
    return std.select(F.inline(F.array(*rows))).orderBy("position").drop("position")


def value_counts(df: DataFrame, name: str, normalize: bool = False) -> DataFrame:
    """Counts of present values, or their shares."""
    c = quoted(name)
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("count"))
    if not normalize:
        return counts.orderBy(F.desc("count"), "value")
    total = F.broadcast(counts.agg(F.sum("count").alias("_all")))  # one row
    return counts.crossJoin(total).select("value", (F.col("count") / F.col("_all")).alias("proportion")).orderBy(F.desc("proportion"), "value")


def unique(df: DataFrame, name: str, order_by: str) -> DataFrame:
    """Distinct values, null included, in order of first appearance."""
    return (df.groupBy(quoted(name).alias("value")).agg(F.min(quoted(order_by)).alias("first_seen")).orderBy("first_seen"))


def mode(df: DataFrame, name: str) -> DataFrame:
    """Every most frequent value, sorted."""
    counts = df.where(quoted(name).isNotNull()).groupBy(quoted(name).alias("mode")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(top), "n").select("mode").orderBy("mode")


def corr(df: DataFrame, cols: list[str], method: str = "pearson", **options) -> DataFrame:
    """Correlations of columns as a matrix; Spearman's ranks the complete rows of each pair."""
    if method == "pearson":
        return stats.correlation_matrix(df, cols, **options)
    if method != "spearman":
        raise ValueError(f"unknown method {method}")
    if ROW_ID not in df.columns:  # rows are told apart by the files they are written to
        df = materialise(df.select(*[quoted(c) for c in cols]), "rows").withColumn(ROW_ID, F.monotonically_increasing_id())
    found = associations.spearman_pairs(df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    pairs = found.select("i", "j", names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.col("rho").alias("r"))
    return stats.correlation_matrix(df, cols, pairs=pairs, **options)


cov = stats.covariance_matrix


# --- window-like ------------------------------------------------------------------------------------------
def _of_groups(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Rows without a group key belong to no group and get no value."""
    known = F.lit(True)
    for b in by:
        known = known & quoted(b).isNotNull()
    return df.withColumn(out, F.when(known, F.col(out))) if by else df


def rank(df: DataFrame, value: str, by: list[str] = (), out: str = "rank", method: str = "average", ascending: bool = True,
         pct: bool = False, rows_per_slice: int = ordering.ROWS_PER_SLICE) -> DataFrame:
    """Rank of present values; ``method`` average, min or max says what ties share."""
    return _of_groups(ordering.ranked(df, value, by, out, method, ascending, pct, rows_per_slice), by, out)


def cumsum(df: DataFrame, value: str, order_by: list[str], by: list[str] = (), out: str = "cumsum",
           rows_per_slice: int = ordering.ROWS_PER_SLICE) -> DataFrame:
    return _of_groups(ordering.running_sum(df, value, order_by, by, out, rows_per_slice), by, out)


def cumcount(df: DataFrame, order_by: list[str], by: list[str] = (), out: str = "cumcount",
             rows_per_slice: int = ordering.ROWS_PER_SLICE) -> DataFrame:
    return _of_groups(ordering.running_count(df, order_by, by, out, rows_per_slice), by, out)


def diff(df: DataFrame, value: str, order_by: list[str], by: list[str] = (), periods: int = 1, out: str = "diff",
         rows_per_slice: int = ordering.ROWS_PER_SLICE) -> DataFrame:
    moved = ordering.lagged(df, value, order_by, by, periods, "_lag", rows_per_slice)
    return _of_groups(moved.withColumn(out, quoted(value) - F.col("_lag")).drop("_lag"), by, out)


def pct_change(df: DataFrame, value: str, order_by: list[str], by: list[str] = (), periods: int = 1,
               out: str = "pct_change", rows_per_slice: int = ordering.ROWS_PER_SLICE) -> DataFrame:
    """Relative change against an earlier row; a gap counts as the last present value before it."""
    filled = ordering.last_present(df, value, order_by, by, "_filled", rows_per_slice)
    moved = ordering.lagged(filled, "_filled", order_by, by, periods, "_lag", rows_per_slice)
    return _of_groups(moved.withColumn(out, divide(F.col("_filled"), F.col("_lag")) - 1).drop("_lag", "_filled"), by, out)


# --- sorting ----------------------------------------------------------------------------------------------
def sort_values(df: DataFrame, cols: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    up = ascending if isinstance(ascending, list) else [ascending] * len(cols)
    return df.orderBy(*[F.asc_nulls_last(c) if a else F.desc_nulls_last(c) for c, a in zip(cols, up)])


def sort_index(df: DataFrame, keys: list[str], ascending: bool = True) -> DataFrame:
    return sort_values(df, keys, ascending)


def head(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(n).orderBy(*order_by)


def nlargest(df: DataFrame, n: int, cols: list[str], order_by: list[str]) -> DataFrame:
    return df.dropna("any", subset=cols).orderBy(*[F.desc(c) for c in cols], *order_by).limit(n)


def nsmallest(df: DataFrame, n: int, cols: list[str], order_by: list[str]) -> DataFrame:
    return df.dropna("any", subset=cols).orderBy(*cols, *order_by).limit(n)


# --- scalar functions -------------------------------------------------------------------------------------
def round_(c: Column, decimals: int = 0) -> Column:
    return half_even(c, decimals)


def str_len(c: Column) -> Column:
    return F.char_length(c)


def abs_(c: Column) -> Column:
    return F.abs(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def startswith(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


def endswith(c: Column, suffix: str) -> Column:
    return c.endswith(suffix)


strip = strip_text


def contains(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def date_parts(c: Column) -> dict[str, Column]:
    return {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "quarter": F.quarter(c),
            "weekday": F.weekday(c), "date": F.to_date(c)}


# --- binning, stacking, conversion ------------------------------------------------------------------------
def cut_edges(low: float, high: float, bins: int) -> list[float]:
    """Equal-width edges; the lowest is widened by 0.1 % of the range so that the minimum falls inside."""
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        low, high = low - pad, high + pad
        return [low + (high - low) * k / bins for k in range(bins + 1)]
    edges = [low + (high - low) * k / bins for k in range(bins)] + [high]
    edges[0] -= 0.001 * (high - low)
    return edges


def cut(c: Column, edges: list[float]) -> Column:
    """Zero-based bin of right-closed intervals; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((c > edges[k]) & (c <= edges[k + 1]), k).otherwise(out)
    return out


def cut_equal(df: DataFrame, name: str, bins: int, out: str = "bin") -> DataFrame:
    r = stats.column_ranges(df, [name])[name]
    return df.withColumn(out, cut(quoted(name).cast("double"), cut_edges(r["min"], r["max"], bins)))


def qcut(df: DataFrame, name: str, q: int, out: str = "bin") -> DataFrame:
    """Quantile bins: tied values share one; the lowest bin includes the minimum."""
    probs = [k / q for k in range(q + 1)]
    found = ordering.exact_quantiles(df, [name], probs)[name]
    edges = [found[p] for p in probs]
    if len(set(edges)) != len(edges):
        raise ValueError("bin edges must be unique")
    c = quoted(name).cast("double")
    return df.withColumn(out, F.when(c == edges[0], 0).otherwise(cut(c, edges)))


def concat(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


to_numeric = parse_number
to_datetime = parse_datetime


# --- result shaping ---------------------------------------------------------------------------------------
def normalise_values(df: DataFrame) -> DataFrame:
    """Floats to six decimals, NaN as null, timestamps as ISO text, other values as text."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), F.bround(c.cast("double"), 6))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            fraction = F.date_format(c, "SSSSSS") != "000000"
            c = F.when(fraction, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
                F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
        elif not isinstance(f.dataType, (T.IntegralType, T.BooleanType, T.StringType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def bounded(df: DataFrame, order_by: list[str], limit: int = MAX_RESULT_ROWS) -> DataFrame:
    """The first rows of a result, for display."""
    return normalise_values(df.orderBy(*order_by).limit(limit))


def envelope(df: DataFrame, kind: str = "table", limit: int = MAX_RESULT_ROWS) -> DataFrame:
    """One row that says how much of a result is shown."""
    n = F.count("*")
    return df.agg(F.lit(kind).alias("kind"), n.alias("row_count"), F.least(n, F.lit(limit)).alias("returned"),
                  (n > limit).alias("result_truncated"), F.lit(False).alias("input_truncated"))
