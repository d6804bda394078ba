"""Order-based work that never gathers one group in one task.

Ranks, running totals, lags and exact quantiles need sorted data. A window over a whole group would put a
hot group into a single task, so rows are first cut into slices of the whole order key (group, then order, then
place among equals), windows run inside (group, slice), and per-slice totals, which are few, carry the rest across.
Where the slices are cut changes the work per task but never the result.
"""
from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clip
from ..session import materialise
from ..sources.tables import quoted

ROWS_PER_SLICE = 1_000_000
MAX_SLICES = 65_536
#: Values that a KLL sketch holds, about, groups of tasks whose sketches are merged first, and rows of all brackets that are read out.
SKETCH, SKETCH_TREE, READ_OUT = 4_096, 64, 400_000
_SLICE, _TIE, _PLACE = "_slice", "_slice_tie", "_slice_place"
_MAX = sys.float_info.max


def in_slices(df: DataFrame, order: list[str | Column], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame | None:
    """The rows with the number of their slice in the whole order key; none if one slice holds them all.

    Keys are sampled as they are, whatever their types and number, and rows with equal keys are told apart by their place, so a key that
    a third of the rows have is many slices. A task holds one large slice, or sorts its rows and counts many small ones off: tasks, files
    and the sample of keys follow the rows, not the slices. The slices are written, because a second sample would cut elsewhere.
    """
    rows = df.count()
    rows_per_slice = max(rows_per_slice, math.ceil(rows / MAX_SLICES))
    slices = math.ceil(rows / rows_per_slice)
    if slices <= 1:
        return None
    tasks = min(slices, max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_SLICE)))
    keys = [*(quoted(o) if isinstance(o, str) else o for o in order), F.col(_TIE)]
    dealt = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(tasks, *keys)
    if tasks == slices:
        return materialise(dealt.drop(_TIE).withColumn(_SLICE, F.spark_partition_id().cast("bigint")), "slices")
    # the task's number and, in the lower 33 bits, the row's place in it; a slice has the number of its first row
    counted = dealt.sortWithinPartitions(*keys).drop(_TIE).withColumn(_PLACE, F.monotonically_increasing_id())
    number = F.col(_PLACE) - F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1)) % rows_per_slice
    return materialise(counted.withColumn(_SLICE, number).drop(_PLACE), "slices")


def page(df: DataFrame, order: list[str | Column], start: int, stop: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rows ``start`` up to ``stop`` in the order, which has to be total for the page to be the only one.

    A short prefix is a plain limit. Beyond one slice a positional index helps: with the rows of every slice, running totals say in which
    slices the page lies, and only these are read (a file holds consecutive slices, whose bounds its pages name) and sorted.
    """
    wanted = max(0, stop - start)
    keys = [quoted(o) if isinstance(o, str) else o for o in order]
    if not wanted or stop <= rows_per_slice:
        return df.orderBy(*keys).offset(start).limit(wanted)
    sliced = in_slices(df, order, rows_per_slice)
    if sliced is None:
        return df.orderBy(*keys).offset(start).limit(wanted)
    before, bases = 0, []
    for r in sliced.groupBy(_SLICE).count().orderBy(_SLICE).collect():  # a row for each slice
        if before < stop and before + r["count"] > start:
            bases.append((r[_SLICE], before))
        before += r["count"]
    if not bases:
        return df.limit(0)
    base = F.element_at(F.map_from_arrays(F.array(*[F.lit(k).cast("bigint") for k, _ in bases]), F.array(*[F.lit(n).cast("bigint") for _, n in bases])), F.col(_SLICE))
    within = F.row_number().over(W.partitionBy(_SLICE).orderBy(*keys)).cast("bigint") - 1
    rows = sliced.where(F.col(_SLICE).between(bases[0][0], bases[-1][0])).withColumn(_PLACE, base + within)
    return rows.where((F.col(_PLACE) >= start) & (F.col(_PLACE) < stop)).orderBy(_PLACE).drop(_SLICE, _PLACE)


def _with_carry(sliced: DataFrame, by: list[str], per_slice: list[Column], carried: list[Column]) -> DataFrame:
    """Join each row to what the earlier slices of its group add up to."""
    keys = [*by, _SLICE]
    totals = sliced.groupBy(*keys).agg(*per_slice)
    carry = totals.select(*keys, *carried)
    # null group keys belong together, as in any window
    left, right = sliced.alias("r"), carry.alias("c")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{_tick(k)}").eqNullSafe(F.col(f"c.{_tick(k)}"))
    names = [c for c in carry.columns if c not in keys]
    return left.join(right, on).select("r.*", *[F.col(f"c.{n}") for n in names])


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def running_sum(df: DataFrame, value: str, order_by: list[str], by: list[str] = (), out: str = "cumsum",
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Running total in row order; null values stay null and add nothing."""
    by = list(by)
    v = quoted(value)
    sliced = in_slices(df, [*by, *order_by], rows_per_slice)
    if sliced is None:
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(out, F.when(v.isNotNull(), F.sum(v).over(w)))
    inside = W.partitionBy(*by, _SLICE).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    joined = _with_carry(sliced, by, [F.sum(v).alias("_total")],
                         [F.sum("_total").over(earlier).alias("_before")])
    total = F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0))
    return joined.withColumn(out, F.when(v.isNotNull(), total)).drop(_SLICE, "_before")


def running_count(df: DataFrame, order_by: list[str], by: list[str] = (), out: str = "cumcount",
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Zero-based position of each row in its group."""
    by = list(by)
    sliced = in_slices(df, [*by, *order_by], rows_per_slice)
    if sliced is None:
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(*order_by)
        return df.withColumn(out, F.row_number().over(w).cast("bigint") - 1)
    inside = W.partitionBy(*by, _SLICE).orderBy(*order_by)
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    joined = _with_carry(sliced, by, [F.count("*").alias("_total")],
                         [F.sum("_total").over(earlier).alias("_before")])
    position = F.row_number().over(inside).cast("bigint") - 1 + F.coalesce(F.col("_before"), F.lit(0))
    return joined.withColumn(out, position.cast("bigint")).drop(_SLICE, "_before")


def lagged(df: DataFrame, value: str, order_by: list[str], by: list[str] = (), periods: int = 1,
           out: str = "lagged", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Value ``periods`` rows earlier (later when negative) in the group."""
    by, k, v = list(by), abs(periods), quoted(value)
    if k == 0:
        return df.withColumn(out, v)
    forward = periods > 0
    sliced = in_slices(df, [*by, *order_by], rows_per_slice)
    if sliced is None:
        return df.withColumn(out, F.lag(v, periods).over(W.partitionBy(*(by or [F.lit(0)])).orderBy(*order_by)))
    direction = F.asc if forward else F.desc
    opposite = F.desc if forward else F.asc
    if not forward:
        sliced = sliced.withColumn(_SLICE, -F.col(_SLICE))
    inside = W.partitionBy(*by, _SLICE).orderBy(*[direction(o) for o in order_by])
    backwards = W.partitionBy(*by, _SLICE).orderBy(*[opposite(o) for o in order_by])
    # the last k values of every slice, nearest first
    tails = (sliced.withColumn("_back", F.row_number().over(backwards)).where(F.col("_back") <= k)
             .groupBy(*by, _SLICE)
             .agg(F.array_sort(F.collect_list(F.struct(F.col("_back").alias("b"), v.alias("v")))).alias("_tail")))
    previous = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(_SLICE).desc()).rowsBetween(1, k)
    carry = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(previous))).drop("_tail")
    keys = [*by, _SLICE]
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"r.{_tick(key)}").eqNullSafe(F.col(f"c.{_tick(key)}"))
    joined = sliced.alias("r").join(carry.alias("c"), on).select("r.*", "c._carry")
    at = F.row_number().over(inside)
    from_carry = F.try_element_at(F.col("_carry"), F.lit(k + 1) - F.col("_at"))["v"]
    return (joined.withColumn("_at", at).withColumn("_near", F.lag(v, k).over(inside))
            .withColumn(out, F.when(F.col("_at") > k, F.col("_near")).otherwise(from_carry))
            .drop(_SLICE, "_carry", "_at", "_near"))


def last_present(df: DataFrame, value: str, order_by: list[str], by: list[str] = (), out: str = "filled",
                 rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The value, or the last present one before it in the group."""
    by, v = list(by), quoted(value)
    sliced = in_slices(df, [*by, *order_by], rows_per_slice)
    if sliced is None:
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(out, F.last(v, ignorenulls=True).over(w))
    inside = W.partitionBy(*by, _SLICE).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    place = F.when(v.isNotNull(), F.struct(*[quoted(o) for o in order_by]))
    joined = _with_carry(sliced, by, [F.max_by(v, place).alias("_last")],
                         [F.last("_last", ignorenulls=True).over(earlier).alias("_before")])
    return joined.withColumn(out, F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col("_before"))).drop(_SLICE, "_before")


def ladder(df: DataFrame, value: str, by: list[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Distinct values per group with their count ``n``, rows ``before`` them and group ``total``.

    Ties are counted before anything is sorted, so a value holding a third of the rows is one row here.
    """
    by = list(by)
    v = quoted(value)
    present = df.where(v.isNotNull())
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        present = present.where(~F.isnan(v))
    # read by several jobs below, so the counts are written once
    counts = materialise(present.groupBy(*[quoted(b) for b in by], v).agg(F.count("*").alias("n")), "ladder")
    return rungs(counts, value, by, rows_per_slice)


def rungs(counts: DataFrame, value: str, by: list[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The ladder of values that are counted already: group, value and ``n``, one row each."""
    by = list(by)
    group = by or [F.lit(0)]
    sliced = in_slices(counts, [*by, value], rows_per_slice)
    if sliced is None:
        up_to = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
        return counts.select(*by, value, "n", (F.sum("n").over(up_to) - F.col("n")).alias("before"),
                             F.sum("n").over(W.partitionBy(*group)).alias("total"))
    everything = W.partitionBy(*group)
    earlier = W.partitionBy(*group).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    joined = _with_carry(
        sliced, by, [F.sum("n").alias("_total")],
        [F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
         F.sum("_total").over(everything).alias("total")])
    inside = W.partitionBy(*by, _SLICE).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (joined.withColumn("before", F.col("_before") + F.sum("n").over(inside) - F.col("n"))
            .select(*by, value, "n", "before", "total"))


def running_weights(counts: DataFrame, value: str, by: list[str], weights: list[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The rows, one for each group and value, with what the smaller values of the group add up to by each weight (``before_…``)."""
    sliced = in_slices(counts, [*by, value], rows_per_slice)
    if sliced is None:
        smaller = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumns({f"before_{w}": F.coalesce(F.sum(w).over(smaller), F.lit(0)) for w in weights})
    inside = W.partitionBy(*by, _SLICE).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*by).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    joined = _with_carry(sliced, by, [F.sum(w).alias(f"_total_{w}") for w in weights],
                         [F.coalesce(F.sum(f"_total_{w}").over(earlier), F.lit(0)).alias(f"_earlier_{w}") for w in weights])
    return joined.withColumns({f"before_{w}": F.col(f"_earlier_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}) \
        .drop(_SLICE, *[f"_earlier_{w}" for w in weights])


def lookup(df: DataFrame, table: DataFrame, on: list[str], hot_rows: int = ROWS_PER_SLICE) -> DataFrame:
    """Left join to a table that is unique on ``on`` and has the row count of each key in ``n``.

    Keys above ``hot_rows`` are at most rows/hot_rows many; they are broadcast, the others are joined by shuffle. Rows that lack a part
    of the key meet nothing and are not moved.
    """
    lacking = F.lit(False)
    for k in on:
        lacking = lacking | quoted(k).isNull()
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in on]
    apart = df.where(lacking).select(*[quoted(k) for k in on], *[quoted(c) for c in df.columns if c not in on], *nothing)
    df = df.where(~lacking)
    hot = table.where(F.col("n") > hot_rows)
    if hot.isEmpty():
        return df.join(table, on, "left").unionByName(apart)
    hot_part = df.join(F.broadcast(hot), on, "inner")
    cold_part = df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(
        table.where(F.col("n") <= hot_rows), on, "left")
    return hot_part.unionByName(cold_part).unionByName(apart)


def average_rank(df: DataFrame, value: str, by: list[str] = (), out: str = "rank",
                 rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rank with ties averaged; null (and NaN) get no rank."""
    by = list(by)
    steps = ladder(df, value, by, rows_per_slice).select(
        *by, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return lookup(df, steps, [*by, value], rows_per_slice).drop("n")


def ranked(df: DataFrame, value: str, by: list[str] = (), out: str = "rank", method: str = "average", ascending: bool = True,
           pct: bool = False, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rank in either direction; ties share their average, least or greatest place."""
    by = list(by)
    steps = ladder(df, value, by, rows_per_slice)
    n, total = F.col("n"), F.col("total")
    before = F.col("before") if ascending else total - F.col("before") - n
    place = {"average": before + (n + 1) / 2, "min": before + 1, "max": before + n}[method]
    if pct:
        place = place / total
    steps = steps.select(*by, value, "n", place.cast("double").alias(out))
    return lookup(df, steps, [*by, value], rows_per_slice).drop("n")


def _pick(probs: list[float], value: str) -> list[Column]:
    """Interpolated quantiles of a ladder, as aggregates."""
    v, before, n = quoted(value).cast("double"), F.col("before"), F.col("n")
    picked = []
    for p in probs:
        at = F.lit(p) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        x = F.max(F.when((before <= low) & (low < before + n), v))
        y = F.max(F.when((before <= high) & (high < before + n), v))
        frac = F.max(at - low)
        picked.append(x + (y - x) * frac)
    return picked


def grouped_quantiles(df: DataFrame, value: str, by: list[str], probs: dict[str, float],
                      rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exact interpolated quantiles per group: one output column per entry of ``probs``."""
    steps = ladder(df, value, by, rows_per_slice)
    return steps.groupBy(*by).agg(*[c.alias(name) for name, c in zip(probs, _pick(list(probs.values()), value))])


def sketch_error(size: int) -> float:
    """Rank error, as a share of the rows, that a KLL sketch of the size stays below in 99 of 100 cases."""
    return 2.296 / size ** 0.9021


def _sketched(typed: DataFrame, columns: int, points: list[list[float]], size: int, known: bool) -> dict:
    """Count, least and greatest value of every column and its values at the points, about; from one scan.

    Every task sketches its rows, and sketches are merged in two levels, so no task merges more than a root of all of them.
    """
    tasks = "_task"
    cells = [e for i in range(columns) for e in (
        [F.kll_sketch_agg_double(f"c{i}", F.lit(size)).alias(f"s{i}")]
        + ([] if known else [F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}")]))]
    parts = typed.withColumn(tasks, F.pmod(F.spark_partition_id(), F.lit(SKETCH_TREE))).groupBy(tasks).agg(*cells)
    whole = parts.agg(*[e for i in range(columns) for e in (
        [F.kll_merge_agg_double(f"s{i}").alias(f"s{i}"), F.max(F.kll_sketch_get_n_double(f"s{i}")).alias(f"any{i}")]
        + ([] if known else [F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]))])
    return whole.select(*[c for c in whole.columns if not c.startswith(("s", "any"))], *[
        F.when(F.col(f"any{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(float(x)) for x in points[i]]))).alias(f"q{i}")
        for i in range(columns) if points[i]]).first().asDict()


def _counted(typed: DataFrame, brackets: list[list[tuple[float, float]]]) -> DataFrame:
    """``zone, value, n``: rows by value inside the brackets of each column, and by zone between them (value null).

    The zones of a column go on from those of the column before: below the first bracket, in it, between it and the second, and so on.
    """
    cells, first = [], 0
    for i, own in enumerate(brackets):
        if own:
            v = F.col(f"c{i}")
            zone, value = F.lit(first + 2 * len(own)), F.lit(None).cast("double")
            for j, (lo, hi) in reversed(list(enumerate(own))):
                inside = v <= F.lit(hi)
                zone = F.when(v < F.lit(lo), first + 2 * j).when(inside, first + 2 * j + 1).otherwise(zone)
                value = F.when(inside & (v >= F.lit(lo)), v).otherwise(value)
            cells.append(F.struct(F.when(v.isNotNull(), zone).alias("zone"), value.alias("value")))
        first += 2 * len(own) + 1
    return typed.select(F.inline(F.array(*cells))).where("zone is not null").groupBy("zone", "value").agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], keep: int = READ_OUT, sketch: int = SKETCH,
                    ranges: dict[str, dict] | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> dict[str, dict[float, float | None]]:
    """Exact interpolated quantiles of whole columns in two scans, without a shuffle of the data.

    The first scan sketches every column (KLL, mergeable). A sketch's rank error is known, so its quantiles a little before and after a
    wanted position make up a bracket that holds it. The second scan counts the rows below and between brackets and the values inside
    them, each task its own first. Are the rows inside all brackets of all columns at most ``keep``, their values are read out; if not,
    running totals over the counts pick the answers where they are. A bracket that missed its position, which is rare, is widened
    and counted again. Known ``ranges`` (count, min and max per column) are not sought again.
    """
    if not cols:
        return {}
    typed = df.select(*[F.when(~F.isnan(quoted(c).cast("double")),
                               clip(quoted(c).cast("double"), -_MAX, _MAX)).alias(f"c{i}")
                        for i, c in enumerate(cols)])
    known = {k: v for i, c in enumerate(cols) for r in ((ranges or {}).get(c),) if r for k, v in (
        (f"n{i}", r["count"]), (f"lo{i}", r["min"] and max(r["min"], -_MAX)), (f"hi{i}", r["max"] and min(r["max"], _MAX)))}
    settled = len(known) == 3 * len(cols)
    flat = [settled and (not known[f"n{i}"] or known[f"lo{i}"] == known[f"hi{i}"]) for i in range(len(cols))]
    error = 1.5 * sketch_error(sketch)
    around = sorted({min(1.0, max(0.0, p + e)) for p in probs for e in (-error, error)})
    start = known if all(flat) else known | _sketched(typed, len(cols), [[] if f else around for f in flat], sketch, settled)

    answers: dict[tuple[int, int], float] = {}
    wanted: dict[int, dict[int, tuple[float, float]]] = {}  # column -> position -> its bracket
    expected = 0.0
    for i in range(len(cols)):
        n, lo, hi = (start[f"{k}{i}"] for k in ("n", "lo", "hi"))
        for p in probs if n else []:
            for position in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                if lo == hi or position in (0, n - 1):
                    answers[i, position] = hi if position == n - 1 else lo
                elif n * error < 4:  # about as many rows as a sketch holds
                    wanted.setdefault(i, {})[position] = lo, hi
                else:
                    points = dict(zip(around, start[f"q{i}"]))
                    wanted.setdefault(i, {})[position] = (points[p - error] if p > error else lo, points[p + error] if p + error < 1 else hi)
        expected += sum(min(n, 2 * n * error) for _ in wanted.get(i, ())) if n * error >= 4 else n

    while wanted:
        spans: list[list[tuple[float, float]]] = []
        for i in range(len(cols)):
            own: list[tuple[float, float]] = []
            for lo, hi in sorted(wanted.get(i, {}).values()):
                if own and lo <= own[-1][1]:
                    own[-1] = (own[-1][0], max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
            spans.append(own)
        counts = _counted(typed, spans)
        few = expected <= keep
        if not few:
            counts = materialise(counts, "brackets")
            few = counts.count() <= keep
        totals: dict[int, int] = {}
        values: dict[int, list[tuple[float, int]]] = {}
        for r in (counts if few else counts.groupBy("zone").agg(F.lit(None).cast("double").alias("value"), F.sum("n").alias("n"))).collect():
            totals[r["zone"]] = totals.get(r["zone"], 0) + r["n"]
            if r["value"] is not None:
                values.setdefault(r["zone"], []).append((r["value"], r["n"]))
        # where each position lies: its zone and the rows of the zone before it
        places, first = {}, 0
        for i, own in enumerate(spans):
            for position in list(wanted.get(i, {})):
                left, zone = position, first
                while left >= totals.get(zone, 0):
                    left -= totals.get(zone, 0)
                    zone += 1
                if (zone - first) % 2:
                    places[i, position] = (zone, left)
                else:  # missed: from here on the bracket reaches to the ends
                    wanted[i][position] = start[f"lo{i}"], start[f"hi{i}"]
                    expected += start[f"n{i}"]
            first += 2 * len(own) + 1
        answers |= _inside(values, places) if few else _distributed(counts, places, rows_per_slice)
        for i, position in places:
            del wanted[i][position]
        wanted = {i: own for i, own in wanted.items() if own}

    result: dict[str, dict[float, float | None]] = {}
    for i, c in enumerate(cols):
        n = start[f"n{i}"]
        result[c] = {}
        for p in probs:
            if not n:
                result[c][p] = None
                continue
            at = p * (n - 1)
            x, y = (math.copysign(math.inf, v) if abs(v) == _MAX else v
                    for v in (answers[(i, math.floor(at))], answers[(i, math.ceil(at))]))
            result[c][p] = x if x == y else x + (y - x) * (at - math.floor(at))
    return result


def _inside(values: dict[int, list[tuple[float, int]]], places: dict) -> dict[tuple[int, int], float]:
    """Values at the places, from the counts of their brackets."""
    answers, ordered = {}, {zone: sorted(found) for zone, found in values.items()}
    for key, (zone, left) in places.items():
        for value, n in ordered[zone]:
            if left < n:
                answers[key] = value
                break
            left -= n
    return answers


def _distributed(counts: DataFrame, places: dict, rows_per_slice: int) -> dict[tuple[int, int], float]:
    """The same by running totals over the counts; one row comes back for each place."""
    steps = rungs(counts.where("value is not null"), "value", ["zone"], rows_per_slice)
    asked = counts.sparkSession.createDataFrame([(*key, *place) for key, place in places.items()], "i int, position bigint, zone int, at bigint")
    found = steps.join(F.broadcast(asked), "zone").where("before <= at and at < before + n").select("i", "position", "value").collect()
    return {(r["i"], r["position"]): r["value"] for r in found}
