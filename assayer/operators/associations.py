"""Associations between columns of any role."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.tables import ROW_ID, quoted
from .ordering import ROWS_PER_SLICE, ladder, lookup, running_weights
from .roles import BOOLEAN, CATEGORICAL, NUMERIC
from .stats import as_numbers, column_ranges, correlation_pairs

MIN_PAIR_ROWS = 5
RANKED_LIMIT = 40
LOOKUP_ROWS = 250_000
#: Patterns of gaps that are still ranked one by one.
MOST_MASKS = 64
SCHEMA = ("kind_order int, i int, j int, left string, right string, kind string, method string, "
          "strength double, secondary double, label string")


def strength_label(c: Column) -> Column:
    a = F.abs(c)
    return (F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("negligible"))


def _long(x: DataFrame, sets: list[Column], *keep: str) -> DataFrame:
    return (x.select(*keep, F.inline(F.array(*[F.struct(F.lit(g).alias("g"), v.alias("v")) for g, v in enumerate(sets)])))
            .where("v is not null"))


def _centred_ranks(x: DataFrame, sets: list[Column], rows_per_slice: int) -> DataFrame:
    """``g, v, n, rank``: the centred average rank of every value of every rank set; all ladders are built at once."""
    return materialise(ladder(_long(x, sets, "r"), "v", ["g"], rows_per_slice).select(
        "g", "v", "n", (F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2).alias("rank")), "ranks")


def _with_ranks(x: DataFrame, sets: list[Column], steps: DataFrame, rows_per_slice: int, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """One row per input row with what ``steps`` (``g, v, n, rank``) has for its values: k0, k1, … (one per rank set).

    Sets with few distinct values are looked up from a broadcast map without moving a row; the others are joined by value in long form
    and folded back by row.
    """
    sizes = {r["g"]: r["rows"] for r in steps.groupBy("g").agg(F.count("*").alias("rows")).collect()}
    small, room = [], lookup_rows * 4
    for g in sorted(sizes, key=sizes.get):
        if sizes[g] <= min(lookup_rows, room):
            small.append(g)
            room -= sizes[g]
    large = [g for g in range(len(sets)) if g not in small]
    for g in small:
        # at most ``lookup_rows`` values, counted above
        rung = F.broadcast(steps.where(F.col("g") == g).select(F.col("v").alias("_v"), F.col("rank").alias(f"k{g}")))
        x = x.join(rung, sets[g] == F.col("_v"), "left").drop("_v")
    if not large:
        return x
    if len(large) == 1:
        g = large[0]
        rung = steps.where(F.col("g") == g).select(F.col("v").alias("_v"), "n", F.col("rank").alias(f"k{g}"))
        return lookup(x.withColumn("_v", sets[g]), rung, ["_v"], rows_per_slice).drop("_v", "n")
    rest = (x.select("r", F.inline(F.array(*[F.struct(F.lit(g).alias("g"), sets[g].alias("v")) for g in large])))
            .where("v is not null"))
    ranked = lookup(rest, steps.where(F.col("g").isin(large)), ["g", "v"], rows_per_slice).select("r", "g", "rank")
    none = F.lit(None).cast(steps.schema["rank"].dataType)
    kept = [F.col(f"k{g}") for g in small]
    folded = ranked.select("r", "g", "rank", *[none.alias(f"k{g}") for g in small]).unionByName(
        x.select("r", F.lit(-1).alias("g"), none.alias("rank"), *kept))
    return folded.groupBy("r").agg(*[F.max(F.when(F.col("g") == g, F.col("rank"))).alias(f"k{g}") for g in large],
                                   *[F.max(f"k{g}").alias(f"k{g}") for g in small])


def _masks(x: DataFrame, gaps: list[int], most: int) -> list[str] | None:
    """The patterns of gaps that rows have, a digit for each column of ``gaps``; none if there are more than ``most``."""
    found = x.select(_mask(gaps).alias("m")).distinct().limit(most + 1).collect()
    return sorted(r["m"] for r in found) if len(found) <= most else None


def _mask(gaps: list[int]) -> Column:
    return F.concat(*[F.when(F.col(f"c{i}").isNull(), "0").otherwise("1") for i in gaps])


def _masked_ladders(x: DataFrame, columns: int, gaps: list[int], masks: list[str], rows_per_slice: int) -> DataFrame:
    """``g, v, n, rank`` of every column g: ``rank`` has, for each mask, the rows of that mask below the value and half of those at it.

    Rows are counted by column, mask and value; the ladders of all masks of a column stand side by side over its values.
    """
    place = F.map_from_arrays(F.array(*[F.lit(m) for m in masks]), F.array(*[F.lit(k) for k in range(len(masks))]))
    long = _long(x.withColumn("m", place[_mask(gaps)]), [F.col(f"c{i}") for i in range(columns)], "m")
    weights = [f"n{k}" for k in range(len(masks))]
    counts = materialise(long.groupBy("g", "v").agg(F.count("*").alias("n"), *[F.count_if(F.col("m") == k).alias(w) for k, w in enumerate(weights)]), "masked")
    steps = running_weights(counts, "v", ["g"], weights, rows_per_slice)
    return materialise(steps.select("g", "v", "n", F.array(*[F.col(f"before_{w}") + F.col(w) / 2 for w in weights]).alias("rank")), "ranks")


def _pair_sums(wide: DataFrame, columns: int, gaps: list[int], masks: list[str]) -> DataFrame:
    """``i, j, xy, xx, yy`` over the complete rows of each pair, of its centred ranks.

    The rank of a value in a pair is the sum of its places in the ladders of the masks that have both columns, less half of the rows
    that have both; a batch works it out for all pairs from the places, a matrix of masks for each column.
    """
    held = np.ones((len(masks), columns), dtype=bool)  # mask x column: present
    held[:, gaps] = [[d == "1" for d in m] for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, columns, columns))
        for batch in batches:
            mask, size = batch.column(columns).to_numpy(), batch.num_rows
            ranks = []
            for i in range(columns):
                lists = batch.column(i)
                there = lists.is_valid().to_numpy(zero_copy_only=False)
                places = np.zeros((size, len(masks)))
                places[there] = lists.drop_null().flatten().to_numpy().reshape(-1, len(masks))
                both = (held & held[:, [i]]).astype(np.float64)  # the masks that have i and j
                ranks.append(places @ both)
            for i in range(columns):
                for j in range(i + 1, columns):
                    rows = held[mask, i] & held[mask, j]
                    a, b = ranks[i][rows, j] - totals[i, j] / 2, ranks[j][rows, i] - totals[i, j] / 2
                    sums[:, i, j] += a @ b, a @ a, b @ b
        i, j = np.triu_indices(columns, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(s[i, j]) for s in sums]],
                                         ["i", "j", "xy", "xx", "yy"])

    rows = {r["m"]: r["n"] for r in wide.groupBy("m").agg(F.count("*").alias("n")).collect()}
    each = np.array([rows.get(k, 0) for k in range(len(masks))], dtype=np.float64)
    totals = (held * each[:, None]).T @ held
    return wide.select(*[f"k{i}" for i in range(columns)], "m").mapInArrow(run, "i int, j int, xy double, xx double, yy double") \
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])


def spearman_pairs(df: DataFrame, cols: list[str], row_id: str = ROW_ID, rows_per_slice: int = ROWS_PER_SLICE,
                   most_masks: int = MOST_MASKS, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """(i, j, rho): Pearson correlation of average ranks over the complete rows of each pair.

    Columns without nulls are ranked once for all their pairs. With gaps rows are told apart by the pattern of their gaps: a column has
    a ladder for each pattern, and the ranks of a pair are sums over the patterns that have both columns, so every row is
    looked up once a column. Only where patterns outnumber columns or ``most_masks`` does each pair rank its own complete rows.
    Ranks come from value counts, so ties never meet in a sorted group.
    """
    schema = "i int, j int, rho double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    x = as_numbers(df, cols, [F.col(row_id).alias("r")])
    counts = x.agg(F.count("*").alias("n"), *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))]).first()
    full = {i for i in range(len(cols)) if counts[f"n{i}"] == counts["n"]}
    gaps = [i for i in range(len(cols)) if i not in full]
    masks = _masks(x, gaps, min(most_masks, max(2, len(cols)))) if gaps else None
    if masks:
        place = F.map_from_arrays(F.array(*[F.lit(m) for m in masks]), F.array(*[F.lit(k) for k in range(len(masks))]))
        steps = _masked_ladders(x, len(cols), gaps, masks, rows_per_slice)
        own = [F.col(f"c{i}") for i in range(len(cols))]
        ranked = _with_ranks(x, own, steps, rows_per_slice, lookup_rows)
        # the folded form has the ranks only: a column without one is absent
        digits = F.concat(*[F.when(F.col(f"k{i}").isNull(), "0").otherwise("1") for i in gaps])
        sums = _pair_sums(materialise(ranked.select(*[f"k{i}" for i in range(len(cols))], place[digits].alias("m")), "placed"), len(cols), gaps, masks)
        return sums.select("i", "j", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))
    sets: list[tuple[int, Column]] = []
    place: dict[tuple[int, int, int], int] = {}
    shared = {}
    for i in sorted(full):
        shared[i] = len(sets)
        sets.append((i, F.col(f"c{i}")))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    for i, j in pairs:
        if i in full and j in full:
            place[(i, j, i)], place[(i, j, j)] = shared[i], shared[j]
            continue
        for k, other in ((i, j), (j, i)):
            place[(i, j, k)] = len(sets)
            sets.append((k, F.when(F.col(f"c{other}").isNotNull(), F.col(f"c{k}"))))
    own = [v for _, v in sets]
    wide = _with_ranks(x, own, _centred_ranks(x, own, rows_per_slice), rows_per_slice, lookup_rows)
    aggs: dict[str, Column] = {}
    for i, j in pairs:
        a, b = place[(i, j, i)], place[(i, j, j)]
        aggs[f"xy_{i}_{j}"] = F.sum(F.col(f"k{a}") * F.col(f"k{b}"))
        for g in (a, b):
            aggs[f"xx_{g}"] = F.sum(F.col(f"k{g}") * F.col(f"k{g}"))
    total = wide.agg(*[e.alias(k) for k, e in aggs.items()])
    # centred ranks of a complete set sum to zero, so the product sums are the covariances
    return total.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"),
        F.try_divide(F.col(f"xy_{i}_{j}"),
                     F.sqrt(F.col(f"xx_{place[(i, j, i)]}") * F.col(f"xx_{place[(i, j, j)]}"))).alias("rho"))
        for i, j in pairs])))


def numeric_associations(df: DataFrame, cols: list[str], row_id: str = ROW_ID, ranges: dict | None = None) -> DataFrame:
    """Pearson strength with Spearman as second opinion, for pairs with at least five complete rows."""
    pearson = correlation_pairs(df, cols, ranges).where((F.col("n") >= MIN_PAIR_ROWS) & F.col("r").isNotNull())
    rho = spearman_pairs(df, cols, row_id)
    joined = pearson.join(F.broadcast(rho), ["i", "j"], "left")
    return joined.select(
        F.lit(0).alias("kind_order"), "i", "j", F.col("a").alias("left"), F.col("b").alias("right"),
        F.lit("numeric-numeric").alias("kind"), F.lit("pearson/spearman").alias("method"),
        F.round("r", 4).alias("strength"), F.round("rho", 4).alias("secondary"), strength_label(F.col("r")).alias("label"))


def correlation_ratios(df: DataFrame, categories: list[str], numbers: list[str], ranges: dict | None = None) -> DataFrame:
    """(i, j, eta) per category x number: share of spread explained by the groups, as a square root.

    One pre-aggregated group-by over all category columns carries the sums of all numbers.
    """
    schema = "i int, j int, eta double"
    if not categories or not numbers:
        return df.sparkSession.createDataFrame([], schema)
    ranges = ranges or column_ranges(df, numbers)
    x = as_numbers(df, numbers, [quoted(c).cast("string").alias(f"g{i}") for i, c in enumerate(categories)])
    centred = [(F.col(f"c{j}") - F.lit(ranges[c]["mean"] or 0.0)).alias(f"c{j}") for j, c in enumerate(numbers)]
    long = x.select(*centred, F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"g{i}").alias("value")) for i in range(len(categories))]))).where("value is not null")
    groups = long.groupBy("i", "value").agg(*[e for j in range(len(numbers)) for e in (
        F.count(f"c{j}").alias(f"n{j}"), F.sum(f"c{j}").alias(f"s{j}"), F.sum(F.col(f"c{j}") * F.col(f"c{j}")).alias(f"q{j}"))])
    cells = groups.select("i", F.inline(F.array(*[F.struct(
        F.lit(j).alias("j"), F.col(f"n{j}").alias("n"), F.col(f"s{j}").alias("s"), F.col(f"q{j}").alias("q"))
        for j in range(len(numbers))]))).where("n > 0")
    n, s = F.sum("n"), F.sum("s")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    total = F.sum("q") - s * s / n
    flat = F.array(*[F.lit(ranges[c]["min"] == ranges[c]["max"]) for c in numbers])
    eta = F.sqrt(F.greatest(F.least(F.try_divide(F.col("between"), F.col("total")), F.lit(1.0)), F.lit(0.0)))
    return (cells.groupBy("i", "j")
            .agg(n.alias("n"), F.count("*").alias("groups"), between.alias("between"), total.alias("total"))
            .select("i", "j", F.when((F.col("groups") >= 2) & (F.col("n") >= 3) & (F.col("total") > 0)
                                     & ~F.element_at(flat, F.col("j") + 1), eta).otherwise(0.0).alias("eta")))


def cramers_v(df: DataFrame, cols: list[str], hot_cells: int = ROWS_PER_SLICE) -> DataFrame:
    """(i, j, v) per pair of categorical columns: chi-squared from the contingency counts, no correction."""
    schema = "i int, j int, v double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    x = df.select(*[quoted(c).cast("string").alias(f"g{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}").alias("a"), F.col(f"g{j}").alias("b"))
                      for i in range(len(cols)) for j in range(i + 1, len(cols))])
    cells = (x.select(F.inline(pairs)).where("a is not null and b is not null")
             .groupBy("i", "j", "a", "b").agg(F.count("*").cast("double").alias("o")))
    cells = materialise(cells, "cells")
    left = cells.groupBy("i", "j", "a").agg(F.sum("o").alias("r"), F.count("*").alias("n"))
    right = cells.groupBy("i", "j", "b").agg(F.sum("o").alias("c"), F.count("*").alias("n"))
    # a category that meets very many others is broadcast
    met = lookup(cells, left, ["i", "j", "a"], hot_cells).drop("n")
    shares = (lookup(met, right, ["i", "j", "b"], hot_cells)
              .groupBy("i", "j").agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s")))
    sizes = (left.groupBy("i", "j").agg(F.count("*").alias("rows"))
             .join(right.groupBy("i", "j").agg(F.count("*").alias("cols")), ["i", "j"]))
    least = F.least("rows", "cols") - 1
    return shares.join(sizes, ["i", "j"]).select(
        "i", "j", F.when(least >= 1, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / least)).otherwise(0.0).alias("v"))


def _named(names: list[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in names]), F.col(index) + 1)


def discover(df: DataFrame, roles: dict[str, str], row_id: str = ROW_ID, limit: int = RANKED_LIMIT,
             ranges: dict | None = None) -> DataFrame:
    """All associations by absolute strength; ties keep numeric, mixed, categorical order."""
    numbers = [c for c, r in roles.items() if r == NUMERIC]
    groups = [c for c, r in roles.items() if r in (CATEGORICAL, BOOLEAN)]
    ranges = ranges or column_ranges(df, numbers)
    none = F.lit(None).cast("double")
    parts = []
    if len(numbers) > 1:
        parts.append(numeric_associations(df, numbers, row_id, ranges))
    if numbers and groups:
        eta = correlation_ratios(df, groups, numbers, ranges).where("eta > 0")
        parts.append(eta.select(
            F.lit(1).alias("kind_order"), "i", "j", _named(groups, "i").alias("left"), _named(numbers, "j").alias("right"),
            F.lit("categorical-numeric").alias("kind"), F.lit("correlation ratio (eta)").alias("method"),
            F.round("eta", 4).alias("strength"), none.alias("secondary"), strength_label(F.col("eta")).alias("label")))
    if len(groups) > 1:
        v = cramers_v(df, groups).where("v > 0")
        parts.append(v.select(
            F.lit(2).alias("kind_order"), "i", "j", _named(groups, "i").alias("left"), _named(groups, "j").alias("right"),
            F.lit("categorical-categorical").alias("kind"), F.lit("cramers_v").alias("method"),
            F.round("v", 4).alias("strength"), none.alias("secondary"), strength_label(F.col("v")).alias("label")))
    if not parts:
        return df.sparkSession.createDataFrame([], SCHEMA)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.orderBy(F.desc(F.abs("strength")), "kind_order", "i", "j").limit(limit)
