"""One row of facts per column, computed on distinct values weighted by their counts.

Every column is turned into (ordinal, value) pairs and pre-aggregated on the map side, so parse checks, spelling
variants and vocabularies run once per distinct value and a value that fills a third of the table is one row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import BOOLEAN_VOCABULARIES, parse_datetime, parse_number
from ..functions.text import is_short, normalise, strip, token
from ..sources.tables import ROW_ID, data_columns, is_nested, is_number, quoted

FACTS = ("ordinal int, column string, dtype string, rows bigint, non_null bigint, distinct bigint, "
         "distinct_trimmed bigint, distinct_normalised bigint, numeric_ok bigint, datetime_ok bigint, "
         "trim_changed bigint, boolean_like boolean")


def _present(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def _kinds(df: DataFrame) -> tuple[list[tuple[int, str]], list[tuple[int, str]], list[tuple[int, str]]]:
    text, fixed, nested = [], [], []
    for i, c in enumerate(data_columns(df)):
        t = df.schema[c].dataType
        (nested if is_nested(t) else text if isinstance(t, T.StringType) else fixed).append((i, c))
    return text, fixed, nested


def _row_id(df: DataFrame) -> Column:
    return (F.col(ROW_ID) if ROW_ID in df.columns else F.lit(None)).cast("bigint")


def _grouped(cells: DataFrame, keys: list[str], rows: bool) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.min("r").alias("first_row")] if rows else [])
    return cells.groupBy(*keys).agg(*aggs)


def _exploded(df: DataFrame, cells: list[Column], rows: bool) -> DataFrame:
    return df.select(*([_row_id(df).alias("r")] if rows else []), F.inline(F.array(*cells)))


def text_values(df: DataFrame) -> DataFrame | None:
    """(ordinal, tok, trim, norm, num, dated, n) per distinct text value; long texts stand as fingerprints.

    What a long text parses to is found before it becomes a fingerprint; short ones are parsed once per distinct value later on.
    """
    text, _, _ = _kinds(df)
    if not text:
        return None
    # cells first, so that what is asked of a text is one expression, however many columns there are
    v = F.col("v")
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), quoted(c).alias("v")) for i, c in text])))
    keyed = cells.select(
        "ordinal", token(v).alias("tok"),
        F.when(~is_short(v), token(strip(v))).alias("trim"),
        F.when(~is_short(v), token(normalise(v))).alias("norm"),
        F.when(~is_short(v), parse_number(v)).alias("long_num"),
        F.when(~is_short(v), parse_datetime(v).isNotNull()).alias("long_date"))
    return (_grouped(keyed, ["ordinal", "tok", "trim", "norm", "long_num", "long_date"], False)
            .withColumn("trim", F.coalesce("trim", strip(F.col("tok"))))
            .withColumn("norm", F.coalesce("norm", F.lower("trim"))))


def _fixed_keys(df: DataFrame) -> tuple[list[Column], list[str]]:
    """One-to-one keys: the hash of a single value of at most 64 bits never collides; wider decimals get a second hash."""
    _, fixed, _ = _kinds(df)
    wide = [i for i, c in fixed if isinstance(df.schema[c].dataType, T.DecimalType) and df.schema[c].dataType.precision > 18]
    cells = []
    for i, c in fixed:
        v = _present(df, c)
        key = [F.when(v.isNotNull(), F.xxhash64(v)).alias("key")]
        if wide:
            key.append(F.when(F.lit(i in wide) & v.isNotNull(), F.xxhash64(F.lit(7), v)).alias("key2"))
        cells.append(F.struct(F.lit(i).alias("ordinal"), *key))
    return cells, ["ordinal", "key", *(["key2"] if wide else [])]


def fixed_values(df: DataFrame) -> DataFrame | None:
    """(ordinal, key, n, zero_one) per distinct number, date or boolean."""
    _, fixed, _ = _kinds(df)
    if not fixed:
        return None
    cells, keys = _fixed_keys(df)
    # whether a value is 0 or 1 (or any boolean) is read off its key
    lows, highs = {}, {}
    for i, c in fixed:
        t = df.schema[c].dataType
        low, high = (F.lit(0), F.lit(1)) if is_number(t) else (F.lit(False), F.lit(True)) if isinstance(t, T.BooleanType) else (None, None)
        if low is not None:
            lows[i], highs[i] = F.xxhash64(low.cast(t)), F.xxhash64(high.cast(t))

    def of(keys_: dict[int, Column]) -> Column:
        return F.element_at(F.create_map(*[x for i, k in keys_.items() for x in (F.lit(i), k)]), F.col("ordinal")) if keys_ else F.lit(None)

    zero_one = F.coalesce(F.col("key") == of(lows), F.lit(False)) | F.coalesce(F.col("key") == of(highs), F.lit(False))
    return _grouped(_exploded(df, cells, False), keys, False).withColumn("zero_one", zero_one)


def _text_facts(values: DataFrame, reader_types: bool) -> DataFrame:
    n, tok = F.col("n"), F.col("tok")
    trimmed = values.groupBy("ordinal", "trim", "norm").agg(
        F.sum(n).alias("n"), F.count(tok).alias("raw"), F.max("long_num").alias("long_num"), F.max("long_date").alias("long_date"),
        F.sum(F.when(tok != F.col("trim"), n).otherwise(0)).alias("changed"))
    datey = F.coalesce("long_date", F.col("trim").isNotNull() & parse_datetime(F.col("trim"), stripped=True).isNotNull())
    normal = trimmed.withColumn("dates", F.when(datey, n).otherwise(0)).groupBy("ordinal", "norm").agg(
        F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.count("trim").alias("trims"),
        F.sum("changed").alias("changed"), F.sum("dates").alias("dates"), F.max("long_num").alias("long_num"))
    normal = normal.withColumn("num", F.coalesce("long_num", parse_number(F.col("norm"))))
    vocab = [F.coalesce(F.bool_and(F.col("norm").isin(v)), F.lit(False)).alias(f"v{k}")
             for k, v in enumerate(BOOLEAN_VOCABULARIES)]
    by_number = normal.groupBy("ordinal", "num").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("norm").isNotNull(), n).otherwise(0)).alias("present"),
        F.sum("raw").alias("raw"), F.sum("trims").alias("trims"), F.count("norm").alias("norms"),
        F.sum("changed").alias("changed"), F.sum("dates").alias("dates"), *vocab)
    has_text = F.col("present") > 0
    facts = by_number.groupBy("ordinal").agg(
        F.sum("n").alias("rows"), F.sum("present").alias("non_null"), F.sum("raw").alias("raw"),
        F.sum("trims").alias("distinct_trimmed"), F.sum("norms").alias("distinct_normalised"),
        F.count("num").alias("numbers"), F.sum(F.when(F.col("num").isNotNull(), n).otherwise(0)).alias("numeric_ok"),
        F.sum("dates").alias("datetime_ok"), F.sum("changed").alias("trim_changed"),
        F.coalesce(F.bool_and(F.when(has_text, F.coalesce(F.col("num").isin(0.0, 1.0), F.lit(False)))),
                   F.lit(False)).alias("zero_one"),
        *[F.coalesce(F.bool_and(F.when(has_text, F.col(f"v{k}"))), F.lit(False)).alias(f"v{k}")
          for k in range(len(BOOLEAN_VOCABULARIES))])
    any_vocab = F.lit(False)
    for k in range(len(BOOLEAN_VOCABULARIES)):
        any_vocab = any_vocab | F.col(f"v{k}")
    distinct, boolean_like = F.col("raw"), any_vocab
    if reader_types:
        # a reader turns an all-numeric column into numbers and an all-true/false one into booleans
        all_numeric = (F.col("numeric_ok") == F.col("non_null")) & (F.col("non_null") > 0)
        distinct = F.when(all_numeric, F.col("numbers")).when(F.col("v0"), F.col("distinct_normalised")).otherwise(distinct)
        boolean_like = F.when(all_numeric, F.col("zero_one")).otherwise(boolean_like)
    return facts.select("ordinal", "rows", "non_null", distinct.cast("bigint").alias("distinct"),
                        "distinct_trimmed", "distinct_normalised", "numeric_ok", "datetime_ok", "trim_changed",
                        boolean_like.alias("boolean_like"))


def _fixed_facts(values: DataFrame, df: DataFrame) -> DataFrame:
    _, fixed, _ = _kinds(df)
    numbers = [i for i, c in fixed if is_number(df.schema[c].dataType)]
    dates = [i for i, c in fixed if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    present = F.sum(F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0))
    facts = values.groupBy("ordinal").agg(
        F.sum("n").alias("rows"), present.alias("non_null"), F.count("key").alias("distinct"),
        F.coalesce(F.bool_and(F.when(F.col("key").isNotNull(), F.col("zero_one"))), F.lit(False)).alias("boolean_like"))
    zero = F.lit(0).cast("bigint")
    return facts.select(
        "ordinal", "rows", "non_null", "distinct", F.col("distinct").alias("distinct_trimmed"),
        F.col("distinct").alias("distinct_normalised"),
        F.when(F.col("ordinal").isin(numbers), F.col("non_null")).otherwise(zero).alias("numeric_ok"),
        F.when(F.col("ordinal").isin(dates), F.col("non_null")).otherwise(zero).alias("datetime_ok"),
        zero.alias("trim_changed"), "boolean_like")


def _nested_facts(df: DataFrame) -> DataFrame | None:
    _, _, nested = _kinds(df)
    if not nested:
        return None
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    counted = df.agg(F.count("*").alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in nested])
    return counted.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("ordinal"), F.col("rows"), F.col(f"n{i}").alias("non_null"), none.alias("distinct"),
        none.alias("distinct_trimmed"), none.alias("distinct_normalised"), zero.alias("numeric_ok"),
        zero.alias("datetime_ok"), zero.alias("trim_changed"), F.lit(False).alias("boolean_like"))
        for i, _ in nested])))


def column_facts(df: DataFrame, reader_types: bool = False) -> DataFrame:
    """Facts per column of a frame, see FACTS. ``reader_types`` marks an all-text frame read from a file."""
    text, fixed = text_values(df), fixed_values(df)
    parts = []
    if text is not None:
        parts.append(_text_facts(text, reader_types))
    if fixed is not None:
        parts.append(_fixed_facts(fixed, df))
    nested = _nested_facts(df)
    if nested is not None:
        parts.append(nested)
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    cols = data_columns(df)
    names = F.array(*[F.lit(c) for c in cols])
    types = F.array(*[F.lit(df.schema[c].dataType.simpleString()) for c in cols])
    return facts.select(
        "ordinal", F.element_at(names, F.col("ordinal") + 1).alias("column"),
        F.element_at(types, F.col("ordinal") + 1).alias("dtype"),
        "rows", "non_null", "distinct", "distinct_trimmed", "distinct_normalised", "numeric_ok", "datetime_ok",
        "trim_changed", "boolean_like")


def _first_seen(df: DataFrame, columns: list[tuple[int, Column]], k: int) -> DataFrame:
    """(ordinal, key, first_row): in every task the ``k`` distinct keys of each column that its rows show first.

    A task keeps ``k`` keys a column, so it gives back at most that many rows, however many values there are. A key that was dropped
    for a later row and returns with an earlier one is taken up again, so rows may come in any order.
    """
    ordinals = [i for i, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in ordinals]
        for batch in batches:
            rows = batch.column(0).to_numpy()
            order = None if len(rows) < 2 or (np.diff(rows) > 0).all() else np.argsort(rows, kind="stable")
            for held, column in zip(kept, batch.columns[1:]):
                column = column if order is None else column.take(pa.array(order))
                own = rows if order is None else rows[order]
                last = max(held.values()) if len(held) >= k else None
                upto = len(own) if last is None else int(np.searchsorted(own, last))
                size, fresh = 64, 0
                while fresh < upto:  # parts of growing size until k keys of this batch are known
                    part = column.slice(fresh, min(size, upto - fresh))
                    for i, key in enumerate(part.to_pylist()):
                        if key is not None and held.get(key, own[fresh + i] + 1) > own[fresh + i]:
                            held[key] = int(own[fresh + i])
                    if len(held) > k:
                        for key in sorted(held, key=held.get)[k:]:
                            del held[key]
                    fresh += len(part)
                    if len(held) == k:
                        upto = min(upto, int(np.searchsorted(own, max(held.values()))))
                    size *= 4
        found = [(ordinals[i], str(key), row) for i, held in enumerate(kept) for key, row in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int32(), pa.string(), pa.int64()))],
                                         ["ordinal", "key", "first_row"])

    return df.select(F.col(ROW_ID), *[c.alias(f"k{i}") for i, c in columns]).mapInArrow(run, "ordinal int, key string, first_row bigint")


def first_values(df: DataFrame, k: int = 5) -> DataFrame:
    """(ordinal, first_row, value) of the first ``k`` distinct values of each column in row order."""
    text, fixed, _ = _kinds(df)
    columns = [(i, token(quoted(c))) for i, c in text]
    for i, c in fixed:
        v = _present(df, c)
        t = df.schema[c].dataType
        wide = isinstance(t, T.DecimalType) and t.precision > 18
        columns.append((i, v.cast("string") if wide else F.when(v.isNotNull(), F.xxhash64(v))))
    firsts = _first_seen(df, columns, k).groupBy("ordinal", "key").agg(F.min("first_row").alias("first_row"))
    w = W.partitionBy("ordinal").orderBy("first_row")
    top = firsts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    # at most k rows per column; they fetch their values from the rows they name
    wanted = top.groupBy(F.col("first_row").alias("_r")).agg(F.collect_list("ordinal").alias("_of"))
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), _present(df, c).cast("string").alias("value")) for i, c in text + fixed])
    return (df.join(F.broadcast(wanted), F.col(ROW_ID) == F.col("_r"))
            .select(F.col("_r").alias("first_row"), "_of", F.inline(cells)).where(F.array_contains("_of", F.col("ordinal")))
            .select("ordinal", "first_row", "value"))


def facts_frame(spark: SparkSession, facts: list) -> DataFrame:
    """Collected facts (one per column) as a table again."""
    names = [f.split(" ")[0] for f in FACTS.split(", ")]
    return spark.createDataFrame([tuple(f[n] for n in names) for f in facts], FACTS)
