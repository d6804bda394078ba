"""Column roles and role-driven cleaning."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import parse_boolean, parse_datetime, parse_number
from ..functions.text import strip
from ..session import materialise, spread
from ..sources.tables import data_columns, is_nested, is_number, quoted
from .digest import column_facts, facts_frame

NUMERIC, CATEGORICAL, TEXT, DATETIME = "numeric", "categorical", "text", "datetime"
BOOLEAN, ID, EMPTY, NESTED = "boolean", "id", "empty", "nested"

# fixed value: names that mark an identifier
ID_NAME = r"(^|_)(id|uuid|guid|key|code)s?$"
PARSE_SHARE, ID_SHARE, CATEGORY_SHARE, CATEGORY_FLOOR = 0.8, 0.98, 0.05, 20


def with_role(facts: DataFrame) -> DataFrame:
    """Add parse ratios and the role to column facts."""
    c = F.col
    share = F.coalesce(F.try_divide(c("distinct").cast("double"), c("rows").cast("double")), F.lit(0.0))
    numeric = F.coalesce(F.try_divide(c("numeric_ok").cast("double"), c("non_null").cast("double")), F.lit(0.0))
    datetime = F.coalesce(F.try_divide(c("datetime_ok").cast("double"), c("non_null").cast("double")), F.lit(0.0))
    is_id = c("column").rlike("(?i)" + ID_NAME) & (share >= ID_SHARE)
    nested = c("dtype").rlike("^(array|map|struct|variant|binary)")
    role = (F.when(c("non_null") == 0, EMPTY)
            .when(nested, NESTED)
            .when((c("distinct") <= 2) & c("boolean_like"), BOOLEAN)
            .when(numeric >= PARSE_SHARE, F.when(is_id, ID).otherwise(NUMERIC))
            .when(datetime >= PARSE_SHARE, DATETIME)
            .when(is_id, ID)
            .when(c("distinct") <= F.greatest(F.lit(float(CATEGORY_FLOOR)), F.lit(CATEGORY_SHARE) * c("rows")), CATEGORICAL)
            .otherwise(TEXT))
    return (facts.withColumn("numeric_ratio", numeric).withColumn("datetime_ratio", datetime)
            .withColumn("role", role))


def infer_roles(df: DataFrame, reader_types: bool = False) -> DataFrame:
    """One row per column: facts, parse ratios and role."""
    return with_role(column_facts(df, reader_types))


def collect_roles(roles: DataFrame) -> dict[str, str]:
    """Column -> role, in column order; one short string per column."""
    return {r["column"]: r["role"] for r in roles.orderBy("ordinal").select("column", "role").collect()}


def clean_value(c: Column, t: T.DataType, role: str) -> Column:
    if is_nested(t):
        return c
    if role == NUMERIC:
        return c if is_number(t) else parse_number(c)
    if role == DATETIME:
        return c if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse_datetime(c)
    if role == BOOLEAN:
        return c if isinstance(t, T.BooleanType) else parse_boolean(c)
    if role in (CATEGORICAL, TEXT, ID):
        return strip(c.cast("string"))
    return c


def _typed(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    return df.select(*[
        clean_value(quoted(c), df.schema[c].dataType, roles[c]).alias(c) if c in roles else quoted(c)
        for c in df.columns])


def _without_empty(df: DataFrame) -> DataFrame:
    return df.dropna("all", subset=["`" + c.replace("`", "``") + "`" if "." in c else c for c in data_columns(df)])


def clean(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Typed and trimmed columns; rows with no value at all are dropped."""
    return _without_empty(_typed(df, roles))


def recount(facts: list, reader_types: bool) -> list[str]:
    """Columns whose distinct values or parse counts can differ after cleaning."""
    out = []
    for f in facts:
        text, role = f["dtype"] == "string", f["role"]
        unparsed = (role == NUMERIC and f["numeric_ok"] != f["non_null"]) or (role == DATETIME and f["datetime_ok"] != f["non_null"])
        respelled = text and (role in (BOOLEAN, DATETIME) or (role == NUMERIC and not reader_types) or (role == ID and f["numeric_ok"] > 0))
        if unparsed or respelled or f["trim_changed"]:
            out.append(f["column"])
    return out


def facts_after_cleaning(cleaned: DataFrame, facts: list, reader_types: bool) -> DataFrame:
    """Column facts of the cleaned frame: only columns whose values changed are counted again.

    For the others just the number of rows can differ, and only if no column was full before cleaning.
    """
    changed = recount(facts, reader_types)
    always_full = any(f["non_null"] == f["rows"] and f["column"] not in changed for f in facts)
    rows = facts[0]["rows"] if always_full else cleaned.count()
    out = facts_frame(cleaned.sparkSession, [f for f in facts if f["column"] not in changed]).withColumn(
        "rows", F.lit(rows).cast("bigint"))
    if changed:
        order = F.element_at(F.create_map(*[F.lit(x) for f in facts for x in (f["column"], f["ordinal"])]), F.col("column"))
        out = out.unionByName(column_facts(cleaned.select(*[quoted(c) for c in changed])).withColumn("ordinal", order))
    types = F.create_map(*[F.lit(x) for c in data_columns(cleaned) for x in (c, cleaned.schema[c].dataType.simpleString())])
    return out.withColumn("dtype", F.element_at(types, F.col("column")))


@dataclass
class Inference:
    """What is known of a table after reading it once (twice for columns that cleaning altered)."""
    clean: DataFrame
    roles: dict[str, str]
    facts: list
    raw_facts: list
    raw_roles: dict[str, str]

    @property
    def numeric(self) -> list[str]:
        return [c for c, r in self.roles.items() if r == NUMERIC]


def infer_and_clean(df: DataFrame, reader_types: bool = False, keep: bool = False) -> Inference:
    """Infer, clean, and infer again on the cleaned frame; the facts hold one row per column.

    Text of a reader is always written once it is cleaned; ``keep`` does so for any table, for callers that scan it many times.
    """
    raw_facts = infer_roles(df, reader_types).orderBy("ordinal").collect()
    raw_roles = {f["column"]: f["role"] for f in raw_facts}
    if reader_types or keep:
        # text is parsed once into columnar form; everything after reads it by column, on all cores. Rows without a value are left out
        # by the readers: as a condition on the parsed values it would be moved below them, and every text parsed twice
        rows = raw_facts[0]["rows"] if raw_facts else 0
        cleaned = _without_empty(materialise(spread(_typed(df, raw_roles), rows) if keep else _typed(df, raw_roles), "clean"))
    else:
        cleaned = clean(df, raw_roles)
    facts = with_role(facts_after_cleaning(cleaned, raw_facts, reader_types)).orderBy("ordinal").collect()
    return Inference(cleaned, {f["column"]: f["role"] for f in facts}, facts, raw_facts, raw_roles)


def is_id_name(name: str) -> bool:
    return re.search(ID_NAME, name, re.I) is not None
