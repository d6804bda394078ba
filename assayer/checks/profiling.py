"""Scans, roles, cleaning and profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsing import parse_datetime, parse_number
from ..operators import profile as P
from ..operators import roles as R
from ..operators.digest import column_facts
from ..operators.stats import numeric_summary
from ..sources import csv as C
from ..sources.tables import ROW_ID
from . import check, keyed, rounded, table
from ..session import materialise, scratch_path
from .fixtures import DIRTY, dirty

# column -> Spark type of each test table
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
ID = "(^|_)(id|uuid|guid|key|code)s?$"
VOCABULARIES = ["'true','false'", "'yes','no'", "'y','n'", "'t','f'", "'0','1'", "'0.0','1.0'"]


def fields(name: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().split(" ", 1)) for f in COLUMNS[name].split(", ")]


def role_sql(source: str, cols: list[tuple[str, str]]) -> str:
    """(ordinal, column, dtype, rows, non_null, distinct, role) per column."""
    parts = []
    for i, (c, t) in enumerate(cols):
        n, nn, d = "count(*)", f"count({c})", f"count(distinct {c})"
        is_id = f"(regexp_matches('{c}', '(?i){ID}') and {d} / {n} >= 0.98)"
        if t.startswith("array"):
            role, d = "'nested'", "null::bigint"
        elif t == "timestamp_ntz":
            role = "'datetime'"
        elif t == "string":
            low = f"lower(trim({c}))"
            vocab = " or ".join(f"bool_and({low} in ({v}))" for v in VOCABULARIES)
            num = f"count(try_cast(trim({c}) as double)) / {nn}"
            day = f"count(try_cast(trim({c}) as timestamp)) / {nn}"
            role = (f"case when {d} <= 2 and ({vocab}) then 'boolean' when {num} >= 0.8 then case when {is_id} then 'id' else 'numeric' end "
                    f"when {day} >= 0.8 then 'datetime' when {is_id} then 'id' when {d} <= greatest(20, 0.05 * {n}) then 'categorical' else 'text' end")
        else:
            role = f"case when {d} <= 2 and bool_and({c} in (0, 1)) then 'boolean' when {is_id} then 'id' else 'numeric' end"
        parts.append(f"select {i} as ordinal, '{c}' as column, '{t}' as dtype, {n} as rows, {nn} as non_null, {d} as \"distinct\", "
                     f"case when {nn} = 0 then 'empty' else {role} end as role from {source}")
    return " union all ".join(parts)


def roles_of(df):
    return R.infer_roles(df).select("ordinal", "column", "dtype", "rows", "non_null", "distinct", "role")


for _name in COLUMNS:
    check(f"roles_{_name}", role_sql(_name, fields(_name)))(lambda s, d, n=_name: roles_of(table(s, d, n)))


def profile_sql(name: str) -> str:
    parts = []
    for i, (c, t) in enumerate(fields(name)):
        number = t in ("int", "bigint", "double")
        m = [f"min({c})::double", f"max({c})::double", f"round(avg({c}), 6)", f"round(coalesce(stddev_samp({c}), 0), 6)"]
        extent = ", ".join(f"case when r.role = 'numeric' then {e if number else 'null::double'} end as {k}"
                           for e, k in zip(m, ("min", "max", "mean", "std")))
        cleaned = {"id": "string", "boolean": "boolean"}
        dtype = "case r.role " + " ".join(f"when '{k}' then '{v}'" for k, v in cleaned.items()) + f" else '{t}' end"
        parts.append(f"select {i} as ordinal, '{c}' as name, r.role, {dtype} as dtype, count({c}) as non_null, "
                     f"round(100 * (1 - count({c}) / count(*)), 2) as null_pct, "
                     f"{'null::bigint' if t.startswith('array') else f'count(distinct {c})'} as \"unique\", {extent} "
                     f"from {name}, (select role from roles where roles.column = '{c}') r group by r.role")
    return f"with roles as ({role_sql(name, fields(name))}) " + " union all ".join(parts)


def profiled(s, d, name):
    return rounded(P.profile_of(R.infer_and_clean(table(s, d, name))))


for _name in ("orders", "lineitem", "events", "customer", "labels", "part", "documents", "embeddings"):
    check(f"profile_columns_{_name}", profile_sql(_name))(lambda s, d, n=_name: profiled(s, d, n))


def counters_sql(source: str, cols: list[str]) -> str:
    missing = " + ".join(f"({c} is null)::int" for c in cols)
    return (f"with t as (select {', '.join(cols)} from {source}), m as (select count(*) as n, count(*) filter (({missing}) > 0) as any_missing, "
            f"coalesce(sum({missing}), 0)::bigint as cells from t), u as (select count(*) as distinct_rows from (select distinct * from t)) "
            f"select n as row_count, {len(cols)}::bigint as col_count, n * {len(cols)} as cell_count, any_missing as rows_with_missing, "
            f"cells as missing_cells, round(100.0 * cells / (n * {len(cols)}), 2) as missing_cell_pct, n - distinct_rows as duplicate_rows from m, u")


for _name in ("orders", "lineitem", "documents", "events"):
    check(f"profile_table_{_name}", counters_sql(_name, [c for c, _ in fields(_name)]))(
        lambda s, d, n=_name: P.profile_table(table(s, d, n)))

# repeated and incomplete rows
GAPS = """(select p_brand, p_type, case when p_partkey % 6 = 0 then null else p_size end as p_size,
  case when p_partkey % 4 = 0 then null else p_name end as p_name from part)"""


def gaps(s, d):
    return table(s, d, "part").select(
        "p_brand", "p_type", F.when(F.col("p_partkey") % 6 != 0, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("p_name"))


check("profile_table_with_gaps", counters_sql(GAPS, ["p_brand", "p_type", "p_size", "p_name"]))(lambda s, d: P.profile_table(gaps(s, d)))
check("duplicate_rows", f"select (select count(*) from {GAPS}) - (select count(*) from (select distinct * from {GAPS})) as duplicate_rows")(
    lambda s, d: P.duplicate_rows(gaps(s, d)))
check("role_counts_lineitem", f"select role, count(*) as columns from ({role_sql('lineitem', fields('lineitem'))}) group by role")(
    lambda s, d: P.role_counts(R.infer_roles(table(s, d, "lineitem"))))


def sample_sql(name: str, key: str, cols: list[tuple[str, str]]) -> str:
    return " union all ".join(
        f"select '{c}' as column, string_agg(v, ', ' order by f) as sample from (select {expr} as v, min({key}) as f from {name} "
        f"where {c} is not null group by 1 order by f limit 5)" for c, expr in cols)


check("sample_values_orders", sample_sql("orders", "o_orderkey", [
    ("o_orderkey", "o_orderkey::varchar"), ("o_custkey", "o_custkey::varchar"), ("o_orderstatus", "o_orderstatus"),
    ("o_totalprice", "o_totalprice::varchar"), ("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"), ("o_orderpriority", "o_orderpriority")]))(
    lambda s, d: P.sample_values(keyed(s, d, "orders", "o_orderkey")))
check("sample_values_documents", sample_sql("documents", "doc_id", [
    ("doc_id", "doc_id::varchar"), ("text", "text"), ("lang", "lang"), ("source", "source"), ("n_chars", "n_chars::varchar")]))(
    lambda s, d: P.sample_values(keyed(s, d, "documents", "doc_id")))


@check("column_lookup", """select 'c_acctbal' as column, 'summary' as source, 'numeric' as role, count(*) as count, round(avg(c_acctbal), 6) as mean,
    round(quantile_cont(c_acctbal, 0.5), 6) as median, count(distinct c_acctbal) as "unique" from customer
  union all select 'c_mktsegment', 'profile', 'categorical', count(*), null, null, count(distinct c_mktsegment) from customer
  union all select 'nothing', 'column not found', null, null, null, null, null""")
def _(s, d):
    known = R.infer_and_clean(table(s, d, "customer"))
    profile, summary = P.profile_of(known), numeric_summary(known.clean, known.numeric)
    found = [P.column_summary(profile, summary, c) for c in ("c_acctbal", "c_mktsegment", "nothing")]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return rounded(out.select("column", "source", "role", "count", "mean", "median", "unique"))


# --- scans and cleaning
# the reader's view of the export: NA tokens are null, text is otherwise untouched
READ = f"""(select o_orderkey, order_code, price, status, paid, day, note, case when priority in ('n/a', '') then null else priority end as priority, customer from {DIRTY})"""


@check("csv_scan_orders", f"select order_code, price, status, paid, day, note, priority, customer from {READ}")
def _(s, d):
    path = scratch_path(s, "csv")
    C.write_csv(dirty(s, d), path)
    return C.read_csv(s, path).drop(ROW_ID)


@check("csv_quoted_line_breaks", "select doc_id, text from documents where text is not null and text <> ''")
def _(s, d):
    """Texts of documents, line breaks and all, written as quoted fields and read back by several tasks a file."""
    path, before = scratch_path(s, "csv"), s.conf.get("spark.sql.files.maxPartitionBytes")
    C.write_csv(table(s, d, "documents").select("doc_id", "text").where("text <> ''"), path, rows_per_file=50_000)
    s.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = materialise(C.read_csv(s, path, delimiter=",", encoding="UTF-8", multi_line=True), "records")
    finally:
        s.conf.set("spark.sql.files.maxPartitionBytes", before)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


check("na_tokens", f"select order_code, priority, note from {READ}")(
    lambda s, d: C.na_to_null(dirty(s, d).select("order_code", "priority", "note")))
check("parse_ratios", f"""select count(try_cast(trim(price) as double)) / count(price) as numeric_ratio,
  count(try_cast(trim(day) as timestamp)) / count(day) as datetime_ratio from {READ}""")(
    lambda s, d: dirty(s, d).agg((F.count(parse_number(F.col("price"))) / F.count("price")).alias("numeric_ratio"),
                                 (F.count(parse_datetime(F.col("day"))) / F.count("day")).alias("datetime_ratio")))


def read_dirty(s, d):
    return C.na_to_null(dirty(s, d))


@check("roles_long_numbers", """select * from (values ('long_number', 'numeric'), ('long_day', 'datetime'), ('long_text', 'text')) t("column", role)""")
def _(s, d):
    k = F.col("o_orderkey").cast("string")
    df = table(s, d, "orders").select(
        F.concat(F.lit("0."), F.lpad(k, 80, "7")).alias("long_number"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss."), F.lpad(k, 60, "0"), F.lit("Z")).alias("long_day"),
        F.concat(F.lpad(k, 80, "7"), F.lit(" pieces")).alias("long_text"), F.col("o_orderkey").alias(ROW_ID))
    return roles_of(df).select("column", "role")


@check("roles_empty_column", """select * from (values ('nothing', 'empty', 0), ('blank', 'empty', 0), ('o_orderstatus', 'categorical', 3)) t("column", role, "distinct")
  where (select count(*) from orders) > 0""")
def _(s, d):
    """Columns without a value: nulls of a number type, and nulls of text."""
    df = table(s, d, "orders").select("o_orderstatus", F.lit(None).cast("double").alias("nothing"), F.lit(None).cast("string").alias("blank"))
    return R.infer_roles(df).select("column", "role", F.col("distinct").cast("int").alias("distinct"))


@check("roles_dirty_orders", """select * from (values ('order_code', 'id'), ('price', 'numeric'), ('status', 'categorical'), ('paid', 'boolean'),
  ('day', 'datetime'), ('note', 'categorical'), ('priority', 'categorical'), ('customer', 'numeric')) v("column", role) where (select count(*) from orders) > 0""")
def _(s, d):
    return R.infer_roles(read_dirty(s, d), reader_types=True).select("column", "role")


@check("clean_orders", f"""select order_code, try_cast(trim(price) as double) as price, trim(status) as status, paid = 'Yes' as paid,
  try_cast(day as timestamp) as day, trim(note) as note, trim(priority) as priority, cast(customer as double) as customer from {READ}""")
def _(s, d):
    return R.infer_and_clean(read_dirty(s, d), reader_types=True).clean.drop(ROW_ID).withColumn("day", F.col("day").cast("timestamp_ntz"))


check("clean_drop_empty_rows", "select case when event_id % 3 <> 0 then event_type end as kind, case when event_id % 2 <> 0 then value end as value from events "
      "where event_id % 3 <> 0 or event_id % 2 <> 0")(
    lambda s, d: R.clean(table(s, d, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"),
                                                      F.when(F.col("event_id") % 2 != 0, F.col("value")).alias("value")),
                         {"kind": "categorical", "value": "numeric"}))


@check("second_inference", """select 'grade' as column, 'numeric' as first_role, 'boolean' as second_role, count(*) as rows from orders""")
def _(s, d):
    """A 0/1 column with junk is numeric at first and boolean once the junk is gone."""
    k = F.col("o_orderkey")
    df = table(s, d, "orders").select(F.when(k % 9 == 0, "bad").otherwise((k % 2).cast("string")).alias("grade"), k.cast("string").alias("filler"))
    known = R.infer_and_clean(df, reader_types=True)
    return df.agg(F.count("*").alias("rows")).select(
        F.lit("grade").alias("column"), F.lit(known.raw_roles["grade"]).alias("first_role"), F.lit(known.roles["grade"]).alias("second_role"), "rows")


check("column_facts_dirty_orders", " union all ".join(
    f"select '{c}' as column, count({c}) as non_null, count(distinct {c}) as \"distinct\", count(distinct trim({c})) as distinct_trimmed, "
    f"count(distinct lower(trim({c}))) as distinct_normalised, count(try_cast(trim({c}) as double)) as numeric_ok, "
    f"count(*) filter (trim({c}) <> {c}) as trim_changed from {READ}"
    for c in ("order_code", "price", "status", "paid", "day", "note", "priority", "customer")))(
    lambda s, d: column_facts(read_dirty(s, d)).select("column", "non_null", "distinct", "distinct_trimmed", "distinct_normalised",
                                                       "numeric_ok", "trim_changed"))
