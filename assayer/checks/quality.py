"""Quality scorecard and schema drift."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import roles as R
from ..operators.digest import facts_frame
from ..operators.outliers import iqr_outliers
from ..sources import csv as C
from . import check, rounded, table
from .fixtures import dirty
from .profiling import READ, counters_sql, role_sql

ROLES = {"order_code": "id", "price": "numeric", "status": "categorical", "paid": "boolean", "day": "datetime",
         "note": "categorical", "priority": "categorical", "customer": "numeric"}
CLEAN = f"""(select order_code, try_cast(trim(price) as double) as price, trim(status) as status, paid = 'Yes' as paid,
  try_cast(day as timestamp) as day, trim(note) as note, trim(priority) as priority, cast(customer as double) as customer from {READ})"""
COUNTERS = counters_sql(CLEAN, list(ROLES))


def _column_sql() -> str:
    parts = []
    for i, (c, role) in enumerate(ROLES.items()):
        num, day = f"count(try_cast(trim({c}) as double)) / count({c})", f"count(try_cast(trim({c}) as timestamp)) / count({c})"
        valid = {"numeric": num, "datetime": day}.get(role, "null::double")
        same = f"count(distinct lower(trim({c}))) / count(distinct {c})" if role == "categorical" else "null::double"
        trust = {"numeric": num, "datetime": day, "boolean": "1.0", "id": f"count(distinct trim({c})) / count({c})",
                 "categorical": f"1 - least(1.0, count(distinct trim({c})) / (0.5 * count(*)))"}[role]
        parts.append(f"select {i} as ordinal, '{c}' as column, '{role}' as role, {valid} as validity, {same} as consistency, "
                     f"count(distinct {c}) as \"distinct\", count(distinct lower(trim({c}))) as distinct_normalised, {trust} as confidence from {READ}")
    return " union all ".join(parts)


COLUMNS_SQL = _column_sql()
FENCED = " union all ".join(
    f"(with q as (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, count({c}) as n from {CLEAN}) "
    f"select round(100.0 * count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / any_value(n), 2) as pct from {CLEAN}, q)"
    for c in ("price", "customer"))
SCORES = f"""(with t as ({COUNTERS}), c as ({COLUMNS_SQL}), o as (select avg(pct) as mean_pct from ({FENCED}))
  select 0 as position, 'completeness' as key, 'Completeness' as label, 100 - missing_cell_pct as score, 0.28 as weight from t
  union all select 1, 'duplication', 'Uniqueness', 100 * (1 - duplicate_rows / greatest(row_count, 1)), 0.14 from t
  union all select 2, 'validity', 'Validity', coalesce(100 * avg(validity), 100), 0.22 from c
  union all select 3, 'consistency', 'Consistency', coalesce(100 * avg(consistency), 100), 0.14 from c
  union all select 4, 'outliers', 'Outlier cleanliness', greatest(0, least(100, 100 - 3 * mean_pct)), 0.10 from o
  union all select 5, 'type_confidence', 'Type confidence', coalesce(100 * avg(confidence), 100), 0.12 from c)"""
DETAILS = f"""(select 'completeness' as key, missing_cell_pct || '% of cells are empty (' || rows_with_missing || '/' || row_count || ' rows affected).' as detail from ({COUNTERS})
  union all select 'duplication', duplicate_rows || ' exact duplicate rows.' from ({COUNTERS})
  union all (select 'validity', "column" || ': ' || round(100 * (1 - validity), 2) || '% of values don''t parse as ' || role || '.' from ({COLUMNS_SQL}) where validity < 0.98
    order by validity, ordinal limit 1)
  union all (select 'consistency', "column" || ': ' || "distinct" || ' raw values collapse to ' || distinct_normalised || ' after trimming/casing.' from ({COLUMNS_SQL})
    where consistency < 0.95 order by "distinct" - distinct_normalised desc, ordinal limit 1)
  union all select 'type_confidence', 'Some column types were inferred with low confidence.'
  union all select 'outliers', 'Numeric columns average ' || printf('%.1f', avg(pct)) || '% IQR outliers.' from ({FENCED}))"""


def raw(s, d):
    return C.na_to_null(dirty(s, d))


def parts(s, d):
    """Raw facts, final roles, table counters and fences of the dirty export."""
    df = raw(s, d)
    known = R.infer_and_clean(df, reader_types=True)
    return (facts_frame(s, known.raw_facts), P.role_table(known.clean, known.roles), P.profile_table(known.clean),
            iqr_outliers(known.clean, known.numeric, examples=False))


check("quality_columns", f"select ordinal, \"column\", role, round(validity, 9) as validity, round(consistency, 9) as consistency, \"distinct\", distinct_normalised, "
      f"round(confidence, 9) as confidence from ({COLUMNS_SQL})")(
    lambda s, d: rounded(Q.column_quality(*parts(s, d)[:2]).drop("has_values"), 9))
check("quality_unparseable", f"select ordinal, \"column\", role, round(100 * (1 - validity), 2) as unparseable_pct from ({COLUMNS_SQL}) where validity < 0.98 order by 4 desc, 1 limit 5")(
    lambda s, d: Q.unparseable(Q.column_quality(*parts(s, d)[:2])))
check("quality_inconsistent", f"select ordinal, \"column\", \"distinct\" as raw_values, distinct_normalised as after_normalisation from ({COLUMNS_SQL}) where consistency < 0.95")(
    lambda s, d: Q.inconsistent(Q.column_quality(*parts(s, d)[:2])))
check("quality_low_confidence", """select 0 as ordinal, 'mark' as column, 'categorical' as inferred_role, round(1 - least(1.0, count(distinct s_suppkey % 20) / (0.5 * count(*))), 2) as confidence
  from supplier having 1 - least(1.0, count(distinct s_suppkey % 20) / (0.5 * count(*))) < 0.85""")(
    lambda s, d: _low(s, d))


def _low(s, d):
    df = table(s, d, "supplier").select((F.concat(F.lit("m"), (F.col("s_suppkey") % 20).cast("string"))).alias("mark"))
    known = R.infer_and_clean(df)
    return Q.low_confidence(Q.column_quality(facts_frame(s, known.raw_facts), P.role_table(known.clean, known.roles)))


def _scores(s, d):
    facts, roles, tab, iqr = parts(s, d)
    columns = Q.column_quality(facts, roles)
    return Q.subscores(columns, tab, iqr), columns, tab, iqr


check("quality_subscores", f"select position, key, label, round(score, 6) as score, weight::double as weight from {SCORES}")(
    lambda s, d: rounded(_scores(s, d)[0]))
check("quality_overall", f"""select round_even(t, 1) as overall, case when t >= 90 then 'A' when t >= 80 then 'B' when t >= 70 then 'C' when t >= 60 then 'D' when t >= 50 then 'E' else 'F' end as grade
  from (select sum(score * weight::double) as t from {SCORES})""")(lambda s, d: Q.overall(_scores(s, d)[0]))


@check("quality_issues", f"""select place::int as place, label as dimension, round_even(score, 1) as score, detail from
  (select *, row_number() over (order by score, position) as place from {SCORES}) s join {DETAILS} d using (key) where place <= 3 and score < 90""")
def _(s, d):
    scores, columns, tab, iqr = _scores(s, d)
    return Q.issues(scores, Q.issue_details(columns, tab, iqr))


# --- drift: the same export earlier (half the rows, other columns) and now
BEFORE = "(select o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority as legacy from orders where o_orderkey % 2 = 0)"
NOW = """(select o_orderkey, 'C' || o_custkey as o_custkey, case when o_orderkey % 3 = 0 then null else o_totalprice end as o_totalprice, o_orderstatus, o_orderdate from orders)"""
BEFORE_COLUMNS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderstatus", "string"), ("legacy", "string")]
NOW_COLUMNS = [("o_orderkey", "bigint"), ("o_custkey", "string"), ("o_totalprice", "double"), ("o_orderstatus", "string"), ("o_orderdate", "timestamp_ntz")]


def print_sql(source: str, cols: list[tuple[str, str]]) -> str:
    return (f"select r.column as name, r.role, r.dtype, round(100 * (1 - non_null / rows), 2) as null_pct, t.row_count, t.col_count, t.missing_cell_pct "
            f"from ({role_sql(source, cols)}) r, ({counters_sql(source, [c for c, _ in cols])}) t")


P_SQL, C_SQL = print_sql(BEFORE, BEFORE_COLUMNS), print_sql(NOW, NOW_COLUMNS)


def _fingerprint(df):
    known = R.infer_and_clean(df)
    return D.fingerprint(P.profile_of(known), P.profile_table(known.clean))


def before(s, d):
    return _fingerprint(table(s, d, "orders").where("o_orderkey % 2 = 0").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("legacy")))


def now(s, d):
    return _fingerprint(table(s, d, "orders").select(
        "o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus", "o_orderdate"))


CHANGES = f"""(with p as ({P_SQL}), c as ({C_SQL})
  select 'added' as kind, name as column, null as before, role as after, null::double as jump from c where name not in (select name from p)
  union all select 'removed', name, role, null, null from p where name not in (select name from c)
  union all select 'role_change', p.name, p.role, c.role, null from p join c using (name) where p.role <> c.role
  union all select 'null_spike', p.name, p.null_pct::varchar, c.null_pct::varchar, round(c.null_pct - p.null_pct, 1) from p join c using (name) where c.null_pct - p.null_pct >= 15)"""

check("drift_fingerprint", C_SQL)(lambda s, d: now(s, d))
check("drift_baseline", f"""select 'baseline' as status, 'info' as severity, '{D.BASELINE_TEXT}' as summary, 0::bigint as added, 0::bigint as removed, 0::bigint as role_changes,
  0::bigint as null_spikes, null::bigint as row_delta, null::double as row_delta_pct from (select count(*) as n from orders) where n > 0""")(
    lambda s, d: D.compare(None, now(s, d)))
for _kind in ("added", "removed", "role_change", "null_spike"):
    check(f"drift_{_kind}", f"select * from {CHANGES} where kind = '{_kind}'")(
        lambda s, d, k=_kind: D.changes(before(s, d), now(s, d)).where(F.col("kind") == k))
check("drift_row_delta", f"with p as (select count(*) as n from {BEFORE}), c as (select count(*) as n from {NOW}) select c.n - p.n as row_delta, "
      "round(100.0 * (c.n - p.n) / p.n, 1) as row_delta_pct from p, c")(lambda s, d: D.row_delta(before(s, d), now(s, d)))
check("drift_compare", f"""with k as (select count(*) filter (kind = 'added') as added, count(*) filter (kind = 'removed') as removed, count(*) filter (kind = 'role_change') as role_changes,
    count(*) filter (kind = 'null_spike') as null_spikes from {CHANGES}),
  r as (select (select count(*) from {NOW}) - (select count(*) from {BEFORE}) as row_delta, round(100.0 * ((select count(*) from {NOW}) - (select count(*) from {BEFORE})) / (select count(*) from {BEFORE}), 1) as row_delta_pct)
  select 'compared' as status, case when removed > 0 or role_changes > 0 then 'critical' when added > 0 or null_spikes > 0 or abs(row_delta_pct) >= 40 then 'warning' else 'info' end as severity,
    'Since the last run: ' || concat_ws(', ', case when added > 0 then added || ' new column(s)' end, case when removed > 0 then removed || ' column(s) removed' end,
      case when role_changes > 0 then role_changes || ' type change(s)' end, case when null_spikes > 0 then null_spikes || ' null-rate spike(s)' end,
      case when abs(row_delta_pct) >= 5 then printf('%+.0f', row_delta_pct) || '% rows' end) || '.' as summary, added, removed, role_changes, null_spikes, row_delta, row_delta_pct from k, r""")(
    lambda s, d: D.compare(before(s, d), now(s, d)))
check("drift_unchanged", f"""select 'compared' as status, 'info' as severity, '{D.UNCHANGED_TEXT}' as summary, 0::bigint as added, 0::bigint as removed, 0::bigint as role_changes, 0::bigint as null_spikes,
  0::bigint as row_delta, 0.0 as row_delta_pct from (select count(*) as n from orders) where n > 0""")(lambda s, d: D.compare(now(s, d), now(s, d)))


@check("drift_table", f"""select case kind when 'added' then 0 when 'removed' then 1 when 'role_change' then 2 else 3 end as position, "column",
    case kind when 'added' then 'Column added' when 'removed' then 'Column removed' when 'role_change' then 'Type change' else 'Null-rate spike' end as change,
    case kind when 'role_change' then "column" || ': ' || before || ' → ' || after when 'null_spike' then "column" || ': ' || before || '% → ' || after || '%' else "column" end as detail from {CHANGES}
  union all select 4, '', 'Row count', (case when c.n < p.n then '-' else '+' end) || format('{{:,}}', abs(c.n - p.n)) || printf(' rows (%+.1f%%)', round(100.0 * (c.n - p.n) / p.n, 1)) from (select count(*) as n from {BEFORE}) p, (select count(*) as n from {NOW}) c""")
def _(s, d):
    p, c = before(s, d), now(s, d)
    return D.change_table(D.compare(p, c), D.changes(p, c))
