"""Associations between columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import associations as A
from . import check, keyed, rounded, table
from .statistics import LINE, WIDE, _wide
from .verbs import GAPPY, _gappy

NUMBERS, GROUPS = ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]


def rank_sql(c: str, keep: str) -> str:
    return (f"case when {keep} then rank() over (partition by {keep} order by {c}) "
            f"+ (count(*) over (partition by {keep}, {c}) - 1) / 2.0 end")


def spearman_sql(source: str, a: str, b: str) -> str:
    keep = f"({a} is not null and {b} is not null)"
    return f"(select corr(ra, rb) from (select {rank_sql(a, keep)} as ra, {rank_sql(b, keep)} as rb from {source}))"


def eta_sql(source: str, c: str, v: str) -> str:
    t = f"(select {c} as c, {v} as v, avg({v}) over () as m, avg({v}) over (partition by {c}) as gm from {source} where {c} is not null and {v} is not null)"
    return f"(select case when count(distinct c) < 2 or count(*) < 3 then 0 else coalesce(sqrt(sum((gm - m) ** 2) / nullif(sum((v - m) ** 2), 0)), 0) end from {t})"


def cramer_sql(source: str, a: str, b: str) -> str:
    cells = f"(select a, b, count(*) as o from (select {a}::varchar as a, {b}::varchar as b from {source} where {a} is not null and {b} is not null) group by 1, 2)"
    return (f"(select case when least(count(distinct a), count(distinct b)) < 2 then 0 else sqrt(greatest(sum(o * o / (r * c)) - 1, 0) / (least(count(distinct a), count(distinct b)) - 1)) end "
            f"from (select a, b, o::double as o, (sum(o) over (partition by a))::double as r, (sum(o) over (partition by b))::double as c from {cells}))")


def label_sql(x: str) -> str:
    return f"case when abs({x}) >= 0.7 then 'strong' when abs({x}) >= 0.4 then 'moderate' when abs({x}) >= 0.2 then 'weak' else 'negligible' end"


def discover_sql(source: str, numbers: list[str], groups: list[str]) -> str:
    parts = []
    for i, a in enumerate(numbers):
        for j in range(i + 1, len(numbers)):
            b = numbers[j]
            parts.append(f"select 0 as kind_order, {i} as i, {j} as j, '{a}' as left, '{b}' as right, 'numeric-numeric' as kind, 'pearson/spearman' as method, "
                         f"corr({a}, {b}) as s, {spearman_sql(source, a, b)} as s2 from {source} having count(case when {a} is not null then {b} end) >= 5")
    for i, c in enumerate(groups):
        for j, v in enumerate(numbers):
            parts.append(f"select * from (select 1 as kind_order, {i} as i, {j} as j, '{c}' as left, '{v}' as right, 'categorical-numeric' as kind, "
                         f"'correlation ratio (eta)' as method, {eta_sql(source, c, v)} as s, null::double as s2) where s > 0")
    for i, a in enumerate(groups):
        for j in range(i + 1, len(groups)):
            parts.append(f"select * from (select 2 as kind_order, {i} as i, {j} as j, '{a}' as left, '{groups[j]}' as right, 'categorical-categorical' as kind, "
                         f"'cramers_v' as method, {cramer_sql(source, a, groups[j])} as s, null::double as s2) where s > 0")
    return (f"select kind_order, i, j, \"left\", \"right\", kind, method, round(s, 4) + 0 as strength, round(s2, 4) + 0 as secondary, {label_sql('s')} as label "
            f"from ({' union all '.join(parts)}) where s is not null and not isnan(s) order by abs(round(s, 4)) desc, kind_order, i, j limit 40")


check("relationships_orders", discover_sql("orders", NUMBERS, GROUPS))(
    lambda s, d: A.discover(keyed(s, d, "orders", "o_orderkey"), dict.fromkeys(NUMBERS, "numeric") | dict.fromkeys(GROUPS, "categorical")))
check("relationships_lineitem", discover_sql("lineitem", LINE, ["l_returnflag", "l_linestatus"]))(
    lambda s, d: A.discover(table(s, d, "lineitem", row_id=True), dict.fromkeys(LINE, "numeric") | dict.fromkeys(["l_returnflag", "l_linestatus"], "categorical")))
check("relationships_documents", discover_sql("documents", ["n_chars"], ["lang", "source"]))(
    lambda s, d: A.discover(keyed(s, d, "documents", "doc_id"), {"n_chars": "numeric", "lang": "categorical", "source": "categorical"}))
check("pearson_pairs", f"select 'user_id' as left, 'value' as right, round(corr(user_id, value), 4) + 0 as strength from {GAPPY}")(
    lambda s, d: A.numeric_associations(_gappy(s, d).withColumn("_row_id", F.col("event_id")), ["user_id", "value"]).select("left", "right", "strength"))
check("spearman_with_gaps", " union all ".join(
    f"select {i} as i, {j} as j, round({spearman_sql(GAPPY, a, b)}, 6) + 0 as rho" for i, j, a, b in (
        (0, 1, "event_id", "user_id"), (0, 2, "event_id", "value"), (1, 2, "user_id", "value"))))(
    lambda s, d: rounded(A.spearman_pairs(_gappy(s, d).withColumn("_row_id", F.col("event_id")), ["event_id", "user_id", "value"])))
_MASKED = ["l_quantity", "l_extendedprice_7", "l_partkey_7", "l_quantity_13", "l_suppkey_13", "late"]
check("spearman_with_gap_patterns", f"with w as materialized (select {', '.join(f'{WIDE[c]} as {c}' for c in _MASKED)} from lineitem) " + " union all ".join(
    f"select {i} as i, {j} as j, round({spearman_sql('w', a, b)}, 6) + 0 as rho"
    for i, a in enumerate(_MASKED) for j, b in enumerate(_MASKED) if i < j))(
    lambda s, d: rounded(A.spearman_pairs(_wide(s, d, row_id=True), _MASKED)))
check("eta_part", f"select 0 as i, 0 as j, round({eta_sql('part', 'p_type', 'p_retailprice')}, 6) as eta union all "
      f"select 1, 0, round({eta_sql('part', 'p_brand', 'p_retailprice')}, 6)")(
    lambda s, d: rounded(A.correlation_ratios(table(s, d, "part"), ["p_type", "p_brand"], ["p_retailprice"])))
CRAMER = (f"select 0 as i, 1 as j, round({cramer_sql('part', 'p_type', 'p_brand')}, 6) as v union all "
      f"select 0, 2, round({cramer_sql('part', 'p_type', 'p_name')}, 6) union all select 1, 2, round({cramer_sql('part', 'p_brand', 'p_name')}, 6)")
check("cramers_v_part", CRAMER)(
    lambda s, d: rounded(A.cramers_v(table(s, d, "part"), ["p_type", "p_brand", "p_name"])))
check("cramers_v_busy_categories", CRAMER)(
    lambda s, d: rounded(A.cramers_v(table(s, d, "part"), ["p_type", "p_brand", "p_name"], hot_cells=30)))
check("strength_labels", f"select event_id, {label_sql('(value / 100 - 1)')} as label from events")(
    lambda s, d: table(s, d, "events").select("event_id", A.strength_label(F.col("value") / 100 - 1).alias("label")))
