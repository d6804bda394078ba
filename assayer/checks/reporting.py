"""Chart data, findings and report tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import general3
from ..operators import associations as A
from ..operators import charts as H
from ..operators import drift as D
from ..operators import findings as I
from ..operators import outliers as O
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import roles as R
from ..operators import stats as S
from ..operators.drivers import segments
from ..plans import report, workflow
from ..session import scratch_path, settle
from . import check, keyed, rounded, table
from .associations import discover_sql
from .drivers import ROLES, flat, segment_sql
from .outliers import fence_sql
from .profiling import GAPS, counters_sql, gaps, profile_sql
from .quality import CHANGES, CLEAN, DETAILS, SCORES, _scores, before, now, parts, raw
from .statistics import LINE, matrix_sql, pairs_sql, summary_sql

# skewed, widely spread and nearly redundant columns
SHAPED = "(select event_id, user_id, value, value * value as squared, value * 2 + user_id * 0.01 as twin from events)"
SHAPED_COLUMNS = ["user_id", "value", "squared", "twin"]


def shaped(s, d):
    v, u = F.col("value"), F.col("user_id")
    return table(s, d, "events").select("event_id", "user_id", "value", (v * v).alias("squared"), (v * 2 + u * 0.01).alias("twin"),
                                        F.col("event_id").alias("_row_id"))


def shaped_summary(s, d):
    order = F.array_position(F.array(*[F.lit(c) for c in SHAPED_COLUMNS]), F.col("column")).cast("int") - 1
    return S.numeric_summary(shaped(s, d), SHAPED_COLUMNS).withColumn("ordinal", order)


# --- charts
def bins_sql(source: str, cols: list[str]) -> str:
    parts_ = []
    for c in cols:
        parts_.append(
            f"(with r as (select min({c})::double as a, max({c})::double as b from {source}), e as (select case when a = b then a - 0.5 else a end as lo, case when a = b then b + 0.5 else b end as hi from r), "
            f"n as (select least(floor(({c} - lo) / (hi - lo) * 12), 11)::int as bin, count(*) as n from {source}, e where {c} is not null group by 1) "
            f"select '{c}' as column, g.bin::int as bin, round(lo + (hi - lo) * (g.bin + 0.5) / 12, 3) as centre, coalesce(n.n, 0) as count from (select unnest(range(12)) as bin) g cross join e left join n using (bin))")
    return " union all ".join(parts_)


check("histogram_lineitem", bins_sql("lineitem", LINE[:4]))(lambda s, d: H.histogram(table(s, d, "lineitem"), LINE[:4]))
check("histogram_events", bins_sql("events", ["user_id", "value"]))(lambda s, d: H.histogram(table(s, d, "events"), ["user_id", "value"]))
check("histogram_constant", bins_sql("(select 3.0::double as flat from orders)", ["flat"]))(
    lambda s, d: H.histogram(table(s, d, "orders").select(F.lit(3.0).alias("flat")), ["flat"]))
check("scatter_events", f"select value as x, round(twin, 6) as y from {SHAPED} order by event_id limit 500")(
    lambda s, d: rounded(H.scatter(shaped(s, d), "value", "twin")))
check("role_mix_orders", f"select role, count(*) as columns from ({profile_sql('orders')}) group by role")(
    lambda s, d: P.role_counts(R.infer_roles(table(s, d, "orders"))))
check("box_lineitem", " union all ".join(
    f"select '{c}' as column, min({c})::double as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.75), 6) as p75, max({c})::double as max, "
    f"round(2.5 * quantile_cont({c}, 0.25) - 1.5 * quantile_cont({c}, 0.75), 6) + 0 as lower_fence, round(2.5 * quantile_cont({c}, 0.75) - 1.5 * quantile_cont({c}, 0.25), 6) as upper_fence from lineitem" for c in LINE[:6]))(
    lambda s, d: rounded(H.box(table(s, d, "lineitem"), LINE[:6])))
check("bars_part", """select "column", value, n, place::int as place from (select *, row_number() over (partition by "column" order by n desc, value) as place from
  (select 'p_type' as column, p_type as value, count(*) as n from part group by 2 union all select 'p_brand', p_brand, count(*) from part group by 2)) where place <= 10""")(
    lambda s, d: H.bars(table(s, d, "part"), ["p_type", "p_brand"]))
check("heatmap_events", " union all ".join(
    f"select '{a}' as column, '{b}' as other, " + ("1.0" if a == b else f"round(corr({a}, {b}), 4) + 0") + f" as r from {SHAPED}" + (" having count(*) > 0" if a == b else "")
    for a in SHAPED_COLUMNS for b in SHAPED_COLUMNS))(lambda s, d: H.heatmap(shaped(s, d), SHAPED_COLUMNS))


@check("chart_specs_customer", """select * from (values (2, 'histogram', 'c_custkey', null), (3, 'box', 'c_custkey', null), (4, 'histogram', 'c_nationkey', null), (5, 'box', 'c_nationkey', null),
  (6, 'histogram', 'c_acctbal', null), (7, 'box', 'c_acctbal', null), (21, 'bar', 'c_mktsegment', null), (31, 'heatmap', 'c_custkey, c_nationkey, c_acctbal', null)) v(position, type, x, y)
  where (select count(*) from customer) > 0 union all (select 30, 'scatter', a, b from (""" + pairs_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]) + ") order by abs(r) desc limit 1)")
def _(s, d):
    c = table(s, d, "customer")
    profile = P.profile_columns(c, {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "categorical"})
    return H.chart_specs(profile, S.correlation_pairs(c, ["c_custkey", "c_nationkey", "c_acctbal"])).drop("r")


# --- findings
GAP_COUNTERS = counters_sql(GAPS, ["p_brand", "p_type", "p_size", "p_name"])
check("findings_table", f"""select 1 as rule, 0::bigint as pos, 'data_quality' as category, case when missing_cell_pct > 20 then 'critical' when missing_cell_pct > 5 then 'warning' else 'info' end as severity,
    missing_cell_pct || '% of cells are missing' as title, rows_with_missing || ' of ' || row_count || ' rows have at least one missing value.' as evidence from ({GAP_COUNTERS}) where missing_cell_pct > 0
  union all select 3, 0, 'data_quality', case when duplicate_rows / row_count > 0.01 then 'warning' else 'info' end, duplicate_rows || ' duplicate rows detected', 'Exact full-row duplicates.'
    from ({GAP_COUNTERS}) where duplicate_rows > 0""")(
    lambda s, d: I.about_table(P.profile_table(gaps(s, d))).withColumn("pos", F.col("pos")[0].cast("bigint")))
check("findings_missing_advice", f"""with c as ({' union all '.join(f"select {i} as ordinal, '{c}' as name, round(100 * (1 - count({c}) / count(*)), 2) as null_pct from {CLEAN}" for i, c in enumerate(
    ["order_code", "price", "status", "paid", "day", "note", "priority", "customer"]))})
  select 'Address missingness in ''' || name || '''' as title, null_pct || '% missing — consider imputation, a ''missing'' category, or dropping the column.' as detail,
    case when null_pct >= 60 then 'high' else 'medium' end as priority from (select * from c order by null_pct desc, ordinal limit 3) where null_pct >= 30""")(
    lambda s, d: I.missing_advice(_dirty_profile(s, d)).select("title", "detail", "priority"))


def _dirty_profile(s, d):
    return P.profile_of(R.infer_and_clean(raw(s, d), reader_types=True))


check("findings_duplicate_advice", f"select 'De-duplicate the dataset' as title, 'medium' as priority from ({GAP_COUNTERS}) where duplicate_rows > 0")(
    lambda s, d: I.duplicate_advice(P.profile_table(gaps(s, d))).select("title", "priority"))
_SHAPE = " union all ".join(
    f"select {i} as ordinal, '{c}' as column, skewness({c}) as skew, avg({c}) as mean, quantile_cont({c}, 0.5) as median, stddev_samp({c}) / avg({c}) as cv from {SHAPED}" for i, c in enumerate(SHAPED_COLUMNS))
check("findings_shape", f"""with s as ({_SHAPE}) select 'info' as severity, '''' || "column" || ''' is ' || case when skew > 0 then 'right' else 'left' end || '-skewed' as title,
    'skew=' || printf('%.2f', skew) || ', mean=' || format('{{:.3g}}', mean) || ', median=' || format('{{:.3g}}', median) || '.' as evidence from s where abs(skew) >= 1
  union all select 'info', '''' || "column" || ''' has very high relative variability', 'coefficient of variation = ' || printf('%.2f', cv) || '.' from s where cv > 1.5""")(
    lambda s, d: I.about_shape(shaped_summary(s, d)).select("severity", "title", "evidence"))
check("findings_shape_advice", f"""select 'Consider transforming ''' || "column" || '''' as title, 'low' as priority from ({_SHAPE}) where abs(skew) >= 1""")(
    lambda s, d: I.shape_advice(shaped_summary(s, d)).select("title", "priority"))
_PAIRS = pairs_sql(SHAPED, SHAPED_COLUMNS)
check("findings_relations", f"""select case when abs(r) >= 0.7 then 'Strong' else 'Moderate' end || ' association: ''' || a || ''' ↔ ''' || b || '''' as title,
    'pearson/spearman = ' || round(r, 4) || ' (numeric-numeric).' as evidence from ({_PAIRS}) where abs(round(r, 4)) >= 0.6""")(
    lambda s, d: I.about_relations(A.discover(shaped(s, d), dict.fromkeys(SHAPED_COLUMNS, "numeric"))).select("title", "evidence"))
check("findings_redundancy", f"""select 'Possible redundancy: ''' || a || ''' and ''' || b || '''' as title, 'Pearson r = ' || printf('%.2f', r) || '. Consider dropping one to reduce multicollinearity.' as detail
  from ({_PAIRS}) where abs(r) >= 0.85""")(
    lambda s, d: I.redundancy_advice(S.top_pairs(S.correlation_pairs(shaped(s, d), SHAPED_COLUMNS))).select("title", "detail"))
check("findings_outliers", f"""select 'warning' as severity, '''' || "column" || ''' has ' || outlier_pct || '% IQR outliers' as title,
    outlier_count || ' values outside [' || format('{{:.3g}}', lower_fence) || ', ' || format('{{:.3g}}', upper_fence) || '].' as evidence from ({fence_sql(SHAPED, SHAPED_COLUMNS)}) where outlier_pct >= 5""")(
    lambda s, d: I.about_outliers(O.iqr_outliers(shaped(s, d), SHAPED_COLUMNS, examples=False)).select("severity", "title", "evidence"))


def _forest(s, d):
    """What the forest flags among all lines: of n rows those whose score is over the 0.98 quantile."""
    used, scores = O.anomaly_scores(table(s, d, "lineitem", row_id=True), LINE)
    return O.flag_anomalies(scores).agg(F.count_if("flagged").alias("flagged_count"), F.array(*[F.lit(c) for c in used]).alias("columns"))


_FLAGGED = "(select (count(*) - 1 - floor(0.98 * (count(*) - 1)))::bigint as n from lineitem)"
check("findings_forest", f"""select 'IsolationForest flagged ' || n || ' multivariate outlier rows' as title, 'Across columns {", ".join(LINE[:6])}….' as evidence, 'info' as severity
  from {_FLAGGED} where n > 0""")(lambda s, d: I.about_forest(_forest(s, d)).select("title", "evidence", "severity"))
check("findings_forest_advice", f"select 'Review flagged anomalous rows' as title, 'medium' as priority from {_FLAGGED} where n > 0")(
    lambda s, d: I.forest_advice(_forest(s, d)).select("title", "priority"))
check("findings_drift", f"""select 'critical' as severity, 'Schema changed since the last run' as title from {CHANGES} where kind in ('removed', 'role_change') having count(*) > 0""")(
    lambda s, d: I.about_drift(D.compare(before(s, d), now(s, d))).select("severity", "title"))
check("findings_drift_advice", f"""select 'Investigate removed columns' as title, 'These columns disappeared: ' || string_agg("column", ', ' order by "column") || '. Downstream reports and joins may break.' as detail, 'high' as priority
    from {CHANGES} where kind = 'removed' having count(*) > 0
  union all (select 'Column ''' || "column" || ''' changed type', 'Was ' || before || ', now ' || after || ' — check the upstream export.', 'high' from {CHANGES} where kind = 'role_change' order by "column" limit 1)""")(
    lambda s, d: I.drift_advice(D.changes(before(s, d), now(s, d))).select("title", "detail", "priority"))


@check("findings_drivers", """select 'Main driver of ''p_retailprice'' is ''p_partkey''' as title from (select corr(p_partkey, p_retailprice) as r from part) where r > 0""")
def _(s, d):
    df = table(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    fitted_roles = {"p_partkey": "numeric", "p_brand": "categorical", "p_type": "categorical", "p_size": "numeric", "p_retailprice": "numeric"}
    from ..operators.drivers import fit_tree
    fit = fit_tree(df, fitted_roles, "p_retailprice", "numeric")
    targets = s.createDataFrame([(0, "p_retailprice", *fit["metric"])], "position int, target string, fit_name string, fit_value double")
    drivers = s.createDataFrame([(0, i, f, v) for i, (f, v) in enumerate(fit["drivers"])], "position int, place int, feature string, importance double")
    return I.about_drivers(targets, drivers).select("title")


_HITS = f"case when o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') then 1.0 when o_orderstatus = 'O' and o_orderpriority = '5-LOW' then 0.9 else 0.2 end"
check("findings_segments", f"""select 'Segment ''' || "column" || ' = ' || value || ''' stands out on ''hit''' as title,
    printf('%+.0f', round_even(lift_pct, 0)) || '% vs. the overall average (n=' || n || '). Worth a targeted deep-dive.' as detail
  from ({segment_sql(_HITS, ["o_orderstatus", "o_orderpriority", "c_mktsegment"])}) where abs(lift_pct) >= 25 order by place limit 1""")(
    lambda s, d: I.segment_advice(segments(flat(s, d).withColumn("hit", F.expr(_HITS).cast("double")), {**ROLES, "hit": "numeric"}, "hit", "numeric").select(
        F.lit(0).alias("position"), F.lit("hit").alias("target"), "place", "column", "value", "lift_pct", "n")).select("title", "detail"))
check("findings_quality", f"""with o as (select sum(score * weight::double) as t from {SCORES}),
  i as (select detail, place from (select key, score, row_number() over (order by score, position) as place from {SCORES}) s join {DETAILS} d using (key) where place <= 2 and score < 90)
  select case when round_even(t, 1) < 60 then 'critical' when round_even(t, 1) < 80 then 'warning' else 'info' end as severity,
    'Data quality score: ' || round_even(t, 1) || '/100 (grade ' || case when t >= 90 then 'A' when t >= 80 then 'B' when t >= 70 then 'C' when t >= 60 then 'D' when t >= 50 then 'E' else 'F' end || ')' as title,
    coalesce((select string_agg(detail, '; ' order by place) from i), 'All quality dimensions are strong.') as evidence from o""")(
    lambda s, d: _quality_finding(s, d).select("severity", "title", "evidence"))


def _quality_finding(s, d):
    scores, columns, tab, iqr = _scores(s, d)
    scores = settle(scores)
    return I.about_quality(Q.overall(scores), Q.issues(scores, Q.issue_details(columns, tab, iqr)))


check("findings_default", "select 15 as rule, 'info' as severity, 'No material data-quality issues detected' as title from orders having count(*) > 0")(
    lambda s, d: _default(s, d).select("rule", "severity", "title"))


def _default(s, d):
    counters = P.profile_table(table(s, d, "orders"))
    return I.with_default(I.about_table(counters), counters)


def _some_findings(s, d):
    counters = P.profile_table(gaps(s, d))
    return counters, I.about_table(counters).unionByName(I.about_shape(shaped_summary(s, d)))


_SEV = "case when missing_cell_pct > 20 then 'critical' when missing_cell_pct > 5 then 'warning' else 'info' end"
_SOME = f"""(select 1 as rule, 0 as pos, {_SEV} as severity, missing_cell_pct || '% of cells are missing' as title from ({GAP_COUNTERS}) where missing_cell_pct > 0
  union all select 3, 0, case when duplicate_rows / row_count > 0.01 then 'warning' else 'info' end, duplicate_rows || ' duplicate rows detected' from ({GAP_COUNTERS}) where duplicate_rows > 0
  union all select 4, ordinal * 2, 'info', '''' || "column" || ''' is ' || case when skew > 0 then 'right' else 'left' end || '-skewed' from ({_SHAPE}) where abs(skew) >= 1
  union all select 4, ordinal * 2 + 1, 'info', '''' || "column" || ''' has very high relative variability' from ({_SHAPE}) where cv > 1.5)"""
check("findings_ordered", f"""select title, severity, row_number() over (order by case severity when 'critical' then 0 when 'warning' then 1 else 2 end, rule, pos)::bigint as place from {_SOME}""")(
    lambda s, d: _ordered(s, d))


def _ordered(s, d):
    from pyspark.sql import Window as W
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    # as many rows as rules fired
    return I.order_findings(_some_findings(s, d)[1]).select("title", "severity", F.row_number().over(W.orderBy(rank, "rule", "pos")).cast("bigint").alias("place"))


check("findings_counts", f"select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'info') as info from {_SOME}")(
    lambda s, d: I.severity_counts(_some_findings(s, d)[1]))
check("findings_headline", f"""with n as (select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning from {_SOME})
  select format('{{:,}}', row_count) || ' rows × ' || col_count || ' columns (' || missing_cell_pct || '% missing).' || case when critical > 0 then ' ' || critical || ' critical issue(s) to fix before analysis.'
    when warning > 0 then ' ' || warning || ' warning(s) to review.' else ' Dataset looks healthy and ready for analysis.' end as headline from ({GAP_COUNTERS}), n""")(
    lambda s, d: I.headline(*_some_findings(s, d)))
check("general_format", "select event_id, format('{:.3g}', value * 1000 / (user_id + 1)) as a, format('{:.3g}', value / 77777) as b from events")(
    lambda s, d: table(s, d, "events").select("event_id", general3(F.col("value") * 1000 / (F.col("user_id") + 1)).alias("a"), general3(F.col("value") / 77777).alias("b")))

# --- report tables
check("report_quality_table", f"""select 'dimension' as section, position::bigint as position, label as item, round_even(score, 1)::varchar as value, weight::double::varchar as detail from {SCORES}""")(
    lambda s, d: _quality_report(s, d).where("section = 'dimension'"))


def _quality_report(s, d):
    facts, roles, tab, iqr = parts(s, d)
    return report.quality_table({f"quality_{k}": v for k, v in Q.scorecard(facts, roles, tab, iqr).items()})


check("report_drift_table", f"""select 'change' as section, case kind when 'added' then 0 when 'removed' then 1 when 'role_change' then 2 else 3 end::bigint as position, "column" as value from {CHANGES}
  union all select 'change', 4, '' from orders having count(*) > 0""")(
    lambda s, d: _drift_report(s, d).where("section = 'change'").select("section", "position", "value"))


def _drift_report(s, d):
    p, c = before(s, d), now(s, d)
    moved = D.compare(p, c)
    return report.drift_table({"drift": moved, "drift_table": D.change_table(moved, D.changes(p, c))})


check("report_profile_table", f"select ordinal, name, role, dtype, non_null, null_pct, \"unique\" from ({profile_sql('customer')})")(
    lambda s, d: report.profile_sheet(P.profile_of(R.infer_and_clean(table(s, d, "customer")))))
check("report_correlation_table", matrix_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))(
    lambda s, d: S.correlation_matrix(table(s, d, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"]))
check("report_raw_extract", "select event_id, user_id, event_type, value from events order by event_id limit 5000")(
    lambda s, d: report.raw_extract(keyed(s, d, "events", "event_id").select("event_id", "user_id", "event_type", "value", "_row_id")).drop("_row_id"))


_RELATED = {"o_custkey": "numeric", "o_totalprice": "numeric", "o_orderstatus": "categorical", "o_orderpriority": "categorical"}
check("report_relationship_table", f"select \"left\", \"right\", kind, method, strength, label from ({discover_sql('orders', ['o_custkey', 'o_totalprice'], ['o_orderstatus', 'o_orderpriority'])})")(
    lambda s, d: A.discover(keyed(s, d, "orders", "o_orderkey"), _RELATED).select("left", "right", "kind", "method", "strength", "label"))
check("report_summary_table", summary_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))(
    lambda s, d: rounded(S.numeric_summary(table(s, d, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"]).drop("is_normal"), 4))
check("report_chart_table", f"""select 'histogram' as section, bin::bigint as position, "column" as item, centre::varchar as value, count::varchar as detail from ({bins_sql('events', ['user_id', 'value'])})
  union all (select 'scatter', 0, 'point', value::varchar, round(twin, 6)::varchar from {SHAPED} order by event_id limit 500)""")(
    lambda s, d: report.chart_table({"histogram": H.histogram(table(s, d, "events"), ["user_id", "value"]), "scatter": rounded(H.scatter(shaped(s, d), "value", "twin"))}))
check("report_insight_table", f"""select 'finding' as section, rule::bigint as position, severity as item, title as value from {_SOME}
  union all select 'recommendation', 3, 'medium', 'De-duplicate the dataset' from ({GAP_COUNTERS}) where duplicate_rows > 0""")(
    lambda s, d: _insights(s, d))


def _insights(s, d):
    counters, found = _some_findings(s, d)
    tables = {"headline": I.headline(counters, found), "findings": found, "recommendations": I.duplicate_advice(counters)}
    return report.insight_table(tables).where("section <> 'headline'").select("section", "position", "item", "value")


@check("report_outlier_table")
def _(s, d):
    events = keyed(s, d, "events", "event_id")
    used, scores = O.anomaly_scores(events, ["user_id", "value"])
    flags = O.flag_anomalies(scores)
    forest = flags.agg(F.count(F.when(F.col("flagged"), 1)).alias("flagged_count"))
    return report.outlier_table({"iqr_outliers": O.iqr_outliers(events, used), "forest": forest, "flagged_rows": O.flagged_rows(flags)})


@check("report_driver_table")
def _(s, d):
    from ..operators.drivers import analyse_drivers
    df, part_roles = table(s, d, "part").drop("p_name"), {"p_partkey": "numeric", "p_brand": "categorical", "p_type": "categorical", "p_size": "numeric", "p_retailprice": "numeric"}
    return report.driver_table({f"driver_{k}": v for k, v in analyse_drivers(df, part_roles, P.profile_columns(df, part_roles)).items()})


def _analysis(s, d):
    return workflow.analyze(keyed(s, d, "customer", "c_custkey"))


check("report_executive")(lambda s, d: report.executive(_analysis(s, d)))
check("report_manifest")(lambda s, d: report.write(report.build(_analysis(s, d)), scratch_path(s, "report"), "check").select("position", "table", "rows"))
check("analyze_events_findings")(lambda s, d: workflow.analyze(keyed(s, d, "events", "event_id"))["findings"])
