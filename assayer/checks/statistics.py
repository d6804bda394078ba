"""Numeric summaries, correlation and charts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from . import check, rounded, table
from .verbs import GAPPY, _gappy

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def summary_sql(source: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as column, count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c})::double as min, "
        f"round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as median, round(quantile_cont({c}, 0.75), 4) as p75, "
        f"max({c})::double as max, round(skewness({c}), 4) + 0 as skew, round(kurtosis({c}), 4) + 0 as kurtosis, "
        f"round(stddev_samp({c}) / avg({c}), 4) as cv from {source} having count({c}) >= 3" for c in cols)


def pairs_sql(source: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select {i} as i, {j} as j, '{cols[i]}' as a, '{cols[j]}' as b, corr({cols[i]}, {cols[j]}) as r from {source}"
        for i in range(len(cols)) for j in range(i + 1, len(cols)))


check("numeric_summary_lineitem", summary_sql("lineitem", LINE))(
    lambda s, d: rounded(S.numeric_summary(table(s, d, "lineitem"), LINE).drop("is_normal"), 4))
check("numeric_summary_events", summary_sql(GAPPY, ["user_id", "value"]))(
    lambda s, d: rounded(S.numeric_summary(_gappy(s, d), ["user_id", "value"]).drop("is_normal"), 4))


@check("numeric_summary_constant", """select 'constant' as column, count(*) as count, 4.0 as mean, 0.0 as std, null::double as skew, null::double as kurtosis, 0.0 as cv
  from orders union all select 'half', count(*), round(avg(o_orderkey % 2), 6), round(stddev_samp(o_orderkey % 2), 6), round(skewness(o_orderkey % 2), 6) + 0,
  round(kurtosis(o_orderkey % 2), 6), round(stddev_samp(o_orderkey % 2) / avg(o_orderkey % 2), 6) from orders""")
def _(s, d):
    df = table(s, d, "orders").select(F.lit(4.0).alias("constant"), (F.col("o_orderkey") % 2).alias("half"))
    return rounded(S.numeric_summary(df, ["constant", "half"]).select("column", "count", "mean", "std", "skew", "kurtosis", "cv"))


check("capped_sample_lineitem", "select 'l_quantity' as column, 5000::bigint as n where (select count(*) from lineitem) >= 5000")(
    lambda s, d: S.capped_sample(table(s, d, "lineitem", row_id=True), ["l_quantity"], {"l_quantity": table(s, d, "lineitem").count()})
    .groupBy("column").agg(F.count("*").alias("n")))


@check("normality")
def _(s, d):
    return S.normality_verdict(table(s, d, "lineitem", row_id=True), LINE)


check("corr_pairs_lineitem", f"select i, j, a, b, round(r, 6) + 0 as r, round(abs(r), 6) as abs_r from ({pairs_sql('lineitem', LINE)}) "
      "where r is not null and not isnan(r) order by abs(r) desc, i, j limit 15")(
    lambda s, d: rounded(S.top_pairs(S.correlation_pairs(table(s, d, "lineitem"), LINE))))
check("corr_pairs_with_gaps", f"select i, j, a, b, round(r, 6) + 0 as r from ({pairs_sql(GAPPY, ['event_id', 'user_id', 'value'])})")(
    lambda s, d: rounded(S.correlation_pairs(_gappy(s, d), ["event_id", "user_id", "value"]).select("i", "j", "a", "b", "r")))


#: Columns whose pairs are too many for one written-out aggregate; all but the first eight have gaps, in six patterns.
WIDE = {**{c: c for c in LINE}, **{f"{c}_{k}": f"case when (l_orderkey + l_linenumber) % {g} > 0 then floor({c}) % {k} end"
                                  for k, g in ((7, 4), (13, 3)) for c in LINE if c != "l_discount" and c != "l_tax"},
        "late": "case when (l_orderkey + l_linenumber) % 4 > 0 then datediff('day', date '1992-01-01', cast(l_shipdate as date)) end"}
_WIDE_SQL = "(select " + ", ".join(f"{e} as {c}" for c, e in WIDE.items()) + " from lineitem)"


def _wide(s, d, **more):
    df = table(s, d, "lineitem", **more)
    return df.select(*[F.expr(e.replace("datediff('day', date '1992-01-01', cast(l_shipdate as date))", "datediff(cast(l_shipdate as date), date '1992-01-01')")).alias(c)
                       for c, e in WIDE.items()], *(["_row_id"] if more else []))


check("corr_pairs_wide", f"with w as materialized (select * from {_WIDE_SQL}) select i, j, a, b, round(r, 6) + 0 as r from ({pairs_sql('w', list(WIDE))})")(
    lambda s, d: rounded(S.correlation_pairs(_wide(s, d), list(WIDE)).select("i", "j", "a", "b", "r")))


def matrix_sql(source: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select '{a}' as column, " + ", ".join(
            "1.0 as " + b if a == b else f"round(coalesce(case when isnan(corr({a}, {b})) then 0 else corr({a}, {b}) end, 0), 4) + 0 as {b}" for b in cols)
        + f" from {source}" for a in cols)


check("corr_matrix_lineitem", matrix_sql("lineitem", LINE))(lambda s, d: rounded(S.correlation_matrix(table(s, d, "lineitem"), LINE), 4))
check("corr_matrix_constant", "select 'flat' as column, 0.0 as flat, 0.0 as value from events having count(*) > 0 union all "
      "select 'value', 0.0, 1.0 from events having count(*) > 0")(
    lambda s, d: S.correlation_matrix(table(s, d, "events").select(F.lit(0.1).alias("flat"), "value"), ["flat", "value"]))
