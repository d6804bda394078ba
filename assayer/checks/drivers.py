"""Driver analysis."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drivers as D
from ..operators import profile as P
from ..operators import roles as R
from . import check, rounded, table

# orders joined to customers and their nations
FLAT = """(select o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderdate, c_acctbal, c_mktsegment, n_regionkey
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
ROLES = {"o_orderkey": "numeric", "o_totalprice": "numeric", "o_orderstatus": "categorical", "o_orderpriority": "categorical",
         "o_orderdate": "datetime", "c_acctbal": "numeric", "c_mktsegment": "categorical", "n_regionkey": "numeric"}


def flat(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    # nation has 25 rows at every scale
    n = F.broadcast(table(s, d, "nation"))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(*ROLES))


def _score_sql(c: str, kind: str) -> str:
    hint = 2.0 if any(h in c.lower() for h in D.TARGET_HINTS) else 0.0
    if kind == "numeric":
        return (f"select '{c}' as column, 'numeric' as kind, {hint} + least(stddev_pop({c}) / (abs(avg({c})) + 1e-9), 3) as score from {FLAT} "
                f"having count(distinct {c}) >= 5 and stddev_pop({c}) > 0")
    return f"select '{c}' as column, 'categorical' as kind, ({hint} + 0.6)::double as score from {FLAT} having count(distinct {c}) between 2 and 6"


TARGETS = " union all ".join(f"select {i} as ordinal, * from ({_score_sql(c, r)})" for i, (c, r) in enumerate(ROLES.items()) if r != "datetime")
check("driver_targets", f"select ordinal, \"column\", kind, round(score, 6) as score from ({TARGETS}) order by score desc, ordinal limit 2")(
    lambda s, d: rounded(D.rank_targets(P.profile_columns(flat(s, d), ROLES))))
check("driver_top_values", f"""select "column", value, n, place::int as place from (select *, row_number() over (partition by "column" order by n desc, value) as place from
  (select 'o_orderpriority' as column, o_orderpriority as value, count(*) as n from {FLAT} group by 2 union all select 'c_mktsegment', c_mktsegment, count(*) from {FLAT} group by 2)) where place <= 8""")(
    lambda s, d: D.top_values(flat(s, d), ["o_orderpriority", "c_mktsegment"]))


def segment_sql(y: str, cols: list[str]) -> str:
    groups = " union all ".join(f"select {i} as i, '{c}' as column, {c}::varchar as value, avg({y}) as mean, count({y}) as n from {FLAT} where {c} is not null group by 3"
                                for i, c in enumerate(cols))
    return f"""with g as ({groups}), w as (select avg({y}) as overall, greatest(20, floor(0.01 * count(*))) as least_rows from {FLAT}),
      l as (select i, "column", value, round_even(mean, 3) as metric, round_even(100 * (mean - overall) / overall, 1) as lift_pct, n from g, w where n >= least_rows)
      select (row_number() over (order by abs(lift_pct) desc, i, value) - 1)::int as place, "column", value, metric, lift_pct + 0 as lift_pct, n from l
      order by abs(lift_pct) desc, i, value limit 10"""


check("segment_lift_orders", segment_sql("o_totalprice", ["o_orderstatus", "o_orderpriority", "c_mktsegment"]))(
    lambda s, d: D.segments(flat(s, d), ROLES, "o_totalprice", "numeric"))
check("segment_lift_class", segment_sql(
    f"case when o_orderstatus = (select o_orderstatus from {FLAT} group by 1 order by count(*) desc, 1 limit 1) then 1.0 else 0.0 end", ["o_orderpriority", "c_mktsegment"]))(
    lambda s, d: D.segments(flat(s, d), ROLES, "o_orderstatus", "categorical"))
LABELLED = "(select d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 as quality, l.toxic = 1 as toxic from documents d join labels l using (doc_id))"


def labelled(s, d):
    return (table(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(s, d, "labels"), "doc_id")
            .select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic")))


LABEL_ROLES = {"lang": "categorical", "source": "categorical", "n_chars": "numeric", "quality": "boolean", "toxic": "boolean"}
check("segment_lift_documents", segment_sql(
    f"case when quality = (select quality from {LABELLED} group by 1 order by count(*) desc, 1 limit 1) then 1.0 else 0.0 end", ["lang", "source", "initcap_toxic"])
      .replace("initcap_toxic::varchar", "case when toxic then 'True' else 'False' end").replace("initcap_toxic is not null", "true").replace("initcap_toxic", "toxic").replace(FLAT, LABELLED))(
    lambda s, d: D.segments(labelled(s, d), LABEL_ROLES, "quality", "boolean"))


@check("driver_features", f"""select o_orderkey, c_acctbal, epoch_us(o_orderdate) * 1000.0::double as moment, (o_orderstatus = 'F')::int::double as status_f,
  (c_mktsegment = 'BUILDING')::int::double as building from {FLAT}""")
def _(s, d):
    df = flat(s, d)
    names, exprs = D.features(df, ROLES, "o_totalprice")
    by = dict(zip(names, exprs))
    return df.select("o_orderkey", by["c_acctbal"].alias("c_acctbal"), by["o_orderdate (as timestamp)"].alias("moment"),
                     by["o_orderstatus_F"].alias("status_f"), by["c_mktsegment_BUILDING"].alias("building"))


# part prices depend on the key, so a tree finds it
PART_ROLES = {"p_partkey": "numeric", "p_brand": "categorical", "p_type": "categorical", "p_size": "numeric", "p_retailprice": "numeric"}


def _analysis(s, d, name):
    df = table(s, d, "part").select(*PART_ROLES)
    return D.analyse_drivers(df, PART_ROLES, P.profile_columns(df, PART_ROLES))[name]


check("driver_tree_regression")(lambda s, d: _tree(s, d, table(s, d, "part").select(*PART_ROLES), PART_ROLES, "p_retailprice", "numeric"))
check("driver_tree_classes")(lambda s, d: _tree(s, d, labelled(s, d), LABEL_ROLES, "quality", "boolean"))


def _tree(s, d, df, roles, target, kind):
    fitted = D.fit_tree(df, roles, target, kind)
    rows = [("fit", fitted["metric"][0], float(fitted["metric"][1]), fitted["rows"])]
    rows += [("driver", f, float(v), None) for f, v in fitted["drivers"]]
    rows += [("rule", r[0], float(r[2] if r[2] is not None else r[3]), r[4]) for r in fitted["rules"]]
    return s.createDataFrame(rows, "part string, name string, value double, support bigint")


check("driver_importances")(lambda s, d: _analysis(s, d, "drivers"))
check("driver_rules")(lambda s, d: _analysis(s, d, "rules"))


@check("driver_no_target", f"select '{D.NO_TARGET}' as note from (select count(*) as n from region) where n > 0")
def _(s, d):
    df = table(s, d, "benchmark")
    known = R.infer_and_clean(df)
    return D.analyse_drivers(known.clean, known.roles, P.profile_of(known))["note"]
