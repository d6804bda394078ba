"""Dataframe verbs on orders, events and part."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import verbs as V
from . import check, rounded, table

# events with gaps, used wherever null handling matters
GAPPY = """(select event_id, ts, user_id, event_type,
  case when event_id % 7 = 0 then null else value end as value,
  case when event_id % 11 = 0 then null else event_type end as kind from events)"""


def _orders(s, d):
    return table(s, d, "orders")


def _events(s, d):
    return table(s, d, "events")


def _part(s, d):
    return table(s, d, "part")


def _gappy(s, d):
    e = _events(s, d)
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
                    F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("kind"))


# --- projection and filters
check("v_select", "select o_orderkey, o_totalprice from orders")(
    lambda s, d: V.select(_orders(s, d), ["o_orderkey", "o_totalprice"]))
check("v_filter_mask", "select o_orderkey, o_totalprice from orders where o_totalprice > 400000")(
    lambda s, d: V.where(V.select(_orders(s, d), ["o_orderkey", "o_totalprice"]), F.col("o_totalprice") > 400000))
check("v_query_text", "select o_orderkey from orders where o_totalprice > 300000 and o_orderstatus = 'F'")(
    lambda s, d: V.select(V.query(_orders(s, d), "o_totalprice > 300000 and o_orderstatus = 'F'"), ["o_orderkey"]))


@check("v_compare", f"""select event_id, coalesce(value = 10, false) as eq, coalesce(value <> 10, true) as ne,
  coalesce(value < 10, false) as lt, coalesce(value <= 10, false) as le, coalesce(value > 10, false) as gt,
  coalesce(value >= 10, false) as ge, kind <> 'click' as text_ne from {GAPPY}""")
def _(s, d):
    e = _gappy(s, d)
    return e.select("event_id", *[V.compare(e, "value", op, 10.0).alias(op) for op in ("eq", "ne", "lt", "le", "gt", "ge")],
                    V.compare(e, "kind", "ne", "click").alias("text_ne"))


check("v_between", f"select event_id, value from {GAPPY} where value between 10 and 20")(
    lambda s, d: V.where(_gappy(s, d).select("event_id", "value"), V.between(F.col("value"), 10, 20)))
check("v_isin", f"select event_id, kind from {GAPPY} where kind in ('click', 'view')")(
    lambda s, d: V.where(_gappy(s, d).select("event_id", "kind"), V.isin(F.col("kind"), ["click", "view"])))
check("v_isin_long_list", "select o_orderkey, o_custkey from orders where o_custkey in "
      "(select c_custkey from customer where c_mktsegment = 'BUILDING')")(
    lambda s, d: V.keep_listed(_orders(s, d).select("o_orderkey", "o_custkey"), "o_custkey",
                               table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")))


@check("v_isna_notna", f"select event_id, value is null as isna, value is not null as notna from {GAPPY}")
def _(s, d):
    e = _gappy(s, d)
    return e.select("event_id", V.isna(e, "value").alias("isna"), V.notna(e, "value").alias("notna"))


@check("v_logic", f"""select event_id, coalesce(not (value > 10), true) as inverted,
  coalesce(value > 10 and kind = 'click', false) as both, coalesce(value > 10, false) or coalesce(kind = 'click', false) as either,
  case when value > 10 then 'high' else 'low' end as picked, coalesce(kind not in ('click', 'view'), true) as not_in from {GAPPY}""")
def _(s, d):
    e = _gappy(s, d)
    high, click = V.compare(e, "value", "gt", 10.0), F.coalesce(V.compare(e, "kind", "eq", "click"), F.lit(False))
    return e.select("event_id", (~high).alias("inverted"), (high & click).alias("both"), (high | click).alias("either"),
                    F.when(high, "high").otherwise("low").alias("picked"),
                    (~V.mask(V.isin(F.col("kind"), ["click", "view"]))).alias("not_in"))


@check("v_arithmetic", f"""select event_id, round(value + user_id, 4) as added, round(value - user_id, 4) + 0 as subtracted, round(value * user_id, 4) as multiplied,
  round(case when user_id = 0 then case when value > 0 then 'inf'::double when value = 0 then 'nan'::double end else value / user_id end, 9) as divided,
  case when user_id = 0 then case when value > 0 then 'inf'::double when value = 0 then 'nan'::double end else floor(value / user_id) end as floored,
  round((event_id % 7 - 3) - floor((event_id % 7 - 3) / 4.0) * 4, 6)::double as remainder, round(power(value, 2), 4) as squared, -value as negated
  from {GAPPY}""")
def _(s, d):
    v, u = F.col("value"), F.col("user_id")
    return rounded(_gappy(s, d).select(
        "event_id", F.round(v + u, 4).alias("added"), F.round(v - u, 4).alias("subtracted"), F.round(v * u, 4).alias("multiplied"),
        N.divide(v, u).alias("divided"), N.floor_divide(v, u).alias("floored"),
        N.modulo(F.col("event_id") % 7 - 3, F.lit(4)).alias("remainder"),
        F.round(N.power(v, F.lit(2)), 4).alias("squared"), (-v).alias("negated")), 9)


check("v_astype", "select cast(o_orderkey as varchar) as o_orderkey, cast(o_totalprice as bigint) as price_up from "
      "(select o_orderkey, floor(o_totalprice) as o_totalprice from orders)")(
    lambda s, d: V.rename(V.astype(_orders(s, d).select("o_orderkey", F.floor("o_totalprice").alias("o_totalprice")),
                                   {"o_orderkey": "string", "o_totalprice": "bigint"}), {"o_totalprice": "price_up"}))
check("v_rename", "select o_orderkey as order_id, o_totalprice as price from orders")(
    lambda s, d: V.rename(_orders(s, d).select("o_orderkey", "o_totalprice"), {"o_orderkey": "order_id", "o_totalprice": "price"}))
check("v_add_prefix", "select r_regionkey as x_r_regionkey, r_name as x_r_name from region")(
    lambda s, d: V.add_prefix(table(s, d, "region"), "x_"))
check("v_add_suffix", "select r_regionkey as r_regionkey_y, r_name as r_name_y from region")(
    lambda s, d: V.add_suffix(table(s, d, "region"), "_y"))
check("v_fillna", f"select event_id, coalesce(value, 0.0) as value, coalesce(kind, 'none') as kind from {GAPPY}")(
    lambda s, d: V.fillna(_gappy(s, d).select("event_id", "value", "kind"), {"value": 0.0, "kind": "none"}))
check("v_dropna", f"select event_id, value, kind from {GAPPY} where value is not null and kind is not null")(
    lambda s, d: V.dropna(_gappy(s, d).select("event_id", "value", "kind"), "any"))
check("v_dropna_all", f"select event_id, value, kind from {GAPPY} where value is not null or kind is not null")(
    lambda s, d: V.dropna(_gappy(s, d).select("event_id", "value", "kind"), "all", ["value", "kind"]))
check("v_clip", f"select event_id, case when value < 5 then 5.0 when value > 100 then 100.0 else value end as value from {GAPPY}")(
    lambda s, d: _gappy(s, d).select("event_id", N.clip(F.col("value"), 5.0, 100.0).alias("value")))
check("v_loc", "select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT'")(
    lambda s, d: V.loc(_orders(s, d), F.col("o_orderpriority") == "1-URGENT", ["o_orderkey", "o_totalprice"]))
check("v_iloc", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 30 offset 100")(
    lambda s, d: V.iloc(_orders(s, d).select("o_orderkey", "o_totalprice"), 100, 130, ["o_orderkey"]))
check("v_iloc_deep", "select o_orderkey, o_orderpriority from orders order by o_orderpriority, o_orderkey limit 3000 offset 9000")(
    lambda s, d: V.iloc(_orders(s, d).select("o_orderkey", "o_orderpriority"), 9_000, 12_000, ["o_orderpriority", "o_orderkey"], rows_per_slice=1_000))
check("v_rank_in_slices", "select page_id, (rank() over (order by url) + (count(*) over (partition by url) - 1) / 2.0)::double as place from pages")(
    lambda s, d: V.rank(table(s, d, "pages").select("page_id", "url"), "url", out="place", rows_per_slice=50).drop("url"))
check("v_cumsum_in_slices", "select o_orderkey, o_orderpriority, sum(o_custkey) over (partition by o_orderpriority order by o_orderdate, o_orderkey)::bigint as total from orders")(
    lambda s, d: V.cumsum(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"],
                          ["o_orderpriority"], "total", rows_per_slice=1_000).select("o_orderkey", "o_orderpriority", "total"))
check("v_sample_rows")(lambda s, d: V.sample(_events(s, d), "event_id", n=500, seed=3))
check("v_sample_fraction")(lambda s, d: V.sample(_events(s, d), "event_id", frac=0.1, seed=3))
check("v_drop_duplicates", "select user_id, event_type, event_id, value from (select *, row_number() over "
      "(partition by user_id, event_type order by event_id) as rn from events) where rn = 1")(
    lambda s, d: V.drop_duplicates(_events(s, d).select("user_id", "event_type", "event_id", "value"),
                                   ["user_id", "event_type"], ["event_id"]))
check("v_drop_duplicates_rows", "select distinct p_brand, p_type from part")(
    lambda s, d: _part(s, d).select("p_brand", "p_type").dropDuplicates())
check("v_reindex", "select n.n_nationkey * 3 as c_custkey, c_name from nation n left join customer c on c.c_custkey = n.n_nationkey * 3")(
    lambda s, d: V.reindex(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey",
                           table(s, d, "nation").select((F.col("n_nationkey") * 3).alias("c_custkey"))))
check("v_columns")(lambda s, d: V.columns(_orders(s, d)))
check("v_dtypes")(lambda s, d: V.dtypes(_orders(s, d)))
check("v_shape", "select count(*) as rows, 6::bigint as columns from orders")(lambda s, d: V.shape(_orders(s, d)))
check("v_empty", "select count(*) = 0 as empty from orders where o_totalprice < 0")(
    lambda s, d: V.empty(V.where(_orders(s, d), F.col("o_totalprice") < 0)))


@check("v_transpose", """select 'n' as key, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O",
  count(*) filter (o_orderstatus = 'P') as "P" from orders""")
def _(s, d):
    counts = V.aggregate(_orders(s, d), ["o_orderstatus"], {"n": ("o_orderkey", "count")})
    return V.transpose(counts, "o_orderstatus")


# --- aggregation
@check("v_groupby_agg", f"""select kind, count(value) as n, count(*) as size, round(avg(value), 6) as mean, round(coalesce(sum(value), 0), 4) as total,
  min(value) as low, max(value) as high from {GAPPY} where kind is not null group by kind""")
def _(s, d):
    out = V.aggregate(_gappy(s, d), ["kind"], {
        "n": ("value", "count"), "size": ("value", "size"), "mean": ("value", "mean"), "total": ("value", "sum"),
        "low": ("value", "min"), "high": ("value", "max")})
    return out.select("kind", "n", "size", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"), "low", "high")


check("v_agg_list", f"""select round(avg(value), 6) as value_mean, max(value) as value_max, count(distinct user_id) as user_id_nunique from {GAPPY}""")(
    lambda s, d: rounded(V.aggregate(_gappy(s, d), [], {"value_mean": ("value", "mean"), "value_max": ("value", "max"),
                                                         "user_id_nunique": ("user_id", "nunique")})))
_BY_ORDER = """arg_min(value, event_id) filter (value is not null) as value_first, arg_max(value, event_id) filter (value is not null) as value_last,
  first(event_id order by value desc, event_id) filter (value is not null) as value_idxmax, first(event_id order by value, event_id) filter (value is not null) as value_idxmin,
  round(sum(value), 4) as value_sum"""
check("v_agg_ordered", f"select kind, {_BY_ORDER} from {GAPPY} where kind is not null group by kind")(
    lambda s, d: rounded(V.agg(_gappy(s, d), ["kind"], {"value": ["first", "last", "idxmax", "idxmin", "sum"]}, "event_id"), 4))
check("v_agg_mapping", f"""with c as (select event_type, user_id, count(*) as n, min(event_id) as f from {GAPPY} group by 1, 2),
  m as (select event_type, first(user_id order by n desc, user_id) filter (user_id is not null) as user_id_mode, array_to_string(list(user_id order by f), ',') as user_id_unique from c group by 1)
  select g.event_type, round(quantile_cont(value, 0.5), 6) as value, user_id_mode, user_id_unique, count(distinct user_id) as user_id_nunique
  from {GAPPY} g join m using (event_type) group by all""")(
    lambda s, d: rounded(V.agg(_gappy(s, d), ["event_type"], {"value": "median", "user_id": ["mode", "unique", "nunique"]}, "event_id")
                         .withColumn("user_id_unique", F.array_join("user_id_unique", ","))))
check("v_agg_whole", f"select {_BY_ORDER}, (select kind from {GAPPY} where kind is not null group by kind order by count(*) desc, kind limit 1) as kind_mode from {GAPPY}")(
    lambda s, d: rounded(V.agg(_gappy(s, d), [], {"value": ["first", "last", "idxmax", "idxmin", "sum"], "kind": ["mode"]}, "event_id"), 4))
check("v_mean", f"select round(avg(value), 6) as mean from {GAPPY}")(
    lambda s, d: rounded(V.aggregate(_gappy(s, d), [], {"mean": ("value", "mean")})))
check("v_sum", "select round(sum(o_totalprice), 2) as total, round(coalesce(sum(case when o_totalprice < 0 then o_totalprice end), 0), 2) as nothing from orders")(
    lambda s, d: rounded(V.aggregate(_orders(s, d).withColumn("none", F.expr("case when o_totalprice < 0 then o_totalprice end")), [],
                                     {"total": ("o_totalprice", "sum"), "nothing": ("none", "sum")}), 2))
check("v_count", f"select count(value) as n from {GAPPY}")(lambda s, d: V.aggregate(_gappy(s, d), [], {"n": ("value", "count")}))
check("v_size", f"select kind, count(*) as size from {GAPPY} where kind is not null group by kind")(
    lambda s, d: V.aggregate(_gappy(s, d), ["kind"], {"size": ("event_id", "size")}))
check("v_median", f"select round(quantile_cont(value, 0.5), 6) as median from {GAPPY}")(
    lambda s, d: rounded(V.aggregate(_gappy(s, d), [], {"median": ("value", "median")})))
check("v_median_by_group", f"select kind, round(quantile_cont(value, 0.5), 6) as median, count(value) as n from {GAPPY} where kind is not null group by kind")(
    lambda s, d: rounded(V.aggregate(_gappy(s, d), ["kind"], {"median": ("value", "median"), "n": ("value", "count")})))
check("v_std", f"select kind, round(stddev_samp(value), 6) as std from {GAPPY} where kind is not null group by kind")(
    lambda s, d: rounded(V.aggregate(_gappy(s, d), ["kind"], {"std": ("value", "std")})))
check("v_var", f"select kind, round(var_samp(value), 4) as var from {GAPPY} where kind is not null group by kind")(
    lambda s, d: rounded(V.aggregate(_gappy(s, d), ["kind"], {"var": ("value", "var")}), 4))
check("v_min_max", "select o_orderpriority, min(o_totalprice) as low, max(o_orderdate) as latest from orders group by 1")(
    lambda s, d: V.aggregate(_orders(s, d), ["o_orderpriority"], {"low": ("o_totalprice", "min"), "latest": ("o_orderdate", "max")}))
check("v_quantile", "select round(quantile_cont(o_totalprice, 0.1), 6) as p10, round(quantile_cont(o_totalprice, 0.9), 6) as p90 from orders")(
    lambda s, d: rounded(V.aggregate(_orders(s, d), [], {"p10": ("o_totalprice", "quantile:0.1"), "p90": ("o_totalprice", "quantile:0.9")})))
check("v_quantile_by_group", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) as p25, round(quantile_cont(l_extendedprice, 0.9), 6) as p90, "
      "round(quantile_cont(l_quantity, 0.5), 6) as mid from lineitem group by 1")(
    lambda s, d: rounded(V.aggregate(table(s, d, "lineitem"), ["l_returnflag"], {
        "p25": ("l_extendedprice", "quantile:0.25"), "p90": ("l_extendedprice", "quantile:0.9"), "mid": ("l_quantity", "median")})))


@check("v_describe", """select statistic, round(case statistic when 'count' then a1 when 'mean' then a2 when 'std' then a3 when 'min' then a4
    when '25%' then a5 when '50%' then a6 when '75%' then a7 else a8 end, 4) as p_retailprice,
  round(case statistic when 'count' then b1 when 'mean' then b2 when 'std' then b3 when 'min' then b4
    when '25%' then b5 when '50%' then b6 when '75%' then b7 else b8 end, 4) as p_size
  from (select count(p_retailprice)::double a1, avg(p_retailprice) a2, stddev_samp(p_retailprice) a3, min(p_retailprice) a4, quantile_cont(p_retailprice, 0.25) a5,
    quantile_cont(p_retailprice, 0.5) a6, quantile_cont(p_retailprice, 0.75) a7, max(p_retailprice) a8,
    count(p_size)::double b1, avg(p_size) b2, stddev_samp(p_size) b3, min(p_size)::double b4, quantile_cont(p_size, 0.25) b5,
    quantile_cont(p_size, 0.5) b6, quantile_cont(p_size, 0.75) b7, max(p_size)::double b8 from part),
  (select unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) as statistic)""")
def _(s, d):
    return rounded(V.describe(_part(s, d), ["p_retailprice", "p_size"]), 4)


check("v_value_counts", f"select kind as value, count(*) as count from {GAPPY} where kind is not null group by 1")(
    lambda s, d: V.value_counts(_gappy(s, d), "kind"))
check("v_filter_value_counts", "select o_orderpriority as value, count(*) as count from orders where o_totalprice > 250000 group by 1")(
    lambda s, d: V.value_counts(V.where(_orders(s, d), F.col("o_totalprice") > 250000), "o_orderpriority"))
check("v_nunique", f"select count(distinct value) as value, count(distinct kind) as kind from {GAPPY}")(
    lambda s, d: V.aggregate(_gappy(s, d), [], {"value": ("value", "nunique"), "kind": ("kind", "nunique")}))
check("v_unique", f"select kind as value, min(event_id) as first_seen from {GAPPY} group by kind")(
    lambda s, d: V.unique(_gappy(s, d), "kind", "event_id"))
check("v_mode", "with c as (select p_size as mode, count(*) as n from part group by 1) select mode from c where n = (select max(n) from c)")(
    lambda s, d: V.mode(_part(s, d), "p_size"))
check("v_first_last", f"select event_type, arg_min(value, event_id) filter (value is not null) as first, arg_max(value, event_id) filter (value is not null) as last "
      f"from {GAPPY} group by event_type")(
    lambda s, d: V.group_first_last(_gappy(s, d), ["event_type"], "value", "event_id"))
check("v_idxmax_idxmin", "select event_type, first(event_id order by value desc, event_id) as idxmax, first(event_id order by value, event_id) as idxmin "
      "from events group by event_type")(
    lambda s, d: V.index_of_extreme(_events(s, d), "value", "event_id", ["event_type"]))
check("v_any_all", f"select event_type, bool_or(value > 300) as any, bool_and(value > 0) as all from {GAPPY} group by 1")(
    lambda s, d: V.aggregate(_gappy(s, d).withColumn("a", F.col("value") > 300).withColumn("b", F.col("value") > 0), ["event_type"],
                             {"any": ("a", "any"), "all": ("b", "all")}))
check("v_corr", "select 'l_quantity' as column, 1.0::double as l_quantity, round(corr(l_quantity, l_extendedprice), 6) + 0 as l_extendedprice from lineitem "
      "union all select 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) + 0, 1.0 from lineitem")(
    lambda s, d: rounded(V.corr(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], decimals=None)))
check("v_cov", f"""select 'value' as column, round(var_samp(value), 3) as value, round(covar_samp(value, user_id), 3) + 0 as user_id from {GAPPY}
  union all select 'user_id', round(covar_samp(value, user_id), 3) + 0, round(var_samp(user_id), 3) from {GAPPY}""")(
    lambda s, d: rounded(V.cov(_gappy(s, d), ["value", "user_id"]), 3))

# --- window-like
check("v_rank", f"""select event_id, case when value is not null then rank() over (order by value nulls last) + (count(*) over (partition by value) - 1) / 2.0 end::double as rank
  from {GAPPY}""")(lambda s, d: V.rank(_gappy(s, d), "value").select("event_id", F.col("rank").cast("double")))
check("v_rank_by_group", f"""select event_id, case when value is not null then rank() over (partition by event_type order by value nulls last)
  + (count(*) over (partition by event_type, value) - 1) / 2.0 end::double as rank from {GAPPY}""")(
    lambda s, d: V.rank(_gappy(s, d), "value", ["event_type"]).select("event_id", F.col("rank").cast("double")))
check("v_cumsum", f"select event_id, case when value is not null then round(sum(value) over (order by event_id), 4) end as cumsum from {GAPPY}")(
    lambda s, d: rounded(V.cumsum(_gappy(s, d), "value", ["event_id"]).select("event_id", "cumsum"), 4))
check("v_cumsum_by_group", "select o_orderkey, round(sum(o_totalprice) over (partition by o_orderstatus order by o_orderkey), 2) as cumsum from orders")(
    lambda s, d: rounded(V.cumsum(_orders(s, d), "o_totalprice", ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "cumsum"), 2))
check("v_cumcount", "select event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as cumcount from events")(
    lambda s, d: V.cumcount(_events(s, d), ["ts", "event_id"], ["event_type"]).select("event_id", "cumcount"))
check("v_diff", f"select event_id, round(value - lag(value) over (order by event_id), 6) + 0 as diff from {GAPPY}")(
    lambda s, d: rounded(V.diff(_gappy(s, d), "value", ["event_id"]).select("event_id", "diff")))
check("v_diff_by_group", "select event_id, round(value - lag(value, 2) over (partition by user_id order by event_id), 6) + 0 as diff from events")(
    lambda s, d: rounded(V.diff(_events(s, d), "value", ["event_id"], ["user_id"], 2).select("event_id", "diff")))
# gaps filled with the last present value of the group; rows without a group key belong to none
_FILLED = f"""(select *, last_value(value ignore nulls) over (partition by kind order by event_id rows unbounded preceding) as filled from {GAPPY})"""
_PCT = f"select event_id, case when kind is not null then round(filled / lag(filled) over (partition by kind order by event_id) - 1, 6) + 0 end as pct_change from {_FILLED}"
_CUM = f"select event_id, case when kind is not null and value is not null then round(sum(value) over (partition by kind order by event_id), 4) end as cumsum from {GAPPY}"
_COUNT = f"select event_id, case when kind is not null then row_number() over (partition by kind order by ts, event_id) - 1 end as cumcount from {GAPPY}"
_DIFF = f"select event_id, case when kind is not null then round(value - lag(value) over (partition by kind order by event_id), 6) + 0 end as diff from {GAPPY}"
_RANK = f"""select event_id, case when value is not null and kind is not null then rank() over (partition by kind order by value nulls last)
  + (count(*) over (partition by kind, value) - 1) / 2.0 end::double as rank from {GAPPY}"""
check("v_pct_change_whole", f"""select event_id, round(filled / lag(filled) over (order by event_id) - 1, 6) + 0 as pct_change from
  (select *, last_value(value ignore nulls) over (order by event_id rows unbounded preceding) as filled from {GAPPY})""")(
    lambda s, d: rounded(V.pct_change(_gappy(s, d), "value", ["event_id"]).select("event_id", "pct_change")))
# once in one slice per group, once in slices of 200 rows, as large tables have them
for _suffix, _rows in (("", 1_000_000), ("_sliced", 200)):
    check(f"v_pct_change{_suffix}", _PCT)(lambda s, d, n=_rows: rounded(
        V.pct_change(_gappy(s, d), "value", ["event_id"], ["kind"], rows_per_slice=n).select("event_id", "pct_change")))
    check(f"v_cumsum_gappy{_suffix}", _CUM)(lambda s, d, n=_rows: rounded(
        V.cumsum(_gappy(s, d), "value", ["event_id"], ["kind"], rows_per_slice=n).select("event_id", "cumsum"), 4))
    check(f"v_cumcount_gappy{_suffix}", _COUNT)(lambda s, d, n=_rows: V.cumcount(
        _gappy(s, d), ["ts", "event_id"], ["kind"], rows_per_slice=n).select("event_id", "cumcount"))
    check(f"v_diff_gappy{_suffix}", _DIFF)(lambda s, d, n=_rows: rounded(
        V.diff(_gappy(s, d), "value", ["event_id"], ["kind"], rows_per_slice=n).select("event_id", "diff")))
    check(f"v_rank_gappy{_suffix}", _RANK)(lambda s, d, n=_rows: V.rank(
        _gappy(s, d), "value", ["kind"], rows_per_slice=n).select("event_id", F.col("rank").cast("double")))
# an order of texts that all begin alike
check("v_cumcount_text_sliced", "select c_custkey, row_number() over (order by c_name) - 1 as cumcount from customer")(
    lambda s, d: V.cumcount(table(s, d, "customer").select("c_custkey", "c_name"), ["c_name"], rows_per_slice=100).select("c_custkey", "cumcount"))
check("v_rank_min_down", f"select event_id, case when value is not null then rank() over (order by value desc nulls last) end::double as rank from {GAPPY}")(
    lambda s, d: V.rank(_gappy(s, d), "value", method="min", ascending=False).select("event_id", "rank"))
check("v_rank_max_pct", f"""select event_id, case when value is not null then round((rank() over (order by value nulls last) + count(*) over (partition by value) - 1)
  / (select count(value) from {GAPPY}), 9) end::double as rank from {GAPPY}""")(
    lambda s, d: rounded(V.rank(_gappy(s, d), "value", method="max", pct=True).select("event_id", "rank"), 9))
_SPARSE = f"(select kind, event_id, case when kind <> 'click' then value end as v, user_id from {GAPPY})"


def _sparse(s, d):
    return _gappy(s, d).withColumn("v", F.when(F.col("kind") != "click", F.col("value"))).select("kind", "event_id", "v", "user_id")


check("v_median_only", f"select kind, round(quantile_cont(v, 0.5), 6) as median from {_SPARSE} where kind is not null group by kind")(
    lambda s, d: rounded(V.aggregate(_sparse(s, d), ["kind"], {"median": ("v", "median")})))
check("v_two_medians", f"select kind, round(quantile_cont(v, 0.5), 6) as a, round(quantile_cont(user_id, 0.5), 6) as b from {_SPARSE} where kind is not null group by kind")(
    lambda s, d: rounded(V.aggregate(_sparse(s, d), ["kind"], {"a": ("v", "median"), "b": ("user_id", "median")})))
check("v_idx_text_key", "select c_mktsegment, first(c_name order by c_acctbal desc, c_name) as idxmax, first(c_name order by c_acctbal, c_name) as idxmin from customer group by 1")(
    lambda s, d: V.index_of_extreme(table(s, d, "customer"), "c_acctbal", "c_name", ["c_mktsegment"]))
check("v_idx_null_group", f"""select kind, first(event_id order by value desc, event_id) as idxmax, first(event_id order by value, event_id) as idxmin
  from {GAPPY} where kind is not null and value is not null group by kind""")(
    lambda s, d: V.index_of_extreme(_gappy(s, d), "value", "event_id", ["kind"]))
_PLACE = "select event_id, kind from (select *, row_number() over (partition by kind order by {}) as rn from " + GAPPY + " where kind is not null {}) where rn <= 3"
check("v_group_head", _PLACE.format("event_id", ""))(lambda s, d: V.group_head(_gappy(s, d), ["kind"], ["event_id"], 3).select("event_id", "kind"))
check("v_group_tail", _PLACE.format("event_id desc", ""))(lambda s, d: V.group_tail(_gappy(s, d), ["kind"], ["event_id"], 3).select("event_id", "kind"))
check("v_group_nlargest", _PLACE.format("value desc, event_id", "and value is not null"))(
    lambda s, d: V.group_nlargest(_gappy(s, d), ["kind"], "value", ["event_id"], 3).select("event_id", "kind"))
check("v_group_nsmallest", _PLACE.format("value, event_id", "and value is not null"))(
    lambda s, d: V.group_nsmallest(_gappy(s, d), ["kind"], "value", ["event_id"], 3).select("event_id", "kind"))
check("v_group_value_counts", "select o_orderstatus, o_orderpriority as value, count(*) as count from orders group by 1, 2")(
    lambda s, d: V.group_value_counts(_orders(s, d), ["o_orderstatus"], "o_orderpriority"))
check("v_group_describe", f"""select kind, count(v) as count, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, min(v) as min, round(quantile_cont(v, 0.25), 4) as "25%",
  round(quantile_cont(v, 0.5), 4) as "50%", round(quantile_cont(v, 0.75), 4) as "75%", max(v) as max from {_SPARSE} where kind is not null group by kind""")(
    lambda s, d: rounded(V.group_describe(_sparse(s, d), ["kind"], "v"), 4))
check("v_describe_other", f"""select 'kind' as column, count(kind) as count, count(distinct kind) as unique, (select kind from {GAPPY} where kind is not null group by 1 order by count(*) desc, 1 limit 1) as top,
    (select count(*) from {GAPPY} where kind is not null group by kind order by 1 desc limit 1) as freq from {GAPPY}
  union all select 'event_type', count(event_type), count(distinct event_type), (select event_type from events group by 1 order by count(*) desc, 1 limit 1),
    (select count(*) from events group by event_type order by 1 desc limit 1) from events""")(
    lambda s, d: V.describe_other(_gappy(s, d), ["kind", "event_type"]))
check("v_value_counts_normalize", f"select kind as value, round(count(*) / (select count(kind) from {GAPPY}), 9)::double as proportion from {GAPPY} where kind is not null group by 1")(
    lambda s, d: rounded(V.value_counts(_gappy(s, d), "kind", normalize=True), 9))
check("v_drop_duplicates_last", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1")(
    lambda s, d: V.drop_duplicates(_events(s, d).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"], "last"))
check("v_drop_duplicates_none", f"select event_id, user_id, kind from (select *, count(*) over (partition by user_id, kind) as n from {GAPPY}) where n = 1")(
    lambda s, d: V.drop_duplicates(_gappy(s, d), ["user_id", "kind"], ["event_id"], False).select("event_id", "user_id", "kind"))
check("v_corr_spearman", """select 'l_quantity' as column, 1.0::double as l_quantity, round(corr(a, b), 6) + 0 as l_extendedprice from r union all select 'l_extendedprice', round(corr(a, b), 6) + 0, 1.0 from r"""
      .replace("from r", """from (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a,
        rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)"""))(
    lambda s, d: rounded(V.corr(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman", decimals=None)))
check("v_text_functions", "select p_partkey, lower(p_name) as low, upper(p_name) as up, starts_with(p_name, 'a') as starts, ends_with(p_name, 'e') as ends, abs(p_size - 25) as off from part")(
    lambda s, d: _part(s, d).select("p_partkey", V.lower(F.col("p_name")).alias("low"), V.upper(F.col("p_name")).alias("up"),
                                    V.startswith(F.col("p_name"), "a").alias("starts"), V.endswith(F.col("p_name"), "e").alias("ends"),
                                    V.abs_(F.col("p_size") - 25).alias("off")))
# --- sorting
check("v_sort_values", f"select event_id, value from {GAPPY} order by value desc nulls last, event_id")(
    lambda s, d: V.sort_values(_gappy(s, d).select("event_id", "value"), ["value", "event_id"], [False, True]))
check("v_sort_index", "select o_orderkey, o_orderdate from orders order by o_orderkey")(
    lambda s, d: V.sort_index(_orders(s, d).select("o_orderkey", "o_orderdate"), ["o_orderkey"]))
check("v_head", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 5")(
    lambda s, d: V.head(_orders(s, d).select("o_orderkey", "o_totalprice"), ["o_orderkey"]))
check("v_tail", "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 5")(
    lambda s, d: V.tail(_orders(s, d).select("o_orderkey", "o_totalprice"), ["o_orderkey"]))
check("v_nlargest", "select event_id, value from events order by value desc, event_id limit 20")(
    lambda s, d: V.nlargest(_events(s, d).select("event_id", "value"), 20, ["value"], ["event_id"]))
check("v_nsmallest", "select event_id, value from events order by value, event_id limit 20")(
    lambda s, d: V.nsmallest(_events(s, d).select("event_id", "value"), 20, ["value"], ["event_id"]))

# --- scalar functions
check("v_round", "select l_orderkey, l_linenumber, l_extendedprice, round_even(l_quantity / 2, 0) as half, round_even(l_discount, 1) as tenth from lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", V.round_(F.col("l_quantity") / 2).alias("half"),
                                                V.round_(F.col("l_discount"), 1).alias("tenth")))
check("v_abs", "select c_custkey, abs(c_acctbal - 5000) as distance from customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("distance")))
check("v_str_len", "select doc_id, length(text)::int as len from documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", V.str_len(F.col("text")).alias("len")))
check("v_str_case", "select p_partkey, lower(p_brand) as lower, upper(p_name) as upper from part")(
    lambda s, d: _part(s, d).select("p_partkey", F.lower("p_brand").alias("lower"), F.upper("p_name").alias("upper")))
check("v_str_strip", r"select doc_id, md5(regexp_replace('  ' || text || chr(9) || chr(10), '^\s+|\s+$', '', 'g')) as stripped from documents")(
    lambda s, d: table(s, d, "documents").select(
        "doc_id", F.md5(F.encode(V.strip(F.concat(F.lit("  "), F.col("text"), F.lit("\t\n"))), "utf-8")).alias("stripped")))
check("v_str_contains", "select p_partkey, regexp_matches(p_name, '^(red|blue) .*t$') as hit from part")(
    lambda s, d: _part(s, d).select("p_partkey", V.contains(F.col("p_name"), "^(red|blue) .*t$").alias("hit")))
check("v_str_startswith_endswith", "select p_partkey, starts_with(p_name, 're') as starts, ends_with(p_name, 'et') as ends from part")(
    lambda s, d: _part(s, d).select("p_partkey", F.startswith("p_name", F.lit("re")).alias("starts"), F.endswith("p_name", F.lit("et")).alias("ends")))
check("v_date_parts", "select event_id, year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, hour(ts)::int as hour, quarter(ts)::int as quarter from events")(
    lambda s, d: _events(s, d).select("event_id", *[V.date_parts(F.col("ts"))[k].alias(k) for k in ("year", "month", "day", "hour", "quarter")]))
check("v_weekday", "select event_id, (isodow(ts) - 1)::int as weekday from events")(
    lambda s, d: _events(s, d).select("event_id", V.weekday(F.col("ts")).alias("weekday")))
check("v_date", "select event_id, cast(ts as date) as date from events")(
    lambda s, d: _events(s, d).select("event_id", V.date_parts(F.col("ts"))["date"].alias("date")))

# --- binning, stacking, conversion
check("v_cut_equal_width", """with r as (select min(p_retailprice) lo, max(p_retailprice) hi from part)
  select p_partkey, case when p_retailprice <= lo then 0 else least(greatest(ceil((p_retailprice - lo) / ((hi - lo) / 8)), 1), 8) - 1 end::int as bin from part, r""")(
    lambda s, d: V.cut_equal(_part(s, d), "p_retailprice", 8).select("p_partkey", "bin"))
check("v_cut_edges", "select p_partkey, case when p_size > 0 and p_size <= 10 then 0 when p_size > 10 and p_size <= 25 then 1 when p_size > 25 and p_size <= 40 then 2 end::int as bin from part")(
    lambda s, d: _part(s, d).select("p_partkey", V.cut(F.col("p_size"), [0, 10, 25, 40]).alias("bin")))
check("v_qcut", """with q as (select quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) e from orders)
  select o_orderkey, case when o_totalprice <= e[2] then 0 when o_totalprice <= e[3] then 1 when o_totalprice <= e[4] then 2 else 3 end::int as bin from orders, q""")(
    lambda s, d: V.qcut(_orders(s, d), "o_totalprice", 4).select("o_orderkey", "bin"))
check("v_concat", "select c_custkey as key, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_acctbal, null from supplier")(
    lambda s, d: V.concat([table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
                           table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))]))
check("v_to_numeric", "select event_id, try_cast(txt as double) as number from (select event_id, case when event_id % 5 = 0 then event_type else ' ' || value || ' ' end as txt from events)")(
    lambda s, d: _events(s, d).select("event_id", V.to_numeric(
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))).alias("number")))
check("v_to_datetime", "select event_id, case when event_id % 5 <> 0 then date_trunc('second', ts) end as moment from events")(
    lambda s, d: _events(s, d).select("event_id", V.to_datetime(F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz").alias("moment")))
# each row written in one of twelve layouts, by event_id, with the seconds that the layout keeps
_LAYOUTS = [("M/d/yyyy h:mm a", 60), ("yyyy-MM-dd h:mm a", 60), ("MM/dd/yy", 86400), ("yyyy.MM.dd", 86400), ("yyyy/MM/dd HH:mm", 60),
            ("dd-MMM-yyyy HH:mm:ss", 1), ("d MMM yyyy HH:mm", 60), ("MMM d yyyy HH:mm", 60), ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", 1),
            ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", 1), ("MMMM d, yyyy", 86400), ("yyyyMMdd'T'HHmmss", 1)]


@check("v_to_datetime_layouts", "select event_id, (epoch(ts)::bigint // k) * k - case when event_id % 12 = 9 then 7200 else 0 end as seconds from (select event_id, ts, "
       "[60, 60, 86400, 86400, 60, 1, 60, 60, 1, 1, 86400, 1][(event_id % 12 + 1)::int] as k from (select event_id, date_trunc('second', ts) as ts from events))")
def _(s, d):
    e = _events(s, d)
    written = F.coalesce(*[F.when(F.col("event_id") % 12 == k, F.date_format("ts", layout)) for k, (layout, _) in enumerate(_LAYOUTS)])
    return e.select("event_id", F.unix_seconds(V.to_datetime(written)).alias("seconds"))


check("v_named_agg", "select event_type, round(avg(value), 6) as average, count(distinct user_id) as users from events group by 1")(
    lambda s, d: rounded(V.aggregate(_events(s, d), ["event_type"], {"average": ("value", "mean"), "users": ("user_id", "nunique")})))
check("v_log_sqrt", f"select event_id, round(ln(value), 9) + 0 as log, round(ln(1 + value), 9) + 0 as log1p, round(sqrt(value), 9) as sqrt from {GAPPY}")(
    lambda s, d: rounded(_gappy(s, d).select("event_id", N.natural_log(F.col("value")).alias("log"), N.natural_log1p(F.col("value")).alias("log1p"),
                                             N.square_root(F.col("value")).alias("sqrt")), 9))

# --- result shaping
check("v_bounded_result", f"select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as ts, round_even(value / 3, 6) as value from {GAPPY} order by event_id limit 1000")(
    lambda s, d: V.bounded(_gappy(s, d).select("event_id", "ts", (F.col("value") / 3).alias("value")), ["event_id"]))
check("v_result_envelope", "select 'table' as kind, count(*) as row_count, least(count(*), 1000) as returned, count(*) > 1000 as result_truncated, false as input_truncated from events")(
    lambda s, d: V.envelope(_events(s, d)))
