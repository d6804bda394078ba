"""Run history and limit audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as J
from ..operators import profile as P
from ..operators import roles as R
from ..session import scratch_path
from ..streaming import limits as L
from . import check, table
from .profiling import fields, role_sql

# orders as runs of customers' datasets: the nation owns them, the market segment is the file name
RUNS = """(select o_orderkey as run_id, o_custkey as dataset_id, c_nationkey as owner, case o_orderstatus when 'F' then 'succeeded' when 'P' then 'running' else 'queued' end as status,
  o_orderdate as created_at, o_totalprice as size from orders join customer on o_custkey = c_custkey)"""


def runs(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    o, c = table(s, d, "orders"), table(s, d, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_id"), F.col("c_nationkey").alias("owner"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size"))


def datasets(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_mktsegment").alias("filename"))


check("history_page", f"select *, (select count(*) from {RUNS} where owner = 3) as total from (select * from {RUNS} where owner = 3 order by created_at desc, run_id limit 20 offset 40)")(
    lambda s, d: J.page(runs(s, d), "owner", 3, 20, 40, key="run_id"))
check("history_page_deep", f"select *, (select count(*) from {RUNS} where owner = 3) as total from (select * from {RUNS} where owner = 3 order by created_at desc, run_id limit 25 offset 380)")(
    lambda s, d: J.page(runs(s, d), "owner", 3, 25, 380, key="run_id", rows_per_slice=100))
check("history_latest_profile", f"select owner, dataset_id, run_id, created_at, size from (select *, row_number() over (partition by owner, dataset_id order by created_at desc, run_id desc) as rn "
      f"from {RUNS} where status = 'succeeded') where rn = 1")(lambda s, d: J.latest_profile(runs(s, d), ["size"]))
check("history_active_runs", f"select owner, count(*) as active from {RUNS} where status in ('queued', 'running') group by owner")(lambda s, d: J.active_runs(runs(s, d)))
check("history_grouped_summary", "select l_returnflag, count(*) as orders, round(sum(l_extendedprice), 2) as revenue, round(avg(l_quantity), 2) as avg_units from lineitem group by 1")(
    lambda s, d: J.grouped_summary(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity"))
PRIOR = f"""with r as (select r.*, c_mktsegment as filename from {RUNS} r join customer on dataset_id = c_custkey),
  s as (select owner, filename, run_id, row_number() over (partition by owner, filename order by created_at desc, run_id desc) as place from r where status = 'succeeded')
  select r.run_id, r.owner, r.filename, case when a.run_id = r.run_id then b.run_id else a.run_id end as prior_run_id from r
  left join s a on a.owner = r.owner and a.filename = r.filename and a.place = 1 left join s b on b.owner = r.owner and b.filename = r.filename and b.place = 2"""
check("history_prior_run", PRIOR)(lambda s, d: J.prior_runs(runs(s, d), datasets(s, d)))
check("history_prior_run_of_busy_files", PRIOR)(lambda s, d: J.prior_runs(runs(s, d), datasets(s, d), hot_rows=12))


@check("history_run_record", "select 'run-1' as run_id, 'customer' as dataset, 'me' as owner, 'succeeded' as status, "
       """'[' || string_agg('{"ordinal":' || ordinal || ',"name":"' || "column" || '","role":"' || role || '"}', ',' order by ordinal) || ']' as profile """
       f"from ({role_sql('customer', fields('customer'))})")
def _(s, d):
    profile = P.profile_of(R.infer_and_clean(table(s, d, "customer")))
    none = s.createDataFrame([], "rule int, pos bigint, severity string, title string")
    record = J.run_record(s, "run-1", "customer", "me", "succeeded", profile, none)
    short = F.regexp_replace("profile", r',"dtype":"[a-z]+","null_pct":[0-9.]+', "")
    return record.select("run_id", "dataset", "owner", "status", short.alias("profile"))


CLASSES = {"click": (2, 86400), "view": (3, 86400), "purchase": (1, 43200), "signup": (1, 86400), "error": (1, 604800)}


def audit_sql() -> str:
    return " union all ".join(
        f"select user_id, '{c}' as class, make_timestamp(slot * {n} * 1000000) as window_start, make_timestamp((slot + 1) * {n} * 1000000) as window_end, "
        f"events, {k}::bigint as allowed from (select user_id, epoch_us(ts) // {n * 1000000} as slot, count(*) as events from events "
        f"where event_type = '{c}' group by 1, 2) where events > {k}" for c, (k, n) in CLASSES.items())


check("limit_audit_events", audit_sql())(
    lambda s, d: L.limit_audit(table(s, d, "events").withColumnRenamed("event_type", "class"), "user_id", CLASSES).select(
        "user_id", "class", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "events", "allowed"))


@check("limit_audit_stream", f"select * from ({audit_sql()}) where window_end <= (select min(last) from (select max(ts) as last from events group by event_type)) - interval 10 minutes")
def _(s, d):
    """The same audit as a stream: windows the watermark has closed."""
    source = table(s, d, "events")
    landing, out, state = scratch_path(s, "events"), scratch_path(s, "audit"), scratch_path(s, "audit-state")
    source.write.parquet(landing)
    stream = s.readStream.schema(source.schema).parquet(landing).withColumnRenamed("event_type", "class")
    (L.limit_audit_stream(stream, "user_id", CLASSES).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    found = s.read.schema("user_id bigint, class string, window_start timestamp, window_end timestamp, events bigint, allowed bigint").parquet(out)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@check("drift_monitor", """select place::int as place, status, row_delta from (select 1 as place, 'baseline' as status, null::bigint as row_delta
  union all select 2, 'compared', (select count(*) from orders) - (select count(*) from orders where o_orderkey % 3 = 0)
  union all select 3, 'compared', 0::bigint)""")
def _(s, d):
    """Three arrivals of the same export: a third of the rows, then all, then all again."""
    from pyspark.sql import Window as W

    from ..streaming import drift_monitor as M
    incoming, history, state = scratch_path(s, "incoming"), scratch_path(s, "history"), scratch_path(s, "monitor-state")
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for part in (rows.where("o_orderkey % 3 = 0"), rows, rows):
        # one file is one arrival
        part.coalesce(1).write.mode("append").option("header", True).csv(f"{incoming}/orders")
        M.watch(s, incoming, history, state).awaitTermination()
    seen = M.monitor_history(s, history)
    place = F.row_number().over(W.partitionBy("dataset").orderBy("arrival"))
    return seen.select(place.alias("place"), "status", "row_delta")
