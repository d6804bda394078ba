"""Inputs derived from the test tables, with the SQL that derives the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ROW_ID
from . import table

# orders as a hand-made export would look: all text, gaps, junk, spelling variants, a blank column
DIRTY = """(select o_orderkey,
  'A' || o_orderkey as order_code,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 13 = 0 then 'TBD' else ' ' || o_totalprice end as price,
  case when o_orderkey % 5 = 0 then ' ' || lower(o_orderstatus) when o_orderkey % 3 = 0 then null else o_orderstatus end as status,
  case when o_orderkey % 2 = 0 then 'Yes' else 'no' end as paid,
  case when o_orderkey % 17 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as day,
  case when o_orderkey % 10 = 0 then o_orderpriority end as note,
  case when o_orderkey % 4 = 0 then 'n/a' when o_orderkey % 4 = 1 then '' else o_orderpriority end as priority,
  '' || (o_custkey % 50) as customer
  from orders)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("A"), k.cast("string")).alias("order_code"),
        F.when(k % 7 == 0, None).when(k % 13 == 0, "TBD").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).alias("price"),
        F.when(k % 5 == 0, F.concat(F.lit(" "), F.lower("o_orderstatus"))).when(k % 3 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 2 == 0, "Yes").otherwise("no").alias("paid"),
        F.when(k % 17 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 10 == 0, F.col("o_orderpriority")).alias("note"),
        F.when(k % 4 == 0, "n/a").when(k % 4 == 1, "").otherwise(F.col("o_orderpriority")).alias("priority"),
        (F.col("o_custkey") % 50).cast("string").alias("customer"),
        k.alias(ROW_ID))
