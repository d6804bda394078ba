"""Run and dataset history kept as tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import one_row
from . import ordering
from .ordering import ROWS_PER_SLICE


def page(history: DataFrame, owner: str, who, limit: int = 20, offset: int = 0, created: str = "created_at",
         key: str = "id", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One page of an owner's rows, newest first, with the total on every row; deep pages are found by a positional index."""
    own = history.where(F.col(owner) == who)
    rows = ordering.page(own, [F.desc(created), key], offset, offset + limit, rows_per_slice)
    return rows.withColumn("total", F.lit(own.count()).cast("bigint"))


def latest_profile(runs: DataFrame, payload: list[str], status: str = "succeeded") -> DataFrame:
    """Newest successful run per owner and dataset; ties go to the larger run id."""
    best = F.max_by(F.struct("run_id", "created_at", *payload), F.struct("created_at", "run_id"))
    return (runs.where(F.col("status") == status).groupBy("owner", "dataset_id").agg(best.alias("b"))
            .select("owner", "dataset_id", "b.*"))


def active_runs(runs: DataFrame) -> DataFrame:
    """Queued or running runs per owner."""
    return runs.where(F.col("status").isin("queued", "running")).groupBy("owner").agg(F.count("*").alias("active"))


def grouped_summary(df: DataFrame, key: str, amount: str, units: str) -> DataFrame:
    """count, sum and mean per key at two decimals."""
    return df.groupBy(key).agg(F.count("*").alias("orders"), F.round(F.sum(amount), 2).alias("revenue"),
                               F.round(F.avg(units), 2).alias("avg_units"))


def prior_runs(runs: DataFrame, datasets: DataFrame, hot_rows: int = ROWS_PER_SLICE) -> DataFrame:
    """Each run with the newest other successful run of the same owner and file name.

    The two newest successes per owner and file name are enough: if a run is the newest itself, the second one is its
    prior. Both limits are applied on the map side, so a much-analysed file is not gathered anywhere. Runs meet those two by a join in
    which files with more than ``hot_rows`` runs, and datasets with as many, are broadcast.
    """
    counted = datasets.select("dataset_id", "filename").join(runs.groupBy("dataset_id").agg(F.count("*").alias("n")), "dataset_id")
    named = ordering.lookup(runs, counted.withColumn("known", F.lit(True)), ["dataset_id"], hot_rows).where("known").drop("known", "n")
    newest = W.partitionBy("owner", "filename").orderBy(F.desc("created_at"), F.desc("run_id"))
    two = (named.where("status = 'succeeded'").withColumn("place", F.row_number().over(newest)).where("place <= 2")
           .groupBy("owner", "filename").agg(F.max(F.when(F.col("place") == 1, F.col("run_id"))).alias("first"),
                                             F.max(F.when(F.col("place") == 2, F.col("run_id"))).alias("second")))
    sizes = named.groupBy("owner", "filename").agg(F.count("*").alias("n"))
    joined = ordering.lookup(named, sizes.join(two, ["owner", "filename"], "left"), ["owner", "filename"], hot_rows)
    prior = F.when(F.col("first") == F.col("run_id"), F.col("second")).otherwise(F.col("first"))
    return joined.select("run_id", "owner", "filename", prior.alias("prior_run_id"))


def run_record(spark, run_id: str, dataset: str, owner: str, status: str, profile: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per run: identity, status, time, and profile and findings as JSON (both bounded by the column count)."""
    columns = profile.agg(F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", "name", "role", "dtype", "null_pct")))).alias("profile"))
    notes = findings.agg(F.to_json(F.array_sort(F.collect_list(F.struct("rule", "pos", "severity", "title")))).alias("findings"))
    return one_row(columns, notes).select(F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), F.lit(owner).alias("owner"),
                        F.lit(status).alias("status"), F.current_timestamp().alias("created_at"), "profile", "findings")


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").partitionBy("dataset").parquet(path)
