"""Recurring files: every arrival is profiled and compared with the previous one of the same name."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift, profile
from ..operators.roles import infer_and_clean
from ..sources.csv import read_csv

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _history(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def record_arrival(df: DataFrame, name: str, arrival: int, history: str, reader_types: bool = True) -> DataFrame:
    """Fingerprint one arrival, compare it with the latest earlier one of that name, and keep both results.

    Results are written under the arrival number, so a replay overwrites its own files and nothing is counted twice.
    """
    spark = df.sparkSession
    known = infer_and_clean(df, reader_types)
    now = drift.fingerprint(profile.profile_columns(known.clean, known.roles, facts=known.facts), profile.profile_table(known.clean))
    seen = _history(spark, history, "fingerprints")
    prior = None
    if seen is not None:
        mine = seen.where((F.col("dataset") == name) & (F.col("arrival") < arrival))
        last = mine.agg(F.max("arrival")).first()[0]
        if last is not None:
            prior = mine.where(F.col("arrival") == last).select(*now.columns)
    now.write.mode("overwrite").parquet(f"{history}/fingerprints/dataset={name}/arrival={arrival}")
    result = drift.compare(prior, now)
    result.write.mode("overwrite").parquet(f"{history}/drift/dataset={name}/arrival={arrival}")
    return result


def folder_name(path: str) -> str:
    return path.rstrip("/").split("/")[-2]


def watch(spark: SparkSession, incoming: str, history: str, checkpoint: str, name_of: Callable[[str], str] = folder_name,
          read: Callable[[SparkSession, str], DataFrame] = read_csv) -> StreamingQuery:
    """Stream of arriving files, one per micro-batch; only paths pass through the driver, files are read by Spark jobs."""
    files = (spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", 1).load(incoming).select("path", "modificationTime"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        for place, row in enumerate(batch.orderBy("modificationTime", "path").collect()):
            record_arrival(read(batch.sparkSession, row["path"]), name_of(row["path"]), batch_id * 1000 + place, history)

    return (files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def monitor_history(spark: SparkSession, history: str) -> DataFrame:
    """(dataset, arrival, status, severity, summary, …) of all arrivals so far."""
    return _history(spark, history, "drift")
