"""Session defaults and durable intermediates."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "assayer", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session may fall back to a temp one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="assayer-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/assayer-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate that several later jobs read as Parquet in the checkpoint folder and read it back.

    It is computed once, survives the loss of executors, and later scans still prune its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.parquet(path)
    stored = df.sparkSession.read.schema(T.StructType([
        T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])).parquet(path)
    return stored.toDF(*df.columns)


def settle(df: DataFrame) -> DataFrame:
    """Fix a small result (a row per column, column pair or target) as a local table, so that it is not recomputed."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row results side by side."""
    spark = frames[0].sparkSession
    values, fields = [], []
    for f in frames:
        values += list(f.first())
        fields += f.schema.fields
    return spark.createDataFrame([tuple(values)], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def spread(df: DataFrame, rows: int, rows_per_task: int = 1_000_000) -> DataFrame:
    """Share rows with costly work among all cores; a larger scan has enough tasks of its own.

    A scan is cut at 4 MB or more, which in a table that compresses well are a million rows: up to there it may have one task for all.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parallelism) if rows <= parallelism * rows_per_task else df


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
