"""Columnar tables with a row position that does not depend on partitioning."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"
_ROWS_PER_FILE = 1 << 40


def read_parquet(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """Parquet scan; with ``row_id`` each row carries (file ordinal, position in file) as one bigint."""
    df = spark.read.parquet(path)
    if not row_id:
        return df
    files = sorted(df.inputFiles())
    position = F.col("_metadata.row_index")
    if len(files) == 1:
        return df.select("*", position.alias(ROW_ID))
    listing = spark.createDataFrame(
        [(f.rsplit("/", 1)[-1], f, i) for i, f in enumerate(files)], "name string, path string, ordinal bigint")
    if len({f.rsplit("/", 1)[-1] for f in files}) == len(files):
        keyed = df.select("*", F.col("_metadata.file_name").alias("_file"), position.alias("_pos"))
        listing = listing.select(F.col("name").alias("_file"), "ordinal")
    else:
        keyed = df.select("*", F.col("_metadata.file_path").alias("_file"), position.alias("_pos"))
        listing = listing.select(F.col("path").alias("_file"), "ordinal")
    # the listing has one row per file; past a size no executor should hold, Spark joins it by shuffle
    if len(files) <= 200_000:
        listing = F.broadcast(listing)
    return (keyed.join(listing, "_file")
            .withColumn(ROW_ID, F.col("ordinal") * F.lit(_ROWS_PER_FILE) + F.col("_pos"))
            .drop("_file", "_pos", "ordinal"))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType))


def quoted(name: str):
    """Column reference that also works for names holding dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
