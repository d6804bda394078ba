"""File admission: name, size, digest and the reason a file is refused."""
from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def _same(column: str) -> Column:
    """One spelling of local paths (file:/x and file:///x)."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def catalogue(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, name, size_bytes, sha256, status) per file; only admitted files are read, by the length filter.

    ``max_bytes`` refuses larger files; without it any size is admitted.
    """
    most = (1 << 62) if max_bytes is None else max_bytes
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # a scan skips empty files, so they come from its listing of names
    listing = spark.createDataFrame([(unquote(f),) for f in scan.inputFiles()], "listed string").select(_same("listed").alias("path"))
    files = scan.withColumn("path", _same("path"))
    name = F.element_at(F.split("path", "/"), -1)
    status = (F.when(~F.lower(name).endswith(".csv"), "only .csv files are accepted")
              .when(F.col("length") == 0, "file is empty")
              .when(F.col("length") > most, "file exceeds the size limit").otherwise("uploaded"))
    sized = listing.join(files.select("path", "length"), "path", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    listed = sized.select("path", name.alias("name"), F.col("length").alias("size_bytes"), status.alias("status"))
    digests = (files.where((F.col("length") > 0) & (F.col("length") <= most))
               .select("path", F.sha2(F.col("content"), 256).alias("sha256")))
    return (listed.join(digests, "path", "left")
            .select("path", "name", "size_bytes", F.when(F.col("status") == "uploaded", F.col("sha256")).alias("sha256"), "status"))
