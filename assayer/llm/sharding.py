"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to source partitions, a matrix fixes how many rows go from each partition to each shard, every partition permutes its
rows and cuts them by its line of the matrix, and after the exchange every shard is permuted again. Only counts reach the driver:
one per partition and one per block of a shard. Everything that touches rows is DataFrame functions.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: numpy draws hypergeometric numbers for populations below this.
_EXACT = 1_000_000_000
ROWS_PER_PARTITION = 100_000
MAX_PARTITIONS = 65_536


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric number; for huge populations by inversion over twelve deviations around the mean."""
    total = good + bad
    if total < _EXACT:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mean = draws * good / total
    spread = 12 * math.sqrt(max(mean * (bad / total) * ((total - draws) / (total - 1)), 1.0)) + 12
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[1:]) - np.log(bad - draws + k[1:])
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(weights - weights.max())
    return int(k[np.searchsorted(np.cumsum(weights), rng.random() * weights.sum())])


def communication_matrix(partitions: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard, distributed as in a uniform shuffle; both margins are exact.

    >>> communication_matrix([2, 1], [2, 1], 0) in ([[2, 0], [0, 1]], [[1, 1], [1, 0]])
    True
    """
    if sum(partitions) != sum(shards):
        raise ValueError("partitions and shards hold different numbers of rows")
    rng, left, lines = np.random.default_rng(seed), list(shards), []
    for rows in partitions:
        line, rest = [], sum(left)
        for room in left:
            rest -= room
            line.append(_hypergeometric(rng, room, rest, rows - sum(line)))
        left = [a - b for a, b in zip(left, line)]
        lines.append(line)
    return lines


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _cell(hashed: Column, cells: int) -> Column:
    """Equal intervals of the hash, so that cells are in hash order."""
    return F.floor((F.shiftrightunsigned(hashed, 33)) * F.lit(cells) / F.lit(2**31)).cast("int")


def shuffle_to_shards(df: DataFrame, id_col: str, text_col: str, shards: int = 16, seed: int = 17,
                      rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Give every row a shard and a gapless slot in it: ``id_col, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length of the text plus one. A null text counts as empty. Rows are told apart by id, size and checksum; rows
    equal in all three are interchangeable, so repeated rows and null ids are fine (null ids are spread by their checksum). Fewer rows
    than shards leave the last shards empty; an empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col(f"`{id_col}`")
    rows = df.select(key.alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"))
    mixed = [F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("size"), F.col("text_crc32")]
    rows = materialise(rows.withColumn("_first", F.xxhash64(F.lit(seed), *mixed))
                       .withColumn("_second", F.xxhash64(F.lit(seed + 1), F.col("_first"), *mixed)), "shards")
    total = rows.count()
    partitions = min(MAX_PARTITIONS, max(16, -(-total // rows_per_partition)))
    rows = rows.withColumn("_from", _cell(F.col("_first"), partitions))
    found = {r["_from"]: r["count"] for r in rows.groupBy("_from").count().collect()}
    sizes = shard_sizes(total, shards)
    sources = sorted(found)
    matrix = communication_matrix([found[p] for p in sources], sizes, seed)
    cuts = [(p, [int(x) for x in np.cumsum(line)]) for p, line in zip(sources, matrix)]
    # one short line per partition, at most MAX_PARTITIONS of them
    cuts = F.broadcast(spark.createDataFrame(cuts, T.StructType([
        T.StructField("_from", T.IntegerType()), T.StructField("_cuts", T.ArrayType(T.LongType()))])))

    local = Window.partitionBy("_from").orderBy("_first", "_id")
    dealt = rows.withColumn("_rank", F.row_number().over(local)).join(cuts, "_from").withColumn(
        "shard", F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))).cast("int"))

    blocks = min(MAX_PARTITIONS // shards, max(4, -(-total // (shards * rows_per_partition))))
    dealt = dealt.withColumn("_block", _cell(F.col("_second"), blocks))
    counts = dealt.groupBy("shard", "_block").count()
    offsets = F.broadcast(counts.withColumn("_offset", F.sum("count").over(
        Window.partitionBy("shard").orderBy("_block")) - F.col("count")).drop("count"))  # at most shards x blocks lines
    inside = Window.partitionBy("shard", "_block").orderBy("_second", "_id")
    return dealt.withColumn("_place", F.row_number().over(inside)).join(offsets, ["shard", "_block"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_offset") + F.col("_place") - 1).cast("long").alias("slot"))
