"""Bounded samples of labelled texts for fitting, and the cross-validation fold of a document."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a fit reads; those with the smallest hash of their id.
MOST_ROWS = 20_000


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, folds: int, held_out: int,
           most_rows: int = MOST_ROWS) -> DataFrame:
    """``id, text, label`` of at most ``most_rows`` labelled documents outside the held-out fold.

    Of repeated labels of a document the greatest counts; null ids, labels and texts are left out. The rows are chosen by a hash of
    the id, so the choice does not depend on partitioning. As their number is bounded, they are broadcast.
    """
    chosen = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")) \
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id"), folds) != held_out)) \
        .groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "id")
