"""The corpus pipeline: documents in, token ids out; every stage is one of the corpus operators.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all documents that the stage before it kept; ``run`` writes what a stage
returns to the shared checkpoint folder and reads it back for the next one. All stages but the last return the columns they are given.

Decisions are made for rows, not for ids: a stage numbers the rows it is given (they are read from files, so the numbers stand), and drops
by that number. So rows without an id are judged like all others, of repeated rows the near-duplicate stage keeps one, and of two texts
under one id only the one that was found goes. Rows with a null or empty text have no duplicates and overlap nothing.
"""
from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, jaccard, queries, secret_scan, seeds
from assayer.session import materialise

#: Score below which the quality classifier rejects a document: label 0 is the likelier one.
REJECT_BELOW = 0.5
#: Rows of a batch that goes to a Python worker: whole texts, which stand in the JVM, in Arrow and in Python at once.
ROWS_SENT = 1_000
#: Numbers of dropped rows that still go to every task (8 bytes each); beyond it they are joined by a shuffle.
MOST_SENT = 1_000_000


ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents whose row is not among ``rows``; these go to every task only while they are few."""
    rows = materialise(rows.distinct(), "dropped")
    return _numbered(docs).join(F.broadcast(rows) if rows.count() <= MOST_SENT else rows, ROW, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it is fitted on the labelled ones among them.

    Scores are written before they are filtered by: a condition on them would be moved into the scan's projection, where every
    statistic that a rule mentions would be worked out anew.
    """
    model = queries.quality_model(spark, docs, sf_dir)
    scored = materialise(model.score(docs, "text", "__score"), "scored")
    return scored.filter(F.col("__score") >= REJECT_BELOW).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard index of 0.8 on five-word shingles: the one with the smallest id.

    Rows without an id come after those with one; of rows with one id the first in the table stays.
    """
    found = jaccard.join_components(_numbered(docs).select(ROW, "text"), ROW, "text", words=5, num=80, den=100)
    groups = found.join(_numbered(docs).select(ROW, "doc_id"), ROW).select(
        "component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW).alias("place"))
    groups = materialise(groups, "groups")
    first = groups.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return _without(docs, groups.join(first, "component_id").filter(F.col(f"place.{ROW}") != F.col(f"first.{ROW}")).select(f"place.{ROW}"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    found = seeds.overlaps(_numbered(docs).select(ROW, "text"), ROW, "text", queries.table(spark, sf_dir, "benchmark"), "item_id", "text")
    return _without(docs, found.select(ROW))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and ``n_chars`` counted anew."""
    masked = secret_scan.mask(docs, "doc_id", "text")
    return masked.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the kept texts: ``doc_id, n_tokens, ids``."""
    ids = bpe.encode(docs, "doc_id", "text", public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate),
          ("secret scans", secrets), ("byte-level BPE encoding and decoding", encode)]

#: No SQL says what a fitted classifier keeps; the stages are tested against brute force.
ORACLE_SQL = None


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Stages that run inside send ``ROWS_SENT`` rows to Python at a time, if the session does not send fewer."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if not 0 < int(before) <= ROWS_SENT:
        spark.conf.set(setting, ROWS_SENT)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    with _small_batches(spark):
        for place, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if place < len(STAGES) - 1:
                docs = materialise(docs, f"stage-{place}")
    return docs
