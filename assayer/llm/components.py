"""Connected components of a large graph by alternating stars; no part of it reaches the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node; aggregated in the tasks first, so a hub is one line of each."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``: the component is its smallest node.

    Self-links, repeated links and links with a null end are ignored; without links the result is empty. Every round writes its links to
    the shared checkpoint folder. A hub's links are spread by the skew handling of joins.
    """
    links = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = materialise(links.distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        # large star: a node's larger neighbours meet its smallest one
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both).withColumn("m", F.least("m", "u")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: a node and its smaller neighbours meet the smallest of them
        small = large.join(_least(large), "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.*").filter("u <> v").distinct()
        links = materialise(small, "links")
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
