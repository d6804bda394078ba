"""Fixed-window limit audit over an event stream, with a batch twin that reads its events once."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: class -> (events allowed, window in seconds)
LIMITS = {"auth": (10, 300), "upload": (20, 3600), "analyze": (30, 3600), "read": (240, 60), "mcp": (120, 60)}


def _over(counted: DataFrame, key: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Windows ``w`` with more events than their class allows."""
    allowed = F.element_at(F.create_map(*[x for c, (n, _) in limits.items() for x in (F.lit(c), F.lit(n))]), F.col("class")).cast("bigint")
    return counted.where(F.col("events") > allowed).select(
        key, "class", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", allowed.alias("allowed"))


def limit_audit(events: DataFrame, key: str, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Batch: events need columns ts, class and the key; one scan and one shuffle of partial counts for all classes.

    Windows are aligned to the epoch. Events without a time or of a class without a limit are left out; events without a key
    share one count.
    """
    known = events.where(F.col("class").isin(list(limits)) & F.col("ts").isNotNull())
    at = F.col("ts").cast("timestamp")
    seconds = F.element_at(F.create_map(*[x for c, (_, s) in limits.items() for x in (F.lit(c), F.lit(s))]), F.col("class")).cast("bigint")
    micros = F.unix_micros(at)
    kind = events.schema["ts"].dataType
    start = micros - F.pmod(micros, seconds * 1_000_000)
    window = F.struct(F.timestamp_micros(F.col("slot")).cast(kind).alias("start"),
                      F.timestamp_micros(F.col("slot") + seconds * 1_000_000).cast(kind).alias("end"))
    counted = known.groupBy(F.col(key), F.col("class"), start.alias("slot")).agg(F.count("*").alias("events")).withColumn("w", window)
    return _over(counted, key, limits)


def limit_audit_stream(events: DataFrame, key: str, limits: dict[str, tuple[int, int]] = LIMITS,
                       lateness: str = "10 minutes") -> DataFrame:
    """Stream: a window is reported once it is closed by the watermark; later events are dropped.

    Classes with windows of one length share a stateful operator.
    """
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    lengths: dict[int, list[str]] = {}
    for c, (_, seconds) in limits.items():
        lengths.setdefault(seconds, []).append(c)
    return reduce(DataFrame.unionByName, [
        _over(marked.where(F.col("class").isin(classes)).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), F.col(key), F.col("class"))
              .agg(F.count("*").alias("events")), key, limits) for seconds, classes in lengths.items()])
