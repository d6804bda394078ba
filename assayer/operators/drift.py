"""Schema fingerprints and their comparison across runs."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import signed

NULL_SPIKE_POINTS, ROW_SHIFT_PCT, ROW_MENTION_PCT = 15.0, 40, 5
# fixed values: summary sentences
BASELINE_TEXT = ("First analysis of a file with this name — baseline saved. "
                 "Re-upload later to see what changed.")
UNCHANGED_TEXT = "Schema unchanged since the last run."


def fingerprint(profile: DataFrame, table: DataFrame) -> DataFrame:
    """Long form, one row per column, carrying the table counters of its run."""
    counters = table.select("row_count", "col_count", "missing_cell_pct").first()
    return profile.select("name", "role", "dtype", "null_pct", F.lit(counters["row_count"]).cast("bigint").alias("row_count"),
                          F.lit(counters["col_count"]).cast("bigint").alias("col_count"),
                          F.lit(counters["missing_cell_pct"]).cast("double").alias("missing_cell_pct"))


def changes(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, column, before, after, jump) of two fingerprints."""
    p = prior.select(F.col("name").alias("column"), F.col("role").alias("r0"), F.col("null_pct").alias("n0"))
    c = current.select(F.col("name").alias("column"), F.col("role").alias("r1"), F.col("null_pct").alias("n1"))
    none = F.lit(None).cast("string")
    added = c.join(p, "column", "left_anti").select(
        F.lit("added").alias("kind"), "column", none.alias("before"), F.col("r1").alias("after"), F.lit(None).cast("double").alias("jump"))
    removed = p.join(c, "column", "left_anti").select(
        F.lit("removed").alias("kind"), "column", F.col("r0").alias("before"), none.alias("after"), F.lit(None).cast("double").alias("jump"))
    both = p.join(c, "column")
    roles = both.where("r0 <> r1").select(
        F.lit("role_change").alias("kind"), "column", F.col("r0").alias("before"), F.col("r1").alias("after"),
        F.lit(None).cast("double").alias("jump"))
    spikes = both.where(F.col("n1") - F.col("n0") >= NULL_SPIKE_POINTS).select(
        F.lit("null_spike").alias("kind"), "column", F.col("n0").cast("string").alias("before"), F.col("n1").cast("string").alias("after"),
        F.bround(F.col("n1") - F.col("n0"), 1).alias("jump"))
    return reduce(DataFrame.unionByName, [added, removed, roles, spikes])


def row_delta(prior: DataFrame, current: DataFrame) -> DataFrame:
    """One row: change of the row count, absolute and in percent of the prior count (null if that was 0)."""
    none = F.lit(None).cast("bigint")
    counts = prior.agg(F.max("row_count").alias("a"), none.alias("b")).unionByName(
        current.agg(none.alias("a"), F.max("row_count").alias("b"))).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return counts.select(
        (F.col("b") - F.col("a")).alias("row_delta"),
        F.bround(F.try_divide(F.lit(100.0) * (F.col("b") - F.col("a")), F.col("a").cast("double")), 1).alias("row_delta_pct"))


def compare(prior: DataFrame | None, current: DataFrame) -> DataFrame:
    """One row: status, severity, summary sentence, counts per kind and row delta."""
    none_d = F.lit(None).cast("double")
    if prior is None:
        zero = F.lit(0).cast("bigint")
        return current.agg(F.count("*").alias("_n")).select(
            F.lit("baseline").alias("status"), F.lit("info").alias("severity"), F.lit(BASELINE_TEXT).alias("summary"),
            zero.alias("added"), zero.alias("removed"), zero.alias("role_changes"), zero.alias("null_spikes"),
            F.lit(None).cast("bigint").alias("row_delta"), none_d.alias("row_delta_pct"))
    names = {"added": "added", "removed": "removed", "role_change": "role_changes", "null_spike": "null_spikes"}
    found = changes(prior, current).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(v) for k, v in names.items()])
    delta = row_delta(prior, current)
    # two one-row frames side by side through a union
    shape = [(c, "bigint") for c in names.values()] + [("row_delta", "bigint"), ("row_delta_pct", "double")]

    def padded(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in shape])

    one = padded(found).unionByName(padded(delta)).agg(*[F.max(c).alias(c) for c, _ in shape])
    pct = F.col("row_delta_pct")
    severity = (F.when((F.col("removed") > 0) | (F.col("role_changes") > 0), "critical")
                .when((F.col("added") > 0) | (F.col("null_spikes") > 0) | (F.coalesce(F.abs(pct), F.lit(0.0)) >= ROW_SHIFT_PCT), "warning")
                .otherwise("info"))
    bits = F.concat_ws(
        ", ",
        F.when(F.col("added") > 0, F.format_string("%d new column(s)", "added")),
        F.when(F.col("removed") > 0, F.format_string("%d column(s) removed", "removed")),
        F.when(F.col("role_changes") > 0, F.format_string("%d type change(s)", "role_changes")),
        F.when(F.col("null_spikes") > 0, F.format_string("%d null-rate spike(s)", "null_spikes")),
        F.when(F.abs(pct) >= ROW_MENTION_PCT, F.concat(signed(pct), F.lit("% rows"))))
    summary = F.when(bits == "", UNCHANGED_TEXT).otherwise(F.concat(F.lit("Since the last run: "), bits, F.lit(".")))
    return one.select(F.lit("compared").alias("status"), severity.alias("severity"), summary.alias("summary"),
                      *names.values(), "row_delta", "row_delta_pct")


def change_table(drift: DataFrame, found: DataFrame | None) -> DataFrame:
    """Report rows: kind of change and detail, in report order."""
    pct = F.col("row_delta_pct")
    rows = drift.where(pct.isNotNull()).select(
        F.lit(4).alias("position"), F.lit("").alias("column"), F.lit("Row count").alias("change"),
        F.concat(F.when(F.col("row_delta") < 0, "-").otherwise("+"), F.format_number(F.abs("row_delta"), 0), F.lit(" rows ("),
                 signed(pct, 1), F.lit("%)")).alias("detail"))
    if found is None:
        return rows
    kind = F.col("kind")
    arrow = F.concat(F.col("column"), F.lit(": "), F.col("before"), F.lit(" → "), F.col("after"))
    percents = F.concat(F.col("column"), F.lit(": "), F.col("before"), F.lit("% → "), F.col("after"), F.lit("%"))
    listed = found.select(
        F.when(kind == "added", 0).when(kind == "removed", 1).when(kind == "role_change", 2).otherwise(3).alias("position"), "column",
        F.when(kind == "added", "Column added").when(kind == "removed", "Column removed").when(kind == "role_change", "Type change")
        .otherwise("Null-rate spike").alias("change"),
        F.when(kind == "role_change", arrow).when(kind == "null_spike", percents).otherwise(F.col("column")).alias("detail"))
    return listed.unionByName(rows)
