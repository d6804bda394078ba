"""The whole analysis of one table."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import associations, charts, drift, drivers, findings, outliers, profile, quality, stats
from ..operators.digest import facts_frame
from ..operators.ordering import exact_quantiles
from ..operators.roles import infer_and_clean
from ..session import settle

# fixed values: steps of a run, in order
STEPS = [
    "dataset_loading", "schema_detection", "data_cleaning", "type_inference", "missing_value_analysis",
    "relationship_discovery", "statistical_analysis", "anomaly_detection", "driver_analysis", "quality_scoring",
    "schema_drift_check", "chart_generation", "insight_extraction", "report_creation", "final_export",
]
RAW_ROWS = 5_000


def analyze(df: DataFrame, reader_types: bool = False, prior: DataFrame | None = None,
            progress: Callable[[str, int], None] | None = None) -> dict[str, DataFrame]:
    """All results of one run, each as a DataFrame; ``df`` carries ``_row_id``.

    Tables with one row per
    column or column pair are computed once and kept; everything that grows with the data stays on the cluster.
    """
    def step(name: str) -> None:
        if progress:
            progress(name, round(100 * (STEPS.index(name) + 1) / len(STEPS)))

    step("dataset_loading")
    step("schema_detection")
    known = infer_and_clean(df, reader_types, keep=True)
    cleaned, roles, numeric = known.clean, known.roles, known.numeric
    step("data_cleaning")
    step("type_inference")
    spark = df.sparkSession

    step("missing_value_analysis")
    columns = settle(profile.profile_columns(cleaned, roles, samples=True, facts=known.facts))
    table = settle(profile.profile_table(cleaned))
    role_table = columns.select("ordinal", F.col("name").alias("column"), "role")

    step("relationship_discovery")
    ranges = stats.column_ranges(cleaned, numeric)
    relations = settle(associations.discover(cleaned, roles, ranges=ranges))

    step("statistical_analysis")
    quartiles = exact_quantiles(cleaned, numeric, stats.QUARTILES, ranges=ranges)
    # an infinite value would take part in these medians but not in those of the features
    finite = all(r["count"] == 0 or (abs(r["min"]) < math.inf and abs(r["max"]) < math.inf) for r in ranges.values())
    position = columns.select("ordinal", F.col("name").alias("column"))
    summary = settle(stats.numeric_summary(cleaned, numeric, normality=True, quantiles=quartiles, ranges=ranges).join(position, "column").orderBy("ordinal"))
    pairs = settle(stats.correlation_pairs(cleaned, numeric, ranges))
    top = settle(stats.top_pairs(pairs))
    matrix = settle(stats.correlation_matrix(cleaned, numeric, ranges=ranges, pairs=pairs)) if len(numeric) > 1 else spark.createDataFrame([], "column string")

    step("anomaly_detection")
    limits = outliers.fences(cleaned, numeric, quartiles, ranges)
    iqr = settle(outliers.iqr_outliers(cleaned, numeric, limits=limits))
    used, scores = outliers.anomaly_scores(cleaned, numeric, ranges=ranges, quantiles=quartiles) if numeric else ([], None)
    if scores is not None:
        flags = outliers.flag_anomalies(scores)
        forest = settle(flags.agg(F.count(F.when(F.col("flagged"), 1)).alias("flagged_count"),
                                  F.array(*[F.lit(c) for c in used]).alias("columns")))
        flagged = outliers.flagged_rows(flags)
    else:
        forest = spark.createDataFrame([(0, used)], "flagged_count bigint, columns array<string>")
        flagged = spark.createDataFrame([], "r bigint, score double")

    step("driver_analysis")
    driven = {k: settle(v) for k, v in drivers.analyse_drivers(cleaned, roles, columns, quartiles if finite else None).items()}

    step("quality_scoring")
    facts = facts_frame(spark, known.raw_facts)
    card = {k: settle(v) for k, v in quality.scorecard(facts, role_table, table, iqr).items()}

    step("schema_drift_check")
    print_ = settle(drift.fingerprint(columns, table))
    moved = settle(drift.compare(prior, print_))
    changed = settle(drift.changes(prior, print_)) if prior is not None else None

    step("chart_generation")
    specs = settle(charts.chart_specs(columns, pairs))
    bins = settle(charts.histogram(cleaned, numeric[:4], ranges=ranges))
    best = top.first()
    points = charts.scatter(cleaned, best["a"], best["b"]) if best else spark.createDataFrame([], "x double, y double")

    step("insight_extraction")
    insight = findings.generate(columns, table, summary, top, relations, iqr, forest, card, moved, changed, driven)
    results = {
        "roles": role_table, "profile_columns": columns, "profile_table": table, "role_counts": profile.role_counts(role_table),
        "relationships": relations, "summary": summary, "correlation_pairs": top, "correlation_matrix": matrix,
        "iqr_outliers": iqr, "forest": forest, "flagged_rows": flagged,
        **{f"driver_{k}": v for k, v in driven.items()}, **{f"quality_{k}": v for k, v in card.items()},
        "fingerprint": print_, "drift": moved, "drift_table": drift.change_table(moved, changed),
        "chart_specs": specs, "histogram": bins, "scatter": points,
        **insight, "clean": cleaned,
    }
    return results
