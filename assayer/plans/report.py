"""The report of a run as twelve tables and a manifest."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ROW_ID
from .workflow import RAW_ROWS

# fixed values: report tables in order
TABLES = ["executive", "quality", "drivers", "drift", "profile", "summary", "correlation", "relationships", "outliers",
          "insights", "charts", "raw"]


def _lines(df: DataFrame, section: str, position, item, value, detail="") -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(section).alias("section"), as_col(position).cast("bigint").alias("position"),
                     as_col(item).cast("string").alias("item"), as_col(value).cast("string").alias("value"),
                     as_col(detail).cast("string").alias("detail"))


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def executive(r: dict[str, DataFrame]) -> DataFrame:
    """Key figures, headline, top three findings and the role mix."""
    t, q = r["profile_table"], r["quality_overall"]
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    top = r["findings"].orderBy(rank, "rule", "pos").limit(3)
    return _stack([
        _lines(t, "kpi", 0, "Rows", F.format_number("row_count", 0)),
        _lines(t, "kpi", 1, "Columns", F.col("col_count")),
        _lines(t, "kpi", 2, "Missing %", F.concat(F.col("missing_cell_pct").cast("string"), F.lit("%"))),
        _lines(q, "kpi", 3, "Quality score", F.col("overall")),
        _lines(q, "kpi", 4, "Grade", F.col("grade")),
        _lines(r["forest"], "kpi", 5, "Outlier rows", F.col("flagged_count")),
        _lines(r["headline"], "headline", 0, "Headline", F.col("headline")),
        _lines(top, "finding", F.lit(0), F.concat(F.lit("["), F.upper("severity"), F.lit("]")),
               F.concat_ws(" — ", "title", "evidence")),
        _lines(r["role_counts"], "role mix", 0, F.col("role"), F.col("columns")),
    ])


def quality_table(r: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        _lines(r["quality_overall"], "overall", 0, F.col("grade"), F.col("overall")),
        _lines(r["quality_subscores"], "dimension", F.col("position"), F.col("label"), F.col("score"), F.col("weight")),
        _lines(r["quality_issues"], "issue", F.col("place"), F.format_string("%s (%s)", F.col("dimension"), F.col("score").cast("string")),
               F.col("score"), F.col("detail")),
    ])


def driver_table(r: dict[str, DataFrame]) -> DataFrame:
    """Per target: fit, importances, rules and segments."""
    key = F.col("position") * 100
    effect = F.when(F.col("mean").isNotNull(), F.format_string("mean = %s", F.col("mean").cast("string"))).otherwise(
        F.format_string("%s (%.0f%%)", "outcome", F.bround(F.col("confidence") * 100, 0)))
    return _stack([
        _lines(r["driver_targets"], "target", key, F.format_string("%s (%s)", "target", "target_kind"),
               F.format_string("%s = %s", "fit_name", F.col("fit_value").cast("string"))),
        _lines(r["driver_drivers"], "driver", key + F.col("place"), F.col("feature"), F.col("importance"), F.col("target")),
        _lines(r["driver_rules"], "rule", key + F.col("place"), F.col("condition"), effect, F.col("support")),
        _lines(r["driver_segments"], "segment", key + F.col("place"), F.format_string("%s = %s", "column", "value"), F.col("metric"),
               F.format_string("lift %s%%, n=%d", F.coalesce("lift_pct", F.lit(0.0)).cast("string"), F.col("n"))),
        _lines(r["driver_note"], "note", 0, "note", F.col("note")),
    ])


def drift_table(r: dict[str, DataFrame]) -> DataFrame:
    return _stack([_lines(r["drift"], "summary", 0, F.col("status"), F.col("severity"), F.col("summary")),
                   _lines(r["drift_table"], "change", F.col("position"), F.col("change"), F.col("column"), F.col("detail"))])


def profile_sheet(profile: DataFrame) -> DataFrame:
    return profile.select("ordinal", "name", "role", "dtype", "non_null", "null_pct", "unique", *[c for c in ("sample",) if c in profile.columns])


def outlier_table(r: dict[str, DataFrame], listed: int = 60) -> DataFrame:
    rows = r["flagged_rows"].orderBy("r").limit(listed)
    return _stack([
        _lines(r["iqr_outliers"], "fences", F.col("ordinal"), F.col("column"),
               F.format_string("%d (%s%%)", "outlier_count", F.col("outlier_pct").cast("string")),
               F.format_string("[%s, %s] %s", F.col("lower_fence").cast("string"), F.col("upper_fence").cast("string"), F.col("example_values"))),
        _lines(r["forest"], "forest", 0, "flagged rows", F.col("flagged_count")),
        _lines(rows, "forest row", F.col("r"), "row", F.col("r"), F.round("score", 6)),
    ])


def insight_table(r: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        _lines(r["headline"], "headline", 0, "Headline", F.col("headline")),
        _lines(r["findings"], "finding", F.col("rule"), F.col("severity"), F.col("title"), F.col("evidence")),
        _lines(r["recommendations"], "recommendation", F.col("rule"), F.col("priority"), F.col("title"), F.col("detail")),
    ])


def chart_table(r: dict[str, DataFrame]) -> DataFrame:
    return _stack([
        _lines(r["histogram"], "histogram", F.col("bin"), F.col("column"), F.col("centre"), F.col("count")),
        _lines(r["scatter"], "scatter", 0, "point", F.col("x"), F.col("y")),
    ])


def raw_extract(clean: DataFrame, rows: int = RAW_ROWS) -> DataFrame:
    """The first cleaned rows in row order."""
    return clean.orderBy(ROW_ID).limit(rows)


def build(r: dict[str, DataFrame], raw_rows: int = RAW_ROWS) -> dict[str, DataFrame]:
    """The report tables of an analysis."""
    made = {
        "executive": executive(r), "quality": quality_table(r), "drivers": driver_table(r), "drift": drift_table(r),
        "profile": profile_sheet(r["profile_columns"]), "summary": r["summary"].drop("ordinal"), "correlation": r["correlation_matrix"],
        "relationships": r["relationships"].select("left", "right", "kind", "method", "strength", "label"),
        "outliers": outlier_table(r), "insights": insight_table(r), "charts": chart_table(r), "raw": raw_extract(r["clean"], raw_rows),
    }
    return {name: made[name] for name in TABLES}


def write(tables: dict[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> DataFrame:
    """Write every table under run_id=…/table=… and return the manifest (position, table, rows, path)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for i, (name, df) in enumerate(tables.items()):
        target = f"{path}/run_id={run_id}/table={name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(target)
            stored = spark.read.option("header", True).csv(target)
        else:
            writer.parquet(target)
            stored = spark.read.parquet(target)
        rows.append((i, name, stored.count(), target))
    manifest = spark.createDataFrame(rows, "position int, table string, rows bigint, path string")
    manifest.write.mode("overwrite").json(f"{path}/run_id={run_id}/manifest")
    return manifest
