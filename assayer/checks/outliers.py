"""Fences and the isolation forest."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as O
from . import check, keyed, rounded, table
from .statistics import LINE
from .verbs import GAPPY, _gappy


def fence_sql(source: str, cols: list[str], key: str | None = None) -> str:
    parts = []
    for i, c in enumerate(cols):
        example = (f", coalesce((select string_agg(v::varchar, ', ' order by k) from (select {c}::double as v, {key} as k from {source}, q where {c} < lo or {c} > hi "
                   f"order by k limit 5)), '') as example_values" if key else "")
        parts.append(f"(with q as (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi, "
                     f"count({c}) as n from {source}) select {i} as ordinal, '{c}' as column, round(any_value(lo), 6) as lower_fence, round(any_value(hi), 6) as upper_fence, "
                     f"count(*) filter ({c} < lo or {c} > hi) as outlier_count, round(100.0 * count(*) filter ({c} < lo or {c} > hi) / any_value(n), 2) as outlier_pct{example} "
                     f"from {source}, q having any_value(n) >= 8)")
    return " union all ".join(parts)


check("iqr_outliers_events", fence_sql(GAPPY, ["user_id", "value"], "event_id"))(
    lambda s, d: rounded(O.iqr_outliers(_gappy(s, d).withColumn("_row_id", F.col("event_id")), ["user_id", "value"])))
check("iqr_outliers_lineitem", fence_sql("lineitem", LINE))(
    lambda s, d: rounded(O.iqr_outliers(table(s, d, "lineitem"), LINE, examples=False)))
check("iqr_outliers_documents", fence_sql("documents", ["n_chars"], "doc_id"))(
    lambda s, d: rounded(O.iqr_outliers(keyed(s, d, "documents", "doc_id"), ["n_chars"])))
check("forest_input", f"select event_id as r, user_id::double as c0, coalesce(value, (select quantile_cont(value, 0.5) from {GAPPY})) as c1 from {GAPPY}")(
    lambda s, d: O.forest_input(_gappy(s, d).withColumn("_row_id", F.col("event_id")), ["user_id", "value"])[1])


def _flags(s, d):
    _, scores = O.anomaly_scores(keyed(s, d, "events", "event_id"), ["user_id", "value"])
    return O.flag_anomalies(scores)


check("iforest_events")(lambda s, d: rounded(_flags(s, d)))
check("iforest_flagged_rows")(lambda s, d: rounded(O.flagged_rows(_flags(s, d))))
check("iforest_flagged_share", "select count(*) as rows, (count(*) - 1 - floor(0.98 * (count(*) - 1)))::bigint as flagged, true as in_range, true as above from events")(
    lambda s, d: (lambda f: f.agg(F.count("*").alias("rows"), F.count_if("flagged").alias("flagged"), F.bool_and((F.col("score") > 0) & (F.col("score") <= 1)).alias("in_range"),
                                  (F.min(F.when(F.col("flagged"), F.col("score"))) > F.max(F.when(~F.col("flagged"), F.col("score")))).alias("above")))(_flags(s, d)))
