"""What moves a target: shallow trees, split rules and segment lift."""
from __future__ import annotations

import math
import re

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from ..sources.tables import quoted
from .ordering import exact_quantiles
from .roles import BOOLEAN, CATEGORICAL, DATETIME, NUMERIC

# fixed values: name parts that suggest a target
TARGET_HINTS = [
    "revenue", "sales", "amount", "price", "churn", "target", "score", "profit", "margin", "conversion", "rating", "nps",
    "cost", "value", "spend", "ltv", "arr", "retention", "engagement", "usage",
]
NO_TARGET = "No suitable target: need a numeric column with variance or a low-cardinality category."
TOP_VALUES, TOP_CLASSES, MIN_ROWS, MIN_GROUP = 8, 6, 30, 20
OTHER, MISSING = "(other)", "(missing)"


def _text(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def rank_targets(profile: DataFrame, limit: int = 2) -> DataFrame:
    """(column, kind, score) of the most interesting targets, read off the column profile."""
    c = F.col
    hint = F.when(F.lower("name").rlike("|".join(TARGET_HINTS)), 2.0).otherwise(0.0)
    std = c("std") * F.sqrt((c("non_null") - 1) / c("non_null"))
    cv = std / (F.abs("mean") + 1e-9)
    numeric = (c("role") == NUMERIC) & (c("unique") >= 5) & (std > 0)
    classes = (c("role") == BOOLEAN) | ((c("role") == CATEGORICAL) & c("unique").between(2, 6))
    return (profile.withColumn("score", F.when(numeric, hint + F.least(cv, F.lit(3.0))).when(classes, hint + 0.6))
            .where("score is not null")
            .select("ordinal", F.col("name").alias("column"), F.when(c("role") == NUMERIC, "numeric").otherwise("categorical").alias("kind"), "score")
            .orderBy(F.desc("score"), "ordinal").limit(limit))


def top_values(df: DataFrame, cols: list[str], k: int = TOP_VALUES) -> DataFrame:
    """(column, value, n, place) of the most frequent values per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in cols])
    counts = (df.select(F.explode(cells).alias("s")).select("s.*").where("value is not null")
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def features(df: DataFrame, roles: dict[str, str], target: str, quantiles: dict | None = None) -> tuple[list[str], list[Column]]:
    """Feature names and expressions; only medians and the top values of each category reach the driver."""
    numeric = [c for c, r in roles.items() if r == NUMERIC and c != target]
    groups = [c for c, r in roles.items() if r in (CATEGORICAL, BOOLEAN) and c != target]

    def finite(c: str) -> Column:
        v = quoted(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)

    medians = quantiles or exact_quantiles(df.select(*[finite(c).alias(c) for c in numeric]), numeric, [0.5])
    tops: dict[str, list[tuple[str, int]]] = {c: [] for c in groups}
    rows = 0
    if groups:
        for r in top_values(df, groups).collect():
            tops[r["column"]].append((r["value"], r["n"]))
        rows = df.count()
    names, exprs = [], []
    for c, role in roles.items():
        if c == target:
            continue
        if role == NUMERIC:
            names.append(c)
            exprs.append(F.coalesce(finite(c), F.lit(medians[c][0.5]), F.lit(0.0)))
        elif role in (CATEGORICAL, BOOLEAN):
            kept = [v for v, _ in tops[c]]
            rest = rows > sum(n for _, n in tops[c])
            for v in sorted(kept + ([OTHER] if rest else [])):
                names.append(f"{c}_{v}")
                hit = _text(df, c) == v if v in kept else ~F.coalesce(_text(df, c).isin(kept), F.lit(False))
                exprs.append(F.coalesce(hit, F.lit(False)).cast("double"))
        elif role == DATETIME:
            names.append(f"{c} (as timestamp)")
            nanos = F.unix_micros(quoted(c).cast("timestamp")).cast("double") * 1000.0
            exprs.append(F.coalesce(nanos, F.lit(-9.223372036854775808e18)))
    return names, exprs


def leaf_paths(debug: str, names: list[str]) -> list[str]:
    """Condition text of every leaf, left to right, from the printed tree."""
    path: list[tuple[int, str]] = []
    leaves = []
    for line in debug.splitlines():
        depth = len(line) - len(line.lstrip())
        branch = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (.+)\)", line)
        if branch:
            path = [p for p in path if p[0] < depth]
            sign = "≤" if branch[2] == "<=" else ">"
            path.append((depth, f"{names[int(branch[1])]} {sign} {float(branch[3]):.2f}"))
        elif line.strip().startswith("Predict:"):
            leaves.append(" AND ".join(t for d, t in path if d < depth) or "(all rows)")
    return leaves


def fit_tree(df: DataFrame, roles: dict[str, str], target: str, kind: str, quantiles: dict | None = None) -> dict | None:
    """Depth-3 tree on all labelled rows: fit metric, importances and ranked leaf rules; None if it cannot be fitted."""
    names, exprs = features(df, roles, target, quantiles)
    if not names:
        return None
    if kind == "numeric":
        label, classes = quoted(target).cast("double"), None
        label = F.when(~F.isnan(label), label)
    else:
        y = F.coalesce(_text(df, target), F.lit(MISSING))
        found = (df.groupBy(y.alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(TOP_CLASSES).collect())
        classes = [r["y"] for r in found]
        if len(classes) < 2:
            return None
        label = F.lit(None).cast("double")
        for i, v in enumerate(classes):
            label = F.when(y == v, float(i)).otherwise(label)
    data = df.select(label.alias("label"), *[e.alias(f"f{i}") for i, e in enumerate(exprs)]).where("label is not null")
    n = data.count()
    if n < MIN_ROWS:
        return None
    ready = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features").transform(spread(data, n)).select("label", "features")
    common = dict(maxDepth=3, minInstancesPerNode=max(MIN_GROUP, n // 50), maxBins=256, seed=0, leafCol="leaf")
    tree = (DecisionTreeRegressor(**common) if classes is None else DecisionTreeClassifier(**common)).fit(ready)
    placed = tree.transform(ready)
    paths = leaf_paths(tree.toDebugString, names)
    importances = [(names[i], float(tree.featureImportances[i])) for i in range(len(names))]
    drivers = [(f, round(v, 4)) for f, v in sorted(importances, key=lambda t: -t[1]) if v > 0][:6]
    if classes is None:
        leaves = placed.groupBy("leaf").agg(
            F.count("*").alias("n"), F.avg("label").alias("mean"), F.var_pop("label").alias("var")).collect()
        grand = sum(r["n"] * r["mean"] for r in leaves) / n
        sse = sum(r["n"] * r["var"] for r in leaves)
        sst = sse + sum(r["n"] * (r["mean"] - grand) ** 2 for r in leaves)
        metric = ("R²", round(1 - sse / sst, 3) if sst else 1.0)
        centre = sum(round(r["mean"], 3) for r in leaves) / len(leaves)
        ranked = sorted(leaves, key=lambda r: (-abs(round(r["mean"], 3) - centre) * math.log1p(r["n"]), r["leaf"]))[:3]
        rules = [(paths[int(r["leaf"])], None, round(r["mean"], 3), None, r["n"]) for r in ranked]
    else:
        cells = placed.groupBy("leaf", "label").agg(F.count("*").alias("n")).collect()
        hits = placed.where("label = prediction").count()
        metric = ("accuracy", round(hits / n, 3))
        by_leaf: dict[float, list] = {}
        for r in cells:
            by_leaf.setdefault(r["leaf"], []).append((r["n"], -r["label"]))
        found = []
        for leaf, counts in by_leaf.items():
            top, negative = max(counts)
            support = sum(c for c, _ in counts)
            found.append((paths[int(leaf)], classes[int(-negative)], None, round(top / support, 3), support))
        rules = sorted(found, key=lambda r: (-r[3], -r[4]))[:3]
    return {"metric": metric, "drivers": drivers, "rules": rules, "rows": n}


def segments(df: DataFrame, roles: dict[str, str], target: str, kind: str, limit: int = 10) -> DataFrame:
    """(place, column, value, metric, lift_pct, n) per category value, strongest lift first."""
    schema = "place int, column string, value string, metric double, lift_pct double, n bigint"
    groups = [c for c, r in roles.items() if r in (CATEGORICAL, BOOLEAN) and c != target]
    if not groups:
        return df.sparkSession.createDataFrame([], schema)
    if kind == "numeric":
        y = quoted(target).cast("double")
        y = F.when(~F.isnan(y), y)
    else:
        known = F.coalesce(_text(df, target), F.lit(MISSING))
        top = df.groupBy(known.alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").first()
        if top is None:
            return df.sparkSession.createDataFrame([], schema)
        y = (known == top["y"]).cast("double")
    whole = df.agg(F.count("*").alias("rows"), F.avg(y).alias("mean")).first()
    least = max(MIN_GROUP, int(0.01 * whole["rows"]))
    overall = F.lit(whole["mean"])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), _text(df, c).alias("value")) for i, c in enumerate(groups)])
    grouped = (df.select(y.alias("y"), F.explode(cells).alias("s")).select("y", "s.*").where("value is not null")
               .groupBy("i", "column", "value").agg(F.avg("y").alias("mean"), F.count("y").alias("n")).where(F.col("n") >= least))
    lift = F.bround(F.try_divide(100 * (F.col("mean") - overall), overall), 1)
    strongest = [F.desc(F.coalesce(F.abs("lift_pct"), F.lit(0.0))), F.col("i"), F.col("value")]
    top = (grouped.withColumn("lift_pct", lift).withColumn("metric", F.bround("mean", 3)).orderBy(*strongest).limit(limit))
    # at most ``limit`` rows are numbered
    return top.select((F.row_number().over(W.orderBy(*strongest)) - 1).alias("place"), "column", "value", "metric", "lift_pct", "n")


def analyse_drivers(df: DataFrame, roles: dict[str, str], profile: DataFrame, quantiles: dict | None = None) -> dict[str, DataFrame]:
    """targets, drivers, rules, segments as tables; an empty target list comes with a note row."""
    spark = df.sparkSession
    picked = rank_targets(profile).collect()
    targets, drivers, rules, lifts = [], [], [], None
    seg_schema = "position int, target string, place int, column string, value string, metric double, lift_pct double, n bigint"
    for position, t in enumerate(picked):
        fitted = fit_tree(df, roles, t["column"], t["kind"], quantiles)
        if fitted is None:
            continue
        name, value = fitted["metric"]
        targets.append((position, t["column"], t["kind"], name, float(value), fitted["rows"]))
        drivers += [(position, t["column"], i, f, v) for i, (f, v) in enumerate(fitted["drivers"])]
        rules += [(position, t["column"], i, *r) for i, r in enumerate(fitted["rules"])]
        part = segments(df, roles, t["column"], t["kind"]).select(
            F.lit(position).alias("position"), F.lit(t["column"]).alias("target"), "place", "column", "value", "metric", "lift_pct", "n")
        lifts = part if lifts is None else lifts.unionByName(part)
    return {
        "targets": spark.createDataFrame(targets, "position int, target string, target_kind string, fit_name string, fit_value double, rows bigint"),
        "drivers": spark.createDataFrame(drivers, "position int, target string, place int, feature string, importance double"),
        "rules": spark.createDataFrame(rules, "position int, target string, place int, condition string, outcome string, mean double, confidence double, support bigint"),
        "segments": lifts if lifts is not None else spark.createDataFrame([], seg_schema),
        "note": spark.createDataFrame([] if picked else [(NO_TARGET,)], "note string"),
    }
