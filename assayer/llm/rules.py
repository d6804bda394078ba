"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, compiled into column expressions.

Shallow trees are grown on a bounded sample of labelled texts, every path from a root to a node becomes a rule, a lasso logistic
regression over the rules keeps a few of them, and what is kept is a sum of ``CASE WHEN`` terms that Spark evaluates where the rows are.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

STATISTICS = ("log_chars", "mean_word", "distinct_words", "repeated_words", "short_words", "upper", "symbols", "digits", "bars",
              "sentence_ends", "distinct_lines")
TREES, DEPTH, PENALTY = 24, 3, 0.002


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one double column ``__<name>`` per statistic; a null or empty text has zeros, apart from distinct shares of one."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # arrays and counts that several statistics use are columns of their own
    parts = df.withColumns({
        "__words": F.filter(F.split(text, r"\s+"), lambda w: w != ""), "__lines": F.split(text, "\n"), "__chars": F.length(text).cast("double"),
        "__capitals": F.length(F.regexp_replace(text, r"[^A-ZÀ-Þ]+", "")), "__signs": F.regexp_replace(text, r"[^#$%&*|!@~^<>{}=+\\/_.?0-9]+", "")})
    words, n = F.col("__words"), F.greatest(F.size("__words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("__chars"), F.lit(1.0))

    def signs(pattern: str) -> Column:
        return F.length(F.regexp_replace("__signs", pattern, ""))

    found = {
        "log_chars": F.log1p("__chars"), "mean_word": F.col("__chars") / n,
        "distinct_words": F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / n).otherwise(1.0),
        "repeated_words": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b),
                                          lambda same: same)) / n,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "upper": F.col("__capitals") / chars, "symbols": signs("[.?0-9]+") / chars, "digits": signs("[^0-9]+") / chars, "bars": signs("[^|]+") / n,
        "sentence_ends": signs("[^.?]+") / n, "distinct_lines": F.size(F.array_distinct("__lines")) / F.size("__lines")}
    return parts.withColumns({f"__{k}": found[k].cast("double") for k in STATISTICS}).drop("__words", "__lines", "__chars", "__capitals", "__signs")


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (statistic, lower or None, upper or None), lower exclusive, upper inclusive."""
    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            value = F.col(f"__{name}")
            out = out & (value > low if low is not None else F.lit(True)) & (value <= high if high is not None else F.lit(True))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{'' if low is None else f'{low:.6g} < '}{name}{'' if high is None else f' <= {high:.6g}'}"
                            for name, low, high in self.bounds)


def _paths(node, bounds: dict, out: list) -> None:
    """Rules for all nodes below the root of a fitted tree."""
    if bounds:
        out.append(Rule(tuple((k, *v) for k, v in sorted(bounds.items()))))
    if node.subtreeDepth() == 0:
        return
    name, cut = STATISTICS[node.split().featureIndex()], node.split().threshold()
    low, high = bounds.get(name, (None, None))
    _paths(node.leftChild(), bounds | {name: (low, cut)}, out)
    _paths(node.rightChild(), bounds | {name: (cut, high)}, out)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, df: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``df`` with the probability of label 1; all rows and columns stay."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        # the row travels as one value, so that no name of it can clash
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
        scored = statistics(df.select(row, F.col(f"`{text_col}`").alias("__text")), "__text")
        return scored.select("__row.*", (1 / (1 + F.exp(-total))).alias(name))


def fit(sample: DataFrame, seed: int = 7) -> RuleEnsemble:
    """Ensemble from ``id, text, label`` rows (a bounded sample, see ``labelled.sample``).

    Without two classes in the sample the score is constant: the share of label 1, one half without rows.
    """
    table = materialise(statistics(sample).select("label", *[f"__{k}" for k in STATISTICS]), "rules")
    n, ones = table.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = 0.5 if not n else min(max(ones / n, 0.01), 0.99)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    table = table.coalesce(4)
    vectors = VectorAssembler(inputCols=[f"__{k}" for k in STATISTICS], outputCol="features").transform(table)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=5).fit(vectors)
    found: list[Rule] = []
    for tree in forest.trees:
        _paths(tree._call_java("rootNode"), {}, found)
    rules = sorted(set(found), key=str)
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        table.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]))
    model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(flags)
    weights = tuple((r, float(w)) for r, w in zip(rules, model.coefficients) if abs(w) > 1e-6)
    return RuleEnsemble(float(model.intercept), weights)
