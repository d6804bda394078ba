"""Univariate fences and an isolation forest."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import ROW_ID
from ..session import materialise, spread
from .ordering import exact_quantiles
from .stats import as_numbers, column_ranges

MIN_FENCE_ROWS = 8
MIN_FOREST_ROWS = 20
TREES, TREE_ROWS, CONTAMINATION = 200, 256, 0.02
#: Rows that all trees of a forest draw from.
POOL = 4 * TREES * TREE_ROWS
FLAGGED_LIMIT = 200


def fences(df: DataFrame, cols: list[str], quantiles: dict | None = None, ranges: dict | None = None) -> dict[str, tuple[float, float]]:
    """Tukey fences of columns with at least eight values."""
    ranges = ranges or column_ranges(df, cols)
    used = [c for c in cols if ranges[c]["count"] >= MIN_FENCE_ROWS]
    quantiles = quantiles or exact_quantiles(df, used, [0.25, 0.75], ranges=ranges)
    out = {}
    for c in used:
        q1, q3 = quantiles[c][0.25], quantiles[c][0.75]
        out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def iqr_outliers(df: DataFrame, cols: list[str], examples: bool = True, row_id: str = ROW_ID,
                 limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(ordinal, column, fences, outlier_count, outlier_pct[, example_values]) per column."""
    limits = limits if limits is not None else fences(df, cols)
    used = list(limits)
    schema = ("ordinal int, column string, lower_fence double, upper_fence double, outlier_count bigint, "
              "outlier_pct double" + (", example_values string" if examples else ""))
    if not used:
        return df.sparkSession.createDataFrame([], schema)
    x = as_numbers(df, used, [F.col(row_id).alias("r")] if examples else [])
    outside = [(F.col(f"c{i}") < limits[c][0]) | (F.col(f"c{i}") > limits[c][1]) for i, c in enumerate(used)]
    counted = x.agg(*[e for i in range(len(used)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.count(F.when(outside[i], 1)).alias(f"o{i}"))])
    table = counted.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(limits[c][0]).alias("lower_fence"),
        F.lit(limits[c][1]).alias("upper_fence"), F.col(f"o{i}").alias("outlier_count"),
        F.round(100.0 * F.col(f"o{i}") / F.col(f"n{i}"), 2).alias("outlier_pct")) for i, c in enumerate(used)])))
    if not examples:
        return table
    hits = (x.select("r", F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.when(outside[i], F.col(f"c{i}")).alias("v"))
                                             for i in range(len(used))]))).where("v is not null"))
    # the limit runs per map task before the exchange
    top = hits.withColumn("place", F.row_number().over(W.partitionBy("ordinal").orderBy("r"))).where("place <= 5")
    listed = top.groupBy("ordinal").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "v"))), lambda s: s["v"].cast("string")), ", ").alias("example_values"))
    return table.join(F.broadcast(listed), "ordinal", "left").withColumn(
        "example_values", F.coalesce("example_values", F.lit("")))


def forest_columns(df: DataFrame, cols: list[str], ranges: dict | None = None) -> list[str]:
    ranges = ranges or column_ranges(df, cols)
    return [c for c in cols if ranges[c]["count"] > MIN_FOREST_ROWS]


def forest_input(df: DataFrame, cols: list[str], row_id: str = ROW_ID, ranges: dict | None = None,
                 quantiles: dict | None = None) -> tuple[list[str], DataFrame]:
    """Columns with enough values, gaps filled with the column median, as (row id, c0, c1, …).

    Medians are sought for columns with gaps only; the others have as many values as the table has rows.
    """
    ranges = ranges or column_ranges(df, cols)
    used = forest_columns(df, cols, ranges)
    rows = df.count()
    gappy = [c for c in used if ranges[c]["count"] < rows]
    medians = quantiles or exact_quantiles(df, gappy, [0.5], ranges=ranges)
    x = as_numbers(df, used, [F.col(row_id).alias("r")])
    return used, x.select("r", *[F.coalesce(f"c{i}", F.lit(medians[c][0.5])).alias(f"c{i}") if c in gappy else F.col(f"c{i}") for i, c in enumerate(used)])


def tree_samples(x: DataFrame, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0, n: int | None = None) -> DataFrame:
    """(tree, features): ``rows`` random rows per tree, chosen by hashes so that partitioning does not matter.

    One scheme for every size: a row enters the pool when its hash is below POOL / n, a row of the pool enters a tree when its hash
    with the tree's number is below the share that leaves half as many again as wanted, and each tree cuts that to ``rows``. A row
    meets only trees that it enters, and no step sees more than the pool in one place.
    """
    features = F.array(*[c for c in x.columns if c != "r"]).alias("features")
    n = x.count() if n is None else n
    scale = 1 << 40
    pooled = min(1.0, POOL / max(n, 1))
    share = min(1.0, (rows * 1.5 + 60) / max(n * pooled, 1))

    def drawn(*key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col("r"), *key), F.lit(scale))

    pool = x.select("r", features).where(drawn() < int(pooled * scale))
    entered = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) < int(share * scale))
    picked = pool.select("r", "features", F.explode(entered).alias("tree")).withColumn("h", drawn(F.col("tree")))
    at = F.row_number().over(W.partitionBy("tree").orderBy("h", "r"))
    return picked.withColumn("at", at).where(F.col("at") <= rows).select("tree", "features")


def _grower(seed: int):
    def grow(pdf):
        """One isolation tree as rows (tree, node, feature, threshold, left, right, path)."""
        import numpy as np
        import pandas as pd

        tree = int(pdf["tree"].iloc[0])
        points = np.array(pdf["features"].tolist(), dtype=float)
        points = points[np.lexsort(points.T)]
        rng = np.random.default_rng([seed, tree])
        height = int(np.ceil(np.log2(max(len(points), 2))))

        def expected(n):
            if n <= 1:
                return 0.0
            return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n

        nodes, stack = [[tree, 0, -1, 0.0, -1, -1, 0.0]], [(0, points, 0)]
        while stack:
            at, rows, depth = stack.pop()
            lows, highs = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(highs > lows)
            if len(rows) <= 1 or depth >= height or len(usable) == 0:
                nodes[at][6] = depth + expected(len(rows))
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(lows[feature], highs[feature]))
            left = rows[:, feature] <= cut
            a, b = len(nodes), len(nodes) + 1
            nodes[at][2:6] = [feature, cut, a, b]
            nodes += [[tree, a, -1, 0.0, -1, -1, 0.0], [tree, b, -1, 0.0, -1, -1, 0.0]]
            stack += [(a, rows[left], depth + 1), (b, rows[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return grow


def grow_forest(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Isolation trees (Liu, Ting and Zhou, 2008), one small group of sampled rows per tree."""
    return samples.groupBy("tree").applyInPandas(
        _grower(seed), "tree int, node int, feature int, threshold double, left int, right int, path double")


def level_tables(trees: list, columns: int) -> tuple[list, list]:
    """The cuts of each column over all trees, in order, and of each tree its levels and the path lengths below the last one.

    A level has a word for each place: the number of its cut, and in the lowest bits its column. Place ``j`` leads to 2j or 2j + 1 of the
    next level, so all rows walk all levels in step; below a leaf every place has its path.
    """
    import numpy as np

    trees = [tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")) for t in trees]
    cuts = [np.unique(np.concatenate([threshold[feature == i] for feature, threshold, *_ in trees])) for i in range(columns)]
    bits, forest = columns.bit_length(), []
    for feature, threshold, left, right, path in trees:
        word = np.zeros(len(feature), dtype=np.int64)
        for i in range(columns):
            word[feature == i] = (np.searchsorted(cuts[i], threshold[feature == i]) << bits) + i
        levels, level = [], np.zeros(1, dtype=np.int64)
        while (feature[level] >= 0).any():
            inner = feature[level] >= 0
            levels.append(word[level])
            level = np.stack([np.where(inner, left[level], level), np.where(inner, right[level], level)], axis=1).ravel()
        forest.append((levels, path[level]))
    return cuts, forest


def _scorer(shared, norm: float):
    def score(batches):
        import numpy as np
        import pandas as pd

        cuts, forest = shared.value
        bits, block = len(cuts).bit_length(), 4_096  # the places, words and cells of a block stay in a core's cache
        buffers = np.empty((4, block), dtype=np.int64)
        for pdf in batches:
            # a value is at most a cut when at most as many cuts are below it as the cut's number
            below = np.stack([np.searchsorted(c, pdf[f"c{i}"].to_numpy(dtype=float)) for i, c in enumerate(cuts)], axis=1).astype(np.int64)
            depth = np.zeros(len(below))
            for start in range(0, len(below), block):
                cells = below[start:start + block].ravel()
                n = len(cells) // len(cuts)
                at, word, cell, own = buffers[:, :n]
                rows = np.arange(n, dtype=np.int64) * len(cuts)
                for levels, path in forest:
                    at[:] = 0
                    for words in levels:
                        np.take(words, at, out=word, mode="clip")
                        np.bitwise_and(word, (1 << bits) - 1, out=cell)
                        cell += rows
                        np.take(cells, cell, out=own, mode="clip")
                        word >>= bits
                        word -= own
                        word >>= 63  # -1 where the value is above the cut, else 0
                        at += at
                        at -= word
                    depth[start:start + n] += path[at]
            yield pd.DataFrame({"r": pdf["r"], "score": np.power(2.0, -depth / len(forest) / norm)})

    return score


def anomaly_scores(df: DataFrame, cols: list[str], row_id: str = ROW_ID, trees: int = TREES,
                   seed: int = 0, ranges: dict | None = None, quantiles: dict | None = None) -> tuple[list[str], DataFrame | None]:
    """Anomaly score per row (higher is stranger): (row id, score), written once to the checkpoint folder.

    Only the grown trees (at most ``trees`` x 511 places) are broadcast; rows are scored where they are.
    """
    import numpy as np

    used, x = forest_input(df, cols, row_id, ranges, quantiles)
    if len(used) < 2:
        return used, None
    spark = df.sparkSession
    rows = x.count()
    x = spread(x, rows)
    nodes = grow_forest(tree_samples(x, trees, TREE_ROWS, seed, rows), seed).toPandas().sort_values(["tree", "node"])
    forest = level_tables([g for _, g in nodes.groupby("tree")], len(used))
    sampled = min(TREE_ROWS, rows)
    norm = 2.0 * (np.log(sampled - 1.0) + 0.5772156649015329) - 2.0 * (sampled - 1.0) / sampled
    shared = spark.sparkContext.broadcast(forest)
    return used, materialise(x.mapInPandas(_scorer(shared, float(norm)), "r bigint, score double"))


def flag_anomalies(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """(r, score, flagged): flagged above the (1 - contamination) quantile of the scores."""
    cut = exact_quantiles(scores, ["score"], [1.0 - contamination])["score"][1.0 - contamination]
    return scores.withColumn("flagged", F.col("score") > F.lit(cut))


def flagged_rows(flags: DataFrame, limit: int = FLAGGED_LIMIT) -> DataFrame:
    """The first flagged rows in row order."""
    return flags.where("flagged").orderBy("r").limit(limit).select("r", "score")
