import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer import session
from assayer.operators import associations, charts, drift, drivers, outliers, profile, quality, roles, stats, verbs
from assayer.operators.digest import _first_seen, column_facts, facts_frame, first_values
from assayer.plans import report, workflow


def inferred(df, **kw):
    return roles.collect_roles(roles.infer_roles(df, **kw))


def test_roles_of_text_columns(frame):
    n = 60
    rows = [(str(i), f"u{i}", "Yes" if i % 2 else "no", "true", "0" if i % 3 else "1.0", f"2024-01-{i % 28 + 1:02d}", "x" if i % 5 else str(i),
             None, "abc"[i % 3], f"word {i} of many") for i in range(n)]
    schema = ", ".join(f"{c} string" for c in ("order_id", "user_code", "paid", "only_true", "flag", "day", "mostly_text", "blank", "cat", "txt"))
    got = inferred(frame(rows, schema), reader_types=True)
    assert got == {"order_id": "id", "user_code": "id", "paid": "boolean", "only_true": "boolean", "flag": "boolean", "day": "datetime",
                   "mostly_text": "categorical", "blank": "empty", "cat": "categorical", "txt": "text"}


def test_numeric_share_and_thresholds(frame):
    rows = [(str(i) if i % 10 < 8 else "junk", str(i) if i % 10 < 7 else "junk", "20240103" if i % 2 else "20240104") for i in range(100)]
    got = inferred(frame(rows, "a string, b string, c string"), reader_types=True)
    assert got == {"a": "numeric", "b": "text", "c": "numeric"}


def test_three_spellings_are_not_boolean_until_cleaned(frame):
    df = frame([("yes",), (" yes",), ("no",)] * 10, "a string")
    known = roles.infer_and_clean(df, reader_types=True)
    assert known.raw_roles == {"a": "categorical"} and known.roles == {"a": "boolean"}


def test_cleaning(frame):
    df = frame([(" 1.5 ", " a ", "Y", "2024-01-02"), ("bad", None, "n", "bad"), (None, None, None, None)], "num string, cat string, flag string, day string")
    out = roles.clean(df, {"num": "numeric", "cat": "categorical", "flag": "boolean", "day": "datetime"}).orderBy("_row_id").collect()
    assert len(out) == 2
    assert (out[0]["num"], out[0]["cat"], out[0]["flag"]) == (1.5, "a", True) and out[0]["day"].year == 2024
    assert (out[1]["num"], out[1]["cat"], out[1]["flag"], out[1]["day"]) == (None, None, False, None)


def test_profile_counts_and_samples(frame):
    df = frame([("b", 1.0), ("a", None), ("b", 3.0), (None, 3.0), ("b", 1.0)], "s string, x double")
    cols = {r["name"]: r for r in profile.profile_columns(df, {"s": "categorical", "x": "numeric"}, samples=True).collect()}
    assert (cols["s"]["non_null"], cols["s"]["null_pct"], cols["s"]["unique"], cols["s"]["sample"]) == (4, 20.0, 2, "b, a")
    assert (cols["x"]["min"], cols["x"]["max"], cols["x"]["mean"], cols["x"]["sample"]) == (1.0, 3.0, 2.0, "1.0, 3.0")
    t = profile.profile_table(df).first()
    assert (t["row_count"], t["rows_with_missing"], t["missing_cell_pct"], t["duplicate_rows"]) == (5, 2, 20.0, 1)


def test_null_position_matters_for_duplicates(frame):
    df = frame([("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_long_texts_are_told_apart_whole(frame):
    base = "word " * 1000
    df = frame([(base + "x",), (base + "y",), (base + "x ",), (base.upper() + "X",)], "t string")
    f = column_facts(df).first()
    assert (f["distinct"], f["distinct_trimmed"], f["distinct_normalised"], f["trim_changed"]) == (4, 3, 2, 1)


@pytest.mark.parametrize("k", [1, 5])
def test_first_values_whatever_order_rows_come_in(spark, k):
    rng = np.random.default_rng(6)
    n = 4000
    pdf = pd.DataFrame({"_row_id": rng.permutation(n), "a": rng.integers(0, 3, n), "b": rng.integers(0, 10 ** 6, n).astype(float),
                        "t": [None if x < 0.3 else f"long text {'y' * 70} {int(x * 50)}" for x in rng.random(n)], "late": "x"})
    pdf.loc[pdf["_row_id"] > 3000, "late"] = [f"v{i % 9}" for i in pdf.loc[pdf["_row_id"] > 3000, "_row_id"]]
    df = spark.createDataFrame(pdf).repartition(6)
    got = {}
    for r in first_values(df, k).collect():
        got.setdefault(r["ordinal"], []).append((r["first_row"], r["value"]))
    names = [c for c in df.columns if c != "_row_id"]
    ordered = pdf.sort_values("_row_id")
    for i, c in enumerate(names):
        want = ordered.dropna(subset=[c]).drop_duplicates(c).head(k)
        assert sorted(got[i]) == [(r["_row_id"], str(r[c])) for _, r in want.iterrows()]
    per_task = _first_seen(df, [(i, F.col(c)) for i, c in enumerate(names)], k).count()
    assert per_task <= 6 * len(names) * k


def test_summary_and_constant_column(frame):
    df = frame([(float(i), 4.0, None) for i in range(10)], "a double, b double, c double")
    got = {r["column"]: r for r in stats.numeric_summary(df, ["a", "b", "c"], normality=True).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["p25"] == 2.25 and got["a"]["median"] == 4.5 and got["a"]["kurtosis"] == pytest.approx(-1.2)
    assert got["b"]["std"] == 0.0 and got["b"]["skew"] is None and got["b"]["cv"] == 0.0


def test_correlation_with_gaps_and_constants(frame):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    pdf["d"] = 5.0
    pdf.loc[::3, "b"] = np.nan
    pdf["c"] += pdf["a"]
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.to_numpy()]
    df = frame(rows, "a double, b double, c double, d double")
    want = pdf.corr()
    for r in stats.correlation_pairs(df, list("abcd")).collect():
        w = want.loc[r["a"], r["b"]]
        assert (r["r"] is None) if math.isnan(w) else r["r"] == pytest.approx(w, abs=1e-12)
    for r in associations.spearman_pairs(df, list("abc")).collect():
        a, b = "abc"[r["i"]], "abc"[r["j"]]
        both = pdf[[a, b]].dropna()
        assert r["rho"] == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-12)


def _gappy_frame(frame, n=300, endless=False):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 12, size=(n, 6)).astype(float), columns=list("abcdef"))
    pdf["f"] = rng.normal(size=n)
    pdf.loc[rng.random(n) < 0.3, ["b", "c"]] = np.nan
    pdf.loc[::4, "d"] = np.nan
    pdf["e"] += 2 * pdf["a"]
    if endless:
        pdf.loc[3, "a"] = np.inf
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return pdf, frame(rows, ", ".join(f"{c} double" for c in "abcdef")).repartition(7)


@pytest.mark.parametrize("endless", [False, True])
def test_blocks_of_products_agree_with_pair_sums(frame, endless):
    pdf, df = _gappy_frame(frame, endless=endless)
    pdf["g"] = 2.0
    df = df.withColumn("g", F.lit(2.0))
    want, cov = pdf.corr(), pdf.cov()
    wide, narrow = (sorted(stats.correlation_pairs(df, list("abcdefg"), per_pass=n).collect()) for n in (0, 99))
    assert len(wide) == 21 and [r[:5] for r in wide] == [r[:5] for r in narrow]
    for r in wide + narrow:
        w, c = want.loc[r["a"], r["b"]], cov.loc[r["a"], r["b"]]
        assert r["n"] == np.isfinite(pdf[[r["a"], r["b"]]]).all(axis=1).sum()
        assert (r["r"] is None) if math.isnan(w) else r["r"] == pytest.approx(w, abs=1e-12)
        if not math.isnan(c):
            assert r["cov"] == pytest.approx(c, abs=1e-10)


def test_blocks_need_one_scan_and_no_shuffle_of_rows(frame):
    _, df = _gappy_frame(frame)
    plan = stats.correlation_pairs(df, list("abcdef"), per_pass=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") <= 2
    assert stats.correlation_pairs(df.limit(0), list("ab"), per_pass=0).count() == 0


@pytest.mark.parametrize("more", [{}, {"rows_per_slice": 3, "lookup_rows": 2}, {"most_masks": 1}, {"lookup_rows": 0}])
def test_spearman_ranks_the_complete_rows_of_each_pair(frame, more):
    pdf, df = _gappy_frame(frame)
    got = {(r["i"], r["j"]): r["rho"] for r in associations.spearman_pairs(df, list("abcdef"), **more).collect()}
    assert len(got) == 15
    for (i, j), rho in got.items():
        both = pdf[["abcdef"[i], "abcdef"[j]]].dropna()
        assert rho == pytest.approx(both.iloc[:, 0].rank().corr(both.iloc[:, 1].rank()), abs=1e-12)
    if not more:
        matrix = {r["column"]: r for r in verbs.corr(df, list("abcdef"), "spearman", decimals=None).collect()}
        want = pdf.corr("spearman")
        assert all(matrix[a][b] == pytest.approx(want.loc[a, b], abs=1e-12) for a in "abcdef" for b in "abcdef")


def test_eta_and_cramer(frame):
    df = frame([("x", "p", 1.0), ("x", "p", 1.0), ("y", "q", 5.0), ("y", "q", 5.0), (None, "q", 9.0), ("z", None, None)], "a string, b string, v double")
    assert associations.correlation_ratios(df, ["a"], ["v"]).first()["eta"] == pytest.approx(1.0)
    assert associations.cramers_v(df, ["a", "b"]).first()["v"] == pytest.approx(1.0)
    one_group = frame([("x", 1.0), ("x", 2.0), ("x", 3.0)], "a string, v double")
    assert associations.correlation_ratios(one_group, ["a"], ["v"]).first()["eta"] == 0.0


def test_iqr_needs_eight_values(frame):
    rows = [(float(i), float(i) if i < 7 else None) for i in range(8)] + [(100.0, None)]
    got = outliers.iqr_outliers(frame(rows, "a double, b double"), ["a", "b"]).collect()
    assert [(r["column"], r["outlier_count"], r["example_values"]) for r in got] == [("a", 1, "100.0")]


def test_forest_ranks_injected_outliers_first_under_any_partitioning(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(1500, 2))] + [(15.0, -15.0), (-20.0, 18.0), (25.0, 25.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a double, b double, _row_id bigint")
    runs = []
    for parts in (1, 7):
        _, scores = outliers.anomaly_scores(df.repartition(parts), ["a", "b"])
        flags = outliers.flag_anomalies(scores)
        runs.append({r["r"]: (round(r["score"], 9), r["flagged"]) for r in flags.collect()})
    assert runs[0] == runs[1]
    top = sorted(runs[0], key=lambda k: -runs[0][k][0])[:3]
    assert set(top) == {1500, 1501, 1502}
    assert 0.015 <= sum(f for _, f in runs[0].values()) / len(rows) <= 0.025


@pytest.mark.parametrize("pool", [1_000_000, 6_000])
def test_forest_samples_alike_at_every_size(spark, monkeypatch, pool):
    monkeypatch.setattr(outliers, "POOL", pool)
    x = spark.range(30_000).select(F.col("id").alias("r"), F.rand(1).alias("c0"), F.rand(2).alias("c1"))
    sizes = outliers.tree_samples(x, trees=20, rows=64).groupBy("tree").count().collect()
    assert len(sizes) == 20 and {r["count"] for r in sizes} == {64}
    again = outliers.tree_samples(x.repartition(7), trees=20, rows=64)
    assert outliers.tree_samples(x, trees=20, rows=64).exceptAll(again).count() == 0


def test_quality_of_a_clean_and_a_dirty_column(frame):
    df = frame([("1", "a"), ("2", "A "), ("x", "b"), ("4", "b"), ("5", None), ("6", "b")], "n string, c string")
    known = roles.infer_and_clean(df, reader_types=True)
    cols = {r["column"]: r for r in quality.column_quality(
        facts_frame(df.sparkSession, known.raw_facts), profile.role_table(known.clean, known.roles)).collect()}
    assert cols["n"]["validity"] == pytest.approx(5 / 6) and cols["c"]["consistency"] == pytest.approx(2 / 3)
    assert cols["c"]["confidence"] == pytest.approx(0.0)


def test_drift_kinds_and_severity(frame):
    def prints(rows, schema, r):
        df = frame(rows, schema)
        return drift.fingerprint(profile.profile_columns(df, r), profile.profile_table(df))
    old = prints([("a", 1.0)] * 10, "x string, y double", {"x": "categorical", "y": "numeric"})
    new = prints([(None, "q")] * 8, "x string, z string", {"x": "text", "z": "categorical"})
    kinds = {(r["kind"], r["column"]) for r in drift.changes(old, new).collect()}
    assert kinds == {("added", "z"), ("removed", "y"), ("role_change", "x"), ("null_spike", "x")}
    row = drift.compare(old, new).first()
    assert row["severity"] == "critical" and row["row_delta_pct"] == -20.0
    assert row["summary"] == ("Since the last run: 1 new column(s), 1 column(s) removed, 1 type change(s), 1 null-rate spike(s), -20% rows.")
    assert drift.compare(None, new).first()["status"] == "baseline"


def test_tree_finds_the_splitting_column(frame):
    rows = [(float(i), "u" if i % 2 else "v", 100.0 if i >= 300 else 1.0) for i in range(600)]
    df = frame(rows, "a double, b string, revenue double")
    fit = drivers.fit_tree(df, {"a": "numeric", "b": "categorical", "revenue": "numeric"}, "revenue", "numeric")
    assert fit["metric"] == ("R²", 1.0) and fit["drivers"][0] == ("a", 1.0)
    assert {(r[2], r[4]) for r in fit["rules"]} == {(1.0, 300), (100.0, 300)}
    assert all(r[0].startswith("a ") for r in fit["rules"])


def test_class_tree_and_segments(frame):
    rows = [("x" if i % 3 else "y", "hit" if i % 3 else "miss") for i in range(300)]
    df = frame(rows, "seg string, outcome string")
    r = {"seg": "categorical", "outcome": "categorical"}
    fit = drivers.fit_tree(df, r, "outcome", "categorical")
    assert fit["metric"] == ("accuracy", 1.0) and fit["rules"][0][1] in ("hit", "miss") and fit["rules"][0][3] == 1.0
    seg = drivers.segments(df, r, "outcome", "categorical").collect()
    assert [(s["value"], s["metric"], s["lift_pct"], s["n"]) for s in seg] == [("y", 0.0, -100.0, 100), ("x", 1.0, 50.0, 200)]


def test_histogram_keeps_empty_bins_and_closes_the_last(frame):
    got = charts.histogram(frame([(0.0,), (12.0,), (12.0,)], "x double"), ["x"]).orderBy("bin").collect()
    assert [r["count"] for r in got] == [1] + [0] * 10 + [2] and got[0]["centre"] == 0.5


@pytest.fixture(scope="module")
def smoke(spark):
    """Seeded order frame: 500 rows, 25 missing and 5 extreme revenues, delivered as text."""
    rng = np.random.default_rng(42)
    n = 500
    revenue = rng.gamma(2, 100, n).round(2)
    revenue[rng.choice(n, 5, replace=False)] = 99999.0
    gone = set(rng.choice(np.flatnonzero(revenue < 99999), 25, replace=False).tolist())
    stamps = pd.date_range("2024-01-01", periods=n, freq="6h").strftime("%Y-%m-%d %H:%M:%S")
    rows = [(str(i + 1), str(rng.choice(["North", "South", "East", "West"])), str(rng.choice(["online", "retail"])), stamps[i], str(rng.poisson(4)),
             None if i in gone else str(revenue[i]), str(round(float(rng.beta(2, 8)), 3)), i) for i in range(n)]
    schema = "order_id string, region string, channel string, order_date string, units string, revenue string, discount_pct string, _row_id bigint"
    steps = []
    return workflow.analyze(spark.createDataFrame(rows, schema), reader_types=True, progress=lambda s, p: steps.append((s, p))), steps


def test_whole_analysis(smoke):
    r, steps = smoke
    got = {x["column"]: x["role"] for x in r["roles"].collect()}
    assert got == {"order_id": "id", "region": "categorical", "channel": "categorical", "order_date": "datetime", "units": "numeric",
                   "revenue": "numeric", "discount_pct": "numeric"}
    assert r["profile_table"].first()["row_count"] == 500
    q = r["quality_overall"].first()
    assert 0 <= q["overall"] <= 100 and q["grade"] in "ABCDEF"
    assert r["driver_targets"].count() >= 1 and r["drift"].first()["status"] == "baseline"
    iqr = {x["column"]: x["outlier_count"] for x in r["iqr_outliers"].collect()}
    assert iqr["revenue"] >= 5
    assert r["findings"].where("category = 'anomaly'").count() >= 1
    assert [s for s, _ in steps] == workflow.STEPS[:13] and len(workflow.STEPS) == 15
    assert r["headline"].first()["headline"].startswith("500 rows × 7 columns (0.71% missing).")


def test_report_has_twelve_tables(smoke, tmp_path):
    manifest = report.write(report.build(smoke[0]), str(tmp_path), "r1")
    rows = {r["table"]: r["rows"] for r in manifest.collect()}
    assert list(rows) == report.TABLES and len(rows) == 12
    assert rows["raw"] == 500 and rows["profile"] == 7 and rows["executive"] >= 10


def test_run_records_are_appended(smoke, spark, tmp_path):
    from assayer.operators import history
    r, _ = smoke
    for run in ("r1", "r2"):
        history.append_run(history.run_record(spark, run, "orders.csv", "me", "succeeded", r["profile_columns"], r["findings"]), str(tmp_path / "runs"))
    kept = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert {k["run_id"] for k in kept} == {"r1", "r2"} and all('"name":"revenue"' in k["profile"] for k in kept)


def test_forest_scores_are_those_of_walking_each_tree():
    from types import SimpleNamespace
    rng = np.random.default_rng(3)
    points = np.column_stack([rng.normal(size=900), rng.integers(0, 3, 900), np.round(rng.normal(size=900), 1)])
    points[:3, 0] = math.inf, -math.inf, math.nan
    grown = [outliers._grower(0)(pd.DataFrame({"tree": t, "features": list(points[rng.choice(np.arange(3, 900), n)])})) for t, n in enumerate([256, 256, 40, 2, 1])]

    def walk(tree, row):
        node = tree.iloc[0]
        while node["feature"] >= 0:
            node = tree.iloc[int(node["left"] if row[int(node["feature"])] <= node["threshold"] else node["right"])]
        return node["path"]

    want = [2.0 ** (-sum(walk(t, row) for t in grown) / len(grown) / 10.0) for row in points]
    frames = [pd.DataFrame({"r": np.arange(900), **{f"c{i}": points[:, i] for i in range(3)}}).iloc[a:b] for a, b in ((0, 7), (7, 900))]
    got = pd.concat(outliers._scorer(SimpleNamespace(value=outliers.level_tables(grown, 3)), 10.0)(frames))
    np.testing.assert_allclose(got["score"], want, rtol=1e-12)


def test_medians_are_sought_for_columns_with_gaps_only(spark, monkeypatch):
    df = spark.range(100).selectExpr("id as _row_id", "cast(id as double) as a", "case when id % 4 > 0 then id end as b", "case when id = 7 then double('nan') else id / 2 end as c")
    asked, sought = [], outliers.exact_quantiles
    monkeypatch.setattr(outliers, "exact_quantiles", lambda d, cols, *a, **k: asked.append(cols) or sought(d, cols, *a, **k))
    got = outliers.forest_input(df, ["a", "b", "c"])[1].orderBy("r").toPandas()
    assert asked == [["b", "c"]]
    assert got["c0"].tolist() == [float(i) for i in range(100)] and got["c1"].tolist() == [float(i) if i % 4 else 50.0 for i in range(100)]
    assert got["c2"].tolist() == [25.0 if i == 7 else i / 2 for i in range(100)]


def test_rows_of_one_task_are_shared_among_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, cores * 110_000, 1, 1)
    assert session.spread(few, cores * 110_000).rdd.getNumPartitions() == cores
    # what is scanned many times is written once, by all cores, and rows without a value stay out
    df = spark.range(0, 4_000, 1, 1).selectExpr("if(id % 10 = 0, null, id * 0.5) as amount", "if(id % 10 = 0, null, concat(' x', id % 3)) as kind", "id as _row_id")
    known, plain = roles.infer_and_clean(df, keep=True), roles.infer_and_clean(df)
    assert known.clean.rdd.getNumPartitions() >= cores and known.clean.count() == 3_600
    assert sorted(map(tuple, known.clean.collect())) == sorted(map(tuple, plain.clean.collect()))
    assert known.roles == plain.roles and known.facts == plain.facts
