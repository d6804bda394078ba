import numpy as np
import pandas as pd
import pytest

from assayer.operators import ordering as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"k": np.arange(n), "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)), "v": rng.integers(0, 300, n).astype(float)})
    pdf.loc[rng.random(n) < 0.3, "v"] = 7.0  # one value fills a third of the rows
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    df = spark.createDataFrame(pdf.astype({"v": object}).where(pdf.notna(), None), "k bigint, g string, v double").repartition(5).cache()
    return pdf, df


def values(df, name):
    return df.select("k", name).toPandas().sort_values("k")[name].astype(float).reset_index(drop=True)


def same(a, b):
    pd.testing.assert_series_equal(a, b.astype(float).reset_index(drop=True), check_names=False, atol=1e-9)


@pytest.mark.parametrize("rows_per_slice", [10 ** 6, 100])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_work_is_the_same_however_it_is_sliced(data, by, rows_per_slice):
    pdf, df = data
    view = pdf.groupby("g") if by else pdf
    same(values(O.running_sum(df, "v", ["k"], by, rows_per_slice=rows_per_slice), "cumsum"), view["v"].cumsum())
    position = view.cumcount() if by else pd.Series(np.arange(len(pdf)))
    same(values(O.running_count(df, ["k"], by, rows_per_slice=rows_per_slice), "cumcount"), position)
    for k in (1, 3, -2):
        same(values(O.lagged(df, "v", ["k"], by, k, rows_per_slice=rows_per_slice), "lagged"), view["v"].shift(k))
    same(values(O.average_rank(df, "v", by, rows_per_slice=rows_per_slice), "rank"), view["v"].rank())


@pytest.mark.parametrize("rows_per_slice", [10 ** 6, 100])
def test_grouped_quantiles(data, rows_per_slice):
    pdf, df = data
    got = O.grouped_quantiles(df, "v", ["g"], {"a": 0.25, "b": 0.5, "c": 0.9}, rows_per_slice).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.25, 0.5, 0.9]).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("keep, sketch", [(400_000, 4_096), (0, 8), (20, 8), (400_000, 64)])
def test_exact_quantiles(spark, data, keep, sketch):
    pdf, df = data
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    rng = np.random.default_rng(0)
    wide = np.concatenate([10.0 ** rng.uniform(-300, 300, 800), -10.0 ** rng.uniform(-300, 300, 500)])
    got = O.exact_quantiles(df, ["k", "v"], probs, keep, sketch, rows_per_slice=100)
    for c in ("k", "v"):
        np.testing.assert_allclose([got[c][p] for p in probs], pdf[c].quantile(probs))
    got = O.exact_quantiles(spark.createDataFrame([(float(x),) for x in wide], "x double"), ["x"], probs, keep, sketch)["x"]
    np.testing.assert_allclose([got[p] for p in probs], np.quantile(wide, probs), rtol=1e-9)


def test_quantiles_of_a_large_table_take_two_scans_and_few_rows(spark, monkeypatch):
    n, scans, read = 400_000, [], []
    df = spark.range(n, numPartitions=16).selectExpr("id", "cast(id * 7919 % 400009 as double) as a", "case when id % 3 = 0 then 5.0 else sqrt(id) end as b",
                                                     "case when id % 10 > 0 then id % 1000 end as c")
    sketched, counted, inside = O._sketched, O._counted, O._inside
    monkeypatch.setattr(O, "_sketched", lambda *a: scans.append("sketch") or sketched(*a))
    monkeypatch.setattr(O, "_counted", lambda *a: scans.append("count") or counted(*a))
    monkeypatch.setattr(O, "_inside", lambda v, p: read.append(sum(map(len, v.values()))) or inside(v, p))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = O.exact_quantiles(df, ["a", "b", "c"], probs)
    pdf = df.toPandas()
    for c in "abc":
        np.testing.assert_allclose([got[c][p] for p in probs], pdf[c].astype(float).quantile(probs))
    assert scans == ["sketch", "count"] and read[0] < 0.05 * 3 * n
    # the way for brackets that are too many to read out
    scans.clear()
    few = O.exact_quantiles(df, ["a", "b", "c"], probs, keep=100, rows_per_slice=1_000)
    assert few == got and scans == ["sketch", "count"] and len(read) == 1


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(O, "sketch_error", lambda size: 1e-6)
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) as a")
    probs = [i / 20 for i in range(21)]
    got = O.exact_quantiles(df, ["a"], probs, sketch=8)["a"]
    np.testing.assert_allclose([got[p] for p in probs], df.toPandas()["a"].quantile(probs))


def test_string_order_slices(spark):
    df = spark.createDataFrame([(f"n{i * 7919 % 1000:04d}", 1.0) for i in range(1000)], "s string, v double")
    got = O.running_sum(df, "v", ["s"], rows_per_slice=50).orderBy("s").toPandas()["cumsum"]
    assert got.tolist() == [float(i + 1) for i in range(1000)]


def test_a_key_with_a_third_of_the_rows_is_many_slices(spark):
    df = spark.range(6000, numPartitions=4).selectExpr("id", "case when id % 3 = 0 then date '2024-01-01' else date_add(date '2024-01-01', cast(id % 50 as int)) end as day",
                                                       "case when id % 5 > 0 then concat('a long common prefix ', id % 7) else '' end as t")
    sizes = O.in_slices(df, ["day"], 500).groupBy("_slice").count().toPandas()
    assert len(sizes) >= 10 and sizes["count"].max() < 1500
    for order in (["day", "id"], ["t", "id"]):
        pdf = df.toPandas().sort_values(order, ignore_index=True)
        got = O.running_count(df, order, rows_per_slice=300).toPandas().sort_values("cumcount", ignore_index=True)
        assert got["id"].tolist() == pdf["id"].tolist() and got["cumcount"].tolist() == list(range(6000))
    by = O.running_sum(df, "id", ["day", "id"], ["t"], rows_per_slice=300).toPandas().sort_values("id")["cumsum"].tolist()
    pdf = df.toPandas().sort_values(["day", "id"])
    assert by == pdf.assign(c=pdf.groupby("t")["id"].cumsum()).sort_values("id")["c"].tolist()


def test_ranks_of_texts_that_share_a_long_prefix(spark):
    df = spark.range(3000, numPartitions=3).selectExpr("id", "case when id % 4 > 0 then concat('http://www.example.org/', id % 900) when id % 8 = 0 then '' end as t")
    got = O.average_rank(df, "t", rows_per_slice=100).toPandas().sort_values("id")
    same(got["rank"].reset_index(drop=True), df.toPandas().sort_values("id")["t"].rank().reset_index(drop=True))


@pytest.mark.parametrize("start, stop", [(0, 7), (95, 105), (2500, 2510), (990, 2210), (2995, 4000), (5000, 5010), (10, 10)])
def test_deep_pages_read_their_slices_only(spark, start, stop):
    df = spark.range(3000, numPartitions=3).selectExpr("id * 7919 % 3001 as k", "id % 10 as day")
    pdf = df.toPandas().sort_values(["day", "k"], ascending=[False, True])
    got = O.page(df, [O.F.desc("day"), "k"], start, stop, rows_per_slice=100)
    assert [tuple(r) for r in got.select("day", "k").collect()] == [tuple(r) for r in pdf[["day", "k"]].to_numpy().tolist()][start:stop]
    if start == 2500:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "_slice" in plan and "PushedFilters" in plan and "GreaterThanOrEqual(c2" in plan


def test_small_slices_share_tasks_and_files(spark):
    df = spark.range(20_000, numPartitions=4).selectExpr("id", "id * 7919 % 20011 as k", "case when id % 3 > 0 then id % 4 end as g")
    for order in (["k"], ["g", "k"], ["g"]):
        sliced = O.in_slices(df, order, 10)
        assert len(sliced.inputFiles()) <= spark.sparkContext.defaultParallelism
        found = sliced.groupBy("_slice").agg(O.F.count("*").alias("n"), *[f(O.F.struct(*order)).alias(a) for f, a in ((O.F.min, "lo"), (O.F.max, "hi"))]).orderBy("_slice").collect()
        assert len(found) >= 2_000 and max(r["n"] for r in found) <= 10 and sum(r["n"] for r in found) == 20_000
        # slices go on from each other, nulls first
        def key(t):
            return [(v is not None, v or 0) for v in t]
        assert all(key(a["hi"]) <= key(b["lo"]) for a, b in zip(found, found[1:]))
    pdf = df.toPandas().sort_values("k")
    assert O.running_sum(df, "id", ["k"], rows_per_slice=10).orderBy("k").toPandas()["cumsum"].tolist() == pdf["id"].cumsum().tolist()


def test_lookup_of_hot_and_missing_keys(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 1 when id % 3 = 1 then id end as a", "cast(id % 2 as string) as b")
    table = df.groupBy("a", "b").agg(O.F.count("*").alias("n")).withColumn("v", O.F.concat_ws("-", "a", "b"))
    for hot in (10, 10_000):
        got = {r["id"]: r["v"] for r in O.lookup(df, table, ["a", "b"], hot).collect()}
        assert got == {r["id"]: None if r["a"] is None else f"{r['a']}-{r['b']}" for r in df.collect()}


def test_empty_input(spark):
    df = spark.createDataFrame([], "k bigint, g string, v double")
    assert O.exact_quantiles(df, ["v"], [0.5]) == {"v": {0.5: None}}
    assert O.running_sum(df, "v", ["k"]).count() == 0
    assert O.grouped_quantiles(df, "v", ["g"], {"m": 0.5}).count() == 0
