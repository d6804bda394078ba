"""Shapiro-Wilk with Royston's (1995) approximation, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: Wichura's AS 241 (PPND16) rational approximation of the normal quantile, highest power first
_CENTRE = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
            13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
           [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
            5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0])
_NEAR = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
          3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
         [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
          0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0])
_FAR = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
         0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
        [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
         0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0])
# fixed values: Royston's polynomials, highest power first
_LAST = [-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0]
_BEFORE_LAST = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
_MEAN_LARGE = [0.0038915, -0.083751, -0.31082, -1.5861]
_LOGSD_LARGE = [0.0030302, -0.082676, -0.4803]
_MEAN_SMALL = [-0.0006714, 0.025054, -0.39978, 0.544]
_LOGSD_SMALL = [-0.0020322, 0.062767, -0.77857, 1.3822]
_Z_95 = 1.6448536269514722


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + F.lit(k)
    return out


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    r_mid = F.lit(0.180625) - q * q
    r_tail = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r_tail <= 5, _poly(_NEAR[0], r_tail - 1.6) / _poly(_NEAR[1], r_tail - 1.6)) \
        .otherwise(_poly(_FAR[0], r_tail - 5) / _poly(_FAR[1], r_tail - 5))
    return F.when(F.abs(q) <= 0.425, q * _poly(_CENTRE[0], r_mid) / _poly(_CENTRE[1], r_mid)) \
        .otherwise(F.signum(q) * tail)


def shapiro_wilk(sample: DataFrame, group: str, value: str) -> DataFrame:
    """W, z and verdict per group of a bounded sample (at most a few thousand values per group)."""
    by_value = W.partitionBy(group).orderBy(value)
    everyone = W.partitionBy(group)
    n = F.col("n").cast("double")
    u = F.lit(1.0) / F.sqrt(n)
    scored = (
        sample.select(group, F.col(value).cast("double").alias("x"))
        .withColumnRenamed("x", value)
        .select(group, F.col(value).alias("x"),
                F.row_number().over(by_value).alias("i"),
                F.count("*").over(everyone).alias("n"),
                F.avg(value).over(everyone).alias("mean"))
        .withColumn("m", normal_quantile((F.col("i") - 0.375) / (n + 0.25)))
        .withColumn("m2", F.sum(F.col("m") * F.col("m")).over(everyone))
        .withColumn("m_last", normal_quantile((n - 0.375) / (n + 0.25)))
        .withColumn("m_prev", normal_quantile((n - 1.375) / (n + 0.25)))
        .withColumn("a_last", F.when(n == 3, F.lit(0.5 ** 0.5))
                    .otherwise(_poly(_LAST, u) + F.col("m_last") / F.sqrt("m2")))
        .withColumn("a_prev", _poly(_BEFORE_LAST, u) + F.col("m_prev") / F.sqrt("m2"))
    )
    two = n > 5
    numerator = F.col("m2") - 2 * F.pow("m_last", F.lit(2)) - F.when(two, 2 * F.pow("m_prev", F.lit(2))).otherwise(0.0)
    denominator = 1 - 2 * F.pow("a_last", F.lit(2)) - F.when(two, 2 * F.pow("a_prev", F.lit(2))).otherwise(0.0)
    i = F.col("i")
    weight = (F.when(i == 1, -F.col("a_last")).when(i == F.col("n"), F.col("a_last"))
              .when(two & (i == 2), -F.col("a_prev")).when(two & (i == F.col("n") - 1), F.col("a_prev"))
              .when(n == 3, F.lit(0.0))
              .otherwise(F.col("m") / F.sqrt(F.abs(F.try_divide(numerator, denominator)))))
    stats = (
        scored.withColumn("a", weight).groupBy(group)
        .agg(F.max("n").alias("n"),
             F.sum(F.col("a") * F.col("x")).alias("b"),
             F.sum(F.pow(F.col("x") - F.col("mean"), F.lit(2))).alias("ss"))
        .withColumn("w", F.least(F.try_divide(F.col("b") * F.col("b"), F.col("ss")), F.lit(1.0)))
    )
    w, log_n = F.col("w"), F.ln(n)
    tail = F.ln(F.greatest(F.lit(1.0) - w, F.lit(1e-300)))
    gamma = F.lit(0.459) * n - 2.273
    z_large = (tail - _poly(_MEAN_LARGE, log_n)) / F.exp(_poly(_LOGSD_LARGE, log_n))
    z_small = (-F.ln(F.greatest(gamma - tail, F.lit(1e-300))) - _poly(_MEAN_SMALL, n)) / F.exp(_poly(_LOGSD_SMALL, n))
    p_three = F.lit(1.909859317102744) * (F.asin(F.sqrt(w)) - F.lit(1.0471975511965976))
    z = F.when(n >= 12, z_large).when(n >= 4, z_small)
    return stats.select(
        F.col(group), "n", "w", z.alias("z"),
        F.when(F.col("ss") == 0, True)
        .when(n == 3, p_three > 0.05)
        .when(n >= 4, z < _Z_95).alias("is_normal"))
