"""Robust statistics of layouts: cohorts, angle fields, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COHORT_MEMBERS, COHORT_CV = 3, 0.15
FLAT_DEGREES = 3.0
FIELD_SAMPLES, FIELD_MAD, STEP_SHARE = 5, 1.0, 0.05


def median(c: str):
    return F.percentile(c, F.lit(0.5))


def size_cohorts(df: DataFrame, keys: list[str], height: str, members: int = COHORT_MEMBERS, cv: float = COHORT_CV) -> DataFrame:
    """keys, n, centre: groups of enough heights whose spread is small against their median."""
    g = df.groupBy(*keys).agg(F.count(height).alias("n"), median(height).alias("centre"), F.stddev_pop(height).alias("sd"))
    return g.where((F.col("n") >= members) & (F.col("centre") > 0) & (F.col("sd") / F.col("centre") <= cv)).drop("sd")


def flat(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.percentile(F.abs(angle), F.lit(0.5)) < FLAT_DEGREES).alias("flat"))


def theil_sen(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """keys, slope, intercept, mad: the median of the slopes of all pairs far enough apart.  Groups are
    lines of a page, tens at most."""
    span = df.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("span"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= FIELD_SAMPLES)
    a = df.select(*keys, F.col(order).alias("oa"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = df.select(*keys, F.col(order).alias("ob"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    pairs = a.join(b, keys).where("oa < ob").join(span, keys).where(F.abs(F.col("xb") - F.col("xa")) >= STEP_SHARE * F.col("span")).where("xa <> xb")
    slope = pairs.groupBy(*keys).agg(F.percentile((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa")), F.lit(0.5)).alias("slope"))
    level = df.join(slope, keys).groupBy(*keys, "slope").agg(F.percentile(F.col(y) - F.col("slope") * F.col(x), F.lit(0.5)).alias("intercept"))
    rest = df.join(level, keys).groupBy(*keys, "slope", "intercept").agg(F.percentile(F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))), F.lit(0.5)).alias("mad"))
    return rest


def clustered_slope(df: DataFrame, keys: list[str], cluster: str, x: str, y: str) -> DataFrame:
    """keys, slope, degrees: least squares through the points of all clusters, each about its own mean."""
    mean = df.groupBy(*keys, cluster).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    c = df.join(mean, [*keys, cluster]).withColumn("dx", F.col(x) - F.col("mx")).withColumn("dy", F.col(y) - F.col("my"))
    g = c.groupBy(*keys).agg(F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"))
    slope = F.try_divide("sxy", "sxx")
    return g.select(*keys, slope.alias("slope"), F.degrees(F.atan(slope)).alias("degrees"))


def least_squares(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
