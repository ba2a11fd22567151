"""Differences of records and sets: expected against actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_differences(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, expected, actual where they differ; rows of one side only aren't compared."""
    j = expected.alias("e").join(actual.alias("a"), keys)
    rows = j.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").cast("string").alias("expected"), F.col(f"a.{f}").cast("string").alias("actual")) for f in fields])))
    return rows.where(~F.col("expected").eqNullSafe(F.col("actual")))


def count_differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected, actual: how many rows each side has, where the numbers differ."""
    one = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("a")))
    return one.groupBy(*keys).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual")).where("expected <> actual")


def budget_rows(rows: DataFrame, keys: list[str], order: list[str], budget: DataFrame, n: str) -> DataFrame:
    """The first ``n`` rows of each key that has a budget."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.join(budget, keys).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col(n)).drop("_rn", n)


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing, extra: copies that only one side has."""
    one = a.select(*keys, F.lit(1).alias("d")).unionByName(b.select(*keys, F.lit(-1).alias("d")))
    g = one.groupBy(*keys).agg(F.sum("d").alias("d")).where("d <> 0")
    return g.select(*keys, F.greatest(F.lit(0), F.col("d")).alias("missing"), F.greatest(F.lit(0), -F.col("d")).alias("extra"))


def nearest_consuming(expected: DataFrame, actual: DataFrame, keys: list[str], limit: float = 3.0) -> DataFrame:
    """keys, ord, shift, moved: each expected row takes the nearest actual row of its text that none before
    it took.  Rows of one text on one page form a group, folded in order inside the JVM."""
    e = expected.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "cx", "cy"))).alias("es"))
    a = actual.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "cx", "cy"))).alias("rest"))
    j = e.join(a, keys)
    far = lambda x, y: F.sqrt((x["cx"] - y["cx"]) * (x["cx"] - y["cx"]) + (x["cy"] - y["cy"]) * (x["cy"] - y["cy"]))
    none = F.filter(F.transform("es", lambda x: F.struct(x["ord"].alias("ord"), F.lit(0.0).alias("shift"))), lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        best = F.array_min(F.transform(acc["rest"], lambda y, i: F.struct(far(x, y).alias("d"), i.alias("i"), y["ord"].alias("o"))))
        return F.when(F.size(acc["rest"]) == 0, acc).otherwise(F.struct(F.filter(acc["rest"], lambda y: y["ord"] != best["o"]).alias("rest"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), best["d"].alias("shift")))).alias("out")))

    out = F.aggregate("es", F.struct(F.col("rest").alias("rest"), none.alias("out")), step)
    return j.select(*keys, F.inline(out["out"])).withColumn("moved", F.col("shift") > limit)


def region_columns_key_diff(left: Column, right: Column) -> Column:
    """Keys that only one of two maps has, or whose values differ."""
    a, b = F.map_keys(left), F.map_keys(right)
    changed = F.filter(F.array_intersect(a, b), lambda k: ~F.element_at(left, k).eqNullSafe(F.element_at(right, k)))
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a), changed))
