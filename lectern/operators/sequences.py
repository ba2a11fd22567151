"""Ordered scans: islands, clusters, bands, splits.  Every input names its partition keys and its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: str, labels: list[str], starts: Column | None = None, out: str = "grp") -> DataFrame:
    """Numbers runs of equal labels from 0.  Rows whose first label is null stand alone (their number is
    null) and don't break a run; rows where ``starts`` holds begin one."""
    w = Window.partitionBy(*keys).orderBy(order)
    label = F.struct(*labels)
    bound = df.where(F.col(labels[0]).isNotNull())
    new = ~label.eqNullSafe(F.lag(label).over(w)) if starts is None else ~label.eqNullSafe(F.lag(label).over(w)) | F.coalesce(starts, F.lit(False))
    numbered = bound.withColumn("_new", new.cast("bigint")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
    return numbered.unionByName(df.where(F.col(labels[0]).isNull()).withColumn(out, F.lit(None).cast("bigint")))


def line_clusters(boxes: DataFrame, keys: list[str], low: str, high: str, order: str) -> DataFrame:
    """Boxes by centre; one joins the running line while its centre is within the line's extent so far.
    A new line's own end is past all before it, so the running maximum needs no reset."""
    w = Window.partitionBy(*keys).orderBy("_c", order)
    b = boxes.withColumn("_c", (F.col(low) + F.col(high)) / 2)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("_new", (reach.isNull() | (F.col("_c") > reach)).cast("bigint"))
    return b.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_c", "_new")


def projection_bands(spans: DataFrame, keys: list[str], left: str, right: str, gutter: int = 25) -> DataFrame:
    """keys, band, band_left, margin: bands between empty corridors of at least ``gutter`` whole pixels."""
    s = spans.withColumn("_l", F.greatest(F.lit(0), F.col(left).cast("bigint"))).withColumn("_r", F.greatest(F.lit(0), F.col(right).cast("bigint")))
    w = Window.partitionBy(*keys).orderBy("_l", "_r")
    reach = F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_cut", (F.col("_l") - reach >= gutter).cast("bigint")).withColumn("band", F.sum(F.coalesce("_cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "band").agg(F.min("_l").alias("band_left"), F.max(right).alias("margin"), F.count(F.lit(1)).alias("members"))


def column_split(members: DataFrame, keys: list[str], left: str, width: str, order: str, text: str, ratio: float = 1.8, two: float = 2.0) -> DataFrame:
    """keys, order, col: members of one line by left edge; a gap of ``ratio`` times the least positive one
    (three members or more) or ``two`` average glyph widths (two members) starts a column."""
    w = Window.partitionBy(*keys).orderBy(left, order)
    every = Window.partitionBy(*keys)
    m = members.withColumn("_gap", F.col(left) - F.lag(F.col(left) + F.col(width)).over(w)).withColumn("_n", F.count(F.lit(1)).over(every))
    chars = F.greatest(F.lit(1), F.sum(F.length(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""))).over(every))
    limit = F.when(F.col("_n") >= 3, ratio * F.min(F.when(F.col("_gap") > 0, F.col("_gap"))).over(every)).otherwise(two * F.sum(width).over(every) / chars)
    m = m.withColumn("_limit", limit).withColumn("_cut", F.coalesce(F.col("_gap") >= F.col("_limit"), F.lit(False)).cast("bigint"))
    return m.withColumn("col", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_n", "_limit", "_cut")


def true_runs(mask: DataFrame, keys: list[str], at: str, flag: str) -> DataFrame:
    """keys, first, last of every run of consecutive places where the flag holds."""
    w = Window.partitionBy(*keys).orderBy(at)
    held = mask.where(F.col(flag)).withColumn("_g", F.col(at) - F.row_number().over(w))
    return held.groupBy(*keys, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_g")


def nearest_sides(cells: DataFrame, keys: list[str], reach: float = 1.2) -> DataFrame:
    """For each unlabelled cell the label that its nearest labelled neighbours to the left and right on its
    line agree on; neighbours further than ``reach`` heights don't count.  One neighbour is enough."""
    w = Window.partitionBy(*keys).orderBy("x", "cell_id")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    mark = F.when(F.col("label").isNotNull(), F.struct("label", "x", "w"))
    c = cells.withColumn("_l", F.last(mark, ignorenulls=True).over(before)).withColumn("_r", F.first(mark, ignorenulls=True).over(after))
    left = F.when(F.col("x") - F.col("_l.x") - F.col("_l.w") <= reach * F.col("h"), F.col("_l.label"))
    right = F.when(F.col("_r.x") - F.col("x") - F.col("w") <= reach * F.col("h"), F.col("_r.label"))
    agreed = F.when(left.isNull(), right).when(right.isNull() | (left == right), left)
    return c.where("label is null").select(*keys, "cell_id", agreed.alias("anchor"))


def interpolated(df: DataFrame, keys: list[str], order: str, x: str, y: str, low: Column, high: Column) -> DataFrame:
    """``df`` with ``position``: y where known, else on the line between the known ones around, or through
    the two nearest at an end, within low and high.  Fewer than two known: null."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("_k", known)
    d = d.withColumn("_b", F.last("_k", ignorenulls=True).over(back)).withColumn("_a", F.first("_k", ignorenulls=True).over(ahead))
    every = d.groupBy(*keys).agg(F.sort_array(F.collect_list("_k")).alias("_all"))
    d = d.join(every, keys)
    n = F.size("_all")
    p = F.when(F.col("_b").isNull(), F.get("_all", F.lit(0))).when(F.col("_a").isNull(), F.get("_all", n - 2)).otherwise(F.col("_b"))
    q = F.when(F.col("_b").isNull(), F.get("_all", F.lit(1))).when(F.col("_a").isNull(), F.get("_all", n - 1)).otherwise(F.col("_a"))
    line = F.when(q["x"] == p["x"], p["y"]).otherwise(p["y"] + (q["y"] - p["y"]) * (F.col(x) - p["x"]) / (q["x"] - p["x"]))
    return d.withColumn("position", F.when(n >= 2, F.greatest(low, F.least(high, line)))).drop("_k", "_b", "_a", "_all")
