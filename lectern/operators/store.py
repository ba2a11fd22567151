"""Stored runs, prompts, settings, fixtures: the tables behind the stores, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = ["doc_id", "system"]


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each document and system, by run id."""
    others = [c for c in runs.columns if c not in CELL]
    x = runs.groupBy(*CELL).agg(F.max_by(F.struct(*others), "run_id").alias("x"))
    return x.select(*CELL, *[F.col("x")[c].alias(c) for c in others])


def run_id(stamp: Column, payload: Column) -> Column:
    """Time stamp and the first eight digits of the content's hash."""
    return F.concat(F.date_format(stamp, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(payload, 256), 1, 8))


def save_runs(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each run; an existing store isn't overwritten."""
    runs.write.mode(mode).partitionBy(*CELL, "run_id").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete_cell(runs: DataFrame, doc_id: int, system: str) -> tuple[DataFrame, Column]:
    """The runs that stay, and the condition of those that go."""
    gone = (F.col("doc_id") == doc_id) & (F.col("system") == system)
    return runs.where(~gone), gone


def changed_axes(before: DataFrame, after: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """keys, axis, before, after of every axis that differs, nulls compared as values."""
    j = before.alias("b").join(after.alias("a"), keys)
    rows = j.select(*keys, F.inline(F.array(*[F.struct(F.lit(x).alias("axis"), F.col(f"b.{x}").alias("before"), F.col(f"a.{x}").alias("after")) for x in axes])))
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def overlay(builtin: DataFrame, user: DataFrame, key: str = "id") -> DataFrame:
    """Built-in entries with the user's in their place or added."""
    others = [c for c in builtin.columns if c != key]
    j = builtin.alias("b").join(user.alias("u"), key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}")).alias(c) for c in others], F.col(f"u.{others[0]}").isNotNull().alias("own"))


def setting(layers: list[Column], low: float | None = None, high: float | None = None) -> Column:
    """The last layer that sets a value, within bounds."""
    v = F.coalesce(*reversed(layers))
    v = v if low is None else F.greatest(F.lit(low), v)
    return v if high is None else F.least(F.lit(high), v)


def flag(text: Column, default: bool = True) -> Column:
    """Text flags: 0, false, no and off are false."""
    t = F.lower(F.trim(text))
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(~t.isin("0", "false", "no", "off"))


def next_variant(variants: DataFrame, keys: list[str], name: str = "variant") -> DataFrame:
    n = F.regexp_extract(name, "^v([0-9]+)$", 1)
    return variants.groupBy(*keys).agg(F.concat(F.lit("v"), (F.coalesce(F.max(F.nullif(n, F.lit("")).cast("bigint")), F.lit(0)) + 1).cast("string")).alias("next"))


def lineage(links: DataFrame, keep: Column, depth: int = 8) -> DataFrame:
    """id, root, hops: up the chain of sources to the first id that ``keep`` holds for; a cycle or a chain
    longer than ``depth`` has none.  Each hop is a join on the id, with the finished walks left out."""
    base = links.select("id", "source_id", keep.alias("ok"))
    walk = base.select(F.col("id").alias("start"), F.col("id").alias("at"), "source_id", "ok", F.lit(0).alias("hops"))
    done = walk.where("ok")
    walk = walk.where("not ok and source_id is not null")
    for hop in range(1, depth + 1):
        step = walk.select("start", F.col("source_id").alias("id")).join(base, "id")
        step = step.where(F.col("id") != F.col("start")).select("start", F.col("id").alias("at"), "source_id", "ok", F.lit(hop).alias("hops"))
        done = done.unionByName(step.where("ok"))
        walk = step.where("not ok and source_id is not null")
    return done.select(F.col("start").alias("id"), F.col("at").alias("root"), "hops")


def content_duplicates(df: DataFrame, content: list[str], key: str) -> DataFrame:
    """key, first: rows whose content an earlier key has."""
    h = F.sha2(F.to_json(F.struct(*sorted(content))), 256)
    w = Window.partitionBy("_h").orderBy(key)
    return df.withColumn("_h", h).withColumn("first", F.first(key).over(w)).where(F.col(key) != F.col("first")).select(key, "first")
