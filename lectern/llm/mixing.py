"""Mixing sources to target weights by a splitting tree over blocks.

Every source is cut into ``blocks`` disjoint blocks by a keyed hash of the document
id, which permutes its documents.  A source whose target is q times its size gives
every block floor(q) times and then blocks in order up to the words that are left;
documents of the one block at the border give their words in hash order.  These
block instances are the source's exact quota.

The quotas are dealt to output shards by a binary tree.  At each node the instances
are ranked by a keyed hash and the first half goes left, so the number that each
source sends left is one multivariate-hypergeometric draw and the halves are
disjoint.  Shards are then shuffled locally by a keyed hash of document and pass.

Only DataFrame operations are used.  No window spans a source: sums go over blocks,
whose number per source grows with the corpus (``block_count``).

Defined results: a null text has size 0; null sources form one source, ordered last;
a document of size 0 is taken 0 words; rows with the same id are mixed as separate
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dealing import row_struct

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
SHARDS = 8
SEED = "mix"
#: a block table of at most so many rows (about 5 MB) is broadcast; a larger one is joined by shuffle
BROADCAST_ROWS = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def block_count(documents: int) -> int:
    """Blocks per source: 64, or so many that a block has about a million documents at most."""
    n = 64
    while documents / n > 1_000_000:
        n *= 2
    return n


def key_of(*parts: Column) -> Column:
    """A keyed hash: hexadecimal text, so that any SQL engine gives the same order."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MAX_TIMES) -> DataFrame:
    """``sources(source, source_size)`` with ``target``.  Sources by code point, null last, weigh
    ``weights`` in turn and share the sum of all sizes; what a source would have above ``times``
    its size is shared again by weight.  With sources by rising size/weight, source i is held to
    its cap iff the cap is at most its share of what the sources before it leave."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * times)
    rising = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("w").over(after))
    s = s.withColumn("free", F.col("cap") * F.col("weight_left") > F.col("left") * F.col("w"))
    level = F.max(F.when(F.col("free"), F.col("left") / F.col("weight_left"))).over(everything)
    return s.withColumn("level", level).select("source", "source_size", F.when(F.col("free"), F.col("level") * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"))


def plan_blocks(sized: DataFrame, blocks: int, weights: tuple[int, ...] = WEIGHTS, times: int = MAX_TIMES) -> DataFrame:
    """``sized(source, block, size)`` to one row a block: source, block, source_size, target,
    passes (whole passes), part (words of the last pass), words."""
    per = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    t = targets(per.groupBy("source").agg(F.sum("words").alias("source_size")), weights, times)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint")
    inside = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = per.alias("p").join(t.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "block", "words", "source_size", "target")
    return (
        joined.withColumn("passes", passes)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), rest - F.coalesce(F.sum("words").over(inside), F.lit(0)))))
        .select("source", "block", "words", "source_size", "target", "passes", "part")
    )


def split(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The tree: one row a block with ``shards``, the output shard of each pass that takes words of it."""
    last = F.col("passes") + (F.col("part") > 0).cast("bigint")
    node = plan.where(last > 0).select("source", "block", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("pass"), F.lit(0).alias("shard"))
    level, width = 0, 1
    while width < shards:
        level, width = level + 1, width * 2
        here = Window.partitionBy("shard")
        rank = F.row_number().over(here.orderBy(key_of(F.lit(level), F.col("source"), F.col("block"), F.col("pass"))))
        node = node.withColumn("rank", rank).withColumn("all", F.count(F.lit(1)).over(here)).select("source", "block", "pass", (F.col("shard") * 2 + (F.col("rank") * 2 > F.col("all") + 1).cast("int")).alias("shard"))
    return node.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, times: int = MAX_TIMES, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: the columns in ``keep`` (default: the key), mix_size,
    mix_source_size, mix_target, mix_taken (words, repeats counted), mix_passes (whole passes) and
    mix_shards (the shard of each pass)."""
    blocks = block_count(docs.select(key).count())
    keep = [key] if keep is None else keep
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    hashed = key_of(F.col(key))
    rows = docs.select(F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), hashed.alias("h"), kept.alias("kept"))
    block = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % blocks
    rows = rows.withColumn("block", block)
    plan = plan_blocks(rows.select("source", "block", "size"), blocks, weights, times).checkpoint()  # sources x blocks rows
    dealt = split(plan, shards)
    table = plan.alias("a").join(dealt.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block")), "left").select(
        "a.source", "a.block", "words", "source_size", "target", "passes", "part", "shards"
    )
    if plan.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    d = rows.alias("d").join(table.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.block") == F.col("t.block"))).select("d.*", "words", "source_size", "target", "passes", "part", "shards")
    border = (F.col("part") > 0) & (F.col("part") < F.col("words"))
    order = Window.partitionBy("source", "block").orderBy("h", "size")
    # only documents of border blocks, one block a source, need a running sum
    whole = d.where(~border).withColumn("of_part", F.when(F.col("part") > 0, F.col("size")).otherwise(0))
    ordered = d.where(border).withColumn("of_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))))
    both = whole.unionByName(ordered)
    return both.select(
        *([F.col("kept")[c].alias(c) for c in keep]),
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        (F.col("passes") * F.col("size") + F.col("of_part")).alias("mix_taken"),
        F.col("passes").alias("mix_passes"),
        F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), (F.when(F.col("size") > 0, F.col("passes") + (F.col("of_part") > 0).cast("bigint")).otherwise(0)).cast("int")).alias("mix_shards"),
        F.col("h").alias("mix_key"),
    )


def draw(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", shards: int = SHARDS, shard: str | None = "mix_shard") -> DataFrame:
    """The mixed corpus: all columns of ``docs``, whatever their names, and ``shard`` (unless None; it
    takes the place of a column of that name), a row for each time that a document is taken whole.  Of a
    document that the quota cuts, the larger part decides whether it goes.  Texts without words are not
    drawn; repeated rows are drawn one by one.  Partitions are shuffled locally."""
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in ((key, "key"), (source, "source"), (text, "text"))], row_struct(docs).alias("row"))
    m = mix(rows, "text", "source", "key", shards, keep=["row"])
    times = F.col("mix_passes") + ((F.col("mix_taken") - F.col("mix_passes") * F.col("mix_size")) * 2 >= F.col("mix_size")).cast("bigint")
    n = F.when(F.col("mix_size") > 0, times).otherwise(0).cast("int")
    out = m.where(n > 0).select("row", F.posexplode(F.slice("mix_shards", F.lit(1), n)).alias("pass", "shard"), "mix_key")
    out = out.sortWithinPartitions("shard", F.md5(F.concat_ws(":", "mix_key", "pass")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != shard], *([F.col("shard").alias(shard)] if shard else []))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS h FROM documents),
e AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS block FROM d),
per AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY ALL),
s AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM per GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM w),
f AS (SELECT *, cap * wl > rest * w AS free, max(CASE WHEN cap * wl > rest * w THEN CAST(rest AS DOUBLE) / CAST(wl AS DOUBLE) END) OVER () AS lv FROM l),
t AS (SELECT source, source_size, CASE WHEN free THEN lv * w ELSE CAST(cap AS DOUBLE) END AS target FROM f),
p AS (SELECT per.source, block, words, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes
    FROM per JOIN t ON per.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, greatest(0, least(words, CAST(round(target - passes * source_size) AS BIGINT) - CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))) AS part FROM p),
i0 AS (SELECT source, block, unnest(range(1, passes + CAST(part > 0 AS INT) + 1)) AS pass, 0 AS shard FROM b),
i1 AS (SELECT source, block, pass, shard * 2 + CAST(row_number() OVER (PARTITION BY shard ORDER BY md5('mix:1:' || coalesce(source, '~') || ':' || block || ':' || pass)) * 2 > count(*) OVER (PARTITION BY shard) + 1 AS INT) AS shard FROM i0),
i2 AS (SELECT source, block, pass, shard * 2 + CAST(row_number() OVER (PARTITION BY shard ORDER BY md5('mix:2:' || coalesce(source, '~') || ':' || block || ':' || pass)) * 2 > count(*) OVER (PARTITION BY shard) + 1 AS INT) AS shard FROM i1),
i3 AS (SELECT source, block, pass, shard * 2 + CAST(row_number() OVER (PARTITION BY shard ORDER BY md5('mix:3:' || coalesce(source, '~') || ':' || block || ':' || pass)) * 2 > count(*) OVER (PARTITION BY shard) + 1 AS INT) AS shard FROM i2),
g AS (SELECT source, block, list(shard ORDER BY pass) AS shards FROM i3 GROUP BY ALL),
j AS (SELECT e.doc_id, e.size, e.source, e.block, b.source_size, b.target, b.passes, b.part, b.words, g.shards,
    CAST(coalesce(sum(e.size) OVER (PARTITION BY e.source, e.block ORDER BY e.h, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.block = b.block LEFT JOIN g ON e.source IS NOT DISTINCT FROM g.source AND e.block = g.block),
k AS (SELECT *, CASE WHEN part = 0 THEN 0 WHEN part >= words THEN size ELSE greatest(0, least(size, part - before)) END AS of_part FROM j)
SELECT doc_id, size, source_size, target, CAST(passes * size + of_part AS BIGINT) AS taken,
    CASE WHEN size > 0 THEN array_to_string(list_slice(coalesce(shards, []), 1, passes + CAST(of_part > 0 AS INT)), ',') ELSE '' END AS shards FROM k
"""
