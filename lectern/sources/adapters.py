"""Domain tables derived from the stored ones, by integer arithmetic that any engine repeats.

A pair is a document with an even id (source, side 0) and the next one (translated, side 1).
Every function returns a DataFrame; ``CTES`` has the same tables as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 40
LINES_PER_REGION = 4
LABELS = ("text", "doc_title", "image", "table", "text", "footer", "formula", "chart")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side, page, seg_ord, text, and the box x, y, w, h: one row for each line with text.
    Each line ends in a number, so that numbers survive from side to side or don't."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select((F.col("doc_id") / 2).cast("bigint").alias("pair_id"), (F.col("doc_id") % 2).alias("side"), F.posexplode(F.split("text", "\n")).alias("seg_ord", "line"))
    lines = lines.where(F.trim("line") != "").withColumn("seg_ord", F.col("seg_ord").cast("bigint"))
    n = (F.col("seg_ord") * 137 + F.col("pair_id") + F.col("side") * (F.col("pair_id") % 3)) % 3000 + 5
    plain = F.regexp_replace(F.col("line"), "([0-9]) +([0-9])", "$1x$2")
    number = F.when(n >= 1000, F.concat((n / 1000).cast("bigint").cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))
    return lines.select(
        "pair_id",
        "side",
        (F.col("seg_ord") / LINES_PER_PAGE).cast("bigint").alias("page"),
        "seg_ord",
        F.concat(plain, F.lit(" no "), number).alias("text"),
        ((F.col("pair_id") * 37 + F.col("seg_ord") * 11) % 200 + F.col("side") * 3).cast("double").alias("x"),
        (F.col("seg_ord") % LINES_PER_PAGE * 20).cast("double").alias("y"),
        (F.length("line") * 8).cast("double").alias("w"),
        (12 + (F.col("seg_ord") * 7 + F.col("pair_id") + F.col("side") * 2) % 9).cast("double").alias("h"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side, page, reg_ord, label, score, x0, y0, x1, y1: a box around each block of lines."""
    s = segments(spark, sf_dir).withColumn("reg_ord", (F.col("seg_ord") % LINES_PER_PAGE / LINES_PER_REGION).cast("bigint"))
    shift = F.col("side") * ((F.col("pair_id") + F.col("reg_ord")) % 4) * 5
    label = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("pair_id") + F.col("reg_ord") * 3) % len(LABELS) + 1).cast("int"))
    boxes = s.groupBy("pair_id", "side", "page", "reg_ord").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return boxes.select("pair_id", "side", "page", "reg_ord", label.alias("label"), (((F.col("pair_id") * 13 + F.col("reg_ord") * 29 + F.col("side") * 5) % 66 + 35) / 100.0).alias("score"), "x0", (F.col("y0") + shift).alias("y0"), "x1", (F.col("y1") + shift).alias("y1"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, seg_ord, cell_id, text, x, y, w, h: runs of three words of each line of even documents."""
    s = segments(spark, sf_dir).where("side = 0")
    w = F.split(F.trim("text"), "[ ]+")
    spots = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size("words") - 1) / 3).cast("int")))
    c = s.withColumn("words", w).select(F.col("pair_id").alias("doc"), "page", "seg_ord", F.explode(spots).alias("k"), "words", "x", "y", "h")
    text = F.array_join(F.slice("words", F.col("k") * 3 + 1, 3), " ")
    return c.select("doc", "page", "seg_ord", (F.col("seg_ord") * 1000 + F.col("k")).alias("cell_id"), text.alias("text"), (F.col("x") + F.col("k") * 90).alias("x"), "y", F.lit(80.0).alias("w"), "h")


def hint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, line_idx, text, block_id, level, bullet: the lines of the documents, in reading order."""
    s = segments(spark, sf_dir).where("side = 0")
    i = F.col("seg_ord")
    level = F.element_at(F.array(*map(F.lit, ("h1", "body", "body", "caption"))), ((i / 5).cast("bigint") % 4 + 1).cast("int"))
    return s.select(F.col("pair_id").alias("doc"), "page", i.alias("line_idx"), "text", (i / 3).cast("bigint").alias("block_id"), level.alias("level"), (i % 7 == 3).alias("bullet"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, system, run_id, layout, anchors, has_scores: one stored run for each order."""
    o = table(spark, sf_dir, "orders")
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("system"), stamp.alias("run_id"), (cents % 10001 / 100.0).alias("layout"), (cents % 7919 / 100.0).alias("anchors"), (F.col("o_orderkey") % 5 != 0).alias("has_scores"))


STATES = {"click": "queued", "view": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, request_id, state, t (seconds), value: lifecycle events of requests (one for each user)."""
    e = table(spark, sf_dir, "events")
    state = F.lit("queued")
    for k, v in STATES.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("request_id"), state.alias("state"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "value")


CTES = {
    "segments": r"""segments AS (SELECT pair_id, side, seg_ord // 40 AS page, seg_ord,
    regexp_replace(line, '([0-9]) +([0-9])', '\1x\2', 'g') || ' no ' || CASE WHEN n >= 1000 THEN (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS text,
    CAST((pair_id * 37 + seg_ord * 11) % 200 + side * 3 AS DOUBLE) AS x, CAST(seg_ord % 40 * 20 AS DOUBLE) AS y, CAST(length(line) * 8 AS DOUBLE) AS w,
    CAST(12 + (seg_ord * 7 + pair_id + side * 2) % 9 AS DOUBLE) AS h
    FROM (SELECT *, (seg_ord * 137 + pair_id + side * (pair_id % 3)) % 3000 + 5 AS n FROM (SELECT doc_id // 2 AS pair_id, doc_id % 2 AS side,
        unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_ord FROM documents WHERE text IS NOT NULL)
    WHERE trim(line) <> ''))""",
    "regions": r"""regions AS (SELECT pair_id, side, page, reg_ord, ['text', 'doc_title', 'image', 'table', 'text', 'footer', 'formula', 'chart'][CAST((pair_id + reg_ord * 3) % 8 + 1 AS INT)] AS label,
    ((pair_id * 13 + reg_ord * 29 + side * 5) % 66 + 35) / 100.0::DOUBLE AS score, x0, y0 + side * ((pair_id + reg_ord) % 4) * 5 AS y0, x1, y1 + side * ((pair_id + reg_ord) % 4) * 5 AS y1
    FROM (SELECT pair_id, side, page, seg_ord % 40 // 4 AS reg_ord, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM segments GROUP BY ALL))""",
    "cells": r"""cells AS (SELECT doc, page, seg_ord, seg_ord * 1000 + k AS cell_id, array_to_string(list_slice(words, k * 3 + 1, k * 3 + 3), ' ') AS text, x + k * 90 AS x, y, CAST(80 AS DOUBLE) AS w, h
    FROM (SELECT pair_id AS doc, page, seg_ord, x, y, h, words, unnest(range(0, greatest(0, (len(words) - 1) // 3) + 1)) AS k FROM (SELECT *, regexp_split_to_array(trim(text), '[ ]+') AS words FROM segments WHERE side = 0)))""",
    "hint_lines": r"""hint_lines AS (SELECT pair_id AS doc, page, seg_ord AS line_idx, text, seg_ord // 3 AS block_id, ['h1', 'body', 'body', 'caption'][CAST(seg_ord // 5 % 4 + 1 AS INT)] AS level, seg_ord % 7 = 3 AS bullet FROM segments WHERE side = 0)""",
    "runs": r"""runs AS (SELECT o_custkey AS doc_id, o_orderpriority AS system, strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS run_id,
    CAST(round(o_totalprice * 100) AS BIGINT) % 10001 / 100.0::DOUBLE AS layout, CAST(round(o_totalprice * 100) AS BIGINT) % 7919 / 100.0::DOUBLE AS anchors, o_orderkey % 5 <> 0 AS has_scores FROM orders)""",
    "requests": r"""requests AS (SELECT event_id AS seq, user_id AS request_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'queued' END AS state,
    CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events)""",
}
NEEDS = {"regions": ["segments"], "cells": ["segments"], "hint_lines": ["segments"]}


def with_tables(names: list[str], sql: str) -> str:
    """SQL with the definitions of the named tables, and what they need, in front."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    sql = sql.strip()
    head = ",\n".join(CTES[n] for n in order)
    if not head:
        return sql
    return f"WITH RECURSIVE {head},\n{sql[5:].lstrip()}" if sql[:5].upper() == "WITH " else f"WITH RECURSIVE {head}\n{sql}"
