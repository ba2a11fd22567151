"""Queries of alignment and layout: islands, token index joins, bands, cohorts, fits."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import robust as R
from lectern.operators import sequences as Q
from lectern.sources import adapters as A

from .registry import query

LABELLED = "l AS (SELECT doc, line_idx, CASE WHEN line_idx % 11 = 4 THEN NULL ELSE block_id // 2 END AS label, level, bullet FROM hint_lines)"


def _labelled(spark, sf):
    h = A.hint_lines(spark, sf)
    return h.select("doc", "line_idx", F.when(F.col("line_idx") % 11 == 4, None).otherwise((F.col("block_id") / 2).cast("bigint")).alias("label"), "level", "bullet")


@query("W01_unit_islands", f"""WITH {LABELLED}, b AS (SELECT *, CAST(label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc ORDER BY line_idx) AS INT) AS new FROM l WHERE label IS NOT NULL)
SELECT doc, line_idx, label, CAST(sum(new) OVER (PARTITION BY doc ORDER BY line_idx) - 1 AS BIGINT) AS grp FROM b UNION ALL SELECT doc, line_idx, label, NULL FROM l WHERE label IS NULL""", ("hint_lines",))
def w01(spark, sf):
    return Q.islands(_labelled(spark, sf), ["doc"], "line_idx", ["label"]).select("doc", "line_idx", "label", "grp")


@query("W02_render_groups", f"""WITH {LABELLED}, b AS (SELECT *, CAST(lag(label) OVER w IS NULL OR label <> lag(label) OVER w OR level <> lag(level) OVER w OR bullet AS INT) AS new FROM l WHERE label IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY line_idx))
SELECT doc, line_idx, CAST(sum(new) OVER (PARTITION BY doc ORDER BY line_idx) - 1 AS BIGINT) AS grp FROM b UNION ALL SELECT doc, line_idx, NULL FROM l WHERE label IS NULL""", ("hint_lines",))
def w02(spark, sf):
    return Q.islands(_labelled(spark, sf), ["doc"], "line_idx", ["label", "level"], F.col("bullet")).select("doc", "line_idx", "grp")


@query("W03_blocks_of", """WITH b AS (SELECT *, CAST(block_id IS DISTINCT FROM lag(block_id) OVER (PARTITION BY doc ORDER BY line_idx) AS INT) AS new FROM hint_lines), c AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY line_idx) - 1 AS blk FROM b)
SELECT doc, CAST(blk AS BIGINT) AS blk, count(*) AS lines, min(line_idx) AS first_line, string_agg(text, ' / ' ORDER BY line_idx) AS text FROM c GROUP BY doc, blk""", ("hint_lines",))
def w03(spark, sf):
    b = Q.islands(A.hint_lines(spark, sf), ["doc"], "line_idx", ["block_id"], out="blk")
    g = b.groupBy("doc", "blk").agg(F.count(F.lit(1)).alias("lines"), F.min("line_idx").alias("first_line"), F.sort_array(F.collect_list(F.struct("line_idx", "text"))).alias("x"))
    return g.select("doc", "blk", "lines", "first_line", F.array_join(F.transform("x", lambda v: v["text"]), " / ").alias("text"))


@query("W07_linear_positions", "SELECT doc, page, cell_id, round(CASE WHEN max(y) OVER w > min(y) OVER w THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0 END, 9) AS position FROM cells WINDOW w AS (PARTITION BY doc, page)", ("cells",))
def w07(spark, sf):
    w = Window.partitionBy("doc", "page")
    c = A.cells(spark, sf)
    low, high = F.min("y").over(w), F.max("y").over(w)
    return c.select("doc", "page", "cell_id", F.round(F.when(high > low, (F.col("y") - low) / (high - low)).otherwise(0.0), 9).alias("position"))


@query("W06_interpolated_positions", """WITH k AS (SELECT doc, page, cell_id, y + x / 1000.0::DOUBLE AS t, CASE WHEN cell_id % 4 = 1 THEN CAST(seg_ord AS DOUBLE) END AS v FROM cells),
g AS (SELECT doc, page, list({'x': t, 'y': v} ORDER BY t, v) FILTER (v IS NOT NULL) AS a FROM k GROUP BY ALL),
j AS (SELECT k.*, a, len(a) AS n, last_value(CASE WHEN v IS NOT NULL THEN {'x': t, 'y': v} END IGNORE NULLS) OVER (PARTITION BY k.doc, k.page ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
    first_value(CASE WHEN v IS NOT NULL THEN {'x': t, 'y': v} END IGNORE NULLS) OVER (PARTITION BY k.doc, k.page ORDER BY cell_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM k JOIN g USING (doc, page)),
p AS (SELECT *, CASE WHEN b IS NULL THEN a[1] WHEN c IS NULL THEN a[n - 1] ELSE b END AS p, CASE WHEN b IS NULL THEN a[2] WHEN c IS NULL THEN a[n] ELSE c END AS q FROM j WHERE n >= 2)
SELECT doc, page, cell_id, round(greatest(0, least(40, CASE WHEN q.x = p.x THEN p.y ELSE p.y + (q.y - p.y) * (t - p.x) / (q.x - p.x) END)), 6) AS position FROM p""", ("cells",))
def w06(spark, sf):
    c = A.cells(spark, sf).select("doc", "page", "cell_id", (F.col("y") + F.col("x") / 1000.0).alias("t"), F.when(F.col("cell_id") % 4 == 1, F.col("seg_ord").cast("double")).alias("v"))
    d = Q.interpolated(c, ["doc", "page"], "cell_id", "t", "v", F.lit(0.0), F.lit(40.0))
    return d.where("position is not null").select("doc", "page", "cell_id", F.round("position", 6).alias("position"))


BOXES = "b AS (SELECT pair_id, page, seg_ord, y + (seg_ord % 3) * 9 AS lo, y + h + (seg_ord % 3) * 9 AS hi FROM segments WHERE side = 0)"


@query("W09_line_clusters", f"""WITH {BOXES}, c AS (SELECT *, (lo + hi) / 2 AS c FROM b), m AS (SELECT *, max(hi) OVER (PARTITION BY pair_id, page ORDER BY c, seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)
SELECT pair_id, page, seg_ord, CAST(sum(CAST(reach IS NULL OR c > reach AS INT)) OVER (PARTITION BY pair_id, page ORDER BY c, seg_ord ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS line FROM m""", ("segments",))
def w09(spark, sf):
    s = A.segments(spark, sf).where("side = 0")
    b = s.select("pair_id", "page", "seg_ord", (F.col("y") + F.col("seg_ord") % 3 * 9).alias("lo"), (F.col("y") + F.col("h") + F.col("seg_ord") % 3 * 9).alias("hi"))
    return Q.line_clusters(b, ["pair_id", "page"], "lo", "hi", "seg_ord").select("pair_id", "page", "seg_ord", "line")


@query("W10_column_split", r"""WITH m AS (SELECT doc, seg_ord, cell_id, text, x + (cell_id % 5) * 13 AS x, w FROM cells), g AS (SELECT *, x - lag(x + w) OVER p AS gap, count(*) OVER (PARTITION BY doc, seg_ord) AS n, sum(length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'))) OVER (PARTITION BY doc, seg_ord) AS chars FROM m WINDOW p AS (PARTITION BY doc, seg_ord ORDER BY x, cell_id)),
l AS (SELECT *, CASE WHEN n >= 3 THEN 1.8::DOUBLE * min(gap) FILTER (gap > 0) OVER (PARTITION BY doc, seg_ord) ELSE 2.0::DOUBLE * sum(w) OVER (PARTITION BY doc, seg_ord) / greatest(1, chars) END AS lim FROM g)
SELECT doc, seg_ord, cell_id, CAST(sum(CAST(coalesce(gap >= lim, false) AS INT)) OVER (PARTITION BY doc, seg_ord ORDER BY x, cell_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS col FROM l""", ("cells",))
def w10(spark, sf):
    m = A.cells(spark, sf).withColumn("x", F.col("x") + F.col("cell_id") % 5 * 13)
    return Q.column_split(m, ["doc", "seg_ord"], "x", "w", "cell_id", "text").select("doc", "seg_ord", "cell_id", "col")


@query("W11_mask_runs", """WITH m AS (SELECT pair_id, seg_ord, h > 15 AS on_ FROM segments WHERE side = 0), g AS (SELECT *, seg_ord - row_number() OVER (PARTITION BY pair_id ORDER BY seg_ord) AS g FROM m WHERE on_)
SELECT pair_id, min(seg_ord) AS first, max(seg_ord) AS last FROM g GROUP BY pair_id, g""", ("segments",))
def w11(spark, sf):
    m = A.segments(spark, sf).where("side = 0").select("pair_id", "seg_ord", (F.col("h") > 15).alias("on"))
    return Q.true_runs(m, ["pair_id"], "seg_ord", "on")


SPANS = "s AS (SELECT doc, page, CAST(x + (seg_ord % 2) * 400 AS BIGINT) AS l, CAST(x + (seg_ord % 2) * 400 + w AS BIGINT) AS r FROM cells)"


@query("W12_projection_bands", f"""WITH {SPANS}, m AS (SELECT *, max(r) OVER (PARTITION BY doc, page ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
c AS (SELECT *, sum(CAST(coalesce(l - reach >= 25, false) AS INT)) OVER (PARTITION BY doc, page ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS band FROM m)
SELECT doc, page, CAST(band AS BIGINT) AS band, min(l) AS band_left, max(r) AS margin, count(*) AS members FROM c GROUP BY ALL""", ("cells",))
def w12(spark, sf):
    c = A.cells(spark, sf)
    l = (F.col("x") + F.col("seg_ord") % 2 * 400).cast("bigint")  # noqa: E741
    return Q.projection_bands(c.select("doc", "page", l.alias("l"), (l + 80).alias("r")), ["doc", "page"], "l", "r")


@query("J22_band_margin", f"""WITH {SPANS}, m AS (SELECT *, max(r) OVER (PARTITION BY doc, page ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
c AS (SELECT *, sum(CAST(coalesce(l - reach >= 25, false) AS INT)) OVER (PARTITION BY doc, page ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS band FROM m),
b AS (SELECT doc, page, band, min(l) AS band_left, max(r) AS margin FROM c GROUP BY ALL)
SELECT q.doc, q.page, q.cell_id, CAST((SELECT min(margin) FROM b WHERE b.doc = q.doc AND b.page = q.page AND q.x BETWEEN band_left AND margin) AS BIGINT) AS margin FROM cells q""", ("cells",))
def j22(spark, sf):
    bands = w12(spark, sf).groupBy("doc", "page").agg(F.collect_list(F.struct("band_left", "margin")).alias("bands"))
    j = A.cells(spark, sf).select("doc", "page", "cell_id", "x").join(bands, ["doc", "page"], "left")
    around = F.filter("bands", lambda b: F.col("x").between(b["band_left"], b["margin"]))
    return j.select("doc", "page", "cell_id", F.array_min(F.transform(around, lambda b: b["margin"])).alias("margin"))


@query("W15_unit_numbers", "SELECT doc, page, cell_id, row_number() OVER (PARTITION BY doc ORDER BY page, cell_id) AS unit_id FROM cells", ("cells",))
def w15(spark, sf):
    return A.cells(spark, sf).select("doc", "page", "cell_id", F.row_number().over(Window.partitionBy("doc").orderBy("page", "cell_id")).alias("unit_id"))


@query("W17_contained_run", "SELECT doc, line_idx, regexp_matches(' ' || array_to_string(regexp_split_to_array(lower(trim(text)), '[ ]+'), ' ') || ' ', ' (of the and|no 5|and the in|de la en) ') AS has_run FROM hint_lines", ("hint_lines",))
def w17(spark, sf):
    h = A.hint_lines(spark, sf).withColumn("w", F.split(F.lower(F.trim("text")), "[ ]+"))
    runs = [["of", "the", "and"], ["no", "5"], ["and", "the", "in"], ["de", "la", "en"]]

    def has(run):
        spots = F.when(F.size("w") >= len(run), F.sequence(F.lit(1), F.size("w") - (len(run) - 1)))
        return F.coalesce(F.exists(spots, lambda i: F.slice("w", i, F.lit(len(run))) == F.array(*map(F.lit, run))), F.lit(False))

    return h.select("doc", "line_idx", functools.reduce(operator.or_, map(has, runs)).alias("has_run"))


@query("J20_line_anchor", """WITH c AS (SELECT doc, seg_ord, cell_id, x, w, h, CASE WHEN cell_id % 3 <> 1 THEN (cell_id // 2) % 2 END AS label FROM cells),
k AS (SELECT *, last_value(CASE WHEN label IS NOT NULL THEN {'label': label, 'x': x, 'w': w} END IGNORE NULLS) OVER (PARTITION BY doc, seg_ord ORDER BY x, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    first_value(CASE WHEN label IS NOT NULL THEN {'label': label, 'x': x, 'w': w} END IGNORE NULLS) OVER (PARTITION BY doc, seg_ord ORDER BY x, cell_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM c),
s AS (SELECT *, CASE WHEN x - l.x - l.w <= 1.2 * h THEN l.label END AS a, CASE WHEN r.x - x - w <= 1.2 * h THEN r.label END AS b FROM k WHERE label IS NULL)
SELECT doc, seg_ord, cell_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a END AS anchor FROM s""", ("cells",))
def j20(spark, sf):
    c = A.cells(spark, sf).select("doc", "seg_ord", "cell_id", "x", "w", "h", F.when(F.col("cell_id") % 3 != 1, (F.col("cell_id") / 2).cast("bigint") % 2).alias("label"))
    return Q.nearest_sides(c, ["doc", "seg_ord"])


HT = "ht AS (SELECT DISTINCT doc, page, line_idx, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM hint_lines WHERE regexp_full_match(text, '[\\x00-\\x7F]*')), ct AS (SELECT doc, page, cell_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM cells WHERE regexp_full_match(text, '[\\x00-\\x7F]*'))"


def _ascii(d):
    return d.where(F.col("text").rlike(r"^[\x00-\x7F]*$"))


def _tokens(d, key):
    return _ascii(d).select("doc", "page", key, F.explode(T.match_tokens(F.col("text"))).alias("tok"))


@query("J08_token_index_join", f"WITH {HT} SELECT DISTINCT c.doc, c.page, c.cell_id, h.line_idx FROM ct c JOIN ht h USING (doc, page, tok)", ("hint_lines", "cells"))
def j08(spark, sf):
    h = _tokens(A.hint_lines(spark, sf), "line_idx").distinct()
    return _tokens(A.cells(spark, sf), "cell_id").distinct().join(h, ["doc", "page", "tok"]).select("doc", "page", "cell_id", "line_idx").distinct()


def _best(spark, sf):
    h, c = _tokens(A.hint_lines(spark, sf), "line_idx").distinct(), _tokens(A.cells(spark, sf), "cell_id")
    n = c.groupBy("doc", "page", "cell_id").agg(F.count(F.lit(1)).alias("n"))
    s = c.join(h, ["doc", "page", "tok"]).groupBy("doc", "page", "cell_id", "line_idx").agg(F.count(F.lit(1)).alias("hits")).join(n, ["doc", "page", "cell_id"]).withColumn("score", F.round(F.col("hits") / F.col("n"), 9))
    w = Window.partitionBy("doc", "page", "cell_id").orderBy(F.desc("score"))
    return s.withColumn("r", F.rank().over(w)).where("r = 1").select("doc", "page", "cell_id", "line_idx", "score")


BEST = f"{HT}, n AS (SELECT doc, page, cell_id, count(*) AS n FROM ct GROUP BY ALL), sc AS (SELECT doc, page, cell_id, line_idx, round(count(*) / any_value(n), 9) AS score FROM ct JOIN ht USING (doc, page, tok) JOIN n USING (doc, page, cell_id) GROUP BY ALL), best AS (SELECT doc, page, cell_id, line_idx, score FROM (SELECT *, rank() OVER (PARTITION BY doc, page, cell_id ORDER BY score DESC) AS r FROM sc) WHERE r = 1)"


@query("G06_cell_best_lines", f"WITH {BEST} SELECT * FROM best", ("hint_lines", "cells"))
def g06(spark, sf):
    return _best(spark, sf)


@query("A12_column_vote", f"""WITH {BEST}, v AS (SELECT doc, page, line_idx, cell_id % 3 AS col, sum(score) AS mass FROM best GROUP BY ALL), t AS (SELECT doc, page, line_idx, max_by(col, mass * 1000 - col) AS col, max(mass) AS top, sum(mass) AS whole FROM v GROUP BY ALL)
SELECT doc, page, line_idx, col FROM t WHERE round(top / whole, 6) >= 0.6""", ("hint_lines", "cells"))
def a12(spark, sf):
    v = _best(spark, sf).groupBy("doc", "page", "line_idx", (F.col("cell_id") % 3).alias("col")).agg(F.sum("score").alias("mass"))
    t = v.groupBy("doc", "page", "line_idx").agg(F.max_by("col", F.col("mass") * 1000 - F.col("col")).alias("col"), F.max("mass").alias("top"), F.sum("mass").alias("whole"))
    return t.where(F.round(F.col("top") / F.col("whole"), 6) >= 0.6).select("doc", "page", "line_idx", "col")


@query("G08_column_filtered", f"""WITH {BEST}, v AS (SELECT doc, page, line_idx, cell_id % 3 AS col, sum(score) AS mass FROM best GROUP BY ALL), t AS (SELECT doc, page, line_idx, max_by(col, mass * 1000 - col) AS col, max(mass) AS top, sum(mass) AS whole FROM v GROUP BY ALL),
k AS (SELECT doc, page, line_idx, col FROM t WHERE round(top / whole, 6) >= 0.6) SELECT b.doc, b.page, b.cell_id, b.line_idx FROM best b LEFT JOIN k USING (doc, page, line_idx) WHERE score >= 0.75 OR k.col IS NULL OR k.col = cell_id % 3""", ("hint_lines", "cells"))
def g08(spark, sf):
    b = _best(spark, sf).join(a12(spark, sf), ["doc", "page", "line_idx"], "left")
    return b.where((F.col("score") >= 0.75) | F.col("col").isNull() | (F.col("col") == F.col("cell_id") % 3)).select("doc", "page", "cell_id", "line_idx")


@query("A24_alignment_metrics", f"WITH {BEST}, c AS (SELECT doc, page, cell_id, (SELECT max(score) FROM best b WHERE b.doc = x.doc AND b.page = x.page AND b.cell_id = x.cell_id) AS s FROM cells x) SELECT doc, count(*) AS cells, count(s) AS bound, count(*) - count(s) AS leftover, count(DISTINCT cell_id % 3) AS columns FROM c GROUP BY doc", ("hint_lines", "cells"))
def a24(spark, sf):
    best = _best(spark, sf).select("doc", "page", "cell_id").distinct().withColumn("hit", F.lit(1))
    c = A.cells(spark, sf).join(best, ["doc", "page", "cell_id"], "left")
    return c.groupBy("doc").agg(F.count(F.lit(1)).alias("cells"), F.count("hit").alias("bound"), (F.count(F.lit(1)) - F.count("hit")).alias("leftover"), F.count_distinct(F.col("cell_id") % 3).alias("columns"))


@query("A13_dominant_family", r"""WITH f AS (SELECT pair_id, CASE WHEN h >= 18 THEN 'serif' WHEN h >= 15 THEN 'sans' ELSE 'mono' END AS family, sum(length(regexp_replace(text, '\s', '', 'g'))) AS n, min(seg_ord) AS first FROM segments WHERE side = 0 GROUP BY ALL)
SELECT pair_id, family FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, first) AS rn FROM f) WHERE rn = 1""", ("segments",))
def a13(spark, sf):
    f = F.when(F.col("h") >= 18, "serif").when(F.col("h") >= 15, "sans").otherwise("mono")
    g = A.segments(spark, sf).where("side = 0").groupBy("pair_id", f.alias("family")).agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n"), F.min("seg_ord").alias("first"))
    return g.groupBy("pair_id").agg(F.max_by("family", F.struct("n", -F.col("first"))).alias("family"))


@query("A14_dominant_span", "SELECT doc, seg_ord, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, seg_ord ORDER BY length(text) * h * h DESC, cell_id) AS rn FROM cells) WHERE rn = 1", ("cells",))
def a14(spark, sf):
    return A.cells(spark, sf).groupBy("doc", "seg_ord").agg(F.max_by("cell_id", F.struct(F.length("text") * F.col("h") * F.col("h"), -F.col("cell_id"))).alias("cell_id"))


@query("A15_union_box", "SELECT doc, page, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, CAST(max(x + w) - min(x) AS BIGINT) AS w, CAST(max(y + h) - min(y) AS BIGINT) AS h FROM cells GROUP BY ALL", ("cells",))
def a15(spark, sf):
    long = lambda c: c.cast("bigint")
    return A.cells(spark, sf).groupBy("doc", "page").agg(long(F.min("x")).alias("x"), long(F.min("y")).alias("y"), long(F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), long(F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


@query("A16_size_cohorts", "SELECT CAST(p_size AS BIGINT) AS p_size, p_brand, count(*) AS n, round(median(p_retailprice), 6) AS centre FROM part GROUP BY ALL HAVING count(*) >= 3 AND median(p_retailprice) > 0 AND stddev_pop(p_retailprice) / median(p_retailprice) <= 0.15")
def a16(spark, sf):
    return R.size_cohorts(A.table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("bigint")), ["p_size", "p_brand"], "p_retailprice").withColumn("centre", F.round("centre", 6))


@query("A17_group_size", "SELECT p_brand, CAST(min(p_size) AS BIGINT) AS least, CAST(floor(median(p_size)) AS BIGINT) AS middle FROM part GROUP BY 1")
def a17(spark, sf):
    return A.table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").cast("bigint").alias("least"), F.floor(R.median("p_size")).cast("bigint").alias("middle"))


ANGLES = "a AS (SELECT pair_id, page, seg_ord, y, (seg_ord * 7 + pair_id * 3) % 11 - 4 + y / 200.0::DOUBLE AS angle FROM segments WHERE side = 0)"


def _angles(spark, sf):
    s = A.segments(spark, sf).where("side = 0")
    return s.select("pair_id", "page", "seg_ord", "y", ((F.col("seg_ord") * 7 + F.col("pair_id") * 3) % 11 - 4 + F.col("y") / 200.0).alias("angle"))


@query("A19_flat_pages", f"WITH {ANGLES} SELECT pair_id, page, median(abs(angle)) < 3 AS flat FROM a GROUP BY ALL", ("segments",))
def a19(spark, sf):
    return R.flat(_angles(spark, sf), ["pair_id", "page"], "angle")


@query("A20_theil_sen", f"""WITH {ANGLES}, sp AS (SELECT pair_id, page, max(y) - min(y) AS span FROM a GROUP BY ALL HAVING count(*) >= 5),
s AS (SELECT p.pair_id, p.page, median((q.angle - p.angle) / (q.y - p.y)) AS slope FROM a p JOIN a q ON p.pair_id = q.pair_id AND p.page = q.page AND p.seg_ord < q.seg_ord JOIN sp ON sp.pair_id = p.pair_id AND sp.page = p.page WHERE abs(q.y - p.y) >= 0.05 * span AND q.y <> p.y GROUP BY ALL),
i AS (SELECT pair_id, page, slope, median(angle - slope * y) AS intercept FROM a JOIN s USING (pair_id, page) GROUP BY ALL)
SELECT pair_id, page, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(median(abs(angle - (slope * y + intercept))), 6) AS mad FROM a JOIN i USING (pair_id, page) GROUP BY pair_id, page, slope, intercept""", ("segments",))
def a20(spark, sf):
    t = R.theil_sen(_angles(spark, sf), ["pair_id", "page"], "seg_ord", "y", "angle")
    return t.select("pair_id", "page", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "mad")])


@query("A21_baseline_fit", """WITH c AS (SELECT doc, page, seg_ord, x, y + cell_id % 7 AS y, avg(x) OVER g AS mx, avg(y + cell_id % 7) OVER g AS my, count(*) OVER g AS n FROM cells WINDOW g AS (PARTITION BY doc, page, seg_ord))
SELECT doc, page, round(sum((x - mx) * (y - my)) / nullif(sum((x - mx) * (x - mx)), 0), 6) + 0.0 AS slope FROM c WHERE n >= 2 GROUP BY ALL""", ("cells",))
def a21(spark, sf):
    c = A.cells(spark, sf).withColumn("y", F.col("y") + F.col("cell_id") % 7)
    return R.clustered_slope(c, ["doc", "page"], "seg_ord", "x", "y").select("doc", "page", (F.round("slope", 6) + 0.0).alias("slope"))


@query("A22_line_pitch", "SELECT pair_id, page, round(regr_slope(y + seg_ord % 5, seg_ord), 6) AS slope, round(regr_intercept(y + seg_ord % 5, seg_ord), 6) AS intercept FROM segments WHERE side = 0 GROUP BY ALL HAVING count(*) >= 2", ("segments",))
def a22(spark, sf):
    s = A.segments(spark, sf).where("side = 0").withColumn("v", F.col("y") + F.col("seg_ord") % 5)
    return R.least_squares(s, ["pair_id", "page"], "seg_ord", "v").where("slope is not null").select("pair_id", "page", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("A26_dominant_script", r"""WITH s AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '\p{Latin}')), 0) AS latin, coalesce(len(regexp_extract_all(text, '\p{Cyrillic}')), 0) AS cyrillic, coalesce(len(regexp_extract_all(text, '\p{Han}')), 0) AS han FROM documents)
SELECT doc_id, CASE WHEN greatest(latin, cyrillic, han) = 0 THEN NULL WHEN latin >= cyrillic AND latin >= han THEN 'latin' WHEN cyrillic >= han THEN 'cyrillic' ELSE 'han' END AS script FROM s""")
def a26(spark, sf):
    n = {k: F.regexp_count("text", F.lit(rf"\p{{Is{v}}}")) for k, v in (("latin", "Latin"), ("cyrillic", "Cyrillic"), ("han", "Han"))}
    d = A.table(spark, sf, "documents").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(k) for k, c in n.items()])
    return d.select("doc_id", F.when(F.greatest("latin", "cyrillic", "han") == 0, None).when((F.col("latin") >= F.col("cyrillic")) & (F.col("latin") >= F.col("han")), "latin").when(F.col("cyrillic") >= F.col("han"), "cyrillic").otherwise("han").alias("script"))


@query("A27_document_gate", """WITH n AS (SELECT pair_id, side, page, count(*) FILTER (label IN ('text', 'doc_title', 'footer') AND score >= 0.7) AS n FROM regions GROUP BY ALL),
f AS (SELECT s.pair_id, s.side, s.page, count(*) AS free, count(*) FILTER (EXISTS (SELECT 1 FROM regions r WHERE r.pair_id = s.pair_id AND r.side = s.side AND r.page = s.page AND r.label IN ('text', 'doc_title', 'footer') AND s.x + s.w / 2 BETWEEN r.x0 AND r.x1 AND s.y + s.h / 2 BETWEEN r.y0 AND r.y1)) AS held FROM segments s GROUP BY ALL)
SELECT pair_id, side, page, n >= 3 AND held / free >= 0.5 AS gate FROM f JOIN n USING (pair_id, side, page)""", ("regions",))
def a27(spark, sf):
    from lectern.functions import geometry as G
    from lectern.operators.scoring import centred

    keys = ["pair_id", "side", "page"]
    r = A.regions(spark, sf)
    text = F.col("label").isin("text", "doc_title", "footer")
    n = r.groupBy(*keys).agg(F.count_if(text & (F.col("score") >= 0.7)).alias("n"))
    s = centred(A.segments(spark, sf))
    held = s.join(r.where(text), keys).where(G.inside(F.col("cx"), F.col("cy"), G.box())).select(*keys, "seg_ord").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    free = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("free"))
    return free.join(n, keys).join(held, keys, "left").select(*keys, ((F.col("n") >= 3) & (F.coalesce("held", F.lit(0)) / F.col("free") >= 0.5)).alias("gate"))


@query("O01_reading_order", "SELECT pair_id, page, seg_ord, row_number() OVER (PARTITION BY pair_id, page ORDER BY floor((y + h) / 10), x, seg_ord) AS place FROM segments WHERE side = 0", ("segments",))
def o01(spark, sf):
    w = Window.partitionBy("pair_id", "page").orderBy(F.floor((F.col("y") + F.col("h")) / 10), "x", "seg_ord")
    return A.segments(spark, sf).where("side = 0").select("pair_id", "page", "seg_ord", F.row_number().over(w).alias("place"))


@query("O02_groups_by_top", "WITH g AS (SELECT doc, cell_id % 5 AS grp, min(y + cell_id % 3) AS t FROM cells GROUP BY ALL) SELECT doc, grp, row_number() OVER (PARTITION BY doc ORDER BY t, grp) AS place FROM g", ("cells",))
def o02(spark, sf):
    g = A.cells(spark, sf).groupBy("doc", (F.col("cell_id") % 5).alias("grp")).agg(F.min(F.col("y") + F.col("cell_id") % 3).alias("t"))
    return g.select("doc", "grp", F.row_number().over(Window.partitionBy("doc").orderBy("t", "grp")).alias("place"))


@query("O12_anchor_member", "SELECT doc, seg_ord, min(cell_id) AS cell_id FROM cells GROUP BY ALL", ("cells",))
def o12(spark, sf):
    return A.cells(spark, sf).groupBy("doc", "seg_ord").agg(F.min_by("cell_id", "cell_id").alias("cell_id"))


@query("J12_unit_blocks", "SELECT c.doc, c.cell_id, h.block_id, h.level FROM cells c JOIN hint_lines h ON c.doc = h.doc AND c.seg_ord = h.line_idx", ("hint_lines", "cells"))
def j12(spark, sf):
    h = A.hint_lines(spark, sf).select("doc", F.col("line_idx").alias("seg_ord"), "block_id", "level")
    return A.cells(spark, sf).join(h, ["doc", "seg_ord"]).select("doc", "cell_id", "block_id", "level")


@query("U10_token_containment", f"WITH {HT}, c AS (SELECT doc, page, cell_id, list_distinct(list(tok)) AS t FROM ct GROUP BY ALL), h AS (SELECT doc, page, line_idx, list(tok) AS t FROM ht GROUP BY ALL) SELECT c.doc, c.cell_id, CAST(len(list_filter(c.t, lambda x: NOT list_contains(h.t, x))) AS BIGINT) AS new_tokens FROM c JOIN h ON c.doc = h.doc AND c.page = h.page AND h.line_idx = c.cell_id // 1000 + 1", ("hint_lines", "cells"))
def u10(spark, sf):
    c = _tokens(A.cells(spark, sf), "cell_id").groupBy("doc", "page", "cell_id").agg(F.collect_set("tok").alias("t")).withColumn("line_idx", (F.col("cell_id") / 1000).cast("bigint") + 1)
    h = _tokens(A.hint_lines(spark, sf), "line_idx").groupBy("doc", "page", "line_idx").agg(F.collect_set("tok").alias("u"))
    return c.join(h, ["doc", "page", "line_idx"]).select("doc", "cell_id", F.size(F.array_except("t", "u")).alias("new_tokens"))
