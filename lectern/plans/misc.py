"""Queries of the remaining scalar functions, predicates and small aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.operators import protocol as P
from lectern.operators import runtime as X
from lectern.operators import sequences as Q
from lectern.sources import adapters as A

from .records import STATE, TURNS, _turns
from .registry import query


def _rot(spark, sf):
    """Quadrilaterals: cells turned a little, as four corners."""
    c = A.cells(spark, sf)
    d = F.col("cell_id") % 9 - 4
    return c.select("doc", "cell_id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("w")).alias("bx"), (F.col("y") + d).alias("by"), (F.col("y") + d + F.col("h")).alias("cy"), (F.col("y") + F.col("h")).alias("dy"))


ROT = "q AS (SELECT doc, cell_id, x AS ax, y AS ay, x + w AS bx, y + cell_id % 9 - 4 AS by_, y + cell_id % 9 - 4 + h AS cy, y + h AS dy FROM cells)"


@query("F33_edge_angle", f"WITH {ROT} SELECT doc, cell_id, round((degrees(atan2(by_ - ay, bx - ax)) + degrees(atan2(cy - dy, bx - ax))) / 2, 6) AS angle FROM q", ("cells",))
def f33(spark, sf):
    a = lambda p, q: F.degrees(F.atan2(F.col(q) - F.col(p), F.col("bx") - F.col("ax")))
    return _rot(spark, sf).select("doc", "cell_id", F.round((a("ay", "by") + a("dy", "cy")) / 2, 6).alias("angle"))


@query("F34_line_height", f"WITH {ROT} SELECT doc, cell_id, round((sqrt((dy - ay) * (dy - ay)) + sqrt((cy - by_) * (cy - by_))) / 2, 6) AS height FROM q", ("cells",))
def f34(spark, sf):
    return _rot(spark, sf).select("doc", "cell_id", F.round((F.hypot(F.lit(0.0), F.col("dy") - F.col("ay")) + F.hypot(F.lit(0.0), F.col("cy") - F.col("by"))) / 2, 6).alias("height"))


@query("F32_corner_order", f"WITH {ROT} SELECT doc, cell_id, least(ax, bx) AS left_x, least(ay, by_) AS top_y, greatest(ax, bx) AS right_x, greatest(cy, dy) AS bottom_y FROM q", ("cells",))
def f32(spark, sf):
    q = _rot(spark, sf)
    pts = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "by"), ("bx", "cy"), ("ax", "dy"))])
    lim = lambda f, c: f(F.transform(pts, lambda p: p[c]))
    return q.select("doc", "cell_id", lim(F.array_min, "x").alias("left_x"), lim(F.array_min, "y").alias("top_y"), lim(F.array_max, "x").alias("right_x"), lim(F.array_max, "y").alias("bottom_y"))


PAIRED = "p AS (SELECT a.doc, a.seg_ord, a.cell_id, a.x, a.y, a.w, a.h, b.x AS x2, b.y + b.cell_id % 3 AS y2, b.w AS w2, b.h AS h2 FROM cells a JOIN cells b ON a.doc = b.doc AND b.cell_id = a.cell_id + 1)"


def _next(spark, sf):
    c = A.cells(spark, sf)
    b = c.select("doc", (F.col("cell_id") - 1).alias("cell_id"), F.col("x").alias("x2"), (F.col("y") + F.col("cell_id") % 3).alias("y2"), F.col("w").alias("w2"), F.col("h").alias("h2"))
    return c.join(b, ["doc", "cell_id"])


@query("F38_continuation", f"WITH {PAIRED} SELECT doc, cell_id, y2 - y > 0 AND y2 - y <= 2.5 * h AND abs(x2 - x) <= 2 * h AS continues FROM p", ("cells",))
def f38(spark, sf):
    drop = F.col("y2") - F.col("y")
    return _next(spark, sf).select("doc", "cell_id", ((drop > 0) & (drop <= 2.5 * F.col("h")) & (F.abs(F.col("x2") - F.col("x")) <= 2 * F.col("h"))).alias("continues"))


@query("F36_box_overlap", f"WITH {PAIRED} SELECT doc, cell_id, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) > 0.3 * least(w * h, w2 * h2) AS overlaps FROM p", ("cells",))
def f36(spark, sf):
    e = lambda a, b: F.greatest(F.lit(0.0), F.least(F.col(a) + F.col(b), F.col(a + "2") + F.col(b + "2")) - F.greatest(F.col(a), F.col(a + "2")))
    return _next(spark, sf).select("doc", "cell_id", (e("x", "w") * e("y", "h") > 0.3 * F.least(F.col("w") * F.col("h"), F.col("w2") * F.col("h2"))).alias("overlaps"))


@query("F37_x_overlap", f"WITH {PAIRED} SELECT doc, cell_id, round(greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) / least(w, w2), 6) AS share FROM p", ("cells",))
def f37(spark, sf):
    o = F.greatest(F.lit(0.0), F.least(F.col("x") + F.col("w"), F.col("x2") + F.col("w2")) - F.greatest("x", "x2"))
    return _next(spark, sf).select("doc", "cell_id", F.round(o / F.least("w", "w2"), 6).alias("share"))


@query("F35_adjacency", f"""WITH {PAIRED}, g AS (SELECT doc, cell_id, greatest(h, h2, 1.0) AS tall, greatest(x, x2) - least(x + w, x2 + w2) AS across, greatest(y, y2) - least(y + h, y2 + h2) AS down FROM p)
SELECT doc, cell_id, (across < 0 AND down <= 1.5 * tall) OR (down < 0 AND across <= 2.0 * tall) AS near FROM g""", ("cells",))
def f35(spark, sf):
    corners = lambda s: F.struct(F.col("x" + s).alias("x0"), F.col("y" + s).alias("y0"), (F.col("x" + s) + F.col("w" + s)).alias("x1"), (F.col("y" + s) + F.col("h" + s)).alias("y1"))
    return _next(spark, sf).select("doc", "cell_id", corners("").alias("a"), corners("2").alias("b")).select("doc", "cell_id", G.near(F.col("a"), F.col("b")).alias("near"))


@query("F39_box_numbers", "SELECT doc, cell_id, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS x FROM cells", ("cells",))
def f39(spark, sf):
    return A.cells(spark, sf).select("doc", "cell_id", F.when(F.col("x") == F.floor("x"), F.col("x").cast("bigint").cast("string")).otherwise(F.col("x").cast("string")).alias("x"))


@query("F40_work_scale", "SELECT p_partkey, round(least(1.0, sqrt(1500000.0 / (p_size * p_retailprice * 100))), 6) AS scale FROM part")
def f40(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", F.round(F.least(F.lit(1.0), F.sqrt(1500000.0 / (F.col("p_size") * F.col("p_retailprice") * 100))), 6).alias("scale"))


@query("F41_condense_factor", "SELECT p_brand, round(min(greatest(0.7, least(1.0, (p_retailprice * 1.1) / (p_size * 60)))), 6) AS factor FROM part GROUP BY 1")
def f41(spark, sf):
    f = F.greatest(F.lit(0.7), F.least(F.lit(1.0), F.col("p_retailprice") * 1.1 / (F.col("p_size") * 60)))
    return A.table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.min(f), 6).alias("factor"))


@query("F43_canonical_json", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS doc FROM part""")
def f43(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("doc"))


@query("F45_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def f45(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("F46_truncated_reply", f"WITH {TURNS} SELECT unit_id, coalesce(length(translated) // 4 >= nullif(unit_id % 40, 0), false) AS truncated FROM tp")
def f46(spark, sf):
    cap = F.nullif(F.col("unit_id") % 40, F.lit(0))
    return _turns(spark, sf).select("unit_id", F.coalesce((F.length("translated") / 4).cast("bigint") >= cap, F.lit(False)).alias("truncated"))


@query("F10_reproduced_in", f"WITH {TURNS} SELECT unit_id, len(list_filter(list_distinct(regexp_extract_all(lower(source_text), '[a-z0-9]+')), lambda x: length(x) > 2 AND NOT list_contains(regexp_extract_all(lower(translated), '[a-z0-9]+'), x))) = 0 AS reproduced FROM tp")
def f10(spark, sf):
    tok = lambda c: T.all_of(F.lower(c), "[a-z0-9]+")
    lost = F.filter(F.array_except(tok("source_text"), tok("translated")), lambda x: F.length(x) > 2)
    return _turns(spark, sf).select("unit_id", (F.size(lost) == 0).alias("reproduced"))


@query("P16_effectively_unchanged")
def p16(spark, sf):
    return _turns(spark, sf).select("unit_id", P.effectively_unchanged(F.col("source_text"), F.col("translated")).alias("unchanged"))


@query("P17_heading_number", r"SELECT doc, line_idx, regexp_full_match(split_part(text, ' ', 1), '\(?\[?[A-Za-z]?[0-9]+([.\-][0-9]+)*[.):\]]?') AS heading FROM hint_lines", ("hint_lines",))
def p17(spark, sf):
    return A.hint_lines(spark, sf).select("doc", "line_idx", F.split_part("text", F.lit(" "), F.lit(1)).rlike(r"^\(?\[?[A-Za-z]?[0-9]+([.\-][0-9]+)*[.):\]]?$").alias("heading"))


@query("P18_source_rebuilt", "SELECT doc, seg_ord, string_agg(text, ' ' ORDER BY cell_id) AS source_text, count(*) AS members FROM cells GROUP BY ALL", ("cells",))
def p18(spark, sf):
    g = A.cells(spark, sf).groupBy("doc", "seg_ord").agg(F.sort_array(F.collect_list(F.struct("cell_id", "text"))).alias("m"))
    return g.select("doc", "seg_ord", F.array_join(F.transform("m", lambda x: x["text"]), " ").alias("source_text"), F.size("m").alias("members"))


@query("P19_request_validation", r"""SELECT event_id, CASE WHEN NOT regexp_full_match(event_type || '-' || user_id, '[a-z]{4,8}-[0-9]{1,3}') THEN 'invalid_id' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'invalid_task' WHEN value IS NULL THEN 'missing_input' WHEN value > 90 THEN 'too_large' ELSE 'ok' END AS verdict FROM events""")
def p19(spark, sf):
    ok_id = F.concat_ws("-", "event_type", F.col("user_id").cast("string")).rlike(r"^[a-z]{4,8}-[0-9]{1,3}$")
    v = F.when(~ok_id, "invalid_id").when(~F.col("event_type").isin("click", "view", "purchase"), "invalid_task").when(F.col("value").isNull(), "missing_input").when(F.col("value") > 90, "too_large").otherwise("ok")
    return A.table(spark, sf, "events").select("event_id", v.alias("verdict"))


@query("J13_two_key_attach", """WITH u AS (SELECT doc, seg_ord, CASE WHEN seg_ord % 4 = 1 THEN NULL ELSE seg_ord END AS hint_index FROM cells GROUP BY ALL), t AS (SELECT doc, line_idx, 'h' || line_idx AS entry FROM hint_lines WHERE line_idx % 3 <> 0), m AS (SELECT doc, cell_id, 'c' || cell_id AS entry FROM cells WHERE cell_id % 5 = 1)
SELECT u.doc, u.seg_ord, coalesce(t.entry, (SELECT arg_min(m.entry, m.cell_id) FROM m JOIN cells c ON c.doc = m.doc AND c.cell_id = m.cell_id WHERE u.hint_index IS NULL AND c.doc = u.doc AND c.seg_ord = u.seg_ord)) AS entry FROM u LEFT JOIN t ON t.doc = u.doc AND t.line_idx = u.hint_index""", ("hint_lines", "cells"))
def j13(spark, sf):
    c = A.cells(spark, sf)
    u = c.select("doc", "seg_ord").distinct().withColumn("hint_index", F.when(F.col("seg_ord") % 4 != 1, F.col("seg_ord")))
    t = A.hint_lines(spark, sf).where("line_idx % 3 <> 0").select("doc", F.col("line_idx").alias("hint_index"), F.concat(F.lit("h"), F.col("line_idx").cast("string")).alias("by_hint"))
    m = c.where("cell_id % 5 = 1").groupBy("doc", "seg_ord").agg(F.min_by(F.concat(F.lit("c"), F.col("cell_id").cast("string")), "cell_id").alias("by_cell"))
    j = u.join(t, ["doc", "hint_index"], "left").join(m, ["doc", "seg_ord"], "left")
    return j.select("doc", "seg_ord", F.coalesce("by_hint", F.when(F.col("hint_index").isNull(), F.col("by_cell"))).alias("entry"))


@query("J21_above_neighbour", """SELECT a.doc, a.cell_id, max(b.cell_id) AS above FROM cells a JOIN cells b ON a.doc = b.doc AND a.page = b.page AND b.seg_ord < a.seg_ord AND b.seg_ord >= a.seg_ord - 2 WHERE a.y - b.y > 0 AND a.y - b.y <= 2.5 * b.h AND abs(a.x - b.x) <= 2 * b.h GROUP BY ALL""", ("cells",))
def j21(spark, sf):
    c = A.cells(spark, sf).select("doc", "page", "seg_ord", "cell_id", "x", "y", "h")
    b = c.select("doc", "page", F.explode(F.array(F.col("seg_ord") + 1, F.col("seg_ord") + 2)).alias("seg_ord"), F.col("cell_id").alias("above"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("h").alias("bh"))
    j = c.join(b, ["doc", "page", "seg_ord"])
    drop = F.col("y") - F.col("by")
    return j.where((drop > 0) & (drop <= 2.5 * F.col("bh")) & (F.abs(F.col("x") - F.col("bx")) <= 2 * F.col("bh"))).groupBy("doc", "cell_id").agg(F.max("above").alias("above"))


@query("J23_repeated_suffix", """WITH w AS (SELECT doc, line_idx, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM hint_lines), k AS (SELECT doc, line_idx, array_to_string(w[len(w) - 5:len(w)], ' ') AS tail, w FROM w WHERE len(w) >= 6)
SELECT a.doc, a.line_idx, min(b.line_idx) AS repeats FROM k a JOIN k b ON a.doc = b.doc AND a.tail = b.tail AND a.line_idx <> b.line_idx AND len(a.w) > len(b.w) GROUP BY ALL""", ("hint_lines",))
def j23(spark, sf):
    w = A.hint_lines(spark, sf).withColumn("w", T.all_of(F.lower("text"), "[a-z0-9]+")).where(F.size("w") >= 6).select("doc", "line_idx", F.array_join(F.slice("w", F.size("w") - 5, F.lit(6)), " ").alias("tail"), F.size("w").alias("n"))
    b = w.select("doc", "tail", F.col("line_idx").alias("other"), F.col("n").alias("m"))
    return w.join(b, ["doc", "tail"]).where("line_idx <> other and n > m").groupBy("doc", "line_idx").agg(F.min("other").alias("repeats"))


@query("A23_metric_rollup", "SELECT user_id, round(sum(value), 3) AS value_total, count(value) AS values FROM events GROUP BY 1")
def a23(spark, sf):
    return A.table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 3).alias("value_total"), F.count("value").alias("values"))


@query("A25_call_estimate", """WITH r AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'x_batch' WHEN 1 THEN 'x_line' ELSE 'x_batch_fallback' END AS route FROM conversations) SELECT conv_id, count(*) FILTER (NOT route LIKE '%\\_batch' ESCAPE '\\') + CAST(bool_or(route LIKE '%\\_batch' ESCAPE '\\') AS BIGINT) AS calls FROM r GROUP BY 1""".replace("\\\\", "\\"))
def a25(spark, sf):
    t = F.col("turn") % 3
    r = A.table(spark, sf, "conversations").select("conv_id", F.when(t == 0, "x_batch").when(t == 1, "x_line").otherwise("x_batch_fallback").alias("route"))
    batch = F.col("route").endswith("_batch")
    return r.groupBy("conv_id").agg((F.count_if(~batch) + F.max(batch.cast("bigint"))).alias("calls"))


@query("A28_prune_counters", "SELECT pair_id, page, count(*) FILTER (h >= 19) AS protected, count(*) FILTER (x > 150) AS rotated, count(*) FILTER (starts_with(text, 'The')) AS stripped FROM segments GROUP BY ALL", ("segments",))
def a28(spark, sf):
    return A.segments(spark, sf).groupBy("pair_id", "page").agg(F.count_if(F.col("h") >= 19).alias("protected"), F.count_if(F.col("x") > 150).alias("rotated"), F.count_if(F.col("text").startswith("The")).alias("stripped"))


@query("W13_island_runs", """WITH s AS (SELECT doc, seg_ord, cell_id, cell_id % 4 = 2 AS math, NOT regexp_matches(text, '\\p{L}{4,}') AS small FROM cells), m AS (SELECT *, math OR small AS in_run FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY doc, seg_ord ORDER BY cell_id) - row_number() OVER (PARTITION BY doc, seg_ord, in_run ORDER BY cell_id) AS g FROM m)
SELECT doc, seg_ord, min(cell_id) AS first, max(cell_id) AS last, count(*) AS spans FROM g WHERE in_run GROUP BY doc, seg_ord, g HAVING bool_or(math)""", ("cells",))
def w13(spark, sf):
    s = A.cells(spark, sf).select("doc", "seg_ord", "cell_id", (F.col("cell_id") % 4 == 2).alias("math"), (~F.col("text").rlike(r"\p{L}{4,}")).alias("small"))
    m = s.withColumn("run", (F.col("math") | F.col("small")).cast("int"))
    g = Q.islands(m, ["doc", "seg_ord"], "cell_id", ["run"])
    return g.where("run = 1").groupBy("doc", "seg_ord", "grp").agg(F.min("cell_id").alias("first"), F.max("cell_id").alias("last"), F.count(F.lit(1)).alias("spans"), F.bool_or("math").alias("m")).where("m").drop("grp", "m")


@query("W18_redundant_stray", """WITH t AS (SELECT doc, page, seg_ord, length(text) * 8.0::DOUBLE AS w, row_number() OVER (PARTITION BY doc, page ORDER BY seg_ord) AS rn FROM (SELECT pair_id AS doc, * FROM segments WHERE side = 0)), r AS (SELECT doc, page, median(w) AS m FROM t WHERE rn > 1 GROUP BY ALL)
SELECT t.doc, t.page, t.w < 0.5 * m AS stray FROM t JOIN r ON t.doc = r.doc AND t.page = r.page WHERE rn = 1""", ("segments",))
def w18(spark, sf):
    w = Window.partitionBy("doc", "page").orderBy("seg_ord")
    t = A.segments(spark, sf).where("side = 0").select(F.col("pair_id").alias("doc"), "page", "seg_ord", (F.length("text") * 8.0).alias("w")).withColumn("rn", F.row_number().over(w))
    r = t.where("rn > 1").groupBy("doc", "page").agg(F.percentile("w", F.lit(0.5)).alias("m"))
    return t.where("rn = 1").join(r, ["doc", "page"]).select("doc", "page", (F.col("w") < 0.5 * F.col("m")).alias("stray"))


@query("W20_justified", """WITH t AS (SELECT pair_id, page, x, x + w AS r, median(x) OVER g AS mx, median(x + w) OVER g AS mr, count(*) OVER g AS n, median(h) OVER g AS mh FROM segments WHERE side = 0 WINDOW g AS (PARTITION BY pair_id, page))
SELECT pair_id, page, n >= 3 AND count(*) FILTER (abs(x - mx) > mh) <= n // 4 AND count(*) FILTER (abs(r - mr) > mh) <= n // 4 + 1 AS justified FROM t GROUP BY pair_id, page, n""", ("segments",))
def w20(spark, sf):
    g = Window.partitionBy("pair_id", "page")
    mid = lambda c: F.percentile(c, F.lit(0.5)).over(g)
    t = A.segments(spark, sf).where("side = 0").withColumn("r", F.col("x") + F.col("w"))
    t = t.withColumn("mx", mid("x")).withColumn("mr", mid("r")).withColumn("mh", mid("h"))
    n = F.count(F.lit(1))
    quarter = (n / 4).cast("bigint")
    ok = (n >= 3) & (F.count_if(F.abs(F.col("x") - F.col("mx")) > F.col("mh")) <= quarter) & (F.count_if(F.abs(F.col("r") - F.col("mr")) > F.col("mh")) <= quarter + 1)
    return t.groupBy("pair_id", "page").agg(ok.alias("justified"))


@query("U07_score_differences", "SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after FROM (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority <> '5-LOW' GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def u07(spark, sf):
    o = A.table(spark, sf, "orders")
    side = lambda d, n: d.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias(n))
    j = side(o.where("o_orderkey % 2 = 0"), "before").join(side(o.where("o_orderkey % 2 = 1 and o_orderpriority <> '5-LOW'"), "after"), "k", "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("after")))


@query("U09_band_union", "SELECT pair_id, page, 'region' AS kind, x0 AS left_x, x1 AS right_x FROM regions WHERE side = 0 AND score >= 0.6 AND label = 'text' UNION ALL SELECT pair_id, page, 'artwork', x0, x1 FROM regions WHERE side = 0 AND label IN ('image', 'chart')", ("regions",))
def u09(spark, sf):
    r = A.regions(spark, sf).where("side = 0")
    kind = lambda d, k: d.select("pair_id", "page", F.lit(k).alias("kind"), F.col("x0").alias("left_x"), F.col("x1").alias("right_x"))
    return kind(r.where("score >= 0.6 and label = 'text'"), "region").unionByName(kind(r.where(F.col("label").isin(G.PRESERVE_LABELS)), "artwork"))


@query("U12_content_duplicates", "SELECT conv_id, turn, first_conv FROM (SELECT conv_id, turn, min(conv_id) OVER (PARTITION BY role, text) AS first_conv FROM conversations) WHERE conv_id <> first_conv")
def u12(spark, sf):
    c = A.table(spark, sf, "conversations").withColumn("h", F.sha2(F.to_json(F.struct("role", "text")), 256))
    first = c.groupBy("h").agg(F.min("conv_id").alias("first_conv"))
    return c.join(first, "h").where("conv_id <> first_conv").select("conv_id", "turn", "first_conv")


@query("H01_preserved_cells", "SELECT DISTINCT s.pair_id, s.side, s.seg_ord FROM segments s JOIN regions r ON s.pair_id = r.pair_id AND s.side = r.side AND s.page = r.page AND s.x + s.w / 2 BETWEEN r.x0 AND r.x1 AND s.y + s.h / 2 BETWEEN r.y0 AND r.y1 WHERE label IN ('image', 'chart') AND score >= 0.5", ("regions",))
def h01(spark, sf):
    from lectern.operators.scoring import centred

    s, r = centred(A.segments(spark, sf)), A.regions(spark, sf).where(F.col("label").isin(G.PRESERVE_LABELS) & (F.col("score") >= 0.5))
    k = [r[c] == s[c] for c in ("pair_id", "side", "page")]
    return s.join(r, k[0] & k[1] & k[2] & G.inside(s["cx"], s["cy"], G.box()), "left_semi").select("pair_id", "side", "seg_ord")


@query("H03_unique_stems", "SELECT p_name AS stem, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE CAST(min(p_partkey) AS VARCHAR) END AS source FROM part GROUP BY 1")
def h03(spark, sf):
    return A.table(spark, sf, "part").groupBy(F.col("p_name").alias("stem")).agg(F.when(F.count(F.lit(1)) > 1, "ambiguous").otherwise(F.min("p_partkey").cast("string")).alias("source"))


@query("H06_readback_language", "SELECT lang, coalesce(map {'de': 'german', 'fr': 'fr', 'en': 'en'}[lang], nullif(lang, ''), 'en') AS model, count(*) AS n FROM documents GROUP BY ALL")
def h06(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in {"de": "german", "fr": "fr", "en": "en"}.items() for x in kv])
    return A.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.coalesce(F.try_element_at(m, F.col("lang")), F.nullif("lang", F.lit("")), F.lit("en")).alias("model"), "n")


@query("H11_initial_stage", "SELECT event_type, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'render' ELSE 'extract' END AS stage, count(*) AS n FROM events GROUP BY ALL")
def h11(spark, sf):
    return A.table(spark, sf, "events").groupBy("event_type", F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "render").otherwise("extract").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("H13_prompt_choice", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN ' ' END), ''), CASE WHEN p_partkey % 2 = 0 THEN p_name END, 'default') AS prompt FROM part")
def h13(spark, sf):
    k = F.col("p_partkey")
    return A.table(spark, sf, "part").select("p_partkey", F.coalesce(F.nullif(F.trim(F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, " ")), F.lit("")), F.when(k % 2 == 0, F.col("p_name")), F.lit("default")).alias("prompt"))


@query("H14_route_label", "SELECT DISTINCT 'pool_' || lower(o_orderpriority) || '_' || o_orderstatus AS route FROM orders")
def h14(spark, sf):
    return A.table(spark, sf, "orders").select(F.concat_ws("_", F.lit("pool"), F.lower("o_orderpriority"), "o_orderstatus").alias("route")).distinct()


@query("H20_ink_box", "SELECT doc, seg_ord, min(x) FILTER (trim(text) <> '') AS left_x, max(x + w) FILTER (length(text) > 3) AS right_x FROM cells GROUP BY ALL", ("cells",))
def h20(spark, sf):
    return A.cells(spark, sf).groupBy("doc", "seg_ord").agg(F.min(F.when(F.trim("text") != "", F.col("x"))).alias("left_x"), F.max(F.when(F.length("text") > 3, F.col("x") + F.col("w"))).alias("right_x"))


@query("H22_plane_tokens", "SELECT doc, seg_ord, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+'))))), ' ') AS tokens FROM cells GROUP BY ALL", ("cells",))
def h22(spark, sf):
    return A.cells(spark, sf).groupBy("doc", "seg_ord").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.all_of(F.lower("text"), "[a-z0-9]+"))))), " ").alias("tokens"))


@query("H26_font_category", "SELECT p_name, CASE WHEN regexp_matches(lower(p_name), 'mono|courier|steel') THEN 'mono' WHEN regexp_matches(lower(p_name), 'serif|times|blue') THEN 'serif' ELSE 'sans' END AS category FROM part")
def h26(spark, sf):
    n = F.lower("p_name")
    return A.table(spark, sf, "part").select("p_name", F.when(n.rlike("mono|courier|steel"), "mono").when(n.rlike("serif|times|blue"), "serif").otherwise("sans").alias("category"))


@query("H28_upper_median_height", "SELECT doc, seg_ord, h AS median_h FROM (SELECT doc, seg_ord, h + cell_id % 4 AS h, row_number() OVER (PARTITION BY doc, seg_ord ORDER BY h + cell_id % 4) AS rn, count(*) OVER (PARTITION BY doc, seg_ord) AS n FROM cells) WHERE rn = n // 2 + 1", ("cells",))
def h28(spark, sf):
    g = A.cells(spark, sf).groupBy("doc", "seg_ord").agg(F.sort_array(F.collect_list(F.col("h") + F.col("cell_id") % 4)).alias("hs"))
    return g.select("doc", "seg_ord", F.get("hs", (F.size("hs") / 2).cast("int")).alias("median_h"))


@query("H29_first_call", "SELECT conv_id, arg_min(text, turn) FILTER (starts_with(role, 'assist')) AS reply FROM conversations GROUP BY 1")
def h29(spark, sf):
    c = A.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role").startswith("assist"), F.col("turn"))).alias("reply"))


@query("H37_setting_normalisers", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'auto' END AS mode, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS number FROM events")
def h37(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("auto").alias("mode"), F.expr("try_cast(regexp_extract(props, '[0-9]+', 0) as bigint)").alias("number"))


@query("G22_last_entry_per_key", "SELECT doc, seg_ord % 6 AS k, arg_max(text, cell_id) AS entry FROM cells GROUP BY ALL", ("cells",))
def g22(spark, sf):
    return A.cells(spark, sf).groupBy("doc", (F.col("seg_ord") % 6).alias("k")).agg(F.max_by("text", "cell_id").alias("entry"))


@query("G25_undetected_text", "SELECT doc, seg_ord, len(list_filter(regexp_extract_all(lower(any_value(t)), '[a-z0-9]+'), lambda x: NOT list_contains(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+'))), x))) > 0 AS undetected FROM (SELECT c.doc, c.seg_ord, c.text, h.text AS t FROM cells c JOIN segments h ON h.side = 1 AND c.doc = h.pair_id AND h.seg_ord = c.seg_ord) GROUP BY ALL", ("segments", "cells"))
def g25(spark, sf):
    tok = lambda c: T.all_of(F.lower(c), "[a-z0-9]+")
    c = A.cells(spark, sf).groupBy("doc", "seg_ord").agg(F.flatten(F.collect_list(tok("text"))).alias("have"))
    h = A.segments(spark, sf).where("side = 1").select(F.col("pair_id").alias("doc"), "seg_ord", "text")
    return c.join(h, ["doc", "seg_ord"]).select("doc", "seg_ord", (F.size(F.array_except(tok("text"), "have")) > 0).alias("undetected"))


@query("T02_queue_depth", f"WITH {STATE} SELECT seq, CAST(sum(CASE state WHEN 'queued' THEN 1 WHEN 'running' THEN -1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM requests", ("requests",))
def t02(spark, sf):
    d = F.when(F.col("state") == "queued", 1).when(F.col("state") == "running", -1).otherwise(0)
    w = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return A.requests(spark, sf).select("seq", F.sum(d).over(w).alias("depth"))


@query("T11_unreferenced_work", f"WITH {STATE} SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT request_id FROM st)", ("requests",))
def t11(spark, sf):
    st = X.last_state(A.requests(spark, sf)).select(F.col("request_id").alias("o_custkey"))
    return A.table(spark, sf, "orders").select("o_custkey").distinct().join(st, "o_custkey", "left_anti")


@query("X01_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def x01(spark, sf):
    """Extension: a relational smoke test over the star schema."""
    t = lambda n: A.table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
