"""Queries of document scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.operators import scoring as S
from lectern.sources import adapters as A

from .registry import query

SIGS = r"""sigs AS (SELECT pair_id, side, page, seg_ord, unnest(found) AS sig, generate_subscripts(found, 1) - 1 AS pos FROM (SELECT *, list_filter(list_transform(
    regexp_extract_all(regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g'), '[0-9]{2,}'), lambda r: ltrim(r, '0')), lambda r: length(r) >= 2) AS found FROM segments)),
sig_n AS (SELECT pair_id, sig, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM sigs GROUP BY ALL)"""
WORDS = r"regexp_extract_all({}, '[\p{L}]{2,}')"
ELIGIBLE = r"(trim(text) <> '' AND NOT regexp_matches(text, '(?i)(https?://|www\.|@)') AND coalesce(length(array_to_string(regexp_extract_all(text, '[\p{L}]{2,}'), '')), 0) >= 4)"
NORMAL = r"coalesce(array_to_string(regexp_extract_all(lower(text), '[\p{L}]{2,}'), ' '), '')"
FAMILY = "CASE WHEN label IN ('image', 'chart') THEN 'image' WHEN label = 'table' THEN 'table' WHEN label IN ('text', 'content', 'paragraph_title', 'doc_title', 'abstract', 'aside_text', 'list', 'header', 'footer', 'figure_title', 'table_title', 'reference') THEN 'text' ELSE 'other' END"
IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query("A04_anchor_survival", f"WITH {SIGS} SELECT pair_id, CAST(sum(a) AS BIGINT) AS total, CAST(sum(least(a, b)) AS BIGINT) AS survived, CASE WHEN sum(a) = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * sum(least(a, b)) / sum(a), 2) END AS axis FROM sig_n GROUP BY 1", ("segments",))
def a04(spark, sf):
    return S.anchor_survival(A.segments(spark, sf))


@query("A05_anchor_survival_repaired")
def a05(spark, sf):
    return S.anchor_survival_repaired(A.segments(spark, sf))


@query("A06_anchor_evidence", f"""WITH {SIGS}, need AS (SELECT pair_id, sig, 0 AS side, a - b AS n FROM sig_n WHERE a > b UNION ALL SELECT pair_id, sig, 1, b - a FROM sig_n WHERE b > a)
SELECT pair_id, side, page, seg_ord, pos, sig FROM (SELECT s.*, n, row_number() OVER (PARTITION BY s.pair_id, s.side, s.sig ORDER BY page, seg_ord, pos) AS rn FROM sigs s JOIN need USING (pair_id, sig, side)) WHERE rn <= n""", ("segments",))
def a06(spark, sf):
    return S.anchor_evidence(A.segments(spark, sf))


@query("O05_evidence_order", f"WITH {SIGS} SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY page, sig) AS place FROM (SELECT pair_id, page, sig, count(*) AS n FROM sigs WHERE side = 0 GROUP BY ALL)", ("segments",))
def o05(spark, sf):
    from pyspark.sql import Window

    s = S.signature_rows(A.segments(spark, sf)).where("side = 0").groupBy("pair_id", "page", "sig").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy("page", "sig")))


@query("U02_multiset_intersection", f"WITH {SIGS} SELECT pair_id, CAST(sum(least(a, b)) AS BIGINT) AS common, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS missing, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added FROM sig_n GROUP BY 1", ("segments",))
def u02(spark, sf):
    c = S.signature_counts(S.signature_rows(A.segments(spark, sf)))
    return c.groupBy("pair_id").agg(F.sum(F.least("n_source", "n_target")).alias("common"), F.sum(F.greatest(F.col("n_source") - F.col("n_target"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("n_target") - F.col("n_source"), F.lit(0))).alias("added"))


@query("W04_adjacent_pairs", f"WITH {SIGS} SELECT pair_id, side, page, sig AS first, second FROM (SELECT *, lead(sig) OVER (PARTITION BY pair_id, side, page ORDER BY seg_ord, pos) AS second FROM sigs) WHERE second IS NOT NULL", ("segments",))
def w04(spark, sf):
    return S.adjacent_pairs(A.segments(spark, sf))


@query("A07_volume_units", r"""WITH v AS (SELECT pair_id, side, coalesce(len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]')), 0) + coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0) AS n FROM segments)
SELECT pair_id, a AS source_units, b AS target_units, CASE WHEN a > 0 THEN round(b / a, 3) END AS ratio FROM (SELECT pair_id, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS BIGINT) AS a, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS BIGINT) AS b FROM v GROUP BY 1)""", ("segments",))
def a07(spark, sf):
    return S.volume(A.segments(spark, sf))


@query("P01_usable_regions", f"SELECT pair_id, side, page, reg_ord, label, score, {FAMILY} AS family FROM regions WHERE score >= 0.4", ("regions",))
def p01(spark, sf):
    return S.usable(A.regions(spark, sf)).select("pair_id", "side", "page", "reg_ord", "label", "score", "family")


@query("P02_region_family_counts", f"SELECT side, {FAMILY} AS family, count(*) AS n FROM regions GROUP BY ALL", ("regions",))
def p02(spark, sf):
    return A.regions(spark, sf).groupBy("side", G.family(F.col("label")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("P03_eligible_segments", f"SELECT pair_id, side, page, seg_ord, {ELIGIBLE} AS eligible FROM segments", ("segments",))
def p03(spark, sf):
    return A.segments(spark, sf).select("pair_id", "side", "page", "seg_ord", T.eligible(F.col("text")).alias("eligible"))


@query("P04_normalised_text", f"SELECT pair_id, side, seg_ord, {NORMAL} AS k FROM segments", ("segments",))
def p04(spark, sf):
    return A.segments(spark, sf).select("pair_id", "side", "seg_ord", T.normalised(F.col("text")).alias("k"))


CELL_WORDS = "w AS (SELECT doc, cell_id, unnest(string_split(text, ' ')) AS word FROM cells)"


@query("P05_nontranslatable", rf"""WITH {CELL_WORDS} SELECT word, count(*) AS n, (trim(word) = '' OR contains(lower(word), '://') OR starts_with(lower(word), 'www.') OR regexp_matches(lower(word), '\.(com|nl|org|net|io|de|fr|co|eu)\b')
    OR regexp_matches(word, '^[€$£]?\s*[-+]?\s*[0-9][0-9.,]*\s*[A-Z]?$') OR NOT regexp_matches(word, '\p{{L}}')) AS nontranslatable FROM w GROUP BY word""", ("cells",))
def p05(spark, sf):
    w = A.cells(spark, sf).select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("nontranslatable", T.nontranslatable(F.col("word")))


@query("P06_symbolic_label", rf"""WITH {CELL_WORDS} SELECT word, (trim(word) = '' OR (NOT regexp_matches(word, '[\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]') AND NOT regexp_matches(word, '\p{{Ll}}') AND NOT regexp_matches(word, '\p{{L}}{{2}}'))) AS symbolic FROM w GROUP BY word""", ("cells",))
def p06(spark, sf):
    w = A.cells(spark, sf).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.withColumn("symbolic", T.symbolic_label(F.col("word")))


@query("P07_noise", rf"WITH {CELL_WORDS} SELECT word, (length(trim(word)) <= 2 AND regexp_matches(trim(word), '^[\x00-\x7F]*$')) AS noise FROM w GROUP BY word", ("cells",))
def p07(spark, sf):
    w = A.cells(spark, sf).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.withColumn("noise", T.noise(F.col("word")))


@query("A03_region_weight", "SELECT pair_id, side, page, reg_ord, round(sqrt(greatest(0, x1 - x0) * greatest(0, y1 - y0)), 6) AS weight FROM regions", ("regions",))
def a03(spark, sf):
    return A.regions(spark, sf).select("pair_id", "side", "page", "reg_ord", F.round(G.weight(G.box()), 6).alias("weight"))


@query("J01_iou_candidates", f"""WITH u AS (SELECT *, {FAMILY} AS family FROM regions WHERE score >= 0.4), c AS (SELECT a.pair_id, a.page, a.reg_ord AS i, b.reg_ord AS j, {IOU} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
    FROM u a JOIN u b ON a.pair_id = b.pair_id AND a.page = b.page AND a.family = b.family AND a.side = 0 AND b.side = 1)
SELECT pair_id, page, i, j, round(o / (s - o), 9) AS iou FROM c WHERE o > 0 AND o / (s - o) >= 0.1""", ("regions",))
def j01(spark, sf):
    return S.iou_candidates(A.regions(spark, sf)).withColumn("iou", F.round("iou", 9))


@query("F30_iou_pairs", f"""SELECT a.pair_id, a.side, a.page, a.reg_ord AS i, b.reg_ord AS j, round(o / nullif(s - o, 0), 9) AS iou FROM (SELECT a.pair_id, a.side, a.page, a, b, {IOU} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
    FROM regions a JOIN regions b ON a.pair_id = b.pair_id AND a.page = b.page AND a.side = b.side AND a.reg_ord < b.reg_ord) WHERE o > 0""", ("regions",))
def f30(spark, sf):
    r = A.regions(spark, sf)
    side = lambda n: r.select("pair_id", "side", "page", F.col("reg_ord").alias(n), G.box().alias("box" + n))
    j = side("i").join(side("j"), ["pair_id", "side", "page"]).where("i < j").withColumn("iou", G.iou(F.col("boxi"), F.col("boxj"))).where("iou > 0")
    return j.select("pair_id", "side", "page", "i", "j", F.round("iou", 9).alias("iou"))


INSIDE = "s.x + s.w / 2 BETWEEN r.x0 AND r.x1 AND s.y + s.h / 2 BETWEEN r.y0 AND r.y1"
HOLD = f"segments s JOIN regions r ON s.pair_id = r.pair_id AND s.side = r.side AND s.page = r.page AND {INSIDE}"


@query("J04_smallest_region", f"SELECT pair_id, side, page, seg_ord, reg_ord FROM (SELECT s.pair_id, s.side, s.page, s.seg_ord, r.reg_ord, row_number() OVER (PARTITION BY s.pair_id, s.side, s.page, s.seg_ord ORDER BY (x1 - x0) * (y1 - y0), r.reg_ord) AS rn FROM {HOLD}) WHERE rn = 1", ("regions",))
def j04(spark, sf):
    return S.smallest_region(A.segments(spark, sf), A.regions(spark, sf), ["pair_id", "side", "page"], "reg_ord")


@query("J05_smallest_labelled_region", f"SELECT pair_id, side, page, seg_ord, reg_ord FROM (SELECT s.pair_id, s.side, s.page, s.seg_ord, r.reg_ord, row_number() OVER (PARTITION BY s.pair_id, s.side, s.page, s.seg_ord ORDER BY (x1 - x0) * (y1 - y0), r.reg_ord) AS rn FROM {HOLD} WHERE label IN ('image', 'chart') AND score >= 0.6) WHERE rn = 1", ("regions",))
def j05(spark, sf):
    sure = A.regions(spark, sf).where(F.col("label").isin(G.PRESERVE_LABELS) & (F.col("score") >= 0.6))
    return S.smallest_region(A.segments(spark, sf), sure, ["pair_id", "side", "page"], "reg_ord")


@query("J06_region_has_text", f"SELECT DISTINCT r.pair_id, r.side, r.page, r.reg_ord FROM {HOLD}", ("regions",))
def j06(spark, sf):
    s = S.centred(A.segments(spark, sf)).select("pair_id", "side", "page", "cx", "cy")
    r = A.regions(spark, sf)
    k = [r[c] == s[c] for c in ("pair_id", "side", "page")]
    return r.join(s, k[0] & k[1] & k[2] & G.inside(s["cx"], s["cy"], G.box()), "left_semi").select("pair_id", "side", "page", "reg_ord")


@query("J07_stray_segments", f"SELECT pair_id, side, page, seg_ord FROM segments s WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE s.pair_id = r.pair_id AND s.side = r.side AND s.page = r.page AND r.label IN ('text', 'image') AND {INSIDE})", ("regions",))
def j07(spark, sf):
    s, r = S.centred(A.segments(spark, sf)), A.regions(spark, sf).where(F.col("label").isin("text", "image"))
    k = [r[c] == s[c] for c in ("pair_id", "side", "page")]
    return s.join(r, k[0] & k[1] & k[2] & G.inside(s["cx"], s["cy"], G.box()), "left_anti").select("pair_id", "side", "page", "seg_ord")


@query("A08_text_fate", f"""WITH e AS (SELECT pair_id, page, side, {NORMAL} AS k FROM segments WHERE {ELIGIBLE}), p AS (SELECT pair_id, page, k, bool_or(side = 0) AS a, bool_or(side = 1) AS b FROM e GROUP BY ALL)
SELECT pair_id, page, count(*) FILTER (a) AS eligible, count(*) FILTER (a AND b) AS unchanged FROM p GROUP BY ALL""", ("segments",))
def a08(spark, sf):
    return S.text_fate(A.segments(spark, sf))


@query("U03_unchanged_keys", f"SELECT k, count(*) AS n FROM (SELECT pair_id, page, {NORMAL} AS k FROM segments WHERE side = 0 AND {ELIGIBLE} INTERSECT SELECT pair_id, page, {NORMAL} FROM segments WHERE side = 1 AND {ELIGIBLE}) GROUP BY k", ("segments",))
def u03(spark, sf):
    s = A.segments(spark, sf).where(T.eligible(F.col("text"))).select("pair_id", "page", "side", T.normalised(F.col("text")).alias("k"))
    side = lambda n: s.where(F.col("side") == n).drop("side")
    return side(0).intersect(side(1)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("A09_stray_share", f"""WITH t AS (SELECT s.*, EXISTS (SELECT 1 FROM regions r WHERE s.pair_id = r.pair_id AND r.side = 1 AND s.page = r.page AND {INSIDE}) AS held FROM segments s WHERE side = 1)
SELECT pair_id, page, CASE WHEN sum(w * h) > 0 THEN round(coalesce(sum(w * h) FILTER (NOT held), 0) / sum(w * h), 4) ELSE 0.0::DOUBLE END AS share FROM t GROUP BY ALL""", ("regions",))
def a09(spark, sf):
    return S.stray_share(A.segments(spark, sf), A.regions(spark, sf))


@query("A10_structure_flags", """SELECT pair_id, count(*) FILTER (side = 0 AND label IN ('image', 'chart') AND score >= 0.5) AS image_source, count(*) FILTER (side = 1 AND label IN ('image', 'chart') AND score >= 0.5) AS image_target,
    count(*) FILTER (side = 0 AND label = 'table' AND score >= 0.5) AS table_source, count(*) FILTER (side = 1 AND label = 'table' AND score >= 0.5) AS table_target, image_source = image_target AS image_equal, table_source = table_target AS table_equal FROM regions GROUP BY 1""", ("regions",))
def a10(spark, sf):
    return S.region_counts(A.regions(spark, sf))


@query("A11_mean_or_hundred", "SELECT p.pair_id, round(coalesce(avg(score) FILTER (label = 'table'), 100.0), 6) AS mean FROM regions p GROUP BY 1", ("regions",))
def a11(spark, sf):
    return A.regions(spark, sf).groupBy("pair_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("label") == "table", F.col("score"))), F.lit(100.0)), 6).alias("mean"))


@query("O03_candidate_order", f"""WITH u AS (SELECT *, {FAMILY} AS family FROM regions WHERE score >= 0.4), c AS (SELECT a.pair_id, a.page, a.reg_ord AS i, b.reg_ord AS j, {IOU} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
    FROM u a JOIN u b ON a.pair_id = b.pair_id AND a.page = b.page AND a.family = b.family AND a.side = 0 AND b.side = 1)
SELECT pair_id, page, i, j, row_number() OVER (PARTITION BY pair_id, page ORDER BY o / (s - o) DESC, i DESC, j DESC) AS place FROM c WHERE o > 0 AND o / (s - o) >= 0.1""", ("regions",))
def o03(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id", "page").orderBy(F.desc("iou"), F.desc("i"), F.desc("j"))
    return S.iou_candidates(A.regions(spark, sf)).withColumn("place", F.row_number().over(w)).drop("iou")


@query("O04_region_order", "SELECT pair_id, side, page, reg_ord, row_number() OVER (PARTITION BY pair_id, side, page ORDER BY score DESC, reg_ord) AS place FROM regions WHERE score >= 0.4", ("regions",))
def o04(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id", "side", "page").orderBy(F.desc("score"), "reg_ord")
    return S.usable(A.regions(spark, sf)).select("pair_id", "side", "page", "reg_ord", F.row_number().over(w).alias("place"))


@query("J03_covered_fraction", f"""WITH r AS (SELECT *, {FAMILY} AS family, (x1 - x0) * (y1 - y0) AS own FROM regions WHERE score >= 0.4),
clip AS (SELECT a.pair_id, a.page, a.reg_ord, a.own, greatest(a.x0, b.x0) AS cx0, greatest(a.y0, b.y0) AS cy0, least(a.x1, b.x1) AS cx1, least(a.y1, b.y1) AS cy1
    FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.page = b.page AND a.family = b.family AND a.side = 0 AND b.side = 1 WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
xs AS (SELECT pair_id, page, reg_ord, v AS xa, lead(v) OVER (PARTITION BY pair_id, page, reg_ord ORDER BY v) AS xb FROM (SELECT pair_id, page, reg_ord, cx0 AS v FROM clip UNION SELECT pair_id, page, reg_ord, cx1 FROM clip)),
ys AS (SELECT pair_id, page, reg_ord, v AS ya, lead(v) OVER (PARTITION BY pair_id, page, reg_ord ORDER BY v) AS yb FROM (SELECT pair_id, page, reg_ord, cy0 AS v FROM clip UNION SELECT pair_id, page, reg_ord, cy1 FROM clip)),
g AS (SELECT x.pair_id, x.page, x.reg_ord, sum((xb - xa) * (yb - ya)) AS covered FROM xs x JOIN ys y USING (pair_id, page, reg_ord) WHERE xb IS NOT NULL AND yb IS NOT NULL
    AND EXISTS (SELECT 1 FROM clip c WHERE c.pair_id = x.pair_id AND c.page = x.page AND c.reg_ord = x.reg_ord AND cx0 <= xa AND cx1 >= xb AND cy0 <= ya AND cy1 >= yb) GROUP BY ALL)
SELECT r.pair_id, r.page, r.reg_ord, CASE WHEN own > 0 THEN round(coalesce(covered, 0) / own, 9) ELSE 0.0::DOUBLE END AS fraction FROM r LEFT JOIN g USING (pair_id, page, reg_ord) WHERE side = 0""", ("regions",))
def j03(spark, sf):
    u = S.usable(A.regions(spark, sf))
    others = u.where("side = 1").groupBy("pair_id", "page", "family").agg(F.collect_list(G.box()).alias("others"))
    j = u.where("side = 0").withColumn("box", G.box()).join(others, ["pair_id", "page", "family"], "left")
    fraction = F.when(F.col("others").isNull(), 0.0).otherwise(S.covered_fraction(F.col("box"), F.col("others")))
    return j.select("pair_id", "page", "reg_ord", F.round(fraction, 9).alias("fraction"))


@query("J14_page_pairs", "SELECT DISTINCT pair_id, page FROM (SELECT pair_id, page FROM segments WHERE side = 0 INTERSECT SELECT pair_id, page FROM segments WHERE side = 1)", ("segments",))
def j14(spark, sf):
    s = A.segments(spark, sf)
    return s.groupBy("pair_id", "page").agg(F.count_distinct("side").alias("n")).where("n = 2").select("pair_id", "page")


@query("F31_centres", "SELECT pair_id, side, seg_ord, x + w / 2 AS cx, y + h / 2 AS cy FROM segments", ("segments",))
def f31(spark, sf):
    return S.centred(A.segments(spark, sf)).select("pair_id", "side", "seg_ord", "cx", "cy")


@query("J02_prepared_regions")
def j02(spark, sf):
    p = S.page_regions(A.regions(spark, sf))
    return p.select("pair_id", "page", F.size("source").alias("n_source"), F.size("target").alias("n_target"), F.transform("source", lambda x: x["reg_ord"]).alias("kept_source"), F.transform("target", lambda x: x["reg_ord"]).alias("kept_target"))


@query("G01_page_matching")
def g01(spark, sf):
    m = S.match_pages(A.regions(spark, sf))
    return m.select("pair_id", "page", F.transform("matches", lambda k: F.struct(k["i"].alias("i"), k["j"].alias("j"), F.round(k["iou"], 6).alias("iou"))).alias("matches"), "covered_source", "lost", "covered_target", "invented")


@query("J17_region_statuses")
def j17(spark, sf):
    return S.region_statuses(S.match_pages(A.regions(spark, sf)))


@query("A02_page_scores")
def a02(spark, sf):
    p = S.score_pages(A.segments(spark, sf), A.regions(spark, sf))
    return p.withColumns({c: F.round(c, 2) for c in ("layout", "retention", "typography")}).drop("numerator", "matched_weight", "denominator")


@query("G02_pair_scores")
def g02(spark, sf):
    return S.score_pairs(A.segments(spark, sf), A.regions(spark, sf))


@query("G04_identity_baseline")
def g04(spark, sf):
    """Every document scored against itself: layout and anchors 100, ratio 1."""
    twice = lambda d: d.where("side = 0").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    s = S.score_pairs(twice(A.segments(spark, sf)), twice(A.regions(spark, sf)))
    return s.select("pair_id", "layout", "anchors", "typography", "volume_ratio", "layout_noise_share")
