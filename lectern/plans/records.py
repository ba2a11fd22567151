"""Queries of stores, differences, the reply protocol and the runtime."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import differences as D
from lectern.operators import protocol as P
from lectern.operators import runtime as X
from lectern.operators import store as S
from lectern.sources import adapters as A

from .registry import query


@query("S01_list_runs", "SELECT doc_id, system, count(*) AS runs, min(run_id) AS first_run, max(run_id) AS last_run FROM runs GROUP BY ALL", ("runs",))
def s01(spark, sf):
    return A.runs(spark, sf).groupBy("doc_id", "system").agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))


@query("S02_load_scores", "SELECT doc_id, system, run_id, CASE WHEN has_scores THEN layout END AS layout, CASE WHEN has_scores THEN anchors END AS anchors FROM runs", ("runs",))
def s02(spark, sf):
    r = A.runs(spark, sf)
    scores = r.where("has_scores").select("run_id", "layout", "anchors")
    return r.select("doc_id", "system", "run_id").join(scores, "run_id", "left")


@query("S03_run_ids", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') || '-' || substr(sha256(o_orderpriority || ':' || o_custkey), 1, 8) AS run_id FROM orders")
def s03(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select("o_orderkey", S.run_id(F.col("o_orderdate"), F.concat_ws(":", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("run_id"))


@query("S04_latest_run", "SELECT doc_id, system, run_id, layout, anchors, has_scores FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, system ORDER BY run_id DESC) AS rn FROM runs) WHERE rn = 1", ("runs",))
def s04(spark, sf):
    return S.latest_runs(A.runs(spark, sf))


@query("S05_delete_cell", "SELECT system, count(*) AS kept FROM runs WHERE NOT (doc_id = 1 AND system = '1-URGENT') GROUP BY 1", ("runs",))
def s05(spark, sf):
    kept, _ = S.delete_cell(A.runs(spark, sf), 1, "1-URGENT")
    return kept.groupBy("system").agg(F.count(F.lit(1)).alias("kept"))


@query("S06_runs_index", "SELECT doc_id, system, run_id, layout, anchors FROM runs WHERE has_scores", ("runs",))
def s06(spark, sf):
    return A.runs(spark, sf).where("has_scores").select("doc_id", "system", "run_id", "layout", "anchors")


@query("S12_fixture_paths", "SELECT url, split_part(url, '/', -1) AS variant, split_part(url, '/', -2) AS lang, split_part(url, '/', -3) AS name FROM pages")
def s12(spark, sf):
    part = lambda i: F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(i)), F.lit(""))
    return A.table(spark, sf, "pages").select("url", part(-1).alias("variant"), part(-2).alias("lang"), part(-3).alias("name"))


CENSUS = "census AS (SELECT page_id, length(html) AS chars, round(length(coalesce(html, '')) % 1000 / 950.0::DOUBLE, 6) AS coverage, page_id % 4 AS rotation FROM pages)"


def _census(spark, sf):
    p = A.table(spark, sf, "pages")
    return p.select("page_id", F.length("html").alias("chars"), F.round(F.length(F.coalesce("html", F.lit(""))) % 1000 / 950.0, 6).alias("coverage"), (F.col("page_id") % 4).alias("rotation"))


def page_class(coverage, chars):
    return F.when(coverage >= 0.9, F.when(chars > 1500, "hybrid").otherwise("scanned")).otherwise("born_digital")


@query("S13_page_census", f"WITH {CENSUS} SELECT page_id, chars, least(1.0::DOUBLE, coverage) AS coverage, CASE WHEN chars IS NULL OR chars = 0 THEN 'empty' WHEN page_id >= 200 THEN 'over_cap' ELSE 'ok' END AS verdict FROM census")
def s13(spark, sf):
    v = F.when(F.coalesce("chars", F.lit(0)) == 0, "empty").when(F.col("page_id") >= 200, "over_cap").otherwise("ok")
    return _census(spark, sf).select("page_id", "chars", F.least(F.lit(1.0), "coverage").alias("coverage"), v.alias("verdict"))


@query("P08_page_class", f"WITH {CENSUS} SELECT page_id, CASE WHEN coverage >= 0.9 THEN CASE WHEN chars > 1500 THEN 'hybrid' ELSE 'scanned' END ELSE 'born_digital' END AS page_class FROM census")
def p08(spark, sf):
    return _census(spark, sf).select("page_id", page_class(F.col("coverage"), F.col("chars")).alias("page_class"))


@query("P09_cell_source", f"WITH {CENSUS} SELECT page_id, CASE WHEN coverage < 0.9 AND rotation <> 3 THEN 'text_layer' ELSE 'ocr' END AS cell_source FROM census")
def p09(spark, sf):
    own = (page_class(F.col("coverage"), F.col("chars")) == "born_digital") & (F.col("rotation") != 3)
    return _census(spark, sf).select("page_id", F.when(own, "text_layer").otherwise("ocr").alias("cell_source"))


@query("P10_ocr_language", r"SELECT doc_id, CASE WHEN source = 'src3' THEN 'fixed' WHEN coalesce(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')), 0) >= 2 THEN 'cjk' ELSE coalesce(nullif(lang, ''), 'en') END AS model FROM documents")
def p10(spark, sf):
    n = F.coalesce(F.regexp_count("text", F.lit("[一-鿿぀-ヿ가-힯]")), F.lit(0))
    return A.table(spark, sf, "documents").select("doc_id", F.when(F.col("source") == "src3", "fixed").when(n >= 2, "cjk").otherwise(F.coalesce(F.nullif("lang", F.lit("")), F.lit("en"))).alias("model"))


@query("P11_rotated_tall", "SELECT doc, cell_id, CAST(floor(sqrt(h * h + 9)) AS BIGINT) / CAST(floor(sqrt(w * w + 16) / 8) AS BIGINT) >= 1.5 AS tall FROM cells", ("cells",))
def p11(spark, sf):
    return A.cells(spark, sf).select("doc", "cell_id", (F.floor(F.hypot("h", F.lit(3.0))) / F.floor(F.hypot("w", F.lit(4.0)) / 8) >= 1.5).alias("tall"))


@query("P12_span_protection", r"""SELECT p_partkey, CASE WHEN regexp_matches(regexp_replace(p_type, '^[A-Z]{6}\+', ''), '(?i)(math|symbol|STEEL)') THEN 'math' WHEN regexp_matches(p_type, '(?i)(BRASS|wingdings)') THEN 'symbol' ELSE 'none' END AS protection FROM part""")
def p12(spark, sf):
    bare = F.regexp_replace("p_type", r"^[A-Z]{6}\+", "")
    return A.table(spark, sf, "part").select("p_partkey", F.when(bare.rlike("(?i)(math|symbol|STEEL)"), "math").when(F.col("p_type").rlike("(?i)(BRASS|wingdings)"), "symbol").otherwise("none").alias("protection"))


@query("P13_separators", r"SELECT doc, line_idx, regexp_full_match(replace(trim(split_part(text, ' ', 1)), ' ', ''), '[#\-=*:.,]{3,}') AS separator FROM hint_lines", ("hint_lines",))
def p13(spark, sf):
    return A.hint_lines(spark, sf).select("doc", "line_idx", F.replace(F.trim(F.split_part("text", F.lit(" "), F.lit(1))), F.lit(" "), F.lit("")).rlike(r"^[#\-=*:.,]{3,}$").alias("separator"))


@query("P14_category_preserves", "SELECT p_type, regexp_matches(lower(p_type), 'academic|scientific|research paper|polished') AS preserves, count(*) AS n FROM part GROUP BY ALL")
def p14(spark, sf):
    return A.table(spark, sf, "part").groupBy("p_type", F.lower("p_type").rlike("academic|scientific|research paper|polished").alias("preserves")).agg(F.count(F.lit(1)).alias("n"))


@query("P15_word_for_word", r"""SELECT pair_id, seg_ord, len(regexp_extract_all(a, '\p{L}+')) > 0 AND regexp_extract_all(a, '[\p{L}\p{N}]+') = regexp_extract_all(b, '[\p{L}\p{N}]+') AS preserved
FROM (SELECT s.pair_id, s.seg_ord, s.text AS a, t.text AS b FROM segments s JOIN segments t ON s.pair_id = t.pair_id AND s.seg_ord = t.seg_ord AND s.side = 0 AND t.side = 1)""", ("segments",))
def p15(spark, sf):
    s = A.segments(spark, sf)
    j = s.where("side = 0").select("pair_id", "seg_ord", F.col("text").alias("a")).join(s.where("side = 1").select("pair_id", "seg_ord", F.col("text").alias("b")), ["pair_id", "seg_ord"])
    return j.select("pair_id", "seg_ord", (F.col("a").rlike(T.LETTER) & (T.all_of(F.col("a"), T.TOKEN) == T.all_of(F.col("b"), T.TOKEN))).alias("preserved"))


@query("P20_safe_token", r"SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 20), ''), 'item') AS token FROM pages")
def p20(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.safe_token(F.col("url"), longest=20).alias("token"))


@query("G03_rescore_changed", "SELECT run_id, axis, before, after FROM (SELECT run_id, 'layout' AS axis, layout AS before, CASE WHEN has_scores THEN layout + (doc_id % 3 = 0)::INT END AS after FROM runs UNION ALL SELECT run_id, 'anchors', anchors, anchors FROM runs) WHERE before IS DISTINCT FROM after", ("runs",))
def g03(spark, sf):
    r = A.runs(spark, sf)
    after = r.select("run_id", F.when(F.col("has_scores"), F.col("layout") + (F.col("doc_id") % 3 == 0).cast("int")).alias("layout"), "anchors")
    return S.changed_axes(r.select("run_id", "layout", "anchors"), after, ["run_id"], ["layout", "anchors"])


@query("A29_matrix_inventory", "SELECT doc_id, count(*) FILTER (system = '1-URGENT') AS urgent, count(*) FILTER (system = '2-HIGH') AS high, count(*) FILTER (system = '5-LOW') AS low FROM runs GROUP BY 1", ("runs",))
def a29(spark, sf):
    p = A.runs(spark, sf).groupBy("doc_id").pivot("system", ["1-URGENT", "2-HIGH", "5-LOW"]).count().fillna(0)
    return p.select("doc_id", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


@query("S15_prompt_overlay", "SELECT coalesce(u.id, b.id) AS id, coalesce(u.body, b.body) AS body, u.body IS NOT NULL AS own FROM (SELECT p_partkey AS id, p_name AS body FROM part WHERE p_partkey % 3 <> 0) b FULL JOIN (SELECT p_partkey AS id, p_type AS body FROM part WHERE p_partkey % 2 = 0) u ON b.id = u.id")
def s15(spark, sf):
    p = A.table(spark, sf, "part")
    b = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body"))
    u = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("body"))
    return S.overlay(b, u)


@query("S14_layered_settings", "SELECT p_partkey, greatest(1, least(40, coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_size + 30 END, CASE WHEN p_partkey % 3 = 0 THEN p_size - 5 END, 10))) AS slots FROM part")
def s14(spark, sf):
    own, site = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 30), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") - 5)
    return A.table(spark, sf, "part").select("p_partkey", S.setting([F.lit(10), site, own], 1, 40).alias("slots"))


@query("O11_next_variant", "SELECT p_brand, 'v' || (coalesce(max(CAST(nullif(regexp_extract(v, '^v([0-9]+)$', 1), '') AS BIGINT)), 0) + 1) AS next FROM (SELECT p_brand, CASE WHEN p_size % 4 = 0 THEN 'draft' ELSE 'v' || p_size END AS v FROM part) GROUP BY 1")
def o11(spark, sf):
    v = F.when(F.col("p_size") % 4 == 0, "draft").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string")))
    return S.next_variant(A.table(spark, sf, "part").select("p_brand", v.alias("variant")), ["p_brand"])


LINKS = "links AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey // 2 END AS source_id, o_totalprice > 150000 AS ok FROM orders)"


@query("J18_lineage_walk", f"""WITH RECURSIVE {LINKS}, walk AS (SELECT id AS start, id AS here, source_id, ok, 0 AS hops FROM links UNION ALL SELECT w.start, l.id, l.source_id, l.ok, w.hops + 1 FROM walk w JOIN links l ON w.source_id = l.id WHERE NOT w.ok AND w.hops < 8 AND l.id <> w.start)
SELECT start AS id, here AS root, CAST(hops AS BIGINT) AS hops FROM walk WHERE ok""")
def j18(spark, sf):
    o = A.table(spark, sf, "orders")
    links = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") / 2).cast("bigint")).alias("source_id"), "o_totalprice")
    return S.lineage(links, F.col("o_totalprice") > 150000)


@query("J24_content_identity", "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents) WHERE doc_id <> first")
def j24(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").where("doc_id <> first").select("doc_id", "first")


@query("F44_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f44(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))




@query("U04_unit_differences", """SELECT pair_id, seg_ord, field, expected, actual FROM (SELECT e.pair_id, e.seg_ord, unnest(['h', 'page']) AS field, unnest([CAST(CAST(e.h AS BIGINT) AS VARCHAR), CAST(e.page AS VARCHAR)]) AS expected, unnest([CAST(CAST(a.h AS BIGINT) AS VARCHAR), CAST(a.page AS VARCHAR)]) AS actual
FROM segments e JOIN segments a ON e.pair_id = a.pair_id AND e.seg_ord = a.seg_ord AND e.side = 0 AND a.side = 1) WHERE expected IS DISTINCT FROM actual""", ("segments",))
def u04(spark, sf):
    s = A.segments(spark, sf).withColumn("h", F.col("h").cast("bigint"))
    side = lambda n: s.where(F.col("side") == n).select("pair_id", "seg_ord", "h", "page")
    return D.field_differences(side(0), side(1), ["pair_id", "seg_ord"], ["h", "page"])


@query("U05_census_differences", "SELECT pair_id, page, CAST(count(*) FILTER (side = 0) AS BIGINT) AS expected, CAST(count(*) FILTER (side = 1) AS BIGINT) AS actual FROM segments GROUP BY ALL HAVING count(*) FILTER (side = 0) <> count(*) FILTER (side = 1)", ("segments",))
def u05(spark, sf):
    s = A.segments(spark, sf)
    return D.count_differences(s.where("side = 0"), s.where("side = 1"), ["pair_id", "page"])


NORM = r"lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))"


@query("U01_multiset_difference", f"WITH t AS (SELECT pair_id, page, {NORM} AS k, sum(CASE side WHEN 0 THEN 1 ELSE -1 END) AS d FROM segments GROUP BY ALL) SELECT pair_id, page, k, CAST(greatest(0, d) AS BIGINT) AS missing, CAST(greatest(0, -d) AS BIGINT) AS extra FROM t WHERE d <> 0", ("segments",))
def u01(spark, sf):
    s = A.segments(spark, sf).withColumn("k", T.alnum_form(F.col("text")))
    return D.multiset_difference(s.where("side = 0"), s.where("side = 1"), ["pair_id", "page", "k"])


@query("F11_alnum_form", f"SELECT pair_id, side, seg_ord, {NORM} AS k FROM segments", ("segments",))
def f11(spark, sf):
    return A.segments(spark, sf).select("pair_id", "side", "seg_ord", T.alnum_form(F.col("text")).alias("k"))


@query("U08_budget_rows", "WITH c AS (SELECT doc, text, count(*) FILTER (seg_ord % 2 = 0) AS n FROM cells GROUP BY ALL) SELECT doc, text, cell_id FROM (SELECT x.doc, x.text, cell_id, n, row_number() OVER (PARTITION BY x.doc, x.text ORDER BY cell_id) AS rn FROM cells x JOIN c ON c.doc = x.doc AND c.text = x.text) WHERE rn <= n", ("cells",))
def u08(spark, sf):
    c = A.cells(spark, sf)
    b = c.groupBy("doc", "text").agg(F.count_if(F.col("seg_ord") % 2 == 0).alias("n"))
    return D.budget_rows(c, ["doc", "text"], ["cell_id"], b, "n").select("doc", "text", "cell_id")


@query("O10_first_differences", """WITH d AS (SELECT e.pair_id, e.seg_ord, row_number() OVER (PARTITION BY e.pair_id ORDER BY e.seg_ord) AS rn, count(*) OVER (PARTITION BY e.pair_id) AS n FROM segments e JOIN segments a ON e.pair_id = a.pair_id AND e.seg_ord = a.seg_ord AND e.side = 0 AND a.side = 1 AND e.text <> a.text)
SELECT pair_id, seg_ord, n - least(n, 3) AS more FROM d WHERE rn <= 3""", ("segments",))
def o10(spark, sf):
    s = A.segments(spark, sf)
    j = s.where("side = 0").select("pair_id", "seg_ord", F.col("text").alias("a")).join(s.where("side = 1").select("pair_id", "seg_ord", F.col("text").alias("b")), ["pair_id", "seg_ord"]).where("a <> b")
    w = Window.partitionBy("pair_id")
    d = j.withColumn("rn", F.row_number().over(w.orderBy("seg_ord"))).withColumn("n", F.count(F.lit(1)).over(w))
    return d.where("rn <= 3").select("pair_id", "seg_ord", (F.col("n") - F.least(F.col("n"), F.lit(3))).alias("more"))


@query("J15_nearest_consuming")
def j15(spark, sf):
    c = A.cells(spark, sf).select("doc", F.col("cell_id").alias("ord"), T.alnum_form(F.col("text")).alias("k"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    moved = c.withColumn("cx", F.col("cx") + F.col("ord") % 5).where("ord % 13 <> 0")
    return D.nearest_consuming(c, moved, ["doc", "k"]).select("doc", "k", "ord", F.round("shift", 6).alias("shift"), "moved")


# --- replies ------------------------------------------------------------------------------------

REPLIES = r"replies AS (SELECT conv_id * 1000 + turn AS reply_id, '1. ' || replace(coalesce(text, ''), chr(10), chr(10) || CASE WHEN turn % 2 = 0 THEN '2) ' ELSE '' END) AS text FROM conversations)"


def _replies(spark, sf):
    c = A.table(spark, sf, "conversations")
    mark = F.when(F.col("turn") % 2 == 0, F.lit("\n2) ")).otherwise(F.lit("\n"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.concat(F.lit("1. "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), mark)).alias("text"))


NUMBERED = rf"""{REPLIES}, x AS (SELECT reply_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM replies),
y AS (SELECT *, CASE WHEN regexp_matches(raw, '^\s*[0-9]+[.)]') THEN CAST(regexp_extract(raw, '^\s*([0-9]+)[.)]', 1) AS BIGINT) END AS n FROM x), z AS (SELECT *, sum(CAST(n IS NOT NULL AS INT)) OVER (PARTITION BY reply_id ORDER BY ln) AS item FROM y),
i AS (SELECT reply_id, item, max(n) AS n, trim(string_agg(CASE WHEN n IS NOT NULL THEN regexp_extract(raw, '^\s*[0-9]+[.)]\s*(.*)$', 1) ELSE trim(raw) END, ' ' ORDER BY ln) FILTER (n IS NOT NULL OR trim(raw) <> '')) AS text FROM z WHERE item > 0 GROUP BY ALL),
numbered AS (SELECT reply_id, n, max_by(text, item) AS text FROM i GROUP BY ALL)"""


@query("F21_numbered_parse", f"WITH {NUMBERED} SELECT reply_id, n, text FROM numbered")
def f21(spark, sf):
    return P.numbered(_replies(spark, sf))


@query("G16_numbered_accept", f"WITH {NUMBERED}, g AS (SELECT reply_id, list_sort(list(n)) AS got FROM numbered GROUP BY 1) SELECT r.reply_id, coalesce(got = CASE WHEN r.reply_id % 3 > 0 THEN CAST(range(1, r.reply_id % 3 + 1) AS BIGINT[]) ELSE [] END, r.reply_id % 3 = 0) AS accepted FROM replies r LEFT JOIN g USING (reply_id)")
def g16(spark, sf):
    r = _replies(spark, sf)
    return P.numbered_accepted(P.numbered(r), r.select("reply_id", (F.col("reply_id") % 3).alias("asked")))


BLOCKTEXT = "bt AS (SELECT conv_id * 1000 + turn AS reply_id, 'Category: x' || chr(10) || replace(replace(coalesce(text, ''), '. ', chr(10) || '###' || chr(10)), ', ', chr(10) || '- ') || chr(10) || '---' AS text FROM conversations)"


@query("F22_block_parse", rf"""WITH {BLOCKTEXT}, x AS (SELECT reply_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM bt), y AS (SELECT *, starts_with(lower(line), 'category:') AS cat FROM x WHERE line <> ''),
z AS (SELECT *, sum(CAST(cat AS INT)) OVER (PARTITION BY reply_id ORDER BY ln) AS c, regexp_full_match(replace(line, ' ', ''), '[#\-=*:]{{3,}}') AS rule FROM y), w AS (SELECT *, sum(CAST(rule AND contains(line, '#') AS INT)) OVER (PARTITION BY reply_id ORDER BY ln) AS b FROM z WHERE NOT (cat AND c = 1)),
v AS (SELECT reply_id, b, ln, trim(regexp_replace(trim(CASE WHEN regexp_matches(line, '^[-*#]+(\s|$)') THEN regexp_replace(line, '^[-*#]+', '') ELSE line END), '^\*+|\*+$', '', 'g')) AS line FROM w WHERE NOT rule)
SELECT reply_id, dense_rank() OVER (PARTITION BY reply_id ORDER BY b) - 1 AS block, row_number() OVER (PARTITION BY reply_id, b ORDER BY ln) - 1 AS line_no, line FROM v WHERE line <> ''""")
def f22(spark, sf):
    c = A.table(spark, sf, "conversations")
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n###\n")), F.lit(", "), F.lit("\n- "))
    return P.blocks(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.concat(F.lit("Category: x\n"), t, F.lit("\n---")).alias("text")))


TURNS = "tp AS (SELECT a.conv_id * 1000 + a.turn AS unit_id, coalesce(a.text, '') AS source_text, coalesce(b.text, '') || CASE WHEN a.conv_id % 5 = 0 THEN ' *x* $a_b$' ELSE '' END AS translated FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, sf):
    c = A.table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("s"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("t"))
    tail = F.when(F.col("conv_id") % 5 == 0, " *x* $a_b$").otherwise("")
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), F.col("s").alias("source_text"), F.concat("t", tail).alias("translated"))


@query("F20_crosstalk_gate", f"WITH {TURNS} SELECT unit_id, length(trim(translated, E' \\n')) > greatest(20, 4 * length(trim(source_text, E' \\n'))) AS crosstalk FROM tp")
def f20(spark, sf):
    return _turns(spark, sf).select("unit_id", P.crosstalk(F.col("source_text"), F.col("translated")).alias("crosstalk"))


@query("F18_emphasis_gate", rf"WITH {TURNS} SELECT unit_id, contains(translated, '*') AND NOT contains(source_text, '*') AS leak FROM tp")
def f18(spark, sf):
    return _turns(spark, sf).select("unit_id", P.emphasis_leak(F.col("source_text"), F.col("translated")).alias("leak"))


@query("F19_tex_gate", rf"WITH {TURNS} SELECT unit_id, regexp_matches(translated, '\\[a-zA-Z]{{2,}}') OR len(list_filter(regexp_extract_all(translated, '\$([^$]{{1,40}})\$', 1), lambda x: regexp_matches(x, '[_^{{}}\\]') OR regexp_full_match(trim(x, E' \n'), '[A-Za-z0-9(),./]{{1,6}}'))) > 0 AS markup FROM tp")
def f19(spark, sf):
    return _turns(spark, sf).select("unit_id", P.tex_markup(F.col("translated")).alias("markup"))


@query("F18_F19_stripped_replies")
def f18b(spark, sf):
    return _turns(spark, sf).select("unit_id", P.strip_tex(P.strip_emphasis(F.col("translated"))).alias("text"))


@query("U11_island_tokens", f"WITH {TURNS} SELECT unit_id, unit_id % 3 = 1 AS mismatch FROM tp")
def u11(spark, sf):
    t = _turns(spark, sf)
    a = F.concat("source_text", F.lit(" ⟦M1⟧ ⟦M2⟧"))
    b = F.concat(F.lit("⟦M2⟧ "), "translated", F.when(F.col("unit_id") % 3 == 1, " ⟦M3⟧").otherwise(" ⟦M1⟧"))
    return t.select("unit_id", P.island_mismatch(a, b).alias("mismatch"))


@query("F25_text_key", f"WITH {TURNS} SELECT unit_id, regexp_replace(lower(trim(source_text, E' \\n')), '\\s+', ' ', 'g') AS k FROM tp")
def f25(spark, sf):
    return _turns(spark, sf).select("unit_id", T.text_key(F.col("source_text")).alias("k"))


@query("G14_fallback_cascade")
def g14(spark, sf):
    t = _turns(spark, sf)
    reply = lambda m: t.where(F.col("unit_id") % m != 0).select("unit_id", F.col("translated").alias("text"))
    return P.cascade(t.select("unit_id", "source_text"), {"structured": reply(2), "batch": reply(3), "line": reply(5)})


@query("G15_field_pairs")
def g15(spark, sf):
    d = A.segments(spark, sf).where("text like '%|%'")
    a, b = (d.where(F.col("side") == n).select("pair_id", "seg_ord", F.col("text").alias(c)) for n, c in ((0, "s"), (1, "t")))
    j = a.join(b, ["pair_id", "seg_ord"], "left").withColumn("t", F.coalesce("t", "s"))
    return j.select("pair_id", "seg_ord", P.field_pairs(F.col("s"), F.col("t")).alias("pairs"), P.effectively_unchanged(F.col("s"), F.col("t")).alias("unchanged"))


CLAUSE = """[.!?:;][''\"’”)\\]]*\\s*$"""
DRIFT = """(?s)^(.*[.!?][''\"’”)\\]]*)\\s+(\\S.*?)\\s*$"""


@query("W14_boundary_repair", rf"""WITH {TURNS}, u AS (SELECT unit_id // 1000 AS doc, unit_id, source_text, translated AS text, coalesce(lead(translated) OVER w, '') AS after, coalesce(lead(source_text) OVER w, '') AS nxt, regexp_extract(translated, '{DRIFT}', 2) AS tail
    FROM tp WINDOW w AS (PARTITION BY unit_id // 1000 ORDER BY unit_id)),
g AS (SELECT *, CASE WHEN regexp_matches(source_text, '{CLAUSE}') AND NOT regexp_matches(text, '{CLAUSE}') AND lower(after[1]) = after[1] AND upper(after[1]) <> after[1] AND upper(nxt[1]) = nxt[1] AND lower(nxt[1]) <> nxt[1]
    AND tail <> '' AND len(regexp_split_to_array(tail, '\s+')) <= 14 AND NOT regexp_matches(tail, '⟦M[0-9]+⟧') THEN tail END AS given FROM u),
t AS (SELECT *, lag(given) OVER (PARTITION BY doc ORDER BY unit_id) AS taken, CASE WHEN given IS NULL THEN text ELSE trim(regexp_extract(text, '{DRIFT}', 1), E' \n') END AS kept FROM g)
SELECT doc, unit_id, source_text, coalesce(taken || ' ', '') || kept AS text, CASE WHEN taken IS NULL THEN 'batch' ELSE 'batch_boundary_repaired' END AS route FROM t""")
def w14(spark, sf):
    t = _turns(spark, sf).select((F.col("unit_id") / 1000).cast("bigint").alias("doc"), "unit_id", "source_text", F.col("translated").alias("text"), F.lit("batch").alias("route"))
    return P.boundary_repair(t, ["doc"], "unit_id")


@query("F13_template", "SELECT p_partkey, replace(replace('{{name}} of {{brand}} and {{other}}', '{{name}}', p_name), '{{brand}}', p_brand) AS text FROM part")
def f13(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", T.render_template(F.lit("{{name}} of {{brand}} and {{other}}"), {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("text"))


@query("F14_language_names", "SELECT lang, coalesce(map {'en': 'English', 'de': 'German', 'fr': 'French', 'nl': 'Dutch'}[lang], nullif(lang, ''), 'the target language') AS name, count(*) AS n FROM documents GROUP BY ALL")
def f14(spark, sf):
    names = {"en": "English", "de": "German", "fr": "French", "nl": "Dutch"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return A.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.coalesce(F.try_element_at(m, F.col("lang")), F.nullif("lang", F.lit("")), F.lit("the target language")).alias("name"), "n")


@query("F16_script_predicates", r"SELECT pair_id, side, seg_ord, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS han, regexp_matches(text, '[\x{ac00}-\x{d7af}]') AS hangul FROM segments", ("segments",))
def f16(spark, sf):
    return A.segments(spark, sf).select("pair_id", "side", "seg_ord", F.col("text").rlike("[一-鿿]").alias("han"), F.col("text").rlike("[가-힯]").alias("hangul"))


# --- runtime ------------------------------------------------------------------------------------

STATE = """st AS (SELECT request_id, coalesce(arg_min(state, seq) FILTER (state IN ('completed', 'failed', 'cancelled')), arg_max(state, seq)) AS state, coalesce(min(seq) FILTER (state IN ('completed', 'failed', 'cancelled')), max(seq)) AS seq,
    arg_min(t, seq) AS submitted_at, arg_min(t, seq) FILTER (state IN ('completed', 'failed', 'cancelled')) AS finished_at FROM requests GROUP BY 1)"""


@query("T01_lifecycle_state", f"WITH {STATE} SELECT * FROM st", ("requests",))
def t01(spark, sf):
    return X.last_state(A.requests(spark, sf))




@query("T04_ttl_prune", f"WITH {STATE} SELECT request_id, state FROM st WHERE state IN ('completed', 'failed', 'cancelled') AND (SELECT max(t) FROM requests) - coalesce(finished_at, submitted_at) >= CASE state WHEN 'completed' THEN 900 WHEN 'failed' THEN 1800 ELSE 600 END", ("requests",))
def t04(spark, sf):
    r = A.requests(spark, sf)
    now = r.agg(F.max("t")).first()[0]
    return X.expired(X.last_state(r), F.lit(now)).select("request_id", "state")


@query("T05_overflow_evict", f"WITH {STATE} SELECT request_id FROM (SELECT request_id, row_number() OVER (ORDER BY coalesce(finished_at, submitted_at), request_id) AS rn FROM st WHERE state IN ('completed', 'failed', 'cancelled')) WHERE rn <= (SELECT greatest(0, count(*) - 20) FROM st)", ("requests",))
def t05(spark, sf):
    return X.overflow(X.last_state(A.requests(spark, sf)), 20).select("request_id")


@query("T06_completion_page", f"WITH {STATE} SELECT seq, request_id, state FROM st WHERE state IN ('completed', 'failed', 'cancelled') AND seq > 5 ORDER BY seq LIMIT 50", ("requests",))
def t06(spark, sf):
    return X.feed_page(X.completions(A.requests(spark, sf)), 5, 50).select("seq", "request_id", "state")


@query("O08_retained_feed", f"WITH {STATE} SELECT seq, request_id FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS rn FROM st WHERE state IN ('completed', 'failed', 'cancelled')) WHERE rn <= 1000", ("requests",))
def o08(spark, sf):
    return X.feed_retained(X.completions(A.requests(spark, sf))).select("seq", "request_id")


@query("T07_durations", """WITH g AS (SELECT request_id, min(t) FILTER (state = 'queued') AS q, min(t) FILTER (state = 'running') AS r, min(t) FILTER (state IN ('completed', 'failed', 'cancelled')) AS f FROM requests GROUP BY 1)
SELECT request_id, CASE WHEN r - q IS NULL THEN 0 ELSE greatest(0, r - q) END AS waited, CASE WHEN f - r IS NULL THEN 0 ELSE greatest(0, f - r) END AS ran FROM g""", ("requests",))
def t07(spark, sf):
    return X.durations(A.requests(spark, sf))


@query("T10_status_gauge", f"WITH {STATE} SELECT count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'queued') AS depth, count(*) AS records FROM st", ("requests",))
def t10(spark, sf):
    return X.last_state(A.requests(spark, sf)).agg(F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "queued").alias("depth"), F.count(F.lit(1)).alias("records"))


@query("W16_queue_position", "SELECT seq, request_id, row_number() OVER (PARTITION BY request_id % 8 ORDER BY seq) AS position FROM requests WHERE state = 'queued'", ("requests",))
def w16(spark, sf):
    r = A.requests(spark, sf).withColumn("lane", F.col("request_id") % 8)
    return X.queue_positions(r, "lane").select("seq", "request_id", "position")


@query("U13_idempotent_submit", "SELECT request_id, seq, CASE WHEN seq = min(seq) OVER (PARTITION BY request_id) THEN 202 WHEN state = first_value(state) OVER (PARTITION BY request_id ORDER BY seq) THEN 200 ELSE 409 END AS outcome FROM requests", ("requests",))
def u13(spark, sf):
    return X.submissions(A.requests(spark, sf).withColumn("payload", F.col("state")))


@query("T03_deduplicated_submissions", "SELECT request_id, min(seq) AS seq FROM requests GROUP BY 1", ("requests",))
def t03(spark, sf):
    return A.requests(spark, sf).groupBy("request_id").agg(F.min("seq").alias("seq"))


@query("H10_lifecycle_read", f"WITH {STATE} SELECT request_id, state, submitted_at, finished_at FROM st", ("requests",))
def h10(spark, sf):
    return X.last_state(A.requests(spark, sf)).select("request_id", "state", "submitted_at", "finished_at")


@query("F42_iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events")
def f42(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return A.table(spark, sf, "events").select("event_id", iso.alias("iso"), F.unix_seconds(F.try_to_timestamp(F.regexp_replace(iso, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("unix"))


@query("J10_unit_translations", f"WITH {TURNS}, t AS (SELECT unit_id, translated FROM tp WHERE unit_id % 4 <> 0) SELECT tp.unit_id, t.translated IS NULL AS lacking, coalesce(t.translated, source_text) AS text FROM tp LEFT JOIN t USING (unit_id)")
def j10(spark, sf):
    u = _turns(spark, sf)
    t = u.where("unit_id % 4 <> 0").select("unit_id", "translated")
    return u.drop("translated").join(t, "unit_id", "left").select("unit_id", F.col("translated").isNull().alias("lacking"), F.coalesce("translated", "source_text").alias("text"))


@query("J11_orphans", f"WITH {TURNS} SELECT unit_id FROM tp WHERE unit_id % 6 = 0")
def j11(spark, sf):
    u = _turns(spark, sf)
    return u.select("unit_id").join(u.where("unit_id % 6 <> 0").select("unit_id"), "unit_id", "left_anti")


@query("J19_request_overlay", """SELECT b.request_id, coalesce(nullif(trim(b.mode), ''), s.mode, 'auto') AS mode, coalesce(b.keep, s.keep, true) AS keep FROM (SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN event_type END AS mode, CASE WHEN event_id % 4 = 0 THEN false END AS keep FROM events) b
LEFT JOIN (SELECT event_id AS request_id, event_type || '!' AS mode, event_id % 2 = 0 AS keep FROM events WHERE event_id % 5 <> 0) s USING (request_id)""")
def j19(spark, sf):
    e = A.table(spark, sf, "events")
    i = F.col("event_id")
    b = e.select(i.alias("request_id"), F.when(i % 3 == 0, " ").when(i % 3 == 1, F.col("event_type")).alias("mode"), F.when(i % 4 == 0, False).alias("keep"))
    s = e.where("event_id % 5 <> 0").select(i.alias("request_id"), F.concat("event_type", F.lit("!")).alias("mode"), (i % 2 == 0).alias("keep"))
    return X.overlay_request(b, s, ["mode"], ["keep"], {"mode": "auto"})


@query("H09_flag_defaults", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE lower(trim(f)) NOT IN ('0', 'false', 'no', 'off') END AS flag FROM (SELECT event_id, ['', 'false', 'Yes', 'OFF', '1'][CAST(event_id % 5 + 1 AS INT)] AS f FROM events)")
def h09(spark, sf):
    f = F.element_at(F.array(*[F.lit(x) for x in ("", "false", "Yes", "OFF", "1")]), (F.col("event_id") % 5 + 1).cast("int"))
    return A.table(spark, sf, "events").select("event_id", S.flag(f).alias("flag"))
