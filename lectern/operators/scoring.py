"""Scoring of a translated document against its source.

Tables are keyed by ``pair`` columns (a run of a document) and page; a side is 0 (source) or 1.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T

PAIR = "pair_id"


# --- numbers ---------------------------------------------------------------------------------


def signature_rows(segments: DataFrame, signatures=T.signatures) -> DataFrame:
    """pair_id, side, page, seg_ord, pos, sig."""
    return segments.select(PAIR, "side", "page", "seg_ord", F.posexplode(signatures(F.col("text"))).alias("pos", "sig"))


def signature_counts(sigs: DataFrame) -> DataFrame:
    """pair_id, sig, n_source, n_target: both sides counted in one pass over one shuffle."""
    side = lambda s: F.count_if(F.col("side") == s)
    return sigs.groupBy(PAIR, "sig").agg(side(0).alias("n_source"), side(1).alias("n_target"))


def anchor_survival(segments: DataFrame, signatures=T.signatures) -> DataFrame:
    """pair_id, total, survived, axis: how many source numbers the translation still has."""
    c = signature_counts(signature_rows(segments, signatures))
    per = c.groupBy(PAIR).agg(F.sum("n_source").alias("total"), F.sum(F.least("n_source", "n_target")).alias("survived"))
    return per.withColumn("axis", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("survived") / F.col("total"), 2)))


def anchor_differences(segments: DataFrame) -> DataFrame:
    """pair_id, sig, missing, added; only where a count differs."""
    c = signature_counts(signature_rows(segments)).where("n_source <> n_target")
    return c.select(PAIR, "sig", F.greatest(F.lit(0), F.col("n_source") - F.col("n_target")).alias("missing"), F.greatest(F.lit(0), F.col("n_target") - F.col("n_source")).alias("added"))


def anchor_evidence(segments: DataFrame) -> DataFrame:
    """pair_id, side, page, seg_ord, pos, sig: the first occurrences of each missing or added number."""
    s = signature_rows(segments)
    d = anchor_differences(segments)
    needed = d.select(PAIR, "sig", F.lit(0).cast("bigint").alias("side"), F.col("missing").alias("needed")).unionByName(d.select(PAIR, "sig", F.lit(1).cast("bigint").alias("side"), F.col("added").alias("needed"))).where("needed > 0")
    w = Window.partitionBy(PAIR, "side", "sig").orderBy("page", "seg_ord", "pos")
    return s.join(needed, [PAIR, "side", "sig"]).withColumn("rn", F.row_number().over(w)).where("rn <= needed").select(PAIR, "side", "page", "seg_ord", "pos", "sig")


def adjacent_pairs(segments: DataFrame) -> DataFrame:
    """pair_id, side, page, first, second: numbers that follow each other on a page."""
    w = Window.partitionBy(PAIR, "side", "page").orderBy("seg_ord", "pos")
    return signature_rows(segments).withColumn("second", F.lead("sig").over(w)).where("second is not null").select(PAIR, "side", "page", F.col("sig").alias("first"), "second")


def anchor_survival_repaired(segments: DataFrame, signatures=T.full_signatures) -> DataFrame:
    """As ``anchor_survival``, with the residual repaired: a number left over on one side that joins two
    adjacent ones left over on the other is forgiven.  Only documents whose residual could be repaired
    are grouped, with their residual's adjacent pairs only."""
    s = signature_rows(segments, signatures)
    c = signature_counts(s)
    base = c.groupBy(PAIR).agg(F.sum("n_source").alias("total"), F.sum(F.least("n_source", "n_target")).alias("survived"))
    rest = c.where("n_source <> n_target").select(PAIR, "sig", (F.col("n_source") - F.col("n_target")).alias("excess"))
    w = Window.partitionBy(PAIR, "side", "page").orderBy("seg_ord", "pos")
    near = s.withColumn("second", F.lead("sig").over(w)).where("second is not null")
    e = rest.select(PAIR, F.col("sig").alias("k"), "excess")
    near = near.join(e.select(PAIR, F.col("k").alias("sig"), F.col("excess").alias("e1")), [PAIR, "sig"]).join(e.select(PAIR, F.col("k").alias("second"), F.col("excess").alias("e2")), [PAIR, "second"])
    near = near.withColumn("joined", F.concat("sig", "second")).join(e.select(PAIR, F.col("k").alias("joined"), F.col("excess").alias("e3")), [PAIR, "joined"])
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    near = near.where((F.col("e1") * sign > 0) & (F.col("e2") * sign > 0) & (F.col("e3") * sign < 0))

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {}
        for a, b in (("sig", "e1"), ("second", "e2"), ("joined", "e3")):
            left.update(zip(pdf[a], pdf[b].abs()))
        gained = 0
        for r in pdf.sort_values(["side", "page", "seg_ord", "pos"]).itertuples():
            need = 2 if r.sig == r.second else 1
            if left[r.sig] >= need and left[r.second] >= need and left[r.joined] >= 1:
                for x in (r.sig, r.second, r.joined):
                    left[x] -= 1
                gained += 2 if r.side == 0 else 1
        return pd.DataFrame({PAIR: [pdf[PAIR].iloc[0]], "gained": [gained]})

    gains = near.groupBy(PAIR).applyInPandas(repair, f"{PAIR} bigint, gained bigint")
    out = base.join(gains, PAIR, "left").withColumn("survived", F.col("survived") + F.coalesce("gained", F.lit(0)))
    return out.select(PAIR, "total", "survived", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("survived") / F.col("total"), 2)).alias("axis"))


def volume(segments: DataFrame) -> DataFrame:
    v = T.volume_units(F.col("text")).cast("bigint")
    per = segments.groupBy(PAIR).agg(F.coalesce(F.sum(F.when(F.col("side") == 0, v)), F.lit(0)).alias("source_units"), F.coalesce(F.sum(F.when(F.col("side") == 1, v)), F.lit(0)).alias("target_units"))
    return per.withColumn("ratio", F.when(F.col("source_units") > 0, F.round(F.col("target_units") / F.col("source_units"), 3)))


# --- regions ---------------------------------------------------------------------------------


def usable(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("score") >= G.REGION_MIN_SCORE).withColumn("family", G.family(F.col("label")))


def _kept(items: Column) -> Column:
    """Regions by falling score, without those that repeat a kept one of the family."""
    start = F.filter(items, lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        twin = F.exists(kept, lambda k: (k["family"] == x["family"]) & (G.iou(k["box"], x["box"]) >= G.DUPLICATE_IOU))
        return F.when(twin, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, start, step)


def page_regions(regions: DataFrame) -> DataFrame:
    """pair_id, page, source, target: prepared regions of each side as arrays in order of score."""
    u = usable(regions)
    item = F.struct((-F.col("score")).alias("order"), "reg_ord", "label", "family", "score", G.box().alias("box"))
    side = lambda s: _kept(F.sort_array(F.collect_list(F.when(F.col("side") == s, item))))
    return u.groupBy(PAIR, "page").agg(side(0).alias("source"), side(1).alias("target"))


def iou_candidates(regions: DataFrame) -> DataFrame:
    """pair_id, page, i, j, iou: same-family regions of both sides that overlap enough."""
    u = usable(regions)
    a, b = u.where("side = 0"), u.where("side = 1")
    side = lambda d, s: d.select(PAIR, "page", "family", F.col("reg_ord").alias(s), G.box().alias("box" + s))
    j = side(a, "i").join(side(b, "j"), [PAIR, "page", "family"])
    return j.withColumn("iou", G.iou(F.col("boxi"), F.col("boxj"))).where(F.col("iou") >= G.MATCH_MIN_IOU).select(PAIR, "page", "i", "j", "iou")


def covered_fraction(box: Column, boxes: Column) -> Column:
    """The share of a box under the union of others, by the grid of their edges."""
    clip = lambda o: F.struct(F.greatest(box["x0"], o["x0"]).alias("x0"), F.greatest(box["y0"], o["y0"]).alias("y0"), F.least(box["x1"], o["x1"]).alias("x1"), F.least(box["y1"], o["y1"]).alias("y1"))
    clipped = F.filter(F.transform(boxes, clip), lambda c: (c["x1"] > c["x0"]) & (c["y1"] > c["y0"]))
    edges = lambda c, a, b: F.array_sort(F.array_distinct(F.concat(F.transform(c, lambda k: k[a]), F.transform(c, lambda k: k[b]))))

    def of(c: Column) -> Column:
        def grid(e: Column) -> Column:
            xs, ys = e["xs"], e["ys"]

            def column(i: Column) -> Column:
                xa, xb = F.get(xs, i), F.get(xs, i + 1)
                row = lambda k: F.when(F.exists(c, lambda o: (o["x0"] <= xa) & (o["x1"] >= xb) & (o["y0"] <= F.get(ys, k)) & (o["y1"] >= F.get(ys, k + 1))), (xb - xa) * (F.get(ys, k + 1) - F.get(ys, k))).otherwise(0.0)
                return F.aggregate(F.sequence(F.lit(0), F.size(ys) - 2), F.lit(0.0), lambda s, k: s + row(k))

            return F.aggregate(F.sequence(F.lit(0), F.size(xs) - 2), F.lit(0.0), lambda s, i: s + column(i))

        return F.when(F.size(c) == 0, 0.0).otherwise(F.transform(F.array(F.struct(edges(c, "x0", "x1").alias("xs"), edges(c, "y0", "y1").alias("ys"))), grid)[0])

    total = G.box_area(box)
    return F.when(total > 0, F.transform(F.array(clipped), of)[0] / total).otherwise(0.0)


def match_pages(regions: DataFrame) -> DataFrame:
    """pair_id, page, source, target, matches (i, j, iou by falling iou), and the indices of regions
    covered_source, lost, covered_target, invented.  Greedy: ties go to the larger indices."""
    p = page_regions(regions)
    at = lambda a, i: F.get(a, i)
    pairs = F.flatten(F.transform("source", lambda s, i: F.transform("target", lambda t, j: F.struct(F.when(s["family"] == t["family"], G.iou(s["box"], t["box"])).otherwise(0.0).alias("iou"), i.alias("i"), j.alias("j")))))
    p = p.withColumn("pairs", F.sort_array(F.filter(pairs, lambda x: x["iou"] >= G.MATCH_MIN_IOU), asc=False))
    free = lambda m, x: ~F.exists(m, lambda k: (k["i"] == x["i"]) | (k["j"] == x["j"]))
    p = p.withColumn("matches", F.aggregate("pairs", F.filter("pairs", lambda x: F.lit(False)), lambda m, x: F.when(free(m, x), F.concat(m, F.array(x))).otherwise(m)))

    def unmatched(side: str, key: str) -> Column:
        every = F.transform(side, lambda s, i: i)
        return F.array_except(every, F.transform("matches", lambda m: m[key]))

    p = p.withColumn("rest_source", unmatched("source", "i")).withColumn("rest_target", unmatched("target", "j"))

    def covered(rest: str, side: str, other: str) -> Column:
        def ok(i: Column) -> Column:
            s = at(F.col(side), i)
            boxes = F.transform(F.filter(other, lambda o: o["family"] == s["family"]), lambda o: o["box"])
            return covered_fraction(s["box"], boxes) >= G.COVERED_FRACTION

        return F.filter(rest, ok)

    p = p.withColumn("covered_source", covered("rest_source", "source", "target")).withColumn("covered_target", covered("rest_target", "target", "source"))
    return p.select(PAIR, "page", "source", "target", "matches", "covered_source", F.array_except("rest_source", "covered_source").alias("lost"), "covered_target", F.array_except("rest_target", "covered_target").alias("invented"))


def region_statuses(matched: DataFrame) -> DataFrame:
    """pair_id, page, side, idx, label, status, iou of every prepared region."""

    def side(name: str, key: str, covered: str, rest: str, number: int) -> DataFrame:
        rows = matched.select(PAIR, "page", F.posexplode(name).alias("idx", "region"), "matches", covered)
        hit = F.get(F.filter("matches", lambda m: m[key] == F.col("idx")), F.lit(0))
        status = F.when(hit.isNotNull(), "matched").when(F.array_contains(covered, F.col("idx")), "covered").otherwise(rest)
        return rows.select(PAIR, "page", F.lit(number).alias("side"), "idx", F.col("region.label").alias("label"), status.alias("status"), F.round(hit["iou"], 3).alias("iou"))

    return side("source", "i", "covered_source", "lost", 0).unionByName(side("target", "j", "covered_target", "invented", 1))


# --- text fate, typography, pages --------------------------------------------------------------


def centred(segments: DataFrame) -> DataFrame:
    return segments.withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)


def smallest_region(segments: DataFrame, regions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each segment the smallest region that holds its centre (ties: the first in ``order``)."""
    j = centred(segments).join(regions, keys).where(G.inside(F.col("cx"), F.col("cy"), G.box()))
    return j.groupBy(*keys, "seg_ord").agg(F.min_by(order, F.struct(G.box_area(G.box()), F.col(order))).alias(order))


def text_fate(segments: DataFrame) -> DataFrame:
    """pair_id, page, eligible, unchanged: distinct normalised texts of the source, and those of them that
    the translated page has verbatim.  Texts are told apart by 128 bits, and meet once, by page."""
    s = segments.select(PAIR, "page", "side", T.text_identity(F.col("text")).alias("k")).where("k is not null")
    of = lambda n: F.collect_set(F.when(F.col("side") == n, F.col("k")))
    per = s.groupBy(PAIR, "page").agg(of(0).alias("a"), of(1).alias("b"))
    return per.select(PAIR, "page", F.size("a").cast("bigint").alias("eligible"), F.size(F.array_intersect("a", "b")).cast("bigint").alias("unchanged"))


def stray_share(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """pair_id, page, share: the part of the translated page's text area centred in no region."""
    t = centred(segments.where("side = 1"))
    held = t.join(regions.where("side = 1").select(PAIR, "page", G.box().alias("box")), [PAIR, "page"]).where(G.inside(F.col("cx"), F.col("cy"), F.col("box"))).select(PAIR, "page", "seg_ord").distinct().withColumn("held", F.lit(True))
    size = F.col("w") * F.col("h")
    g = t.join(held, [PAIR, "page", "seg_ord"], "left").groupBy(PAIR, "page").agg(F.sum(size).alias("total"), F.sum(F.when(F.col("held").isNull(), size).otherwise(0.0)).alias("stray"))
    return g.select(PAIR, "page", F.when(F.col("total") > 0, F.round(F.col("stray") / F.col("total"), 4)).otherwise(0.0).alias("share"))


def _median(values: Column) -> Column:
    """The median of an array of numbers, null if it is empty."""
    n = F.size(values)
    at = lambda v, i: F.get(v, i.cast("int"))
    return F.when(n > 0, F.transform(F.array(F.array_sort(values)), lambda v: (at(v, F.floor((n - 1) / 2)) + at(v, F.floor(n / 2))) / 2)[0])


def _within(segment: Column, b: Column) -> Column:
    return G.inside(segment["cx"], segment["cy"], b)


def page_segments(segments: DataFrame) -> DataFrame:
    """pair_id, page, and of each side its segments as an array: centre, size, height, identity of the text."""
    s = centred(segments)
    item = F.struct("cx", "cy", (F.col("w") * F.col("h")).alias("ink"), "h", T.text_identity(F.col("text")).alias("k"))
    side = lambda n: F.collect_list(F.when(F.col("side") == n, item))
    return s.groupBy(PAIR, "page").agg(side(0).alias("source_text"), side(1).alias("target_text"))


def score_pages(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for each page that both sides have: layout parts, counts, retention, typography.

    Segments and regions of a page meet once, as arrays (a page has no more of them than fit on it);
    everything else is arithmetic on the row."""
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, x: s + f(x))
    region = lambda side, i: F.get(F.col(side), i)
    w = lambda side, i: G.weight(region(side, i)["box"])
    d = page_segments(segments).where((F.size("source_text") > 0) & (F.size("target_text") > 0)).join(match_pages(regions), [PAIR, "page"], "left")
    d = d.withColumns({
        "numerator": F.coalesce(total("matches", lambda k: k["iou"] * w("source", k["i"])), F.lit(0.0)),
        "matched_weight": F.coalesce(total("matches", lambda k: w("source", k["i"])), F.lit(0.0)),
        "other_weight": F.coalesce(total("lost", lambda i: w("source", i)) + total("invented", lambda j: w("target", j)), F.lit(0.0)),
        "prose": F.filter("source_text", lambda x: x["k"].isNotNull()),
    })
    # where the smallest text region of a source segment is lost, or its counterpart without text, the segment is missing
    texts = F.transform("source", lambda s, i: F.struct(G.box_area(s["box"]).alias("area"), i.alias("i"), s["family"].alias("family"), s["box"].alias("box")))
    d = d.withColumn("texts", F.array_sort(F.filter(texts, lambda x: x["family"] == "text")))
    blank = F.filter(F.transform("matches", lambda k: F.when(~F.exists("target_text", lambda t: _within(t, region("target", k["j"])["box"])), k["i"])), lambda i: i.isNotNull())
    d = d.withColumn("gone", F.concat("lost", blank))
    home = lambda x: F.get(F.filter("texts", lambda r: _within(x, r["box"])), F.lit(0))["i"]
    missing = F.size(F.filter("prose", lambda x: F.coalesce(F.array_contains("gone", home(x)), F.lit(False))))
    keys = lambda c: F.array_distinct(F.transform(F.filter(c, lambda x: x["k"].isNotNull()), lambda x: x["k"]))
    d = d.withColumns({
        "own": keys("prose"),
        "missing": F.greatest(F.coalesce(missing, F.lit(0)), F.lit(0)),
        # ink of the target outside all regions; spread of the height ratios of matched text regions
        "stray": F.coalesce(total(F.filter("target_text", lambda t: ~F.coalesce(F.exists("target", lambda r: _within(t, r["box"])), F.lit(False))), lambda t: t["ink"]) / F.nullif(total("target_text", lambda t: t["ink"]), F.lit(0.0)), F.lit(0.0)),
    })
    height = lambda side, b: _median(F.transform(F.filter(side, lambda t: _within(t, b)), lambda t: t["h"]))
    pairs = F.filter("matches", lambda k: region("source", k["i"])["family"] == "text")
    ratios = F.transform(pairs, lambda k: F.struct(height("source_text", region("source", k["i"])["box"]).alias("s"), height("target_text", region("target", k["j"])["box"]).alias("t")))
    d = d.withColumn("ratios", F.transform(F.filter(ratios, lambda r: (r["s"] > 0) & (r["t"] > 0)), lambda r: r["t"] / r["s"]))
    d = d.withColumns({
        "drift": F.when(F.size("ratios") >= 2, F.array_max("ratios") / F.array_min("ratios") - 1).otherwise(0.0),
        "eligible": F.size("own").cast("bigint"),
        "unchanged": F.size(F.array_intersect("own", keys("target_text"))).cast("bigint"),
        "missing": F.col("missing").cast("bigint"),
        "denominator": F.col("matched_weight") + F.col("other_weight"),
    })
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return d.select(
        PAIR, "page", "numerator", "matched_weight", "denominator",
        F.when(F.col("denominator") > 0, 100 * F.col("numerator") / F.col("denominator")).otherwise(100.0).alias("layout"),
        F.when(F.col("eligible") > 0, 100 * F.greatest(F.lit(0.0), 1 - F.col("missing") / F.col("eligible"))).otherwise(100.0).alias("retention"),
        (100 * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), 0.5 * F.col("stray") + 0.5 * F.least(F.lit(1.0), F.col("drift"))))).alias("typography"),
        n("matches").alias("regions_matched"), n("lost").alias("regions_lost"), n("invented").alias("regions_invented"), n("covered_source").alias("regions_covered_source"), n("covered_target").alias("regions_covered_target"),
        "eligible", "unchanged", "missing", F.round("stray", 4).alias("stray_share"), F.round("drift", 4).alias("size_ratio_drift"),
    )


def region_counts(regions: DataFrame) -> DataFrame:
    """pair_id and, of each side, how many sure image and table regions there are, with flags."""
    sure = F.col("score") >= G.FLAG_MIN_SCORE
    n = lambda s, labels: F.count_if(sure & (F.col("side") == s) & F.col("label").isin(labels))
    g = regions.groupBy(PAIR).agg(n(0, G.PRESERVE_LABELS).alias("image_source"), n(1, G.PRESERVE_LABELS).alias("image_target"), n(0, G.STRUCTURE_LABELS).alias("table_source"), n(1, G.STRUCTURE_LABELS).alias("table_target"))
    return g.withColumn("image_equal", F.col("image_source") == F.col("image_target")).withColumn("table_equal", F.col("table_source") == F.col("table_target"))


def score_pairs(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for each pair: the axes, indicators and flags of the whole document."""
    pages = score_pages(segments, regions).groupBy(PAIR).agg(
        F.sum("numerator").alias("num"), F.sum("denominator").alias("den"), F.sum("matched_weight").alias("mw"), F.avg("typography").alias("typography"), F.avg("retention").alias("retention"),
        F.sum("eligible").alias("eligible"), F.sum("unchanged").alias("unchanged"), F.sum("missing").alias("missing"),
    )
    counts = segments.groupBy(PAIR).agg(F.count_distinct(F.when(F.col("side") == 0, F.col("page"))).alias("pages_source"), F.count_distinct(F.when(F.col("side") == 1, F.col("page"))).alias("pages_translated"))
    d = counts.join(pages, PAIR, "left").join(anchor_survival_repaired(segments).withColumnRenamed("axis", "anchors"), PAIR, "left").join(volume(segments), PAIR, "left").join(region_counts(regions), PAIR, "left")
    share = lambda c: F.when(F.col("eligible") > 0, F.round(100.0 * F.col(c) / F.col("eligible"), 2)).otherwise(0.0)
    hundred = lambda c: F.round(F.coalesce(c, F.lit(100.0)), 2)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.select(
        PAIR, hundred(F.when(F.col("den") > 0, 100 * F.col("num") / F.col("den"))).alias("layout"), hundred(F.col("anchors")).alias("anchors"), hundred(F.col("typography")).alias("typography"),
        zero("eligible").alias("eligible_segments"), F.greatest(F.lit(0), zero("eligible") - zero("unchanged") - zero("missing")).alias("changed_segments"), zero("unchanged").alias("unchanged_segments"), zero("missing").alias("missing_segments"),
        share("unchanged").alias("unchanged_share"), share("missing").alias("missing_share"), hundred(F.col("retention")).alias("region_retention"),
        zero("total").alias("anchors_source"), zero("survived").alias("anchors_survived"), F.col("source_units").alias("volume_units_source"), F.col("target_units").alias("volume_units_translated"), F.col("ratio").alias("volume_ratio"),
        F.when(F.col("den") > 0, F.round(1 - F.col("mw") / F.col("den"), 3)).otherwise(0.0).alias("layout_noise_share"),
        (F.col("pages_source") == F.col("pages_translated")).alias("page_count_equal"), "pages_source", "pages_translated", "image_source", "image_target", "image_equal", "table_source", "table_target", "table_equal",
    )
