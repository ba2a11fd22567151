"""The whole-document score against a plain version, on the tables that the queries read."""

import os
import re
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.plans import QUERIES
from lectern.sources import adapters as A

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")
WORD = re.compile(r"[^\W\d_]{2,}")


def kind(label):
    return "image" if label in G.PRESERVE_LABELS else "table" if label in G.STRUCTURE_LABELS else "text" if label in G.TEXT_LABELS else "other"


def size(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def shared(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def alike(a, b):
    both = shared(a, b)
    return both / (size(a) + size(b) - both) if both else 0.0


def prepared(regions):
    """Sure regions by falling score, without repeats: (reg_ord, label, kind, box)."""
    kept = []
    for r in sorted((r for r in regions if r.score >= 0.4), key=lambda r: (-r.score, r.reg_ord)):
        b = (r.x0, r.y0, r.x1, r.y1)
        if not any(k == kind(r.label) and alike(b, c) >= 0.85 for _, _, k, c in kept):
            kept.append((r.reg_ord, r.label, kind(r.label), b))
    return kept


def covered(b, others):
    """The share of a box that lies in others, by cells between all edges."""
    if not size(b):
        return 0.0
    xs = sorted({b[0], b[2]} | {min(max(v, b[0]), b[2]) for o in others for v in (o[0], o[2])})
    ys = sorted({b[1], b[3]} | {min(max(v, b[1]), b[3]) for o in others for v in (o[1], o[3])})
    held = 0.0
    for x, u in zip(xs, xs[1:]):
        for y, v in zip(ys, ys[1:]):
            if any(o[0] <= x and o[2] >= u and o[1] <= y and o[3] >= v for o in others):
                held += (u - x) * (v - y)
    return held / size(b)


def matched(src, tgt):
    """(pairs with their likeness, covered and lost sources, covered and invented targets)."""
    pairs = []
    for o, i, j in sorted(((alike(a[3], b[3]), i, j) for i, a in enumerate(src) for j, b in enumerate(tgt) if a[2] == b[2]), reverse=True):
        if o >= 0.1 and not any(i == p or j == q for p, q, _ in pairs):
            pairs.append((i, j, o))

    def left(own, other, taken):
        rest = [i for i in range(len(own)) if i not in taken]
        under = [i for i in rest if covered(own[i][3], [o[3] for o in other if o[2] == own[i][2]]) >= 0.8]
        return under, [i for i in rest if i not in under]

    return pairs, *left(src, tgt, {p for p, _, _ in pairs}), *left(tgt, src, {q for _, q, _ in pairs})


def holds(b, s):
    x, y = s.x + s.w / 2, s.y + s.h / 2
    return b[0] <= x <= b[2] and b[1] <= y <= b[3]


def prose(t):
    return bool(t.strip()) and not re.search(r"(?i)https?://|www\.|@", t) and sum(map(len, WORD.findall(t.strip()))) >= 4


def key(t):
    return " ".join(WORD.findall(t.lower()))


def page_score(segs, regs):
    """Scores and counts of one page from its segments and regions of both sides."""
    src, tgt = (prepared([r for r in regs if r.side == n]) for n in (0, 1))
    pairs, under_s, lost, under_t, new = matched(src, tgt)
    weight = lambda r: size(r[3]) ** 0.5
    own, other = [s for s in segs if s.side == 0], [s for s in segs if s.side == 1]
    num, hit = sum(o * weight(src[i]) for i, _, o in pairs), sum(weight(src[i]) for i, _, _ in pairs)
    den = hit + sum(weight(src[i]) for i in lost) + sum(weight(tgt[j]) for j in new)
    texts = [s for s in own if prose(s.text)]
    keys = {key(s.text) for s in texts}
    same = keys & {key(s.text) for s in other if prose(s.text)}
    missing, to = 0, {i: j for i, j, _ in pairs}
    for s in texts:
        around = [(size(r[3]), i) for i, r in enumerate(src) if r[2] == "text" and holds(r[3], s)]
        if around:
            i = min(around)[1]
            missing += i in lost or i in to and not any(holds(tgt[to[i]][3], t) for t in other)
    ink = sum(s.w * s.h for s in other)
    stray = sum(s.w * s.h for s in other if not any(holds(r[3], s) for r in tgt)) / ink if ink else 0.0
    ratios = []
    for i, j, _ in pairs:
        a, b = [s.h for s in own if holds(src[i][3], s)], [s.h for s in other if holds(tgt[j][3], s)]
        if src[i][2] == "text" and a and b and statistics.median(a) > 0 and statistics.median(b) > 0:
            ratios.append(statistics.median(b) / statistics.median(a))
    drift = max(ratios) / min(ratios) - 1 if len(ratios) > 1 else 0.0
    return {
        "num": num, "hit": hit, "den": den, "layout": 100 * num / den if den > 0 else 100.0,
        "retention": 100 * max(0.0, 1 - missing / len(keys)) if keys else 100.0, "typography": 100 * max(0.0, 1 - min(1.0, stray / 2 + min(1.0, drift) / 2)),
        "eligible": len(keys), "unchanged": len(same), "missing": missing, "stray_share": stray, "size_ratio_drift": drift,
        "regions_matched": len(pairs), "regions_lost": len(lost), "regions_invented": len(new), "regions_covered_source": len(under_s), "regions_covered_target": len(under_t),
        "src": src, "tgt": tgt, "pairs": pairs, "under_s": under_s, "lost": lost, "under_t": under_t, "new": new,
    }


def survival(pages):
    """(numbers of the source, how many survive): common ones, then neighbours that the other side joins."""
    seqs = [[[x for s in sorted(p, key=lambda s: s.seg_ord) if s.side == n for x in s.sigs] for p in pages] for n in (0, 1)]
    a, b = (Counter(x for q in side for x in q) for side in seqs)
    kept = sum((a & b).values())
    gone, new = a - b, b - a
    for side, mine, theirs, worth in ((0, gone, new, 2), (1, new, gone, 1)):
        for q in seqs[side]:
            for x, y in zip(q, q[1:]):
                if not Counter([x, y]) - mine and theirs[x + y] > 0:
                    mine.subtract([x, y])
                    theirs.subtract([x + y])
                    kept += worth
    return sum(a.values()), kept


@pytest.fixture(scope="module")
def tables(spark):
    segs, regs = defaultdict(list), defaultdict(list)
    for r in A.segments(spark, SF).withColumn("sigs", T.full_signatures(F.col("text"))).collect():
        segs[r.pair_id, r.page].append(r)
    for r in A.regions(spark, SF).collect():
        regs[r.pair_id, r.page].append(r)
    return segs, regs


@pytest.fixture(scope="module")
def scored(tables):
    segs, regs = tables
    return {k: page_score(v, regs[k]) for k, v in segs.items() if {s.side for s in v} == {0, 1}}


def close(a, b):
    return abs(a - b) <= 0.0101 if isinstance(b, float) else a == b


def test_page_scores(spark, scored):
    got = {(r.pair_id, r.page): r for r in QUERIES["A02_page_scores"](spark, SF).collect()}
    assert set(got) == set(scored) and len(got) >= 100
    for k, w in scored.items():
        for c in ("layout", "retention", "typography", "eligible", "unchanged", "missing", "regions_matched", "regions_lost", "regions_invented", "regions_covered_source", "regions_covered_target", "stray_share", "size_ratio_drift"):
            assert close(got[k][c], w[c]), (k, c)
    assert sum(w["missing"] for w in scored.values()) and sum(w["regions_lost"] for w in scored.values()) and any(w["regions_covered_source"] for w in scored.values())


def test_page_matching(spark, tables):
    segs, regs = tables
    got = {(r.pair_id, r.page): r for r in QUERIES["G01_page_matching"](spark, SF).collect()}
    kept = {(r.pair_id, r.page): r for r in QUERIES["J02_prepared_regions"](spark, SF).collect()}
    for k, r in got.items():
        src, tgt = (prepared([x for x in regs[k] if x.side == n]) for n in (0, 1))
        pairs, under_s, lost, under_t, new = matched(src, tgt)
        assert [(m.i, m.j) for m in r.matches] == [(i, j) for i, j, _ in pairs] and all(abs(m.iou - o) < 1e-5 for m, (_, _, o) in zip(r.matches, pairs))
        assert (r.covered_source, r.lost, r.covered_target, r.invented) == (under_s, lost, under_t, new)
        assert kept[k].kept_source == [x[0] for x in src] and kept[k].kept_target == [x[0] for x in tgt]
    assert len(got) >= 100


def test_region_statuses(spark, tables):
    _, regs = tables
    got = {(r.pair_id, r.page, r.side, r.idx): (r.label, r.status, r.iou) for r in QUERIES["J17_region_statuses"](spark, SF).collect()}
    want = {}
    for (p, page), rs in regs.items():
        src, tgt = (prepared([x for x in rs if x.side == n]) for n in (0, 1))
        pairs, under_s, lost, under_t, new = matched(src, tgt)
        for side, own, under, rest in ((0, src, under_s, "lost"), (1, tgt, under_t, "invented")):
            for i, r in enumerate(own):
                hit = [o for *ij, o in pairs if ij[side] == i]
                want[p, page, side, i] = (r[1], "matched" if hit else "covered" if i in under else rest, hit[0] if hit else None)
    assert set(got) == set(want)
    for k, (label, status, o) in want.items():
        assert got[k][:2] == (label, status) and (got[k][2] is None) == (o is None) and (o is None or abs(got[k][2] - o) < 1e-3)


def test_repaired_survival_and_pair_scores(spark, tables, scored):
    segs, regs = tables
    pages = defaultdict(dict)
    for (p, page), v in segs.items():
        pages[p][page] = v
    repaired = {r.pair_id: (r.total, r.survived) for r in QUERIES["A05_anchor_survival_repaired"](spark, SF).collect()}
    got = {r.pair_id: r for r in QUERIES["G02_pair_scores"](spark, SF).collect()}
    assert set(got) == set(pages)
    for p, by_page in pages.items():
        total, kept = survival([by_page[k] for k in sorted(by_page)])
        if total:
            assert repaired[p] == (total, kept)
        own = [scored[p, k] for k in by_page if (p, k) in scored]
        num, den, hit = (sum(x[c] for x in own) for c in ("num", "den", "hit"))
        eligible, same, missing = (sum(x[c] for x in own) for c in ("eligible", "unchanged", "missing"))
        want = {
            "layout": 100 * num / den if den > 0 else 100.0, "anchors": 100.0 * kept / total if total else 100.0, "typography": statistics.fmean([x["typography"] for x in own]) if own else 100.0,
            "eligible_segments": eligible, "changed_segments": max(0, eligible - same - missing), "unchanged_segments": same, "missing_segments": missing, "unchanged_share": 100.0 * same / eligible if eligible else 0.0, "missing_share": 100.0 * missing / eligible if eligible else 0.0,
            "region_retention": statistics.fmean([x["retention"] for x in own]) if own else 100.0, "anchors_source": total, "anchors_survived": kept, "layout_noise_share": 1 - hit / den if den > 0 else 0.0,
            "pages_source": sum(any(s.side == 0 for s in v) for v in by_page.values()), "pages_translated": sum(any(s.side == 1 for s in v) for v in by_page.values()),
        }
        sure = Counter((r.side, kind(r.label)) for k in by_page for r in regs[p, k] if r.score >= 0.5)
        want |= {"image_source": sure[0, "image"], "image_target": sure[1, "image"], "table_source": sure[0, "table"], "table_target": sure[1, "table"]}
        for c, v in want.items():
            assert close(got[p][c], v), (p, c)


def test_identity(spark):
    for r in QUERIES["G04_identity_baseline"](spark, SF).collect():
        assert (r.layout, r.anchors, r.layout_noise_share) == (100.0, 100.0, 0.0) and r.volume_ratio in (1.0, None)
