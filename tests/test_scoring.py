"""Scoring on synthetic measurements: the identity, and one change at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import differences, protocol, scoring

SEGMENT = "pair_id bigint, side bigint, page bigint, seg_ord bigint, text string, x double, y double, w double, h double"
REGION = "pair_id bigint, side bigint, page bigint, reg_ord bigint, label string, score double, x0 double, y0 double, x1 double, y1 double"
TEXTS = ["Opening words of the page", "Second sentence with more words", "Third sentence closing the block"]
OTHER = ["Andere woorden bovenaan", "Tweede zin met woorden", "Derde zin aan het slot"]
BASE = [("doc_title", 0.95, 100, 80, 900, 140), ("text", 0.92, 100, 200, 1200, 600), ("image", 0.9, 100, 700, 600, 1100)]


def segments(side, texts, tops=(90, 220, 260), height=16.0, page=0):
    return [(0, side, page, i, t, 120.0, float(y), 180.0 if i == 0 else 600.0, height) for i, (t, y) in enumerate(zip(texts, tops))]


def regions(side, boxes, page=0):
    return [(0, side, page, i, b[0], b[1], *map(float, b[2:])) for i, b in enumerate(boxes)]


def score(spark, target=OTHER, boxes=BASE, source=TEXTS, **kw):
    s = spark.createDataFrame(segments(0, source) + segments(1, target, **kw), SEGMENT)
    r = spark.createDataFrame(regions(0, BASE) + regions(1, boxes), REGION)
    return scoring.score_pairs(s, r).first(), scoring.match_pages(r).first()


def test_identity(spark):
    s, _ = score(spark, TEXTS)
    assert (s.layout, s.anchors, s.typography, s.region_retention, s.volume_ratio, s.unchanged_share, s.changed_segments) == (100, 100, 100, 100, 1.0, 100, 0)


def test_clean_translation(spark):
    s, _ = score(spark)
    assert (s.layout, s.unchanged_share, s.changed_segments) == (100, 0, 3)


def test_one_unchanged(spark):
    s, _ = score(spark, [TEXTS[0], *OTHER[1:]])
    assert (s.unchanged_share, s.region_retention) == (33.33, 100)


def test_lost_image(spark):
    s, m = score(spark, boxes=BASE[:2])
    w = [math.sqrt((b[4] - b[2]) * (b[5] - b[3])) for b in BASE]
    assert len(m.lost) == 1 and not s.image_equal
    assert s.layout == round(100 * (w[0] + w[1]) / sum(w), 2)


def test_emptied_text_region(spark):
    s, _ = score(spark, OTHER[:1])
    assert (s.missing_segments, s.region_retention, s.missing_share) == (2, 33.33, 66.67)


def test_moved_region(spark):
    moved = [BASE[0], ("text", 0.92, 100, 300, 1200, 700), BASE[2]]
    s, m = score(spark, boxes=moved)
    assert 0 < s.layout < 100 and len(m.matches) == 3


def test_extra_regions(spark):
    split = [*BASE, ("text", 0.8, 120, 210, 1100, 400)]
    assert score(spark, boxes=split)[1].covered_target and not score(spark, boxes=split)[1].invented
    twice = [*BASE, ("text", 0.7, 101, 201, 1200, 600)]
    assert len(score(spark, boxes=twice)[1].target) == 3
    far = [*BASE, ("text", 0.7, 700, 1300, 1200, 1700)]
    assert len(score(spark, boxes=far)[1].invented) == 1


def test_noise_share(spark):
    away = [(b[0], b[1], *(v + 5000 for v in b[2:])) for b in BASE]
    assert score(spark, boxes=away)[0].layout_noise_share == 1.0 and score(spark)[0].layout_noise_share == 0.0


@pytest.mark.parametrize(
    ("source", "target", "total", "survived"),
    [
        ("1,234.56 and 18/17", "1.234,56 en 17/18", 3, 3),
        ("on 07 and 10", "op 7 en 10", 1, 1),
        ("1234", "１２３４", 1, 1),
        ("123456 99", "99", 2, 1),
        ("#1 2025 has 1 234 567", "#1 2025 heeft 1 234 567", 2, 2),
        ("2o25 or 235,ooo or 80O", "2025 of 235,000 of 800", 3, 3),
        ("$927million $136million", "$927 $136", 2, 2),
        ("In 2025, 119 people", "In 2025 waren 119", 2, 2),
        ("aged 50-59", "oud 5059", 2, 2),
        ("1234", "12 34", 1, 1),
    ],
)
def test_numbers(spark, source, target, total, survived):
    s = spark.createDataFrame([(0, 0, 0, 0, source, 0.0, 0.0, 1.0, 1.0), (0, 1, 0, 0, target, 0.0, 0.0, 1.0, 1.0)], SEGMENT)
    r = scoring.anchor_survival_repaired(s).first()
    assert (r.total, r.survived) == (total, survived)


def test_evidence(spark):
    s = spark.createDataFrame([(0, 0, 0, 0, "123456 99", 0.0, 300.0, 1.0, 1.0), (0, 1, 0, 0, "99", 0.0, 0.0, 1.0, 1.0)], SEGMENT)
    r = [x for x in scoring.anchor_evidence(s).collect()]
    assert [(x.sig, x.side, x.page) for x in r] == [("123456", 0, 0)]


def test_cjk_volume(spark):
    s = spark.createDataFrame([(0, 0, 0, 0, "two words", 0.0, 0.0, 1.0, 1.0), (0, 1, 0, 0, "二字", 0.0, 0.0, 1.0, 1.0)], SEGMENT)
    v = scoring.volume(s).first()
    assert (v.source_units, v.target_units, v.ratio) == (2, 2, 1.0)


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda k: (k[2] - k[0]) * (k[3] - k[1])
    return w * h / (area(a) + area(b) - w * h)


def test_matching_equals_a_plain_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    labels = {"text": "text", "image": "image", "chart": "image", "table": "table"}
    for page in range(30):
        sides = []
        for side in (0, 1):
            made = []
            for i in range(rng.randint(0, 7)):
                x, y = rng.randint(0, 60), rng.randint(0, 60)
                made.append((rng.choice(list(labels)), rng.randint(30, 99) / 100, x, y, x + rng.randint(5, 60), y + rng.randint(5, 60)))
            rows += [(0, side, page, i, *m[:2], *map(float, m[2:])) for i, m in enumerate(made)]
            kept = []
            for m in sorted((m for m in made if m[1] >= 0.4), key=lambda m: -m[1]):
                if not any(labels[k[0]] == labels[m[0]] and _iou(k[2:], m[2:]) >= 0.85 for k in kept):
                    kept.append(m)
            sides.append(kept)
        if not any(s for s in sides):
            continue
        c = sorted(((_iou(a[2:], b[2:]), i, j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1]) if labels[a[0]] == labels[b[0]]), reverse=True)
        got, a_used, b_used = [], set(), set()
        for v, i, j in c:
            if v >= 0.1 and i not in a_used and j not in b_used:
                a_used.add(i)
                b_used.add(j)
                got.append((i, j))

        def covered(k, others):
            cells = [(x, y) for x in range(k[2], k[4]) for y in range(k[3], k[5])]
            on = [o for o in others if labels[o[0]] == labels[k[0]]]
            return sum(any(o[2] <= x < o[4] and o[3] <= y < o[5] for o in on) for x, y in cells) / len(cells) >= 0.8

        rest = [i for i in range(len(sides[0])) if i not in a_used], [j for j in range(len(sides[1])) if j not in b_used]
        cov = [i for i in rest[0] if covered(sides[0][i], sides[1])], [j for j in rest[1] if covered(sides[1][j], sides[0])]
        want[page] = (got, cov[0], [i for i in rest[0] if i not in cov[0]], cov[1], [j for j in rest[1] if j not in cov[1]])
    m = scoring.match_pages(spark.createDataFrame(rows, REGION)).collect()
    assert {r.page: ([(k.i, k.j) for k in r.matches], r.covered_source, r.lost, r.covered_target, r.invented) for r in m} == want


def test_confusions():
    f = T.fold_confusions
    assert f("2o2l and $5l3,750 ooo") == "2021 and $513,750 ooo"
    assert f("235,ooo million 927million") == "235,000 million 927million"


def test_nearest_consuming(spark):
    schema = "k string, ord bigint, cx double, cy double"
    e = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 10.0, 0.0), ("b", 2, 0.0, 0.0)], schema)
    a = spark.createDataFrame([("a", 0, 9.0, 0.0), ("a", 1, 11.0, 0.0)], schema)
    got = {r.ord: (r.shift, r.moved) for r in differences.nearest_consuming(e, a, ["k"]).collect()}
    assert got == {0: (9.0, True), 1: (1.0, False)}


def test_reply_protocol(spark):
    r = spark.createDataFrame([(1, "1. one\n more\n2) two\n1. again"), (2, "no list"), (3, "intro\n10. ten")], "reply_id bigint, text string")
    assert {(x.reply_id, x.n, x.text) for x in protocol.numbered(r).collect()} == {(1, 1, "again"), (1, 2, "two"), (3, 10, "ten")}
    b = spark.createDataFrame([(1, "CATEGORY: menu\nA\n---\n- B\n###\n**C**\n-25% off\n###\n###\nD")], "reply_id bigint, text string")
    assert [(x.block, x.line_no, x.line) for x in protocol.blocks(b).orderBy("block", "line_no").collect()] == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (1, 1, "-25% off"), (2, 0, "D")]
    t = spark.createDataFrame([("a **bold** word* x", "the $a_b$ and $x$ costs $5 or \\alpha , ok")], "e string, t string")
    got = t.select(protocol.strip_emphasis(F.col("e")).alias("e"), protocol.strip_tex(F.col("t")).alias("t")).first()
    assert got.e == "a bold word x" and got.t == "the and costs $5 or, ok"


def test_boundary_repair(spark):
    rows = [(1, 0, "First sentence.", "Eerste zin. Tweede", "batch"), (1, 1, "Second one.", "zin loopt door.", "batch"), (1, 2, "Third.", "Derde.", "batch")]
    df = spark.createDataFrame(rows, "doc bigint, ord bigint, source_text string, text string, route string")
    got = [(r.text, r.route) for r in protocol.boundary_repair(df, ["doc"], "ord").orderBy("ord").collect()]
    assert got == [("Eerste zin.", "batch"), ("Tweede zin loopt door.", "batch_boundary_repaired"), ("Derde.", "batch")]
