"""Labels, member flags and field marks against plain versions."""

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.operators import labels as N
from lectern.plans import QUERIES
from lectern.plans import claims as Q
from lectern.sources import adapters as A

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "label,want",
    [
        ("t|Roboto|18pt|700|c", ("title", "center", "Roboto", 700, 18)),
        ("b | Helvetica | 11 PT | l", ("body", None, "Helvetica", None, 11)),
        ("Menu", (None, None, None, None, None)),
        ("mx|Arial", ("footer", None, "Arial", None, None)),
        ("header| centered", ("header", "center", None, None, None)),
        ("|Arial|9pt|r", (None, None, "Arial", None, 9)),
        ("metadata|400|500|A|B", ("footer", None, "A", 500, None)),
    ],
)
def test_label_fields(spark, label, want):
    assert tuple(one(spark, N.label_fields(F.lit(label)))) == want


def test_normalised_labels(spark):
    n = lambda t: one(spark, N.pipe_normalised(F.lit(t)))
    assert n("b Roboto 18pt r") == "b|Roboto|18pt|r" and n("Roboto 18pt r") == "|Roboto|18pt|r" and n("b|x 18pt") == "b|x 18pt" and n("just text") == "just text"


@pytest.mark.parametrize(
    "text,want",
    [("|@blt|@•|item", (True, "•", "item")), ("@blt|1. item", (True, None, "1. item")), ("@-| item", (True, "-", "item")), ("@blt|Price | 12,50", (True, None, "Price | 12,50")), ("plain | text", (False, None, "plain | text")), ("@blt|(iv)|x", (True, "(iv)", "x"))],
)
def test_bullets(spark, text, want):
    assert tuple(one(spark, N.bullet_of(F.lit(text)))) == want


def test_flag_cases(spark):
    flags = lambda texts, line: one(spark, N.member_flags(F.array(*map(F.lit, texts)), F.lit(line), F.array(*[F.lit(t.lower()) for t in texts]), F.lower(F.lit(line))))
    assert flags(["8", "jun"], "8 jun") == [True, True]  # a phrase's number goes with it
    assert flags(["9", "jun", "9"], "9 jun | 9°/16°") == [True, True, True]  # the neighbour's field decides
    assert flags(["9", "16", "jun"], "9 jun | 9°/16°") == [False, False, True]  # no neighbour does; a field of numbers stays
    assert flags(["9", "x"], None) == [False, True]
    assert flags(["Tom", "&"], "Tom & Jerry") == [True, True] and flags(["Tom", "&"], "Tom") == [True, False]
    assert flags(["A-", "B"], "A- B") == [False, False]


def tokens(t):
    return re.findall("[a-z0-9]+", t.lower())


@there
def test_flags_equal_a_plain_version(spark):
    from lectern.functions import text as T

    c, lines, units = Q.claimed(spark, SF)
    cells = {(r.doc, r.page, r.cell_id): r for r in c.select("doc", "page", "cell_id", "text", T.match_tokens(F.col("text")).alias("t"), T.nontranslatable(F.col("text")).alias("no"), T.symbolic_label(F.col("text")).alias("sign")).collect()}
    parts = F.zip_with(F.split("text", r"\|"), F.split("s", r"\|"), lambda p, s: F.struct(T.token_list(s).alias("t"), (~T.nontranslatable(p)).alias("ok")))
    line = {(r.doc, r.page, r.line_idx): r for r in lines.withColumn("s", T.spelt(F.col("text"))).withColumn("p", parts).collect()}
    members = {(u.doc, u.page, u.line_idx, u.first_cell): [cells[u.doc, u.page, i] for i in u.cells] for u in units.where("line_idx is not null").collect()}
    got = {(r.doc, r.page, r.line_idx, r.first_cell): r.flags for r in QUERIES["G11_member_flags"](spark, SF).collect()}
    assert set(got) == set(members)
    for k, m in members.items():
        fields = line[k[:3]].p
        over = [[i for i, f in enumerate(fields) if x.t and set(x.t) <= set(f.t)] for x in m]
        want = []
        for i, x in enumerate(m):
            ok = not x.no or not x.t and x.text.strip() not in ("", "|") and x.text.strip() in line[k[:3]].text
            if not ok and x.t:
                own = over[i]
                if len(own) > 1:
                    sure = [over[j][0] for j in (i - 1, i + 1) if 0 <= j < len(m) and len(over[j]) == 1 and over[j][0] in own]
                    own = sure[:1]
                ok = len(own) == 1 and fields[own[0]].ok
            want.append(ok)
        if len(m) > 1 and all(x.sign for x in m):
            want = [False] * len(m)
        assert got[k] == want, k


def plain_marks(line, anchors):
    for a in reversed(anchors):
        places = [i for i, c in enumerate(line) if c.isalnum()]
        flat, want = "".join(line[i].lower() for i in places), "".join(c.lower() for c in a if c.isalnum())
        at = flat.find(want) if want else -1
        if at < 0:
            return None
        cut = places[at + len(want) - 1] + 1
        while cut < len(line) and not line[cut].isspace():
            cut += 1
        if cut == len(line):
            return None
        line = line[:cut] + " |" + line[cut:]
    return line


@there
def test_marks_equal_a_plain_version(spark):
    runs = defaultdict(list)
    for r in A.cells(spark, SF).orderBy("doc", "cell_id").collect():
        runs[r.doc, r.seg_ord].append(r.text)
    text = {(r.doc, r.line_idx): r.text for r in A.hint_lines(spark, SF).collect()}
    got = {(r.doc, r.line_idx): r.text for r in QUERIES["F12_injected_pipes"](spark, SF).collect()}
    assert set(got) == set(text)
    for k, t in text.items():
        assert got[k] == plain_marks(t, [runs[k][i] for i in (0, 2) if i < len(runs[k])]), k
    assert any(v is None for v in got.values()) and any(v and "|" in v for v in got.values())


@there
def test_adjusted_lines_equal_a_plain_version(spark):
    members = defaultdict(list)
    for r in A.cells(spark, SF).orderBy("doc", "cell_id").collect():
        members[r.doc, r.seg_ord].append((r.x + r.cell_id % 1000 // 3 * 60, r.w, r.text))
    text = {(r.doc, r.line_idx): r.text for r in A.hint_lines(spark, SF).collect()}
    got = {(r.doc, r.line_idx): (r.raw, r.adjusted, r.mapped) for r in QUERIES["G12_adjusted_lines"](spark, SF).collect()}
    want = {}
    for k, m in members.items():
        if len(m) < 2 or "|" in text[k] or not any(re.search("[^\\W\\d_]", t) for _, _, t in m):
            continue
        m.sort()
        gaps = [b[0] - a[0] - a[1] for a, b in zip(m, m[1:])]
        open_ = [g for g in gaps if g > 0]
        if not open_:
            continue
        limit = 1.8 * min(open_) if len(m) > 2 else 2 * sum(w for _, w, _ in m) / max(1, sum(len(re.sub("[^a-z0-9]", "", t.lower())) for *_, t in m))
        cols = [[m[0]]]
        for x, g in zip(m[1:], gaps):
            if g >= limit:
                cols.append([])
            cols[-1].append(x)
        if len(cols) > 1:
            put = plain_marks(text[k], [c[-1][2] for c in cols[:-1]])
            want[k] = (text[k], put or " | ".join(" ".join(t for *_, t in c).strip() for c in cols), put is not None)
    assert got == want and len(want) > 50


def test_headings_keep_their_number(spark):
    cells = [(1, 0, 0.0, 10.0, "3"), (1, 1, 60.0, 40.0, "Model"), (1, 2, 300.0, 40.0, "page"), (2, 0, 0.0, 10.0, "3"), (2, 1, 200.0, 40.0, "Model")]
    m = spark.createDataFrame([(l, c, x, 0.0, w, 10.0, t) for l, c, x, w, t in cells], "k int, cell_id int, x double, y double, w double, h double, text string")
    lines = spark.createDataFrame([(1, "3 Model page", "title"), (2, "3 Model", "body")], "k int, text string, level string")
    got = {r.k: r.adjusted for r in N.adjusted_lines(m, lines, ["k"]).collect()}
    assert got == {1: "3 Model | page", 2: "3 | Model"}
