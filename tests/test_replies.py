"""Reply gates, the fallback cascade, nearest matches and the binding of cells against plain versions, on the
tables that the queries read."""

import difflib
import math
import os
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import QUERIES
from lectern.plans import alignment as Q
from lectern.plans.records import _turns
from lectern.sources import adapters as A

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def turns(spark):
    return {r.unit_id: (r.source_text, r.translated) for r in _turns(spark, SF).collect()}


def blank_of_meaning(t):
    """Blank, an address, a price, or without letters."""
    t = t.strip()
    low = t.lower()
    return not t or "://" in low or low.startswith("www.") or bool(re.search(r"\.(com|nl|org|net|io|de|fr|co|eu)\b", low)) or bool(re.match(r"[€$£]?\s*[-+]?\s*[0-9][0-9.,]*\s*[A-Z]?$", t)) or not any(c.isalpha() for c in t)


def meant(t):
    kept = [f.strip() for f in t.split("|") if not blank_of_meaning(re.sub(r"(?i)\b(?:https?://|www\.)\S+", " ", f))]
    return " ".join(kept).strip() or t.strip()


def same_words(a, b):
    flat = lambda t: re.sub(r"\s+", " ", t.strip().lower())
    return meant(a) != "" and flat(meant(a)) == flat(meant(b))


def test_effectively_unchanged(spark, turns):
    got = rows(spark, "P16_effectively_unchanged")
    assert len(got) == len(turns) and all(r.unchanged == same_words(*turns[r.unit_id]) for r in got)


def test_cascade(spark, turns):
    islands = lambda t: sorted(re.findall("⟦M[0-9]+⟧", t))
    seen = set()
    for r in rows(spark, "G14_fallback_cascade"):
        s, t = turns[r.unit_id]
        fine = t != "" and len(t.strip()) <= max(20, 4 * len(s.strip())) and not (islands(s) and islands(s) != islands(t))
        routes = [n for n, m in (("structured", 2), ("batch", 3), ("line", 5)) if r.unit_id % m]
        noise = len(s.strip()) <= 2 and s.strip().isascii()
        want = (s, "skipped") if noise or blank_of_meaning(s) else (t, routes[0]) if fine and routes else (s, "source")
        assert (r.text, r.route) == want
        seen.add(r.route)
    assert {"structured", "batch", "source"} <= seen


def test_field_pairs(spark):
    text = {(r.pair_id, r.side, r.seg_ord): r.text for r in A.segments(spark, SF).collect()}
    got = rows(spark, "G15_field_pairs")
    assert {(r.pair_id, r.seg_ord) for r in got} == {(p, o) for (p, s, o), t in text.items() if s == 0 and "|" in t}
    for r in got:
        a = text[r.pair_id, 0, r.seg_ord]
        b = text.get((r.pair_id, 1, r.seg_ord))
        b = a if b is None or "|" not in b else b
        x, y = [f.strip() for f in a.split("|")], [f.strip() for f in b.split("|")]
        want = [(u, v) for u, v in zip(x, y) if v and not blank_of_meaning(u)] if len(x) == len(y) > 1 else None
        assert (None if r.pairs is None else [tuple(p) for p in r.pairs]) == want and r.unchanged == same_words(a, b)


def test_stripped_replies(spark, turns):
    for r in rows(spark, "F18_F19_stripped_replies"):
        t = re.sub(r"\*{1,2}(?=\S)(.+?)(?<=\S)\*{1,2}", r"\1", turns[r.unit_id][1])
        t = re.sub(r"\s{2,}", " ", re.sub(r"(?<=\w)\*{1,2}(?!\w)|(?<!\w)\*{1,2}(?=\w)", "", t)).strip()
        math_ = lambda m: " " if re.search(r"[_^{}\\]", m[1]) or re.fullmatch(r"[A-Za-z0-9(),./]{1,6}", m[1].strip()) else m[0]
        t = re.sub(r"\\[a-zA-Z]{2,}", " ", re.sub(r"\$([^$]{1,40})\$", math_, t))
        assert r.text == re.sub(r" ([,.;:!?)\]])", r"\1", " ".join(t.split())), r.unit_id


def test_nearest_of_each_text(spark):
    groups = defaultdict(list)
    for r in A.cells(spark, SF).select("doc", "cell_id", "x", "y", "w", "h", T.alnum_form(F.col("text")).alias("k")).collect():
        groups[r.doc, r.k].append((r.cell_id, r.x + r.w / 2, r.y + r.h / 2))
    want = {}
    for (doc, k), members in groups.items():
        left = sorted((i, x + i % 5, y) for i, x, y in members if i % 13)
        for i, x, y in sorted(members):
            if left:
                near = min(range(len(left)), key=lambda j: (math.dist((x, y), left[j][1:]), j))
                want[doc, k, i] = round(math.dist((x, y), left.pop(near)[1:]), 6)
    got = {(r.doc, r.k, r.ord): (r.shift, r.moved) for r in rows(spark, "J15_nearest_consuming")}
    assert set(got) == set(want) and all(abs(got[k][0] - s) < 1e-5 and got[k][1] == (s > 3) for k, s in want.items())


# --- binding ------------------------------------------------------------------------------------------


def fold(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    plain = t
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ß", "ss"), ("þ", "th"), ("ð", "d")):
        t = t.replace(a, b)
    return re.findall("[a-z0-9]+", t), re.findall("[a-z0-9]+", plain)


def near(a, b):
    if min(len(a), len(b)) < 4:
        return False
    return a in b or b in a or 2 * min(len(a), len(b)) >= 0.8 * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8


def best_lines(cells, lines, fuzzy):
    """{cell: (lines of the best score, score)} of a page."""
    read = {i: fold(t) for i, t in lines.items()}
    out = {}
    for c, t in cells.items():
        words = fold(t)[0]
        score = {}
        for i, (exact, loose) in read.items():
            if words and exact:
                score[i] = sum(1.0 if w in exact else 0.9 if fuzzy and any(near(w, x) for x in set(loose)) else 0.0 for w in words) / len(words)
        top = max(score.values(), default=0.0)
        if top:
            out[c] = (sorted(i for i, s in score.items() if abs(s - top) < 1e-9), top)
    return out


@pytest.fixture(scope="module")
def pages(spark):
    cells, lines, boxes = defaultdict(dict), defaultdict(dict), {}
    for r in Q._garbled(spark, SF).collect():
        cells[r.doc, r.page][r.cell_id] = r.text
    for r in A.cells(spark, SF).collect():
        boxes[r.doc, r.page, r.cell_id] = r
    for r in A.hint_lines(spark, SF).collect():
        lines[r.doc, r.page][r.line_idx] = r.text
    return cells, lines, boxes


def small(pages, most=120):
    """Pages of which the plain version can look at all cells and lines."""
    return [p for p, c in pages[0].items() if len(c) <= most]


def test_fuzzy_matches(spark, pages):
    cells, lines, _ = pages
    got = defaultdict(dict)
    for r in rows(spark, "J09_fuzzy_bind"):
        got[r.doc, r.page].setdefault(r.cell_id, {})[r.line_idx] = r.score
    looked = 0
    for p in small(pages):
        weak = {c: t for c, t in cells[p].items() if best_lines({c: t}, lines[p], False).get(c, ((), 0.0))[1] < 0.4 and fold(t)[0]}
        want = best_lines(weak, lines[p], True)
        assert set(got[p]) == set(want)
        for c, (best, s) in want.items():
            assert sorted(got[p][c]) == best and all(abs(v - s) < 1e-5 for v in got[p][c].values())
        looked += len(want)
    assert looked > 20


def longest_rise(lines):
    """Places of the longest run of lines that never fall; of equals the one whose ends come first."""
    runs = []
    for i, v in enumerate(lines):
        back = [r for r in runs if lines[r[-1]] <= v]
        runs.append((max(back, key=len) if back else []) + [i])
    return max(runs, key=len) if runs else []


def expected(tops, seeds, first, n):
    """Where each top should be among n lines, from seeds (top, line) or by proportion; whether seeds said so."""
    if n <= 1:
        return [0.0] * len(tops), False
    keep = []
    for i in longest_rise([v for _, v in seeds]):
        if not keep or seeds[i][0] > keep[-1][0]:
            keep.append((seeds[i][0], seeds[i][1] - first))
    if len(keep) < 2:
        span = max(tops) - min(tops) or 1.0
        return [(t - min(tops)) / span * (n - 1) for t in tops], False
    out = []
    for t in tops:
        k = max([i for i, (x, _) in enumerate(keep) if x < t], default=0)
        (x0, y0), (x1, y1) = keep[min(k, len(keep) - 2)], keep[min(k, len(keep) - 2) + 1]
        out.append(min(max(y0 + (t - x0) / (x1 - x0) * (y1 - y0), 0), n - 1))
    return out, True


def bound(page, pages):
    """{cell: line or None} of a page of clean cells, one after another."""
    _, lines, boxes = pages
    lines = lines[page]
    own = {k[2]: b for k, b in boxes.items() if k[:2] == page}
    exact = best_lines({c: b.text for c, b in own.items()}, lines, False)
    loose = best_lines({c: b.text for c, b in own.items() if exact.get(c, ((), 0))[1] < 0.4}, lines, True)
    cand = {c: v[0] for d in (loose, exact) for c, v in d.items() if v[1] >= 0.4}
    order = sorted(own.values(), key=lambda b: (b.y, b.x, b.cell_id))
    first, n = min(lines), len(lines)
    seeds = [(b.y, cand[b.cell_id][0]) for b in order if len(cand.get(b.cell_id, [])) == 1]
    where, sure = expected([b.y for b in order], seeds, first, n)
    out, last = {}, None
    for b, w in zip(order, where):
        able = [v for v in cand.get(b.cell_id, []) if not sure or abs(v - first - w) <= 3]
        label = None
        if able:
            follows = last is not None and 0 < b.y - last.y <= 2.5 * last.h and abs(b.x - last.x) <= 2 * last.h
            label = out[last.cell_id] if follows and out[last.cell_id] in able else min(able, key=lambda v: (abs(v - first - w), v))
        out[b.cell_id] = label
        last = b if label is not None else last
    return out


def test_bound_cells_and_units(spark, pages):
    got, units = defaultdict(dict), defaultdict(list)
    for r in rows(spark, "G07_bound_cells"):
        got[r.doc, r.page][r.cell_id] = r.line_idx
    for r in rows(spark, "G05_align_units"):
        units[r.doc, r.page].append((r.line_idx, r.cells))
    for p in small(pages):
        want = bound(p, pages)
        assert got[p] == want
        made = []
        for c in sorted(want):
            if made and want[c] is not None and made[-1][0] == want[c]:
                made[-1][1].append(c)
            else:
                made.append((want[c], [c]))
        assert sorted(units[p], key=str) == sorted(made, key=str)


def test_seed_chains(spark, pages):
    _, lines, boxes = pages
    got = defaultdict(list)
    for r in rows(spark, "W05_seed_chains"):
        got[r.doc, r.page].append((r.cell_id, r.line_idx))
    for p in small(pages):
        own = {k[2]: b for k, b in boxes.items() if k[:2] == p}
        best = {c: v[0][0] for c, v in best_lines({c: b.text for c, b in own.items()}, lines[p], False).items() if v[1] >= 0.4 and len(v[0]) == 1}
        order = sorted(best, key=lambda c: (own[c].y, c))
        keep, top = [], None
        for i in longest_rise([best[c] for c in order]):
            if top is None or own[order[i]].y > top:
                keep.append((order[i], best[order[i]]))
                top = own[order[i]].y
        assert sorted(got[p]) == sorted(keep)
