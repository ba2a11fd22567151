"""Claims on lines: cases, and plain versions on the queries' own tables."""

import difflib
import os
import re
import statistics
from collections import defaultdict

import pytest

from lectern.operators.claims import DROPPED, KEPT, MERGED, PRINT, Claim, resolve
from lectern.plans import QUERIES
from lectern.plans import claims as Q

SF = "/root/testdata/sf0.001"


def claim(n, words, x, y, exact=True, w=80, h=12):
    return Claim(n, set(words.split()), exact, (x, y, x + w, y + h))


def test_cases():
    line = [set("of bel de stoplijn 0800 1995".split())]
    # a tilted line joins word by word, whatever the order of the claims
    got = resolve([claim(1, "of bel de", 0, 0), claim(2, "0800 1995", 170, 12), claim(3, "stoplijn", 85, 6)], line)
    assert got == {1: (KEPT, 1), 2: (MERGED, 1), 3: (MERGED, 1)}
    # new words far from everything are none of the line's; clean repeats elsewhere are printed again, garbled or overlapping ones not
    got = resolve([claim(1, "of bel de", 0, 0), claim(2, "stoplijn", 900, 500), claim(3, "bel", 300, 300), claim(4, "bel", 300, 300, exact=False), claim(5, "de", 10, 1, w=20)], line)
    assert got == {1: (KEPT, 1), 2: (DROPPED, 2), 3: (PRINT, 3), 4: (DROPPED, 4), 5: (DROPPED, 5)}
    # each field has its own claim
    got = resolve([claim(1, "total amount", 0, 0), claim(2, "9 95", 600, 0), claim(3, "amount", 0, 14)], [{"total", "amount"}, {"9", "95"}])
    assert got == {1: (KEPT, 1), 2: (KEPT, 2), 3: (PRINT, 3)}


def tokens(t):
    return re.findall("[a-z0-9]+", t.lower())


def alike(a, b):
    return min(len(a), len(b)) >= 4 and (a in b or b in a or 2 * min(len(a), len(b)) >= 0.8 * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8)


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data is not here")
    from pyspark.sql import functions as F

    from lectern.functions import text as T

    cells, lines, units = Q.claimed(spark, SF)
    c = {(r.doc, r.page, r.cell_id): r for r in cells.withColumn("t", T.match_tokens(F.col("text"))).collect()}
    ln = {(r.doc, r.page, r.line_idx): r for r in lines.withColumn("s", T.spelt(F.col("text"))).withColumn("f", F.transform(F.split("s", r"\|"), T.token_list)).collect()}
    return c, ln, units.collect()


def box(c):
    return c.x, c.y, c.x + c.w, c.y + c.h


def union(boxes):
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def test_claims_equal_a_plain_version(spark, tables):
    cells, lines, units = tables
    by_line = defaultdict(list)
    for u in units:
        if u.line_idx is not None:
            by_line[u.doc, u.page, u.line_idx].append(u)
    want = {}
    for k, us in by_line.items():
        if len(us) > 1:
            fields = [set(f) for f in lines[k].f]
            every = set().union(*fields)
            claims = []
            for u in sorted(us, key=lambda u: u.first_cell):
                have = [t for i in u.cells for t in cells[(*k[:2], i)].t]
                covers = {h for t in have for h in ([t] if t in every else [h for h in every if alike(t, h)])}
                claims.append(Claim(u.first_cell, covers, all(t in every for t in have), union([box(cells[(*k[:2], i)]) for i in u.cells])))
            for n, v in resolve(claims, fields).items():
                want[(*k, n)] = v
    got = {(r.doc, r.page, r.line_idx, r.first_cell): (r.verdict, r.home) for r in QUERIES["G09_claims"](spark, SF).collect()}
    assert got == want and {v for v, _ in got.values()} == {KEPT, MERGED, PRINT, DROPPED}


def near(a, b):
    tall = max(a[3] - a[1], b[3] - b[1], 1.0)
    across, down = (max(a[k], b[k]) - min(a[k + 2], b[k + 2]) for k in (0, 1))
    return across < 0 and down <= 1.5 * tall or down < 0 and across <= 2 * tall


def test_fragments_equal_a_plain_version(spark, tables):
    cells, lines, units = tables
    want = set()
    for u in units:
        if u.line_idx is not None and len(u.cells) > 1:
            m = [cells[u.doc, u.page, i] for i in u.cells]
            gone = []
            for c in m:
                rest = [o for o in m if o is not c]
                known = {t for o in rest for t in o.t}
                if c.t and set(c.t) <= known:
                    low = 0 < c.h < 0.6 * statistics.median(o.h for o in rest)
                    away = c.y + c.h <= min(o.y for o in rest) or not any(near(box(c), box(o)) for o in rest)
                    if low or "|" not in lines[u.doc, u.page, u.line_idx].text and away:
                        gone.append(c.cell_id)
            if len(gone) < len(m):
                want |= {(u.doc, u.page, i) for i in gone}
    got = {(r.doc, r.page, r.cell_id) for r in QUERIES["G10_icon_fragments"](spark, SF).collect()}
    assert got == want


def test_symbols_equal_a_plain_version(spark, tables):
    cells, lines, units = tables
    pages = defaultdict(list)
    for u in units:
        pages[u.doc, u.page].append(u)
    want = {}
    for p, us in pages.items():
        for u in us:
            if u.line_idx is None and len(u.cells) == 1:
                s = cells[(*p, u.first_cell)]
                if s.text.strip() and not s.t and s.text.strip() != "|":
                    for o in sorted((o for o in us if o.line_idx is not None and s.text.strip() in lines[(*p, o.line_idx)].text), key=lambda o: o.first_cell):
                        beside = [box(cells[(*p, i)]) for i in o.cells]
                        a = box(s)
                        if any(min(a[3], b[3]) - max(a[1], b[1]) > 0.4 * min(a[3] - a[1], b[3] - b[1]) and max(b[0] - a[2], a[0] - b[2]) <= 1.2 * (a[3] - a[1]) for b in beside):
                            want[(*p, u.first_cell)] = o.first_cell
                            break
    got = {(r.doc, r.page, r.cell_id): r.first_cell for r in QUERIES["G10_symbol_leftovers"](spark, SF).collect()}
    assert got == want and got
