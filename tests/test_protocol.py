"""Repairs of replies and clustering into columns, against plain versions of what they should do."""

import random

import pytest

from lectern.operators import alignment as L
from lectern.operators import protocol as P

CLOSERS = "'\"’”)]"


def plain_repair(rows):
    """One pass over (source, text) of a document, each repair seeing the texts as the ones before left them."""

    def ends(t):
        t = t.rstrip()
        while t and t[-1] in CLOSERS:
            t = t[:-1]
        return t[-1:] in tuple(".!?:;")

    def pieces(t):
        """The text before and after the last sentence end that white space follows."""
        for i in range(len(t) - 1, 0, -1):
            if t[i].isspace() and not t[i - 1].isspace():
                j = i
                while j and t[j - 1] in CLOSERS:
                    j -= 1
                if j and t[j - 1] in ".!?" and t[i:].strip():
                    return t[:i], t[i:].strip()
        return t, ""

    out = [[t, "r"] for _, t in rows]
    for i in range(len(rows) - 1):
        head, after = out[i][0] or "", out[i + 1][0] or ""
        if head and after and ends(rows[i][0]) and not ends(head) and after[0].islower() and rows[i + 1][0][:1].isupper():
            kept, moved = pieces(head)
            if moved and len(moved.split()) <= 14 and "⟦M1⟧" not in moved:
                out[i][0] = kept.strip()
                out[i + 1] = [f"{moved} {after}", out[i + 1][1] + "_boundary_repaired"]
    return [tuple(x) for x in out]


def test_boundary_repair_equals_one_pass(spark):
    rng = random.Random(3)
    bits = ["Alpha beta.", "gamma delta", "Epsilon (zeta.)", "eta theta \n", "Iota!", "kappa:", "one two three four five six seven eight nine ten eleven twelve thirteen", "⟦M1⟧ lambda", "Mu?” nu", "", "été"]
    make = lambda: " ".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
    likely = lambda: (rng.choice(["Alpha beta.", "Mu nu!”", make()]), rng.choice(["", "xi ", "omicron. ", "Pi "]) + rng.choice(["rho sigma. ", "tau ", ""]) + make() + rng.choice([" upsilon", " phi, chi", ""]))
    docs = [[likely() for _ in range(rng.randint(1, 9))] for _ in range(500)]
    docs.append([("First sentence.", "Start here. while for small values"), ("The next one.", "of d the two mechanisms. and more"), ("Third.", "so it goes")])
    rows = [(d, i, s, t, "r") for d, doc in enumerate(docs) for i, (s, t) in enumerate(doc)]
    df = spark.createDataFrame(rows, "doc int, i int, source_text string, text string, route string")
    got = [(r.text, r.route) for r in P.boundary_repair(df, ["doc"], "i").orderBy("doc", "i").collect()]
    want = [x for doc in docs for x in plain_repair(doc)]
    assert got == want
    assert sum(r.endswith("repaired") for _, r in want) > 100
    assert got[-3:] == [("Start here.", "r"), ("while for small values of d the two mechanisms.", "r_boundary_repaired"), ("and more so it goes", "r_boundary_repaired")]


@pytest.mark.parametrize(
    "text,want",
    [("Residual Dropout** We apply *this phrase* here", "Residual Dropout We apply this phrase here"), ("a*b stays", "a*b stays"), ("(*Bahdanau et al., 2015*)", "(Bahdanau et al., 2015)"), ("**bold**  and   space ", "bold and space"), ("plain", "plain")],
)
def test_emphasis_is_stripped(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(P.strip_emphasis("t")).first()[0] == want


@pytest.mark.parametrize(
    "text,want",
    [("a note $^5$ .", "a note."), ("$5 and $x stay$", "$5 and $x stay$"), (r"use \alpha now", "use now"), ("costs $5 en $10 samen", "costs $5 en $10 samen"), ("$x$ , $a_b$)", ", )".replace(", )", ",)")), ("", "")],
)
def test_tex_is_stripped(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(P.strip_tex("t")).first()[0] == want


def plain_columns(regions):
    """Columns as sets of regions, added by width."""
    cols = []
    for k, (a, b) in sorted(enumerate(regions), key=lambda x: x[1][1] - x[1][0]):
        touched = []
        for c in cols:
            lo, hi = min(regions[i][0] for i in c), max(regions[i][1] for i in c)
            narrow = min(b - a, hi - lo)
            touched.append((min(b, hi) - max(a, lo)) / narrow if narrow > 0 else 0.0)
        near = [c for c, s in zip(cols, touched) if s > 0.5]
        if len(near) > 1:
            near = [c for c, s in zip(cols, touched) if s > 0.7]
        if len([c for c in near if len(c) > 1]) > 1:
            continue
        cols = [c for c in cols if c not in near] + [{k}.union(*near)]
    return [next((i for i, c in enumerate(cols) if k in c), None) for k in range(len(regions))]


def test_region_columns_equal_a_plain_loop(spark):
    rng = random.Random(4)
    pages = []
    for _ in range(200):
        pages.append([(a := rng.choice([0, 5, 50, 55, 100]) + rng.randint(0, 3), a + rng.choice([0, 10, 40, 45, 100])) for _ in range(rng.randint(1, 12))])
    rows = [(p, 0, k, float(a), float(b)) for p, page in enumerate(pages) for k, (a, b) in enumerate(page)]
    got = L.region_columns(spark.createDataFrame(rows, "doc int, page int, reg_ord int, x0 double, x1 double")).orderBy("doc", "reg_ord").collect()
    want = [c for page in pages for c in plain_columns(page)]
    assert [r.col for r in got] == want and None in want


def test_stacked_columns_equal_a_plain_loop(spark):
    rng = random.Random(5)
    pages = [[(rng.randint(0, 100), rng.choice([0, 5, 20, 60])) for _ in range(rng.randint(1, 15))] for _ in range(200)]
    rows = [(p, k, float(x), float(w)) for p, page in enumerate(pages) for k, (x, w) in enumerate(page)]
    got = {(r.doc, r.cell_id): r.col for r in L.stacked_columns(spark.createDataFrame(rows, "doc int, cell_id int, x double, w double"), ["doc"]).collect()}
    want = {}
    for p, page in enumerate(pages):
        cols = []
        for k, (x, w) in sorted(enumerate(page), key=lambda m: (m[1][0], m[0])):
            ok = [c for c in cols if any(min(w, ow) > 0 and min(x + w, ox + ow) - max(x, ox) >= 0.3 * min(w, ow) for ox, ow in c)]
            if ok:
                ok[0].append((x, w))
            else:
                cols.append([(x, w)])
            want[p, k] = next(i for i, c in enumerate(cols) if any(c is o for o in ok[:1]) or not ok and i == len(cols) - 1)
    assert got == want
