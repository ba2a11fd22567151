"""What the rows of a page need of each other, against plain versions; and that no table is dealt out more than once
for it, whatever the page's cells and lines have in common."""

import difflib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment as L
from lectern.operators import claims as C
from lectern.operators import evidence as E
from lectern.operators import pages as P
from lectern.plans import QUERIES
from lectern.plans import claims as QC
from lectern.sources import adapters as A

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


def exchanges(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange\b", plan.split("== Initial Plan ==")[-1]))


def plain_alike(a, b):
    if min(len(a), len(b)) < 4:
        return False
    return a in b or b in a or 2 * min(len(a), len(b)) >= 0.8 * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8


def test_alike_is_what_difflib_says():
    rng = random.Random(1)
    for letters, longest in (("ab", 14), ("abcdef", 12), ("etaoinshrdlu0", 24), ("abc", 230)):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(60)})
        for w in list(words):  # garbled ones
            k = rng.randrange(len(w))
            words += [w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]]
        words = sorted(set(words) - {""})
        v = P.Vocabulary(words)
        found = 0
        for a in rng.sample(words, 60):
            got = {words[i] for i in P.bits(v.alike(a))}
            assert got == {b for b in words if plain_alike(a, b)}, a
            found += len(got)
        assert found > 60


def test_counts_and_best_lines():
    rng = random.Random(2)
    for _ in range(200):
        masks = [rng.getrandbits(9) for _ in range(rng.randint(0, 9))]
        for least in range(11):
            assert P.at_least(P.counted(masks), least, 511) == sum(1 << k for k in range(9) if sum(m >> k & 1 for m in masks) >= least)
    lines = P.Lines([5, 3, 9], ["a b c", "b c d d", None])
    assert lines.best(["b", "c"]) == (2, 0b11) and lines.best(["a", "d", "d"]) == (2, 0b1) and lines.best(["z"]) == (0, 0)
    assert lines.of(0b11) == [3, 5]


def test_chain_is_the_loop_of_before():
    def loop(tops, lines):
        n = len(lines)
        length, back = np.ones(n, int), np.full(n, -1)
        for i in range(1, n):
            fits = np.where(lines[:i] <= lines[i], length[:i], 0)
            j = int(fits.argmax())
            if fits[j]:
                length[i], back[i] = fits[j] + 1, j
        at, picked = (int(length.argmax()) if n else -1), []
        while at >= 0:
            picked.append(at)
            at = int(back[at])
        out = []
        for i in reversed(picked):
            if not out or tops[i] > tops[out[-1]]:
                out.append(i)
        return out

    rng = random.Random(3)
    for _ in range(500):
        n = rng.randint(0, 25)
        tops, lines = np.array(sorted(rng.randint(0, 20) for _ in range(n)), float), np.array([rng.randint(0, 9) for _ in range(n)], int)
        assert L.chain(tops, lines) == loop(tops, lines)


@needs_data
@pytest.mark.parametrize("name, most", [("G07_bound_cells", 2), ("G05_align_units", 3), ("W08_sticky_labels", 2), ("J09_fuzzy_bind", 2), ("G10_symbol_leftovers", 6), ("G09_claims", 6), ("F05_token_scores", 2), ("J16_best_fields", 2), ("F09_field_overlap", 2)])
def test_pages_are_dealt_out_once(spark, name, most):
    assert exchanges(spark, name) <= most


@needs_data
def test_units_bind_once(spark):
    plan = QUERIES["G05_align_units"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("MapInArrow") == 1 and "InPandas" not in plan


def test_overlaps_are_what_difflib_says():
    def plain(a, b):
        if not a or not b:
            return 0.0
        least = min(3, len(a), len(b))
        return sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks() if m.size >= least) / min(len(a), len(b))

    rng = random.Random(4)
    for _ in range(60):
        keys = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(12)]
        held = E.Keys(keys, list(range(12)))
        for b in [*keys[:3], *("".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(12))]:
            want = [plain(a, b) for a in keys]
            assert E.Keys(list(dict.fromkeys(keys)), list(range(12))).overlaps(b).tolist() == [plain(a, b) for a in dict.fromkeys(keys)]
            top = max((o, a == b, -abs(len(a) - len(b)), -i) for i, (a, o) in enumerate(zip(keys, want)))
            assert held.best(b) == (top if top[0] >= 0.5 else None)


@needs_data
def test_units_are_made_on_the_page(spark):
    assert exchanges(spark, "G05_align_units") <= 2
    cells, lines = A.cells(spark, SF), A.hint_lines(spark, SF)
    rows = lambda d: sorted((r.doc, r.page, r.first_cell, r.line_idx or -1, tuple(r.cells)) for r in d.collect())
    assert rows(L.bound_units(cells, lines)) == rows(L.units(L.bind(cells, lines)))
    assert L.page_units([7, 3, 5, 5, 4, 9, 5], [1, 1, None, None, 1, 2, 1]) == [(3, 1, [3, 4, 5, 7]), (9, 2, [9]), (5, None, [5, 5])]


def test_gathered_columns_keep_their_nulls(spark):
    rows = [(1, 2, None, 1.5, True), (1, None, "", None, None), (1, 4, "x", 2.5, False), (2, None, None, None, True)]
    g = P.gathered(["k"], t=spark.createDataFrame(rows, "k bigint, a int, b string, c double, d boolean"), u=spark.createDataFrame([(1, [3]), (1, None), (2, [])], "k bigint, e array<bigint>"))
    got = {key: (sorted(zip(*t["t"].values()), key=str), sorted(t["u"]["e"], key=str)) for b in g.toArrow().to_batches() for (key,), t in P.each(b, ["k"])}
    assert got == {k: (sorted((r[1:] for r in rows if r[0] == k), key=str), e) for k, e in ((1, [None, [3]]), (2, [[]]))}


@needs_data
def test_claims_are_found_on_the_page(spark):
    assert exchanges(spark, "G09_claims") <= 2
    cells, lines, units = QC.claimed(spark, SF)
    assert sorted(QUERIES["G09_claims"](spark, SF).collect()) == sorted(C.resolved_claims(units, cells, lines).collect())


def test_blocks_are_those_of_difflib():
    rng = random.Random(6)
    for letters, longest in (("ab", 12), ("abcd", 30), ("abcdefghij", 15), ("abc", 230)):
        for _ in range(300):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(2))
            if rng.random() < 0.5 and a:
                k = rng.randrange(len(a))
                b = a[:k] + rng.choice(["", "x"]) + a[k + 1 :]
            want = [m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks() if m.size]
            for least in (1, 3):
                assert sum(P.block_sizes(a, b, least)) == sum(x for x in want if x >= least), (a, b)


def test_own_fields_are_dealt_out_once(spark):
    rows = [(1, 1, "Total amount", "Totl amount"), (1, 2, "amount due", "amount due"), (1, 3, None, "due"), (1, 4, "due", None), (1, 5, "x", ""), (2, 6, None, None), (2, 7, "Preis", "Pris")]
    c = spark.createDataFrame(rows, "doc bigint, cell_id bigint, text string, read string")
    got = E.best_own_fields(c, ["doc"], "cell_id", "field")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan.split("== Initial Plan ==")[-1])) == 1
    want = E.best_fields(c.select("doc", "cell_id", F.col("read").alias("text")), c.select("doc", F.col("cell_id").alias("field"), "text"), ["doc"], "cell_id", "field")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 3


@needs_data
def test_best_fields_deal_out_once(spark):
    assert exchanges(spark, "J16_best_fields") == 1


@needs_data
def test_overlaps_come_as_lists(spark):
    plan = QUERIES["F09_field_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert exchanges(spark, "F09_field_overlap") == 1 and plan.count("Generate explode") >= 2
    cells = [(1, 1, "Total amount", "Totl amount"), (1, 2, "amount due", "amount due"), (1, 3, None, "due"), (1, 4, "due", None), (1, 5, "due", "due"), (1, 5, "zz", "")]
    c = spark.createDataFrame(cells, "doc bigint, cell_id bigint, text string, read string")
    key = lambda t: None if t is None else t.lower().replace(" ", "")
    want = [(i, j, round(float(E.Keys([key(a)], [0]).overlaps(key(b))[0]), 6)) for _, i, _, b in cells if b is not None for _, j, a, _ in cells if a is not None]
    got = [tuple(r) for r in E.own_overlaps(c, ["doc"], "cell_id", "field").select("cell_id", "field", "overlap").collect()]
    assert sorted(got) == sorted(want) and len(want) == 25 and {0.0, 1.0} < {o for *_, o in want}


@needs_data
def test_similar_tokens_of_lines(spark):
    """Equal pairs are made one before they are dealt out, and are those of a join of all tokens of a line."""
    plan = QUERIES["F04_similar_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(a#", plan)  # pairs are not dealt out one by one
    cells = spark.createDataFrame([(1, 1, "kaart Kaarthouder"), (1, 2, "kaart pas"), (2, 1, "kaart houder"), (3, 1, "alone"), (4, 1, None)], "doc bigint, cell_id bigint, read string")
    lines = spark.createDataFrame([(1, "de kaarthouder past kart"), (2, "kaart houders"), (4, "none here")], "doc bigint, text string")
    own = {1: {"kaart", "kaarthouder", "pas"}, 2: {"kaart", "houder"}}
    theirs = {1: {"de", "kaarthouder", "past", "kart"}, 2: {"kaart", "houders"}}
    want = sorted({(a, b, plain_alike(a, b)) for d in own for a in own[d] for b in theirs[d]})
    assert sorted(tuple(r) for r in E.similar_line_tokens(cells, lines, ["doc"], 4, 0.8).collect()) == want
