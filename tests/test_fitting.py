"""Tokens, wrapping and evidence against plain versions, on the queries' own tables where they have no SQL."""

import difflib
import os
import random
import re
import tracemalloc
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evidence as E
from lectern.operators import fitting as W
from lectern.operators import runtime as X
from lectern.plans import QUERIES
from lectern.plans import fitting as Q
from lectern.sources import adapters as A

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def plain_alike(a, b):
    if min(len(a), len(b)) < 4:
        return False
    if a in b or b in a:
        return True
    return 2 * min(len(a), len(b)) >= 0.8 * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8


def test_similar_tokens(spark):
    got = rows(spark, "F04_similar_tokens")
    assert len(got) > 500 and all(r.similar == plain_alike(r.a, r.b) for r in got)


def test_different_pairs_take_one_table():
    """Pairs of tokens are made one in place: no copy of the table stands beside it."""
    rng = np.random.default_rng(3)
    added = [rng.integers(0, 1 << 20, int(n), np.uint64) << np.uint64(20) for n in rng.integers(0, 1 << 16, 100)]
    want = np.unique(np.concatenate(added))
    tracemalloc.start()
    held = E.Distinct(1 << 21)
    for x in added:
        held.room(len(x))[:] = x
    got = held.settle()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and most < 1.4 * held.table.nbytes
    small = E.Distinct(1)
    for x in added[:9]:
        small.room(len(x))[:] = x
    assert np.array_equal(small.settle(), np.unique(np.concatenate(added[:9])))


def test_token_scores(spark):
    lines, tokens = {}, {}
    for r in A.hint_lines(spark, SF).select("doc", "line_idx", T.fuzzy_tokens(F.col("text")).alias("t")).collect():
        lines[r.doc, r.line_idx] = r.t
    for r in Q._garbled(spark, SF).select("doc", "seg_ord", "cell_id", T.match_tokens(F.col("read")).alias("t")).collect():
        tokens[r.doc, r.seg_ord, r.cell_id] = r.t
    got = {(r.doc, r.seg_ord, r.cell_id, r.pos): r.score for r in rows(spark, "F05_token_scores")}
    some = random.Random(1).sample(sorted(got), 3000)
    for d, s, c, p in some:
        t, line = tokens[d, s, c][p], lines[d, s]
        assert got[d, s, c, p] == (1.0 if t in line else 0.9 if any(plain_alike(t, x) for x in line) else 0.0)
    assert {got[k] for k in some} == {0.0, 0.9, 1.0} or {got[k] for k in some} == {0.9, 1.0}


def plain_folded(text):
    """Letters that look like digits, folded one after another as long as one touches a digit."""
    parts = []
    for part in unicodedata.normalize("NFKC", text).split(" "):
        before = None
        while part != before:
            before = part
            for i, c in enumerate(part):
                if c in "oOlI":
                    for step in (-1, 1):
                        j = i + step
                        while 0 <= j < len(part) and part[j] in ".,  ":
                            j += step
                        if 0 <= j < len(part) and part[j].isdigit():
                            part = part[:i] + ("0" if c in "oO" else "1") + part[i + 1 :]
                            break
        parts.append(part)
    return " ".join(parts)


def test_folded_confusions_and_signatures(spark):
    text = {(r.pair_id, r.side, r.seg_ord): r.text for r in Q._misread(spark, SF).collect()}
    got = {(r.pair_id, r.side, r.seg_ord): r.text for r in rows(spark, "F06_folded_confusions")}
    assert got == {k: plain_folded(t) for k, t in text.items()} and any(got[k] != text[k] for k in text)
    sigs = {(r.pair_id, r.side, r.seg_ord): r.sigs for r in rows(spark, "F07_full_signatures")}
    for k, t in got.items():
        plain = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "", t)
        plain = re.sub(r"(?<=[0-9])(?<![0-9]{4})[.,]?[   ](?=[0-9]{3}(?![0-9]))", "", plain)
        assert sigs[k] == " ".join(x for x in (d.lstrip("0") for d in re.findall("[0-9]{2,}", plain)) if len(x) >= 2), t


def plain_overlap(a, b):
    if not a or not b:
        return 0.0
    least = min(3, len(a), len(b))
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks() if m.size >= least) / min(len(a), len(b))


def test_field_overlap_and_best_fields(spark):
    m, f = Q._fields(spark, SF)
    key = lambda d, c: {(r.doc, r.seg_ord, r[c]): r.k for r in d.select("doc", "seg_ord", c, T.field_key(F.col("text")).alias("k")).collect()}
    members, fields = key(m, "cell_id"), key(f, "field")
    by_line = defaultdict(list)
    for (d, s, i), k in fields.items():
        by_line[d, s].append((i, k))
    best = {(r.doc, r.seg_ord, r.cell_id): (r.field, r.overlap) for r in rows(spark, "J16_best_fields")}
    overlap = {(r.doc, r.cell_id, r.field): r.overlap for r in rows(spark, "F09_field_overlap")}
    for d, s, c in random.Random(2).sample(sorted(members), 400):
        b, ranks = members[d, s, c], []
        for i, a in sorted(by_line[d, s]):
            o = plain_overlap(a, b)
            assert abs(overlap[d, c, i] - o) < 1e-5
            ranks.append((o, a == b, -abs(len(a) - len(b)), -i))
        top = max(ranks)
        assert best.get((d, s, c)) == ((-top[3], pytest.approx(top[0], abs=1e-5)) if top[0] >= 0.5 else None)


def plain_pieces(text):
    """Characters taken one by one: what holds to the next, what to the last, and the space in front."""
    wide = lambda c: "\u3000" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\uff00" <= c <= "\uffef"
    out, gap, open_, open_gap, fresh = [], "", "", "", True
    for c in text:
        if c.isspace():
            gap, fresh = "\u2003" if "\u2003" in (c, gap) else " ", True
            continue
        here, gap = gap, ""
        if wide(c) and c in W.OPENING:
            open_, open_gap = open_ + c, open_gap if open_ else here
        elif wide(c) and c in W.CLOSING and open_:
            open_ += c
        elif wide(c) and c in W.CLOSING and out:
            out[-1] = (out[-1][0] + c, out[-1][1])
        elif not wide(c) and not fresh and not open_:
            out[-1] = (out[-1][0] + c, out[-1][1])
        else:
            out.append((open_ + c, open_gap if open_ else here))
            open_ = ""
        fresh = wide(c)
    return out + ([(open_, open_gap)] if open_ else [])


def test_break_pieces(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\u65e5\u672c\uff08\u300c\uff09\u3002\u3001  x\u2003\u3000") for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["（ab", "a（", "。a", "（）日"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [tuple(p) for p in r.p] for r in df.select("i", W.break_pieces(F.col("text")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_pieces(t), repr(t)
    assert len(rows(spark, "F17_break_pieces")) > 100


def plain_wrapped(words, width, most=10**9):
    lines = [""]
    for w in words:
        if lines[-1] and len(lines[-1]) + 1 + len(w) > width and len(lines) < most:
            lines.append(w)
        else:
            lines[-1] = f"{lines[-1]} {w}".strip()
    return lines


def test_wrapping(spark):
    text = {(r.doc, r.line_idx): r.text for r in A.hint_lines(spark, SF).collect()}
    for r in rows(spark, "H25_wrapped_lines"):
        words = text[r.doc, r.line_idx].split()
        assert r.lines == plain_wrapped(words, 24)
        fits = [n for n in range(6, 25) if max(map(len, plain_wrapped(words, int(200 // (n / 2))))) <= 200 // (n / 2) and len(plain_wrapped(words, int(200 // (n / 2)))) * n * 1.25 <= 60]
        assert r.size == max(fits, default=6)
    for r in rows(spark, "F26_balanced_lines"):
        words = text[r.doc, r.line_idx].split()
        cap = next((w for w in range(1, 61) if len(plain_wrapped(words, w)) <= 3), 60)
        assert r.greedy == plain_wrapped(words, 20, 3) and r.balanced == plain_wrapped(words, cap, 3)


def test_marks_and_markers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = lambda s: F.lit(s)
    assert one(W.fold_wide_marks(t("DANGER！　（x）"))) == "DANGER! (x)" and one(W.fold_wide_marks(t("危険！"))) == "危険！"
    assert one(W.restored_number(t("Model"), t("3."))) == "3. Model" and one(W.restored_number(t("Model 3"), t("3."))) == "Model 3" and one(W.restored_number(t("Model 33"), t("3"))) == "3 Model 33"
    assert one(W.with_lead_marker(t("Noam"), t("*Noam"))) == "*Noam" and one(W.with_lead_marker(t("†Noam"), t("*Noam"))) == "†Noam" and one(W.with_lead_marker(t("Noam"), t("* Noam"))) == "Noam"
    assert one(W.without_glyph(t("• item"))) == "item" and one(W.without_glyph(t("x"))) == "x"
    assert one(W.justifiable(t("one two"), F.lit(56.0), F.lit(60.0), F.lit(8.0))) and not one(W.justifiable(t("one"), F.lit(24.0), F.lit(24.0), F.lit(8.0)))


def test_margins_and_masks(spark):
    lines = [("a", i, 258.0 + i % 3, 100.0, 12.0) for i in range(5)] + [("a", 9, 300.0, 100.0, 12.0), ("b", 1, 0.0, 9.0, 9.0), ("b", 2, 50.0, 9.0, 9.0)]
    got = {(r.k, r.i): (r.x, r.w) for r in E.snapped_margins(spark.createDataFrame(lines, "k string, i int, x double, w double, h double"), ["k"], "x", "w", "h").collect()}
    assert {got["a", i][0] for i in range(5)} == {259.0} and got["a", 9] == (300.0, 100.0) and got["b", 1] == (0.0, 9.0)
    assert got["a", 0] == (259.0, 99.0)


def test_oldest_records(spark):
    rng = random.Random(4)
    st = [(i, rng.choice(["completed", "failed", "running"]), rng.choice([5, 5, rng.randint(0, 10**6)])) for i in range(500)]
    df = spark.createDataFrame([(i, s, t, t) for i, s, t in st], "request_id int, state string, submitted_at bigint, finished_at bigint").repartition(7)
    order = sorted((t, i) for i, s, t in st if s != "running")
    for many in (0, 1, 60, 1000):
        got = sorted((r.place, r.request_id) for r in X.oldest(df, many).collect())
        assert got == [(k, i) for k, (_, i) in enumerate(order[:many], 1)]
    assert {r.request_id for r in X.overflow(df, 450).collect()} == {i for _, i in order[:50]}


def test_bare_text_equals_normalisation(spark):
    rng = random.Random(5)
    latin, other = [chr(c) for c in range(0x20, 0x250)], list("\u0301\u0307ﬁ…’–日本가Ω½ﾊ\u1e9e\u0130Ǆ")
    texts = [c + "x" for c in latin + other] + ["".join(rng.choice(latin if i % 3 else latin + other) for _ in range(12)) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = ["".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)) for t in texts]
    got = {r.i: r.b for r in df.select("i", T.bare_text(F.col("t")).alias("b")).collect()}
    assert [got[i] for i in range(len(texts))] == want
