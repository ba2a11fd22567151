"""Wrapping by halving against all widths and sizes tried one by one; pieces are found once for each use."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import fitting as W
from lectern.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plain(pieces, width, most=10**9):
    lines = []
    for p, glue in pieces:
        if lines and (len(lines[-1]) + len(glue) + len(p) <= width or len(lines) >= most):
            lines[-1] += glue + p
        else:
            lines.append(p)
    return lines or [""]


def test_halving_finds_what_trying_all_finds(spark):
    rng = random.Random(7)
    texts = ["", "   ", "a", "x" * 90, *("".join(rng.choice(["ab", "c" * rng.randint(1, 30), "日", "（", "。", " ", " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    t = F.col("p")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("p", W.break_pieces(F.col("text")))
    for r in df.select("p", W.wrapped(t, F.lit(17)).alias("w"), W.wrapped(t, F.lit(9), F.lit(2)).alias("two"), W.balanced(t, F.lit(37), 3).alias("b"), W.largest_fit(F.col("text"), F.lit(200), F.lit(60), 6, 24).alias("size")).collect():
        pieces = [tuple(p) for p in r.p]
        assert r.w == plain(pieces, 17) and r.two == plain(pieces, 9, 2)
        assert r.b == plain(pieces, next((w for w in range(1, 38) if len(plain(pieces, w)) <= 3), 37), 3)
        caps = {n: int(200 // (n / 2)) for n in range(6, 25)}
        fits = [n for n, cap in caps.items() if max(map(len, plain(pieces, cap))) <= cap and len(plain(pieces, cap)) * n * 1.25 <= 60]
        assert r.size == max(fits, default=6)
    none = spark.createDataFrame([(None,)], "text string")
    assert none.select(W.largest_fit(F.col("text"), F.lit(200), F.lit(60), 6, 24)).first()[0] == 6


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")
@pytest.mark.parametrize("name, most", [("F26_balanced_lines", 1), ("H25_wrapped_lines", 2)])
def test_pieces_are_found_once(spark, name, most):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= most


def test_texts_wrap_as_their_pieces_do(spark):
    rng = random.Random(8)
    texts = [None, "", "   ", " a", "a\tb", "x" * 90, *("".join(rng.choice(["ab", "é" * rng.randint(1, 30), "日", "（", "。", "\u2003", " ", " ", " "][: rng.choice([3, 9])] + [" "]) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = F.col("text")
    for width in (1, 7, 24):
        for r in df.select("text", W.wrapped(W.break_pieces(t), F.lit(width)).alias("w"), W.wrapped_text(t, F.lit(width)).alias("got")).collect():
            assert r.got == r.w, repr(r.text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")
def test_lines_are_not_folded_over(spark):
    plan = QUERIES["H25_wrapped_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
