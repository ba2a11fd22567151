"""Claims of cell groups on reading-order lines: which of several groups has the line, extends it, prints it
again, or is none of it; fragments of icons and lone symbols.

A page is one row, with its units, cells and lines; the tokens that a claim covers, the exact ones and the garbled
ones, are found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T

from .alignment import PAGE, page_units
from .pages import Vocabulary, bits, each, gathered, match_list, spelt_form, token_runs

# fixed values
ICON_HEIGHT = 0.6
WORD_OVERLAP, WORD_GAP = 0.4, 1.2
KEPT, MERGED, PRINT, DROPPED = "kept", "merged", "print", "dropped"


class Claim:
    """A group's claim on a line: the line's tokens that it covers, whether all it has is the line's, its box."""

    def __init__(self, number: int, covers: set[str], exact: bool, box: tuple[float, float, float, float]):
        self.number, self.covers, self.exact, self.box = number, covers, exact, box

    def near(self, other: Claim) -> bool:
        a, b = self.box, other.box
        height = max(a[3] - a[1], b[3] - b[1], 1.0)
        gap = [max(a[k], b[k]) - min(a[k + 2], b[k + 2]) for k in (0, 1)]  # negative where they overlap
        return gap[0] < 0 and gap[1] <= G.STACK_GAP * height or gap[1] < 0 and gap[0] <= G.LINE_GAP * height

    def over(self, other: Claim) -> bool:
        a, b = self.box, other.box
        common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return common > G.SAME_PLACE * min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))

    def join(self, other: Claim) -> None:
        self.box = (*(min(p) for p in zip(self.box[:2], other.box[:2])), *(max(p) for p in zip(self.box[2:], other.box[2:])))


def resolve(claims: list[Claim], fields: list[set[str]]) -> dict[int, tuple[str, int]]:
    """{claim: (verdict, the claim that has it)} of one line.

    The fullest claim and each that covers a field nobody has keep the line.  Of the others, those with words that
    nobody has wait to be joined to a neighbour, whose box grows by them, until none can be joined; the rest print
    the line again, if all their words are the line's and their place is their own, or are dropped."""
    out: dict[int, tuple[str, int]] = {}
    kept: list[Claim] = []
    words: set[str] = set()
    held: set[int] = set()
    waiting: list[Claim] = []

    def spare(c: Claim) -> None:
        again = c.exact and not any(c.over(k) for k in kept)
        out[c.number] = (PRINT if again else DROPPED, c.number)

    for c in sorted(claims, key=lambda c: -len(c.covers)):
        own = {i for i, f in enumerate(fields) if f & c.covers}
        if not kept or own - held:
            kept.append(c)
            words |= c.covers
            held |= own
            out[c.number] = (KEPT, c.number)
        elif c.covers - words:
            waiting.append(c)
        else:
            spare(c)
    joined = True
    while joined and waiting:
        joined, still = False, []
        for c in waiting:
            home = next((k for k in kept if c.near(k)), None)
            if not c.covers - words:
                spare(c)
                joined = True
            elif home is None:
                still.append(c)
            else:
                home.join(c)
                words |= c.covers
                out[c.number] = (MERGED, home.number)
                joined = True
        waiting = still
    for c in waiting:
        if c.covers - words:
            out[c.number] = (DROPPED, c.number)
        else:
            spare(c)
    return out


def page_claims(units: dict[str, list], cells: dict[str, list], lines: dict[str, list]) -> Iterator[tuple[int, list[Claim], list[set[str]]]]:
    """(line, its claims, its fields) of a page's lines that several groups claim."""
    groups: dict[int, dict[int, list[int]]] = {}
    for line, first, held in zip(units["line_idx"], units["first_cell"], units["cells"]):
        if line is not None:
            groups.setdefault(line, {}).setdefault(first, []).extend(held)
    rows: dict[int, list[int]] = {}
    for k, i in enumerate(cells["cell_id"]):
        rows.setdefault(i, []).append(k)
    x, y, w, h, text = (cells[k] for k in ("x", "y", "w", "h", "text"))
    for line, t in zip(lines["line_idx"], lines["text"]):
        if len(groups.get(line, ())) < 2:
            continue
        fields = [] if t is None else [set(token_runs(f)) for f in spelt_form(t).split("|")]
        every = set().union(*fields)
        vocabulary, found = None, []
        for first in sorted(groups[line]):
            own = [k for i in groups[line][first] for k in rows.get(i, ())]
            if not own:
                continue
            covers, exact = set(), True
            for a in {a for k in own for a in match_list(text[k])}:
                if a in every:
                    covers.add(a)
                    continue
                exact, vocabulary = False, vocabulary or Vocabulary(sorted(every))
                covers.update(vocabulary.tokens[i] for i in bits(vocabulary.alike(a)))
            box = min(x[k] for k in own), min(y[k] for k in own), max(x[k] + w[k] for k in own), max(y[k] + h[k] for k in own)
            found.append(Claim(first, covers, exact, box))
        yield line, found, fields


def _resolved(whole: DataFrame, units_of) -> DataFrame:
    """The verdicts of gathered pages; ``units_of`` has a page's units from its tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, t in each(batch, PAGE):
                for line, claims, fields in page_claims(units_of(t), t["cells"], t["lines"]):
                    out += [(*key, line, k, v, home) for k, (v, home) in resolve(claims, fields).items()]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[*PAGE, "line_idx", "first_cell", "verdict", "home"])

    return whole.mapInArrow(run, "doc bigint, page bigint, line_idx bigint, first_cell bigint, verdict string, home bigint")


def resolved_claims(units: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, page, line_idx, first_cell, verdict, home of each claim on a line that several groups claim."""
    whole = gathered(PAGE, units=units.select(*PAGE, "line_idx", "first_cell", "cells"), cells=cells.select(*PAGE, "cell_id", "text", "x", "y", "w", "h"), lines=lines.select(*PAGE, "line_idx", "text"))
    return _resolved(whole, lambda t: t["units"])


def labelled_claims(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """``resolved_claims`` of the units that cells with a line (null: a leftover) make, which are found on the page's
    row; cells of lines that the page hasn't are in no unit."""

    def units_of(t: dict[str, dict[str, list]]) -> dict[str, list]:
        known = {None, *t["lines"]["line_idx"]}
        bound = [(i, line) for i, line in zip(t["cells"]["cell_id"], t["cells"]["line_idx"]) if line in known]
        found = page_units([i for i, _ in bound], [line for _, line in bound])
        return {"first_cell": [u[0] for u in found], "line_idx": [u[1] for u in found], "cells": [u[2] for u in found]}

    whole = gathered(PAGE, cells=cells.select(*PAGE, "cell_id", "line_idx", "text", "x", "y", "w", "h"), lines=lines.select(*PAGE, "line_idx", "text"))
    return _resolved(whole, units_of)


def icon_fragments(units: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, page, cell_id of members that add no word to their unit and are set apart from it: much lower than the
    others, or, where the line is one field, above them or near none of them."""
    u = units.where((F.col("line_idx").isNotNull()) & (F.size("cells") > 1)).select(*PAGE, "line_idx", "first_cell", F.explode("cells").alias("cell_id"))
    item = F.struct("cell_id", T.match_tokens(F.col("text")).alias("t"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    g = u.join(cells.select(*PAGE, "cell_id", "text", "x", "y", "w", "h"), [*PAGE, "cell_id"]).groupBy(*PAGE, "line_idx", "first_cell").agg(F.sort_array(F.collect_list(item)).alias("m"))
    g = g.join(lines.select(*PAGE, "line_idx", (~F.col("text").contains("|")).alias("one")), [*PAGE, "line_idx"])

    def median(v: Column) -> Column:
        n, at = F.size(v), lambda s, i: F.get(s, i.cast("int"))
        return F.transform(F.array(F.array_sort(v)), lambda s: (at(s, F.floor((n - 1) / 2)) + at(s, F.floor(n / 2))) / 2)[0]

    def apart(x: Column) -> Column:
        others = F.filter("m", lambda o: o["cell_id"] != x["cell_id"])
        known = F.flatten(F.transform(others, lambda o: o["t"]))
        height = x["y1"] - x["y0"]
        low = (height > 0) & (height < ICON_HEIGHT * median(F.transform(others, lambda o: o["y1"] - o["y0"])))
        away = (x["y1"] <= F.array_min(F.transform(others, lambda o: o["y0"]))) | ~F.exists(others, lambda o: G.near(x, o))
        return (F.size(x["t"]) > 0) & (F.size(F.array_except(x["t"], known)) == 0) & (low | (F.col("one") & away))

    found = g.withColumn("gone", F.filter("m", apart)).where(F.size("gone") < F.size("m"))  # a unit is never emptied
    return found.select(*PAGE, F.explode(F.transform("gone", lambda x: x["cell_id"])).alias("cell_id"))


def page_symbols(units: dict[str, list], cells: dict[str, list], lines: dict[str, list]) -> Iterator[tuple[int, int]]:
    """(cell, first cell of its unit) of a page's symbols that a unit takes."""
    alone = {f for line, f, held in zip(units["line_idx"], units["first_cell"], units["cells"]) if line is None and len(held) == 1}
    symbols = [(k, i, s) for k, (i, s) in enumerate(zip(cells["cell_id"], cells["symbol"])) if s and s != "|" and i in alone and not match_list(s)]
    if not symbols:
        return
    rows: dict[int, list[int]] = {}
    for k, i in enumerate(cells["cell_id"]):
        rows.setdefault(i, []).append(k)
    number = {line: k for k, line in enumerate(dict.fromkeys(lines["line_idx"]))}
    bound = [(k, number[line], first) for line, first, held in zip(units["line_idx"], units["first_cell"], units["cells"]) if line is not None and line in number for i in held for k in rows.get(i, ())]
    if not bound:
        return
    at, of, first = (np.array(c, np.int64) for c in zip(*bound))
    x0, y0, w, h = (np.array(cells[c], float) for c in ("x", "y", "w", "h"))
    x1, y1 = x0 + w, y0 + h
    bx0, by0, bx1, by1 = x0[at], y0[at], x1[at], y1[at]
    having: dict[str, np.ndarray] = {}  # bound cells whose line has the symbol
    least: dict[int, int] = {}
    for k, i, s in symbols:
        if s not in having:
            has = np.zeros(len(number), bool)
            for line, t in zip(lines["line_idx"], lines["text"]):
                has[number[line]] |= t is not None and s in t
            having[s] = np.flatnonzero(has[of])
        c = having[s]
        side = np.minimum(y1[k], by1[c]) - np.maximum(y0[k], by0[c]) > WORD_OVERLAP * np.minimum(y1[k] - y0[k], by1[c] - by0[c])
        gap = np.maximum(bx0[c] - x1[k], x0[k] - bx1[c]) <= WORD_GAP * (y1[k] - y0[k])
        near = c[side & gap]
        if len(near):
            least[i] = min(least.get(i, 1 << 63), int(first[near].min()))
    yield from least.items()


def absorbed_symbols(units: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, page, cell_id, first_cell: lone symbols, and the first unit whose line has the symbol and one of whose
    cells is a word gap away on the same line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*key, *found) for key, t in each(batch, PAGE) for found in page_symbols(t["units"], t["cells"], t["lines"])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=[*PAGE, "cell_id", "first_cell"])

    # what has a letter or digit of ASCII has a token, so its text stays where it is
    symbol = F.when(~F.col("text").rlike("[A-Za-z0-9]"), T.stripped(F.col("text")))
    placed = cells.select(*PAGE, "cell_id", symbol.alias("symbol"), "x", "y", "w", "h")
    whole = gathered(PAGE, units=units.select(*PAGE, "line_idx", "first_cell", "cells"), cells=placed, lines=lines.select(*PAGE, "line_idx", "text"))
    return whole.mapInArrow(run, "doc bigint, page bigint, cell_id bigint, first_cell bigint")
