"""Fitting translated text to its place: break pieces, wrapping, justification, markers, as column functions.

Widths come from a model that the caller injects; the default is one unit a character.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lectern.functions import text as T

from .protocol import ISLAND

# fixed values: characters that hold to the next or to the one before, and limits of stretching
OPENING, CLOSING = "（「『【〔《〈｛", "。、，．！？：；）」』】｝〕》〉"
WIDE_SCRIPT = "\u3000-\u303f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff00-\uffef"
LETTERS_OF_SCRIPT = "[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7a3\u1100-\u11ff\u3130-\u318e]"
EM_SPACE = "\u2003"
MOST_EXTRA, MOST_SHRINK, SQUEEZE = 1.5, 0.25, 0.94
GLYPHS = "•·∙●○◦‣⁃*–—-"
LEAD_MARKERS = "*†‡§¶⋆✦◊⋄♠♣♥♦♡♢"


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def break_pieces(text: Column) -> Column:
    """(piece, glue) in order: words, and single characters of scripts without spaces; opening marks hold
    to what follows, closing marks to what stands before.  The glue is the white space in front: none, a
    space, or an em space, which keeps its width."""
    core = rf"[^\s{WIDE_SCRIPT}]+|[{WIDE_SCRIPT}&&[^\s{OPENING}{CLOSING}]]"
    held = rf"[{OPENING}](?:\s*[{OPENING}{CLOSING}])*"
    piece = rf"(?U)\s*(?:(?:{held}\s*)?(?:{core})(?:\s*[{CLOSING}])*|{held}\s*$|^\s*[{CLOSING}](?:\s*[{CLOSING}])*)"
    lead = lambda m: F.regexp_extract(m, r"(?U)^\s*", 0)
    glue = lambda m: F.when(lead(m).contains(EM_SPACE), EM_SPACE).when(lead(m) != "", " ").otherwise("")
    parts = F.transform(T.all_of(text, piece), lambda m: F.struct(F.regexp_replace(m, r"(?U)\s+", "").alias("piece"), glue(m).alias("glue")))
    front = F.when(text.startswith(" "), " ").otherwise("")
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w, i: F.struct(w.alias("piece"), F.when(i == 0, front).otherwise(" ").alias("glue")))
    return F.when(_scripted(text), parts).otherwise(words)


def _scripted(text: Column) -> Column:
    """Whether text has such scripts, or white space other than spaces; if not, its pieces are words."""
    return text.rlike(rf"(?U)[{WIDE_SCRIPT}]|[\s&&[^ ]]")


def wrapped(pieces: Column, width: Column, most: Column | None = None) -> Column:
    """Lines of pieces, each as long as ``width`` allows (a piece that is wider has a line of its own); the
    last of ``most`` lines takes the rest."""

    def lines(pieces: Column) -> Column:
        starts = F.aggregate(_sizes(pieces), _start(True), _add(width, most, True), lambda s: s["starts"])

        def cut(starts: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(starts, k + 1), F.size(pieces))
            of = lambda first, end: F.slice(pieces, first + 1, end - first)
            line = lambda p: F.array_join(F.flatten(F.transform(p, lambda x, i: F.array(F.when(i == 0, "").otherwise(x["glue"]), x["piece"]))), "")
            return F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(F.transform(starts, lambda first, k: line(of(first, upto(k)))))

        return _let(starts, cut)

    return _let(pieces, lines)


def _sizes(pieces: Column) -> Column:
    """Lengths of pieces and of the glue in front of them."""
    return F.transform(pieces, lambda p: F.struct(F.length(p["piece"]).alias("n"), F.length(p["glue"]).alias("glue")))


def _start(places: bool) -> Column:
    """No line yet; with the places where lines begin if these are wanted."""
    counts = [F.lit(0).alias("at"), F.lit(0).alias("lines"), F.lit(0).alias("long")]
    return F.struct(*counts, *([F.expr("cast(array() as array<int>)").alias("starts")] if places else []))


def _add(width: Column, most: Column | None, places: bool):
    """One piece more: how many pieces and lines there are, how long the last line is."""

    def add(s: Column, p: Column) -> Column:
        joined = s["long"] + p["glue"] + p["n"]
        stays = (s["lines"] > 0) & (joined <= width)
        if most is not None:
            stays = stays | (s["lines"] >= F.greatest(F.lit(1), most))
        parts = [(s["at"] + 1).alias("at"), F.when(stays, s["lines"]).otherwise(s["lines"] + 1).alias("lines"), F.when(stays, joined).otherwise(p["n"]).alias("long")]
        return F.struct(*parts, *([F.when(stays, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"]))).alias("starts")] if places else []))

    return add


def _lines_needed(sizes: Column, width: Column) -> Column:
    return F.greatest(F.lit(1), F.aggregate(sizes, _start(False), _add(width, None, False), lambda s: s["lines"]))


def _long_and_total(sizes: Column) -> tuple[Column, Column]:
    """The longest piece, and all of them: where none is too wide, lines hold no more than their width."""
    n = F.transform(sizes, lambda p: p["n"])
    return F.coalesce(F.array_max(n), F.lit(0)), F.aggregate(n, F.lit(0), lambda s, x: s + x)


def balanced(pieces: Column, widest: Column, lines: int) -> Column:
    """The lines of the narrowest width, up to ``widest``, that needs no more than ``lines`` lines.  A wider line
    never needs more lines, so the width is found by halving."""

    def narrowest(sizes: Column) -> Column:
        def halve(s: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            ends = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
            return F.when(s["lo"] >= s["hi"], s).otherwise(_let(mid, lambda m: F.when(_lines_needed(sizes, m) <= lines, ends(s["lo"], m)).otherwise(ends(m + 1, s["hi"]))))

        top = F.greatest(F.lit(1), widest).cast("int")
        steps = F.sequence(F.lit(1), F.ceil(F.log2(top.cast("double"))).cast("int") + 1)
        found = F.aggregate(steps, F.struct(F.lit(1).alias("lo"), top.alias("hi")), lambda s, _: halve(s), lambda s: s["lo"])
        long, total = _long_and_total(sizes)
        return F.when((long <= top) & (total > top * lines), widest).when(_lines_needed(sizes, top) <= lines, found).otherwise(widest)

    return _let(pieces, lambda p: _let(_let(_sizes(p), narrowest), lambda w: wrapped(p, w, F.lit(lines))))


def _ends(total: list[int], glue: list[int], width: int) -> Iterator[int]:
    """Where each line ends of pieces, ``total`` long up to each with the glue in front of them."""
    first, n = 0, len(total)
    while first < n:
        before = total[first - 1] if first else 0
        first = max(first + 1, bisect_right(total, before + glue[first] + width, first))
        yield first


def _pieces(text: str, parts) -> tuple[list[str], list[str]]:
    """Pieces and glue of a text: ``parts`` if it has any, else its words."""
    if parts is not None:
        return [p["piece"] for p in parts], [p["glue"] for p in parts]
    words = [w for w in text.split(" ") if w]
    return words, [" " if k or text[0] == " " else "" for k in range(len(words))]


def _totals(words: list[str], glue: list[str]) -> tuple[list[int], list[int]]:
    return list(accumulate(len(w) + len(g) for w, g in zip(words, glue))), [len(g) for g in glue]


@F.pandas_udf(ArrayType(StringType()))
def _text_lines(texts: pd.Series, parts: pd.Series, widths: pd.Series) -> pd.Series:
    out: list[list[str] | None] = []
    for text, found, width in zip(texts, parts, widths):
        if text is None:
            out.append(None)
            continue
        words, glue = _pieces(text, found)
        first, lines = 0, []
        for end in _ends(*_totals(words, glue), int(width)):
            lines.append(" ".join(words[first:end]) if found is None else "".join([words[first], *(g + w for g, w in zip(glue[first + 1 : end], words[first + 1 : end]))]))
            first = end
        out.append(lines or [""])
    return pd.Series(out, dtype=object)


def wrapped_text(text: Column, width: Column) -> Column:
    """``wrapped`` of a text's pieces: a line's end is found by halving."""
    return _text_lines(text, F.when(_scripted(text), break_pieces(text)), width)


def largest_fit(text: Column, width: Column, height: Column, least: int, most: int) -> Column:
    """The largest size at which the wrapped text fits a box; characters are 0.5, lines 1.25 times as wide
    and high as the size.  ``least`` if none fits.  What doesn't fit at a size fits at no larger one."""

    @F.pandas_udf(IntegerType())
    def largest(texts: pd.Series, parts: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        out = []
        for text, found, width, height in zip(texts, parts, widths, heights):
            lo, hi = least, least if text is None else most
            words, glue = _pieces(text, found) if lo < hi else ([], [])
            long, total = max(map(len, words), default=0), sum(map(len, words))
            ends = None
            while lo < hi:
                mid = (lo + hi + 1) // 2
                cap = int(width // (mid * 0.5))
                fits = long <= cap and total * mid * 1.25 <= cap * height
                if fits:
                    ends = ends or _totals(words, glue)
                    fits = max(1, sum(1 for _ in _ends(*ends, cap))) * mid * 1.25 <= height
                lo, hi = (mid, hi) if fits else (lo, mid - 1)
            out.append(lo)
        return pd.Series(out, dtype="int32")

    return largest(text, F.when(_scripted(text), break_pieces(text)), width, height)


def justifiable(text: Column, natural: Column, target: Column, space: Column) -> Column:
    """Whether a line of two words or more can end flush: its gaps stretched or shrunk a little, or all of
    it squeezed a little."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    gap = (target - natural) / F.nullif(words - 1, F.lit(0))
    room = F.greatest(F.lit(1.0), space)
    return F.coalesce((words >= 2) & (gap <= MOST_EXTRA * room) & ((gap >= -MOST_SHRINK * room) | (target >= SQUEEZE * natural)), F.lit(False))


def overhang_width(natural: Column, condense: Column, plane: Column) -> Column:
    """The width that a too long line is squeezed to; null if it fits, or would be too narrow."""
    wide = natural * condense
    return F.when((wide > plane) & (plane >= SQUEEZE * wide), F.greatest(F.lit(1), F.bround(plane)).cast("bigint"))


def fold_wide_marks(text: Column) -> Column:
    """Full-width marks as ASCII, in text without letters of the scripts that they belong to."""
    wide = "\u3000" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    plain = " " + "".join(chr(c) for c in range(0x21, 0x7F))
    return F.when(text.rlike(LETTERS_OF_SCRIPT), text).otherwise(F.translate(text, wide, plain))


def island_segments(text: Column) -> Column:
    """(kind, value) of a text's parts in order: text and islands."""
    parts = T.all_of(text, f"{ISLAND}|(?:(?!{ISLAND}).)+")
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(f"^{ISLAND}$"), "island").otherwise("text").alias("kind"), p.alias("value")))


def without_number(text: Column, number: Column) -> Column:
    """Text without the leading number that is printed elsewhere."""
    bare = F.ltrim(text)
    return F.when(number.isNotNull() & (number != "") & bare.startswith(number), F.ltrim(F.substr(bare, F.length(number) + 1))).otherwise(text)


def widened_number(text: Column, number: Column) -> Column:
    """Text with an em space between its leading number and what follows."""
    rest = F.substr(F.ltrim(text), F.length(number) + 1)
    lead = F.substr(text, F.lit(1), F.length(text) - F.length(F.ltrim(text)))
    return F.when((number != "") & F.ltrim(text).startswith(number) & rest.rlike(r"^\s+\S"), F.concat(lead, number, F.lit(EM_SPACE), F.ltrim(rest))).otherwise(text)


def restored_number(text: Column, number: Column) -> Column:
    """Text with its number in front again, unless the number stands anywhere in it."""
    digits = F.concat(F.lit(" "), F.regexp_replace(text, "[^0-9.]+", " "), F.lit(" "))
    held = F.regexp_replace(F.rtrim(number, F.lit(".:)")), "[^0-9.]+", "")
    known = F.regexp_replace(digits, r"\.(?= )", "").contains(F.concat(F.lit(" "), held, F.lit(" ")))
    return F.when((F.trim(text) == "") | (number == "") | known, text).otherwise(F.concat(number, F.lit(EM_SPACE), F.trim(text)))


def without_glyph(text: Column) -> Column:
    """Text without one leading glyph marker."""
    t = T.stripped(text)
    return F.when(F.length(t) > 1, F.regexp_replace(t, rf"^[{GLYPHS}]\s+", "")).otherwise(text)


def with_marker(text: Column, marker: Column) -> Column:
    """Text with the marker in front, unless it has it."""
    t = T.stripped(text)
    return F.when((F.length(t) > 1) & ~t.startswith(marker), F.concat(marker, F.lit(" "), t)).otherwise(text)


def with_lead_marker(text: Column, printed: Column) -> Column:
    """Text with the lead marker that the source prints, unless it begins with any."""
    mark = F.regexp_extract(F.ltrim(printed), rf"(?U)^([{LEAD_MARKERS}])(?=\w)", 1)
    return F.when((mark == "") | (T.stripped(text) == "") | F.ltrim(text).rlike(f"^[{LEAD_MARKERS}]"), text).otherwise(F.concat(mark, text))
