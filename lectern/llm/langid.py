"""Language identification by rank-order n-gram profiles.

A profile lists a language's (or document's) most frequent letter n-grams, n = 1
to 3, by falling frequency.  A document goes to the language with the least
out-of-place distance: the sum, over the document's profile, of how far each
n-gram's rank is from its rank in the language, or the profile length if the
language doesn't list it.

Letters are those of Unicode, lower-cased, with the marks that follow them; a run
of anything else is one boundary.  An n-gram is written as one number: what it is and
up to three code points, so that counting is a sort of numbers, for many texts at once.

Defined results: null texts and texts without letters (marks alone are none) are ``und``
with score 0, and so is every text if nothing was learned; of languages equally near the first by
name is taken, of n-grams equally frequent the one of lesser code points; repeated rows are
judged alike and each count when learning; an empty table gives an empty result.  A text of more
than PART letters without a boundary is cut there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import release

TOP = 300
UNKNOWN = "und"
#: letters that are counted together
PART = 1 << 17
#: different n-grams that a task holds before it sends their counts on
HELD = 1 << 20
#: bits of a code point: letters and marks are below U+E01F0
POINT = np.uint64(20)
KIND = np.uint64(60)


class Profiles(NamedTuple):
    langs: list[str]  # ascending
    grams: np.ndarray  # uint64, ascending: all n-grams of any language's profile
    ranks: np.ndarray  # [languages, grams + 1] uint16: rank, or TOP; the last column is for other n-grams


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0, 1 for a mark or 2 for a letter, by code point."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _cuts(points: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that begin at a boundary."""
    at = 0
    while at < len(points):
        to = min(at + PART, len(points))
        if to < len(points):
            ends = np.flatnonzero(_kinds()[points[at:to]] == 0)
            to = at + int(ends[-1]) if len(ends) and ends[-1] else to
        yield points[at:to]
        at = to


def gram_counts(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of texts, ascending; ``points`` are their code points one after another
    with a boundary (0) around each, ``owner`` says whose each is."""
    kind = _kinds()[points]
    letter = np.zeros(int(owner.max(initial=0)) + 1, bool)
    letter[owner[kind == 2]] = True
    inside = (kind > 0) & letter[owner]
    seen = np.zeros(0x110000, bool)
    seen[points[inside]] = True
    alphabet = np.flatnonzero(seen)
    symbol = np.zeros(0x110000, np.int64)
    symbol[alphabet] = np.arange(1, len(alphabet) + 1)
    s = np.where(inside, symbol[points], 0)
    keep = np.append(True, (s[1:] != 0) | (s[:-1] != 0))  # a run of others is one boundary
    s, owner = s[keep], owner[keep].astype(np.int64)
    b = len(alphabet).bit_length()
    own = owner << (3 * b + 2)
    one = s != 0
    pair = np.where(s[1:] != 0, own[1:], own[:-1]) | 1 << 3 * b | s[:-1] << b | s[1:]
    mid = one[1:-1]
    three = own[1:-1] | 2 << 3 * b | s[:-2] << 2 * b | s[1:-1] << b | s[2:]
    key, n = np.unique(np.concatenate([own[one] | s[one], pair[one[1:] | one[:-1]], three[mid]]), return_counts=True)
    letters = np.concatenate([[0], alphabet]).astype(np.uint64)
    part = lambda k: letters[key >> k * b & (1 << b) - 1]
    gram = (key >> 3 * b & 3).astype(np.uint64) << KIND | part(2) << POINT << POINT | part(1) << POINT | part(0)
    return key >> 3 * b + 2, gram, n


def _together(texts: list[str | None], owners: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``gram_counts`` of texts, as many at once as fit; a long text, or one of an alphabet of thousands, alone."""
    zero, points, owner, size = np.zeros(1, np.uint32), [], [], 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, o = np.concatenate([*points, zero]), np.concatenate([*owner, owner[-1][-1:]])
        points.clear()
        owner.clear()
        return gram_counts(p, o)

    for t, own in zip(texts, owners):
        for p in _cuts(_points(t or "")):
            if points and (size + len(p) > PART or len(p) and p.max() > 0x2FFF):
                yield done()
                size = 0
            points += [zero, p]
            owner.append(np.full(len(p) + 1, own))
            size += len(p)
            if len(p) and p.max() > 0x2FFF:
                yield done()
                size = 0
    if points:
        yield done()


def document_profiles(texts: list[str | None], top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, n-gram) of each text's profile, by text and place; texts without letters have none."""
    got = list(_together(texts, list(range(len(texts)))))
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    doc, gram, n = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((gram, doc))  # texts that were cut
    doc, gram, n = doc[order], gram[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    if not new.all():
        at = np.flatnonzero(new)
        doc, gram, n = doc[at], gram[at], np.add.reduceat(n, at)
    order = np.lexsort((-n, doc))
    doc, gram = doc[order], gram[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = place < top
    return doc[keep], place[keep], gram[keep]


def classify(texts: list[str | None], p: Profiles, top: int = TOP) -> tuple[list[str], np.ndarray]:
    """(languages, scores).  A score is 1 less the distance's share of the worst distance."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    doc, place, gram = document_profiles(texts, top)
    if not len(doc) or not p.langs:
        return names, scores
    at = np.searchsorted(p.grams, gram)
    at[at == len(p.grams)] = 0
    at[p.grams[at] != gram] = len(p.grams)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    away = np.empty((len(p.langs), len(first)), np.int64)
    for k, ranks in enumerate(p.ranks):
        r = ranks[at].astype(np.int64)
        away[k] = np.add.reduceat(np.where(r >= top, top, np.abs(r - place)), first)
    best, size = away.argmin(axis=0), np.diff(np.append(first, len(doc)))
    scores[doc[first]] = 1 - away[best, np.arange(len(first))] / (top * size)
    for i, k in zip(doc[first].tolist(), best.tolist()):
        names[i] = p.langs[k]
    return names, scores


def slices(col: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, a few at a time."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + PART)))
        yield col.slice(at, to - at).to_pylist()
        at = to
    if len(col) and total[-1] > PART:
        release()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> Profiles:
    """Profiles from every row whose text and language aren't null.  Counts are added up
    within tasks first, so what is shuffled is at most one row for each n-gram, language
    and HELD of them; only the profiles (``top`` rows a language) come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        number: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def sums() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own, gram, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((gram, own))
            own, gram, n = own[order], gram[order], n[order]
            at = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])))
            return own[at], gram[at], np.add.reduceat(n, at)

        def rows(own: np.ndarray, gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for k in langs:
                if k not in number:
                    number[k] = len(names)
                    names.append(k)
            at = 0
            for texts in slices(batch.column(1)):
                own = [number[k] for k in langs[at : at + len(texts)]]
                at += len(texts)
                held += [x for x in _together(texts, own) if len(x[0])]
                if sum(len(x[0]) for x in held) > HELD:
                    held = [sums()]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*sums())

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))) - 1
    got = counted.select("lang", "gram", rank.alias("r")).where(F.col("r") < top).collect()
    langs = sorted({r.lang for r in got})
    known = np.unique(np.array([r.gram for r in got], np.int64).view(np.uint64))
    ranks = np.full((len(langs), len(known) + 1), top, np.uint16)
    number = {k: i for i, k in enumerate(langs)}
    for r in got:
        ranks[number[r.lang], np.searchsorted(known, np.uint64(r.gram))] = r.r
    return Profiles(langs, known, ranks)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with lang_pred and score, which take the place of columns of these names."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded: languages x languages x top ranks

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = held.value
        for col in batches:
            made = [classify(texts, p, top) for texts in slices(col)]
            names, scores = [x for m in made for x in m[0]], np.concatenate([m[1] for m in made]) if made else np.empty(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    judged = predict(F.col(f"`{text}`"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    made = docs.select(F.struct(*others).alias("row"), judged.alias("judged"))
    return made.select("row.*", "judged.*")
