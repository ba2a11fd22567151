"""Quality rules: counting rules and divergence from language references.

The divergence rule compares two histograms of a document, of character classes and of
words, with those of each language, by Jensen-Shannon distance (base 2, so 0 to 1).  The
words counted are the most frequent short ones of each language, learned from all its
documents; every other word is in one cell more, so a text without any of them has a
distance too.  A document passes if one language is near enough in both; a histogram of fewer
characters or words than its guard asks decides nothing.

References are sums over the documents of each language that the counting rules keep, or over all
of them where none is kept.
Everything is expressed in DataFrame functions: words become one letter each where they
are common, so that a count is a difference of string lengths, and a distance is a sum over
the words that the document has.

Defined results: a null text has no words and fails; an empty table gives an empty result; without
a document with words that names its language nothing diverges; rows are independent, so ties and
repeats each keep their row; of words equally frequent the first in order is learned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 50
#: words learned of each language, and letters that such a word has at most
COMMON, LONGEST = 24, 8
#: guards: characters and words that a histogram needs to count
MIN_CHARS = 200
MIN_COUNTED = 50
#: largest distances that pass; n words drawn from the reference itself are some NOISE / sqrt(n) from it.
#: Of labelled documents of sf0.1 that the counting rules keep, these keep 99.97 % of the good, 21 % of the bad
MAX_CLASS = 0.28
MAX_COMMON, NOISE = 0.2, 2.2
#: the letters that stand for learned words, of which there are at most so many
LETTER, LETTERS = 0xE000, 6400
#: buckets that learned words are looked up in
BUCKETS = 256
#: character classes as patterns to remove, tried on the text
WHITE_CLASS, SYMBOL_CLASS = 5, 6  # places of "white" and "mark", from 1
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "other_letter": r"[\p{Lo}\p{Lt}\p{Lm}\p{M}]+", "digit": r"\p{Nd}+", "white": r"[ \t\n\x0B\f\r]+", "mark": r"[#*$%&|<>]+", "stop": r"[.,;:!?'\"()\-]+"}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not again for each use."""
    return F.transform(F.array(value), body)[0]


def counts(text: Column) -> dict[str, Column]:
    """The base counts; null counts as an empty text."""
    chars, words = class_counts(text), spoken_words(text)
    return {
        "n_words": words["n"],
        "word_chars": F.length(F.coalesce(text, F.lit(""))).cast("bigint") - F.element_at(chars, WHITE_CLASS),
        "n_symbols": F.element_at(chars, SYMBOL_CLASS),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": words["repeated"],
    }


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    return _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint")


def spoken_words(text: Column) -> Column:
    """How many words a text has, and how many of them are repeated, as a struct."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("bigint").alias("n"), repeated(h).alias("repeated")))


def repeated(hashes: Column, k: int = 3) -> Column:
    """How many words lie in windows of k words that occur twice or more, from the words' hashes.

    Only a text in which two windows are equal has its windows sorted with their places: as one number
    each, 50 bits of hash and 14 of place, or as pairs in longer texts.  Sorted places p of
    windows that have an equal neighbour cover min(k, next - p) words."""
    short = 1 << 14

    def places(ordered: Column, same, place) -> Column:
        near = lambda x, i: F.coalesce(same(F.try_element_at(ordered, (i + 2).cast("int")), x), F.lit(False)) | F.coalesce(same(F.get(ordered, i - 1), x), F.lit(False))
        return F.sort_array(F.filter(F.transform(ordered, lambda x, i: F.when(near(x, i), place(x))), lambda x: x.isNotNull()))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(k).cast("bigint"), F.coalesce(F.try_element_at(at, (i + 2).cast("int")) - p, F.lit(k).cast("bigint")))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def of_windows(windows: Column) -> Column:
        numbers = F.sort_array(F.transform(windows, lambda h, i: F.shiftleft(F.shiftright(h, 14), 14) + i))
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("at"))))
        few = _let(numbers, lambda n: _let(places(n, lambda x, y: F.shiftright(x, 14) == F.shiftright(y, 14), lambda x: x.bitwiseAND(F.lit(short - 1).cast("bigint"))), covered))
        many = _let(pairs, lambda n: _let(places(n, lambda x, y: x["h"] == y["h"], lambda x: x["at"]), covered))
        alone = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(alone, F.lit(0).cast("bigint")).when(F.size(windows) <= short, few).otherwise(many)

    windows = lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (k - 1))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
    return _let(windows(hashes), of_windows)


def class_counts(text: Column) -> Column:
    """Characters of each class and the rest, as an array of bigint."""
    t = F.coalesce(text, F.lit(""))
    left = [t]
    for pattern in CLASSES.values():
        left.append(F.regexp_replace(left[-1], pattern, ""))
    lengths = [F.length(x) for x in left]
    return F.array(*[(a - b).cast("bigint") for a, b in zip(lengths, lengths[1:])], lengths[-1].cast("bigint"))


def letter_words(text: Column) -> Column:
    """Runs of letters, in lower case; the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+")


def learn(docs: DataFrame, text: str, lang: str, common: int = COMMON) -> list[tuple[str, int]]:
    """The most frequent short words of each language (``common`` of each), with their hashes.  Words
    are counted within tasks first; what comes to the driver is ``common`` rows a language."""
    words = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("word"))
    n = words.where((F.col("word") != "") & (F.length("word") <= LONGEST)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    got = n.select("word", top.alias("top")).where(F.col("top") <= common).select("word", F.xxhash64("word").alias("h")).distinct().collect()
    if len(got) > LETTERS:
        raise ValueError(f"{len(got)} learned words; {LETTERS} can be told apart")
    return sorted((r.word, r.h) for r in got)


def marks(words: Column, learned: list[tuple[str, int]]) -> Column:
    """The letters of a text's learned words, in the order of the text."""
    if not learned:
        return F.lit("")
    bucket: dict[int, list[Column]] = {}
    for i, (w, h) in enumerate(learned):
        bucket.setdefault(h % BUCKETS, []).extend((F.lit(w), F.lit(chr(LETTER + i))))
    table = F.array(*[F.create_map(*bucket[k]) if k in bucket else F.lit(None).cast("map<string,string>") for k in range(BUCKETS)])
    letter = lambda w: F.coalesce(F.try_element_at(F.get(table, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")), w), F.lit(""))
    return F.array_join(F.transform(words, letter), "")


def present(marked: Column) -> Column:
    """(word: its number, n: how often) of the learned words that a text has."""
    return F.transform(F.filter(F.array_distinct(F.split(marked, "")), lambda c: c != ""), lambda c: F.struct((F.ascii(c) - LETTER).alias("word"), (F.length(marked) - F.length(F.replace(marked, c, F.lit("")))).cast("bigint").alias("n")))


def _term(p: Column, q: Column) -> Column:
    """What a cell adds to twice the squared distance."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return part(p, q) + part(q, p)


def class_distance(counted: Column, n: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of an array of counts, of sum ``n``, to an array of shares."""
    cells = F.zip_with(counted, reference, lambda a, q: _term(a / n, q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / 2))


def word_distance(found: Column, others: Column, n: Column, shares: Column, seen: Column, other: Column) -> Column:
    """Jensen-Shannon distance of a text's words to shares: a cell for each learned word and one for all
    others.  A word that the text lacks adds its share, so what all words add is known from those it has;
    ``seen`` is the sum of ``shares``."""

    def add(s: Column, x: Column) -> Column:
        return _let(F.get(shares, x["word"]), lambda q: F.struct((s["sum"] + _term(x["n"] / n, q)).alias("sum"), (s["seen"] + q).alias("seen")))

    words = F.aggregate(found, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("seen")), add, lambda s: s["sum"] + F.greatest(F.lit(0.0), seen - s["seen"]))
    return F.sqrt(F.greatest(F.lit(0.0), (words + _term(others / n, other)) / 2))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: doc_id), the base counts, class_distance and common_distance
    (to the language that is nearest in the worse of both; null where a guard holds), base_failed and kept."""
    keep = ["doc_id"] if keep is None else keep
    learned, t = learn(docs, text, lang), F.col(text)
    spoken = _let(letter_words(t), lambda w: F.struct(marks(w, learned).alias("marks"), (F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("bigint").alias("n")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns"), F.col(lang).alias("lang"), F.length(F.coalesce(t, F.lit(""))).cast("bigint").alias("n_chars"), spoken_words(t).alias("words"), duplicate_lines(t).alias("n_dup_lines"), class_counts(t).alias("chars"), spoken.alias("spoken"))
    rows = rows.checkpoint()
    n_words, n_repeat = F.col("words.n"), F.col("words.repeated")
    rows = rows.withColumn("base_failed", (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words))
    known, cells = rows.where("lang is not null"), len(CLASSES) + 1
    both = (("k", ~F.col("base_failed")), ("a", F.lit(True)))  # sums over kept documents, and over all
    sums = known.groupBy("lang").agg(*[F.sum(F.when(kept, c)).alias(f"{which}_{name}") for which, kept in both for name, c in (("n", F.col("spoken.n")), *[(f"c{i}", F.element_at("chars", i + 1)) for i in range(cells)])]).orderBy("lang").collect()  # a row for each language
    said = known.select("lang", "base_failed", F.inline(present(F.col("spoken.marks")))).groupBy("lang", "word").agg(*[F.sum(F.when(kept, F.col("n"))).alias(which) for which, kept in both]).collect()  # languages x learned words
    refs = []
    for r in sums:
        which = "k" if r.k_n is not None else "a"
        counted, total = r[f"{which}_n"], sum(r[f"{which}_c{i}"] for i in range(cells))
        if not counted:  # no words, no reference
            continue
        times = {x.word: x[which] or 0 for x in said if x.lang == r.lang}
        shares = [times.get(i, 0) / counted for i in range(len(learned))]
        part = {"chars": F.array(*[F.lit(r[f"{which}_c{i}"] / total) for i in range(cells)]), "shares": F.array(*map(F.lit, shares)).cast("array<double>"), "seen": F.lit(float(sum(shares))), "other": F.lit(max(0.0, 1 - sum(shares)))}
        refs.append(F.struct(*[c.alias(k) for k, c in part.items()]))
    n, marked, chars = F.col("spoken.n"), F.col("spoken.marks"), F.col("n_chars")
    limit = MAX_COMMON + NOISE / F.sqrt(F.greatest(n, F.lit(1)))

    def verdict(found: Column, r: Column) -> Column:
        by_class = F.when(chars >= MIN_CHARS, class_distance(F.col("chars"), chars, r["chars"]))
        by_word = F.when(n >= MIN_COUNTED, word_distance(found, n - F.length(marked), n, r["shares"], r["seen"], r["other"]))
        return _let(F.struct(by_class.alias("by_class"), by_word.alias("by_word")), lambda d: F.struct(F.greatest(F.coalesce(d["by_class"], F.lit(0.0)) / MAX_CLASS, F.coalesce(d["by_word"], F.lit(0.0)) / limit).alias("worse"), d["by_class"].alias("class_distance"), d["by_word"].alias("common_distance")))

    near = _let(present(marked), lambda found: F.array_min(F.transform(F.array(*refs), lambda r: verdict(found, r)))) if refs else F.lit(None).cast("struct<worse:double,class_distance:double,common_distance:double>")
    out = rows.withColumn("nearest", near)
    base = {"n_words": n_words, "word_chars": chars - F.element_at("chars", WHITE_CLASS), "n_symbols": F.element_at("chars", SYMBOL_CLASS), "n_dup_lines": F.col("n_dup_lines"), "n_repeat_words": n_repeat}
    passed = F.coalesce(F.col("nearest.worse") <= 1, F.lit(True))
    return out.select("kept_columns.*", *[c.alias(k) for k, c in base.items()], "nearest.class_distance", "nearest.common_distance", "base_failed", (~F.col("base_failed") & passed).alias("kept"))
