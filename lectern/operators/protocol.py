"""The reply protocol: parsing of framed replies, gates, and the fallback cascade, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# fixed values: formats, patterns and limits that replies are judged by
ISLAND = "⟦M[0-9]+⟧"
CROSSTALK_LEAST, CROSSTALK_RATIO = 20, 4
EMPHASIS_PAIR = r"\*{1,2}(?=\S)(.+?)(?<=\S)\*{1,2}"
EMPHASIS_STRAY = r"(?U)(?<=\w)\*{1,2}(?!\w)|(?<!\w)\*{1,2}(?=\w)"
TEX_COMMAND = r"\\[a-zA-Z]{2,}"
TEX_DOLLAR = r"\$([^$]{1,40})\$"
TEX_MATH, TEX_SHORT = r"[_^{}\\]", r"[A-Za-z0-9(),./]{1,6}"
TEX_SHARE, TEX_WORDS = 0.12, 3
SENTENCE_END, CLAUSE_END, CLOSERS = ".!?", ".!?:;", "'\"’”)\\]"
DRIFTED_WORDS = 14
REPAIRED = "_boundary_repaired"
ROUTES = ("structured", "batch", "line", "unit")


def crosstalk(source: Column, translated: Column) -> Column:
    return F.length(T.stripped(translated)) > F.greatest(F.lit(CROSSTALK_LEAST), CROSSTALK_RATIO * F.length(T.stripped(source)))


def island_mismatch(source: Column, translated: Column) -> Column:
    want, got = (F.array_sort(T.all_of(c, ISLAND)) for c in (source, translated))
    return (F.size(want) > 0) & (want != got)


def emphasis_leak(source: Column, translated: Column) -> Column:
    return translated.contains("*") & ~source.contains("*")


def strip_emphasis(t: Column) -> Column:
    """Emphasised text without its marks; marks left at the edge of a word go; runs of spaces become one."""
    unmarked = F.regexp_replace(F.regexp_replace(t, EMPHASIS_PAIR, "$1"), EMPHASIS_STRAY, "")
    return T.stripped(F.array_join(F.split(unmarked, r"\s{2,}"), " "))


def _mathlike(content: Column) -> Column:
    return content.rlike(TEX_MATH) | T.stripped(content).rlike(f"^{TEX_SHORT}$")


def tex_markup(t: Column) -> Column:
    spans = F.regexp_extract_all(t, F.lit(TEX_DOLLAR), F.lit(1))
    return t.rlike(TEX_COMMAND) | F.exists(spans, _mathlike)


def tex_leak(source: Column, translated: Column) -> Column:
    return tex_markup(translated) & ~tex_markup(source)


def strip_tex(t: Column) -> Column:
    """Text between math: dollar pairs that look like math and bare commands become a space, and no
    space is left before closing punctuation.  Pairs are bracketed first, so that the end of one that
    isn't math is not taken for the beginning of another."""
    opened, closed = "\ue000", "\ue001"
    math = rf"{opened}(?:[^{closed}]*{TEX_MATH}[^{closed}]*|\s*{TEX_SHORT}\s*){closed}"
    bracketed = F.regexp_replace(t, TEX_DOLLAR, f"{opened}$1{closed}")
    plain = F.translate(F.regexp_replace(bracketed, math, " "), opened + closed, "$$")
    words = F.filter(F.split(F.regexp_replace(plain, TEX_COMMAND, " "), r"(?U)\s+"), lambda w: w != "")
    return F.regexp_replace(F.array_join(words, " "), r" +([,.;:!?)\]])", "$1")


def fields(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), T.stripped)


def translatable_segment(line: Column) -> Column:
    has = lambda s: ~T.nontranslatable(T.stripped(F.regexp_replace(s, r"(?i)\b(?:https?://|www\.)\S+", " ")))
    return T.stripped(F.array_join(F.filter(fields(line), has), " "))


def effectively_unchanged(source: Column, translated: Column) -> Column:
    part = lambda c: F.coalesce(F.nullif(translatable_segment(c), F.lit("")), T.stripped(c))
    return (part(source) != "") & (T.text_key(part(source)) == T.text_key(part(translated)))


def field_pairs(source: Column, translated: Column) -> Column:
    """(source, translated) of each translatable | field; null unless both have as many, two or more."""
    s, t = fields(source), fields(translated)
    pairs = F.filter(F.arrays_zip(s.alias("source"), t.alias("translated")), lambda p: (p["translated"] != "") & ~T.nontranslatable(p["source"]))
    return F.when((F.size(s) > 1) & (F.size(s) == F.size(t)), pairs)


def _lines(replies: DataFrame, key: str, text: str) -> DataFrame:
    return replies.select(key, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("at", "raw"))


def numbered(replies: DataFrame, key: str = "reply_id", text: str = "text") -> DataFrame:
    """key, n, text: items of numbered lists; lines that follow are appended, a later item of the same
    number replaces the earlier one."""
    head = r"^\s*([0-9]+)[.)]\s*(.*)$"
    x = _lines(replies, key, text).withColumn("n", F.nullif(F.regexp_extract("raw", head, 1), F.lit("")).cast("bigint"))
    w = Window.partitionBy(key).orderBy("at")
    x = x.withColumn("item", F.sum(F.col("n").isNotNull().cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("item > 0")
    piece = F.when(F.col("n").isNotNull(), F.regexp_extract("raw", head, 2)).otherwise(T.stripped(F.col("raw")))
    x = x.withColumn("piece", piece).where(F.col("n").isNotNull() | (F.col("piece") != ""))
    items = x.groupBy(key, "item").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    items = items.withColumn("text", T.stripped(F.array_join(F.transform("parts", lambda p: p["piece"]), " ")))
    return items.groupBy(key, "n").agg(F.max_by("text", "item").alias("text"))


def numbered_accepted(items: DataFrame, expected: DataFrame, key: str = "reply_id") -> DataFrame:
    """key, accepted: a list counts only if its numbers are exactly 1 to the number asked."""
    got = items.groupBy(key).agg(F.array_sort(F.collect_set("n")).alias("got"))
    want = F.when(F.col("asked") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("asked").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return expected.join(got, key, "left").select(key, F.coalesce(F.col("got") == want, F.col("asked") == 0).alias("accepted"))


def blocks(replies: DataFrame, key: str = "reply_id", text: str = "text") -> DataFrame:
    """key, block, line_no, line: lines between # rules; other rules are decoration, leading list marks go."""
    x = _lines(replies, key, text).withColumn("line", T.stripped(F.col("raw"))).where("line <> ''")
    w = Window.partitionBy(key).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    category = F.lower("line").startswith("category:")
    x = x.withColumn("_c", F.sum(category.cast("bigint")).over(upto)).where(~(category & (F.col("_c") == 1)))
    rule = F.replace("line", F.lit(" "), F.lit("")).rlike(r"^[#\-=*:]{3,}$")
    x = x.withColumn("_rule", rule).withColumn("_b", F.sum((rule & F.col("line").contains("#")).cast("bigint")).over(upto)).where("not _rule")
    clean = T.stripped(F.regexp_replace(T.stripped(F.regexp_replace("line", r"^[-*#]+(?=\s|$)", "")), r"^\*+|\*+$", ""))
    x = x.withColumn("line", clean).where("line <> ''")
    return x.select(key, (F.dense_rank().over(Window.partitionBy(key).orderBy("_b")) - 1).alias("block"), (F.row_number().over(Window.partitionBy(key, "_b").orderBy("at")) - 1).alias("line_no"), "line")


def cascade(units: DataFrame, replies: dict[str, DataFrame], key: str = "unit_id") -> DataFrame:
    """units with text and route: the first route that has an acceptable text, else the source."""
    d = units
    text, route = F.lit(None).cast("string"), F.lit("source")
    for name in reversed(list(replies)):
        d = d.join(replies[name].select(key, F.col("text").alias(f"_{name}")), key, "left")
        bad = crosstalk(F.col("source_text"), F.col(f"_{name}")) | island_mismatch(F.col("source_text"), F.col(f"_{name}"))
        ok = F.col(f"_{name}").isNotNull() & (F.col(f"_{name}") != "") & ~bad
        text, route = F.when(ok, F.col(f"_{name}")).otherwise(text), F.when(ok, name).otherwise(route)
    skip = T.noise(F.col("source_text")) | T.nontranslatable(F.col("source_text"))
    return d.select(*units.columns, F.when(skip, F.col("source_text")).otherwise(F.coalesce(text, F.col("source_text"))).alias("text"), F.when(skip, "skipped").otherwise(route).alias("route"))


def boundary_repair(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sentence tails that drifted to the end of a unit go to the front of the next one.

    A tail drifted if its unit's source ends a clause and its text doesn't, and the next unit's source
    begins with a capital and its text with a small letter.  What moves is what follows the last sentence
    end of the text: it has none itself, so what a unit is given never changes what it gives, and
    one look at the neighbours decides every repair of a chain."""
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source_text", F.lit(""))
    ends = lambda c: c.rlike(rf"(?U)[{CLAUSE_END}][{CLOSERS}]*\s*$")
    small = lambda c: (F.lower(c) == c) & (F.upper(c) != c)
    large = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    initial = lambda c: F.substring(c, 1, 1)
    w = Window.partitionBy(*keys).orderBy(order)
    tail = rf"(?sU)^(.*[{SENTENCE_END}][{CLOSERS}]*)\s+(\S.*?)\s*$"
    d = results.withColumns({"_after": F.coalesce(F.lead(text).over(w), F.lit("")), "_next": F.coalesce(F.lead(source).over(w), F.lit("")), "_tail": F.regexp_extract(text, tail, 2)})
    drifted = ends(source) & ~ends(text) & small(initial(F.col("_after"))) & large(initial(F.col("_next")))
    movable = (F.col("_tail") != "") & (F.size(F.split("_tail", r"(?U)\s+")) <= DRIFTED_WORDS) & ~F.col("_tail").rlike(ISLAND)
    d = d.withColumn("_given", F.when(drifted & movable, F.col("_tail")))
    d = d.withColumn("_taken", F.lag("_given").over(w))
    left = F.when(F.col("_given").isNull(), F.col("text")).otherwise(T.stripped(F.regexp_extract(text, tail, 1)))
    done = {"text": F.when(F.col("_taken").isNull(), left).otherwise(F.concat("_taken", F.lit(" "), left)), "route": F.when(F.col("_taken").isNull(), F.col("route")).otherwise(F.concat("route", F.lit(REPAIRED)))}
    return d.withColumns(done).select(*results.columns)
