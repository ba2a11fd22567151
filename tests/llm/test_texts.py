"""Operators that look at one text, or at a text and its neighbour."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import compression, fingerprints, langid, licences, mixing, pieces, queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- language ----------------------------------------------------------------------------------


def test_language_is_learned(spark):
    import random

    rng = random.Random(1)
    stock = {"xx": ["kala", "mako", "toki", "paku"], "yy": ["strelf", "brundt", "grolch", "schwem"]}
    rows = [(i, " ".join(rng.choice(stock[lg]) for _ in range(30)), lg) for i, lg in enumerate(["xx", "yy"] * 20)]
    df = spark.createDataFrame(rows + [(98, "kala toki", None), (99, "brundt", None), (100, None, "xx"), (101, "123 !", "yy")], "doc_id bigint, text string, lang string")
    p = langid.fit(df)
    assert p.langs == ["xx", "yy"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, p).collect()}
    assert all(got[i][0] == lg for i, _, lg in rows)
    assert got[98][0] == "xx" and got[99][0] == "yy"
    assert got[100] == ("und", 0.0) and got[101] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())


def plain_profile(text):
    """N-grams of a text by falling frequency, counted in strings."""
    import unicodedata

    low = (text or "").lower()
    kind = [unicodedata.category(c)[0] for c in low]
    if "L" not in kind:
        return []
    s = re.sub("\0+", "\0", "\0" + "".join(c if k in "LM" else "\0" for c, k in zip(low, kind)) + "\0")
    n = Counter()
    for i, c in enumerate(s):
        if c != "\0":
            n[c] += 1
            n[s[i - 1 : i + 2]] += 1
        if i:
            n[s[i - 1 : i + 1]] += 1
    return sorted(n, key=lambda g: (-n[g], len(g), g))


def plain_language(text, learned, top=300):
    """(language, score) by the distance of ranks, with profiles as lists of strings."""
    doc = plain_profile(text)[:top]
    if not doc or not learned:
        return "und", 0.0
    away = {}
    for lg in sorted(learned):
        rank = {g: i for i, g in enumerate(learned[lg])}
        away[lg] = sum(abs(rank[g] - i) if g in rank else top for i, g in enumerate(doc))
    best = min(away, key=lambda lg: (away[lg], lg))
    return best, 1 - away[best] / (top * len(doc))


def plain_profiles(rows, top=300):
    from lectern.llm.langid import _kinds  # noqa: F401

    n = defaultdict(Counter)
    for t, lg in rows:
        if t is not None and lg is not None:
            grams = Counter()
            s = [t]
            for x in s:
                low = re.sub("\0+", "\0", "\0" + "".join(c if _kinds()[ord(c)] else "\0" for c in x.lower()) + "\0")
                if any(_kinds()[ord(c)] == 2 for c in low):
                    for i, c in enumerate(low):
                        if c != "\0":
                            grams[c] += 1
                            grams[low[i - 1 : i + 2]] += 1
                        if i:
                            grams[low[i - 1 : i + 1]] += 1
            n[lg] += grams
    return {lg: sorted(c, key=lambda g: (-c[g], len(g), g))[:top] for lg, c in n.items() if c}


ALPHABETS = ["Привет мир, здравей свят", "Zażółć gęślą jaźń", "नमस्ते दुनिया", "日本語のテキスト", "İstanbul ÇOK güzel", "ΟΔΥΣΣΕΥΣ", "\u0301\u0300", "a\u0301 b", "12 !?", "ﬁx", "\U000323af x"]


def test_languages_equal_a_plain_version(spark, rows, docs, nothing):
    every = [(i, t, lg) for i, t, lg, *_ in rows] + [(1000 + i, t, "xyz"[i % 3]) for i, t in enumerate(ALPHABETS)]
    df = spark.createDataFrame(every, "doc_id bigint, text string, lang string").repartition(5)
    p = langid.fit(df)
    want = plain_profiles([(t, lg) for _, t, lg in every])
    assert p.langs == sorted(want)
    got = langid.identify(df.select("doc_id", "text", F.lit("old").alias("score")), p)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in got.collect():
        lg, score = plain_language(r.text, want)
        assert r.lang_pred == lg and abs(r.score - score) < 1e-12
    assert {r.lang_pred for r in got.where("text in ('\u0301\u0300', '12 !?')").collect()} == {"und"}
    empty = langid.fit(nothing)
    assert empty.langs == [] and langid.classify(["text"], empty)[0] == ["und"]
    assert langid.identify(nothing, empty).collect() == [] and langid.identify(nothing, p).collect() == []


def test_profiles_of_many_texts_at_once(rows, monkeypatch):
    """Texts are counted alike alone, together and in parts."""
    texts = [r[1] for r in rows] + ALPHABETS + [ALPHABETS[0] * 3000]
    whole = langid.document_profiles(texts)
    alone = [langid.document_profiles([t]) for t in texts]
    for i in range(len(texts)):
        assert whole[2][whole[0] == i].tolist() == alone[i][2].tolist()
    for part in (60_000, 997):
        monkeypatch.setattr(langid, "PART", part)
        again = langid.document_profiles([t for t in texts if not t or len(t) < 2900 or " " in t])
        assert sorted(again[2].tolist()) == sorted(x for a, t in zip(alone, texts) if not t or len(t) < 2900 or " " in t for x in a[2].tolist())


def test_languages_held_out(spark):
    """The query's own split: what is held out is never learned from, and is predicted well."""
    import zlib

    sf = "/root/testdata/sf0.01"
    got = queries.op2_language_id(spark, sf).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in queries.documents(spark, sf).collect()}
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r for r in held if lang[r.doc_id][0] and any(c.isalpha() for c in lang[r.doc_id][1] or "")]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in judged) >= 0.98 * len(judged) > 100
    assert all(0 <= r.score <= 1 for r in got)


# --- mixing --------------------------------------------------------------------------------------


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_mix_meets_its_targets(docs, rows):
    got = mixing.mix(docs, keep=["doc_id", "source", "text", "size", "h"]).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = water_fill(sizes)
    for r in got:
        assert r.mix_size == size(r.text) and r.mix_source_size == sizes[r.source]
        assert abs(r.mix_target - want[r.source]) < 1e-6
        assert 0 <= r.mix_taken <= 3 * r.mix_size
        assert len(r.mix_shards) == -(-r.mix_taken // r.mix_size) if r.mix_size else r.mix_shards == []
        assert r.size == "z" and r.h == "h"
        taken[r.source] += r.mix_taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs.repartition(5), keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.mix_taken) for r in again) == Counter((r.doc_id, r.mix_taken) for r in got)


def test_caps_are_shared_again(spark):
    rows = [(f"s{i}", n) for i, n in enumerate([3, 1000, 10, 5, 200, 0, 90])]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size bigint")).collect()}
    want = water_fill(dict(rows))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert abs(sum(got.values()) - sum(n for _, n in rows)) < 1e-6


def test_splits_are_even(spark):
    plan = spark.createDataFrame([("a", b, 2, 3) for b in range(16)] + [("b", b, 0, 5) for b in range(8)], "source string, block bigint, passes bigint, part bigint")
    shards = Counter()
    for r in mixing.split(plan, 8).collect():
        assert len(r.shards) == (3 if r.source == "a" else 1)
        shards.update(r.shards)
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1


def test_drawn_rows(docs, nothing):
    got = mixing.draw(docs)
    assert got.columns == [*docs.columns, "mix_shard"]
    clash = docs.withColumnsRenamed({"h": "mix_shard", "id": "mix_size", "tag": "row", "label": "key"})
    assert mixing.draw(clash, shard=None).columns == clash.columns and mixing.draw(clash).where("mix_size <> 'x' or row <> 'y' or mix_shard < 0").count() == 0
    n = Counter(r.doc_id for r in got.collect())
    assert max(n[i] for i in range(60) if i != 4) <= 3
    assert mixing.draw(nothing).collect() == [] and mixing.mix(nothing).collect() == []


# --- licenses ------------------------------------------------------------------------------------


def test_templates_accept_mandatory_wording_only():
    label = lambda t: licences.scan(t)[2]
    assert [f[2] for f in label("This work is licensed under the GNU General Public License, version 3.")][0] == "gpl-notice"
    assert [f[2] for f in label("X licensed under terms of the GNU General Public License")] == []
    assert [f[:3] for f in label("Foo. Licensed under the Apache License, Version 2.0.")] == [(1, 9, "apache-notice")]
    assert label("licensed under the apache software license version 2.0") == []
    assert [f[2] for f in label("Released under the MIT License.")] == ["mit-notice"]
    assert label("released under a mit license") == [] and label(None) == [] and label("") == []


def test_base_places(docs, rows, spark):
    extra = [(1000, "GNU general PUBLIC license gnu-general.public,license cc by cc by"), (1001, "apache licenses"), (1002, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = sorted((tuple(r)[:6] for r in licences.scan_documents(df).collect()), key=str)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    want = []
    for i, t in [r[:2] for r in rows] + extra:
        w = pattern.findall((t or "").translate(low))
        found = [(k, lb) for p, lb in licences.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in found]
        want.append((i, len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({lb for _, lb in found}))))
    assert got == sorted(want, key=str)


def plain_ends(markup, words, at):
    """All ends of runs that a template accepts from a place, by trying every choice."""
    import functools

    parts = re.findall(licences.MARKUP, markup.lower())

    def closing(i):
        depth = 0
        for j in range(i, len(parts)):
            depth += (parts[j] == "[[") - (parts[j] == "]]")
            if not depth:
                return j

    @functools.cache
    def ends(i, k):
        if i == len(parts):
            return frozenset([k])
        if parts[i] == "[[":
            return ends(i + 1, k) | ends(closing(i) + 1, k)
        if parts[i] == "]]":
            return ends(i + 1, k)
        if parts[i][0] == "{":
            return frozenset().union(*[ends(i + 1, j) for j in range(k, min(k + int(parts[i][1:-1]), len(words)) + 1)])
        return ends(i + 1, k + 1) if k < len(words) and words[k] == parts[i].encode() else frozenset()

    return ends(0, at)


def plain_scan(text):
    """Labels by place, trying every template at every word."""
    words = (text or "").encode().translate(licences.compiled().table).split()
    found = {}
    for label, texts in licences.TEMPLATES.items():
        for markup in texts:
            for at in range(len(words)):
                if e := max(plain_ends(markup, words, at), default=0):
                    found[at, label] = max(found.get((at, label), 0), e)
    return sorted((at, e, label) for (at, label), e in found.items())


def template_texts(rng):
    """Texts that templates accept, with choices made by chance, and broken ones."""
    out = []
    for texts in licences.TEMPLATES.values():
        for markup in texts:
            for broken in (False, True):
                flat, depth, skip = [], 0, 0
                for part in re.findall(licences.MARKUP, markup):
                    if part == "[[":
                        depth += 1
                        skip = skip or depth * rng.randint(0, 1)
                    elif part == "]]":
                        skip = 0 if skip == depth else skip
                        depth -= 1
                    elif not skip:
                        flat += [rng.choice(["x", "the", "license"]) for _ in range(rng.randint(0, int(part[1:-1])))] if part[0] == "{" else [part]
                if broken:
                    flat.insert(rng.randrange(1, len(flat)), "unlike")
                out.append("Foo, " + rng.choice([" ", "\n", ". "]).join(w.upper() if rng.random() < 0.1 else w for w in flat) + " bar")
    return out


def test_templates_equal_every_choice():
    import random

    rng = random.Random(6)
    for t in template_texts(rng) + [" ".join(rng.choice("licensed under the terms of apache license version cc by nc 2 gnu general public copyright c all rights reserved".split()) for _ in range(60)) for _ in range(40)]:
        assert sorted(f[:3] for f in licences.scan(t)[2]) == plain_scan(t)
    full = [t for t in template_texts(random.Random(7))]
    assert sum(bool(plain_scan(t)) for t in full) >= len(full) // 2


def test_licence_query_equals_a_plain_version(spark):
    """Labels and score of the query, on texts of the tables and on license texts."""
    import random

    docs = [r for r in queries.documents(spark, "/root/testdata/sf0.001").collect()]
    got = {r.doc_id: r for r in queries.op6_license_scans(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    texts = {r.doc_id: r.text for r in docs if r.text is None or len(r.text) < 4000}
    for i, t in enumerate(template_texts(random.Random(8)), 10**6):
        texts[i] = t
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got |= {r.doc_id: r for r in licences.scan_documents(df.where("doc_id >= 1000000")).collect()}
    for i, t in texts.items():
        found, r = plain_scan(t), got[i]
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(base | {x for _, _, x in found}))
        assert (r.score > 0) == bool(found or base) and (r.score >= 0.5) == bool(base) or found


def test_scans_are_linear():
    """A text of 20 MB, full of what runs begin with, takes seconds."""
    import time

    began = time.time()
    n, base, found = licences.scan("cc by " * 1_500_000 + "word license " * 900_000)
    assert n == 4_800_000 and len(base) == 1_500_000 and found == [] and time.time() - began < 60


def test_no_licences_in_nothing(nothing):
    assert licences.scan_documents(nothing).collect() == []


# --- classifier ----------------------------------------------------------------------------------


def test_classifier_separates(spark):
    import random

    rng = random.Random(2)
    good = [" ".join(rng.choice(["river", "stone", "green", "walks", "under", "bright"]) for _ in range(60)) for _ in range(80)]
    bad = ["".join(rng.choice("#$%&*!? XQZ") for _ in range(300)) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(bad)] + [(900, None, 1), (901, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    m = compression.fit(df, df.where("doc_id % 3 <> 1").select("doc_id", "label"))
    got = compression.score(df, m).collect()
    held = [r for r in got if r.doc_id % 3 == 1 and r.text]
    assert sum(r.predicted == r.label for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_classifier_keeps_other_columns(spark, docs):
    m = compression.Model(b"good words " * 20, b"#$%&" * 50, np.array([0.1, 1.0, 0.5, -0.5]))
    clash = docs.select("doc_id", "text", "score", F.col("h").alias("row"))
    got = compression.score(clash, m)
    assert got.columns == ["doc_id", "text", "row", "score", "predicted"] and got.where("row <> 'h'").count() == 0
    sizes = compression.Sizes(m.good, m.bad)
    for r in got.collect():
        z = m.weights @ np.array([1, *sizes.features(r.text)])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12


def test_bounds_of_learning(spark):
    rows = [(i, "x" * (10 + i)) for i in range(50)] + [(100, "y" * 5000), (101, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    labels = df.select("doc_id", F.lit(1).alias("label"))
    good, bad = compression.chosen(df, labels, "text", "label", "doc_id", 20, 300, 1000)
    assert bad == [] and 0 < len(good) <= 20 and sum(map(len, good)) <= 300 and set(good) <= {t for _, t in rows}
    every, _ = compression.chosen(df, labels, "text", "label", "doc_id", 100, 10**6, 1000)
    assert sorted(set(every)) == sorted({t for i, t in rows if t and i != 100})


def test_quality_held_out(spark):
    """The query's own split: nothing that is held out is learned from, and is told apart well."""
    import zlib

    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_classifier(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == queries.documents(spark, sf).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in judged if y], [s for s, y in judged if not y]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    right = np.mean([(s >= 0.5) == y for s, y in judged])
    assert len(judged) > 100 and auc > 0.97 and right > 0.95


def test_classifier_without_examples(nothing, docs):
    m = compression.fit(nothing, nothing.select("doc_id", F.lit(1).alias("label")))
    assert all(r.score == 0.5 for r in compression.score(docs.select("doc_id", "text"), m).collect())
    assert compression.score(nothing.select("doc_id", "text"), m).collect() == []


# --- rules -----------------------------------------------------------------------------------------


def test_base_counts(docs, rows):
    got = sorted((tuple(r) for r in rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        rep = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)})
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert got == sorted(want, key=str)


def test_divergence(spark, nothing):
    clean = "the house of the man and the dog that is in the garden for it was as it is on the road by the sea and to be at the end this is from them or an are with "
    rows = [(i, clean * 3 + f"number {i}", "en") for i in range(20)] + [(90, "!!XQ ##ZZ %%KK " * 60 + str(list(range(80))), "en"), (91, None, "en"), (92, clean.upper().replace(" ", "|| ") * 2, "en")]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[92].class_distance > rules.MAX_CLASS and not got[92].kept
    assert got[91].base_failed and not got[91].kept and got[91].class_distance is None
    assert all(got[i].class_distance <= rules.MAX_CLASS for i in range(20))
    assert rules.judge(nothing).collect() == []


def jensen_shannon(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    kl = lambda x: sum(v * np.log2(v / k) for v, k in zip(x, m) if v)
    return np.sqrt(max(0.0, kl(p) + kl(q)) / 2)


def test_distance_formula(spark):
    a, b = [3, 0, 5], [1, 4, 5]
    got = spark.range(1).select(rules.class_distance(F.array(*[F.lit(x).cast("bigint") for x in a]), F.lit(8), F.array(*[F.lit(x / 10) for x in b])).alias("d")).first().d
    assert abs(got - jensen_shannon(a, b)) < 1e-12


def plain_repeats(w):
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)})


def plain_verdicts(rows):
    """(class distance, word distance, kept) of each (text, lang), by counters."""
    import unicodedata

    def classes(t):
        n = [0] * 8
        for c in t:
            k = unicodedata.category(c)
            n[0 if k == "Ll" else 1 if k == "Lu" else 2 if k in ("Lo", "Lt", "Lm") or k[0] == "M" else 3 if k == "Nd" else 4 if c in " \t\n\x0b\f\r" else 5 if c in "#*$%&|<>" else 6 if c in ".,;:!?'\"()-" else 7] += 1
        return n

    runs = lambda t: "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower()).split(" ")
    words = [[w for w in runs(t or "") if w] for t, _ in rows]
    base = [len(WORD.findall(t or "")) for t, _ in rows]
    failed = [n < 50 or 100 * plain_repeats(WORD.findall(t or "")) > 50 * n for n, (t, _) in zip(base, rows)]
    said = defaultdict(Counter)
    for w, (_, lg) in zip(words, rows):
        if lg is not None:
            said[lg].update(x for x in w if len(x) <= 8)
    learned = sorted({x for c in said.values() for x in sorted(c, key=lambda x: (-c[x], x))[:24]})
    cells = lambda w: [w.count(x) for x in learned] + [sum(x not in learned for x in w)]
    refs = {}
    good = {lg for f, (_, lg) in zip(failed, rows) if not f}
    for w, f, (t, lg) in zip(words, failed, rows):
        if lg is not None and (not f or lg not in good):
            a, b = refs.setdefault(lg, (np.zeros(8), np.zeros(len(learned) + 1)))
            a += classes(t or "")
            b += cells(w)
    out = []
    for w, f, (t, _) in zip(words, failed, rows):
        best = None
        for lg in sorted(lg for lg in refs if refs[lg][1].sum()):
            x = jensen_shannon(classes(t or ""), refs[lg][0]) if len(t or "") >= 200 else None
            y = jensen_shannon(cells(w), refs[lg][1]) if len(w) >= 50 else None
            worse = max((x or 0) / rules.MAX_CLASS, (y or 0) / (rules.MAX_COMMON + rules.NOISE / np.sqrt(len(w)))) if w else (x or 0) / rules.MAX_CLASS
            if best is None or worse < best[0]:
                best = (worse, x, y)
        out.append((*(best[1:] if best else (None, None)), not f and (best is None or best[0] <= 1)))
    return out


def test_verdicts_equal_a_plain_version(spark):
    """The query's distances and verdicts, on its own table, and on salad, scripts and odd texts."""
    import random

    sf, rng = "/root/testdata/sf0.001", random.Random(3)
    docs = [(r.doc_id, r.text, r.lang) for r in queries.documents(spark, sf).collect()]
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf).collect()}

    def same(rows, got):
        for (i, *_), (x, y, kept) in zip(rows, plain_verdicts([r[1:] for r in rows])):
            r = got[i]
            assert (r.class_distance is None) == (x is None) and (r.common_distance is None) == (y is None), i
            assert (x is None or abs(r.class_distance - x) < 1e-6) and (y is None or abs(r.common_distance - y) < 1e-6), i
            assert r.kept == kept, i

    same(docs, got)
    salad = " ".join("".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 11))) for _ in range(6000))
    more = docs + [(10**6, salad, "en"), (10**6 + 1, "Привет мир и все люди на земле " * 30, "ru"), (10**6 + 2, None, None), (10**6 + 3, "", "xx")]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(more, "doc_id bigint, text string, lang string")).collect()}
    same(more, got)
    assert not got[10**6].base_failed and not got[10**6].kept  # long, but without common words


def test_repeats_in_long_texts(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (5, 500, 16386, 20000)] + [" ".join(f"w{i}" for i in range(17000)), "a a a a", "x y x y x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", rules.counts(F.col("t"))["n_repeat_words"].alias("n")).collect()}
    assert all(got[i] == plain_repeats(t.split()) for i, t in enumerate(texts))


# --- pieces ------------------------------------------------------------------------------------------

ODD = ["", " ", "  a", "a  ", "\n a\n\n b", "▁x ▁ y", "日本語 テキスト 🎉é", "\x00\x01 <s> </s> <0x41>", "a" * 300, " " * 50 + "b", "é", "\t tab", "▁", "▁▁", " ▁", "\n", "a\r\nb"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


def test_pieces_equal_the_library(docs, rows, library, spark, nothing):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 500)), "doc_id bigint, text string"))
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in pieces.encode_documents(df, queries.piece_model_path()).collect())
    want = []
    for t in [r[1] or "" for r in rows] + ODD:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), tuple(ids)))
    assert got == sorted(want)
    assert pieces.encode_documents(nothing, queries.piece_model_path()).collect() == []


def test_spans_lie_on_the_source(library):
    m = pieces.load(queries.piece_model_path())
    for t in [*ODD, "Plain words, twice plain words.\nÉté 12"]:
        e, _ = m.encode(t)
        raw = t.encode()
        assert e.end[-1] == len(raw) and (e.begin <= e.end).all() and (e.begin[2:] >= e.begin[1:-1]).all()
        got = b"".join(raw[b:x] for b, x in zip(e.begin[1:-1], e.end[1:-1]))
        assert got == raw
        for i, b, x in zip(e.ids[1:-1], e.begin[1:-1], e.end[1:-1]):
            s = m.surface[i].replace(pieces.MARK_BYTES, b" ")
            assert raw[b:x].replace(pieces.MARK_BYTES, b" ") in (s, s[1:])


def _trie(pairs):
    """A double array of byte keys to offsets, by first fit."""
    keys = sorted(pairs)
    units, used = [0] * 4096, {0}

    def build(node, prefix):
        nexts = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in pairs
        labels = ([0] if leaf else []) + nexts
        base = next(b for b in range(1, 3000) if all((node ^ b ^ x) not in used for x in labels) and (not leaf or (node ^ b) not in used))
        for x in labels:
            used.add(node ^ base ^ x)
        units[node] |= base << 10 | (leaf << 8)
        if leaf:
            units[node ^ base] = pairs[prefix] | 1 << 31
        for x in nexts:
            units[node ^ base ^ x] |= x
            build(node ^ base ^ x, prefix + bytes([x]))

    build(0, b"")
    return np.array(units, "<u4").tobytes()


def test_longest_prefix_rewriting():
    pairs = {"ﬁ".encode(): 0, "ab".encode(): 3, "abc".encode(): 5}
    trie = _trie(pairs)
    m = pieces.CharsMap(len(trie).to_bytes(4, "little") + trie + b"fi\0X\0Y\0")
    assert m.longest("ﬁn".encode(), 0) == (3, b"fi")
    assert m.longest(b"abcd", 0) == (3, b"Y") and m.longest(b"abd", 0) == (2, b"X") and m.longest(b"xab", 1) == (2, b"X")
    assert m.longest(b"zz", 0) is None and pieces.CharsMap(b"").longest(b"a", 0) is None


def test_alignment_of_rewritten_text():
    m = pieces.load(queries.piece_model_path())
    import copy

    x = copy.copy(m)
    trie = _trie({"ﬁ".encode(): 0})
    x.chars, x.squeeze = pieces.CharsMap(len(trie).to_bytes(4, "little") + trie + b"fi\0"), True
    norm, align = x.normalise("  ﬁ  b ".encode())
    assert norm == "▁fi▁b".encode()
    assert align.tolist() == [2, 2, 2, 2, 2, 5, 5, 5, 7, 8]


# --- fingerprints --------------------------------------------------------------------------------------


def test_neighbours(docs, rows, nothing):
    got = fingerprints.fingerprint_neighbours(docs).collect()
    assert len(got) == len(rows)
    key = lambda r: ((1 << 63) - 1 if r[0] is None else r[0], 0)
    order = sorted(rows, key=key)
    unique = [r for r in order if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    by = {r.doc_id: r for r in got}
    for r in unique:
        i = order.index(r)
        following = order[(i + 1) % len(order)]
        if sum(x[0] == following[0] for x in rows) > 1:
            continue
        t, nxt = r[1] or "", following[1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        assert by[r[0]].n_chars == len(t)
        assert by[r[0]].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert by[60].fingerprint == by[61].fingerprint == by[5].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    plain = [r for r in got if r.n_chars > 300 and r.doc_id is not None and r.doc_id < 59]
    assert sum(r.near_edited > r.near_next for r in plain) >= 0.9 * len(plain)
    assert fingerprints.fingerprint_neighbours(nothing).collect() == []


def test_entropy_of_each_window():
    rng = np.random.default_rng(1)
    buf = np.concatenate([rng.integers(97, 110, 400), np.full(100, 65), rng.integers(0, 256, 200)]).astype(np.uint8)
    e = fingerprints.entropies(buf)
    for i in range(len(buf) - 63):
        n = np.bincount(buf[i : i + 64])
        p = n[n > 0] / 64
        assert abs(e[i] - 1000 * -(p * np.log2(p)).sum() / 6) <= 1.01


def test_digests_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    ranks = rng.permutation(1001).astype(np.int32)
    texts = [bytes(rng.integers(97, 115, n).astype(np.uint8)) for n in (0, 5, 63, 64, 127, 128, 200, 1000, 30000)]
    together = [str(d) for d in fingerprints.digest_texts(texts, ranks)]
    alone = [str(fingerprints.digest_texts([t], ranks)[0]) for t in texts]
    assert together == alone and together[0] == ""
    d = fingerprints.parse(together[-1])
    assert fingerprints.likeness(d, d) == 1.0 and d.size > 160 and len(d.filters) == -(-d.size // 160)
    assert fingerprints.likeness(fingerprints.parse(""), fingerprints.parse("")) == 1.0
    assert fingerprints.likeness(fingerprints.parse(""), d) == 0.0
    assert base64.b64decode(together[-1].partition(":")[2])


def test_pieces_of_long_and_odd_texts(library):
    """Texts that are encoded in parts, at every place where they can be cut."""
    import random

    rng = random.Random(9)
    bits = ["word", "  ", " ", "\n", "▁", " ▁", "é日本", "🎉", "x" * 40, "1234", "\t", "the cat"]
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in (30_000, 90_000, 250_000)] + ["a" * 700_000, " " * 600_000, "b " * 400_000, "▁" * 200_000 + " c"]
    m = pieces.PieceModel(queries.piece_model_path())
    for t in texts:
        e, d = m.encode(t)
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert e.ids.tolist() == ids and d == library.decode(ids)
        raw = t.encode()
        assert (e.begin[2:-1] == e.end[1:-2]).all() and e.begin[1] == 0 and e.end[-2] == len(raw)


def test_pieces_through_a_character_map(spark, tmp_path):
    """A model whose map rewrites characters: ids and decoded texts are the library's, spans are of the source."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(queries.piece_model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    trie = _trie({"ﬁ".encode(): 0, "Å".encode(): 3, "Å".encode(): 3, "　".encode(): 6})
    blob = len(trie).to_bytes(4, "little") + trie + "fi\0å\0 \0".encode()
    proto.normalizer_spec.precompiled_charsmap = blob
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["ﬁne ﬁles of Ångström", "  two　 spaces  ", "Å", "", "plain text", "Å　　ﬁ", "日本 ▁ x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    m = pieces.PieceModel(str(path))
    for r in pieces.encode_documents(df, str(path)).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == library.decode(ids)
        raw = texts[r.doc_id].encode()
        got = [raw[a:b].decode() for a, b in zip(r.begins[1:-1], r.ends[1:-1])]
        assert "".join(got).strip(" 　") == texts[r.doc_id].strip(" 　")
        assert m.normalise(raw)[0].decode().replace("▁", " ")[1:] == r.decoded


def plain_digest(text, ranks):
    """The fingerprint of a text, feature by feature."""
    if not text:
        return ""
    if len(text) < 128:
        w = min(6, len(text))
        at = [(i, i + w) for i in range(len(text) - w + 1)]
    else:
        e = fingerprints.entropies(np.frombuffer(text, np.uint8))
        key = [int(ranks[x]) for x in e]
        points, runs = Counter(), max(1, len(key) - 63)
        for r in range(runs):
            points[min(range(r, min(r + 64, len(key))), key=lambda i: (key[i], i))] += 1
        need = min(max(max(len(key) - 63, 0) // 64, 1), 16)
        at = [(i, i + 64) for i in sorted(points) if points[i] >= need and key[i] < fingerprints.NEVER]
        at = at or [(i, i + 64) for i in [max(range(len(key)), key=lambda i: (points[i], -i))]]
    seen = {}
    for a, b in at:
        part = np.frombuffer(text[a:b], np.uint8)
        h = int(fingerprints.span_hash(fingerprints.prefix_hash(part), np.array([0]), np.array([len(part)]))[0])
        seen.setdefault(h, len(seen))
    filters = np.zeros((-(-len(seen) // 160), 2048), np.uint8)
    for h, k in seen.items():
        for i in range(5):
            filters[k // 160, h >> 11 * i & 2047] = 1
    return f"{len(seen)}:{base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()}"


def plain_likeness(x, y):
    if not x or not y:
        return float(x == y)
    (nx, fx), (ny, fy) = ((int(s.split(":")[0]), np.unpackbits(np.frombuffer(base64.b64decode(s.split(":")[1]), np.uint8)).reshape(-1, 2048)) for s in (x, y))
    if (len(fy), ny, np.packbits(fy).tobytes()) < (len(fx), nx, np.packbits(fx).tobytes()):
        (nx, fx), (ny, fy) = (ny, fy), (nx, fx)
    count = lambda n, k, f: 160 if k < len(f) - 1 else n - 160 * (len(f) - 1)
    q, top, weight, rows = (1 - 1 / 2048) ** 5, 0, 0, [count(nx, k, fx) for k in range(len(fx))]
    for a, n in zip(fx, rows):
        if n < min(16, max(rows)):
            continue
        best = 0.0
        for k, b in enumerate(fy):
            m = count(ny, k, fy)
            most, chance = float(min(a.sum(), b.sum())), 2048 * (1 - q**n - q**m + q ** (n + m))
            cut = min(chance + 0.3 * max(most - chance, 0), most - 1)
            best = max(best, min(max((int((a & b).sum()) - cut) / max(most - cut, 1), 0), 1))
        top, weight = top + best * n, weight + n
    return top / weight


def test_fingerprints_equal_a_plain_version(spark):
    """The query's digests and likenesses, feature by feature and filter by filter."""
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    ranks = fingerprints.fit_ranks(docs)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(text)
    following = dict(zip(order, order[1:] + order[:1]))
    got = queries.op10_fingerprints(spark, sf).collect()
    assert len(got) == len(text)
    made = {i: plain_digest(t.encode(), ranks) for i, t in text.items()}
    for r in got:
        new = fingerprints.edited(text[r.doc_id], text[following[r.doc_id]]).encode()
        assert r.fingerprint == made[r.doc_id] and r.edited_fingerprint == plain_digest(new, ranks)
        assert abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - plain_likeness(r.fingerprint, made[following[r.doc_id]])) < 1e-9


def test_long_texts_have_the_same_features(monkeypatch):
    rng = np.random.default_rng(4)
    ranks = rng.permutation(1001).astype(np.int32)
    texts = [bytes(rng.integers(97, 115, n).astype(np.uint8)) for n in (5000, 30000)] + [b"ab" * 9000, b"z" * 20000]
    whole = [str(fingerprints.digest_texts([t], ranks)[0]) for t in texts]
    for part in (1000, 2049):
        monkeypatch.setattr(fingerprints, "PART", part)
        assert [str(fingerprints.digest_texts([t], ranks)[0]) for t in texts] == whole
    monkeypatch.setattr(fingerprints, "PAIRS", 1)
    d = [fingerprints.parse(x) for x in whole]
    assert abs(fingerprints.likeness(d[0], d[1]) - plain_likeness(whole[0], whole[1])) < 1e-9


def test_neighbours_of_one_key(spark):
    """Many rows of one key lie in many ranges, and each row has its neighbour."""
    rows = [(7 if i % 3 else None, f"text number {i} " * 9) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    h = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, h[r[1]]))
    want = Counter(hashlib.sha256(fingerprints.edited(a[1], b[1]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))
    assert Counter(r.edited_sha256 for r in fingerprints.fingerprint_neighbours(df).collect()) == want
