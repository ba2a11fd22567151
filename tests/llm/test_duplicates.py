"""Substring dedup, suffix dedup and the set join against plain versions of themselves."""

import hashlib
import random
import time
from pathlib import Path
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import dealing, passages, setjoin, suffixes
from lectern.llm.dealing import components, even_keys, hash_int

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
LAST = (1 << 63) - 1


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected_components(rows):
    s = [shingles(r[1]) for r in rows]
    key = [LAST if r[0] is None else r[0] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(s[i] & s[j])
            if s[i] and 100 * c >= 75 * (len(s[i]) + len(s[j]) - c):
                root[find(i)] = find(j)
    least = defaultdict(lambda: LAST)
    for i in range(len(rows)):
        least[find(i)] = min(least[find(i)], key[i])
    none = lambda k: None if k == LAST else k
    return sorted(((none(key[i]), len(s[i]), none(least[find(i)])) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("region", [400, 3])
def test_set_join_equals_all_pairs(docs, rows, region):
    got = [tuple(r) for r in setjoin.near_duplicates(docs, region=region).collect()]
    assert sorted(got, key=str) == expected_components(rows)


def test_set_join_of_chains(spark):
    """A chain of near copies whose ends are unlike is one component, also across pieces of a region."""
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(40):
        texts.append(" ".join(base))
        base = base[:]
        base[(k * 7) % 120] = f"n{k}"
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for region in (400, 5):
        got = sorted((tuple(r) for r in setjoin.near_duplicates(df, region=region).collect()), key=str)
        assert got == expected_components(rows)


def test_set_join_of_nothing(nothing):
    assert setjoin.near_duplicates(nothing).collect() == []


def test_region_join_is_exact():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.choice(5000, 80, replace=False)
        for _ in range(6):
            x = base.copy()
            k = rng.integers(0, 30)
            x[rng.choice(80, k, replace=False)] = rng.integers(5000, 10**6, k)
            sets.append(np.unique(x).astype(np.uint64))
    r = setjoin.Region(sets)
    r.join()
    got = {tuple(sorted(j for j in range(len(sets)) if r._find(j) == r._find(i))) for i in range(len(sets))}
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if setjoin.linked(c, len(sets[i]), len(sets[j])):
                root[find(i)] = find(j)
    assert got == {tuple(sorted(j for j in range(len(sets)) if find(j) == find(i))) for i in range(len(sets))}


def test_components(spark):
    links = [(1, 2), (3, 2), (5, 4), (6, 5), (7, 6), (7, 7), (9, 8), (10, 9), (11, 10), (8, 11)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "low int, high int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 8, 10: 8, 11: 8}


def test_even_keys(spark):
    from pyspark.sql import functions as F

    keys = even_keys(7)
    df = spark.createDataFrame([(int(k),) for k in keys], "k int").select("k", F.hash("k").alias("h"), F.pmod(F.hash("k"), F.lit(7)).alias("p"))
    got = df.collect()
    assert [r.p for r in got] == list(range(7))
    assert [r.h for r in got] == hash_int(keys).tolist()


def removed(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) > 0).sum())
        out.append((len(r), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 40])
def test_repeats_equal_all_strings(docs, rows, length):
    got = sorted((tuple(r) for r in suffixes.remove_repeats(docs, length=length).collect()), key=str)
    want = sorted(((r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], length))), key=str)
    assert got == want


def test_repeats_at_the_edges(spark):
    s = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(500))
    texts = [s[:200], s[:199], s[1:202], s[150:480] + "X", "Y" + s[150:480], s[300:499] + s[0:199]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [tuple(r)[1:] for r in suffixes.remove_repeats(df).orderBy("doc_id").collect()]
    assert got == removed(texts)


def test_repeats_of_nothing(nothing):
    assert suffixes.remove_repeats(nothing).collect() == []


def test_queue_spills_and_merges():
    rng = np.random.default_rng(1)
    dtype = np.dtype([("name", "<u4"), ("at", "<u4")])
    x = np.empty(5000, dtype)
    x["name"], x["at"] = rng.integers(0, 60, 5000), rng.permutation(5000)
    q = suffixes.TupleQueue(dtype, held=700)
    for i in range(0, 5000, 130):
        q.push(x[i : i + 130])
    seen, names = [], set()
    for g in q.groups():
        assert not names & set(g["name"].tolist())
        names |= set(g["name"].tolist())
        seen += g.tolist()
    assert seen == sorted(x.tolist())


def test_passages_found(docs, rows):
    """Every window of 50 words that an earlier document has is in a passage, and passages are alike."""
    got = defaultdict(set)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(WORD.findall((r[1] or "").translate(LOWER)))
    for r in passages.passages(docs).collect():
        got[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
        assert r.last_word - r.first_word + 1 >= 40
        assert r.similarity >= 0.6
        a, b = by_id[r.partner_id][0], by_id[r.doc_id][0]
        x = {tuple(a[i : i + 5]) for i in range(r.partner_first_word, r.partner_last_word - 3)}
        y = {tuple(b[i : i + 5]) for i in range(r.first_word, r.last_word - 3)}
        assert abs(len(x & y) / len(x | y) - r.similarity) < 1e-9
    first = {}
    order = sorted({(LAST if r[0] is None else r[0], r[1] or "") for r in rows})
    for k, t in order:
        w = WORD.findall(t.translate(LOWER))
        own = {}
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            if x in first and first[x] != (k, t):
                assert set(range(i, i + 50)) <= got[None if k == LAST else k], k
            own.setdefault(x, (k, t))
        for x, v in own.items():
            first.setdefault(x, v)
    assert not got[0] and not got[68 + 3]


def verbatim_missing(spark, texts):
    """Windows of 50 words that an earlier document has and no passage covers."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = defaultdict(set)
    for r in passages.passages(df).collect():
        got[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    seen, missing = set(), []
    for k, t in enumerate(texts):
        w = t.split()
        own = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        missing += [(k, i) for i, x in enumerate(own) if x in seen and not set(range(i, i + 50)) <= got[k]]
        seen |= set(own)
    return missing


def test_passages_of_frequent_lines(spark):
    """A copy of lines that many documents have in other order has its source among many documents with the same minima."""
    rng = random.Random(11)
    pool = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(25)]
    lines = [rng.sample(pool, 8) for _ in range(150)]
    for k in range(0, 150, 3):
        other = rng.sample([x for x in pool if x not in lines[k]], 3)
        lines.append(other[:2] + lines[k][1:6] + other[2:])
    assert verbatim_missing(spark, ["\n".join(x) for x in lines]) == []


def test_passages_with_a_word_changed(spark):
    """Passages of 50 words with one inner word changed (similarity 41 / 51) are found, each of them."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(600):
        p = some(50)
        texts.append(" ".join(some(20) + p + some(20)))
        p[rng.randint(5, 44)] = "changed"
        texts.append(" ".join(some(20) + p + some(20)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in passages.passages(df).collect()} == set(range(1, 1200, 2))


@pytest.mark.parametrize("apart", [20, 30, 40])
def test_verified_where_a_line_recurs(apart):
    """A line that recurs in the earlier text is matched where the alignment has it."""
    rng = np.random.default_rng(apart)
    w = rng.integers(0, 1 << 60, 2000).astype(np.uint64)
    for i in range(0, 1990, apart):
        w[i : i + 8] = np.arange(8)
    v = w.copy()
    v[np.arange(115, 1990, 120)] = np.arange(17, 17 + len(range(115, 1990, 120)))
    for later in (w, v):
        covered = set()
        for b0, b1, a0, a1, j in passages.verify(passages.shingle_hashes(later, 5), passages.shingle_hashes(w, 5), 46):
            assert j >= 0.75 and (a0, a1) == (b0, b1)
            covered |= set(range(b0, b1 + 5))
        assert len(covered) > 1990


def test_compact_windows_are_all_windows():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 40, 300).astype(np.uint64)
    start = np.array([0, 120, 121, 300])
    least = 6
    for fn, d, at, before, after, v in passages.compact_windows(s, start, least):
        h = passages.mix(s ^ np.uint64(0x9E3779B97F4A7C15 * (fn + 1) & (1 << 64) - 1))
        got = set(zip(d.tolist(), at.tolist(), before.tolist(), after.tolist()))
        want = set()
        for doc in range(3):
            x = h[start[doc] : start[doc + 1]]
            for c in range(len(x)):
                lo = c
                while lo > 0 and x[lo - 1] > x[c]:
                    lo -= 1
                hi = c
                while hi + 1 < len(x) and x[hi + 1] >= x[c]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.add((doc, c, c - lo, hi - c))
        assert got == want


def test_passages_that_many_have_are_sought_once(spark):
    """Of the candidates of a document, one passage for what many earlier documents have; what only the last has stays."""
    rng = random.Random(11)
    w = [f"w{rng.randrange(4000)}" for _ in range(600)]
    texts = [[*w[200 + k * 10 : 230 + k * 10], *w[:90]] for k in range(6)]
    texts[5] += w[400:480]
    texts.append([*w[:90], *w[500:540], *w[400:480]])
    docs = passages.keyed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "text", "doc_id")
    tag = {r.id: r.tag for r in docs.collect()}
    found = spark.createDataFrame([(6, tag[6], a, tag[a], 0, len(texts[a]) - 5, 0, len(texts[6]) - 5) for a in range(6)], passages.CANDIDATE)
    every = {(r.a, r.b0, r.b1) for r in passages.verified(docs, found, 46).collect()}
    assert every == {(a, 0, 89) for a in range(6)} | {(5, 130, 209)}
    assert {(r.a, r.b0, r.b1) for r in passages.verified(docs, found, 46, once=True).collect()} == {(0, 0, 89), (5, 0, 89), (5, 130, 209)}


def test_windows_of_repeated_shingles_are_looked_at():
    """``promising`` leaves out no window that ``similar_runs`` finds."""
    rng = random.Random(12)
    met = []
    for k in range(300):
        stock = rng.choice((1, 3, 40, 400))
        a = [rng.randrange(stock) for _ in range(rng.randint(1, 150))]
        b = [rng.randrange(stock) if rng.random() < rng.choice((0, 0.2)) else x for x in a * 2][rng.randint(0, 30) :][:150]
        met.append(([k], np.array(b, np.uint32).tobytes(), np.array(a, np.uint32).tobytes()))
    want = {k: x for (k,), b, a in met if (x := passages.similar_runs(np.frombuffer(b, np.uint32), np.frombuffer(a, np.uint32), 46))}
    got = {}
    for (k,), sb, sa, windows, *_ in passages.promising(met, 46):
        at = int(windows[0])
        if x := passages.similar_runs(sb[at : windows[-1] + 46], sa, 46):
            got[k] = [(b0 + at, b1 + at, a0, a1, j, w0 + at, w1 + at) for b0, b1, a0, a1, j, w0, w1 in x]
    assert got == want and len(want) > 50


def test_what_was_shuffled_for_a_step_goes(spark):
    """What a step shuffled doesn't stay on disk when its checkpoint is there."""
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before = held()
    step = spark.range(20000).repartition(3, "id").selectExpr("id + 1 as id").checkpoint()
    own = held() - before
    assert own
    assert dealing.freed(step).count() == 20000
    end = time.time() + 20
    while own & held() and time.time() < end:
        time.sleep(0.2)
    assert not own & held()


def test_a_settled_step_leaves_no_shuffled_files(spark):
    """They go with the step, not when the driver happens to collect its garbage; the checkpoint's own when it is dropped."""
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    kept = spark.range(5000).repartition(3, "id").checkpoint()
    before = held()
    tap = spark.range(20000).repartition(3, "id").groupBy((F.col("id") % 1000).alias("k")).count()
    step = dealing.settled(tap)
    assert not held() - before and step.count() == 1000
    made = [r.getCheckpointFile().get() for r, _ in dealing._lineage(step) if r.isCheckpointed()]
    there = lambda: [p for p in made if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert there()
    dealing.dropped(step)
    assert made and not there() and kept.count() == 5000 and tap.count() == 1000  # it can still be made again


def test_rest_is_compared_in_waves(spark, monkeypatch):
    """What is sought in all earlier documents meets in shares and is dealt out wave by wave, and gives the same passages
    as all at once."""
    rng = random.Random(16)
    stock = [[f"w{rng.randrange(10**5)}" for _ in range(18)] for _ in range(30)]
    texts = [[w for line in rng.sample(stock, 6) for w in line] for _ in range(60)]
    for v in texts[:60]:
        u = v[:]
        for at in (31, 77):
            u[at] = f"x{rng.randrange(10**5)}"
        texts.append(u)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    verified, seen = passages.verified, []

    def counted(docs, found, least, once=False):
        if once:
            seen.append({r.id for r in found.select("id").distinct().collect()})
        return verified(docs, found, least, once)

    monkeypatch.setattr(passages, "verified", counted)
    whole, all_ = sorted(passages.passages(df).collect()), seen[:]
    seen.clear()
    monkeypatch.setattr(passages, "MARKED", 1000)
    monkeypatch.setattr(passages, "FEW_PAIRS", 1000)
    monkeypatch.setattr(passages, "PAIR_BYTES", 1 << 60)
    assert sorted(passages.passages(df).collect()) == whole and len(whole) > 50
    assert len(all_) == 1 and len(seen) > 3 and set().union(*seen) == all_[0] and sum(map(len, seen)) == len(all_[0])
    assert max(map(len, seen)) < len(all_[0]) / 2


def test_passages_are_cut(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"first  words\there {p} and after", 1), (2, f"Other start {p}\nother end", 2), (3, p, 3), (4, None, 4), (5, "clean text", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = {r.doc_id: r.text for r in passages.remove_passages(df).collect()}
    assert got == {1: rows[0][1], 2: "Other start other end", 4: None, 5: "clean text"}


def test_passages_are_found_before_rows_are_dealt_out(spark):
    """Rows and spans are all that is shuffled for the result; what the passages took is off the disk by then."""
    p = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"text {i} {p} end {i}") for i in range(9)], "doc_id bigint, text string")
    cut = passages.remove_passages(df)
    plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"\bExchange\b", plan)) <= 2
    assert {r.doc_id: r.text for r in cut.collect()} == {i: f"text {i} {p} end {i}" if not i else f"text {i} {i}" for i in range(9)}


def test_no_passages_of_nothing(nothing):
    assert passages.passages(nothing).collect() == []
    assert passages.remove_passages(nothing).collect() == []


def test_links_across_pieces_are_few(spark):
    """Thousands of sets just around the threshold in one region: all components, and links that are
    bounded by the number of sets, not of similar pairs."""
    base = [f"w{i}" for i in range(40)]
    rows = []
    for k in range(2000):
        w = base[:]
        w[k % 40] = f"n{k}"
        if k % 3 == 0:
            w[(k * 7 + 1) % 40] = f"m{k}"
        rows.append((k, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in setjoin.near_duplicates(df, region=100).collect()), key=str)
    hashed = [np.unique(np.array([hash(x) & (1 << 48) - 1 for x in s], np.uint64)) for s in sets]
    whole = setjoin.Region(hashed)
    for i in range(len(rows)):
        common = np.array([len(x) for x in map(sets[i].intersection, sets[:i])])
        for j in np.flatnonzero([100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c) for j, c in enumerate(common)]):
            whole.link(i, int(j))
    least = {}
    for i in range(len(rows)):
        least.setdefault(whole._find(i), i)
    assert got == sorted(((i, len(sets[i]), least[whole._find(i)]) for i in range(len(rows))), key=str)
    members = spark.createDataFrame([(1, k % 20, 20, k, k + 1, setjoin.pack(h)) for k, h in enumerate(hashed)], "pivot bigint, piece int, pieces int, id bigint, node bigint, data binary")
    centre = members.where("node = 1").selectExpr("pivot", "explode(sequence(0, 19)) piece", "pieces", "id", "node", "data")
    found = setjoin.join_pieces(members.where("node <> 1").unionByName(centre)).cache()
    within, across = found.where("a is not null").count(), setjoin.join_across(found.where("pivot is not null").drop("a", "b")).count()
    assert within < len(rows) and across < 4 * len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_hot_strings(spark, seed):
    """Boilerplate of just over the length in most texts, in the same and in other surroundings, over many tasks."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    hot, lines = some(45), [some(60) for _ in range(4)]
    texts = []
    for i in range(240):
        t = some(rng.randint(0, 90)) + (hot if i % 3 else "") + some(rng.randint(0, 90))
        if i % 5 == 0:
            t += rng.choice(lines) + hot + rng.choice(lines)
        texts.append(t if i % 17 else texts[rng.randrange(i)] if i else t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(9)
    got = [tuple(r)[1:] for r in sorted(suffixes.remove_repeats(df, length=40).collect())]
    assert got == removed(texts, 40)


def test_long_texts_have_the_same_samples(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(suffixes, "PART", 3000)
    for buf in (rng.integers(97, 110, 20_000), np.tile(rng.integers(97, 110, 170), 100), np.full(15_000, 97), rng.integers(97, 110, 3_810)):
        c = suffixes.Chunk(0, buf.astype(np.uint8), np.array([0, len(buf)]))
        _, at, lo, hi, _ = suffixes.samples(c, 200, 100)
        got = []
        for part, base in suffixes.text_parts(c, 200, 100):
            assert len(part.buf) < 3000 + 1000
            _, a, b, e, _ = suffixes.samples(part, 200, 100)
            got += list(zip((a + base).tolist(), (b + base).tolist(), (e + base).tolist()))
        assert got == list(zip(at.tolist(), lo.tolist(), hi.tolist()))


def test_words_of_long_texts_are_hashed_alike(monkeypatch):
    from lectern.llm import kernels

    rng = random.Random(2)
    text = " ".join("w" * rng.randint(1, 30) for _ in range(5000)) + " " + "x" * 4000
    buf = np.frombuffer(text.encode(), np.uint8)
    c = kernels.Chunk(0, buf, np.array([0, 9000, len(buf)]))
    whole = kernels.word_hashes(c)
    monkeypatch.setattr(kernels, "PART", 1000)
    again = kernels.word_hashes(c)
    assert all((a == b).all() for a, b in zip(whole, again))


def passage_recall(spark, texts, wanted):
    """The share of wanted (document, words) of which most words are in a passage."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = defaultdict(set)
    for r in passages.passages(df).collect():
        got[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    return np.mean([len(w & got[k]) >= 0.75 * len(w) for k, w in wanted])


def embedded(rng, some, variants):
    """Texts that each hold one of the variants between words of their own, and where it begins."""
    texts, begins = [], []
    for v in variants:
        before = some(rng.randint(10, 60))
        texts.append(" ".join(before + v + some(rng.randint(10, 60))))
        begins.append(len(before))
    return texts, begins


def alike_words(v, earlier, least=46):
    """Words of v in windows of 50 that are 0.75 alike to the same words of an earlier variant (edits replace words)."""
    held = set()
    for u in earlier:
        same = np.array([v[i : i + 5] == u[i : i + 5] for i in range(len(v) - 4)], int)
        common = np.convolve(same, np.ones(least, int), "valid")
        for o in np.flatnonzero(100 * common >= 75 * (2 * least - common)):
            held |= set(range(o, o + 50))
    return held


@pytest.mark.parametrize("size,edits,vocabulary", [(60, 1, 5000), (60, 2, 5000), (120, 4, 5000), (300, 15, 5000), (80, 2, 40)])
def test_recall_in_groups(spark, size, edits, vocabulary):
    """Groups of variants of one boilerplate, each with words of its own; a vocabulary of 40 words repeats itself.
    What a variant should have found is what brute force finds alike in the group's earlier ones."""
    rng = random.Random(size + edits)
    words = [f"w{i}" for i in range(vocabulary)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    variants, due = [], []
    for _ in range(20):
        base, group = some(size), []
        for j in range(15):
            v = base[:]
            for at in rng.sample(range(size), edits if j else 0):
                v[at] = f"x{rng.randrange(10**6)}"
            due.append(alike_words(v, group))
            group.append(v)
        variants += group
    texts, begins = embedded(rng, some, variants)
    wanted = [(k, {a + i for i in d}) for k, (a, d) in enumerate(zip(begins, due)) if d]
    recall = passage_recall(spark, texts, wanted)
    print("recall", size, edits, vocabulary, len(wanted), recall)
    assert len(wanted) > 100 and recall >= 0.9


def test_recall_with_a_frequent_phrase(spark):
    """Every document has one phrase every twenty words; pairs share a verbatim or an edited passage."""
    rng = random.Random(12)
    some = lambda n: [w for i in range(n) for w in ("all of this is here again".split() if i % 20 == 7 else []) + [f"w{rng.randrange(10**5)}"]]
    variants = []
    for _ in range(100):
        v = some(60)
        u = v[:]
        u[rng.randrange(len(u))] = "changed"
        variants += [v, u]
    texts, begins = embedded(rng, some, variants)
    assert passage_recall(spark, texts, [(k, set(range(begins[k], begins[k] + len(variants[k])))) for k in range(1, len(texts), 2)]) >= 0.9


def test_near_copies_of_frequent_lines(spark):
    """Every line is in many documents, in another order, so nearly all minima are; each document of the second half is a
    near copy of one of the first, with many between them that have its minima."""
    rng = random.Random(15)
    stock = [[f"w{rng.randrange(10**5)}" for _ in range(18)] for _ in range(40)]
    sources = [[w for line in rng.sample(stock, 6) for w in line] for _ in range(200)]
    copies = []
    for v in sources:
        u = v[:]
        for at in rng.sample(range(len(u)), 5):
            u[at] = f"x{rng.randrange(10**6)}"
        copies.append(u)
    order = rng.sample(range(len(sources)), len(sources))
    texts = sources + [copies[k] for k in order]
    wanted = [(len(sources) + n, alike_words(copies[k], [sources[k]])) for n, k in enumerate(order)]
    wanted = [(n, w) for n, w in wanted if w]
    recall = passage_recall(spark, [" ".join(v) for v in texts], wanted)
    print("recall", len(wanted), recall)
    assert len(wanted) > 100 and recall == 1.0
