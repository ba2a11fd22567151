"""Alignment, clustering and streaming against plain versions of themselves."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from lectern.operators import alignment as L
from lectern.operators.evidence import similar_tokens
from lectern.operators import robust, runtime, sequences, store


def slow_chain(tops, lines):
    best = [1] * len(lines)
    for i in range(len(lines)):
        best[i] = 1 + max([best[j] for j in range(i) if lines[j] <= lines[i]], default=0)
    return max(best, default=0)


def test_chain_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 12)
        tops, lines = np.arange(n), np.array([rng.randint(0, 6) for _ in range(n)], int)
        c = L.chain(tops, lines)
        assert len(c) == slow_chain(tops, lines) and (np.diff(lines[c]) >= 0).all()
    assert L.chain(np.array([0, 0, 1]), np.array([1, 1, 2])) == [0, 2]


def test_rogue_seed_is_dropped_and_positions_follow():
    tops = np.array([0.0, 10, 20, 30, 40])
    where, sure = L.expected_lines(np.array([-10.0, 5, 25, 50]), tops, np.array([0, 1, 9, 3, 4]), 10)
    assert sure and where.tolist() == [0.0, 0.5, 2.5, 5.0]
    where, sure = L.expected_lines(np.array([0.0, 10]), np.array([3.0]), np.array([2]), 5)
    assert not sure and where.tolist() == [0.0, 4.0]


def test_alike(spark):
    pairs = [("ahnedaardbei", "ahnedaarbei", True), ("kaart", "kaarthouder", True), ("pas", "past", False), ("abcdef", "uvwxyz", False)]
    got = similar_tokens(spark.createDataFrame(pairs, "a string, b string, want boolean").select("a", "b"), L.FUZZY_LENGTH, L.FUZZY_RATIO).collect()
    assert {(r.a, r.b, r.similar) for r in got} == set(pairs)


def page(lines, cells):
    h = [(1, 0, i, t) for i, t in enumerate(lines)]
    c = [(1, 0, i, t, float(x), float(y), 80.0, 10.0) for i, (t, x, y) in enumerate(cells)]
    return c, h


CELL, LINE = "doc bigint, page bigint, cell_id bigint, text string, x double, y double, w double, h double", "doc bigint, page bigint, line_idx bigint, text string"


def bound(spark, lines, cells):
    c, h = page(lines, cells)
    return {r.cell_id: r.line_idx for r in L.bind(spark.createDataFrame(c, CELL), spark.createDataFrame(h, LINE)).collect()}


def test_cells_find_their_lines(spark):
    lines = ["soup of the day", "grilled fish", "green salad", "grilled fish", "sweet ending"]
    cells = [("soup of", 0, 0), ("the day", 100, 0), ("grilled fish", 0, 20), ("green salad", 0, 40), ("grilled fish", 0, 60), ("sweet ending", 0, 80), ("unrelated", 0, 90)]
    assert bound(spark, lines, cells) == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: None}


def test_garbled_cells_bind(spark):
    got = bound(spark, ["kaarthouder betaling", "totaal bedrag"], [("kaarthuder betallng", 0, 0), ("totaal bedrag", 0, 20)])
    assert got == {0: 0, 1: 1}


def test_every_cell_is_in_one_unit(spark):
    rng = random.Random(5)
    stock = [f"word{i}" for i in range(30)]
    lines = [" ".join(rng.choice(stock) for _ in range(5)) for _ in range(12)]
    cells = [(" ".join(t.split()[k : k + 3]) if rng.random() < 0.8 else "zzz", k * 50, i * 20) for i, t in enumerate(lines) for k in (0, 3)]
    c, h = page(lines, cells)
    b = L.bind(spark.createDataFrame(c, CELL), spark.createDataFrame(h, LINE))
    got = sorted(x for r in L.units(b).collect() for x in r.cells)
    assert got == list(range(len(cells)))


def test_region_columns(spark):
    def cols(boxes):
        df = spark.createDataFrame([(1, 0, i, float(a), float(b)) for i, (a, b) in enumerate(boxes)], "doc bigint, page bigint, reg_ord bigint, x0 double, x1 double")
        return [r.col for r in L.region_columns(df).orderBy("reg_ord").collect()]

    got = cols([(0, 100), (0, 98), (120, 220), (122, 219), (0, 220)])
    assert got[0] == got[1] != got[2] == got[3] and got[4] is None


def test_stacked_columns(spark):
    rows = [(1, i, float(x), 50.0) for i, x in enumerate([0, 5, 100, 110, 40, 300])]
    got = {r.cell_id: r.col for r in L.stacked_columns(spark.createDataFrame(rows, "doc bigint, cell_id bigint, x double, w double"), ["doc"]).collect()}
    assert got[0] == got[1] and got[2] == got[3] != got[0] and got[5] not in (got[0], got[2])


def test_islands_keep_runs_over_leftovers(spark):
    rows = [(1, i, v) for i, v in enumerate([7, 7, None, 7, 3, None, 7])]
    got = [r.grp for r in sequences.islands(spark.createDataFrame(rows, "doc int, i int, label int"), ["doc"], "i", ["label"]).orderBy("i").collect()]
    assert got == [0, 0, None, 0, 1, None, 2]


@pytest.mark.parametrize("seed", range(3))
def test_line_clusters_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(1, i, float(a), float(a + rng.randint(1, 30))) for i, a in enumerate(rng.sample(range(300), 60))]
    want, reach, n = {}, None, -1
    for _, i, a, b in sorted(rows, key=lambda r: ((r[2] + r[3]) / 2, r[1])):
        if reach is None or (a + b) / 2 > reach:
            n, reach = n + 1, b
        else:
            reach = max(reach, b)
        want[i] = n
    df = spark.createDataFrame(rows, "doc int, i int, lo double, hi double")
    assert {r.i: r.line for r in sequences.line_clusters(df, ["doc"], "lo", "hi", "i").collect()} == want


def test_projection_bands_equal_the_mask(spark):
    rng = random.Random(9)
    for _ in range(3):
        spans = [(a, a + rng.randint(1, 40)) for a in rng.sample(range(500), 8)]
        on = np.zeros(600, bool)
        for a, b in spans:
            on[a:b] = True
        cuts, empty = [], None
        for x in range(600):
            if not on[x]:
                empty = x if empty is None else empty
            else:
                if empty is not None and x - empty >= 25 and on[:empty].any():
                    cuts.append(x)
                empty = None
        edges = [0, *cuts, 600]
        want = [max(b for a, b in spans if lo <= a < hi) for lo, hi in zip(edges, edges[1:]) if any(lo <= a < hi for a, _ in spans)]
        df = spark.createDataFrame([(1, a, b) for a, b in spans], "doc int, l bigint, r bigint")
        assert [r.margin for r in sequences.projection_bands(df, ["doc"], "l", "r").orderBy("band").collect()] == want


def test_theil_sen_ignores_a_stray(spark):
    rows = [(1, i, float(10 * i), 0.5 * i) for i in range(9)] + [(1, 9, 95.0, 80.0)]
    r = robust.theil_sen(spark.createDataFrame(rows, "doc int, i int, x double, y double"), ["doc"], "i", "x", "y").first()
    assert abs(r.slope - 0.05) < 1e-9 and abs(r.intercept) < 1e-9


def test_lifecycle_and_retention(spark):
    rows = [(1, "a", "queued", 0), (2, "a", "running", 5), (3, "b", "queued", 6), (4, "a", "cancelled", 9), (5, "a", "failed", 10), (6, "c", "completed", 11)]
    st = runtime.last_state(spark.createDataFrame(rows, "seq bigint, request_id string, state string, t bigint"))
    assert {r.request_id: (r.state, r.finished_at) for r in st.collect()} == {"a": ("cancelled", 9), "b": ("queued", None), "c": ("completed", 11)}
    from pyspark.sql import functions as F

    assert {r.request_id for r in runtime.expired(st, F.lit(609)).collect()} == {"a"}
    assert [r.request_id for r in runtime.overflow(st, 2).collect()] == ["a"]


def test_runs_are_saved_once(spark, tmp_path):
    runs = spark.createDataFrame([(1, "x", "r1", 1.0), (1, "x", "r2", 2.0), (2, "y", "r1", 3.0)], "doc_id bigint, system string, run_id string, layout double")
    path = f"file://{tmp_path}/runs"
    store.save_runs(runs, path)
    back = store.load_runs(spark, path)
    assert {(r.doc_id, r.run_id) for r in store.latest_runs(back.select(*runs.columns)).collect()} == {(1, "r2"), (2, "r1")}
    with pytest.raises(Exception, match="(?i)exist"):
        store.save_runs(runs, path)


def test_lineage_stops_at_cycles(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, True), (2, 1, False), (3, 2, False), (4, 5, False), (5, 4, False)]
    got = {r.id: (r.root, r.hops) for r in store.lineage(spark.createDataFrame(rows, "id bigint, source_id bigint, ok boolean"), F.col("ok")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2)}


def test_stream_equals_batch(spark, tmp_path):
    from lectern.streaming import lifecycle as S

    base = datetime(2024, 1, 1)
    kinds = ["click", "view", "purchase", "error", "signup"]
    rng = random.Random(3)
    rows = [(i, base + timedelta(seconds=30 * i), rng.randint(1, 9), rng.choice(kinds), 1.0, "{}") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    events = lambda: S.event_stream(spark, f"file://{tmp_path}/in", "*.parquet")
    live = S.run_available(spark, S.live_states(events()), "complete")
    e = spark.read.parquet(f"file://{tmp_path}/in")
    assert live.count() == e.select("user_id").distinct().count()
    closed = S.run_available(spark, S.minute_counts(events()), "append")
    assert 0 < closed.agg({"n": "sum"}).first()[0] <= 200
