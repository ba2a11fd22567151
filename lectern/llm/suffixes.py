"""Repeated byte strings by externally sorted suffix tuples.

Which suffixes share their first LENGTH bytes with another is found without sorting all of
them.  Suffixes are sampled by content (a window's least 16-byte hash), so equal strings
have their samples at equal places, and every other suffix has a sample within REACH bytes.

1. A sampled suffix becomes a tuple: its name (of the LENGTH - REACH bytes that every string
   holding it shares), the wide name of all that its strings hold, and its place.
   Tuples of a share of the names are sorted together; neighbours with one name have a common
   prefix of LENGTH - REACH bytes at least, and with one wide name all strings at this sample
   are common.  A name that stands alone rules its suffixes out.
2. Where names are common and wide names are not, the suffixes between samples are induced:
   each is a new tuple, sorted again on its first LENGTH bytes.

The order is that of hashes: only which prefixes are common counts.  Tuples go through
``TupleQueue``, a priority queue that keeps sorted runs on disk and merges them block by
block, so a share of the tuples may be larger than the memory of its task.

A name that is very common is settled where it is read: of the tuples of one name that a task
reads together, those that are common already are marked at once, and only one goes on to
meet the tuples of other tasks.  So one name has as many tuples in the task where it meets as there
are tasks' batches that have it, whatever the number of documents.

Equal texts count once as they are sorted; every byte of them is repeated.  Defined results:
null is an empty text; texts under LENGTH bytes keep all; texts are of less than 1 GB; rows with equal keys are separate
rows; null keys come last; an empty table gives an empty result.  A long text is sampled in parts
that are cut between samples, with the same samples.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import by_document, document_parts, even_keys, never_null, partitions
from .kernels import Chunk, chunks, prefix_hash, span_hash, spread

LENGTH = 200
REACH = 100
GRAM = 16
#: tuples that a queue holds in memory before it writes a sorted run
HELD = 2_000_000
BLOCK = 1 << 16

#: tuples that are settled together where they are read
TOGETHER = 1 << 20
#: bytes of a long text that are sampled together
PART = 1 << 22

#: ``many``: 1 if others of its name and wide name were read with it, 2 if other wide names of its name were
SAMPLE = np.dtype([("name", "<u8"), ("wide", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("many", "u1")])
#: a sample on its way: names are told apart within their part, ``many`` is in the two highest bits of ``at``
BRIEF = np.dtype([("name", "<u4"), ("wide", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("at", "<u4")])
INDUCED = np.dtype([("name", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("at", "<u4")])
#: what is known of a sample, and which starts are repeated
MARK = np.dtype([("id", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("state", "u1")])
STARTS = np.dtype([("id", "<i8"), ("tag", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
RESOLVED, INDUCE = 1, 2


class TupleQueue:
    """Tuples out in the order of their fields, whatever order they went in.

    Runs are anonymous scratch files of the task, gone when it ends."""

    def __init__(self, dtype: np.dtype, held: int = HELD):
        self.dtype, self.held = dtype, held
        self.new: list[np.ndarray] = []
        self.size = 0
        self.runs: list[tuple[object, int]] = []

    def push(self, tuples: np.ndarray) -> None:
        if len(tuples):
            self.new.append(tuples)
            self.size += len(tuples)
            if self.size >= self.held:
                self._spill()

    def _sorted(self, x: np.ndarray) -> np.ndarray:
        return x[np.lexsort([x[f] for f in reversed(self.dtype.names)])]

    def _spill(self) -> None:
        run = self._sorted(np.concatenate(self.new))
        f = tempfile.TemporaryFile()
        f.write(run.tobytes())
        self.runs.append((f, len(run)))
        self.new, self.size = [], 0

    def groups(self) -> Iterator[np.ndarray]:
        """Sorted blocks that no name crosses."""
        if not self.runs:
            if self.new:
                yield self._sorted(np.concatenate(self.new))
            self.new = []
            return
        if self.new:
            self._spill()
        key = self.dtype.names[0]
        read = [0] * len(self.runs)
        heads = [np.empty(0, self.dtype)] * len(self.runs)

        def fill(i: int) -> None:
            f, n = self.runs[i]
            m = min(BLOCK, n - read[i])
            if m:
                f.seek(read[i] * self.dtype.itemsize)
                heads[i] = np.concatenate([heads[i], np.frombuffer(f.read(m * self.dtype.itemsize), self.dtype)])
                read[i] += m

        while True:
            for i in range(len(heads)):
                if not len(heads[i]):
                    fill(i)
            # names below the least last name of the runs not read to their end are complete
            open_ = [i for i in range(len(heads)) if read[i] < self.runs[i][1]]
            if not open_:
                if any(len(h) for h in heads):
                    yield self._sorted(np.concatenate(heads))
                break
            bound = min(heads[i][key][-1] for i in open_)
            cut = [int(np.searchsorted(h[key], bound)) for h in heads]
            if sum(cut):
                yield self._sorted(np.concatenate([h[:c] for h, c in zip(heads, cut)]))
                heads = [h[c:] for h, c in zip(heads, cut)]
            else:  # a name longer than a block: read on
                for i in open_:
                    if heads[i][key][-1] == bound:
                        fill(i)
        for f, _ in self.runs:
            f.close()
        self.runs = []


def samples(c: Chunk, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """(document, place, first and last start of a string at the sample; places in the buffer) and
    the prefix hash.  Strings are those of ``length`` bytes within a document."""
    prefix = prefix_hash(c.buf)
    n = len(c.buf) - GRAM + 1
    empty = np.empty(0, np.int64)
    if n < reach:
        return empty, empty, empty, empty, prefix
    at = np.arange(n)
    bits = np.uint64(max(20, int(n).bit_length()))
    key = (span_hash(prefix, at, at + GRAM) >> bits << bits) | at.astype(np.uint64)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    size = np.diff(c.off)
    starts = spread(c.off[:-1], np.maximum(size - length + 1, 0))
    if not len(starts):
        return empty, empty, empty, empty, prefix
    doc = np.repeat(np.arange(c.n), np.maximum(size - length + 1, 0))
    best = (key[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(best)]]) - 1
    return doc[first], best[first], starts[first], starts[last], prefix


def text_parts(c: Chunk, length: int, reach: int) -> Iterator[tuple[Chunk, int]]:
    """The chunk and 0; or the parts of one long text, each with the place where it begins.  A part ends
    where one sample's strings end, so every sample is in one part."""
    size = len(c.buf)
    if c.n > 1 or size <= PART + 4 * length:
        yield c, 0
        return
    at = 0
    while at < size:
        to = at + PART
        if to + 4 * length < size:
            near = c.buf[to : to + reach + 2 * length]
            _, _, lo, _, _ = samples(Chunk(0, near, np.array([0, len(near)])), length, reach)
            to += int(lo[1])  # the first sample's strings may have begun before
        else:
            to = size
        end = min(size, to + length - 1)
        yield Chunk(c.first, c.buf[at:end], np.array([0, end - at])), at
        at = to if end < size or to < size else size


def _deal(part: np.ndarray, keys: np.ndarray, tuples: np.ndarray, ids: np.ndarray, tags: np.ndarray, fields: list[str]) -> pa.RecordBatch:
    """Tuples packed by part, ids and tags once for each document of a part."""
    order = np.argsort(part, kind="stable")
    part, tuples, ids, tags = part[order], tuples[order], ids[order], tags[order]
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        new = np.ones(b - a, bool)
        new[1:] = (ids[a + 1 : b] != ids[a : b - 1]) | (tags[a + 1 : b] != tags[a : b - 1])
        at = np.flatnonzero(new)
        many = np.diff(np.concatenate([at, [b - a]])).astype(np.uint32)
        body = [np.array([len(at), b - a], np.uint32), ids[a:b][at], tags[a:b][at], many, *[np.ascontiguousarray(tuples[f][a:b]) for f in fields]]
        out.append((int(keys[part[a]]), b"".join(x.tobytes() for x in body)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["part", "data"])


def _dealt(data: bytes, dtype: np.dtype, fields: list[str]) -> np.ndarray:
    m, w = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    many = np.frombuffer(data, np.uint32, m, 8 + 16 * m)
    out, at = np.empty(w, dtype), 8 + 20 * m
    out["id"] = np.repeat(np.frombuffer(data, np.int64, m, 8), many)
    out["tag"] = np.repeat(np.frombuffer(data, np.int64, m, 8 + 8 * m), many)
    for f in fields:
        out[f] = np.frombuffer(data, dtype[f], w, at)
        at += w * dtype[f].itemsize
    return out


def _same(x: np.ndarray, *fields: str) -> np.ndarray:
    """Which tuples equal the one before in the fields."""
    out = np.zeros(len(x), bool)
    if len(x) > 1:
        out[1:] = np.logical_and.reduce([x[f][1:] == x[f][:-1] for f in fields])
    return out


def _counts(same: np.ndarray) -> np.ndarray:
    """The size of the run that each tuple is in."""
    run = np.cumsum(~same) - 1
    return np.bincount(run)[run] if len(run) else run


PACKED = "part int, data binary"


def settle_samples(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks, tuples that go on) of samples read together: one tuple of each name goes on."""
    t = t[np.lexsort((t["id"], t["at"], t["tag"], t["wide"], t["name"]))]
    t = t[~_same(t, "name", "wide", "tag", "at")]  # equal texts: one document
    same_name, same_wide = _same(t, "name"), _same(t, "name", "wide")
    many, alike = _counts(same_name), _counts(same_wide)
    state = np.where(alike > 1, RESOLVED, 0) | np.where((many > alike) & ~same_wide, INDUCE, 0)
    on = t[~same_name]
    on["many"] = np.where((many > alike)[~same_name], 2, np.where((alike > 1)[~same_name], 1, 0))
    return _marks(t, state), on


def _marks(t: np.ndarray, state: np.ndarray) -> np.ndarray:
    keep = state > 0
    y = np.empty(int(keep.sum()), MARK)
    for f in ("id", "tag", "at"):
        y[f] = t[f][keep]
    y["state"] = state[keep]
    return y


def meet_samples(x: np.ndarray) -> np.ndarray:
    """Marks of tuples that went on, all of their names."""
    x = x[np.lexsort((x["id"], x["at"], x["tag"], x["many"] == 0, x["wide"], x["name"]))]
    x = x[~_same(x, "name", "wide", "tag", "at")]
    same_name, same_wide = _same(x, "name"), _same(x, "name", "wide")
    many, alike = _counts(same_name), _counts(same_wide)
    run = np.cumsum(~same_name) - 1
    settled = np.bincount(run, x["many"] == 2)[run] > 0 if len(x) else np.zeros(0, bool)  # other wide names were read with some of the name
    # one tuple of each wide name is induced, of those that were read with other wide names each is already
    state = np.where(alike > 1, RESOLVED, 0) | np.where(((many > alike) | settled) & ~same_wide & (x["many"] < 2), INDUCE, 0)
    # where the first of a wide name is induced already, it speaks for the others
    return _marks(x, state)


def common_samples(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """(id, tag, data): samples whose name isn't alone, as places and what is to do with each."""
    parts = partitions(docs)
    keys = even_keys(parts)
    fields = ["name", "wide", "at"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settled() -> Iterator[pa.RecordBatch]:
            marks, t = settle_samples(np.concatenate(held))
            held.clear()
            if len(marks):
                yield _flagged(_of_documents(marks, parts, keys), True)
            yield _flagged(_deal((t["name"] % np.uint64(parts)).astype(np.int64), keys, _brief(t), t["id"], t["tag"], fields), False)

        for batch in batches:
            ids, tags = (batch.column(i).to_numpy() for i in (0, 1))
            for whole in chunks(batch.column(2)):
                for c, base in text_parts(whole, length, reach):
                    d, at, lo, hi, prefix = samples(c, length, reach)
                    if not len(d):
                        continue
                    t = np.empty(len(d), SAMPLE)
                    t["name"] = span_hash(prefix, at, at + length - reach)
                    t["wide"] = span_hash(prefix, lo, hi + length) ^ ((at - lo) * 1000003 + (hi - lo)).astype(np.uint64)
                    t["id"], t["tag"], t["at"], t["many"] = ids[c.first + d], tags[c.first + d], at - c.off[d] + base, 0
                    held.append(t)
                    if sum(map(len, held)) > TOGETHER:
                        yield from settled()
        if held:
            yield from settled()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = TupleQueue(SAMPLE)
        for batch in batches:
            known = batch.column(2)
            for data, done in zip(batch.column(1), known.to_pylist()):
                if not done:
                    queue.push(_in_full(_dealt(data.as_py(), BRIEF, fields)))
            x = batch.filter(known)
            if x.num_rows:
                yield x.select(["part", "data"])
        yield from _in_turn(map(meet_samples, queue.groups()), parts, keys)

    met = docs.select("id", "tag", "text").mapInArrow(take, f"{PACKED}, known boolean").repartition(parts, "part").mapInArrow(meet, PACKED)
    return by_document(met, MARK, parts, lambda d: _dealt(d, MARK, ["at", "state"]))


def _brief(t: np.ndarray) -> np.ndarray:
    x = np.empty(len(t), BRIEF)
    for f in ("wide", "id", "tag"):
        x[f] = t[f]
    x["name"], x["at"] = t["name"] >> np.uint64(32), t["at"] | t["many"].astype(np.uint32) << np.uint32(30)
    return x


def _in_full(x: np.ndarray) -> np.ndarray:
    t = np.empty(len(x), SAMPLE)
    for f in ("name", "wide", "id", "tag"):
        t[f] = x[f]
    t["at"], t["many"] = x["at"] & np.uint32((1 << 30) - 1), x["at"] >> np.uint32(30)
    return t


def _of_documents(x: np.ndarray, parts: int, keys: np.ndarray) -> pa.RecordBatch:
    """Marks or starts, packed by the part of their document."""
    order = np.lexsort([x[f] for f in reversed(x.dtype.names)])
    x = x[order]
    return _deal(document_parts(x, parts), keys, x, x["id"], x["tag"], list(x.dtype.names[2:]))


def _flagged(packed: pa.RecordBatch, known: bool) -> pa.RecordBatch:
    """``known``: on to the next step as it is."""
    return pa.RecordBatch.from_arrays([*packed.columns, pa.array([known] * packed.num_rows, pa.bool_())], names=["part", "data", "known"])


def _in_turn(made: Iterator[np.ndarray], parts: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What groups give, packed by document, HELD at a time."""
    found, held = [], 0
    for y in made:
        found.append(y)
        held += len(y)
        if held > HELD:
            y = np.concatenate(found)
            yield _of_documents(y, parts, keys)
            found, held = [], 0
    if held:
        yield _of_documents(np.concatenate(found), parts, keys)


def _starts(i: int, tag: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    x = np.empty(len(lo), STARTS)
    x["id"], x["tag"], x["lo"], x["hi"] = i, tag, lo, hi
    return x


def induce(docs: DataFrame, common: DataFrame, length: int, reach: int) -> DataFrame:
    """(id, tag, data): ranges of starts of repeated strings."""
    parts = partitions(docs)
    keys = even_keys(parts)
    # equal texts have one document in ``common``, the least, and only that is read
    joined = docs.join(common, ["id", "tag"]).select("id", "tag", "text", "data")
    fields = ["name", "at"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part_of: list[np.ndarray] = []

        def settled() -> Iterator[pa.RecordBatch]:
            t, part = np.concatenate(held), np.concatenate(part_of)
            held.clear()
            part_of.clear()
            order = np.argsort(t["name"], kind="stable")
            t, part = t[order], part[order]
            same = _same(t, "name")
            common = _counts(same) > 1  # settled here; one of them goes on
            if common.any():
                x = _runs_of_starts(t[common])
                yield _flagged(_of_documents(x, parts, keys), True)
            t, part = t[~same], part[~same]
            yield _flagged(_deal(part, keys, t, t["id"], t["tag"], fields), False)

        for batch in batches:
            ids, tags, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for whole in chunks(batch.column(2)):
                for c, base in text_parts(whole, length, reach):
                    d, at, lo, hi, prefix = samples(c, length, reach)
                    first = np.searchsorted(d, np.arange(c.n + 1))
                    done, new, new_d = [], [], []
                    for i in range(c.n):
                        m = np.frombuffer(marks[c.first + i], MARK)
                        own, place = at[first[i] : first[i + 1]], m["at"].astype(np.int64) - base + c.off[i]
                        which = np.searchsorted(own, place)
                        here = np.zeros(len(m), bool)
                        here[which < len(own)] = own[which[which < len(own)]] == place[which < len(own)]  # a part has its own samples only
                        m, which = m[here], which[here] + first[i]
                        r = np.unique(which[(m["state"] & RESOLVED) > 0])
                        if len(r):
                            done.append(_starts(int(ids[c.first + i]), int(tags[c.first + i]), lo[r] - c.off[i] + base, hi[r] - c.off[i] + base))
                        q = np.unique(which[(m["state"] & INDUCE) > 0])
                        new.append(q)
                        new_d.append(np.full(len(q), i))
                    if done:
                        x = np.concatenate(done)
                        yield _flagged(_of_documents(x, parts, keys), True)
                    q = np.concatenate(new) if new else np.empty(0, np.int64)
                    if len(q):
                        many = hi[q] - lo[q] + 1
                        start, sample, owner = spread(lo[q], many), np.repeat(q, many), np.repeat(np.concatenate(new_d), many)
                        t = np.empty(len(start), INDUCED)
                        t["name"], t["at"] = span_hash(prefix, start, start + length), start - c.off[owner] + base
                        t["id"], t["tag"] = ids[c.first + owner], tags[c.first + owner]
                        # equal strings have equal samples at equal places: those of one sample go together
                        name = span_hash(prefix, at[sample], at[sample] + length - reach) + ((at[sample] - start) // 32).astype(np.uint64)
                        held.append(t)
                        part_of.append(((name >> np.uint64(8)) % np.uint64(parts)).astype(np.int64))
                        if sum(map(len, held)) > TOGETHER:
                            yield from settled()
        if held:
            yield from settled()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = TupleQueue(INDUCED)
        for batch in batches:
            known = batch.column(2)
            for data, done in zip(batch.column(1), known.to_pylist()):
                if not done:
                    queue.push(_dealt(data.as_py(), INDUCED, fields))
            x = batch.filter(known)
            if x.num_rows:
                yield x.select(["part", "data"])
        yield from _in_turn((_runs_of_starts(x[_counts(_same(x, "name")) > 1]) for x in queue.groups()), parts, keys)

    met = joined.mapInArrow(take, f"{PACKED}, known boolean").repartition(parts, "part").mapInArrow(meet, PACKED)
    return by_document(met, STARTS, parts, lambda d: _dealt(d, STARTS, ["lo", "hi"]))


def _runs_of_starts(x: np.ndarray) -> np.ndarray:
    """Neighbouring starts of a document as ranges."""
    x = x[np.lexsort((x["at"], x["tag"], x["id"]))]
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = (x["id"][1:] != x["id"][:-1]) | (x["tag"][1:] != x["tag"][:-1]) | (x["at"][1:] != x["at"][:-1] + 1)
    first = np.flatnonzero(new)
    out = np.empty(len(first), STARTS)
    out["id"], out["tag"], out["lo"] = x["id"][first], x["tag"][first], x["at"][first]
    out["hi"] = x["at"][np.concatenate([first[1:], [len(x)]]) - 1] if len(first) else 0
    return out


def runs(size: int, starts: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes covered by strings at the starts."""
    x = np.frombuffer(starts, STARTS)
    order = np.argsort(x["lo"], kind="stable")
    lo, end = x["lo"][order].astype(np.int64), np.minimum(x["hi"][order].astype(np.int64) + length, size)
    reached = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, lo[1:] > reached[:-1]))
    return lo[first], reached[np.append(first[1:], len(lo)) - 1]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, kept_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked,
    kept_bytes.  Each byte goes that is covered by a string of ``length`` bytes which also starts
    anywhere else, in this text or another."""
    reach = length // 2
    rows = docs.select(never_null(F.col(key)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("tag"), "text")
    every = rows.where(F.octet_length("text") >= length).select("id", "tag")
    copied = every.groupBy("tag").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("tag")
    whole = every.join(copied, "tag").distinct()  # texts that occur again go whole
    found = induce(rows, common_samples(rows, length, reach), length, reach)
    marks = found.select("id", "tag", F.col("data").alias("starts"), F.lit(False).alias("whole"))
    marks = marks.join(whole, ["id", "tag"], "left_anti").unionByName(whole.select("id", "tag", F.lit(None).cast("binary").alias("starts"), F.lit(True).alias("whole")))
    joined = rows.join(marks, ["id", "tag"], "left").select("id", "text", "starts", "whole")
    extra = ", kept_bytes binary" if kept_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, starts, whole_ in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = t.as_py().encode()
                if whole_:
                    kept, removed, spans = b"", len(raw), 1
                elif starts:
                    begin, end = runs(len(raw), starts, length)
                    cuts = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                    removed, spans = len(raw) - len(kept), len(begin)
                else:
                    kept, removed, spans = raw, 0, 0
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols[: 4 + kept_text]], names=names[: 5 + kept_text])

    done = joined.mapInArrow(run, f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{extra}")
    return done.withColumn(key, F.nullif(key, F.lit((1 << 63) - 1)))
