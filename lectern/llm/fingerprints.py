"""Document fingerprints of statistically improbable features.

Every window of 64 bytes has an entropy; entropies are ranked by how rare they are in
the corpus.  In each run of 64 neighbouring windows the rarest (leftmost of equals)
gets a point, and windows with enough points are the features.  A feature's hash sets
five bits of a 2048-bit Bloom filter; after 160 features the chain goes on with a new
filter.  Likeness compares each filter of the shorter chain with its best match in
the other: common bits, less those that chance explains, over the most possible.

The entropy of all windows comes from counting, for 63 shifts, where the text equals
itself shifted: that says how often the byte that leaves or enters a window is in it.

Defined results: null is an empty text; an empty text has an empty fingerprint; a text
under 128 bytes has all its windows of 6 bytes as features, or itself if shorter; two empty fingerprints are alike (1), one empty and
one not are unlike (0).  Null ids come last; equal ids are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK_BYTES, Chunk, chunks, prefix_hash, sliding_argmin, span_hash, spread

WINDOW = 64
RUN = 64
POINTS = 16
#: a text under SHORT bytes has every window of SHORT_WINDOW bytes as a feature
SHORT, SHORT_WINDOW = 128, 6
BITS = 2048
HASHES = 5
PER_FILTER = 160
ENTROPIES = 1001
#: entropies (of 1000) outside say nothing about a text
LEAST, MOST = 100, 990
NEVER = np.int32(1 << 20)
#: windows of a long text, and bytes of filters, that are worked on at once
PART = 1 << 21
PAIRS = 16 << 20
_SCALE = 1 << 20
_TOTAL = 6 * WINDOW * _SCALE
_f = np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))
#: what the c-th equal byte adds to the sum of c*log2(c) over a window
_GAIN = np.concatenate([[0], np.round(np.diff(_f) * _SCALE)]).astype(np.int64)


def entropies(buf: np.ndarray) -> np.ndarray:
    """Entropy, 0 to 1000, of each window of the buffer."""
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ahead, back = np.ones(len(buf), np.uint8), np.ones(len(buf), np.uint8)
    for at in range(0, len(buf), 1 << 15):  # blocks that stay in the cache
        block = buf[at : at + (1 << 15) + WINDOW - 1]
        a, b = ahead[at : at + len(block)], back[at : at + len(block)]
        own = min(1 << 15, len(block))
        for k in range(1, WINDOW):
            m = min(own, len(block) - k)
            if m <= 0:
                break
            eq = (block[:m] == block[k : k + m]).view(np.uint8)
            a[:m] += eq
            b[k : k + m] += eq
    total = np.empty(n, np.int64)
    total[0] = _GAIN[back[:WINDOW]].sum()
    np.cumsum(_GAIN[back[WINDOW:]] - _GAIN[ahead[: n - 1]], out=total[1:])
    total[1:] += total[0]
    return (_TOTAL - total) * 1000 // _TOTAL


def inside(chunk: Chunk, n: int) -> np.ndarray:
    """Which of the n windows lie within one document."""
    ok = np.ones(n, bool)
    for edge in chunk.off[1:-1]:
        ok[max(0, edge - WINDOW + 1) : edge] = False
    return ok


def window_parts(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """The windows of a buffer, PART at a time."""
    n = len(buf) - WINDOW + 1
    for at in range(0, n, PART):
        yield at, min(at + PART, n)


def long_features(buf: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the different features of one text of more than PART windows, by place."""
    windows, found, most = len(buf) - WINDOW + 1, [], (0, np.uint64(0))
    for first, last in window_parts(buf):
        a, b = max(0, first - RUN + 1), min(windows, last + RUN - 1)  # all runs that a window is in
        piece = buf[a : b + WINDOW - 1]
        key = ranks[entropies(piece)]
        points = np.bincount(sliding_argmin(key, RUN), minlength=len(key))[first - a : last - a]
        prefix = prefix_hash(piece)
        at = np.flatnonzero((points >= POINTS) & (key[first - a : last - a] < NEVER)) + (first - a)
        found.append(span_hash(prefix, at, at + WINDOW))
        best = np.array([int(points.argmax())]) + (first - a)
        if points.max() > most[0]:
            most = int(points.max()), span_hash(prefix, best, best + WINDOW)[0]
    h = np.concatenate(found)
    if not len(h):
        return np.array([most[1]], np.uint64)
    _, at = np.unique(h, return_index=True)
    return h[np.sort(at)]


def features(chunk: Chunk, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every different feature, by document and place."""
    length = np.diff(chunk.off)
    if chunk.n == 1 and length[0] > PART + WINDOW:
        h = long_features(chunk.buf, ranks)
        return np.zeros(len(h), np.int64), h
    prefix = prefix_hash(chunk.buf)
    short = np.flatnonzero((length > 0) & (length < SHORT))
    width = np.minimum(length[short], SHORT_WINDOW)
    many = length[short] - width + 1
    begin, doc = spread(chunk.off[short], many), np.repeat(short, many)
    end = begin + np.repeat(width, many)
    e = entropies(chunk.buf)
    if len(e):
        key = np.where(inside(chunk, len(e)), ranks[e], NEVER + 1).astype(np.int32)
        long = np.flatnonzero(length >= SHORT)
        windows = length[long] - WINDOW + 1
        # a run must lie within the document; a document of fewer windows is one run
        points = np.zeros(len(e), np.int64)
        runs = np.maximum(windows - RUN + 1, 0)
        best = sliding_argmin(key, RUN)
        if len(best):
            starts = np.zeros(len(best) + 1, np.int64)
            full = long[runs > 0]
            np.add.at(starts, chunk.off[full], 1)
            np.add.at(starts, chunk.off[full] + runs[runs > 0], -1)
            points += np.bincount(best[np.cumsum(starts[:-1]) > 0], minlength=len(e))
        for d in long[runs == 0]:
            at = chunk.off[d]
            points[at + int(key[at : at + length[d] - WINDOW + 1].argmin())] = 1
        owner = np.repeat(np.arange(chunk.n), length)[: len(e)]
        need = np.ones(chunk.n, np.int64)
        need[long] = np.clip(runs // RUN, 1, POINTS)
        at = np.flatnonzero((points > 0) & (points >= need[owner]) & (key < NEVER))
        lacking = np.setdiff1d(long, owner[at])  # e.g. of one byte only: the window with most points
        more = [chunk.off[d] + int(points[chunk.off[d] : chunk.off[d + 1] - WINDOW + 1].argmax()) for d in lacking]
        at = np.concatenate([at, np.array(more, np.int64)])
        begin, end, doc = np.concatenate([begin, at]), np.concatenate([end, at + WINDOW]), np.concatenate([doc, owner[at]])
    h = span_hash(prefix, begin, end)
    order = np.lexsort((begin, h, doc))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    keep = np.sort(order[first])
    keep = keep[np.lexsort((begin[keep], doc[keep]))]
    return doc[keep], h[keep]


class Digest:
    """A chain of filters; ``size`` features in all."""

    __slots__ = ("filters", "size")

    def __init__(self, filters: np.ndarray, size: int):
        self.filters, self.size = filters, size

    def __str__(self) -> str:
        return f"{self.size}:{base64.b64encode(self.filters.tobytes()).decode()}" if self.size else ""

    def counts(self) -> np.ndarray:
        n = np.full(len(self.filters), PER_FILTER)
        n[-1:] = self.size - PER_FILTER * (len(self.filters) - 1)
        return n


def parse(fingerprint: str) -> Digest:
    if not fingerprint:
        return Digest(np.empty((0, BITS // 64), np.uint64), 0)
    size, _, data = fingerprint.partition(":")
    return Digest(np.frombuffer(base64.b64decode(data), np.uint64).reshape(-1, BITS // 64), int(size))


def digests(chunk: Chunk, ranks: np.ndarray) -> list[Digest]:
    doc, h = features(chunk, ranks)
    size = np.bincount(doc, minlength=chunk.n)
    chain = -(-size // PER_FILTER)
    first = np.concatenate([[0], np.cumsum(chain)])
    within = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    bits = np.zeros((int(first[-1]), BITS), bool)
    row = first[doc] + within // PER_FILTER
    for i in range(HASHES):
        bits[row, ((h >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64).reshape(-1, BITS // 64)
    return [Digest(packed[first[i] : first[i + 1]], int(size[i])) for i in range(chunk.n)]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1; symmetric."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    if (len(b.filters), b.size, b.filters.tobytes()) < (len(a.filters), a.size, a.filters.tobytes()):
        a, b = b, a
    na, nb = a.counts(), b.counts()
    q = (1 - 1 / BITS) ** HASHES
    ones = np.bitwise_count(b.filters).sum(1)
    each, step = np.empty(len(na)), max(1, PAIRS // b.filters.nbytes)
    for at in range(0, len(na), step):  # some filters of one chain with all of the other
        rows, n = a.filters[at : at + step], na[at : at + step, None]
        common = np.bitwise_count(rows[:, None, :] & b.filters[None, :, :]).sum(2).astype(float)
        most = np.minimum(np.bitwise_count(rows).sum(1)[:, None], ones[None, :]).astype(float)
        chance = BITS * (1 - q**n - q ** nb[None, :] + q ** (n + nb[None, :]))
        cut = np.minimum(chance + 0.3 * np.maximum(most - chance, 0), most - 1)
        each[at : at + step] = np.clip((common - cut) / np.maximum(most - cut, 1), 0, 1).max(1)
    use = na >= min(16, na.max())
    return float((each[use] * na[use]).sum() / na[use].sum())


def digest_texts(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    out: list[Digest] = []
    for c in chunks(pa.array(texts, pa.large_binary())):
        out += digests(c, ranks)
    return out


def fit_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy: how rare it is among all windows of all texts.  What comes to the
    driver is one number for each of 1001 entropies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENTROPIES, np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                if c.n == 1:
                    for first, last in window_parts(c.buf):
                        total += np.bincount(entropies(c.buf[first : last + WINDOW - 1]), minlength=ENTROPIES)
                else:
                    e = entropies(c.buf)
                    total += np.bincount(e[inside(c, len(e))], minlength=ENTROPIES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["entropy", "n"])

    got = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "entropy int, n bigint").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(ENTROPIES, np.int64)
    for r in got:
        n[r.entropy] = r.n
    ranks = np.empty(ENTROPIES, np.int32)
    ranks[np.lexsort((np.arange(ENTROPIES), n))] = np.arange(ENTROPIES)
    ranks[:LEAST] = ranks[MOST + 1 :] = NEVER
    return ranks


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; see ``edited``.  The next document is the one after it by key, and the
    first after the last.  Documents are dealt out by ranges of the key, and the first of each range
    also goes to the range before, so neighbours meet without one global sort."""
    spark = docs.sparkSession
    ranks = fit_ranks(docs, text)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k, t = F.col(f"`{key}`").cast("bigint"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(k, F.lit((1 << 63) - 1)).alias("k"), k.alias("id"), t.alias("text"), F.xxhash64(t).alias("h"))
    first = rows.select("k", "h").repartitionByRange(parts * 4, "k", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "h")).alias("x"))
    heads = np.array(sorted({(r.x.k, r.x.h) for r in first.collect()}), np.int64).reshape(-1, 2)  # one for each range
    held = spark.sparkContext.broadcast((heads, ranks))

    @F.arrow_udf("range int, head boolean")
    def place(k: pa.Array, h: pa.Array) -> pa.Array:
        heads = held.value[0]
        k, h = k.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        begin, end = np.searchsorted(heads[:, 0], k), np.searchsorted(heads[:, 0], k, side="right")
        at = end - 1
        for a in np.unique(begin[begin < end]):  # keys that are in several ranges go by text hash
            own = (begin == a) & (begin < end)
            at[own] = a - 1 + np.searchsorted(heads[a : end[own][0], 1], h[own], side="right")
        at = np.maximum(at, 0)
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array((heads[at, 0] == k) & (heads[at, 1] == h))], names=["range", "head"])

    n = max(1, len(heads))
    goes = F.array(F.struct(F.col("at.range").alias("range"), F.lit(0).alias("copy")), F.when(F.col("at.head"), F.struct(((F.col("at.range") + n - 1) % n).cast("int").alias("range"), F.lit(1).alias("copy"))))
    dealt = rows.withColumn("at", place("k", "h")).select("id", "k", "h", "text", F.inline(F.filter(goes, lambda x: x.isNotNull())).alias("range", "copy"))
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "copy", "k", "h")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value[1]
        before = None  # the row that waits for the next one: (id, text, digest)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                to, size = at, 0
                while to < batch.num_rows and (to == at or size < CHUNK_BYTES):
                    size += len(batch.column(1)[to].as_buffer())
                    to += 1
                part = batch.slice(at, to - at).to_pydict()
                at = to
                own = digest_texts([t.encode() for t in part["text"]], ranks)
                pairs = []
                for i, (t, copy) in enumerate(zip(part["text"], part["copy"])):
                    now = (part["id"][i], t, own[i])
                    if before is not None:
                        pairs.append((before, now))
                    before = None if copy else now
                if not pairs:
                    continue
                new = [edited(a[1], b[1]).encode() for a, b in pairs]
                changed = digest_texts(new, ranks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in new]),
                        pa.array([str(a[2]) for a, _ in pairs]),
                        pa.array([str(d) for d in changed]),
                        pa.array([likeness(a[2], d) for (a, _), d in zip(pairs, changed)], pa.float64()),
                        pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                    ],
                    names=names,
                )

    out = dealt.select("id", "text", "copy").mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", key)
