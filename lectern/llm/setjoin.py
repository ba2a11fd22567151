"""Exact Jaccard join of word-shingle sets as a metric-space join.

1. Every text becomes the set of its distinct shingles (64-bit hashes); equal sets are
   one node from here on.
2. A sketch of bounded size counts how many sets hold a shingle of each hash class.
   All sets order their shingles by it, rarest first.  Two sets as alike as asked share
   a shingle within the prefixes of that order, so common passages, which come last,
   bring nobody together who does not consist of them.
3. Sets that share a prefix shingle, and whose sizes allow a link, meet in the region
   of a pivot: the least of them.  Every candidate pair has a region in common.
4. Every set also has a bitmap of two to four bits a shingle.  A bit that one set has and
   another lacks stands for a shingle that they don't share, which bounds their likeness.
   Members of a region that nobody there can be linked to by that bound leave it, before
   whole sets are read.
5. A region is joined by pivots with the distance 1 - J, a metric.  Sets within the
   threshold of a pivot are linked to it and leave; by the triangle inequality only
   sets within twice the threshold can be near one that leaves, and only to those
   whose distances to the pivot differ by the threshold at most.  The rest recurse.
6. A region too large for a task is cut into parts, each with the pivot.  Sets near
   the pivot are linked already, so only the others, replicated to all the parts,
   are still compared.

What links a set to its component is kept, not all pairs.  Defined results: a text
without words, or null, has an empty set and is linked with nothing; fewer words than
a shingle make one shingle; equal ids with different texts are separate rows; null ids
count as greater than all others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dealing import components, even_keys, never_null, packed_by, partitions, row_struct
from .kernels import Chunk, chunks, doc_of, mix, shingle_hashes, spread, word_hashes

WORDS = 5
#: J >= NUM / DEN links two sets
NUM, DEN = 75, 100
SKETCH = 1 << 18
SKETCH_ROWS = 64
#: sets of a region that one task holds
REGION = 400
MASK48 = np.uint64((1 << 48) - 1)


def sets_of(chunk: Chunk, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, concatenated, and where each begins."""
    _, _, first, w = word_hashes(chunk)
    count = np.diff(first)
    doc = doc_of(first, len(w))
    s = shingle_hashes(w, k)
    ok = doc[: len(s)] == doc[k - 1 :] if len(s) else np.empty(0, bool)
    d, h = doc[: len(s)][ok], s[ok]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = []
        with np.errstate(over="ignore"):
            for i in few:
                x = np.uint64(count[i])
                for v in w[first[i] : first[i + 1]]:
                    x = mix(x * np.uint64(0xC4CEB9FE1A85EC53) + v)
                short.append(x)
        d, h = np.concatenate([d, few]), np.concatenate([h, np.array(short, np.uint64)])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    d, h = d[keep], h[keep]
    return h, np.searchsorted(d, np.arange(chunk.n + 1))


def node_ids(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, as int64."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
        n = np.diff(start).astype(np.uint64)
        return mix(total[start[1:]] - total[start[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def least_size(n):
    """The least size of a set that can be linked to one of size n."""
    return -(-n * NUM // DEN)


def linked(common, a, b):
    return DEN * common >= NUM * (a + b - common)


# --- 1 and 2: sets, sketch ---------------------------------------------------------------


def bitmaps(h: np.ndarray, start: np.ndarray) -> list[bytes]:
    """A bitmap of each set: a power of two of bits, at least 64 and at least two for each member."""
    n = np.diff(start)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    flags = np.zeros(int(at[-1]), bool)
    size = np.repeat(bits, n)
    flags[np.repeat(at[:-1], n) + ((h >> np.uint64(16)).astype(np.int64) & (size - 1))] = True
    packed = np.packbits(flags, bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(at[:-1], at[1:])]


def plausible(n: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Which sets may be linked to another, from their sizes and bitmaps (as 64-bit words)."""
    out = np.zeros(len(n), bool)
    words = np.array([len(m) for m in maps])
    for level in np.unique(words):
        mine = np.flatnonzero(words >= level)
        rows = np.stack([np.bitwise_or.reduce(maps[i].reshape(-1, level), axis=0) for i in mine])
        exact = words[mine] == level
        size, own = n[mine], np.bitwise_count(rows).sum(1).astype(np.int64)
        for x in np.flatnonzero(exact):
            both = np.bitwise_count(rows & rows[x]).sum(1).astype(np.int64)
            most = np.minimum(size[x] - (own[x] - both), size - (own - both))
            ok = (DEN * most >= NUM * (size[x] + size - most)) & (size >= least_size(size[x])) & (least_size(size) <= size[x])
            ok[x] = False
            out[mine[ok]] = True
            out[mine[x]] |= ok.any()
    return out


def describe(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: a row for each document (id, tag, node, n, data: its bitmap); kind 1: rows of the sketch (id: which, data)."""
    width = SKETCH // SKETCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        names = ["kind", "id", "tag", "node", "n", "data"]
        for batch in batches:
            nodes, sizes, maps = [], [], []
            for c in chunks(batch.column(1)):
                h, start = sets_of(c, k)
                sketch += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                nodes.append(node_ids(h, start))
                sizes.append(np.diff(start))
                maps += bitmaps(h, start)
            m = batch.num_rows
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), batch.column(0), batch.column(2), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(maps, pa.binary())], names=names)
        at = [i for i in range(SKETCH_ROWS) if sketch[i * width : (i + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at, pa.int64()), *[pa.nulls(len(at), pa.int64())] * 3, pa.array([zlib.compress(sketch[i * width : (i + 1) * width].tobytes(), 1) for i in at], pa.binary())], names=names)

    return docs.mapInArrow(run, "kind int, id bigint, tag bigint, node bigint, n bigint, data binary")


def sketch_of(described: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: SKETCH numbers, whatever the corpus."""
    width = SKETCH // SKETCH_ROWS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(data), np.int64)
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["id", "data"])

    out = np.zeros(SKETCH, np.int64)
    for r in described.where("kind = 1").select("id", "data").repartition(min(SKETCH_ROWS, partitions(described)), "id").mapInArrow(add, "id bigint, data binary").collect():
        out[r.id * width : (r.id + 1) * width] = np.frombuffer(r.data, np.int64)
    return out


# --- 3 and 4: prefixes and regions --------------------------------------------------------------


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes that can be linked are of one class or of neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(DEN / NUM) + 1e-9).astype(np.int64)


def regions(docs: DataFrame, k: int, sketch: np.ndarray) -> DataFrame:
    """(pivot, node): which sets meet in which region, as node ids.  Regions of one set are left out."""
    parts = partitions(docs)
    held = docs.sparkSession.sparkContext.broadcast(sketch)  # SKETCH numbers
    keys = even_keys(parts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            for c in chunks(batch.column(0), 1 << 21):
                h, start = sets_of(c, k)
                n = np.diff(start)
                node = node_ids(h, start)
                _, one = np.unique(node, return_index=True)  # equal sets once
                single = np.zeros(c.n, bool)
                single[one] = True
                d = np.repeat(np.arange(c.n), n)
                rank = np.lexsort((h, counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)], d))
                place = np.arange(len(h)) - start[d]
                take = (place < (n - least_size(n) + 1)[d]) & single[d]
                d, t = d[take], h[rank][take]
                part = ((t >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((d, part))
                d, t, part = d[order], (t[order] >> np.uint64(32)).astype(np.uint32), part[order]
                cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
                rows = []
                for a, b in zip(cut[:-1], cut[1:]):
                    u, m = np.unique(d[a:b], return_counts=True)
                    rows.append((int(keys[part[a]]), np.array([len(u)], np.uint32).tobytes() + node[u].tobytes() + n[u].astype(np.uint32).tobytes() + m.astype(np.uint32).tobytes() + t[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node, size = [], [], []
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = int(np.frombuffer(data, np.uint32, 1)[0])
                ids, n, many = np.frombuffer(data, np.int64, m, 4), np.frombuffer(data, np.uint32, m, 4 + 8 * m), np.frombuffer(data, np.uint32, m, 4 + 12 * m)
                token.append(np.frombuffer(data, np.uint32, -1, 4 + 16 * m))
                node.append(np.repeat(ids, many))
                size.append(np.repeat(n, many))
        if not token:
            return
        token, node, size = np.concatenate(token), np.concatenate(node), np.concatenate(size)
        order = np.argsort(token, kind="stable")
        token, node, size = token[order], node[order], size[order]
        same = token[1:] == token[:-1]
        many = np.zeros(len(token), bool)
        many[1:] |= same
        many[:-1] |= same
        token, node, size = token[many], node[many], size[many]
        # twice: in the region of the set's class with the next, and of the class before with its own
        c = size_class(size)
        token, node, c = np.concatenate([token, token]), np.concatenate([node, node]), np.concatenate([c, c - 1])
        order = np.lexsort((node, c, token))
        token, node, c = token[order], node[order], c[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
        pivot = node[np.flatnonzero(first)][np.cumsum(first) - 1]
        other = pivot != node
        pairs = np.unique(np.stack([pivot[other], node[other]], 1), axis=0) if other.any() else np.empty((0, 2), np.int64)
        if len(pairs):
            yield packed_by((mix(pairs.view(np.uint64).sum(1, dtype=np.uint64)) % np.uint64(parts)).astype(np.int64), keys, pairs)

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(d, np.int64).reshape(-1, 2) for batch in batches for d in batch.column(1).to_pylist()]
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            for at in range(0, len(pairs), 1 << 16):
                p = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["pivot", "node"])

    packed = docs.select("text").mapInArrow(prefixes, "part int, data binary").repartition(parts, "part")
    return packed.mapInArrow(meet, "part int, data binary").repartition(parts, "part").mapInArrow(unique, "pivot bigint, node bigint")


def keep_plausible(members: DataFrame) -> DataFrame:
    """(pivot, node, id): members of regions that may be linked to another member there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def judge() -> None:
            if len(held) > 1:
                ok = plausible(np.array([r[3] for r in held]), [np.frombuffer(r[4], np.uint64) for r in held])
                out.extend(held[i][:3] for i in np.flatnonzero(ok))
            held.clear()

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if held and held[0][0] != row[0]:
                    judge()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["pivot", "node", "id"])
                out.clear()
        judge()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["pivot", "node", "id"])

    dealt = members.repartition("pivot").sortWithinPartitions("pivot", "node")
    return dealt.select("pivot", "node", "id", "n", "data").mapInArrow(run, "pivot bigint, node bigint, id bigint")


# --- 5 and 6: joining a region --------------------------------------------------------------------


def overlaps(one: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many members of ``one`` (sorted) each of n sets (concatenated in ``flat``) has."""
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    return np.bincount(owner[one[at] == flat], minlength=n)


class Region:
    """Sets of one region, joined by pivots; ``links`` are enough to connect what is connected."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.sets = sets
        self.root = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self._find(i), self._find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def distances(self, pivot: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(linked to the pivot, distance) of the sets ``among``."""
        flat = np.concatenate([self.sets[i] for i in among])
        common = overlaps(pivot, flat, np.repeat(np.arange(len(among)), self.size[among]), len(among))
        n = self.size[among]
        return linked(common, n, len(pivot)), 1 - common / (n + len(pivot) - common)

    def join(self, order: np.ndarray | None = None) -> None:
        r, slack = 1 - NUM / DEN, 1e-9
        left = np.arange(len(self.sets)) if order is None else order
        while len(left) > 1:
            p, rest = left[0], left[1:]
            able = (self.size[rest] >= least_size(self.size[p])) & (least_size(self.size[rest]) <= self.size[p])
            near_size = (self.size[rest] >= self.size[p] * (1 - 2 * r) - 1) & (self.size[rest] * (1 - 2 * r) - 1 <= self.size[p])
            seen = rest[near_size]
            if len(seen):
                hit, d = self.distances(self.sets[p], seen)
                hit &= able[near_size]
                for i in seen[hit]:
                    self.link(p, i)
                inner, at = seen[hit], d[hit]
                window = ~hit & (d <= 2 * r + slack)
                for y, dy in zip(seen[window], d[window]):
                    close = inner[at >= dy - r - slack]
                    close = close[(self.size[close] >= least_size(self.size[y])) & (least_size(self.size[close]) <= self.size[y])]
                    if len(close) and self._find(y) != self._find(p):
                        hit_y, _ = self.distances(self.sets[y], close)
                        if hit_y.any():
                            self.link(int(close[hit_y.argmax()]), y)
                rest = np.setdiff1d(rest, inner, assume_unique=True)
            left = rest


def unpack(data: bytes) -> np.ndarray:
    m = len(data) // 6
    return np.frombuffer(data, np.uint32, m).astype(np.uint64) | (np.frombuffer(data, np.uint16, m, 4 * m).astype(np.uint64) << np.uint64(32))


def pack(h: np.ndarray) -> bytes:
    h = np.unique(h & MASK48)
    return h.astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint16).tobytes()


EDGE = "a struct<id:bigint,node:bigint>, b struct<id:bigint,node:bigint>"
MEMBER = "pivot bigint, piece int, pieces int, id bigint, node bigint, root bigint, away double, data binary"
_STRUCT = pa.struct([("id", pa.int64()), ("node", pa.int64())])


def _edges(pairs: list[tuple], passed: list[tuple] | None) -> pa.RecordBatch:
    """Links, then members passed on."""
    blank = [None] * len(pairs)
    members = passed or []
    a = [{"id": x[0], "node": x[1]} for x, _ in pairs] + [None] * len(members)
    b = [{"id": x[0], "node": x[1]} for _, x in pairs] + [None] * len(members)
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
    cols = [pa.array(blank + [m[i] for m in members], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([pa.array(a, _STRUCT), pa.array(b, _STRUCT), *cols], names=["a", "b", *[c.split()[0] for c in MEMBER.split(", ")]])


def join_pieces(members: DataFrame) -> DataFrame:
    """Links within each (pivot, piece), and the members of regions of several pieces with their
    distance to the pivot and the node that stands for what they are connected with in the piece
    (the pivot, if that is).  Rows of a piece are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def joined() -> pa.RecordBatch | None:
            rows = {(r[3], r[4]): r for r in held}
            rows = sorted(rows.values(), key=lambda r: (r[4] != r[0], r[3], r[4]))  # the pivot first
            region = Region([unpack(r[5]) for r in rows])
            region.join()
            passed = []
            if rows and rows[0][2] > 1:
                _, d = region.distances(region.sets[0], np.arange(len(rows)))
                passed = [(*r[:5], rows[region._find(i)][4], float(x), r[5]) for i, (r, x) in enumerate(zip(rows, d)) if r[4] != r[0]]
            held.clear()
            return _edges([(rows[i][3:5], rows[j][3:5]) for i, j in region.links], passed) if region.links or passed else None

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if held and held[0][:2] != row[:2]:
                    if (out := joined()) is not None:
                        yield out
                held.append(row)
        if held and (out := joined()) is not None:
            yield out

    dealt = members.repartition("pivot", "piece").sortWithinPartitions("pivot", "piece")
    return dealt.select("pivot", "piece", "pieces", "id", "node", "data").mapInArrow(run, f"{EDGE}, {MEMBER}")


class Piece:
    """The members of one piece, which guests from other pieces are compared with.

    Labels stand for what is connected already: members and guests carry the node that stands for
    their component in their own piece, and a link is worth keeping only if it joins two labels."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        sets = [unpack(r[7]) for r in rows]
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.token, first = np.unique(flat[order], return_index=True)
        self.owner, self.first = owner, np.append(first, len(owner))
        self.away = np.array([r[6] for r in rows])
        self.inner = np.array([r[5] == r[0] for r in rows])
        self.labels, self.label = np.unique([r[5] for r in rows], return_inverse=True)
        self.root = {int(x): int(x) for x in self.labels}
        self.group = self.labels[self.label]  # the root of each member

    def _find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def receive(self, node: int, label: int, away: float, own: np.ndarray, outer: bool) -> list[tuple]:
        """Members that a guest is linked to, one for each component that it joins.  Members that are
        connected with the pivot are always compared, the others only if ``outer``."""
        r, slack = 1 - NUM / DEN, 1e-9
        mine = self._find(label)
        near = (np.abs(self.away - away) <= r + slack) & (self.size >= least_size(len(own))) & (least_size(self.size) <= len(own)) & (self.group != mine)
        if not outer:
            near &= self.inner
        if not near.any():
            return []
        at = np.searchsorted(self.token, own)
        at[at == len(self.token)] = 0
        at = at[self.token[at] == own]
        common = np.bincount(self.owner[spread(self.first[at], self.first[at + 1] - self.first[at])], minlength=len(self.rows))
        out = []
        for i in np.flatnonzero(near & linked(common, self.size, len(own))):
            theirs = self._find(int(self.labels[self.label[i]]))
            if theirs != mine:
                self.root[max(mine, theirs)] = mine = min(mine, theirs)
                out.append(self.rows[i][3:5])
        if out:
            self.group = np.array([self._find(int(x)) for x in self.labels])[self.label]
        return out


def join_across(members: DataFrame) -> DataFrame:
    """Links between pieces of a region.  Members connected with the pivot in their piece are connected
    with each other; the others go to every other piece of the region, where they are compared with
    what the triangle inequality leaves and yield a link for each component that they join: links are
    bounded by components, whatever the number of similar pairs.  Two of the others meet once, in the
    greater of their pieces."""
    sent = members.where("root <> pivot").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).where(F.col("to") != F.col("piece"))
    cols = ["id", "node", "root", "away", "data"]
    rows = members.select("pivot", F.col("piece").alias("to"), F.lit(-1).alias("guest"), *cols).unionByName(sent.select("pivot", "to", F.col("piece").alias("guest"), *cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, piece = None, [], None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if row[:2] != here:
                    here, own, piece = row[:2], [], None
                if row[2] < 0:
                    own.append(row)  # members of the piece come before guests
                elif own:
                    piece = piece or Piece(own)
                    out += [(row[3:5], x) for x in piece.receive(row[4], row[5], row[6], unpack(row[7]), row[2] < row[1])]
            if out:
                yield _edges(out, None).select(["a", "b"])

    dealt = rows.repartition("pivot", "to").sortWithinPartitions("pivot", "to", "guest", "root")
    return dealt.mapInArrow(run, EDGE)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, region: int = REGION) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id (the least key reachable by
    links, its own included)."""
    none = F.lit((1 << 63) - 1)
    return grouped(docs, text, key, k, region).select(F.nullif("id", none).alias(key), "n_shingles", F.nullif("root", none).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, region: int = REGION) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least key, of those with one key
    the one of the least text hash, of equal texts with one key any.  Rows whose text has no words are in
    no group and stay; null keys count as greater than all others; all columns stay, whatever their names."""
    t = F.col(f"`{text}`").cast("string")
    own = [never_null(F.col(f"`{key}`")).alias("id"), F.xxhash64(t).alias("tag")]
    found = grouped(docs, text, key, k, region, tags=True).where("n_shingles > 0").checkpoint()
    same = found.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("many"), F.first("group").alias("group"))
    stays = found.groupBy("group").agg(F.min(F.struct("id", "tag")).alias("least")).select("group", "least.*")
    judged = same.join(stays.select("group", "id", "tag", F.lit(True).alias("stays")), ["group", "id", "tag"], "left").select("id", "tag", "many", F.coalesce("stays", F.lit(False)).alias("stays"))
    joined = docs.select(*own, row_struct(docs).alias("row")).join(judged, ["id", "tag"], "left")
    alone = joined.where("stays is null or (stays and many = 1)").select("row.*")
    return alone.unionByName(joined.where("stays and many > 1").dropDuplicates(["id", "tag"]).select("row.*"))


def grouped(docs: DataFrame, text: str, key: str, k: int, region: int, tags: bool = False) -> DataFrame:
    """(id, tag: a hash of the text, or null unless ``tags``; n_shingles, root: the least key of the group,
    group: what stands for it) of each row."""
    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(never_null(F.col(f"`{key}`")).alias("id"), t.alias("text"), (F.xxhash64(t) if tags else F.lit(None).cast("bigint")).alias("tag"))
    described = describe(rows, k).checkpoint()
    every = described.where("kind = 0")
    info = every.select("id", "tag", "node", "n")
    sketch = sketch_of(described)
    least = info.where("n > 0").groupBy("node").agg(F.min("id").alias("id"))  # equal sets: the least id stands for them
    mapped = every.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("data").alias("data"))
    met = regions(rows, k, sketch).checkpoint()
    size = met.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).withColumn("pieces", F.ceil(F.col("size") / region).cast("int"))
    small = size.where("pieces = 1")
    whole = met.join(small, "pivot", "left_semi").unionByName(small.select("pivot", F.col("pivot").alias("node")))
    kept = keep_plausible(whole.join(mapped, "node")).select("pivot", "node", "id", F.lit(1).alias("pieces"), F.lit(0).alias("piece"))
    large = size.where("pieces > 1")
    member = met.join(large, "pivot").select("pivot", "node", "pieces", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"))
    centre = large.select("pivot", F.col("pivot").alias("node"), "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    cut = member.unionByName(centre).join(least, "node").select("pivot", "node", "id", "pieces", "piece")
    wanted = kept.unionByName(cut).groupBy("id", "node").agg(F.collect_list(F.struct("pivot", "piece", "pieces")).alias("goes"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            nodes = batch.column(2).to_pylist()
            for c in chunks(batch.column(1)):
                h, start = sets_of(c, k)
                ids = node_ids(h, start)
                out += [pack(h[start[i] : start[i + 1]]) if ids[i] == nodes[c.first + i] else None for i in range(c.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.binary())], names=["id", "node", "goes", "data"])

    loaded = rows.join(wanted, "id").select("id", "text", "node", "goes").mapInArrow(load, "id bigint, node bigint, goes array<struct<pivot:bigint,piece:int,pieces:int>>, data binary")
    members = loaded.where(F.col("data").isNotNull()).select("id", "node", "data", F.inline("goes"))
    found = join_pieces(members).checkpoint()
    links = found.where(F.col("a").isNotNull()).select("a", "b")
    large = found.where(F.col("pivot").isNotNull()).drop("a", "b")
    if not large.isEmpty():
        links = links.unionByName(join_across(large))
    comp = components(links, "a", "b").select(F.col("node.node").alias("node"), F.col("root.id").alias("root"), F.col("root.node").alias("group"))
    out = info.join(least.withColumnRenamed("id", "own"), "node", "left").join(comp, "node", "left")
    return out.select("id", "tag", F.col("n").alias("n_shingles"), F.coalesce("root", "own", "id").alias("root"), F.coalesce("group", "node").alias("group"))
