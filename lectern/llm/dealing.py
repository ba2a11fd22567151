"""Dealing packed rows out to tasks, and components of links, for the operators here."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_int(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of an int: murmur3, seed 42."""
    with np.errstate(over="ignore"):
        rot = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
        k = rot(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rot(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


@lru_cache(maxsize=8)
def even_keys(parts: int) -> np.ndarray:
    """An int for each of ``parts`` partitions that hash partitioning sends there, so that
    packed rows keyed by them are dealt evenly."""
    found = np.full(parts, -1, np.int32)
    start, size = 0, max(1024, parts * 16)
    while (found < 0).any():
        x = np.arange(start, start + size, dtype=np.int32)
        p = hash_int(x).astype(np.int64) % parts
        for k in range(len(x) - 1, -1, -1) if parts <= 4096 else ():
            if found[p[k]] < 0:
                found[p[k]] = x[k]
        if parts > 4096:
            u, at = np.unique(p, return_index=True)
            new = found[u] < 0
            found[u[new]] = x[at[new]]
        start += size
    return found


#: bytes of input that one task's share of packed tuples may come from
PART_BYTES = 64 << 20


def partitions(df: DataFrame) -> int:
    """How many tasks tuples are dealt to: what is configured, more where the tables that ``df`` reads
    (as far as their size is known) are too large for that many."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // PART_BYTES)


def input_bytes(df: DataFrame) -> int:
    """The size of the tables that ``df`` reads; 0 if it is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return size if size < 1 << 60 else 0


#: py4j's thread lets go of Java objects that Python has dropped after a second at most
DETACHED_S = 1.2


def freed(checkpoint: DataFrame) -> DataFrame:
    """The same; what was shuffled for it goes from the executors' disks.  They keep it until the driver happens to
    collect its garbage, and later steps need the room."""
    sc = checkpoint.sparkSession.sparkContext
    for _ in range(2):  # what an object held that went in the first
        sc._jsc.sc().listenerBus().waitUntilEmpty()  # events hold the plans that they tell of
        gc.collect()
        time.sleep(DETACHED_S)
        sc._jvm.System.gc()
    return checkpoint


def _lineage(df: DataFrame) -> Iterator:
    """The RDDs that the executed plan of ``df`` stands on, and their dependencies, in turn."""
    seen, open_ = set(), [df._jdf.queryExecution().toRdd()]
    while open_:
        rdd = open_.pop()
        if rdd.id() not in seen:
            seen.add(rdd.id())
            deps = rdd.dependencies()
            deps = [deps.apply(i) for i in range(deps.size())]
            yield rdd, deps
            open_ += [d.rdd() for d in deps]


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint.  What was shuffled for it goes from the executors' disks at once, as nothing reads it
    again; what had been shuffled before stays."""
    sc = df.sparkSession.sparkContext._jsc.sc()
    since, out = sc.newShuffleId(), df.checkpoint()
    if (cleaner := sc.cleaner()).isDefined():
        for own in {d.shuffleId() for _, deps in _lineage(df) for d in deps if d.getClass().getSimpleName() == "ShuffleDependency"}:
            if own >= since:
                cleaner.get().doCleanupShuffle(own, True)
    return out


def dropped(checkpoint: DataFrame) -> None:
    """Nothing reads the checkpoint again: its files go."""
    spark = checkpoint.sparkSession
    for rdd, _ in _lineage(checkpoint):
        if rdd.isCheckpointed() and (file := rdd.getCheckpointFile()).isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_struct(df: DataFrame) -> Column:
    """All columns as one, so that names of a caller's columns clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def components(links: DataFrame, low: str = "low", high: str = "high", rounds: int = 40) -> DataFrame:
    """(node, root): the least node reachable by ``links``, for every node that has one.

    Large and small stars in turn: each node's greater neighbours, then the lesser ones, are linked
    to its least neighbour, until all links point to roots.  Only links are shuffled, minima are
    taken within tasks first, and every round is cut off by a checkpoint."""
    lo, hi = F.least(low, high), F.greatest(low, high)
    edges = links.select(lo.alias("u"), hi.alias("v")).where(F.col("u") != F.col("v")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        # large star: v > u goes to the least neighbour of u (or u)
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("u"), F.col("b").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: what is under v, and v, goes to the least under v
        low_of = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low_of, "v")
        small = joined.where(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low_of.select(F.col("m").alias("u"), "v"))
        edges = small.distinct().checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()


def never_null(key: Column) -> Column:
    """A key of type bigint that nulls come last in."""
    return F.coalesce(key.cast("bigint"), F.lit((1 << 63) - 1))


def packed_by(part: np.ndarray, keys: np.ndarray, tuples: np.ndarray) -> pa.RecordBatch:
    """(part, data): tuples packed by the part that each goes to."""
    order = np.argsort(part, kind="stable")
    part, tuples = part[order], tuples[order]
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    rows = [(int(keys[part[a]]), tuples[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])


def document_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of each tuple, by its document."""
    return (x["tag"].view(np.uint64) % np.uint64(parts)).astype(np.int64)


def by_document(packed: DataFrame, dtype: np.dtype, parts: int, unpack: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(id, tag, data): all tuples of each document in one row, in order, whatever tasks they came from.
    ``packed`` has (part, data) by ``document_parts`` of ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [unpack(d) for batch in batches for d in batch.column(1).to_pylist()]
        x = np.concatenate(x) if x else np.empty(0, dtype)
        if not len(x):
            return
        x = x[np.lexsort([x[f] for f in reversed(dtype.names)])]
        new = (x["id"][1:] != x["id"][:-1]) | (x["tag"][1:] != x["tag"][:-1])
        cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(x)]])
        for at in range(0, len(cut) - 1, 4096):
            some = [(int(a), int(b)) for a, b in zip(cut[at : at + 4096], cut[at + 1 : at + 4097])]
            first = [a for a, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(x["id"][first]), pa.array(x["tag"][first]), pa.array([x[a:b].tobytes() for a, b in some], pa.binary())], names=["id", "tag", "data"])

    return packed.repartition(parts, "part").mapInArrow(run, "id bigint, tag bigint, data binary")
