"""A quality classifier by compression.

Two Zstandard dictionaries are built from texts labelled good and bad.  A text is
compressed with each; the difference of the two sizes, as a share of the text's own
size, says which kind of text it is like.  Logistic regression on labelled texts
that the dictionaries haven't seen turns it into a probability, together with the
sizes' ratio to the text (how repetitive it is).

What is gathered on the driver is bounded by ``FIT_ROWS`` labelled texts and ``FIT_BYTES`` bytes
of each class, texts whole and in hash order; labelled texts of more than ``FIT_LONGEST`` bytes
are not learned from.  Both bounds are applied to keys and lengths, before any text moves.

Defined results: null and empty texts get the score of features 0; repeated rows are scored alike;
rows of one key are each learned from; a key with both labels counts for both; an empty table gives an
empty result; without texts of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 1500
FIT_BYTES = 16 << 20
FIT_LONGEST = 1 << 18
DICTIONARY_BYTES = 112 << 10
LEVEL = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: np.ndarray  # of [1, *features]


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the texts; of their plain bytes where there are too few to train one."""
    import zstandard

    pieces = [t[i : i + 4096] for t in texts for i in range(0, len(t), 4096)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes() if len(pieces) >= 16 else b"".join(pieces)[-size:]
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


class Sizes:
    """Compressed sizes of a text with either dictionary and with none."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(d: bytes | None):
            held = None if not d else zstandard.ZstdCompressionDict(d)
            if held:
                held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.all = [compressor(good), compressor(bad), compressor(None)]

    def features(self, text: str | None) -> list[float]:
        data = (text or "").encode()
        if not data:
            return [0.0, 0.0, 0.0]
        good, bad, own = (len(c.compress(data)) for c in self.all)
        n = len(data)
        return [20 * (bad - good) / (good + bad), 4 * (own - (good + bad) / 2) / n, 4 * own / n]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, classes weighing alike in the slopes
    and the base rate put back in the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chosen(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, rows: int, bytes_: int, longest: int) -> list[list[str]]:
    """Texts of label 1 and of label 0 to learn from, in hash order of their keys."""
    spark, out = docs.sparkSession, []
    t = F.col(f"`{text}`").cast("string")
    for k in (1, 0):
        own = labels.where((F.col(label) == k) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(F.col(key).cast("string")).alias("h")).distinct()
        some = F.broadcast(own.orderBy("h", "k").limit(rows))  # at most ``rows`` keys
        sizes = docs.select(F.col(f"`{key}`").alias("k"), F.octet_length(t).alias("n"), F.xxhash64(t).alias("x")).where(F.col("n") <= longest)
        sizes = sizes.join(some, "k").orderBy("h", "k", "x").limit(rows)
        taken, total = [], 0
        for r in sizes.collect():  # keys and lengths of at most ``rows`` texts
            if total + r.n <= bytes_:
                total += r.n
                taken.append((r.k, r.x))
        if not taken:
            out.append([])
            continue
        kind = docs.schema[key].dataType.simpleString()
        wanted = F.broadcast(spark.createDataFrame(sorted(set(taken)), f"k {kind}, x bigint"))
        found = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(t).alias("x"), t.alias("t")).join(wanted, ["k", "x"])
        out.append([r.t for r in found.orderBy(F.xxhash64(F.col("k").cast("string")), "k", "x").limit(rows).collect()])
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", rows: int = FIT_ROWS, bytes_: int = FIT_BYTES, longest: int = FIT_LONGEST) -> Model:
    """A model from ``docs(key, text)`` and ``labels(key, label)``, labels 0 or 1.  Of three in four of the
    texts of a class the dictionary is built; with the rest the score is calibrated."""
    good_bad = chosen(docs, labels, text, label, key, rows, bytes_, longest)
    good, bad = good_bad
    build = [[t.encode() for i, t in enumerate(c) if i % 4 != 3] for c in good_bad]
    dictionaries = [build_dictionary(b) for b in build]
    held = [(t, 1) for i, t in enumerate(good) if i % 4 == 3] + [(t, 0) for i, t in enumerate(bad) if i % 4 == 3]
    y = np.array([v for _, v in held], float)
    if not len(y) or y.min() == y.max():
        p = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return Model(*dictionaries, np.array([np.log(p / (1 - p)), 0.0, 0.0, 0.0]))
    sizes = Sizes(*dictionaries)
    return Model(*dictionaries, fit_logistic(np.array([sizes.features(t) for t, _ in held]), y))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted, which take the place of columns of these names."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries, of DICTIONARY_BYTES at most

    @F.arrow_udf("double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        sizes = Sizes(m.good, m.bad)
        for texts in batches:
            x = np.array([sizes.features(t.as_py()) for t in texts]).reshape(-1, 3)
            yield pa.array(1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30))))

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    made = docs.select(F.struct(*others).alias("row"), predict(F.col(f"`{text}`")).alias("score"))
    return made.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
