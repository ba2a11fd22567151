import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, tag string, size string, score string, h string, label string"


def words(rng, n, stock):
    return [rng.choice(stock) for _ in range(n)]


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    """Texts with exact and near copies, shared passages, repeated rows, nulls and odd cases."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(words(rng, 70, stock))
    base = words(rng, 150, stock)
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        w = words(rng, rng.randint(20, 200), stock)
        if i % 6 == 1:
            at = rng.randrange(len(w))
            w[at:at] = passage.split()
        if i % 6 == 2:
            w = list(base)
            for _ in range(rng.randint(1, 9)):
                w[rng.randrange(len(w))] = rng.choice(stock)
        text = " ".join(w)
        if i % 10 == 3:
            text = text.replace(" ", "\n", 5).upper()
        out.append((i, text))
    out += [(n, out[5][1]), (n + 1, out[5][1]), (n + 2, out[2][1])]
    out += [(n + 3, None), (n + 4, ""), (n + 5, " \n\t "), (n + 6, "one"), (n + 7, "three short words"), (n + 8, "one"), (n + 9, "é ü 漢字 🎉 " * 40), (n + 10, "a" * 3000), (n + 11, "same words " * 300), (n + 12, "12345 !!! ###")]
    out += [(None, out[1][1]), (None, "text without an id " * 20)]
    out += [(n + 20, " ".join(words(rng, 12000, stock)))]
    out += [out[4], out[4]]  # repeated rows
    langs, sources = ["en", "de", None], ["a", "b", "ß", None]
    return [(i, t, langs[k % 3], sources[k % 4], len(t or ""), "x", "y", "z", "s", "h", "l") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
