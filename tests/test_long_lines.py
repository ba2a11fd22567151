"""Lines of over 3000 words, whose cells have ids of the next line's cells, against the SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def long_lines(tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    text = " ".join(f"word{i % 97}" for i in range(3200)) + "\nthe next line of words\nand one more"
    docs = {"doc_id": list(range(8)), "text": [text, "a short one", None, "x", text.upper(), "y", "one line\nanother", text], "lang": ["en"] * 8, "source": ["web"] * 8, "n_chars": [1] * 8}
    pq.write_table(pa.table(docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), path / "documents.parquet")
    return path


@pytest.mark.parametrize("name", ["G19_document_verdicts", "J22_band_margin"])
def test_cells_of_the_same_id(spark, long_lines, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{long_lines}/documents.parquet'")
    got = QUERIES[name](spark, f"file://{long_lines}").toPandas()
    want = duck.sql(ORACLE[name]).df()[list(got.columns)]
    plain = lambda d: sorted(tuple(None if x != x else x for x in r) for r in d.astype(object).itertuples(index=False))
    assert sorted(map(repr, plain(got))) == sorted(map(repr, plain(want)))
