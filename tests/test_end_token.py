"""A last word whose hash is the end token's id is still followed by the end token."""

import zlib

import pytest

from loomspark.plans import oracle, queries

#: Words whose crc32 is 2 modulo 32000, as they end documents of the larger tables; the last ones are their likes modulo 31997.
ENDS = ["thsheswh.", "ofaninshor.", "begever.", "edstor."]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    assert all(zlib.crc32(w.encode()) % 32000 == 2 for w in ENDS)
    near = [w for w in (f"w{i}" for i in range(300000)) if zlib.crc32(w.encode()) % 31997 in (0, 1, 2, 31996)]
    texts = [" ".join(["word"] * n + [w]) for w in ENDS + near for n in (0, 5, 7, 253, 254, 255)]
    path = str(tmp_path_factory.mktemp("ends"))
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def check(spark, path, name):
    import duckdb

    got = queries.queries()[name](spark, path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({oracle.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_mask_labels(spark, tables):
    check(spark, tables, "mask_labels")


def test_padded_batches(spark, tables):
    check(spark, tables, "padded_batches")


def test_truncated_rows(spark, tables):
    check(spark, tables, "truncated_rows")
