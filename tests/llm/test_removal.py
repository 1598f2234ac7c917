"""Rows taken out by key, and space given back."""

import pytest

from readtrace.llm.common import dropped, prepared, stash, without


@pytest.mark.parametrize("held", [500_000, 5])
def test_rows_without_keys(spark, held):
    prepared(spark)
    for kind in ("long", "string"):
        df = spark.range(2000).selectExpr(f"cast(if(id % 100 = 7, null, id) as {kind}) AS doc_id", "id AS _lane", "'x' AS _bits")
        gone = spark.range(0, 3000, 3).selectExpr(f"cast(id as {kind}) AS doc_id").union(spark.sql(f"SELECT cast(null as {kind})"))
        left = without(df, "doc_id", gone, held)
        assert left.columns == df.columns
        rows = [r.doc_id for r in left.collect()]
        assert rows.count(None) == 20 and sorted(int(r) for r in rows if r is not None) == [i for i in range(2000) if i % 3 and i % 100 != 7]
        assert without(df, "doc_id", gone.limit(0), held).count() == 2000
        assert without(df.limit(0), "doc_id", gone, held).count() == 0


def test_dropped_stash_is_empty(spark):
    df = stash(spark.range(100).toDF("v"), "some")
    folder = df.inputFiles()[0].rpartition("/")[0]
    dropped(df)
    assert spark.read.schema("v long").parquet(folder).count() == 0


def test_windows_take_texts_in_pieces():
    from readtrace.llm import templates
    texts = ["a" * 400_000, None, "", "b" * 700_000, "c" * 5_000_000, "d", "e" * 999_999]
    pieces = list(templates._pieces(list(range(7)), texts))
    assert [i for keys, _ in pieces for i in keys] == list(range(7)) and [t for _, held in pieces for t in held] == texts
    assert all(len(held) == 1 or sum(len(t or "") for t in held) <= templates.CHARS for _, held in pieces) and len(pieces) == 4
    assert list(templates._pieces([], [])) == []
