import importlib
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_core_does_not_use_the_text_package():
    from pathlib import Path

    root = Path(entry.__file__).parent / "ballotlens"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "ballotlens.llm" not in p.read_text(), p


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns[:3] == ["contest_id", "winner", "loser"] and rows.count() > 0


def test_scratch(spark):
    scratch = importlib.import_module("ballotlens.scratch")
    df = scratch.written(spark.createDataFrame([], "a int, b string"), "none")
    assert df.count() == 0 and df.columns == ["a", "b"]
    path = scratch.new_path(spark, "x")
    assert spark.sparkContext.applicationId in path
    spark.range(3).write.parquet(path)
    scratch.drop_all(spark)
    assert not os.path.exists(path.removeprefix("file://"))
