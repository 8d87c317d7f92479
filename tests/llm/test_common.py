"""Joins that spread hot keys, written tables, and where they lie."""

import os

import pyarrow.dataset
import pytest

from ledgerframe.llm import common


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("small, share", [(100, 10), (2, 10), (0, 2), (0, 1000)])
def test_join_heads_equals_a_plain_join(spark, how, small, share):
    rows = [("hot" if i % 3 else f"k{i % 7}", i % 2, i) for i in range(200)] + [(None, 1, 500), ("k1", None, 501), ("none", 0, 502)]
    df = spark.createDataFrame(rows, "a string, b int, id int")
    heads = df.where("a <> 'none'").groupBy("a", "b").count().withColumnRenamed("count", "n").selectExpr("a", "b", "n", "concat(a, b) AS x")
    got = common.join_heads(df, heads, ["a", "b"], how=how, small=small, share=share)
    want = df.join(heads.drop("n"), ["a", "b"], how)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select("a", "b", "id", "x").collect())) == sorted(map(str, want.select("a", "b", "id", "x").collect()))


def test_written_tables_can_be_released(spark):
    one = common.materialize(spark.range(5))
    path = one._written_to
    assert one.count() == 5 and spark.sparkContext.applicationId in path and os.path.isdir(path.removeprefix("file:"))
    common.release(one.select("id"))
    assert os.path.isdir(path.removeprefix("file:"))
    common.release(one)
    assert not os.path.isdir(path.removeprefix("file:"))


def groups(path):
    """Bytes of all row groups of a written table."""
    return [g.total_byte_size for f in pyarrow.dataset.dataset(path.removeprefix("file:"), format="parquet").get_fragments() for g in f.row_groups]


def test_written_tables_have_bounded_row_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "ROW_GROUP", 200_000, raising=False)
    df = spark.range(0, 30_000, 1, 1).selectExpr("id", "sha2(string(id), 256) AS text")  # 2 MB
    found = groups(common.materialize(df)._written_to)
    assert len(found) > 5 and max(found) < 400_000


def test_a_callers_own_row_group_size_stays(spark):
    session = spark.newSession()
    common.bound_row_groups(session.range(1))
    assert session.conf.get("parquet.block.size") == str(common.ROW_GROUP)
    for key in ("parquet.block.size", "spark.hadoop.parquet.block.size"):
        other = spark.newSession()
        other.conf.set(key, "5000000")
        common.bound_row_groups(other.range(1))
        assert other.conf.get(key) == "5000000" and other.conf.get("parquet.block.size", "5000000") == "5000000"


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
