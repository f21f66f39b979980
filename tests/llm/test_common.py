import pyarrow as pa
from pyspark.sql import types as T

from lumiframe.llm import common


def test_batches_are_bounded(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, left in (("256m", str(common.BATCH_BYTES)), ("1m", "1m"), ("1g", str(common.BATCH_BYTES)), ("512", "512")):
        spark.conf.set(size, given)
        common.bounded_batches(spark)
        assert spark.conf.get(size) == left
    spark.conf.unset(size)
    spark.conf.unset(rows)
    common.bounded_batches(spark)
    assert spark.conf.get(rows) == str(common.BATCH_ROWS) and spark.conf.get(size) == str(common.BATCH_BYTES)


def test_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a", [1, 2], None), (2, None, None, "x")], "k int, t string, l array<int>, n string")
    make = lambda: lambda t: [pa.array([len(x) for x in common.text_bytes(t)])]
    out = common.with_columns_from(df, ["t"], make, [T.StructField("n", T.LongType())])
    assert out.columns == ["k", "t", "l", "n"] and [tuple(r) for r in out.orderBy("k").collect()] == [(1, "a", [1, 2], 1), (2, None, None, 0)]


def test_written_tables(spark):
    df = common.materialize(spark.range(5), "t")
    assert df.count() == 5 and df.columns == ["id"]
    common.discard(df)
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_shared_folders_are_asked_for_on_clusters(spark, monkeypatch):
    import pytest

    from lumiframe.operators import iterate

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        iterate.shared_dir(Session())


def test_shuffle_files_go_with_the_plan(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    common.materialize(spark.range(100).repartition(3), "t")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
