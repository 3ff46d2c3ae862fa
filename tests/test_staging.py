"""Where iterations write what they must not lose."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark import staging


def session(master, folder=None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda name, default=None: settings.get(name, default), set=settings.__setitem__)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda name: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(session(master))
    assert staging.shared_folder(session(master, "hdfs://x/y")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_process_takes_a_folder_of_its_own(master):
    spark = session(master)
    assert staging.shared_folder(spark) == staging.shared_folder(spark)


def test_written_tables_are_read_again(spark):
    df = spark.range(10).withColumnRenamed("id", "a b")
    out = staging.written(df, "numbers")
    assert out.columns == ["a b"] and out.count() == 10
    assert "FileScan" in out._jdf.queryExecution().executedPlan().toString()


def test_released_tables_are_gone(spark):
    one, two = staging.written(spark.range(3), "one"), staging.written(spark.range(4), "two")
    paths = staging.held(spark)[-2:]
    assert all(any(path.rpartition("/")[2] in file for file in df.inputFiles()) for path, df in zip(paths, (one, two), strict=True))
    staging.release(spark, paths[:1])
    assert paths[0] not in staging.held(spark) and two.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST"):
        one.collect()


def test_discarded_tables_are_gone(spark):
    one, two = staging.written(spark.range(3), "one"), staging.written(spark.range(4), "two")
    paths = staging.held(spark)[-2:]
    staging.discard(one)
    assert paths[0] not in staging.held(spark) and paths[1] in staging.held(spark) and two.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST"):
        one.collect()


def test_only_a_table_as_it_was_read_tells_its_files(spark):
    table = staging.written(spark.range(3), "table")
    assert staging.reads_only(table) == table.inputFiles()
    assert staging.reads_only(table.where("id > 1")) is None
    assert staging.reads_only(table.join(table.withColumnRenamed("id", "b"), F.col("id") == F.col("b"))) is None
