"""Tables written in the folder that all executors share, to cut the lineage of iterations."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


_held: dict[str, list[str]] = {}  # by application


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the session runs in one process, as in tests, a folder of its
    own takes its place; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.getParent())
    files.deleteOnExit(hadoop.getParent())
    _held.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def held(spark: SparkSession) -> list[str]:
    """The places made in this application and not yet released."""
    return list(_held.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete what was written at ``paths``; nothing may read it any more."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        _held[spark.sparkContext.applicationId].remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` returned as ``tables``; nothing may read it any more."""
    for table in tables:
        folders = {file.rpartition("/")[0].rpartition("/")[2] for file in table.inputFiles()}
        release(table.sparkSession, [path for path in held(table.sparkSession) if path.rpartition("/")[2] in folders])


def reads_only(df: DataFrame) -> list[str] | None:
    """The files of a frame that is a table as it was read; None for any other plan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return df.inputFiles() if plan.children().isEmpty() else None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: a lost executor loses none of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
