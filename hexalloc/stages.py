"""Cuts in a plan: results kept in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's; where neither is set, a local folder
    that serves a single machine only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written below the shared folder, without what led to them: plans stay as small as a
    single step, and a lost executor costs no more than what it was writing."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_made: dict[tuple, str] = {}


def once(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries start from: written by the first of an application, and read by
    the others as long as the files that it was made from are the same."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def state(path: str) -> tuple:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        files = fs.listStatus(p)
        return path, *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)

    key = (spark.sparkContext.applicationId, name, *map(state, inputs))
    if key not in _made:
        path = scratch(spark, name)
        make().write.parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])
