"""Tables that a job keeps while it runs, in the folder that driver and executors share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all tasks run in the driver's
    own process, one of our own; on a cluster without it, ValueError."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = tempfile.mkdtemp(prefix="daytable-")
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dropped(spark: SparkSession, path: str) -> None:
    """The folder of a table that nothing reads any more is deleted."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
