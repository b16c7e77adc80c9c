"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder for one run's files, below the cluster's ``spark.checkpoint.dir``. It goes when the session's JVM ends.

    Where that setting is absent a single machine uses a temporary folder of its own; on a cluster, whose machines would not
    see each other's, that raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="triago-"))
        base = context.getCheckpointDir()
    out = f"{base.rstrip('/')}/triago-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: its lineage ends there, so a lost executor
    costs a re-read and not a recomputation, and its size is known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
