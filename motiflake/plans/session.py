"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (a no-op where PYTHONPATH has it)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir), removed when the session ends. Where that is
    unset, a folder of our own in local mode, an error on a cluster, whose executors don't see one another's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="motiflake-")
        spark.sparkContext.setCheckpointDir(found)
    out = f"{found}/motiflake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


#: Bytes of a table that is read again in parts if its files are fewer than the cores.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """`df`, or if it is read from fewer files than there are cores and is small, its rows dealt to all cores: a file's rows
    may be in one task otherwise. Large tables have splits enough and are left alone."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL and len(df.inputFiles()) < cores else df
