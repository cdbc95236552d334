"""Shared-folder scratch tables: cut lineage without machine-local files.

Intermediate results are Parquet tables below the folder named by
``spark.checkpoint.dir`` (shared by the driver and every executor), so a lost
executor costs a re-read and never a recomputation of the stages before.  The
tables are registered with Hadoop's ``deleteOnExit`` of the driver.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is named, a session that is one process (``local[...]``, as in tests) gets a temporary one; on a
    cluster, whose executors would each write to a folder of their own, that is an error.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="glyphflow-scratch-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/glyphflow/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more.

    The shuffle files that made them go when the driver's garbage is collected, so that is asked for.
    """
    for df in tables:
        path = df.__dict__.pop("_scratch", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
            context._jvm.System.gc()
