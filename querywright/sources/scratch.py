"""Folders for tables that live as long as the driver."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, deleted when the driver ends.

    It lies in ``spark.checkpoint.dir``, or else, off one machine, in the warehouse; a
    session in one process takes a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = "file://" + tempfile.gettempdir()
    path = f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/querywright-scratch/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
