"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset: below the warehouse on a cluster, else a folder of this machine.

    What is written there is removed when Python ends with its session alive.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            folder = tempfile.mkdtemp(prefix="strandlog-") if alone else spark.conf.get("spark.sql.warehouse.dir") + "/_strandlog"
        sc.setCheckpointDir(folder)
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    _made.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
