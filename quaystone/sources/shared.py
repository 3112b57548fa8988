"""New folders on storage that the driver and all executors share: under ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet. Where ``spark.checkpoint.dir`` is unset, a temporary folder on a local master, an error elsewhere."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='quaystone-')).rstrip('/')}/quaystone/{uuid.uuid4().hex}/{name}"


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as Python opens it, on the driver and in tasks, if it lies in a local (or mounted) file system; else None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toUri().getPath() if system.getUri().getScheme() == "file" else None
