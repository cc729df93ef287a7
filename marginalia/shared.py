"""The folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_scratch: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, a temporary one of ours, but only if
    all executors run on this machine; on a cluster that is an error, as each would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master or 'unknown'}")
        path = tempfile.mkdtemp(prefix="marginalia-")
        base = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one. It is deleted when Python ends, with all that is left in it; one that a
    killed driver leaves behind carries the application's id."""
    path = f"{shared_dir(spark)}/marginalia/{spark.sparkContext.applicationId}"
    if path not in _scratch:
        if not _scratch:
            atexit.register(_clear)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _scratch[path] = (where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def _clear() -> None:
    for where, system in _scratch.values():
        try:
            system.delete(where, True)
        except Exception:  # the JVM is gone before us
            pass
    _scratch.clear()
