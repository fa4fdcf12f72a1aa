"""Scratch tables and folders below the one the cluster names in ``spark.checkpoint.dir``.

Only a local session without that setting gets a temporary folder of its own. What a driver
made is removed when it ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder name below the shared folder that nothing uses yet; removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return [status.getPath().getName() for status in found if status.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    """Remove what this driver made: through Spark while it runs, else through the file system of the folder."""
    spark = SparkSession.getActiveSession()
    for path in _MADE:
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                remove(spark, path)
            else:
                from pyarrow import fs

                place, root = fs.FileSystem.from_uri(path)
                place.delete_dir(root)
        except Exception:  # scratch space; the folder or its store may be gone by now
            continue
