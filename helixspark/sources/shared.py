"""Tables of a running job in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder of any file system that Spark knows; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove_folder(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and with it its files' file system
            return


def scratch(spark: SparkSession) -> str:
    """A new folder name where driver and executors can both write: below spark.checkpoint.dir; only a local session may lack it.

    It is removed when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, f"{root.rstrip('/')}/helixspark/{uuid.uuid4().hex}"))
    return _made[-1][1]


def written(df: DataFrame) -> DataFrame:
    """df as a written table: computed once, whoever reads it, and there after an executor is lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
