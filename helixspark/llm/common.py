"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower case of A-Z, for translate(): other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A whole table. One in fewer partitions than the cluster has cores (a single small file) is dealt out evenly."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """Deal a plain scan out to all cores if it has fewer partitions than there are cores."""
    want = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(want) if scan.rdd.getNumPartitions() < want else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets one of its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="helixspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, row_check: int = 100) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Unlike a cache, the files outlive a lost executor. They are removed when the driver's Python ends. row_check: after how
    many rows a writer looks at how much it holds; few for rows of megabytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixspark/{uuid.uuid4().hex}"
    df.write.option("parquet.page.size.row.check.min", row_check).option("parquet.block.size.row.check.min", row_check).parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(written: DataFrame) -> None:
    """Remove a table of materialize that nothing reads any more."""
    _remove(written.sparkSession, written._written_at)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and with it its files' file system
            return


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, read: int | None = None) -> Iterator[None]:
    """Jobs run inside send Python workers batches of so many rows at most: for rows of many megabytes. ``read``: and read so many from Parquet at once."""
    values = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.parquet.columnarReaderBatchSize": read} if read else {})
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: a worker then holds the Python objects of few texts at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
