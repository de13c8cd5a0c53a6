"""A store of results in batches: each is written once, committed by a rename, and read only then.

A batch is a folder of Parquet files under ``data`` and one JSON file under ``manifest`` that names the folder and what is in it:
rows, and for each class rows, bases and scores. The manifest file comes into its place by a rename that fails if there is one,
so of two writers of a batch one commits, and a batch that is written again after a crash adds nothing. Folders without a
manifest are what crashed writers left: no reader sees them, and ``clean`` removes them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = "array<struct<class: string, n: long, bases: long, scored: long, score: double>>"
MANIFEST = f"batch string, folder string, rows long, classes {CLASSES}"


class ResultStore:
    """Motif tables (with class; length and score if they have them) under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.=-]+", batch, re.A) or batch.startswith((".", "_")):
            raise ValueError(f"a batch's name is of letters, digits and -_.=, not {batch!r}")
        return f"{self.path}/manifest/{batch}.json"

    def committed(self, batch: str) -> bool:
        return self._files.exists(self._path(self._manifest(batch)))

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add a batch; False, and nothing added, if one of that name is there. rows is computed once."""
        place = self._manifest(batch)
        if self.committed(batch):
            return False
        folder = f"{batch}.{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        held = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{folder}")
        number = lambda c, t: F.col(c).cast(t) if c in held.columns else F.lit(None).cast(t)
        sums = held.groupBy("class").agg(F.count("*").alias("n"), F.coalesce(F.sum(number("length", "long")), F.lit(0)).alias("bases"), F.count(number("score", "double")).alias("scored"), F.coalesce(F.sum(number("score", "double")), F.lit(0.0)).alias("score"))
        classes = [r.asDict() for r in sums.orderBy("class").collect()]  # a row a class
        about = {"batch": batch, "folder": folder, "rows": sum(c["n"] for c in classes), "classes": classes}
        waiting = self._path(f"{self.path}/waiting/{folder}.json")
        out = self._files.create(waiting, False)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        self._files.mkdirs(self._path(f"{self.path}/manifest"))
        if not self.committed(batch) and self._files.rename(waiting, self._path(place)):
            return True
        self._files.delete(waiting, False)
        self._files.delete(self._path(f"{self.path}/data/{folder}"), True)
        return False

    def batches(self) -> DataFrame:
        """(batch, folder, rows, classes): what is committed, from the manifests alone."""
        if not self._files.exists(self._path(f"{self.path}/manifest")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    def summary(self) -> DataFrame:
        """(class, n, bases, mean_score) of all batches, from the manifests alone."""
        each = self.batches().select(F.explode("classes").alias("c")).select("c.*")
        return each.groupBy("class").agg(F.sum("n").alias("n"), F.sum("bases").alias("bases"), F.round(F.sum("score") / F.nullif(F.sum("scored"), F.lit(0)), 6).alias("mean_score"))

    def read(self, batches: list[str] | None = None) -> DataFrame:
        """The committed rows, with their ``batch``; of some batches only, if given."""
        found = [(r["batch"], r["folder"]) for r in self.batches().select("batch", "folder").collect() if batches is None or r["batch"] in batches]  # a row a batch
        if not found:
            raise ValueError(f"nothing committed at {self.path}")
        rows = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/data/{folder}" for _, folder in found))
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.withColumn("batch", F.regexp_replace(folder, r"\.[0-9a-f]{32}$", ""))

    def first(self, n: int) -> DataFrame:
        """n rows for display, from as few batches as have so many."""
        some, held = [], 0
        for r in self.batches().select("batch", "rows").orderBy("batch").collect():  # a row a batch
            if held >= n:
                break
            some.append(r["batch"])
            held += r["rows"]
        return self.read(some).limit(n)

    def remove(self, batch: str) -> bool:
        """Take a batch out: the manifest goes first, so no reader sees half of it."""
        found = self.batches().filter(F.col("batch") == batch).select("folder").collect()
        if not found or not self._files.delete(self._path(self._manifest(batch)), False):
            return False
        return self._files.delete(self._path(f"{self.path}/data/{found[0]['folder']}"), True)

    def clean(self) -> int:
        """Remove what crashed writers left, when no writer is at work; how many folders."""
        held = {r["folder"] for r in self.batches().select("folder").collect()}
        self._files.delete(self._path(f"{self.path}/waiting"), True)
        data = self._path(f"{self.path}/data")
        left = [s.getPath() for s in self._files.listStatus(data) if s.getPath().getName() not in held] if self._files.exists(data) else []
        for path in left:
            self._files.delete(path, True)
        return len(left)


def append_batches(store: ResultStore, name: str, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every micro-batch becomes a batch <name>-<number>, once, however often it is tried."""

    def write(rows: DataFrame, number: int) -> None:
        store.append(of(rows), f"{name}-{number:09d}")

    return write
