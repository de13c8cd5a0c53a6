"""Streams of sequences: each arrives whole, so a batch is scanned like a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.reports import batch_co_occurrence
from ..operators.series import binned
from ..plans.scan import scan
from ..sources.results import ResultStore


def stream_sequences(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files (seq_id, seq) that arrive in a folder."""
    return spark.readStream.schema("seq_id string, seq string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scan_stream(seqs: DataFrame, out: str, checkpoint: str, classes: Iterable[str] | None = None) -> StreamingQuery:
    """Scans every batch of new sequences; a batch that is run again replaces its own folder, so none counts twice."""

    def batch(rows: DataFrame, number: int) -> None:
        scan(rows, classes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return seqs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(motifs: DataFrame) -> DataFrame:
    """Counts by class and subclass of a stream of motifs, for the update or complete mode: state has a row per subclass."""
    return motifs.groupBy("class", "subclass").agg(F.count("*").alias("n"), F.sum("length").alias("sum_length"))


PARTIAL = "kind string, class string, other string, what string, bin long, n long"


def partial_counts(motifs: DataFrame, length: int, bins: int = 100) -> DataFrame:
    """(kind, class, other, what, bin, n): what one batch of whole sequences adds to the accumulated tables.

    kind "bins": histograms of starts and lengths for each class; "pairs": in how many sequences two classes occur; "sums": rows and bases.
    """
    none = lambda t: F.lit(None).cast(t)
    parts = [binned(motifs, length, bins, by=("class",)).select(F.lit("bins").alias("kind"), "class", none("string").alias("other"), "what", F.col("bin").cast("long").alias("bin"), "n")]
    parts.append(batch_co_occurrence(motifs).select(F.lit("pairs").alias("kind"), F.col("class_a").alias("class"), F.col("class_b").alias("other"), none("string").alias("what"), none("long").alias("bin"), "n"))
    sums = motifs.groupBy("class").agg(F.count("*").alias("rows"), F.sum("length").alias("bases"))
    parts.append(sums.select(F.lit("sums").alias("kind"), "class", none("string").alias("other"), F.explode(F.create_map(F.lit("rows"), F.col("rows"), F.lit("bases"), F.col("bases"))).alias("what", "n"), none("long").alias("bin")).select("kind", "class", "other", "what", "bin", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def accumulate(motifs: DataFrame, store: str, checkpoint: str, length: int, bins: int = 100) -> StreamingQuery:
    """A stream of motifs of whole sequences as accumulated histograms and pairs: each micro-batch adds its counts to a result store once.

    A batch that is tried again after a crash is found committed; what is stored grows with batches and bins, not with motifs.
    """
    spark = motifs.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        ResultStore(spark, store).append(partial_counts(rows.persist(), length, bins), f"counts-{number:09d}")
        rows.unpersist()

    return motifs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """The accumulated table of a kind: bins (class, what, bin, n), pairs (class_a, class_b, n) or sums (class, rows, bases)."""
    rows = ResultStore(spark, store).read().filter(F.col("kind") == kind)
    if kind == "bins":
        return rows.groupBy("class", "what", "bin").agg(F.sum("n").alias("n"))
    if kind == "pairs":
        return rows.groupBy(F.col("class").alias("class_a"), F.col("other").alias("class_b")).agg(F.sum("n").alias("n"))
    if kind == "sums":
        return rows.groupBy("class").pivot("what", ["rows", "bases"]).agg(F.sum("n"))
    raise ValueError(f"kind is bins, pairs or sums, not {kind}")
