"""Stored sequences: a table of tiles that is cut once, from which slices, chunks and whole sequences are read.

A tile holds ``size`` letters and ``reach`` of the next one. Tiles are sorted by sequence and place and lie in small row groups,
so the least and greatest values that Parquet keeps of each prune all but the few row groups of a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiling import letters, pieces
from .shared import remove_folder

SIZE, REACH = 16_384, 2048
ROW_GROUP = 4 << 20


class SequenceStore:
    """The stored sequences of a folder. Reads are DataFrames; nothing is read before they run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.schema("size int, reach int").json(f"{self.path}/about").first()
        if about is None:
            raise ValueError(f"no sequence store at {path}")
        self.size, self.reach = about["size"], about["reach"]
        self.tiles = spark.read.schema("seq_id string, tile long, n long, bases string").parquet(f"{self.path}/tiles")

    @classmethod
    def create(cls, seqs: DataFrame, path: str, size: int = SIZE, reach: int = REACH) -> SequenceStore:
        """Store sequences (seq_id, seq) of unique names. Null sequences aren't stored, empty ones are."""
        spark = seqs.sparkSession
        tiles = pieces(seqs, size, reach).repartitionByRange("seq_id", "tile").sortWithinPartitions("seq_id", "tile")
        tiles.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 16).option("parquet.block.size.row.check.min", 16).parquet(f"{path}/tiles")
        spark.createDataFrame([(size, reach)], "size int, reach int").coalesce(1).write.json(f"{path}/about")  # last: a store without it isn't whole
        return cls(spark, path)

    def sequences(self) -> DataFrame:
        """(seq_id, length, n_tiles). Letters aren't read."""
        return self.tiles.filter("tile = 0").select("seq_id", F.col("n").alias("length"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / self.size).cast("long")).alias("n_tiles"))

    def letters(self, regions: DataFrame, start: str = "start", end: str = "end", name: str = "seq") -> DataFrame:
        """regions (with seq_id) and their letters [start, end), from 0; null where a sequence is missing or ends before."""
        return letters(regions, self.tiles, F.col(start), F.col(end), name, self.size, self.reach)

    def slice(self, seq_id: str, start: int, end: int) -> DataFrame:
        """(seq_id, start, end, seq): one row of the letters [start, end) of a sequence, cut at its end; no row if there is none."""
        start = max(0, start)
        found = self.tiles.filter((F.col("seq_id") == seq_id) & F.col("tile").between(start // self.size, max(start, end - 1) // self.size))
        at = F.col("tile") * self.size
        first = F.greatest(F.lit(start), at)
        part = F.substr(F.col("bases"), (first - at + 1).cast("int"), F.greatest(F.lit(0), F.least(F.lit(end), at + self.size) - first).cast("int"))
        rows = found.groupBy("seq_id").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("tile", part.alias("p")))).alias("ps"))
        return rows.select("seq_id", F.lit(start).cast("long").alias("start"), F.least(F.lit(end), F.col("n")).cast("long").alias("end"), F.array_join("ps.p", "").alias("seq")).filter("end > start")

    def chunks(self, size: int = 5_000_000, overlap: int = 10_000) -> DataFrame:
        """(seq_id, chunk, start, end, seq): chunks of ``size`` letters, each beginning ``overlap`` before the end of the one before."""
        if not 0 <= overlap < size:
            raise ValueError(f"overlap must be from 0 to below {size}, not {overlap}")
        step = size - overlap
        last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("length") - size) / step).cast("long"))
        places = self.sequences().select("seq_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
        regions = places.select("seq_id", "chunk", (F.col("chunk") * step).alias("start"), F.least(F.col("chunk") * step + size, F.col("length")).alias("end"))
        return self.letters(regions).select("seq_id", "chunk", "start", "end", F.coalesce("seq", F.lit("")).alias("seq"))

    def whole(self) -> DataFrame:
        """(seq_id, seq): the sequences as they were stored."""
        own = F.substring("bases", 1, self.size)
        return self.tiles.groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("tile", own.alias("p")))).getField("p"), "").alias("seq"))

    def drop(self) -> bool:
        """Remove the store; whether there was one."""
        return remove_folder(self.spark, self.path)


def delete_store(spark: SparkSession, path: str) -> bool:
    """Remove a store, whole or not; whether there was one."""
    return remove_folder(spark, path)
