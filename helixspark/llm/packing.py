"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing by supersteps over run lengths, which the driver runs. Documents are ranked by size over the cluster; gaps
are kept sorted too. Both sorted lists are run-length encoded: sizes and gaps are whole numbers up to the sequence length L, so
either list has at most L runs however many documents there are. A superstep takes the largest size that is left and sweeps it over its
successors among the gaps (the smallest gaps that hold it); documents of one size that want the same gaps are matched to
them by rank; the gaps that were filled get their new value, and the next superstep follows. What no gap holds opens new
sequences. The supersteps yield an assignment of rank ranges to ranges of sequences, which is joined to the ranked
documents. This gives exactly the packing of sequential best-fit decreasing.

The driver holds the counts per size (L at most) and the assignment; documents and their ranks stay on the executors.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .tokenizing import encode_all, load

SEQUENCE = 2048
#: Rows of the assignment up to which it is broadcast (40 bytes each); a longer one is joined by a shuffle.
BROADCAST_RUNS = 500_000


def pieces(df: DataFrame, tokenizer: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of every row: its ids, then id 0, cut from the end into pieces of ``size`` (the first may be shorter)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for r, (ids, _, _) in enumerate(encode_all(encoder, [t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                first = len(ids) % size or size
                for k, at in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[at : first if k == 0 else at + size]
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over the runs. counts: documents per length. Gives (length, first rank, end rank, first sequence, offset)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences that have it
    order: list[int] = []  # gaps there are, sorted
    plan, opened = [], 0

    def put(gap: int, lo: int, hi: int) -> None:
        if gap and hi > lo:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((lo, hi))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            k = bisect.bisect_left(order, length)
            if k == len(order):  # nothing holds it: as many new sequences as the rest of this run needs
                each = size // length
                full, rest = divmod(n - rank, each)
                for new, levels in ((full, each), (int(rest > 0), rest)):
                    if new:
                        for level in range(levels):
                            plan.append((length, rank, rank + new, opened, level * length))
                            rank += new
                        put(size - levels * length, opened, opened + new)
                        opened += new
                continue
            gap = order[k]
            lo, hi = gaps[gap].pop()
            take = min(hi - lo, n - rank)
            plan.append((length, rank, rank + take, lo, size - gap))
            rank += take
            if take < hi - lo:
                gaps[gap].append((lo + take, hi))
            if not gaps[gap]:
                del gaps[gap], order[k]
            put(gap - length, lo, lo + take)
    return plan


def pack(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: a piece that holds id 0 alone. Rows with a null id are packed like others; repeated rows
    are packed one by one; ties of length go by a hash of id and piece, then id and piece. Other columns are left out. An empty table
    gives an empty table. Ranks are taken in buckets of each length, so that one frequent length is shared by many tasks.
    """
    spark = df.sparkSession
    cut = materialize(pieces(df, tokenizer, size, id_col, text_col))
    total = cut.count()
    buckets = max(64, -(-total // 20_000))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(buckets)))
    held = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # size rows at most
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(F.col(id_col), F.col("piece"), F.col("ids_crc32"))) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    schema = "_length long, _from long, _to long, _sequence long, _offset long"
    runs = best_fit(counts, size)
    plan = spark.createDataFrame(runs, schema)
    if len(runs) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    meets = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(plan, meets)
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir))
