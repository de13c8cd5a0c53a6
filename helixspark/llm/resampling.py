"""Quality selection by importance resampling: hashed n-gram models of a target and of the raw corpus, Gumbel top-k.

Every text is a bag of hashed words and word pairs. Two generative models (bucket probabilities, smoothed) are counted
over the table: the raw one over all rows, the target one over the rows that are labelled good (a bounded sample: at most
about ``MOST_GOOD`` of them, whose ids every task holds, so that no text is shuffled). A text's log weight is the log of
the ratio of its probabilities under the two models: the sum of the log ratios of its n-grams. Adding Gumbel noise and
taking the k largest draws k rows without replacement, in proportion to their weights. The noise is a hash of seed, id and
text, and for rows that repeat both, of the row's number too, so a lost task repeats it.

The k-th largest key is found exactly by histograms over the keys, each a small aggregate; no row count passes the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

BUCKETS, FRACTION, SEED = 10_000, 0.5, 17
BINS, FEW = 4096, 10_000
#: Good rows that the target model learns from.
MOST_GOOD = 200_000
#: Words whose hashes a task keeps.
KNOWN = 300_000


class Hasher:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def buckets(self, text: str | None) -> np.ndarray:
        """Buckets of the words (lower-cased, by white space), then of the pairs of neighbours."""
        words = (text or "").lower().split()
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        h = np.fromiter((known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode())) for w in words), np.int64, len(words))
        return np.concatenate([h, (h[:-1] * 1_000_003 + h[1:]) & 0x7FFFFFFF]) % BUCKETS


def log_ratios(texts: DataFrame) -> np.ndarray:
    """texts: (text, good boolean). log of target over raw probability of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, good = Hasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(hasher.buckets(t), minlength=BUCKETS)
                raw += n
                if g:
                    good += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(good)], names=["bucket", "raw", "good"])

    found = texts.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).orderBy("bucket").toArrow()
    if not found.num_rows:
        return np.zeros(BUCKETS)
    raw, good = found["raw"].to_numpy(), found["good"].to_numpy()
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + 1.0) / (good.sum() + BUCKETS)) - np.log((raw + 1.0) / (raw.sum() + BUCKETS))


def log_weights(df: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _digest, _row, log_weight): log of target over raw probability of the text; 0 for a text without words."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches):
            out = [float(ratios[hasher.buckets(t)].sum()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], names=[id_col, "_digest", "_row", "log_weight"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_digest"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, _digest long, _row long, log_weight double")


def gumbel(seed: int, *cols: str) -> Column:
    """Standard Gumbel noise from a hash of the columns and the seed."""
    unit = (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int) -> float:
    """keys: (key double). Exact: the interval that holds the k-th narrows by histograms until few rows are left in it."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    inside, above = keys, 0
    while True:
        inside = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        n = inside.count()
        if n <= FEW or lo == hi:
            return inside.orderBy(F.desc("key")).select("key").limit(k - above).agg(F.min("key")).first()[0] if lo != hi else lo
        width = (hi - lo) / BINS
        bins = inside.select(F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1)).alias("bin"), "key").groupBy("bin").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]


def _learnt_from(good: DataFrame, id_col: str) -> DataFrame:
    """(_id, _good): the good ids, about MOST_GOOD of them by hash if there are more; few enough to be sent to every task."""
    ids = good.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    n = ids.count()
    if n > MOST_GOOD:
        ids = ids.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * MOST_GOOD / n))
    return F.broadcast(ids.withColumn("_good", F.lit(True)))


def resample(df: DataFrame, good: DataFrame, fraction: float = FRACTION, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, log_weight, gumbel_key, selected): one row per input row. good: (id_col), the rows that the target model learns.

    ceil(fraction x rows) rows are selected (rows whose keys are equal to the last bit stay together). Rows are drawn one by
    one: null ids with different texts have noise of their own, and so have rows that repeat id and text. Null and empty
    texts have weight 0. A null id is no target. Other columns are left out. An empty table gives an empty table; without
    any good row all weights are 0, and the draw is uniform.
    """
    marked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(_learnt_from(good, id_col), "_id", "left")
    ratios = log_ratios(marked.select("_text", F.coalesce("_good", F.lit(False))))
    weighed = materialize(log_weights(df, ratios, id_col, text_col))
    repeated = weighed.groupBy(F.col(id_col).alias("_id"), F.col("_digest").alias("_same")).count().filter("count > 1").select("_id", "_same")
    noise = gumbel(seed, id_col, "_digest")
    if not repeated.isEmpty():
        same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_same"))
        weighed = weighed.join(repeated, same, "left")
        noise = F.when(F.col("_same").isNull(), noise).otherwise(gumbel(seed, id_col, "_digest", "_row"))
    keyed = materialize(weighed.select(id_col, "log_weight", (F.col("log_weight") + noise).alias("gumbel_key")))
    n = keyed.count()
    if not n:
        return keyed.withColumn("selected", F.lit(False))
    k = min(n, max(1, int(np.ceil(fraction * n))))
    return keyed.withColumn("selected", F.col("gumbel_key") >= kth_largest(keyed.select(F.col("gumbel_key").alias("key")), k))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all documents, drawn by their likeness to those labelled good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir), good)
