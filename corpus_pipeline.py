"""The corpus pipeline: toxicity, SimHash near-duplicates, repeated spans, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's rows as a table into the shared folder and hands them to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import decontaminate, near_copies, packing, suffixes, toxicity
from helixspark.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It learns from the labelled rows of docs."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out=None)
    return toxicity.score_toxicity(docs, model, keep=True).filter(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near-duplicates: five-word shingles, similarity 0.8 or more.

    Of rows that share that id, one stays (the first by text). Rows without an id all stay, unless a row with an id has
    a near-duplicate text.
    """
    rows = near_copies.near_copies(docs)
    least = rows.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(least, "doc_id", "left_semi")
    repeated = rows.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(again.select(*docs.columns))
    nameless = docs.filter("doc_id is null")
    if not nameless.isEmpty():
        alone = rows.filter("component_id is null").select("digest").distinct()
        named = near_copies.digests(nameless.withColumn("doc_id", F.struct(*docs.columns))).join(alone, "digest", "left_semi")
        kept = kept.unionByName(named.select("id.*"))
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 100-byte strings that start earlier too, in whole characters; n_chars follows. No row goes."""
    cut = suffixes.remove_repeats(docs, keep=True)
    n_chars = F.when(F.col("n_spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, benchmark, keep=True).filter("n_leaks = 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("suffixes", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]

#: No stage but the first rows' reading is SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
