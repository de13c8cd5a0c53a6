"""Motif tables as lines of CSV, BED, GFF3, JSON and FASTA, and as Parquet. Files are written by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import normalized, valid_motif
from ..operators.intervals import DERIVED
from ..operators.tiling import letters, pieces
from .shared import scratch  # noqa: F401  also known from here

CORE = ["seq_id", "class", "subclass", "start_pos", "end_pos", "length", "sequence", "strand", "score", "raw_score", "method", "pattern_id"]
#: What stands for a missing value of a core column; NA for the others.
DEFAULTS = {"strand": "+", "method": "Pattern_detection", "pattern_id": "Unknown", "score": "0.0", "raw_score": "0.0"}
# Colours of the classes in browser tracks.
COLOURS = {
    "Curved_DNA": "255,182,193", "Slipped_DNA": "255,218,185", "Cruciform": "173,216,230", "R-Loop": "144,238,144", "Triplex": "221,160,221", "G-Quadruplex": "255,215,0",
    "i-Motif": "255,165,0", "Z-DNA": "138,43,226", "A-philic_DNA": "230,230,250", "Hybrid": "192,192,192", "Non-B_DNA_Clusters": "128,128,128",
}


def exportable(motifs: DataFrame, non_overlapping: bool = False, drop_dynamic_subclasses: bool = True) -> DataFrame:
    """Rows for export, in canonical names. ``drop_dynamic_subclasses`` leaves out rows whose subclass isn't in the taxonomy (hybrids, clusters)."""
    out = motifs.filter(~F.col("class").isin(*DERIVED)) if non_overlapping else motifs
    return valid_motif(normalized(out), keep_derived=not drop_dynamic_subclasses)


def with_sequence(motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The motifs' own letters as column ``sequence``; null where the sequence is missing or ends before."""
    return letters(motifs, pieces(seqs), F.col("start_pos") - 1, F.col("end_pos"), "sequence")


def _text(motifs: DataFrame, name: str) -> Column:
    kind = motifs.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        value = F.when(F.col(name).isNotNull(), F.to_json(name))
    else:
        value = F.col(name).cast("string")
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(DEFAULTS.get(name, "NA")))


def csv_rows(motifs: DataFrame, non_overlapping: bool = False, all_fields: bool = True) -> DataFrame:
    """The core columns as text, then (``all_fields``) the others by name; defaults for what is missing; lists and maps as JSON."""
    rows = exportable(motifs, non_overlapping)
    extra = sorted(set(motifs.columns) - set(CORE)) if all_fields else []
    return rows.select(*(_text(rows, c).alias(c) if c in rows.columns else F.lit(DEFAULTS.get(c, "NA")).alias(c) for c in [*CORE, *extra]))


def _in_order(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines (seq_id, value) of each sequence together: the heads first, then the rows in order. Written as text, a sequence's block is never torn apart.

    The hash is dealt by, not the name: heads and rows may already lie by name, each in parts of their own, and then Spark leaves a shuffle by name out.
    """
    lines = heads.select("seq_id", F.lit(0).alias("_part"), F.col("n").alias("_n"), "value").unionByName(rows.select("seq_id", F.lit(1).alias("_part"), F.col("_n"), "value"))
    return lines.repartition(F.xxhash64("seq_id")).sortWithinPartitions("seq_id", "_part", "_n").select("seq_id", "value")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their number ``_n`` in the sequence, from 1, by place and name."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("seq_id").orderBy("start_pos", "end_pos", "class", "subclass", "score")))


def _or(motifs: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in motifs.columns else F.lit(default)


def bed_lines(motifs: DataFrame, track: str = "helixspark_motifs") -> DataFrame:
    """(seq_id, value): for each sequence a track line, then BED9: start from 0, name class_subclass, score times 1000 between 0 and 1000.

    Scores are 1 at least, so that column is always 1000. Rows that can't be exported (hybrids, clusters) go.
    """
    rows = _numbered(exportable(motifs))
    colour = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    score = F.floor(F.least(F.lit(1000.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0)) * 1000))).cast("string")
    start, end = F.greatest(F.lit(0), F.col("start_pos") - 1).cast("string"), F.col("end_pos").cast("string")
    line = F.concat_ws("\t", "seq_id", start, end, F.concat_ws("_", "class", "subclass"), score, _or(motifs, "strand", "+"), start, end, F.coalesce(colour[F.col("class")], F.lit("128,128,128")))
    heads = motifs.select("seq_id").distinct().select("seq_id", F.lit(0).alias("n"), F.lit(f'track name={track} description="Non-B DNA motifs" itemRgb=On').alias("value"))
    return _in_order(heads, rows.withColumn("value", line))


def gff3_lines(motifs: DataFrame, lengths: DataFrame | None = None, source: str = "helixspark", length_of_name: bool = False) -> DataFrame:
    """(seq_id, value): for each sequence the version and region lines, then nine columns; all rows, hybrids and clusters too.

    The region ends at the length in ``lengths`` (seq_id, seq_length), else at the last motif's end; ``length_of_name``
    gives the number of letters of the name there, as some tools expect it.
    """
    rows = _numbered(motifs)
    ends = motifs.groupBy("seq_id").agg(F.max("end_pos").cast("long").alias("_last"))
    if lengths is not None:
        ends = ends.join(lengths, "seq_id", "left").withColumn("_last", F.coalesce("seq_length", "_last"))
    last = F.length("seq_id").cast("long") if length_of_name else F.col("_last")
    head = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("##gff-version 3").alias("value")), F.struct(F.lit(1).alias("n"), F.concat(F.lit("##sequence-region "), "seq_id", F.lit(" 1 "), last.cast("string")).alias("value"))))
    name = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    attrs = F.concat_ws(";", F.concat(F.lit("ID=motif_"), F.col("_n").cast("string")), F.concat(F.lit("Name="), name("class"), F.lit("_"), name("subclass")), F.concat(F.lit("motif_class="), name("class")), F.concat(F.lit("motif_subclass="), name("subclass")), F.concat(F.lit("length="), F.coalesce("length", F.lit(0)).cast("string")), F.concat(F.lit("method="), _or(motifs, "method", source)))
    line = F.concat_ws("\t", "seq_id", F.lit(source), F.lit("Non_B_DNA_motif"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), _or(motifs, "score", "."), _or(motifs, "strand", "+"), F.lit("."), attrs)
    return _in_order(ends.select("seq_id", head.alias("h")).select("seq_id", "h.n", "h.value"), rows.withColumn("value", line))


def json_lines(motifs: DataFrame, version: str = "1", analysis: str = "non_b_dna") -> DataFrame:
    """(seq_id, value): lines that together are one JSON object for each sequence: version, analysis_type, total_motifs, motifs."""
    rows = _numbered(exportable(motifs))
    total = F.count("*").over(Window.partitionBy("seq_id"))
    line = F.concat(F.to_json(F.struct(*motifs.columns)), F.when(F.col("_n") == total, "]}").otherwise(","))
    counts = rows.groupBy("seq_id").agg(F.count("*").alias("t"))
    heads = motifs.select("seq_id").distinct().join(counts, "seq_id", "left").select("seq_id", F.lit(0).alias("n"), F.concat(F.lit(f'{{"version":"{version}","analysis_type":"{analysis}","total_motifs":'), F.coalesce("t", F.lit(0)).cast("string"), F.when(F.col("t").isNull(), ',"motifs":[]}').otherwise(',"motifs":[')).alias("value"))
    return _in_order(heads, rows.withColumn("value", line))


def json_documents(motifs: DataFrame) -> DataFrame:
    """(value): json_lines for a text file with blanks between them: each sequence's object stands on a line of its own, however many motifs it holds."""
    head = F.startswith(F.col("value"), F.lit('{"version"'))
    return json_lines(motifs).select(F.when(head, F.concat(F.lit("\n"), "value")).otherwise(F.col("value")).alias("value"))


def json_rows(motifs: DataFrame) -> DataFrame:
    """One object a motif: JSON lines."""
    return motifs.select(F.to_json(F.struct(*motifs.columns)).alias("value"))


def append_jsonl(motifs: DataFrame, path: str) -> None:
    json_rows(motifs).write.mode("append").text(path)


def jsonl_summary(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(seq_id, total_motifs, coverage_bp, coverage_pct, density, mean_score): of a store of lines; coverage_bp is the sum of lengths, overlaps counted twice."""
    n = motifs.groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("length").alias("bp"), F.avg("score").alias("s"))
    g = F.col("seq_length")
    return lengths.join(n, "seq_id", "left").select("seq_id", F.coalesce("n", F.lit(0)).alias("total_motifs"), F.coalesce("bp", F.lit(0)).alias("coverage_bp"), F.round(F.coalesce("bp", F.lit(0)) * 100.0 / g, 4).alias("coverage_pct"), F.round(F.coalesce("n", F.lit(0)) * 1000.0 / g, 4).alias("density"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("mean_score"))


def fasta_lines(seqs: DataFrame, width: int = 80) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return seqs.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), body).alias("value"))


def write(motifs: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """kind: parquet, csv, bed, gff3, json (a line with one object for each sequence), jsonl. Every task writes its own file into the folder."""
    if kind == "parquet":
        by = ["source_file"] if "source_file" in motifs.columns else []
        motifs.write.mode(mode).partitionBy(*by).parquet(path)
    elif kind == "csv":
        csv_rows(motifs).write.mode(mode).option("header", True).csv(path)
    elif kind in ("bed", "gff3"):
        {"bed": bed_lines, "gff3": gff3_lines}[kind](motifs).select("value").write.mode(mode).text(path)
    elif kind == "json":
        json_documents(motifs).write.mode(mode).option("lineSep", " ").text(path)
    elif kind == "jsonl":
        json_rows(motifs).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def save_job(path: str, motifs: DataFrame, seqs: DataFrame, about: dict[str, str]) -> None:
    """results, sequences and metadata of a run in one folder."""
    motifs.write.parquet(f"{path}/results")
    seqs.write.parquet(f"{path}/sequences")
    motifs.sparkSession.createDataFrame(list(about.items()), "key string, value string").coalesce(1).write.json(f"{path}/metadata")


def load_job(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    about = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/metadata").collect()}
    return spark.read.parquet(f"{path}/results"), spark.read.parquet(f"{path}/sequences"), about


def list_jobs(spark: SparkSession, root: str) -> DataFrame:
    """(job, key, value): what is noted of every job folder under root."""
    found = spark.read.schema("key string, value string").json(f"{root}/*/metadata").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metadata/[^/]*$", 1).alias("job"), "key", "value")
    return found


def job_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def job_summary(spark: SparkSession, path: str) -> DataFrame:
    """(class, n, sequences): a job's results by class."""
    return spark.read.parquet(f"{path}/results").groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("seq_id").alias("sequences"))
