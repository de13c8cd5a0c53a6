"""Registered queries of the detectors' public tables, of choices and merges of motif tables, and of readers, with their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _COVER, _REGISTRY, WITH_MOTIF, WITH_SEQ, _hits_sql, _m, _q, motifs, sequences
from .catalog_more import _greedy_sql
from .catalog_scale import _CRUCIFORMS, SCAN
from .functions import sequence as fn
from .operators import detector_api, detectors, intervals, series
from .plans.scan import detect, scan
from .sources import fasta_source, readers, writers
from .sources.shared import scratch


def _merged(m: DataFrame, n: DataFrame) -> DataFrame:
    parts = {name: m.filter(F.col("event_id") % 2 == k).drop("event_id") for k, name in enumerate(("even", "odd"))}
    return intervals.merge_results(parts).select("seq_id", "start_pos", "end_pos", "score")


def _chosen(m: DataFrame, n: DataFrame) -> DataFrame:
    """Every seventh motif as a hybrid of two classes."""
    names = F.array("class", F.when(F.col("event_id") % 2 == 0, "Z-DNA").otherwise("Cruciform"))
    hybrid = F.col("event_id") % 7 == 0
    rows = m.withColumn("component_classes", F.when(hybrid, names)).withColumn("class", F.when(hybrid, "Hybrid").otherwise(F.col("class")))
    return intervals.by_subclass_choice(rows, ["Z-DNA", "Triplex"], ["Z-DNA", "H-DNA"]).select("event_id", "class")


def _gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs written as GFF3, read as features."""
    at = scratch(spark)
    writers.write(motifs(spark, sf_dir), at, "gff3")
    return readers.read_gff(spark, at).select("seq_id", "source", "type", "start", "end", "strand")


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA, read by the data source in small byte ranges."""
    at = scratch(spark)
    writers.fasta_lines(sequences(spark, sf_dir)).write.text(at)
    fasta_source.register(spark)
    return spark.read.format("fasta").option("partitionBytes", 200_000).load(at).select("seq_id", "length", F.md5("seq").alias("md5"))


_ARMS = _CRUCIFORMS.replace("'raw': raw}", "'raw': raw, 'arm': arm, 'loop': loop}").rsplit("SELECT seq_id,", 1)[0] + "SELECT seq_id, 'Cruciform' AS class, k.{0}::DOUBLE AS {0} FROM kp"
_CURVES = f"""tr AS (SELECT seq_id, count(*) AS n_tracts FROM {_hits_sql({'t': 'A{3,}|T{3,}'})} GROUP BY 1), ph AS (SELECT seq_id, count(*) AS n, sum(raw_score) AS s FROM ({_REGISTRY['d_global_curvature'][1]}) GROUP BY 1), lg AS (SELECT seq_id, count(*) AS n, sum(raw_score) AS s FROM ({_REGISTRY['d_local_curvature'][1]}) GROUP BY 1)
SELECT seq_id, n_tracts, coalesce(ph.n, 0) AS n_phased, coalesce(lg.n, 0) AS n_long, round(coalesce(ph.s, 0.0), 6) AS phased_score, round(coalesce(lg.s, 0.0), 6) AS long_score, round(coalesce(ph.s, 0.0) + coalesce(lg.s, 0.0), 6) AS combined_score FROM tr LEFT JOIN ph USING (seq_id) LEFT JOIN lg USING (seq_id)"""
_CAP = 40_000
_BOUNDS = ", ".join(f"('{c}', {lo}::DOUBLE, {hi!r}::DOUBLE, {str(per).lower()}, {by.get(None, 'NULL')})" for c, (lo, hi, per, by) in detector_api.BOUNDS.items())
_CAPS = " ".join(f"WHEN subclass = '{s}' THEN {n}" for *_, by in detector_api.BOUNDS.values() for s, n in by.items() if s)

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "d_audit": (_q(lambda q: detector_api.audit(detect(q))), SCAN + " SELECT h.class, h.subclass, h.n AS candidates, coalesce(k.n, 0) AS reported, h.n - coalesce(k.n, 0) AS filtered, h.s AS sequences FROM (SELECT class, subclass, count(*) AS n, count(DISTINCT seq_id) AS s FROM hits GROUP BY 1, 2) h LEFT JOIN (SELECT class, subclass, count(*) AS n FROM kept GROUP BY 1, 2) k USING (class, subclass)"),
    "d_confidence": (_m(lambda m, n: detector_api.by_confidence(m)), WITH_MOTIF + " SELECT class, CASE WHEN score < 1.7 THEN 'weak' WHEN score < 2.3 THEN 'moderate' ELSE 'strong' END AS confidence, count(*) AS n FROM motifs GROUP BY 1, 2"),
    "d_bounds": (_m(lambda m, n: detector_api.bounded(m).select("event_id", F.round("raw_min", 6).alias("raw_min"), F.round("raw_max", 6).alias("raw_max"), "length_cap")), WITH_MOTIF + f", b(class, lo, hi, per, cap) AS (VALUES {_BOUNDS}) SELECT event_id, round(lo, 6) AS raw_min, round(CASE WHEN per THEN length * hi ELSE hi END, 6) AS raw_max, (CASE {_CAPS} ELSE cap END)::INT AS length_cap FROM motifs JOIN b USING (class)"),
    "d_curvature_summary": (_q(detector_api.curvature_summary), WITH_SEQ + ", " + _CURVES),
    "w_arm_lengths": (_q(lambda q: series.attribute_lengths(detectors.cruciform(q), "arm")), _ARMS.replace("{0}", "arm")),
    "w_loop_lengths": (_q(lambda q: series.attribute_lengths(detectors.cruciform(q), "loop")), _ARMS.replace("{0}", "loop")),
    "w_cluster_sizes": (_q(lambda q: series.cluster_sizes(scan(q))), SCAN + " SELECT n::INT AS motif_count, c::INT AS class_diversity, count(*) AS n FROM (SELECT DISTINCT seq_id, start_pos, n, c FROM (SELECT seq_id, start_pos, count(*) OVER w AS n, count(DISTINCT class) OVER w AS c FROM kept WINDOW w AS (PARTITION BY seq_id ORDER BY start_pos RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING)) WHERE n >= 4 AND c >= 3) GROUP BY 1, 2"),
    "i_merge_results": (_m(_merged), WITH_MOTIF + " SELECT seq_id, k.s AS start_pos, k.e AS end_pos, k.score AS score FROM " + _greedy_sql("motifs", "seq_id", "{'s': start_pos, 'e': end_pos, 'score': score}", "score DESC, end_pos - start_pos DESC, start_pos, end_pos")),
    "i_coverage_raw": (_m(lambda m, n: intervals.coverage_raw(m, ["seq_id", "class"], _CAP)), WITH_MOTIF + f", cut AS (SELECT seq_id, class, event_id, start_pos + 1 AS start_pos, least(end_pos, {_CAP}) AS end_pos FROM motifs WHERE start_pos < least(end_pos, {_CAP})) " + _COVER.format(k="seq_id, class").replace("FROM motifs", "FROM cut")),
    "i_subclass_choice": (_m(_chosen), WITH_MOTIF + " SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Hybrid' ELSE class END AS class FROM motifs WHERE CASE WHEN event_id % 7 = 0 THEN class IN ('Z-DNA', 'Triplex') OR event_id % 2 = 0 ELSE class IN ('Z-DNA', 'Triplex') AND subclass IN ('Z-DNA', 'H-DNA') END"),
    "s_gff": (_gff, WITH_MOTIF + " SELECT seq_id, 'helixspark' AS source, 'Non_B_DNA_motif' AS type, start_pos - 1 AS \"start\", end_pos AS \"end\", '+' AS strand FROM motifs"),
    "s_fasta_source": (_source, WITH_SEQ + ", c AS (SELECT seq_id, regexp_replace(seq, '[^ATGCNRYSWKMBDHV]', '', 'g') AS s FROM sequences) SELECT seq_id, length(s)::BIGINT AS length, md5(s) AS md5 FROM c"),
    "f_wrapped": (_q(lambda q: q.select("seq_id", F.md5(fn.wrapped(F.col("seq"), 60)).alias("md5"), fn.shortened(F.col("seq")).alias("short"))), WITH_SEQ + " SELECT seq_id, md5(array_to_string(list_transform(range(0, (length(seq) + 59) // 60), lambda i: substr(seq, i * 60 + 1, 60)), chr(10))) AS md5, CASE WHEN length(seq) > 50 THEN substr(seq, 1, 47) || '...' ELSE seq END AS short FROM sequences"),
}
