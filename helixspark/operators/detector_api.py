"""What detectors tell beside their motifs: bounds of their scores, how a score reads, what was found and what was dropped, tract summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .detectors import global_curvature, local_curvature
from .intervals import remove_overlaps
from .regexscan import placed_hits

# Least raw score, greatest raw score (for each base where ``per_base``), and bases from which length no longer counts.
BOUNDS = {
    "Curved_DNA": (0.1, 1.0, False, {"Local Curvature": 50, "Global Curvature": 120}),
    "Slipped_DNA": (1.0, 3.0, False, {"STR": 1000, "Direct Repeat": 500}),
    "Cruciform": (0.2, 1.0, False, {None: 200}),
    "R-Loop": (0.4, 1.0, False, {None: 2000}),
    "Triplex": (1.0, 3.0, False, {None: 150}),
    "G-Quadruplex": (0.5, 4.0, False, {None: 120}),
    "i-Motif": (0.4, 1.0, False, {None: 60}),
    "Z-DNA": (50.0, 6.3, True, {None: 300}),
    "A-philic_DNA": (0.5, 2.702428571428571 / 10, True, {None: 300}),
}


def _by_class(of: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in of.items():
        out = F.when(F.col("class") == name, value).otherwise(out)
    return out


def raw_bounds() -> tuple[Column, Column, Column]:
    """Of a motif's class, subclass and length: the least and the greatest raw score, and the length cap; null for hybrids and clusters."""
    least = _by_class({c: F.lit(lo) for c, (lo, *_) in BOUNDS.items()})
    most = _by_class({c: F.col("length") * F.lit(hi) if per_base else F.lit(hi) for c, (_, hi, per_base, _) in BOUNDS.items()})
    caps = {}
    for c, (*_, by) in BOUNDS.items():
        cap = F.lit(by.get(None)).cast("int")
        for sub, bases in by.items():
            cap = F.when(F.col("subclass") == sub, F.lit(bases)).otherwise(cap) if sub is not None else cap
        caps[c] = cap
    return least.cast("double"), most.cast("double"), _by_class(caps).cast("int")


def interpreted(motifs: DataFrame) -> DataFrame:
    """Adds ``confidence``: weak (below 1.7), moderate (below 2.3) or strong; null without a score."""
    s = F.col("score")
    return motifs.withColumn("confidence", F.when(s < 1.7, "weak").when(s < 2.3, "moderate").when(s.isNotNull(), "strong"))


def bounded(motifs: DataFrame) -> DataFrame:
    """Adds raw_min, raw_max and length_cap of each motif."""
    least, most, cap = raw_bounds()
    return motifs.withColumns({"raw_min": least, "raw_max": most, "length_cap": cap})


def audit(hits: DataFrame) -> DataFrame:
    """(class, subclass, candidates, reported, filtered, sequences): what a scan's detectors found, and what is left when overlaps are removed.

    hits: as plans.scan.detect gives them. They are counted and chosen from, so they are a written table: detectors run once.
    """
    hits = written(hits.drop("attrs"))
    seen = hits.groupBy("class", "subclass").agg(F.count("*").alias("candidates"), F.count_distinct("seq_id").alias("sequences"))
    kept = remove_overlaps(hits).groupBy("class", "subclass").agg(F.count("*").alias("reported"))
    return seen.join(kept, ["class", "subclass"], "left").select("class", "subclass", "candidates", F.coalesce("reported", F.lit(0)).alias("reported"), (F.col("candidates") - F.coalesce("reported", F.lit(0))).alias("filtered"), "sequences")


def quality_passed(motifs: DataFrame, least: dict[str, float]) -> DataFrame:
    """Motifs whose raw score reaches their class's threshold; classes without one pass."""
    cut = _by_class({c: F.lit(float(x)) for c, x in least.items()}).cast("double")
    return motifs.filter(F.col("raw_score") >= F.coalesce(cut, F.col("raw_score")))


def curvature_summary(seqs: DataFrame) -> DataFrame:
    """(seq_id, n_tracts, n_phased, n_long, phased_score, long_score, combined_score): A and T tracts of each sequence that has any."""
    tracts = placed_hits(seqs, {"tract": "A{3,}|T{3,}"}).groupBy("seq_id").agg(F.count("*").alias("n_tracts"))
    sums = [d.groupBy("seq_id").agg(F.count("*").alias(f"n_{name}"), F.sum("raw_score").alias(f"{name}_score")) for name, d in (("phased", global_curvature(seqs)), ("long", local_curvature(seqs)))]
    out = tracts.join(sums[0], "seq_id", "left").join(sums[1], "seq_id", "left").na.fill(0)
    return out.select("seq_id", "n_tracts", "n_phased", "n_long", F.round("phased_score", 6).alias("phased_score"), F.round("long_score", 6).alias("long_score"), F.round(F.col("phased_score") + F.col("long_score"), 6).alias("combined_score"))


def by_confidence(motifs: DataFrame, classes: Iterable[str] | None = None) -> DataFrame:
    """(class, confidence, n): how the motifs of each class read."""
    rows = motifs if classes is None else motifs.filter(F.col("class").isin(*classes))
    return interpreted(rows).groupBy("class", "confidence").agg(F.count("*").alias("n"))
