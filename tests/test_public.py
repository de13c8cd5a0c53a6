"""The detectors' public tables: bounds, audit, thresholds, confidence."""

import random

from pyspark.sql import functions as F

from helixspark.operators import detector_api, intervals
from helixspark.plans.scan import detect, scan
from tests.test_library import planted, sequences
from tests.test_scale import repetitive


def test_scores_follow_from_raw_scores_and_bounds(spark):
    rng = random.Random(41)
    df = sequences(spark, [*planted(rng, 6), *((f"r{k}", repetitive(rng, 4000)) for k in range(3))])
    rows = detector_api.bounded(scan(df)).collect()
    plain = [r for r in rows if r["class"] in detector_api.BOUNDS]
    assert {r["class"] for r in plain} >= {"Curved_DNA", "Slipped_DNA", "Cruciform", "R-Loop", "Triplex", "G-Quadruplex", "i-Motif", "Z-DNA"}
    for r in plain:
        part = 0.0 if r.raw_max == r.raw_min else max(0.0, min(1.0, (r.raw_score - r.raw_min) / (r.raw_max - r.raw_min)))
        assert abs(r.score - min(3.0, 1 + 2 * part * min(1.0, r.length / r.length_cap))) < 0.00051, r
    assert all(r.raw_min is None and r.length_cap is None for r in rows if r["class"] not in detector_api.BOUNDS)


def test_audit_adds_up(spark):
    df = sequences(spark, planted(random.Random(42), 5))
    hits = detect(df)
    got = {(r["class"], r.subclass): r for r in detector_api.audit(hits).collect()}
    kept = intervals.remove_overlaps(hits)
    assert sum(r.candidates for r in got.values()) == hits.count() and sum(r.reported for r in got.values()) == kept.count()
    assert all(r.filtered == r.candidates - r.reported >= 0 and 1 <= r.sequences <= 5 for r in got.values())


def test_thresholds_and_confidence(spark):
    rows = [("a", "Z-DNA", 60.0, 1.5), ("a", "Z-DNA", 40.0, 1.7), ("a", "R-Loop", 0.5, 2.3), ("a", "R-Loop", None, None)]
    df = spark.createDataFrame(rows, "seq_id string, class string, raw_score double, score double")
    assert [r.raw_score for r in detector_api.quality_passed(df, {"Z-DNA": 50}).orderBy("raw_score").collect()] == [0.5, 60.0]
    assert {(r.score, r.confidence) for r in detector_api.interpreted(df).collect()} == {(1.5, "weak"), (1.7, "moderate"), (2.3, "strong"), (None, None)}
    assert {(r["class"], r.confidence): r.n for r in detector_api.by_confidence(df, ["Z-DNA"]).collect()} == {("Z-DNA", "weak"): 1, ("Z-DNA", "moderate"): 1}
    summary = detector_api.curvature_summary(sequences(spark, [("x", "A" * 9 + "CG" + "T" * 3 + "C"), ("y", "CGCGCGCGCG")])).collect()
    assert [(r.seq_id, r.n_tracts, r.n_phased, r.n_long) for r in summary] == [("x", 2, 0, 1)] and summary[0].combined_score == round(9 / 16, 6)
    assert detector_api.bounded(df.withColumn("length", F.lit(10)).withColumn("subclass", F.lit("x"))).filter("raw_max = 63.0").count() == 2
