"""The registry of search patterns by class: another set than the detectors' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regexscan import regex_hits

# Class, pattern_id, regular expression, subclass, least length.
PATTERNS = [
    ("Curved_DNA", "CRV_1_1", "A{4,15}", "Local Curvature", 4),
    ("Curved_DNA", "CRV_1_2", "T{4,15}", "Local Curvature", 4),
    ("Curved_DNA", "CRV_1_3", "(?:A{3,8}T{1,5}){2,}", "Local Curvature", 8),
    ("Curved_DNA", "CRV_1_4", "(?:A{3,8}.{8,12}){3,}A{3,8}", "Global Curvature", 20),
    ("Curved_DNA", "CRV_1_5", "(?:T{3,8}.{8,12}){3,}T{3,8}", "Global Curvature", 20),
    ("Slipped_DNA", "SLP_2_1", r"([ATGC])\2{9,}", "STR", 10),
    ("Slipped_DNA", "SLP_2_2", r"([ATGC]{2})\2{4,}", "STR", 10),
    ("Slipped_DNA", "SLP_2_3", r"([ATGC]{3})\2{3,}", "STR", 12),
    ("Slipped_DNA", "SLP_2_4", r"([ATGC]{4})\2{2,}", "STR", 12),
    ("Slipped_DNA", "SLP_2_5", r"(CA)\2{4,}", "STR", 10),
    ("Slipped_DNA", "SLP_2_6", r"(CGG)\2{3,}", "STR", 12),
    ("Slipped_DNA", "SLP_2_7", r"([ATGC]{5,20})(?:[ATGC]{0,100})\2", "Direct Repeat", 10),
    ("Slipped_DNA", "SLP_2_8", r"([ATGC]{10,50})(?:[ATGC]{0,200})\2", "Direct Repeat", 20),
    ("Cruciform", "CRU_3_1", "([ATGC]{6,20})[ATGC]{0,50}", "Cruciform forming IRs", 12),
    ("Cruciform", "CRU_3_2", "([ATGC]{8,15})[ATGC]{2,20}([ATGC]{8,15})", "Cruciform forming IRs", 16),
    ("Cruciform", "CRU_3_3", "([ATGC]{4,10})[ATGC]{0,10}([ATGC]{4,10})", "Cruciform forming IRs", 8),
    ("R-Loop", "RLP_4_1", "[GC]{10,}[AT]{2,10}[GC]{10,}", "R-loop formation sites", 20),
    ("R-Loop", "RLP_4_2", "G{5,}[ATGC]{10,100}C{5,}", "R-loop formation sites", 20),
    ("R-Loop", "RLP_4_3", "[GC]{6,}[AT]{1,5}[GC]{6,}", "R-loop formation sites", 15),
    ("R-Loop", "QmRLFS_4_1", "G{3,}[ATCGU]{1,10}?G{3,}(?:[ATCGU]{1,10}?G{3,}){1,}?", "R-loop formation sites", 25),
    ("R-Loop", "QmRLFS_4_2", "G{4,}(?:[ATCGU]{1,10}?G{4,}){1,}?", "R-loop formation sites", 30),
    ("Triplex", "TRX_5_1", "[GA]{15,}", "H-DNA", 15),
    ("Triplex", "TRX_5_2", "[CT]{15,}", "H-DNA", 15),
    ("Triplex", "TRX_5_3", "(?:GA){6,}[GA]*(?:TC){6,}", "H-DNA", 24),
    ("Triplex", "TRX_5_4", "(?:GAA){4,}", "Sticky DNA", 12),
    ("Triplex", "TRX_5_5", "(?:TTC){4,}", "Sticky DNA", 12),
    ("G-Quadruplex", "G4_TEL", "(?:TTAGGG){4,}", "Telomeric G4", 24),
    ("G-Quadruplex", "G4_STK", "(?:(?:G{3,}[ATGC]{1,7}){3}G{3,})(?:[ATGC]{0,20}(?:(?:G{3,}[ATGC]{1,7}){3}G{3,}))+", "Stacked G4", 30),
    ("G-Quadruplex", "G4_CAN", "G{3,}[ATGC]{1,7}G{3,}[ATGC]{1,7}G{3,}[ATGC]{1,7}G{3,}", "Canonical intramolecular G4", 15),
    ("G-Quadruplex", "G4_EXT", "G{3,}[ATGC]{1,12}G{3,}[ATGC]{1,12}G{3,}[ATGC]{1,12}G{3,}", "Extended-loop canonical", 15),
    ("G-Quadruplex", "G4_HIGH", "(?:G{3,}[ATGC]{1,7}){7,}", "Higher-order G4 array/G4-wire", 49),
    ("G-Quadruplex", "G4_TRX", "G{3,}[ATGC]{1,7}G{3,}[ATGC]{1,7}G{3,}", "Intramolecular G-triplex", 12),
    ("G-Quadruplex", "G4_WEAK", "G{2,}[ATGC]{1,7}G{2,}[ATGC]{1,7}G{2,}[ATGC]{1,7}G{2,}", "Two-tetrad weak PQS", 11),
    ("G-Quadruplex", "G4_BUL", "(?:G{2,}[ATGC]G{1,}[ATGC]{1,7}){3}G{2,}[ATGC]G{1,}", "Bulged G4", 15),
    ("i-Motif", "IM_7_1", "C{3,}[ATGC]{1,7}C{3,}[ATGC]{1,7}C{3,}[ATGC]{1,7}C{3,}", "Canonical i-motif", 15),
    ("i-Motif", "IM_7_2", "C{4,}[ATGC]{1,5}C{4,}[ATGC]{1,5}C{4,}[ATGC]{1,5}C{4,}", "Canonical i-motif", 16),
    ("i-Motif", "IM_7_3", "C{2,}[ATGC]{1,12}C{2,}[ATGC]{1,12}C{2,}[ATGC]{1,12}C{2,}", "Relaxed i-motif", 12),
    ("i-Motif", "IM_7_4", "C{3,}[ATGC]{8,15}C{3,}[ATGC]{1,7}C{3,}[ATGC]{1,7}C{3,}", "Relaxed i-motif", 18),
    ("i-Motif", "IM_7_5", "(?:AC){4,}|(?:CA){4,}", "AC-motif", 8),
    ("i-Motif", "IM_7_6", "(?:A{2,3}C{2,3}){3,}", "AC-motif", 12),
    ("i-Motif", "IM_7_7", "(?:ACG){3,}|(?:GCA){3,}", "AC-motif", 9),
    ("Z-DNA", "ZDN_8_1", "(?:CG){4,}|(?:GC){4,}", "Z-DNA", 8),
    ("Z-DNA", "ZDN_8_2", "(?:CA){4,}(?:TG){4,}|(?:TG){4,}(?:CA){4,}", "Z-DNA", 16),
    ("Z-DNA", "ZDN_8_3", "(?:AT){6,}|(?:TA){6,}", "Z-DNA", 12),
    ("Z-DNA", "ZDN_8_4", "[CG]{8,}", "eGZ", 8),
    ("Z-DNA", "ZDN_8_5", "G{4,}C{4,}|C{4,}G{4,}", "eGZ", 8),
    ("A-philic_DNA", "APH_9_1", "A{6,}", "A-philic DNA", 6),
    ("A-philic_DNA", "APH_9_2", "(?:A{3,}[AT]){3,}", "A-philic DNA", 12),
    ("A-philic_DNA", "APH_9_3", "(?:AA[AT]){4,}", "A-philic DNA", 12),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "class string, pattern_id string, regex string, subclass string, min_length int")


def pattern_counts(spark: SparkSession) -> DataFrame:
    return registry(spark).groupBy("class").agg(F.count("*").alias("patterns"), F.count_distinct("subclass").alias("subclasses"))


def scan_with_registry(seqs: DataFrame, name: str) -> DataFrame:
    """All matches of a class's patterns. Back references count from the group that the scan puts around the pattern."""
    mine = {p: rx for c, p, rx, _, _ in PATTERNS if c == name}
    if not mine:
        raise ValueError(f"no patterns of class {name}")
    subclass = F.create_map(*(F.lit(x) for c, p, _, sub, _ in PATTERNS if c == name for x in (p, sub)))
    return regex_hits(seqs, mine, matched=False).select("seq_id", "pattern_id", subclass[F.col("pattern_id")].alias("subclass"), "start", "end")
