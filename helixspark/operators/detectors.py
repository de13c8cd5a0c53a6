"""The nine detectors: sequences (seq_id, seq) or their tiles (see tiling) in, motifs out.

Of tiles that end at safe places and show ``tiling.CONTEXT`` letters around, the motifs are those of the whole sequences:
patterns don't cross a safe place; arms of repeats reach 208 bases, elongation zones 2000, and only what begins in a tile's
core is its own; runs that go on behind a border are joined there; and choices between overlapping hits, chains and unions
are made over the sequence's table of hits, which is written once. A motif: seq_id, class, subclass, start_pos, end_pos (from 1, inclusive), length, strand, raw_score, score (1 to 3),
method, pattern_id, attrs. Sequences are taken in upper case.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import count_of, normalize_score
from ..functions.tables import a_tenmers, z_tenmers
from ..sources.shared import written
from . import kernels
from .intervals import islands, merged, segmented, select_greedy
from .regexscan import kmer_hits, placed_hits, stranded_hits
from .tiling import tiled

COLUMNS = ["seq_id", "class", "subclass", "start_pos", "end_pos", "length", "strand", "raw_score", "score", "method", "pattern_id", "attrs"]

# Patterns of the detectors.
LOCAL_CURVES = {"CRV_002": "A{8,}", "CRV_003": "T{8,}"}
STICKY = {"TRX_GAA": "(?:GAA){4,}", "TRX_TTC": "(?:TTC){4,}"}
EGZ = {f"EGZ_{unit}": f"(?:{unit}){{4,}}" for unit in ("CGG", "GGC", "CCG", "GCC")}
RLOOPS = {
    "QmRLFS-m1": "G{3,}[ATCG]{1,10}?G{3,}(?:[ATCG]{1,10}?G{3,}){1,}?",
    "QmRLFS-m2": "G{4,}(?:[ATCG]{1,10}?G{4,}){1,}?",
}
QUADRUPLEXES = {
    "G4_TEL": "(?:TTAGGG){4,}",
    "G4_STK": "(?:(?:G{3,}[ACT]{1,7}){3}G{3,})(?:[ACT]{0,20}(?:(?:G{3,}[ACT]{1,7}){3}G{3,}))+",
    "G4_CAN": "G{3,}[ACGT]{1,7}G{3,}[ACGT]{1,7}G{3,}[ACGT]{1,7}G{3,}",
    "G4_EXT": "G{3,}[ACGT]{1,12}G{3,}[ACGT]{1,12}G{3,}[ACGT]{1,12}G{3,}",
    "G4_HIGH": "G{3,}(?:[ACT]{1,7}G{3,}){6,}",
    "G4_TRX": "G{3,}[ACGT]{1,7}G{3,}[ACGT]{1,7}G{3,}",
    "G4_WEAK": "G{2,}[ACGT]{1,7}G{2,}[ACGT]{1,7}G{2,}[ACGT]{1,7}G{2,}",
    "G4_BUL": "(?:G{2,}[ACGT]G{1,}[ACGT]{1,7}){3}G{2,}[ACGT]G{1,}",
}
#: In order of priority.
G4_NAMES = {
    "G4_TEL": "Telomeric G4",
    "G4_HIGH": "Higher-order G4 array/G4-wire",
    "G4_STK": "Stacked G4",
    "G4_CAN": "Canonical intramolecular G4",
    "G4_BUL": "Bulged G4",
    "G4_EXT": "Extended-loop canonical",
    "G4_TRX": "Intramolecular G-triplex",
    "G4_WEAK": "Two-tetrad weak PQS",
}
IMOTIFS = {
    "IM_0": "C{3,}[ATGC]{1,7}C{3,}[ATGC]{1,7}C{3,}[ATGC]{1,7}C{3,}",
    "IM_EXT": "C{3,}[ATGC]{1,12}C{3,}[ATGC]{1,12}C{3,}[ATGC]{1,12}C{3,}",
}
AC_MOTIFS = {
    "HUR_AC_1": "A{3}[ACGT]{4}C{3}[ACGT]{4}C{3}[ACGT]{4}C{3}",
    "HUR_AC_2": "C{3}[ACGT]{4}C{3}[ACGT]{4}C{3}[ACGT]{4}A{3}",
    "HUR_AC_3": "A{3}[ACGT]{5}C{3}[ACGT]{5}C{3}[ACGT]{5}C{3}",
    "HUR_AC_4": "C{3}[ACGT]{5}C{3}[ACGT]{5}C{3}[ACGT]{5}A{3}",
    "HUR_AC_5": "A{3}[ACGT]{6}C{3}[ACGT]{6}C{3}[ACGT]{6}C{3}",
    "HUR_AC_6": "C{3}[ACGT]{6}C{3}[ACGT]{6}C{3}[ACGT]{6}A{3}",
}


def _literal(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def _motifs(hits: DataFrame, name: str, subclass: Column, raw: Column, score: Column, method: str, pattern: Column | None = None, strand: Column | None = None, attrs: Column | None = None) -> DataFrame:
    return hits.select(
        F.col("seq_id").cast("string").alias("seq_id"), F.lit(name).alias("class"), subclass.alias("subclass"), (F.col("start") + 1).cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), (F.col("end") - F.col("start")).cast("long").alias("length"),
        (strand if strand is not None else F.lit("+")).alias("strand"), raw.cast("double").alias("raw_score"), score.alias("score"), F.lit(method).alias("method"), (pattern if pattern is not None else F.col("pattern_id")).alias("pattern_id"), (attrs if attrs is not None else F.lit(None).cast("map<string,string>")).alias("attrs"),
    )


def _span() -> Column:
    return F.col("end") - F.col("start")


def local_curvature(seqs: DataFrame) -> DataFrame:
    """Runs of eight or more A or T."""
    raw = F.round(_span() / (_span() + 7.0), 6)
    return _motifs(placed_hits(seqs, LOCAL_CURVES), "Curved_DNA", F.lit("Local Curvature"), raw, normalize_score(raw, 0.1, 1.0, _span(), 50), "A-tract run")


def global_curvature(seqs: DataFrame) -> DataFrame:
    """Three or more A or T tracts whose centres are 9.9 to 11.1 bases apart, one after another.

    Chains are made where the text is; of tiles, those at borders are joined to those that go on there.
    """
    columns = ["seq_id", "start", "end", "n", "off"]
    found = kernels.phased_tracts_of(seqs)
    if not tiled(seqs):
        runs = found.select(columns)
    else:
        found = written(found)
        first, last = F.col("start") + F.col("lead"), F.col("end") - F.col("tail")
        keys = ["seq_id", "_segment"]
        parts = segmented(found.filter("open"), ["seq_id"], first, last, gap=12)  # no step of a chain is longer than the gap
        order = Window.partitionBy(*keys).orderBy("first")
        spaced = parts.withColumn("first", first).withColumn("step", F.col("first") - F.lag(last).over(order))
        goes_on = F.coalesce(F.col("step").between(9.9, 11.1), F.lit(False))
        chained = spaced.withColumn("chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        off = F.sum(F.col("off") + F.when(goes_on, F.abs(F.col("step") - 11.0)).otherwise(0.0))
        joined = chained.groupBy(*keys, "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), off.alias("off"))
        runs = found.filter("not open").select(columns).unionByName(joined.filter("n >= 3").select(columns))
    raw = F.round(F.greatest(F.lit(0.0), 1.0 - F.col("off") / (F.col("n") - 1) / 1.1), 6)
    return _motifs(runs.withColumn("raw", raw).filter("raw >= 0.1"), "Curved_DNA", F.lit("Global Curvature"), F.col("raw"), normalize_score(F.col("raw"), 0.1, 1.0, _span(), 120), "Phased tracts", F.lit("CRV_001"), attrs=F.create_map(F.lit("tracts"), F.col("n").cast("string")))


def _taken(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Of overlapping hits of tiles, those that come first in order: over the whole sequence, segment by segment.

    Hits with ``open`` false were chosen in their tile, which saw all that they overlap.
    """
    hits = written(hits)
    if "open" not in hits.columns:
        return select_greedy(hits, ["seq_id"], order, F.col("start"), F.col("end"), spread=True)
    chosen = select_greedy(hits.filter("open"), ["seq_id"], order, F.col("start"), F.col("end"), spread=True)
    return hits.filter("not open").unionByName(chosen).drop("open")


def _tandem_repeats(tiles: DataFrame) -> DataFrame:
    """Tandem repeats of tiles: runs that end at a tile's border are joined to those that go on there; what a tile sees the whole of is chosen there."""
    runs = written(kernels.repeat_runs_of_tiles(tiles))
    joined = islands(runs.filter("open"), ["seq_id", "k"]).groupBy("seq_id", "k", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("unit", "start").alias("unit"))
    least = F.greatest(F.lit(2), F.ceil(F.lit(20) / F.col("k"))).cast("int")
    whole = runs.filter("not open and not taken").select("seq_id", "start", "end", "k", "unit").unionByName(joined.filter(F.col("end") - F.col("start") >= (least - 1) * F.col("k")).select("seq_id", "start", "end", "k", "unit"))
    chosen = _taken(kernels.tandem_repeats(whole), [F.col("start"), -F.col("base"), F.col("k")])
    return kernels.tandem_repeats(runs.filter("taken")).unionByName(chosen)


def slipped(seqs: DataFrame) -> DataFrame:
    hits = _tandem_repeats(seqs) if tiled(seqs) else kernels.apply_kernel(seqs, kernels.slipped_rows)
    score = F.when(F.col("subclass") == "STR", normalize_score(F.col("raw_score"), 1.0, 3.0, _span(), 1000)).otherwise(normalize_score(F.col("raw_score"), 1.0, 3.0, _span(), 500))
    return _motifs(hits, "Slipped_DNA", F.col("subclass"), F.col("raw_score"), score, "Tandem repeats", F.lit("SLP"), attrs=F.col("attrs"))


def cruciform(seqs: DataFrame) -> DataFrame:
    if tiled(seqs):
        hits = _taken(kernels.apply_kernel(seqs, kernels.cruciform_of_tile, settled=True), [-F.col("raw_score"), F.col("start") - F.col("end"), F.col("start"), -F.col("attrs")["arm"].cast("int")])
    else:
        hits = kernels.apply_kernel(seqs, kernels.cruciform)
    return _motifs(hits, "Cruciform", F.col("subclass"), F.col("raw_score"), normalize_score(F.col("raw_score"), 0.2, 1.0, _span(), 200), "Inverted repeats", F.lit("CRU"), attrs=F.col("attrs"))


def r_loops(seqs: DataFrame) -> DataFrame:
    """G-clustered initiation zones of at least 50 % G, on either strand, with the best elongation zone downstream.

    Zones begin 50, 150, 250 ... bases after the initiation zone and end at multiples of 50, within 2000 bases; G counts
    come from the row's own prefix sums, so no sequence is shuffled.
    """
    hits = kernels.apply_kernel(seqs, kernels.one_by_one(kernels.r_loops(RLOOPS)))
    part = F.split("subclass", "\t")
    return _motifs(hits, "R-Loop", F.lit("R-loop formation sites"), F.col("raw_score"), normalize_score(F.col("raw_score"), 0.4, 1.0, _span(), 2000), "QmRLFS", part[1], part[0], F.col("attrs"))


def h_dna(seqs: DataFrame) -> DataFrame:
    if tiled(seqs):
        hits = _taken(kernels.apply_kernel(seqs, kernels.mirror_of_tile, settled=True), [-F.col("attrs")["arm"].cast("int"), F.col("attrs")["loop"].cast("int"), F.col("start")])
    else:
        hits = kernels.apply_kernel(seqs, kernels.mirror)
    return _motifs(hits, "Triplex", F.col("subclass"), F.col("raw_score"), normalize_score(F.col("raw_score"), 1.0, 3.0, _span(), 150), "Mirror repeats", F.lit("TRX_MIRROR"), attrs=F.col("attrs"))


def sticky(seqs: DataFrame) -> DataFrame:
    """Four or more GAA or TTC; the score rises with the copies in four slopes."""
    c = F.floor(_span() / 3)
    raw = F.round(F.least(F.lit(3.0), F.when(c < 20, 1 + 0.015 * c).when(c < 40, 1.3 + 0.03 * (c - 20)).when(c < 60, 2.0 + 0.02 * (c - 40)).otherwise(2.6 + 0.01 * (c - 60))), 3)
    return _motifs(placed_hits(seqs, STICKY), "Triplex", F.lit("Sticky DNA"), raw, normalize_score(raw, 1.0, 3.0, _span(), 150), "Repeat tract", attrs=F.create_map(F.lit("copies"), c.cast("string")))


def _quadruplexes(seqs: DataFrame, choose: bool) -> DataFrame:
    kinds = {"pattern_id": pa.string(), "raw": pa.float64(), "priority": pa.int32()}
    return kernels.placed(seqs, kernels.one_by_one(kernels.quadruplexes(QUADRUPLEXES, list(G4_NAMES), choose)), kinds, "pattern_id string, raw double, priority int")


def quadruplex_hits(seqs: DataFrame) -> DataFrame:
    """All matches of the eight patterns inside the merged windows around runs of G, with their raw score.

    A tile shows the runs that reach into its core, and ends where no match goes on, so the parts of a window in two tiles
    have the matches of the window.
    """
    return _quadruplexes(seqs, False)


def quadruplexes(seqs: DataFrame) -> DataFrame:
    """Best score, priority and length first, window by window: no match leaves its window or crosses a tile's border."""
    hits = _quadruplexes(seqs, True)
    return _motifs(hits, "G-Quadruplex", _literal(G4_NAMES)[F.col("pattern_id")], F.col("raw"), normalize_score(F.col("raw"), 0.5, 4.0, _span(), 120), "G4Hunter window")


def i_motif_hits(seqs: DataFrame) -> DataFrame:
    tracts = F.regexp_extract_all("matched", F.lit("(C{2,})"), F.lit(1))
    k = F.size(tracts)
    total = F.aggregate(tracts, F.lit(0), lambda a, t: a + F.length(t))
    raw = F.when((_span() < 12) | (k < 3), 0.0).otherwise(F.least(F.lit(1.0), total / _span() + F.least(F.lit(0.4), 0.12 * (k - 2))))
    return stranded_hits(seqs, IMOTIFS).filter("end - start >= 10").select("seq_id", "at", "start", "end", "strand", "pattern_id", F.round(raw, 6).alias("raw"))


def ac_motif_hits(seqs: DataFrame) -> DataFrame:
    long_tracts = lambda b: F.size(F.regexp_extract_all("matched", F.lit(f"({b}{{3,}})"), F.lit(1)))
    share = count_of(F.col("matched"), "AC") / _span()
    boost = F.when(F.col("pattern_id").isin("HUR_AC_5", "HUR_AC_6"), 0.12).otherwise(0.25)
    raw = F.least(F.lit(1.0), F.least(F.lit(0.6), share * 0.8) + F.when((long_tracts("A") >= 1) & (long_tracts("C") >= 3), 0.5).otherwise(0.0) + boost)
    return stranded_hits(seqs, AC_MOTIFS).select("seq_id", "at", "start", "end", "strand", "pattern_id", F.round(raw, 6).alias("raw"))


def i_motifs(seqs: DataFrame) -> DataFrame:
    """C-rich motifs on either strand; canonical and relaxed ones compete with each other, AC motifs among themselves; of tiles, in each tile."""
    kernel = kernels.i_motifs(IMOTIFS, AC_MOTIFS, "IM_EXT", ("HUR_AC_5", "HUR_AC_6"))
    hits = kernels.placed(seqs, kernel, {"strand": pa.string(), "pattern_id": pa.string(), "raw": pa.float64()}, "strand string, pattern_id string, raw double")
    names = F.when(F.col("pattern_id") == "IM_0", "Canonical i-motif").when(F.col("pattern_id") == "IM_EXT", "Relaxed i-motif").otherwise("AC-motif")
    return _motifs(hits, "i-Motif", names, F.col("raw"), normalize_score(F.col("raw"), 0.4, 1.0, _span(), 60), "C-tract density", strand=F.col("strand"))


def _tenmer_regions(seqs: DataFrame, table: list[tuple[str, float]], least: float) -> DataFrame:
    hits = kmer_hits(seqs, table).withColumn("end", F.col("start") + 10).withColumn("n", F.lit(1))
    return merged(hits, ["seq_id"], sums=("n", "value")).withColumn("raw", F.round("value", 6)).filter(F.col("raw") > least)


def z_dna(seqs: DataFrame) -> DataFrame:
    """Regions of touching or overlapping table 10-mers, by the sum of their scores."""
    regions = _tenmer_regions(seqs, z_tenmers(), 50.0)
    return _motifs(regions, "Z-DNA", F.lit("Z-DNA"), F.col("raw"), normalize_score(F.col("raw"), 50.0, _span() * 63.0 / 10.0, _span(), 300), "10-mer sum", F.lit("Z10"), attrs=F.create_map(F.lit("tenmers"), F.col("n").cast("string")))


def egz(seqs: DataFrame) -> DataFrame:
    n = F.floor(_span() / 3)
    raw = F.round(0.85 * n / 3, 6)
    return _motifs(placed_hits(seqs, EGZ), "Z-DNA", F.lit("eGZ"), raw, normalize_score(raw, 50.0, _span() * 63.0 / 10.0, _span(), 300), "Trinucleotide run", attrs=F.create_map(F.lit("copies"), n.cast("string")))


def a_philic(seqs: DataFrame) -> DataFrame:
    regions = _tenmer_regions(seqs, a_tenmers(), 0.5)
    most = max(v for _, v in a_tenmers())
    return _motifs(regions, "A-philic_DNA", F.lit("A-philic DNA"), F.col("raw"), normalize_score(F.col("raw"), 0.5, _span() * most / 10.0, _span(), 300), "10-mer sum", F.lit("A10"), attrs=F.create_map(F.lit("tenmers"), F.col("n").cast("string")))


#: By class, in the order in which ties between classes are resolved.
DETECTORS = {
    "Curved_DNA": (global_curvature, local_curvature),
    "Slipped_DNA": (slipped,),
    "Cruciform": (cruciform,),
    "R-Loop": (r_loops,),
    "Triplex": (h_dna, sticky),
    "G-Quadruplex": (quadruplexes,),
    "i-Motif": (i_motifs,),
    "Z-DNA": (z_dna, egz),
    "A-philic_DNA": (a_philic,),
}
