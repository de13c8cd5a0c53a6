"""Tables behind plots: windows, co-occurrence, cumulative counts, distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import ahead, class_counts_ahead
from .statistics import main_motifs
from .tiling import cut


def windowed(motifs: DataFrame, length: int, width: int, by: str = "class") -> DataFrame:
    """(seq_id, window, by, n, per_kb, mean_score): motifs in every window of ``width`` that they overlap; the tail is left out."""
    windows = max(1, length // width)
    at = F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / width), F.least(F.floor((F.col("end_pos") - 1) / width), F.lit(windows - 1))))
    rows = motifs.filter((F.col("start_pos") - 1) < windows * width).select("seq_id", at.alias("window"), by, "score")
    return rows.groupBy("seq_id", "window", by).agg(F.count("*").alias("n"), F.round(F.count("*") * 1000.0 / width, 4).alias("per_kb"), F.round(F.avg("score"), 4).alias("mean_score"))


def equal_windows(motifs: DataFrame, length: int, n: int, by: str = "class", shift: int = 0) -> DataFrame:
    """Counts of starts in n windows of equal (not whole) width; ``shift`` 1 for subclasses: places from 0."""
    at = F.least(F.floor((F.col("start_pos") - shift) * n / float(length)), F.lit(n - 1))
    return motifs.filter(F.col("start_pos") - shift < length).groupBy("seq_id", at.alias("window"), by).agg(F.count("*").alias("n"))


def whole_windows(seqs: DataFrame, width: int) -> DataFrame:
    """(seq_id, window, part): the sequences cut into windows of ``width`` letters; a shorter tail is left out."""
    return cut(seqs, width).filter(F.col("hi") == width).select("seq_id", F.floor(F.col("at") / width).cast("int").alias("window"), F.col("seq").alias("part"))


def gc_windows(seqs: DataFrame, motifs: DataFrame, width: int = 100) -> DataFrame:
    """GC per cent of each whole window of a sequence against the main motifs whose middle lies in it."""
    gc = whole_windows(seqs, width).select("seq_id", "window", F.round((F.length("part") - F.length(F.translate("part", "GC", ""))) * 100.0 / width, 4).alias("gc_pct"))
    middle = F.floor((F.col("start_pos") - 1 + F.col("end_pos")) / 2 / width).cast("int")
    counts = main_motifs(motifs).groupBy("seq_id", middle.alias("window")).agg(F.count("*").alias("n"))
    return gc.join(counts, ["seq_id", "window"], "left").select("seq_id", "window", "gc_pct", F.coalesce("n", F.lit(0)).alias("n"))


def gc_fit(windows: DataFrame) -> DataFrame:
    """Correlation and line of counts on GC for each sequence."""
    return windows.groupBy("seq_id").agg(F.corr("gc_pct", "n").alias("corr"), F.regr_slope("n", "gc_pct").alias("slope"), F.regr_intercept("n", "gc_pct").alias("intercept"))


def cumulative(motifs: DataFrame, by: str = "class") -> DataFrame:
    order = Window.partitionBy("seq_id", by).orderBy("start_pos", "end_pos", "score").rowsBetween(Window.unboundedPreceding, 0)
    return motifs.select("seq_id", by, "start_pos", "end_pos", "score", F.count("*").over(order).alias("cumulative"))


def _pair_counts(motifs: DataFrame, by: str, reach: int) -> DataFrame:
    """(x, y, n): how many motifs of group y start after one of group x, at most ``reach`` behind its end. Counted, not paired."""

    def kernel(rows: pa.Table, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        names, counts = class_counts_ahead(rows, by, first, last)
        group = rows.column(by).take(pa.array(own)).to_numpy(zero_copy_only=False)
        sums = [(x, y, int(n)) for x in names for y, n in zip(names, counts[group == x].sum(axis=0), strict=True) if n]
        yield {"x": pa.array([r[0] for r in sums], pa.string()), "y": pa.array([r[1] for r in sums], pa.string()), "n": pa.array([r[2] for r in sums], pa.int64())}

    typed = motifs.withColumn(by, F.col(by).cast("string"))
    return ahead(typed, [c for c in (by, "event_id") if c in motifs.columns], kernel, "x string, y string, n long", reach)


def co_occurrence(motifs: DataFrame, reach: int = 1) -> DataFrame:
    """Pairs of classes by the motifs of a sequence that overlap or are at most ``reach`` apart."""
    return _pair_counts(motifs, "class", reach).groupBy(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).agg(F.sum("n").alias("n"))


def overlap_counts(motifs: DataFrame, by: str = "class", top: int | None = 10) -> DataFrame:
    """Pairs of different groups whose motifs overlap by more than a border, the most frequent first; ``top`` is the report's length."""
    out = _pair_counts(motifs, by, -1).filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"))
    return out.orderBy(F.desc("n"), "a", "b").limit(top) if top else out


def class_combinations(motifs: DataFrame) -> DataFrame:
    """How often each set of classes overlaps a motif (the motif's own class with it)."""
    keys = ["start_pos", "end_pos", "class", *(["_id"] if "event_id" in motifs.columns else [])]

    def kernel(rows: pa.Table, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        names, counts = class_counts_ahead(rows, "class", first, last)
        place = np.argsort(np.array(names))
        mine = rows.select(keys).take(pa.array(own)).to_pandas()
        held = pd.DataFrame(counts[:, place] > 0, index=pd.MultiIndex.from_frame(mine))
        held = held[held.any(axis=1) & mine["class"].notna().to_numpy()]
        sets = held.groupby(level=list(range(len(keys)))).any() if held.index.has_duplicates else held  # rows that are alike are one motif
        has = sets.to_numpy() | (np.array(sorted(names))[None, :] == sets.index.get_level_values(2).to_numpy()[:, None])
        kinds, n = np.unique(has, axis=0, return_counts=True)
        yield {"classes": pa.array(["+".join(x for x, y in zip(sorted(names), kind.tolist(), strict=True) if y) for kind in kinds], pa.string()), "n": pa.array(n, pa.int64())}

    return ahead(motifs, [c for c in ("class", "event_id") if c in motifs.columns], kernel, "classes string, n long", -1).groupBy("classes").agg(F.sum("n").alias("n"))


def gaps(motifs: DataFrame) -> DataFrame:
    """Distances between consecutive motifs, 0 at least; the last of a sequence has none."""
    after = Window.partitionBy("seq_id").orderBy("start_pos", "end_pos")
    each = motifs.select("seq_id", "start_pos", "end_pos", F.lead("start_pos").over(after).alias("_next")).filter("_next is not null")
    return each.select("seq_id", "start_pos", "end_pos", F.greatest(F.lit(0), F.col("_next") - F.col("end_pos")).alias("gap"))


def structural_heatmap(motifs: DataFrame, length: int, bins: int = 50) -> DataFrame:
    """Counts of each class in equal bins, over the class's greatest bin."""
    n = equal_windows(motifs, length, bins)
    return n.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy("seq_id", "class")), 6))


def binned(motifs: DataFrame, length: int, bins: int = 100, longest: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Histograms of starts over the sequence and of lengths (longer ones in the last bin), of all motifs or of each group."""
    start = F.least(F.floor((F.col("start_pos") - 1) * bins / float(length)), F.lit(bins - 1))
    size = F.least(F.floor(F.col("length") * bins / float(longest)), F.lit(bins - 1))
    both = F.explode(F.array(F.struct(F.lit("start").alias("what"), start.alias("bin")), F.struct(F.lit("length").alias("what"), size.alias("bin"))))
    return motifs.select(*by, both.alias("b")).groupBy(*by, "b.what", "b.bin").agg(F.count("*").alias("n"))


def attribute_lengths(motifs: DataFrame, attribute: str) -> DataFrame:
    """A numeric attribute (arm, loop) of the motifs that have it."""
    return motifs.select("seq_id", "class", F.col("attrs")[attribute].cast("double").alias(attribute)).filter(F.col(attribute).isNotNull())


def cluster_sizes(motifs: DataFrame) -> DataFrame:
    return motifs.filter("class = 'Non-B_DNA_Clusters'").groupBy("motif_count", "class_diversity").agg(F.count("*").alias("n"))


def density_curves(motifs: DataFrame, value: str = "length", by: str = "class", points: int = 100, bins: int = 400) -> DataFrame:
    """(by, x, density): Gaussian density curves of a column, one for each group, at ``points`` places from 3 bandwidths below its least value to 3 above its greatest.

    The bandwidth is Scott's: the sample deviation times n ** (-1/5). Values are counted in ``bins`` bins of equal width
    first, so the sums run over bins x points, not over rows; a group of one value is left out.
    """
    v = F.col(value).cast("double")
    about = motifs.filter(v.isNotNull()).groupBy(by).agg(F.count("*").alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.stddev_samp(v).alias("_sd")).filter("_sd > 0")
    about = about.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    at = F.least(F.floor((v - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))
    counts = motifs.filter(v.isNotNull()).join(about, by).groupBy(by, at.alias("_b")).agg(F.count("*").alias("_c"))
    step = (F.col("_hi") - F.col("_lo") + 6 * F.col("_h")) / (points - 1)
    placed = counts.join(about, by).select(by, "_n", "_h", "_c", (F.col("_lo") + (F.col("_b") + 0.5) * F.col("_w")).alias("_m"), (F.col("_lo") - 3 * F.col("_h")).alias("_from"), step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("_from") + F.col("i") * F.col("_step")
    part = F.col("_c") * F.exp(-0.5 * F.pow((x - F.col("_m")) / F.col("_h"), F.lit(2.0)))
    sums = placed.groupBy(by, "i", "_n", "_h", x.alias("x")).agg(F.sum(part).alias("_s"))
    return sums.select(by, "i", F.round("x", 6).alias("x"), F.round(F.col("_s") / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())), 9).alias("density"))
