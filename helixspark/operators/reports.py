"""Report tables: input quality, workbooks, comparisons, features of motifs. ``lengths`` is a table (seq_id, seq_length)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import taxonomy
from ..functions.sequence import count_of, gc_content
from .intervals import DERIVED, coverage
from .series import whole_windows
from .statistics import class_coverage, class_pivot, enrichment, five_numbers, genomic_density, main_motifs, motif_statistics, positional_density

LETTERS = "ATGCNRYKMSWBDHV"


# Input quality


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preprocessed(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Raw input (a sequence with or without FASTA headers) as the input's columns and: header (the first one), seq, length,
    n_a, n_t, n_g, n_c, n_n, valid_bases, gc_pct, at_pct, balance, status, invalid (letter and its first ten places from 0), problem.

    status: error (empty, no base A, C, G or T, or letters outside of the alphabet), warning (N), else valid.
    """
    lines = F.transform(F.split(_stripped(F.upper(F.coalesce(text_col, F.lit("")))), "\n"), _stripped)
    title = F.get(F.filter(F.transform(F.filter(lines, lambda x: x.startswith(">")), lambda x: _stripped(F.substring(x, 2, 1 << 30))), lambda x: x != ""), 0)
    cut = raw.withColumn("header", F.coalesce(title, F.lit(""))).withColumn("seq", F.array_join(F.filter(lines, lambda x: ~x.startswith(">") & (x != "")), ""))
    seq = F.col("seq")
    odd = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(seq, f"[{LETTERS}]", ""), ""), lambda c: c != "")))
    # the text between a letter's first ten places: lengths of these few pieces, not a look at every place
    around = lambda c: F.split(seq, F.concat(F.lit("\\Q"), c, F.lit("\\E")), 11)
    places = lambda ps: F.transform(F.sequence(F.lit(1), F.size(ps) - 1), lambda i: F.aggregate(F.slice(ps, 1, i), i - 1, lambda a, x: a + F.length(x)))
    counted = cut.select("*", F.length(seq).cast("long").alias("length"), *(count_of(seq, b).alias(f"n_{b.lower()}") for b in "ATGCN"), F.transform(F.transform(odd, lambda c: F.struct(c.alias("letter"), around(c).alias("around"))), lambda x: F.struct(x["letter"].alias("letter"), places(x["around"]).alias("places"))).alias("invalid"))
    valid = F.col("n_a") + F.col("n_t") + F.col("n_g") + F.col("n_c")
    rated = counted.withColumn("valid_bases", valid).withColumn("gc_pct", F.when(valid > 0, (F.col("n_g") + F.col("n_c")) * 100.0 / valid).otherwise(0.0)).withColumn("at_pct", F.when(valid > 0, (F.col("n_a") + F.col("n_t")) * 100.0 / valid).otherwise(0.0))
    problem = (
        F.when(F.col("length") == 0, "empty sequence")
        .when(F.col("valid_bases") == 0, "no valid bases")
        .when(F.size("invalid") > 0, F.concat(F.lit("invalid characters: "), F.array_join(F.transform("invalid", lambda x: x["letter"]), "")))
        .when(F.col("n_n") > 0, F.concat(F.col("n_n").cast("string"), F.lit(" ambiguous bases N")))
    )
    balance = F.when(F.col("valid_bases") == 0, "").when(F.col("gc_pct") > 60, "GC-rich").when(F.col("gc_pct") < 40, "AT-rich").otherwise("Balanced")
    status = F.when((F.col("valid_bases") == 0) | (F.size("invalid") > 0), "error").when(F.col("n_n") > 0, "warning").otherwise("valid")
    return rated.withColumn("balance", balance).withColumn("status", status).withColumn("problem", F.coalesce(problem, F.lit("")))


def quality_report(clean: DataFrame) -> DataFrame:
    """One row over a table of preprocessed(): sequences, bases, mean GC of those with bases, and how many are valid, have warnings or errors."""
    return clean.agg(
        F.count("*").alias("total_sequences"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_length"), F.round(F.avg(F.when(F.col("valid_bases") > 0, F.col("gc_pct"))), 4).alias("average_gc"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("valid", "warning", "error")),
    )


def report_text(clean: DataFrame) -> DataFrame:
    """The input's columns and ``report``: a few lines to read for each preprocessed sequence."""
    share = lambda b: F.concat(F.lit(f"  {b.upper()}: "), F.format_number(f"n_{b}", 0), F.when(F.col("valid_bases") > 0, F.format_string(" (%.2f%%)", F.col(f"n_{b}") * 100.0 / F.col("valid_bases"))).otherwise(""))
    lines = [F.when(F.col("header") != "", F.concat(F.lit("Header: "), "header")), F.concat(F.lit("Length: "), F.format_number("length", 0), F.lit(" bp")), *(share(b) for b in "atgc"), F.when(F.col("n_n") > 0, F.concat(F.lit("  N: "), F.format_number("n_n", 0))), F.format_string("GC: %.2f%%, AT: %.2f%%, %s", "gc_pct", "at_pct", "balance"), F.concat(F.lit("Status: "), F.upper("status")), F.nullif("problem", F.lit(""))]
    return clean.withColumn("report", F.concat_ws("\n", *lines))


def plain_input(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Rows that consist of A, C, G, T and N alone (any case, blanks at the ends aside)."""
    return raw.filter(F.coalesce(_stripped(F.col(text_col)).rlike("^[ATCGNatcgn]+$"), F.lit(False)))


#: For each canonical column the spellings that may stand for it, the first that a row has counts.
FIELDS = {
    "class": ("Class", "Type"), "subclass": ("Subclass",), "start_pos": ("Start",), "end_pos": ("End",), "length": ("Length",), "score": ("Score",),
    "actual_score": ("Actual Score", "ActualScore", "Actual_Score"), "normalized_score": ("Normalized Score", "Normalized_Score"),
    "sequence": ("Motif", "matched_seq"), "seq_id": ("Sequence_Name", "sequence_name"),
}


def canonical(rows: DataFrame) -> DataFrame:
    """Motif rows of other spellings in canonical columns. A missing length is end - start (not + 1); scores stand in for each other."""
    have = set(rows.columns)
    pick = lambda name, kind: F.coalesce(*(F.col(f"`{c}`").cast(kind) for c in (*FIELDS[name], name) if c in have), F.lit(None).cast(kind))
    some = lambda x: F.when(x != 0, x)  # noqa: E731  zero counts as missing
    start, end, length = (pick(c, "long") for c in ("start_pos", "end_pos", "length"))
    actual = F.coalesce(some(pick("actual_score", "double")), some(pick("score", "double")), F.lit(0.0))
    text = lambda name, default: F.coalesce(F.nullif(pick(name, "string"), F.lit("")), F.lit(default))
    return rows.select(
        text("seq_id", "").alias("seq_id"), text("class", "Unknown").alias("class"), text("subclass", "Other").alias("subclass"), start.alias("start_pos"), end.alias("end_pos"), F.coalesce(some(length), F.when((start != 0) & (end != 0), end - start), length).alias("length"),
        F.coalesce(some(pick("score", "double")), actual).alias("score"), actual.alias("actual_score"), F.coalesce(pick("normalized_score", "double"), F.lit(0.0)).alias("normalized_score"), text("sequence", "").alias("sequence"),
    )


# Workbooks: every sheet is a table


def results_workbook(motifs: DataFrame, simple: bool = False) -> dict[str, DataFrame]:
    """Sheets of results: two of core columns (``simple``), or core results, one for each class, hybrids and clusters."""
    main = main_motifs(motifs)
    if simple:
        return {"NonOverlappingConsolidated": main, "OverlappingAll": motifs}
    classes = [r["class"] for r in taxonomy(motifs.sparkSession).filter(~F.col("class").isin(*DERIVED)).select("class").distinct().orderBy("class").collect()]
    each = {c.replace("-", "_").replace(" ", "_").replace("/", "_")[:31]: motifs.filter(F.col("class") == c) for c in classes}
    return {"Core_Results": main, **each, "Hybrid_Motifs": motifs.filter("class = 'Hybrid'"), "Cluster_Motifs": motifs.filter("class = 'Non-B_DNA_Clusters'")}


def _related(names: DataFrame) -> Column:
    flat = lambda c: F.translate(c, "- ", "__")
    return F.contains(flat("other"), flat("class"))


def depth_by_place(motifs: DataFrame, keys: list[str], width: int = 100_000) -> DataFrame:
    """(keys, position, n): how many motifs cover each place that any covers.

    A sweep over starts and ends in every stretch of ``width`` places; only the result has a row for each place.
    """
    parts = F.explode(F.sequence(F.floor(F.col("start_pos") / width), F.floor(F.col("end_pos") / width)))
    cut = motifs.filter("start_pos <= end_pos").select(*keys, "start_pos", "end_pos", parts.alias("_part"))
    ends = F.array(F.struct(F.greatest("start_pos", F.col("_part") * width).alias("pos"), F.lit(1).alias("d")), F.struct((F.least("end_pos", (F.col("_part") + 1) * width - 1) + 1).alias("pos"), F.lit(-1).alias("d")))
    steps = cut.select(*keys, "_part", F.explode(ends).alias("s")).groupBy(*keys, "_part", F.col("s.pos").alias("pos")).agg(F.sum("s.d").alias("d"))
    order = Window.partitionBy(*keys, "_part").orderBy("pos")
    runs = steps.select(*keys, "pos", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("pos").over(order).alias("next")).filter("n > 0")
    return runs.select(*keys, F.explode(F.sequence("pos", F.col("next") - 1)).alias("position"), "n")


def positional_occurrence(motifs: DataFrame) -> DataFrame:
    """(position, class, subclass, n): how many motifs cover each place, for every class by those subclasses whose name holds the class's; without any, by the class alone ("Unknown")."""
    by_subclass = depth_by_place(motifs.withColumnRenamed("subclass", "other"), ["other"])
    names = motifs.select("class").distinct()
    pairs = names.join(F.broadcast(motifs.select(F.col("subclass").alias("other")).distinct()), _related(names))  # names of the taxonomy: a few dozen
    alone = names.join(pairs.select("class").distinct(), "class", "left_anti")
    some = by_subclass.join(F.broadcast(pairs), "other").select("position", "class", F.col("other").alias("subclass"), "n")
    rest = depth_by_place(motifs.join(F.broadcast(alone), "class"), ["class"]).select("position", "class", F.lit("Unknown").alias("subclass"), "n")
    return some.unionByName(rest)


def multifasta_workbook(motifs: DataFrame, lengths: DataFrame, equal_length: bool = False) -> dict[str, DataFrame]:
    """Sheets All_Motifs, Sequence_Summary, Class_Summary, and for sequences of one length Positional_Occurrence."""
    n = motifs.groupBy("seq_id").agg(F.count("*").alias("n"))
    summary = lengths.join(n, "seq_id", "left").select("seq_id", F.col("seq_length").alias("length"), F.coalesce("n", F.lit(0)).alias("total_motifs"), F.round(F.when(F.col("seq_length") > 0, F.coalesce("n", F.lit(0)) * 1000.0 / F.col("seq_length")).otherwise(0.0), 2).alias("motifs_per_kb"))
    sheets = {"All_Motifs": motifs, "Sequence_Summary": summary, "Class_Summary": motifs.groupBy("class", "subclass").agg(F.count("*").alias("total_count"))}
    return sheets | ({"Positional_Occurrence": positional_occurrence(motifs)} if equal_length else {})


def _long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select(*keys, "m.metric", "m.value")


def derived_coverage(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(seq_id, hybrid_covered_bp, hybrid_coverage_pct, hybrid_per_bp, cluster_covered_bp, cluster_coverage_pct)."""
    g = F.col("seq_length")
    part = lambda name, as_: coverage(motifs.filter(F.col("class") == name), ["seq_id"]).withColumnRenamed("covered_bp", as_)
    n = motifs.filter("class = 'Hybrid'").groupBy("seq_id").agg(F.count("*").alias("_n"))
    all_ = lengths.join(part("Hybrid", "_h"), "seq_id", "left").join(part("Non-B_DNA_Clusters", "_c"), "seq_id", "left").join(n, "seq_id", "left").na.fill(0, ["_h", "_c", "_n"])
    return all_.select("seq_id", F.col("_h").alias("hybrid_covered_bp"), F.round(F.col("_h") * 100.0 / g, 4).alias("hybrid_coverage_pct"), F.round(F.col("_n") / g, 8).alias("hybrid_per_bp"), F.col("_c").alias("cluster_covered_bp"), F.round(F.col("_c") * 100.0 / g, 4).alias("cluster_coverage_pct"))


def class_sheet(motifs: DataFrame, lengths: DataFrame, by: str = "class") -> DataFrame:
    """(seq_id, by, n, covered_bp, coverage_pct, contribution, per_kb, mean_score): the density sheet of classes or subclasses."""
    n = main_motifs(motifs).groupBy("seq_id", by).agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"))
    return n.join(class_coverage(motifs, lengths, by), ["seq_id", by]).join(lengths, "seq_id").select("seq_id", by, "n", "covered_bp", "coverage_pct", "contribution", F.round(F.col("n") * 1000.0 / F.col("seq_length"), 2).alias("per_kb"), "mean_score")


def statistics_workbook(motifs: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    """Sheets Summary (seq_id, metric, value), Class, Subclass, Length_Distribution and Score_Distribution."""
    stats = motif_statistics(motifs, lengths).join(derived_coverage(motifs, lengths), "seq_id")
    main = main_motifs(motifs)
    return {"Summary": _long(stats, ["seq_id"], [c for c in stats.columns if c != "seq_id"]), "Class": class_sheet(motifs, lengths), "Subclass": class_sheet(motifs, lengths, "subclass"), "Length_Distribution": five_numbers(main, "class", "length"), "Score_Distribution": five_numbers(main, "class", "score")}


def enhanced_statistics(motifs: DataFrame, lengths: DataFrame, seqs: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(seq_id, part, class, metric, value): basic statistics, densities, motifs per kb and per Mb, and with ``seqs`` the enrichment over shuffled sequences (all sequences together: seq_id null)."""
    basic = motif_statistics(motifs, lengths)
    out = _long(basic.withColumn("part", F.lit("basic")).withColumn("class", F.lit(None).cast("string")), ["seq_id", "part", "class"], [c for c in basic.columns if c != "seq_id"])
    tables = [("genomic_density", genomic_density(motifs, lengths), "density_pct"), ("per_kbp", positional_density(motifs, lengths), "per_unit"), ("per_mbp", positional_density(motifs, lengths, 1_000_000), "per_unit")]
    for part, df, metric in tables:
        out = out.unionByName(_long(df.withColumn("part", F.lit(part)), ["seq_id", "part", "class"], [metric]))
    if seqs is not None:
        found = enrichment(seqs, rounds=rounds)
        out = out.unionByName(_long(found.withColumn("part", F.lit("enrichment")).withColumn("seq_id", F.lit(None).cast("string")), ["seq_id", "part", "class"], [c for c in found.columns if c != "class"]))
    return out


# Comparison of files: motifs and lengths have a column source_file


def file_densities(motifs: DataFrame, lengths: DataFrame, by: str = "class") -> DataFrame:
    """(source_file, by, n, per_kb, coverage_pct): coverage is clipped at the sequences' ends."""
    total = lengths.groupBy("source_file").agg(F.sum("seq_length").alias("_bp"))
    cover = coverage(motifs.join(lengths.select("source_file", "seq_id", "seq_length"), ["source_file", "seq_id"]), ["source_file", "seq_id", by], F.col("seq_length")).groupBy("source_file", by).agg(F.sum("covered_bp").alias("_c"))
    n = motifs.groupBy("source_file", by).agg(F.count("*").alias("n"))
    return n.join(cover, ["source_file", by], "left").join(total, "source_file").select("source_file", by, "n", F.round(F.col("n") * 1000.0 / F.col("_bp"), 4).alias("per_kb"), F.round(F.coalesce("_c", F.lit(0)) * 100.0 / F.col("_bp"), 3).alias("coverage_pct"))


def file_pivot(motifs: DataFrame, lengths: DataFrame, classes: list[str], value: str = "per_kb") -> DataFrame:
    """Files against classes: n, per_kb or coverage_pct; 0 where a file lacks a class."""
    return file_densities(motifs, lengths).groupBy("source_file").pivot("class", classes).agg(F.first(value)).na.fill(0)


def count_pivot(motifs: DataFrame, classes: list[str]) -> DataFrame:
    return class_pivot(motifs.withColumn("seq_id", F.col("source_file")), classes).withColumnRenamed("seq_id", "source_file")


def overall_statistics(motifs: DataFrame, lengths: DataFrame, by: str = "class") -> DataFrame:
    """(by, total_count, mean_length, mean_score, per_kb, coverage_pct) over all files together."""
    bp = lengths.agg(F.sum("seq_length").alias("_bp"))
    cover = coverage(motifs.join(lengths.select("source_file", "seq_id", "seq_length"), ["source_file", "seq_id"]), ["source_file", "seq_id", by], F.col("seq_length")).groupBy(by).agg(F.sum("covered_bp").alias("_c"))
    rows = motifs.groupBy(by).agg(F.count("*").alias("total_count"), F.round(F.avg("length"), 3).alias("mean_length"), F.round(F.avg("score"), 3).alias("mean_score"))
    total = bp.first()["_bp"] or 1
    return rows.join(cover, by, "left").select(by, "total_count", "mean_length", "mean_score", F.round(F.col("total_count") * 1000.0 / total, 4).alias("per_kb"), F.round(F.coalesce("_c", F.lit(0)) * 100.0 / total, 3).alias("coverage_pct"))


def file_comparison(motifs: DataFrame, lengths: DataFrame, seqs: DataFrame | None = None) -> DataFrame:
    """One row a file: species and region (its name up to and after the first underscore), motifs, bases, density, coverage,
    mean and median length, classes, subclasses, hybrids, clusters; with ``seqs`` (source_file, seq) GC per cent too."""
    total = lengths.groupBy("source_file").agg(F.sum("seq_length").alias("seq_length_bp"))
    cover = coverage(motifs.join(lengths.select("source_file", "seq_id", "seq_length"), ["source_file", "seq_id"]), ["source_file", "seq_id"], F.col("seq_length")).groupBy("source_file").agg(F.sum("covered_bp").alias("_c"))
    n = motifs.groupBy("source_file").agg(F.count("*").alias("n"), F.avg("length").alias("_mean"), F.median("length").alias("_median"), F.count_distinct("class").alias("_classes"), F.count_distinct("subclass").alias("_subclasses"), F.count_if(F.col("class") == "Hybrid").alias("_h"), F.count_if(F.col("class") == "Non-B_DNA_Clusters").alias("_k"))
    rows = total.join(n, "source_file", "left").join(cover, "source_file", "left").na.fill(0)
    at = F.instr("source_file", "_")
    out = rows.select(
        "source_file", F.when(at == 0, F.col("source_file")).otherwise(F.substr("source_file", F.lit(1), at - 1)).alias("species"), F.when(at == 0, "unknown").otherwise(F.substr("source_file", at + 1)).alias("region"),
        F.col("n").alias("total_motifs"), "seq_length_bp", F.round(F.col("n") * 1000.0 / F.col("seq_length_bp"), 4).alias("density_per_kb"), F.round(F.col("_c") * 100.0 / F.col("seq_length_bp"), 3).alias("coverage_pct"),
        F.round("_mean", 2).alias("mean_motif_length"), F.round("_median", 2).alias("median_motif_length"), F.col("_classes").alias("unique_classes"), F.col("_subclasses").alias("unique_subclasses"), F.col("_h").alias("hybrids"), F.col("_k").alias("clusters"),
    )
    if seqs is None:
        return out
    gc = seqs.groupBy("source_file").agg(F.round(F.sum(count_of(F.col("seq"), "GC")) * 100.0 / F.sum(count_of(F.col("seq"), "ACGT")), 4).alias("gc_pct"))
    return out.join(gc, "source_file", "left")


def across_species(comparison: DataFrame, value: str = "density_per_kb") -> DataFrame:
    """(species, region, mean): the long form of the heat map of a column of file_comparison."""
    return comparison.groupBy("species", "region").agg(F.round(F.avg(value), 6).alias("mean"))


# Tables behind further plots


def _shown(motifs: DataFrame) -> DataFrame:
    """Without hybrids and clusters, for sequences that have other motifs."""
    has = F.max(F.when(~F.col("class").isin(*DERIVED), 1).otherwise(0)).over(Window.partitionBy("seq_id"))
    return motifs.withColumn("_has", has).filter((F.col("_has") == 0) | ~F.col("class").isin(*DERIVED)).drop("_has")


def radial_density(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(seq_id, class, per_kb, theta): motifs per kb of each class, the classes spread evenly over a circle by name."""
    n = _shown(motifs).groupBy("seq_id", "class").agg(F.count("*").alias("n")).join(lengths, "seq_id")
    own = Window.partitionBy("seq_id")
    theta = (F.row_number().over(own.orderBy("class")) - 1) * (2 * math.pi) / F.count("*").over(own)
    return n.select("seq_id", "class", F.round(F.col("n") * 1000.0 / F.col("seq_length"), 6).alias("per_kb"), F.round(theta, 6).alias("theta"))


def class_counts_sorted(motifs: DataFrame) -> DataFrame:
    """(seq_id, class, n, place): classes of each sequence, the most frequent first."""
    n = _shown(motifs).groupBy("seq_id", "class").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("n"), "class")))


def tracks(motifs: DataFrame, by: str = "class") -> DataFrame:
    """(seq_id, track, by, start_pos, width, score): one track for each class or subclass of a sequence, from 0 by name."""
    rows = motifs.select("seq_id", by, "start_pos", "end_pos", "score")
    names = rows.select("seq_id", by).distinct().withColumn("track", F.row_number().over(Window.partitionBy("seq_id").orderBy(by)) - 1)
    return rows.join(names, ["seq_id", by]).select("seq_id", "track", by, "start_pos", (F.col("end_pos") - F.col("start_pos") + 1).alias("width"), "score")


def density_comparison(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(seq_id, class, density_pct, per_kb): covered share and motifs per kb of each class side by side, "Overall" too."""
    return genomic_density(motifs, lengths).join(positional_density(main_motifs(motifs), lengths), ["seq_id", "class"]).select("seq_id", "class", "density_pct", F.col("per_unit").alias("per_kb"))


def batch_co_occurrence(motifs: DataFrame) -> DataFrame:
    """(class_a, class_b, n): in how many sequences (batches) both classes occur."""
    has = motifs.select("seq_id", "class").distinct().groupBy("seq_id").agg(F.sort_array(F.collect_set("class")).alias("c"))  # at most the taxonomy's classes
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return has.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("class_a"), F.col("p.b").alias("class_b")).agg(F.count("*").alias("n"))


def overlapped_windows_gc(seqs: DataFrame, motifs: DataFrame, width: int = 100) -> DataFrame:
    """(seq_id, window, gc_pct, per_kb): GC of the known bases of each whole window against motifs that overlap it, all classes, per kb."""
    tiles = whole_windows(seqs, width)
    at = F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / width), F.floor((F.col("end_pos") - 1) / width)))
    counts = motifs.select("seq_id", at.alias("_w")).select("seq_id", F.col("_w").cast("int").alias("window")).groupBy("seq_id", "window").agg(F.count("*").alias("n"))
    return tiles.join(counts, ["seq_id", "window"], "left").select("seq_id", "window", F.round(gc_content(F.col("part")), 4).alias("gc_pct"), F.round(F.coalesce("n", F.lit(0)) * 1000.0 / width, 4).alias("per_kb"))


def motif_info(spark) -> DataFrame:
    """(class_id, class, n_subclasses, subclasses)."""
    return taxonomy(spark).groupBy("class_id", "class").agg(F.count("*").alias("n_subclasses"), F.array_join(F.sort_array(F.collect_list("subclass")), ", ").alias("subclasses"))


# Features of motifs; ``sequence`` holds a motif's letters


def quadruplex_features(motifs: DataFrame) -> DataFrame:
    """G tracts of two and more, and the loops between and beside them: numbers, lengths, least, greatest, mean; GC per cent."""
    tracts = F.regexp_extract_all("sequence", F.lit("(G{2,})"), F.lit(1))
    loops = F.when(F.size(tracts) > 1, F.filter(F.split("sequence", "G{2,}"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    sized = motifs.filter("class = 'G-Quadruplex'").withColumn("_t", F.transform(tracts, F.length)).withColumn("_l", F.transform(loops, F.length))
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c), 2)
    numbers = lambda c, name: [F.size(c).alias(f"num_{name}s"), F.array_join(F.col(c).cast("array<string>"), ",").alias(f"{name}_lengths"), F.coalesce(F.array_min(c), F.lit(0)).alias(f"min_{name}_length"), F.coalesce(F.array_max(c), F.lit(0)).alias(f"max_{name}_length"), F.when(F.size(c) > 0, mean(c)).otherwise(0.0).alias(f"avg_{name}_length")]
    return sized.select("seq_id", "subclass", "start_pos", "end_pos", F.round(gc_content(F.col("sequence")), 2).alias("gc_content"), *numbers("_t", "tract"), *numbers("_l", "loop"))


def repeat_types(motifs: DataFrame) -> DataFrame:
    """(seq_id, start_pos, end_pos, unit, unit_size, copies, type_of_repeat) of slipped motifs, from their attributes."""
    unit = F.col("attrs")["unit"]
    n = F.length(unit)
    names = {1: "Mononucleotide", 2: "Dinucleotide", 3: "Trinucleotide", 4: "Tetranucleotide", 5: "Pentanucleotide", 6: "Hexanucleotide"}
    kind = F.create_map(*(F.lit(x) for k in names.items() for x in k))[n]
    of = F.when(n <= 6, F.format_string("%s (%s)", kind, unit)).when(n < 20, F.format_string("Short tandem repeat (%s, %dbp)", unit, n)).otherwise(F.format_string("Long direct repeat (%dbp unit)", n))
    return motifs.filter("class = 'Slipped_DNA'").select("seq_id", "start_pos", "end_pos", unit.alias("unit"), n.alias("unit_size"), F.col("attrs")["copy_number"].cast("double").alias("copies"), of.alias("type_of_repeat"))


def sticky_ranges(motifs: DataFrame) -> DataFrame:
    """(seq_id, start_pos, end_pos, copies, range) of sticky DNA: weak (4 to 19 copies), replication blockage (20 to 39), sticky threshold (40 to 59), pathogenic (60 and more)."""
    copies = F.col("attrs")["copies"].cast("long")
    name = F.when(copies >= 60, "pathogenic").when(copies >= 40, "sticky threshold").when(copies >= 20, "replication blockage").otherwise("weak")
    return motifs.filter("subclass = 'Sticky DNA'").select("seq_id", "start_pos", "end_pos", copies.alias("copies"), name.alias("range"))
