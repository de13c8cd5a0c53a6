"""More registered queries: whole detectors, greedy selections, files, workbooks and comparisons, with DuckDB twins.

The twins are written from the operators' definitions: greedy choices by folding a sorted list, pairs by range joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import LENGTH, MAIN_CLASSES, WITH_MOTIF, WITH_SEQ, _COVER, _hits_sql, _m, _picked, _q, _score_sql, motifs, sequences
from .functions import registry, scoring
from .functions.tables import TAXONOMY
from .operators import detectors, intervals, reports, series, statistics
from .plans.scan import detect, scan
from .sources import readers, writers


def _greedy_sql(rows: str, keys: str, fields: str, order: str) -> str:
    """rows kept when taken in order, each if its [s, e) overlaps none kept before; fields: what a row is, with s and e."""
    return f"""(SELECT {keys}, unnest(list_reduce(list([{fields}] ORDER BY {order}), lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.s < x[1].e AND k.e > x[1].s)) > 0 THEN a ELSE list_concat(a, x) END)) AS k FROM {rows} GROUP BY {keys})"""


BOTH = ", both_(seq_id, strand, n, seq) AS (SELECT seq_id, '+', length(seq), seq FROM sequences UNION ALL SELECT seq_id, '-', length(seq), reverse(translate(seq, 'ACGT', 'TGCA')) FROM sequences)"
_FORWARD = """SELECT seq_id, CASE strand WHEN '+' THEN "start" ELSE n - "end" END AS s, CASE strand WHEN '+' THEN "end" ELSE n - "start" END AS e, strand, pattern_id, matched FROM {hits}"""

_G4_HITS = f"""{WITH_SEQ},
run AS (SELECT seq_id, greatest(0, "start" - 50) AS a, "start" + 200 AS b FROM {_hits_sql({'g': 'G{3,}'})}),
isl AS (SELECT *, sum(f) OVER (PARTITION BY seq_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY seq_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM run)),
area AS (SELECT seq_id, min(a) AS area, max(b) AS b FROM isl GROUP BY seq_id, g),
win AS (SELECT seq_id, area, substr(seq, area + 1, least(b, length(seq)) - area) AS seq FROM area JOIN sequences USING (seq_id)),
hit AS (SELECT seq_id, area + "start" AS s, area + "end" AS e, pattern_id, matched, least(25, "end" - "start") AS w FROM {_hits_sql(detectors.QUADRUPLEXES, 'win', 'seq_id, area')} WHERE "end" - "start" >= 8),
rated AS (SELECT seq_id, s, e, pattern_id, round(list_max(list_transform(range(1, e - s - w + 2), lambda i: w - length(replace(substr(matched, i, w), 'G', ''))))::DOUBLE / w * ((e - s)::DOUBLE / w), 6) AS raw FROM hit)"""
_G4_NAMES = "nm(pattern_id, subclass, priority) AS (VALUES " + ", ".join(f"('{p}', '{name}', {i})" for i, (p, name) in enumerate(detectors.G4_NAMES.items())) + ")"
_G4_KEPT = _greedy_sql("(SELECT * FROM rated JOIN nm USING (pattern_id))", "seq_id", "{'s': s, 'e': e, 'raw': raw, 'pattern_id': pattern_id, 'subclass': subclass}", "raw DESC, priority, e - s DESC, s, e")

_TRACTS = "regexp_extract_all(matched, 'C{2,}')"
_I_RATED = f"""im AS (SELECT *, round(CASE WHEN e - s < 12 OR len({_TRACTS}) < 3 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform({_TRACTS}, lambda t: length(t)))::DOUBLE / (e - s) + least(0.4::DOUBLE, 0.12::DOUBLE * (len({_TRACTS}) - 2))) END, 6) AS raw FROM ({_FORWARD.format(hits=_hits_sql(detectors.IMOTIFS, 'both_', 'seq_id, strand, n'))}) WHERE e - s >= 10),
ac AS (SELECT *, round(least(1.0::DOUBLE, least(0.6::DOUBLE, length(regexp_replace(matched, '[^AC]', '', 'g'))::DOUBLE / (e - s) * 0.8::DOUBLE) + CASE WHEN len(regexp_extract_all(matched, 'A{{3,}}')) >= 1 AND len(regexp_extract_all(matched, 'C{{3,}}')) >= 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN pattern_id IN ('HUR_AC_5', 'HUR_AC_6') THEN 0.12::DOUBLE ELSE 0.25::DOUBLE END), 6) AS raw FROM ({_FORWARD.format(hits=_hits_sql(detectors.AC_MOTIFS, 'both_', 'seq_id, strand, n'))}))"""
_I_FIELDS = "{'s': s, 'e': e, 'raw': raw, 'pattern_id': pattern_id, 'strand': strand}"

_R_LOOPS = f"""{WITH_SEQ}{BOTH},
riz AS (SELECT h.seq_id, h.strand, h.n, pattern_id, "start" AS s, "end" AS e, round(length(regexp_replace(matched, '[^G]', '', 'g')) * 100.0::DOUBLE / ("end" - "start"), 2) AS riz, substr(seq, "end" + 1, 2000) AS ahead
  FROM {_hits_sql(detectors.RLOOPS, 'both_', 'seq_id, strand, n')} h JOIN both_ USING (seq_id, strand)),
ok AS (SELECT *, row_number() OVER () AS rid FROM riz WHERE riz >= 50),
st AS (SELECT rid, ahead, unnest(list_filter([50 + 100 * k for k in range(20)], lambda a: a < length(ahead) AND (length(substr(ahead, a + 1, 100)) - length(replace(substr(ahead, a + 1, 100), 'G', ''))) * 100.0 / length(substr(ahead, a + 1, 100)) >= 40)) AS a FROM ok),
zn AS (SELECT rid, a, b, b - a - length(replace(substr(ahead, a + 1, b - a), 'G', '')) AS g FROM (SELECT *, unnest(list_filter([50 * k for k in range(1, 40)], lambda b: b > a AND b < length(ahead))) AS b FROM st)),
bz AS (SELECT rid, a, b, g FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY g DESC, a, b) AS r FROM zn WHERE g * 100.0 / (b - a) >= 40 AND g > 0) WHERE r = 1),
al AS (SELECT ok.*, coalesce(round(g * 100.0::DOUBLE / (b - a), 2), 0.0::DOUBLE) AS rez, e + coalesce(b, 0) AS stop FROM ok LEFT JOIN bz USING (rid)),
rw AS (SELECT *, round(least(1.0::DOUBLE, riz / 100.0::DOUBLE + rez / 100.0::DOUBLE), 6) AS raw FROM al)
SELECT seq_id, 'R-loop formation sites' AS subclass, CASE strand WHEN '+' THEN s ELSE n - stop END + 1 AS start_pos, CASE strand WHEN '+' THEN stop ELSE n - s END AS end_pos, strand, raw AS raw_score, {_score_sql('raw', '0.4::DOUBLE', '1.0::DOUBLE', 'stop - s', 2000)} AS score, pattern_id FROM rw"""

_RANGES = ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, (a, b) in scoring.RAW_RANGES.items())
_NORMALIZED = WITH_MOTIF + f""", r(class, lo, hi) AS (VALUES {_RANGES}), x AS (SELECT event_id, class, CASE WHEN class = 'Z-DNA' THEN score * 700.0::DOUBLE - 600.0::DOUBLE ELSE score / 3.0::DOUBLE END AS x FROM motifs)
SELECT event_id, round(CASE WHEN class = 'G-Quadruplex' THEN CASE WHEN x < 0.5 THEN 1.0 WHEN x >= 1.0 THEN least(3.0, 2.0 + (x - 0.5) * 2.0) ELSE 1.0 + (x - 0.5) * 2.0 END
 WHEN class = 'Z-DNA' THEN CASE WHEN x < lo THEN 1.0 WHEN x >= hi THEN 3.0 ELSE 1.0 + 2.0 * (log10(x + 1) - log10(lo + 1)) / (log10(hi + 1) - log10(lo + 1)) END
 WHEN x <= lo THEN 1.0 WHEN x >= hi THEN 3.0 ELSE 1.0 + 2.0 * (x - lo) / (hi - lo) END, 6)::DOUBLE AS score FROM x JOIN r USING (class)"""


def _normalized(m: DataFrame, n: DataFrame) -> DataFrame:
    raw = F.when(F.col("class") == "Z-DNA", F.col("score") * 700.0 - 600.0).otherwise(F.col("score") / 3.0)
    return m.select("event_id", F.round(scoring.normalize_by_class(raw, F.col("class")), 6).alias("score"))


_SCANNED = [c for c in MAIN_CLASSES if c != "Slipped_DNA"]  # the others' patterns refer back, which DuckDB's expressions can't


def _registry_scan(q: DataFrame, classes: list[str]) -> DataFrame:
    found = None
    for c in classes:
        rows = registry.scan_with_registry(q, c).select("seq_id", "pattern_id", "start", "end")
        found = rows if found is None else found.unionByName(rows)
    return found


def _fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA and read again; half of the headers hold a ``>``."""
    at = writers.scratch(spark)
    named = sequences(spark, sf_dir).withColumn("seq_id", F.when(F.col("seq_id").cast("long") % 2 == 0, F.concat("seq_id", F.lit(" A->G"))).otherwise(F.col("seq_id")))
    writers.fasta_lines(named).write.text(at)
    return readers.read_fasta(spark, at).select("seq_id", "length", F.md5("seq").alias("md5"))


def _lines_of(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = writers.scratch(spark)
        writers.write(motifs(spark, sf_dir), at, kind)
        return spark.read.text(at)

    return run


def _csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = writers.scratch(spark)
    writers.write(motifs(spark, sf_dir), at, "csv")
    return spark.read.option("header", True).csv(at)


def _raw_input(q: DataFrame) -> DataFrame:
    """Sequences as raw input: headers, lines, small letters, some odd letters."""
    i = F.col("seq_id").cast("long")
    body = F.when(i % 5 == 0, F.concat(F.lit("xx-"), "seq")).when(i % 5 == 1, F.concat(F.lit("NN"), "seq")).otherwise(F.lower("seq"))
    return q.select("seq_id", F.when(i % 3 == 0, F.concat(F.lit(">head "), "seq_id", F.lit("\n"), body)).when(i % 3 == 1, F.concat(F.substring(body, 1, 40), F.lit("\n  "), F.substring(body, 41, 1 << 30), F.lit("\n"))).otherwise(body).alias("raw"))


_PREPROCESSED = WITH_SEQ + """, b AS (SELECT seq_id, seq_id::BIGINT AS i, CASE seq_id::BIGINT % 5 WHEN 0 THEN 'XX-' || seq WHEN 1 THEN 'NN' || seq ELSE seq END AS s FROM sequences),
c AS (SELECT seq_id, CASE WHEN i % 3 = 0 THEN 'HEAD ' || seq_id ELSE '' END AS header, s, length(s)::BIGINT AS length, length(regexp_replace(s, '[^ACGT]', '', 'g'))::BIGINT AS valid_bases, length(regexp_replace(s, '[^GC]', '', 'g')) AS gc, length(regexp_replace(s, '[^N]', '', 'g'))::BIGINT AS n_n, i FROM b)
SELECT seq_id, header, length, valid_bases, n_n, round(gc * 100.0::DOUBLE / valid_bases, 6) AS gc_pct, CASE WHEN gc * 100.0 / valid_bases > 60 THEN 'GC-rich' WHEN gc * 100.0 / valid_bases < 40 THEN 'AT-rich' ELSE 'Balanced' END AS balance, CASE WHEN i % 5 = 0 THEN 'error' WHEN n_n > 0 THEN 'warning' ELSE 'valid' END AS status, CASE WHEN i % 5 = 0 THEN '-:2,X:0+1' ELSE '' END AS odd FROM c"""


def _preprocessed(q: DataFrame) -> DataFrame:
    odd = F.array_join(F.transform("invalid", lambda x: F.concat(x["letter"], F.lit(":"), F.array_join(x["places"].cast("array<string>"), "+"))), ",")
    return reports.preprocessed(_raw_input(q)).select("seq_id", "header", "length", "valid_bases", "n_n", F.round("gc_pct", 6).alias("gc_pct"), "balance", "status", odd.alias("odd"))


def _foreign(m: DataFrame, n: DataFrame) -> DataFrame:
    """Motifs in other spellings; lengths missing."""
    rows = m.select("event_id", F.col("seq_id").alias("Sequence_Name"), F.col("class").alias("Type"), F.when(F.col("event_id") % 4 > 0, F.col("subclass")).alias("Subclass"), F.col("start_pos").alias("Start"), F.col("end_pos").alias("End"), F.col("score").alias("ActualScore"))
    return reports.canonical(rows).drop("normalized_score", "sequence")


def _filed(df: DataFrame) -> DataFrame:
    """The twenty sequences as six files of three species."""
    k = F.substring("seq_id", 2, 9).cast("int") % 6
    return df.withColumn("source_file", F.when(k == 5, "solo").otherwise(F.concat(F.lit("sp"), (k % 2).cast("string"), F.lit("_chr_"), k.cast("string"))))


_FILED = "CASE WHEN substr(seq_id, 2)::INT % 6 = 5 THEN 'solo' ELSE 'sp' || (substr(seq_id, 2)::INT % 6 % 2) || '_chr_' || (substr(seq_id, 2)::INT % 6) END AS source_file"
_BY_FILE = WITH_MOTIF + f", mf AS (SELECT *, {_FILED} FROM motifs), lf AS (SELECT source_file, sum(seq_length) AS bp FROM (SELECT seq_length, {_FILED} FROM lengths) GROUP BY 1), cv AS ({_COVER.format(k='seq_id, class')}), cf AS (SELECT source_file, class, sum(covered_bp) AS c FROM (SELECT class, covered_bp, {_FILED} FROM cv) GROUP BY 1, 2), nf AS (SELECT source_file, class, count(*) AS n FROM mf GROUP BY 1, 2)"
_ALL_FILES = f"round({{x}} / {20 * LENGTH}, {{d}})"


def _union(sheets: dict[str, DataFrame], *keys: str) -> DataFrame:
    out = None
    for name, df in sheets.items():
        rows = df.select(F.lit(name).alias("sheet"), *keys)
        out = rows if out is None else out.unionByName(rows)
    return out


def _with_derived(m: DataFrame) -> DataFrame:
    """Motifs, some of them turned into hybrids and clusters."""
    return m.withColumn("class", F.when(F.col("event_id") % 11 == 0, "Hybrid").when(F.col("event_id") % 13 == 0, "Non-B_DNA_Clusters").otherwise(F.col("class")))


_DERIVED = "CASE WHEN event_id % 11 = 0 THEN 'Hybrid' WHEN event_id % 13 = 0 THEN 'Non-B_DNA_Clusters' ELSE class END"
_SHEETS = " UNION ALL ".join(["SELECT 'Core_Results' AS sheet, event_id FROM d WHERE class NOT IN ('Hybrid', 'Non-B_DNA_Clusters')", *(f"SELECT '{c.replace('-', '_').replace(' ', '_')}', event_id FROM d WHERE class = '{c}'" for c in MAIN_CLASSES), "SELECT 'Hybrid_Motifs', event_id FROM d WHERE class = 'Hybrid'", "SELECT 'Cluster_Motifs', event_id FROM d WHERE class = 'Non-B_DNA_Clusters'"])
_FLAT = "replace(replace({c}, '-', '_'), ' ', '_')"


def _features(m: DataFrame, n: DataFrame) -> DataFrame:
    """A feature for every hundredth motif's place: genes and exons of growing length."""
    rows = m.filter("event_id % 100 = 0").select("seq_id", F.when(F.col("event_id") % 300 == 0, "gene").otherwise("exon").alias("type"), (F.col("start_pos") - 1).alias("start"), (F.col("start_pos") + 300 + F.col("event_id") % 700).alias("end"))
    return statistics.feature_counts(rows, m)


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_counts": (lambda s, d: statistics.class_counts(detect(sequences(s, d))), None),
    "f_normalize_by_class": (_m(_normalized), _NORMALIZED),
    "f_registry_scan": (_q(lambda q: _registry_scan(q, _SCANNED)), WITH_SEQ + ' SELECT seq_id, pattern_id, "start", "end" FROM ' + _hits_sql({p: rx for c, p, rx, _, _ in registry.PATTERNS if c in _SCANNED})),
    "f_registry_scan_repeats": (_q(lambda q: _registry_scan(q, ["Slipped_DNA"])), None),
    "f_preprocess": (_q(_preprocessed), _PREPROCESSED),
    "f_quality_report": (_q(lambda q: reports.quality_report(reports.preprocessed(_raw_input(q)))), WITH_SEQ + """, c AS (SELECT CASE seq_id::BIGINT % 5 WHEN 0 THEN 'XX-' || seq WHEN 1 THEN 'NN' || seq ELSE seq END AS s, seq_id::BIGINT % 5 AS k FROM sequences), r AS (SELECT k, length(s) AS n, length(regexp_replace(s, '[^GC]', '', 'g')) * 100.0::DOUBLE / length(regexp_replace(s, '[^ACGT]', '', 'g')) AS gc, contains(s, 'N') AS has_n FROM c)
SELECT count(*) AS total_sequences, sum(n)::BIGINT AS total_length, round(avg(gc), 4) AS average_gc, count(*) FILTER (k <> 0 AND NOT has_n) AS n_valid, count(*) FILTER (k <> 0 AND has_n) AS n_warning, count(*) FILTER (k = 0) AS n_error FROM r"""),
    "f_canonical": (_m(_foreign), WITH_MOTIF + " SELECT seq_id, class, CASE WHEN event_id % 4 > 0 THEN subclass ELSE 'Other' END AS subclass, start_pos, end_pos, end_pos - start_pos AS length, score, score AS actual_score FROM motifs"),
    "f_motif_info": (lambda s, d: reports.motif_info(s), "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}', {len(xs)}::BIGINT, '{', '.join(sorted(xs))}')" for k, (c, xs) in enumerate(TAXONOMY.items(), 1)) + ") AS t(class_id, class, n_subclasses, subclasses)"),
    "s_fasta_file": (_fasta_file, WITH_SEQ + ", c AS (SELECT CASE WHEN seq_id::BIGINT % 2 = 0 THEN seq_id || ' A->G' ELSE seq_id END AS seq_id, regexp_replace(seq, '[^ATGCNRYSWKMBDHV]', '', 'g') AS s FROM sequences) SELECT seq_id, length(s)::BIGINT AS length, md5(s) AS md5 FROM c"),
    "s_preview": (_q(readers.preview), WITH_SEQ + ", n AS (SELECT *, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS k FROM sequences) SELECT seq_id, substr(seq, 1, 400) AS start_of_seq, length(seq)::BIGINT AS length, round(length(regexp_replace(seq, '[^GC]', '', 'g')) * 100.0::DOUBLE / k, 4) AS gc_pct, round(length(regexp_replace(seq, '[^AT]', '', 'g')) * 100.0::DOUBLE / k, 4) AS at_pct, " + ", ".join(f"length(regexp_replace(seq, '[^{b}]', '', 'g'))::BIGINT AS n_{b.lower()}" for b in "ATGCN") + ", (SELECT count(*) FROM sequences) AS total_sequences, (SELECT sum(length(seq))::BIGINT FROM sequences) AS total_bp FROM n ORDER BY seq_id LIMIT 3"),
    "d_g4_pattern_hits": (_q(lambda q: detectors.quadruplex_hits(q).select("seq_id", "start", "end", "pattern_id", "raw")), _G4_HITS + ' SELECT seq_id, s AS "start", e AS "end", pattern_id, raw FROM rated'),
    "d_g_quadruplex": (_q(lambda q: _picked(detectors.quadruplexes(q))), _G4_HITS + ", " + _G4_NAMES + f" SELECT seq_id, k.subclass AS subclass, k.s + 1 AS start_pos, k.e AS end_pos, '+' AS strand, k.raw AS raw_score, {_score_sql('k.raw', '0.5::DOUBLE', '4.0::DOUBLE', 'k.e - k.s', 120)} AS score, k.pattern_id AS pattern_id FROM {_G4_KEPT}"),
    "d_i_motif": (
        _q(lambda q: _picked(detectors.i_motifs(q))),
        WITH_SEQ + BOTH + ", " + _I_RATED + f", kp AS (SELECT seq_id, k FROM {_greedy_sql('im', 'seq_id', _I_FIELDS, 'raw DESC, CASE WHEN pattern_id = \'IM_EXT\' THEN 1 ELSE 0 END, e - s DESC, strand, s, e')} UNION ALL SELECT seq_id, k FROM {_greedy_sql('ac', 'seq_id', _I_FIELDS, 'raw DESC, e - s DESC, strand, s, e')})"
        f" SELECT seq_id, CASE k.pattern_id WHEN 'IM_0' THEN 'Canonical i-motif' WHEN 'IM_EXT' THEN 'Relaxed i-motif' ELSE 'AC-motif' END AS subclass, k.s + 1 AS start_pos, k.e AS end_pos, k.strand AS strand, k.raw AS raw_score, {_score_sql('k.raw', '0.4::DOUBLE', '1.0::DOUBLE', 'k.e - k.s', 60)} AS score, k.pattern_id AS pattern_id FROM kp",
    ),
    "d_ac_motif_hits": (_q(lambda q: detectors.ac_motif_hits(q).select("seq_id", "start", "end", "strand", "pattern_id", "raw")), WITH_SEQ + BOTH + ", " + _I_RATED + ' SELECT seq_id, s AS "start", e AS "end", strand, pattern_id, raw FROM ac'),
    "d_r_loop": (_q(lambda q: _picked(detectors.r_loops(q))), _R_LOOPS),
    "d_quadruplex_features": (_q(lambda q: reports.quadruplex_features(writers.with_sequence(detectors.quadruplexes(q), q)).select("seq_id", "start_pos", "end_pos", "num_tracts", "tract_lengths", "num_loops", "loop_lengths", "gc_content")), _G4_HITS + ", " + _G4_NAMES + f""", kp AS (SELECT seq_id, k.s AS s, k.e AS e, substr(seq, k.s + 1, k.e - k.s) AS m FROM {_G4_KEPT} JOIN sequences USING (seq_id)), t AS (SELECT *, regexp_extract_all(m, 'G{{2,}}') AS ts FROM kp), l AS (SELECT *, CASE WHEN len(ts) > 1 THEN list_filter(string_split_regex(m, 'G{{2,}}'), lambda x: x <> '') ELSE [] END AS ls FROM t)
SELECT seq_id, s + 1 AS start_pos, e AS end_pos, len(ts)::INT AS num_tracts, array_to_string(list_transform(ts, lambda x: length(x)), ',') AS tract_lengths, len(ls)::INT AS num_loops, coalesce(array_to_string(list_transform(ls, lambda x: length(x)), ','), '') AS loop_lengths, round(length(regexp_replace(m, '[^GC]', '', 'g')) * 100.0::DOUBLE / length(m), 2) AS gc_content FROM l"""),
    "d_repeat_types": (_q(lambda q: reports.repeat_types(detectors.slipped(q))), None),
    "d_sticky_ranges": (_q(lambda q: reports.sticky_ranges(detectors.sticky(q))), WITH_SEQ + f""" SELECT seq_id, "start" + 1 AS start_pos, "end" AS end_pos, ("end" - "start") // 3 AS copies, CASE WHEN ("end" - "start") // 3 >= 60 THEN 'pathogenic' WHEN ("end" - "start") // 3 >= 40 THEN 'sticky threshold' WHEN ("end" - "start") // 3 >= 20 THEN 'replication blockage' ELSE 'weak' END AS range FROM {_hits_sql(detectors.STICKY)}"""),
    "i_remove_overlaps": (_m(lambda m, n: intervals.remove_overlaps(m).select("seq_id", "class", "start_pos", "end_pos", "score")), WITH_MOTIF + " SELECT seq_id, class, k.s + 1 AS start_pos, k.e AS end_pos, k.score AS score FROM " + _greedy_sql("motifs", "seq_id, class, subclass", "{'s': start_pos - 1, 'e': end_pos, 'score': score}", "score DESC, length DESC, start_pos, end_pos")),
    "i_resolve_cross_class": (_m(lambda m, n: intervals.resolve_cross_class(m.withColumn("class", F.lit("Z-DNA"))).select("seq_id", "start_pos", "end_pos", "score")), WITH_MOTIF + " SELECT seq_id, k.s AS start_pos, k.e AS end_pos, k.score AS score FROM " + _greedy_sql("motifs", "seq_id", "{'s': start_pos, 'e': end_pos, 'score': score}", "score DESC, length DESC, start_pos, end_pos")),
    "i_dedup_near": (_m(lambda m, n: intervals.dedup_near(m.withColumn("class", F.lit("Z-DNA")).withColumn("subclass", F.lit("Z-DNA"))).select("seq_id", "start_pos", "end_pos", "score")), None),
    "i_quality": (
        _m(lambda m, n: intervals.quality_issues(m.withColumn("length", F.when(F.col("event_id") % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))).withColumn("end_pos", F.when(F.col("event_id") % 17 == 0, F.col("start_pos")).otherwise(F.col("end_pos"))).withColumn("class", F.when(F.col("event_id") % 19 > 0, F.col("class"))), 50_000)),
        WITH_MOTIF + ", q AS (SELECT seq_id, event_id, start_pos, CASE WHEN event_id % 17 = 0 THEN start_pos ELSE end_pos END AS end_pos, CASE WHEN event_id % 7 = 0 THEN length + 1 ELSE length END AS length, CASE WHEN event_id % 19 > 0 THEN class END AS class FROM motifs) SELECT seq_id, issue, count(*) AS n FROM (SELECT seq_id, 'missing field' AS issue FROM q WHERE class IS NULL UNION ALL SELECT seq_id, 'start not before end' FROM q WHERE start_pos >= end_pos UNION ALL SELECT seq_id, 'length differs' FROM q WHERE length <> end_pos - start_pos + 1 UNION ALL SELECT seq_id, 'beyond the sequence' FROM q WHERE end_pos > 50000 UNION ALL SELECT a.seq_id, 'overlap within a class' FROM q a JOIN q b ON a.seq_id = b.seq_id AND a.class = b.class AND (a.start_pos, a.end_pos, a.event_id) < (b.start_pos, b.end_pos, b.event_id) AND b.start_pos < a.end_pos) GROUP BY 1, 2",
    ),
    "a_features": (_m(_features), WITH_MOTIF + ", f AS (SELECT seq_id, CASE WHEN event_id % 300 = 0 THEN 'gene' ELSE 'exon' END AS type, start_pos - 1 AS s, start_pos + 300 + event_id % 700 AS e FROM motifs WHERE event_id % 100 = 0), z AS (SELECT type, sum(e - s) AS bp FROM f GROUP BY 1), h AS (SELECT type, count(*) AS n FROM f JOIN motifs m ON f.seq_id = m.seq_id AND m.start_pos - 1 >= s AND m.start_pos - 1 < e GROUP BY 1) SELECT type, coalesce(n, 0) AS n, round(coalesce(n, 0) * 1000.0::DOUBLE / bp, 6) AS per_kb FROM z LEFT JOIN h USING (type)"),
    "a_file_densities": (_m(lambda m, n: reports.file_densities(_filed(m), _filed(n))), _BY_FILE + " SELECT source_file, class, n, round(n * 1000.0::DOUBLE / bp, 4) AS per_kb, round(c * 100.0::DOUBLE / bp, 3) AS coverage_pct FROM nf JOIN cf USING (source_file, class) JOIN lf USING (source_file)"),
    "a_density_pivot": (_m(lambda m, n: reports.file_pivot(_filed(m), _filed(n), MAIN_CLASSES)), _BY_FILE + " SELECT source_file, " + ", ".join(f"coalesce(max(round(n * 1000.0::DOUBLE / bp, 4)) FILTER (class = '{c}'), 0) AS \"{c}\"" for c in MAIN_CLASSES) + " FROM nf JOIN lf USING (source_file) GROUP BY 1"),
    "a_coverage_pivot": (_m(lambda m, n: reports.file_pivot(_filed(m), _filed(n), MAIN_CLASSES, "coverage_pct")), _BY_FILE + " SELECT source_file, " + ", ".join(f"coalesce(max(round(c * 100.0::DOUBLE / bp, 3)) FILTER (class = '{c}'), 0) AS \"{c}\"" for c in MAIN_CLASSES) + " FROM cf JOIN lf USING (source_file) GROUP BY 1"),
    "a_overall_statistics": (_m(lambda m, n: reports.overall_statistics(_filed(m), _filed(n)).drop("mean_score")), _BY_FILE + f" SELECT class, count(*) AS total_count, round(avg(length), 3) AS mean_length, round(count(*) * 1000.0::DOUBLE / {20 * LENGTH}, 4) AS per_kb, round((SELECT sum(c) FROM cf WHERE cf.class = mf.class) * 100.0::DOUBLE / {20 * LENGTH}, 3) AS coverage_pct FROM mf GROUP BY class"),
    "a_file_comparison": (
        _m(lambda m, n: reports.file_comparison(_filed(_with_derived(m)), _filed(n)).drop("mean_motif_length")),
        WITH_MOTIF + f", mf AS (SELECT *, {_DERIVED} AS k, {_FILED} FROM motifs), lf AS (SELECT source_file, sum(seq_length)::BIGINT AS bp FROM (SELECT seq_length, {_FILED} FROM lengths) GROUP BY 1), cv AS ({_COVER.format(k='seq_id')}), cf AS (SELECT source_file, sum(covered_bp) AS c FROM (SELECT covered_bp, {_FILED} FROM cv) GROUP BY 1), nf AS (SELECT source_file, count(*) AS n, median(length) AS md, count(DISTINCT k) AS cl, count(DISTINCT subclass) AS sc, count(*) FILTER (k = 'Hybrid') AS h, count(*) FILTER (k = 'Non-B_DNA_Clusters') AS kl FROM mf GROUP BY 1)"
        " SELECT source_file, split_part(source_file, '_', 1) AS species, CASE WHEN contains(source_file, '_') THEN substr(source_file, strpos(source_file, '_') + 1) ELSE 'unknown' END AS region, n AS total_motifs, bp AS seq_length_bp, round(n * 1000.0::DOUBLE / bp, 4) AS density_per_kb, round(c * 100.0::DOUBLE / bp, 3) AS coverage_pct, round(md, 2)::DOUBLE AS median_motif_length, cl AS unique_classes, sc AS unique_subclasses, h AS hybrids, kl AS clusters FROM nf JOIN cf USING (source_file) JOIN lf USING (source_file)",
    ),
    "a_across_species": (_m(lambda m, n: reports.across_species(reports.file_comparison(_filed(m), _filed(n)))), WITH_MOTIF + f", mf AS (SELECT {_FILED} FROM motifs), lf AS (SELECT source_file, sum(seq_length) AS bp FROM (SELECT seq_length, {_FILED} FROM lengths) GROUP BY 1) SELECT split_part(source_file, '_', 1) AS species, CASE WHEN contains(source_file, '_') THEN substr(source_file, strpos(source_file, '_') + 1) ELSE 'unknown' END AS region, round(avg(d), 6) AS mean FROM (SELECT source_file, round(count(*) * 1000.0::DOUBLE / any_value(bp), 4) AS d FROM mf JOIN lf USING (source_file) GROUP BY 1) GROUP BY 1, 2"),
    "a_enhanced": (_m(lambda m, n: reports.enhanced_statistics(m, n).filter("metric in ('density_pct', 'per_unit', 'total_motifs', 'covered_bp', 'coverage_pct', 'length_max')")), WITH_MOTIF + ", a AS (" + _COVER.format(k="seq_id, class") + "), b AS (" + _COVER.format(k="seq_id") + f"), u AS (SELECT seq_id, class, covered_bp FROM a UNION ALL SELECT seq_id, 'Overall', covered_bp FROM b), p AS (SELECT seq_id, coalesce(class, 'Overall') AS class, count(*) AS n FROM motifs GROUP BY GROUPING SETS ((seq_id, class), (seq_id))) SELECT seq_id, 'genomic_density' AS part, class, 'density_pct' AS metric, round(least(100.0::DOUBLE, covered_bp * 100.0::DOUBLE / {LENGTH}), 4) AS value FROM u UNION ALL SELECT seq_id, 'per_kbp', class, 'per_unit', round(n * 1000.0::DOUBLE / {LENGTH}, 6) FROM p UNION ALL SELECT seq_id, 'per_mbp', class, 'per_unit', round(n * 1000000.0::DOUBLE / {LENGTH}, 6) FROM p UNION ALL SELECT seq_id, 'basic', NULL, 'covered_bp', covered_bp::DOUBLE FROM b UNION ALL SELECT seq_id, 'basic', NULL, 'coverage_pct', round(covered_bp * 100.0::DOUBLE / {LENGTH}, 2) FROM b UNION ALL SELECT seq_id, 'basic', NULL, 'total_motifs', count(*)::DOUBLE FROM motifs GROUP BY 1 UNION ALL SELECT seq_id, 'basic', NULL, 'length_max', max(length)::DOUBLE FROM motifs GROUP BY 1"),
    "w_cumulative": (_m(lambda m, n: series.cumulative(m)), WITH_MOTIF + " SELECT seq_id, class, start_pos, end_pos, score, count(*) OVER (PARTITION BY seq_id, class ORDER BY start_pos, end_pos, score ROWS UNBOUNDED PRECEDING) AS cumulative FROM motifs"),
    "w_gaps": (_m(lambda m, n: series.gaps(m)), WITH_MOTIF + " SELECT seq_id, start_pos, end_pos, greatest(0, nx - end_pos) AS gap FROM (SELECT *, lead(start_pos) OVER (PARTITION BY seq_id ORDER BY start_pos, end_pos) AS nx FROM motifs) WHERE nx IS NOT NULL"),
    "w_radial": (_m(lambda m, n: reports.radial_density(_with_derived(m), n)), WITH_MOTIF + f", n AS (SELECT seq_id, class, count(*) AS n FROM (SELECT seq_id, {_DERIVED} AS class FROM motifs) WHERE class NOT IN ('Hybrid', 'Non-B_DNA_Clusters') GROUP BY 1, 2) SELECT seq_id, class, round(n * 1000.0::DOUBLE / {LENGTH}, 6) AS per_kb, round((row_number() OVER (PARTITION BY seq_id ORDER BY class) - 1) * {2 * math.pi!r}::DOUBLE / count(*) OVER (PARTITION BY seq_id), 6) AS theta FROM n"),
    "w_class_bars": (_m(lambda m, n: reports.class_counts_sorted(_with_derived(m))), WITH_MOTIF + f", n AS (SELECT seq_id, class, count(*) AS n FROM (SELECT seq_id, {_DERIVED} AS class FROM motifs) WHERE class NOT IN ('Hybrid', 'Non-B_DNA_Clusters') GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, class)::INT AS place FROM n"),
    "w_tracks": (_m(lambda m, n: reports.tracks(m)), WITH_MOTIF + ", t AS (SELECT seq_id, class, row_number() OVER (PARTITION BY seq_id ORDER BY class)::INT - 1 AS track FROM (SELECT DISTINCT seq_id, class FROM motifs)) SELECT seq_id, track, class, start_pos, end_pos - start_pos + 1 AS width, score FROM motifs JOIN t USING (seq_id, class)"),
    "w_density_comparison": (_m(lambda m, n: reports.density_comparison(m, n)), WITH_MOTIF + ", a AS (" + _COVER.format(k="seq_id, class") + "), b AS (" + _COVER.format(k="seq_id") + f"), u AS (SELECT seq_id, class, covered_bp FROM a UNION ALL SELECT seq_id, 'Overall', covered_bp FROM b), p AS (SELECT seq_id, coalesce(class, 'Overall') AS class, count(*) AS n FROM motifs GROUP BY GROUPING SETS ((seq_id, class), (seq_id))) SELECT seq_id, class, round(least(100.0::DOUBLE, covered_bp * 100.0::DOUBLE / {LENGTH}), 4) AS density_pct, round(n * 1000.0::DOUBLE / {LENGTH}, 6) AS per_kb FROM u JOIN p USING (seq_id, class)"),
    "w_batch_co_occurrence": (_m(lambda m, n: reports.batch_co_occurrence(m.withColumn("seq_id", F.concat_ws("/", "seq_id", F.floor(F.col("start_pos") / 200).cast("string"))))), WITH_MOTIF + ", h AS (SELECT DISTINCT seq_id, start_pos // 200 AS b, class FROM motifs) SELECT x.class AS class_a, y.class AS class_b, count(*) AS n FROM h x JOIN h y ON x.seq_id = y.seq_id AND x.b = y.b AND x.class < y.class GROUP BY 1, 2"),
    "w_gc_overlaps": (lambda s, d: reports.overlapped_windows_gc(sequences(s, d), motifs(s, d).withColumn("seq_id", F.substring("seq_id", 2, 9))), WITH_SEQ + WITH_MOTIF.replace("WITH motifs", ", motifs") + ", t AS (SELECT seq_id, w, substr(seq, w * 100 + 1, 100) AS part FROM (SELECT seq_id, seq, unnest(range(0, length(seq) // 100)) AS w FROM sequences WHERE length(seq) >= 100)), c AS (SELECT seq_id, w, count(*) AS n FROM (SELECT substr(seq_id, 2) AS seq_id, unnest(range((start_pos - 1) // 100, (end_pos - 1) // 100 + 1)) AS w FROM motifs) GROUP BY 1, 2) SELECT seq_id, w::INT AS \"window\", round(coalesce(length(regexp_replace(part, '[^GC]', '', 'g')) * 100.0::DOUBLE / nullif(length(regexp_replace(part, '[^ACGT]', '', 'g')), 0), 0.0), 4) AS gc_pct, round(coalesce(n, 0) * 1000.0::DOUBLE / 100, 4) AS per_kb FROM t LEFT JOIN c USING (seq_id, w)"),
    "w_gc_fit": (lambda s, d: series.gc_fit(series.gc_windows(sequences(s, d), motifs(s, d).withColumn("seq_id", F.substring("seq_id", 2, 9)))).select("seq_id", *(F.round(c, 6).alias(c) for c in ("slope", "intercept"))).filter("slope is not null"), WITH_SEQ + WITH_MOTIF.replace("WITH motifs", ", motifs") + ", t AS (SELECT seq_id, unnest(range(0, length(seq) // 100)) AS w, seq FROM sequences WHERE length(seq) >= 100), c AS (SELECT substr(seq_id, 2) AS seq_id, (start_pos - 1 + end_pos) // 2 // 100 AS w, count(*) AS n FROM motifs GROUP BY 1, 2), g AS (SELECT t.seq_id, length(regexp_replace(substr(seq, w * 100 + 1, 100), '[^GC]', '', 'g')) * 100.0::DOUBLE / 100 AS gc, coalesce(n, 0)::DOUBLE AS n FROM t LEFT JOIN c USING (seq_id, w)) SELECT * FROM (SELECT seq_id, round(regr_slope(n, gc), 6) AS slope, round(regr_intercept(n, gc), 6) AS intercept FROM g GROUP BY 1 HAVING max(gc) > min(gc)) WHERE slope IS NOT NULL"),
    "k_csv": (_csv_file, WITH_MOTIF + " SELECT seq_id, class, subclass, start_pos::VARCHAR AS start_pos, end_pos::VARCHAR AS end_pos, length::VARCHAR AS length, 'NA' AS sequence, '+' AS strand, score::VARCHAR AS score, '0.0' AS raw_score, 'Pattern_detection' AS method, 'Unknown' AS pattern_id, event_id::VARCHAR AS event_id FROM motifs"),
    "k_bed": (_lines_of("bed"), WITH_MOTIF + ", col(class, rgb) AS (VALUES " + ", ".join(f"('{c}', '{v}')" for c, v in writers.COLOURS.items()) + ") SELECT concat_ws(chr(9), seq_id, start_pos - 1, end_pos, class || '_' || subclass, 1000, '+', start_pos - 1, end_pos, rgb) AS value FROM motifs JOIN col USING (class) UNION ALL SELECT 'track name=helixspark_motifs description=\"Non-B DNA motifs\" itemRgb=On' FROM (SELECT DISTINCT seq_id FROM motifs)"),
    "k_gff3": (_lines_of("gff3"), WITH_MOTIF + ", r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY start_pos, end_pos, class, subclass, score) AS i FROM motifs) SELECT concat_ws(chr(9), seq_id, 'helixspark', 'Non_B_DNA_motif', start_pos, end_pos, score, '+', '.', 'ID=motif_' || i || ';Name=' || class || '_' || subclass || ';motif_class=' || class || ';motif_subclass=' || subclass || ';length=' || length || ';method=helixspark') AS value FROM r UNION ALL SELECT '##gff-version 3' FROM (SELECT DISTINCT seq_id FROM motifs) UNION ALL SELECT '##sequence-region ' || seq_id || ' 1 ' || max(end_pos) FROM motifs GROUP BY seq_id"),
    "k_jsonl_summary": (_m(lambda m, n: writers.jsonl_summary(m, n).drop("mean_score")), WITH_MOTIF + f" SELECT seq_id, count(*) AS total_motifs, sum(length)::BIGINT AS coverage_bp, round(sum(length) * 100.0::DOUBLE / {LENGTH}, 4) AS coverage_pct, round(count(*) * 1000.0::DOUBLE / {LENGTH}, 4) AS density FROM motifs GROUP BY 1"),
    "k_exportable": (_m(lambda m, n: writers.exportable(m.withColumn("subclass", F.when(F.col("event_id") % 5 == 0, "Dynamic thing").otherwise(F.upper("subclass")))).select("event_id", "class", "subclass")), WITH_MOTIF + " SELECT event_id, class, subclass FROM motifs WHERE event_id % 5 <> 0"),
    "k_workbook": (_m(lambda m, n: _union(reports.results_workbook(_with_derived(m)), "event_id")), WITH_MOTIF + f", d AS (SELECT event_id, {_DERIVED} AS class FROM motifs) {_SHEETS}"),
    "k_multifasta_summary": (_m(lambda m, n: reports.multifasta_workbook(m, n)["Sequence_Summary"]), WITH_MOTIF + f" SELECT seq_id, {LENGTH}::BIGINT AS length, count(*) AS total_motifs, round(count(*) * 1000.0::DOUBLE / {LENGTH}, 2) AS motifs_per_kb FROM motifs GROUP BY 1"),
    "k_multifasta_positions": (_m(lambda m, n: reports.multifasta_workbook(m, n, equal_length=True)["Positional_Occurrence"]), WITH_MOTIF + f""", p AS (SELECT class, subclass, unnest(range(start_pos, end_pos + 1)) AS position FROM motifs), cs AS (SELECT DISTINCT class FROM motifs), pr AS (SELECT cs.class, s.subclass FROM cs JOIN (SELECT DISTINCT subclass FROM motifs) s ON contains({_FLAT.format(c='s.subclass')}, {_FLAT.format(c='cs.class')}))
SELECT position, pr.class, pr.subclass, count(*) AS n FROM p JOIN pr ON p.subclass = pr.subclass GROUP BY 1, 2, 3 UNION ALL SELECT position, class, 'Unknown', count(*) FROM p WHERE class NOT IN (SELECT class FROM pr) GROUP BY 1, 2"""),
    "k_class_sheet": (_m(lambda m, n: reports.statistics_workbook(m, n)["Class"].drop("mean_score")), WITH_MOTIF + ", a AS (" + _COVER.format(k="seq_id, class") + "), b AS (" + _COVER.format(k="seq_id") + f"), c AS (SELECT seq_id, class, count(*) AS n FROM motifs GROUP BY 1, 2) SELECT seq_id, class, n, a.covered_bp, round(a.covered_bp * 100.0::DOUBLE / {LENGTH}, 4) AS coverage_pct, round(a.covered_bp::DOUBLE / b.covered_bp, 4) AS contribution, round(n * 1000.0::DOUBLE / {LENGTH}, 2) AS per_kb FROM c JOIN a USING (seq_id, class) JOIN b USING (seq_id)"),
    "k_derived_coverage": (_m(lambda m, n: reports.derived_coverage(_with_derived(m), n)), WITH_MOTIF + ", d AS (SELECT seq_id, " + _DERIVED + f" AS class, unnest(range(start_pos, end_pos + 1)) AS p FROM motifs), h AS (SELECT seq_id, count(DISTINCT p) FILTER (class = 'Hybrid') AS h, count(DISTINCT p) FILTER (class = 'Non-B_DNA_Clusters') AS c FROM d GROUP BY 1), k AS (SELECT seq_id, count(*) FILTER (event_id % 11 = 0) AS n FROM motifs GROUP BY 1) SELECT seq_id, h AS hybrid_covered_bp, round(h * 100.0::DOUBLE / {LENGTH}, 4) AS hybrid_coverage_pct, round(n::DOUBLE / {LENGTH}, 8) AS hybrid_per_bp, c AS cluster_covered_bp, round(c * 100.0::DOUBLE / {LENGTH}, 4) AS cluster_coverage_pct FROM h JOIN k USING (seq_id)"),
}
