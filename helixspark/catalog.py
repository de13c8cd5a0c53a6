"""The registered queries of the motif library and their DuckDB twins.

The driver's tables hold no DNA: ``sequences`` derives some from ``documents`` (letters mapped to bases, then planted
motifs), and ``motifs`` derives intervals from ``events``; both engines compute them with the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, registry, scoring
from .functions import sequence as fn
from .functions.tables import TAXONOMY, a_tenmers, z_tenmers
from .operators import detectors, intervals, regexscan, series, statistics
from .plans.scan import scan

LENGTH = 60_073
LETTERS, BASES = "BDEFHIJKLMNOPQRSUVWXYZ", "CGTACGTACGTACGTACGTACG"
MAIN_CLASSES = list(TAXONOMY)[:9]

_SEQ = """concat(translate(upper(regexp_replace(text, '[^A-Za-z]', ''{g})), '{letters}', '{bases}'),
    repeat('TTAGGG', 4 + cast(doc_id % 5 as int)), 'AT', repeat('GAA', 4 + cast(doc_id % 9 as int)), 'CT',
    repeat('CG', 8 + cast(doc_id % 7 as int)), 'TA', repeat('CCCT', 5), 'A', repeat('CAG', 7 + cast(doc_id % 4 as int)), 'TTG', repeat('AAAAATGCGCG', 4))"""
_MOTIF = """concat('s', cast(event_id % 20 as {string})) AS seq_id, cast(1 + (event_id * 7919) % 60013 as bigint) AS start_pos,
    cast((event_id * 7919) % 60013 + 8 + (event_id * 31) % 53 as bigint) AS end_pos, cast(8 + (event_id * 31) % 53 as bigint) AS length,
    CASE event_id % 9 {classes} END AS class, CASE event_id % 9 {subclasses} END AS subclass,
    cast(1000 + (event_id * 17) % 2001 as double) / cast(1000 as double) AS score, event_id"""


def _cases(values: list[str]) -> str:
    return " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))


def _motif(string: str) -> str:
    return _MOTIF.format(string=string, classes=_cases(MAIN_CLASSES), subclasses=_cases([TAXONOMY[c][0] for c in MAIN_CLASSES]))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.filter("text is not null").selectExpr("cast(doc_id as string) AS seq_id", _SEQ.format(g="", letters=LETTERS, bases=BASES) + " AS seq").repartition(spark.sparkContext.defaultParallelism)


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT {_motif('string')} FROM {{events}}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def lengths(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("seq_id"), F.lit(LENGTH).cast("long").alias("seq_length"))


WITH_SEQ = f"WITH sequences AS (SELECT cast(doc_id as varchar) AS seq_id, {_SEQ.format(g=', ' + chr(39) + 'g' + chr(39), letters=LETTERS, bases=BASES)} AS seq FROM documents WHERE text IS NOT NULL)"
WITH_MOTIF = f"WITH motifs AS (SELECT {_motif('varchar')} FROM events), lengths AS (SELECT 's' || range AS seq_id, {LENGTH}::BIGINT AS seq_length FROM range(20))"
#: Covered bases of any groups: islands, then their sizes.
_COVER = """SELECT {k}, sum(e - s)::BIGINT AS covered_bp FROM (SELECT {k}, isl, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY {k} ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS isl FROM
 (SELECT {k}, start_pos - 1 AS s, end_pos AS e, event_id AS id, CASE WHEN start_pos - 1 > max(end_pos) OVER (PARTITION BY {k} ORDER BY start_pos, end_pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM motifs)) GROUP BY {k}, isl) GROUP BY {k}"""


def _hits_sql(patterns: dict[str, str], table: str = "sequences", keys: str = "seq_id") -> str:
    parts = " UNION ALL ".join(f"SELECT {keys}, '{name}' AS pattern_id, string_split(regexp_replace(seq, '({p})', '_\\1_', 'g'), '_') AS ps FROM {table}" for name, p in patterns.items())
    return f"""(SELECT {keys}, pattern_id, s AS "start", s + length(matched) AS "end", matched FROM (SELECT {keys}, pattern_id, i, matched, (sum(length(matched)) OVER (PARTITION BY {keys}, pattern_id ORDER BY i) - length(matched))::BIGINT AS s
 FROM (SELECT {keys}, pattern_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS matched FROM ({parts}) WHERE len(ps) > 1)) WHERE i % 2 = 0)"""


def _score_sql(raw: str, least: str, most: str, length: str, cap: int) -> str:
    place = f"CASE WHEN {most} = {least} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({raw})::DOUBLE - {least}) / ({most} - {least}))) END"
    return f"round(least(3.0::DOUBLE, 1.0::DOUBLE + 2.0::DOUBLE * {place} * least(1.0::DOUBLE, ({length})::DOUBLE / {cap}.0::DOUBLE)), 3)"


def _picked(df: DataFrame) -> DataFrame:
    return df.select("seq_id", "subclass", "start_pos", "end_pos", "strand", "raw_score", "score", "pattern_id")


def _kmer_sql(table: str, least: float, most: str, subclass: str, pattern: str) -> str:
    score = _score_sql("raw", str(least) + "::DOUBLE", f"((e - s) * {most}::DOUBLE / 10.0)", "e - s", 300)
    return f"""{WITH_SEQ}, {table},
pos AS (SELECT seq_id, unnest(range(0, length(seq) - 9)) AS p, seq FROM sequences WHERE length(seq) >= 10),
hit AS (SELECT seq_id, p, value FROM (SELECT seq_id, p, substr(seq, p + 1, 10) AS kmer FROM pos) JOIN kmers USING (kmer)),
isl AS (SELECT *, sum(f) OVER (PARTITION BY seq_id ORDER BY p) AS g FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY seq_id ORDER BY p) + 10 THEN 1 ELSE 0 END AS f FROM hit)),
reg AS (SELECT seq_id, g, min(p) AS s, max(p) + 10 AS e, round(sum(value), 6) AS raw FROM isl GROUP BY seq_id, g)
SELECT seq_id, '{subclass}' AS subclass, (s + 1)::BIGINT AS start_pos, e::BIGINT AS end_pos, '+' AS strand, raw AS raw_score, {score} AS score, '{pattern}' AS pattern_id FROM reg WHERE raw > {least}"""


_Z_TABLE = "kmers AS (SELECT kmer, value FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in z_tenmers()) + ") AS t(kmer, value))"
_A_TABLE = "kmers AS (SELECT kmer, value FROM (VALUES " + ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in a_tenmers()) + ") AS t(kmer, value))"
_A_MOST = repr(max(v for _, v in a_tenmers()))

_PAIRS = """pairs AS (SELECT a.seq_id, a.start_pos AS s1, a.end_pos AS e1, a.class AS c1, a.score AS x1, b.start_pos AS s2, b.end_pos AS e2, b.class AS c2, b.score AS x2, a.event_id AS i1
 FROM motifs a JOIN motifs b ON a.seq_id = b.seq_id AND b.start_pos <= a.end_pos + {reach} AND b.start_pos BETWEEN a.start_pos AND a.start_pos + 200 AND (a.start_pos, a.end_pos, a.event_id) < (b.start_pos, b.end_pos, b.event_id))"""


def _q(f: Callable[[DataFrame], DataFrame], source=sequences) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(source(spark, sf_dir))


def _m(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(motifs(spark, sf_dir), lengths(spark))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = motifs(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper("class"))).otherwise(F.lower("class")).alias("class"), F.upper("subclass").alias("subclass"))
    return names.normalized(spelt)


_B = "regexp_replace(seq, '[^{b}]', '', 'g')"


def _n(b: str) -> str:
    return f"length({_B.format(b=b)})"


_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_full": (lambda s, d: scan(sequences(s, d)).groupBy("class", "subclass").agg(F.count("*").alias("n"), F.sum("length").alias("sum_length")), None),
    "f_validate": (_q(lambda q: q.select("seq_id", fn.is_valid(F.col("seq")).alias("ok"), fn.validity(F.col("seq")).alias("why"))), WITH_SEQ + " SELECT seq_id, length(seq) >= 10 AND regexp_matches(seq, '^[ATGCRYSWKMBDHVN-]+$') AS ok, CASE WHEN length(seq) = 0 THEN 'empty' WHEN NOT regexp_matches(seq, '^[ATGCRYSWKMBDHVN-]+$') THEN 'invalid characters' WHEN length(seq) < 10 THEN 'too short' ELSE 'valid' END AS why FROM sequences"),
    "f_basic_stats": (
        _q(lambda q: q.select("seq_id", F.length("seq").cast("long").alias("n"), *(fn.count_of(F.col("seq"), b).alias(f"n_{b.lower()}") for b in "ATGCN"), F.round(fn.gc_content(F.col("seq")), 6).alias("gc"), F.round(fn.at_content(F.col("seq")), 6).alias("at"), F.round(fn.at_complement(F.col("seq")), 6).alias("at2"), F.round(fn.melting_temperature(F.col("seq")), 6).alias("tm"), fn.gc_balance(F.col("seq")).alias("balance"))),
        WITH_SEQ + f" SELECT seq_id, length(seq)::BIGINT AS n, {', '.join(f'{_n(b)}::BIGINT AS n_{b.lower()}' for b in 'ATGCN')}, round({_n('GC')} * 100.0::DOUBLE / {_n('ACGT')}, 6) AS gc, round({_n('AT')} * 100.0::DOUBLE / {_n('ACGT')}, 6) AS at, round(100.0::DOUBLE - {_n('GC')} * 100.0::DOUBLE / {_n('ACGT')}, 6) AS at2, round(64.9::DOUBLE + 41.0::DOUBLE * {_n('GC')} / length(seq) - 650.0::DOUBLE / length(seq), 6) AS tm, CASE WHEN {_n('GC')} * 100.0 / {_n('ACGT')} > 60 THEN 'GC-rich' WHEN {_n('GC')} * 100.0 / {_n('ACGT')} < 40 THEN 'AT-rich' ELSE 'balanced' END AS balance FROM sequences",
    ),
    "f_revcomp": (_q(lambda q: q.select("seq_id", F.md5(fn.revcomp(F.col("seq"))).alias("a"), F.md5(fn.reverse_complement(F.col("seq"))).alias("b"), fn.is_palindrome(F.col("seq")).alias("p"))), WITH_SEQ + " SELECT seq_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS a, md5(reverse(translate(seq, 'ATGCRYSWKMBVDHN-', 'TACGYRWSMKVBHDN-'))) AS b, seq = reverse(translate(seq, 'ATGCRYSWKMBVDHN-', 'TACGYRWSMKVBHDN-')) AS p FROM sequences"),
    "f_primitive": (_q(lambda q: q.select("seq_id", fn.primitive_unit(F.col("seq")).alias("u"), fn.shortened(F.col("seq")).alias("short"))), None),
    "f_scores": (_q(lambda q: q.select("seq_id", *(F.round(f(F.col("seq")), 6).alias(name) for name, f in (("imotif", scoring.imotif), ("curvature", scoring.curvature), ("triplex", scoring.triplex), ("r_loop", scoring.r_loop), ("a_philic", scoring.a_philic), ("g4hunter", scoring.g4hunter), ("z_dna", scoring.z_alternation), ("instability", scoring.instability), ("cruciform", scoring.cruciform))))), None),
    "f_registry": (lambda s, d: registry.pattern_counts(s), "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {sum(p[0] == c for p in registry.PATTERNS)}::BIGINT, {len({p[3] for p in registry.PATTERNS if p[0] == c})}::BIGINT)" for c in MAIN_CLASSES) + ") AS t(class, patterns, subclasses)"),
    "f_gc_of_set": (_q(statistics.gc_of_set), WITH_SEQ + f" SELECT count(*) AS sequences, sum(length(seq))::BIGINT AS total_bp, round(sum({_n('GC')}) * 100.0::DOUBLE / sum({_n('ACGT')}), 6) AS gc_pct, round(sum({_n('GC')}) * 100.0::DOUBLE / sum(length(seq)), 6) AS gc_of_total_pct FROM sequences"),
    "f_taxonomy": (lambda s, d: names.taxonomy(s), "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}', '{x}')" for k, (c, xs) in enumerate(TAXONOMY.items(), 1) for x in xs) + ") AS t(class_id, class, subclass)"),
    "f_normalize_names": (_aliases, WITH_MOTIF + " SELECT event_id, class, subclass FROM motifs"),
    "s_file_types": (lambda s, d: statistics.file_types(sequences(s, d).select(F.substring("seq_id", -1, 1).alias("source_file"), "seq")), WITH_SEQ + " SELECT right(seq_id, 1) AS source_file, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT length(seq)) = 1 THEN 'multi_equal' ELSE 'multi' END AS file_type, count(*) AS n FROM sequences GROUP BY 1"),
    "d_local_curvature": (_q(lambda q: _picked(detectors.local_curvature(q))), WITH_SEQ + f""" SELECT seq_id, 'Local Curvature' AS subclass, "start" + 1 AS start_pos, "end" AS end_pos, '+' AS strand, raw AS raw_score, {_score_sql('raw', '0.1::DOUBLE', '1.0::DOUBLE', '"end" - "start"', 50)} AS score, pattern_id FROM (SELECT *, round(("end" - "start")::DOUBLE / ("end" - "start" + 7.0::DOUBLE), 6) AS raw FROM {_hits_sql(detectors.LOCAL_CURVES)})"""),
    "d_global_curvature": (
        _q(lambda q: _picked(detectors.global_curvature(q))),
        WITH_SEQ + f""", tr AS (SELECT seq_id, "start", "end", "start" + ("end" - "start" - 1) / 2.0::DOUBLE AS c FROM {_hits_sql({'t': 'A{3,}|T{3,}'})}),
sp AS (SELECT *, c - lag(c) OVER (PARTITION BY seq_id ORDER BY c) AS step FROM tr), ch AS (SELECT *, sum(CASE WHEN step BETWEEN 9.9::DOUBLE AND 11.1::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY c ROWS UNBOUNDED PRECEDING) AS g FROM sp),
rn AS (SELECT seq_id, g, count(*) AS n, min("start") AS s, max("end") AS e, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - avg(CASE WHEN step BETWEEN 9.9::DOUBLE AND 11.1::DOUBLE THEN abs(step - 11.0::DOUBLE) END) / 1.1::DOUBLE), 6) AS raw FROM ch GROUP BY seq_id, g HAVING count(*) >= 3)
SELECT seq_id, 'Global Curvature' AS subclass, s + 1 AS start_pos, e AS end_pos, '+' AS strand, raw AS raw_score, {_score_sql('raw', '0.1::DOUBLE', '1.0::DOUBLE', 'e - s', 120)} AS score, 'CRV_001' AS pattern_id FROM rn WHERE raw >= 0.1""",
    ),
    "d_sticky": (_q(lambda q: _picked(detectors.sticky(q))), WITH_SEQ + f""" SELECT seq_id, 'Sticky DNA' AS subclass, "start" + 1 AS start_pos, "end" AS end_pos, '+' AS strand, raw AS raw_score, {_score_sql('raw', '1.0::DOUBLE', '3.0::DOUBLE', '"end" - "start"', 150)} AS score, pattern_id FROM (SELECT *, round(least(3.0::DOUBLE, CASE WHEN c < 20 THEN 1 + 0.015::DOUBLE * c WHEN c < 40 THEN 1.3::DOUBLE + 0.03::DOUBLE * (c - 20) WHEN c < 60 THEN 2.0::DOUBLE + 0.02::DOUBLE * (c - 40) ELSE 2.6::DOUBLE + 0.01::DOUBLE * (c - 60) END), 3) AS raw FROM (SELECT *, ("end" - "start") // 3 AS c FROM {_hits_sql(detectors.STICKY)}))"""),
    "d_egz": (_q(lambda q: _picked(detectors.egz(q))), WITH_SEQ + f""" SELECT seq_id, 'eGZ' AS subclass, "start" + 1 AS start_pos, "end" AS end_pos, '+' AS strand, raw AS raw_score, {_score_sql('raw', '50.0::DOUBLE', '(("end" - "start") * 63.0::DOUBLE / 10.0)', '"end" - "start"', 300)} AS score, pattern_id FROM (SELECT *, round(0.85::DOUBLE * (("end" - "start") // 3) / 3, 6) AS raw FROM {_hits_sql(detectors.EGZ)})"""),
    "d_z_dna": (_q(lambda q: _picked(detectors.z_dna(q))), _kmer_sql(_Z_TABLE, 50.0, "63.0", "Z-DNA", "Z10")),
    "d_a_philic": (_q(lambda q: _picked(detectors.a_philic(q))), _kmer_sql(_A_TABLE, 0.5, _A_MOST, "A-philic DNA", "A10")),
    "d_i_motif_hits": (_q(lambda q: detectors.i_motif_hits(q).select("seq_id", "start", "end", "strand", "pattern_id")), WITH_SEQ + f""", both_(seq_id, strand, n, seq) AS (SELECT seq_id, '+', length(seq), seq FROM sequences UNION ALL SELECT seq_id, '-', length(seq), reverse(translate(seq, 'ACGT', 'TGCA')) FROM sequences)
SELECT seq_id, CASE strand WHEN '+' THEN "start" ELSE n - "end" END AS "start", CASE strand WHEN '+' THEN "end" ELSE n - "start" END AS "end", strand, pattern_id FROM {_hits_sql(detectors.IMOTIFS, 'both_', 'seq_id, strand, n')} WHERE "end" - "start" >= 10"""),
    "d_slipped": (_q(lambda q: _picked(detectors.slipped(q))), None),
    "d_cruciform": (_q(lambda q: _picked(detectors.cruciform(q))), None),
    "d_h_dna": (_q(lambda q: _picked(detectors.h_dna(q))), None),
    "f_multi_pattern": (_q(lambda q: regexscan.multi_pattern_hits(q, ["GGG", "CCC", "TTAGGG", "CGCGCG"]).groupBy("word").agg(F.count("*").alias("n"))), WITH_SEQ + ", w(word) AS (VALUES ('GGG'), ('CCC'), ('TTAGGG'), ('CGCGCG')) SELECT word, count(*) AS n FROM (SELECT word, unnest(range(1, length(seq) - length(word) + 2)) AS p, seq FROM sequences, w WHERE length(seq) >= length(word)) WHERE substr(seq, p, length(word)) = word GROUP BY word"),
    "i_tiles": (_q(lambda q: intervals.tiles(q, 1000, 200).select("seq_id", "tile_id", "tile_start", "tile_end", "core_end", F.md5("tile_seq").alias("md5"))), WITH_SEQ + ", t AS (SELECT *, greatest(0, ceil((length(seq) - 1000) / 800.0))::BIGINT AS last FROM sequences), u AS (SELECT *, unnest(range(0, last + 1)) AS tile_id FROM t) SELECT seq_id, tile_id, tile_id * 800 AS tile_start, least(tile_id * 800 + 1000, length(seq)) AS tile_end, CASE WHEN tile_id = last THEN length(seq) ELSE tile_id * 800 + 800 END AS core_end, md5(substr(seq, tile_id * 800 + 1, 1000)) AS md5 FROM u"),
    "i_dedup_exact": (_m(lambda m, n: intervals.dedup_exact(m)), WITH_MOTIF + " SELECT seq_id, class, subclass, start_pos, end_pos, max(score) AS score FROM motifs GROUP BY ALL"),
    "i_hybrids": (_m(lambda m, n: intervals.hybrids(m).select("seq_id", "start_pos", "end_pos", F.array_join("component_classes", "+").alias("classes"))), WITH_MOTIF + ", " + _PAIRS.format(reach=0) + " SELECT DISTINCT seq_id, least(s1, s2) AS start_pos, greatest(e1, e2) AS end_pos, least(c1, c2) || '+' || greatest(c1, c2) AS classes FROM pairs WHERE c1 <> c2 AND (least(e1, e2) - greatest(s1, s2) + 1)::DOUBLE / least(e1 - s1 + 1, e2 - s2 + 1) > 0.5 AND (least(e1, e2) - greatest(s1, s2) + 1)::DOUBLE / least(e1 - s1 + 1, e2 - s2 + 1) < 0.99"),
    "i_clusters": (_m(lambda m, n: intervals.clusters(m).select("seq_id", "start_pos", "end_pos", "motif_count", "class_diversity")), WITH_MOTIF + " SELECT DISTINCT seq_id, start_pos, e AS end_pos, n::INT AS motif_count, c::INT AS class_diversity FROM (SELECT seq_id, start_pos, count(*) OVER w AS n, count(DISTINCT class) OVER w AS c, max(end_pos) OVER w AS e, avg(score) OVER w AS x FROM motifs WINDOW w AS (PARTITION BY seq_id ORDER BY start_pos RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING)) WHERE n >= 4 AND c >= 3"),
    "i_coverage": (_m(lambda m, n: intervals.coverage(m, ["seq_id", "class"])), WITH_MOTIF + " " + _COVER.format(k="seq_id, class")),
    "i_filter": (_m(lambda m, n: m.filter(F.col("score").between(1.5, 2.5) & (F.col("length") >= 20) & F.col("class").isin("Z-DNA", "Triplex")).select("event_id", "class", "score")), WITH_MOTIF + " SELECT event_id, class, score FROM motifs WHERE score BETWEEN 1.5 AND 2.5 AND length >= 20 AND class IN ('Z-DNA', 'Triplex')"),
    "i_overlap_counts": (_m(lambda m, n: series.overlap_counts(m, top=None)), WITH_MOTIF + ", " + _PAIRS.format(reach=0) + " SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) AS n FROM pairs WHERE s2 < e1 AND c1 <> c2 GROUP BY 1, 2"),
    "a_motif_statistics": (
        _m(lambda m, n: statistics.motif_statistics(m, n).select("seq_id", "total_motifs", "classes_detected", "covered_bp", "coverage_pct", "density", "raw_occupancy_bp", "normalized_occupancy", "mean_overlap_depth", "mean_gap", "simpson", "effective_classes", "dominance", "length_min", "length_max")),
        WITH_MOTIF + ", cov AS (" + _COVER.format(k="seq_id") + "), agg AS (SELECT seq_id, count(*) AS n, count(DISTINCT class) AS c, sum(length)::BIGINT AS occ, min(length) AS lo, max(length) AS hi FROM motifs GROUP BY 1), gap AS (SELECT seq_id, round(avg(g), 2) AS mean_gap FROM (SELECT seq_id, lead(start_pos) OVER (PARTITION BY seq_id ORDER BY start_pos, end_pos) - end_pos AS g FROM motifs) GROUP BY 1), div AS (SELECT seq_id, round(1 - sum(p * p), 4) AS simpson, round(1 / sum(p * p), 4) AS eff, round(max(p), 4) AS dom FROM (SELECT seq_id, class, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY seq_id) AS p FROM motifs GROUP BY 1, 2) GROUP BY 1) "
        f"SELECT seq_id, n AS total_motifs, c AS classes_detected, covered_bp, round(covered_bp * 100.0::DOUBLE / {LENGTH}, 2) AS coverage_pct, round(n * 1000.0::DOUBLE / {LENGTH}, 2) AS density, occ AS raw_occupancy_bp, round(occ::DOUBLE / {LENGTH}, 6) AS normalized_occupancy, round(occ::DOUBLE / covered_bp, 4) AS mean_overlap_depth, mean_gap, simpson, eff AS effective_classes, dom AS dominance, lo AS length_min, hi AS length_max FROM agg JOIN cov USING (seq_id) JOIN gap USING (seq_id) JOIN div USING (seq_id)",
    ),
    "a_class_coverage": (_m(lambda m, n: statistics.class_coverage(m, n)), WITH_MOTIF + ", a AS (" + _COVER.format(k="seq_id, class") + "), b AS (" + _COVER.format(k="seq_id") + f") SELECT a.seq_id, a.class, a.covered_bp, round(a.covered_bp * 100.0::DOUBLE / {LENGTH}, 4) AS coverage_pct, round(a.covered_bp::DOUBLE / b.covered_bp, 4) AS contribution FROM a JOIN b USING (seq_id)"),
    "a_local_maxima": (_m(lambda m, n: statistics.local_maxima(m).select("seq_id", "max_local_motifs", "max_local_classes", "max_cluster_score")), WITH_MOTIF + " SELECT seq_id, max(n) AS max_local_motifs, max(c)::INT AS max_local_classes, round(max(s), 3) AS max_cluster_score FROM (SELECT seq_id, count(*) OVER w AS n, count(DISTINCT class) OVER w AS c, sum(score) OVER w AS s FROM motifs WINDOW w AS (PARTITION BY seq_id ORDER BY start_pos RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING)) GROUP BY 1"),
    "a_detection_report": (_m(lambda m, n: statistics.detection_report(m)), WITH_MOTIF + ", t(class_id, class, subclass) AS (VALUES " + ", ".join(f"({k}, '{c}', '{x}')" for k, (c, xs) in enumerate(TAXONOMY.items(), 1) for x in xs) + ") SELECT class_id, class, subclass, count(event_id) AS n, count(event_id) > 0 AS detected FROM t LEFT JOIN motifs USING (class, subclass) GROUP BY ALL"),
    "a_sequence_summary": (_m(lambda m, n: statistics.sequence_summary(m)), WITH_MOTIF + " SELECT seq_id, count(*) AS n_motifs, count(DISTINCT class) AS n_classes, round(avg(score), 4) AS mean_score, sum(length)::BIGINT AS sum_length, min(start_pos) AS first_start, max(end_pos) AS last_end FROM motifs GROUP BY 1"),
    "a_genomic_density": (_m(lambda m, n: statistics.genomic_density(m, n)), WITH_MOTIF + ", a AS (" + _COVER.format(k="seq_id, class") + "), b AS (" + _COVER.format(k="seq_id") + f") SELECT seq_id, class, round(least(100.0::DOUBLE, covered_bp * 100.0::DOUBLE / {LENGTH}), 4) AS density_pct FROM (SELECT seq_id, class, covered_bp FROM a UNION ALL SELECT seq_id, 'Overall', covered_bp FROM b)"),
    "a_positional_density": (_m(lambda m, n: statistics.positional_density(m, n)), WITH_MOTIF + f" SELECT seq_id, coalesce(class, 'Overall') AS class, round(count(*) * 1000.0::DOUBLE / {LENGTH}, 6) AS per_unit FROM motifs GROUP BY GROUPING SETS ((seq_id, class), (seq_id))"),
    "a_length_distribution": (_m(lambda m, n: statistics.five_numbers(m, "class", "length")), WITH_MOTIF + ' SELECT class, count(*) AS n, min(length)::DOUBLE AS least, max(length)::DOUBLE AS most, round(avg(length), 4) AS mean, round(median(length), 4) AS median, round(stddev_samp(length), 4) AS std FROM motifs GROUP BY 1'),
    "a_class_distribution": (_m(lambda m, n: statistics.class_counts(m)), WITH_MOTIF + " SELECT class, count(*) AS n FROM motifs GROUP BY 1"),
    "a_class_sequence_coverage": (_m(lambda m, n: statistics.class_sequence_coverage(m, n)), WITH_MOTIF + " SELECT class, round(count(DISTINCT seq_id) * 100.0::DOUBLE / 20, 4) AS pct_sequences FROM motifs GROUP BY 1"),
    "a_density_per_sequence": (_m(lambda m, n: statistics.density_per_sequence(m, n)), WITH_MOTIF + f" SELECT seq_id, round(count(event_id) * 1000.0::DOUBLE / {LENGTH}, 6) AS per_kb FROM lengths LEFT JOIN motifs USING (seq_id) GROUP BY 1"),
    "a_conservation": (_m(lambda m, n: statistics.positional_conservation(m)), WITH_MOTIF + " SELECT bin, count(DISTINCT seq_id) AS n_sequences FROM (SELECT seq_id, unnest(range(start_pos // 1000, end_pos // 1000 + 1)) AS bin FROM motifs) GROUP BY 1"),
    "a_depth": (_m(lambda m, n: statistics.positional_depth(m, ["seq_id"])), WITH_MOTIF + " SELECT seq_id, pos, depth FROM (SELECT seq_id, pos, d, (sum(d) OVER (PARTITION BY seq_id ORDER BY pos))::BIGINT AS depth FROM (SELECT seq_id, pos, sum(d) AS d FROM (SELECT seq_id, start_pos AS pos, 1 AS d FROM motifs UNION ALL SELECT seq_id, end_pos + 1, -1 FROM motifs) GROUP BY 1, 2)) WHERE d <> 0"),
    "a_group_statistics": (_m(lambda m, n: statistics.group_statistics(m, n, ["seq_id", "class"])), WITH_MOTIF + ", a AS (" + _COVER.format(k="seq_id, class") + f") SELECT seq_id, class, count(*) AS n, round(avg(length), 4) AS mean_length, round(avg(score), 4) AS mean_score, round(count(*) * 1000.0::DOUBLE / {LENGTH}, 6) AS per_kb, round(any_value(covered_bp) * 100.0::DOUBLE / {LENGTH}, 4) AS coverage_pct FROM motifs JOIN a USING (seq_id, class) GROUP BY 1, 2"),
    "a_class_pivot": (_m(lambda m, n: statistics.class_pivot(m, MAIN_CLASSES)), WITH_MOTIF + " SELECT seq_id, " + ", ".join(f"count(*) FILTER (class = '{c}') AS \"{c}\"" for c in MAIN_CLASSES) + " FROM motifs GROUP BY 1"),
    "a_start_frequency": (_m(lambda m, n: statistics.start_frequencies(m)), WITH_MOTIF + " SELECT start_pos, count(*) AS n FROM motifs GROUP BY 1"),
    "w_windows": (_m(lambda m, n: series.windowed(m, LENGTH, 1000).drop("mean_score")), WITH_MOTIF + ' SELECT seq_id, w AS "window", class, count(*) AS n, round(count(*) * 1000.0::DOUBLE / 1000, 4) AS per_kb FROM (SELECT seq_id, class, unnest(range((start_pos - 1) // 1000, least((end_pos - 1) // 1000, 59) + 1)) AS w FROM motifs WHERE start_pos - 1 < 60000) GROUP BY 1, 2, 3'),
    "w_heatmap": (_m(lambda m, n: series.structural_heatmap(m, LENGTH)), WITH_MOTIF + f', b AS (SELECT seq_id, least(floor(start_pos * 50 / {LENGTH}.0::DOUBLE)::BIGINT, 49) AS "window", class, count(*) AS n FROM motifs WHERE start_pos < {LENGTH} GROUP BY 1, 2, 3) SELECT *, round(n::DOUBLE / max(n) OVER (PARTITION BY seq_id, class), 6) AS share FROM b'),
    "w_gc_windows": (lambda s, d: series.gc_windows(sequences(s, d), motifs(s, d).withColumn("seq_id", F.substring("seq_id", 2, 9)), 100), WITH_SEQ + f", motifs AS (SELECT {_motif('varchar')} FROM events), t AS (SELECT seq_id, unnest(range(0, length(seq) // 100)) AS w, seq FROM sequences WHERE length(seq) >= 100), c AS (SELECT substr(seq_id, 2) AS seq_id, (start_pos - 1 + end_pos) // 2 // 100 AS w, count(*) AS n FROM motifs GROUP BY 1, 2) SELECT t.seq_id, t.w::INT AS \"window\", round(length(regexp_replace(substr(seq, w * 100 + 1, 100), '[^GC]', '', 'g')) * 100.0::DOUBLE / 100, 4) AS gc_pct, coalesce(n, 0)::BIGINT AS n FROM t LEFT JOIN c USING (seq_id, w)"),
    "w_co_occurrence": (_m(lambda m, n: series.co_occurrence(m, 100)), WITH_MOTIF + ", " + _PAIRS.format(reach=100) + " SELECT least(c1, c2) AS class_a, greatest(c1, c2) AS class_b, count(*) AS n FROM pairs GROUP BY 1, 2"),
    "w_class_combinations": (_m(lambda m, n: series.class_combinations(m)), WITH_MOTIF + ", " + _PAIRS.format(reach=0) + " SELECT classes, count(*) AS n FROM (SELECT i1, array_to_string(list_sort(list_distinct(list_append(list(c2), any_value(c1)))), '+') AS classes FROM pairs WHERE s2 < e1 GROUP BY i1) GROUP BY 1"),
    "w_bins": (_m(lambda m, n: series.binned(m, LENGTH)), WITH_MOTIF + f" SELECT what, bin, count(*) AS n FROM (SELECT 'start' AS what, least(floor((start_pos - 1) * 100 / {LENGTH}.0::DOUBLE)::BIGINT, 99) AS bin FROM motifs UNION ALL SELECT 'length', least(floor(length * 100 / 10000.0::DOUBLE)::BIGINT, 99) FROM motifs) GROUP BY 1, 2"),
    "k_missing_classes": (_m(lambda m, n: names.missing_classes(m)), WITH_MOTIF + ", t(class_id, class, subclass) AS (VALUES " + ", ".join(f"({k}, '{c}', '{x}')" for k, (c, xs) in enumerate(TAXONOMY.items(), 1) for x in xs) + ") SELECT t.* FROM t ANTI JOIN motifs USING (class, subclass)"),
}


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import catalog_more, catalog_public, catalog_scale

    return _REGISTRY | catalog_more.REGISTRY | catalog_scale.REGISTRY | catalog_public.REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
