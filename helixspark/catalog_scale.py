"""Registered queries of stored tiles, chunked scans and segments, and the twins of the self-comparing detectors and the whole scan.

Twins: repeats by joining equal words of one sequence some places apart, then growing or counting; the scan as the union of
the detectors' twins, greedy choices by folding, and pairs and windows over what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _REGISTRY, LENGTH, WITH_MOTIF, WITH_SEQ, _m, _picked, _q, _score_sql, motifs, sequences
from .catalog_more import REGISTRY as _MORE
from .catalog_more import _greedy_sql
from .functions.tables import STACKING
from .operators import detectors, intervals, kernels, series, statistics
from .plans.scan import detect, scan
from .sources import readers, writers
from .sources.results import ResultStore
from .sources.shared import scratch, written
from .sources.store import SequenceStore
from .streaming import stream

CHUNK = 1000


def _arms_sql(complement: bool, loops: int, longest: int) -> str:
    """arm (seq_id, s, arm, loop, word): seeds of six letters that meet their (complemented) mirror image, grown outwards; word: the left arm."""
    turned = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))" if complement else f"reverse({x})"
    plain = lambda x: f"translate({x}, 'ACGT', 'TGCA')" if complement else x
    more = longest - 6
    return f"""w6 AS (SELECT seq_id, p, substr(seq, p + 1, 6) AS w FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 5)) AS p FROM sequences WHERE length(seq) >= 6)),
sd AS (SELECT a.seq_id, a.p AS i, b.p - a.p - 6 AS loop FROM w6 a JOIN w6 b ON a.seq_id = b.seq_id AND a.w = {turned('b.w')} AND b.p - a.p - 6 BETWEEN 0 AND {loops - 1}),
lr AS (SELECT seq_id, i, loop, seq, {plain(f"reverse(substr(seq, greatest(1, i - {more} + 1), least(i, {more})))")} AS l, substr(seq, i + 13 + loop, {more}) AS r FROM sd JOIN sequences USING (seq_id)),
gr AS (SELECT *, least(length(l), length(r)) AS most FROM lr),
ex AS (SELECT *, coalesce(list_position(list_transform(range(1, most + 1), lambda t: substr(l, t, 1) = substr(r, t, 1)), false) - 1, most) AS more FROM gr),
arm AS (SELECT seq_id, i - more AS s, 6 + more AS arm, loop, substr(seq, i - more + 1, 6 + more) AS word FROM ex)"""


_ENERGY = "list_sum(list_transform(range(1, arm), lambda k: CASE substr(word, k, 2) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in STACKING.items()) + " END))"
_CRUCIFORMS = f"""{WITH_SEQ}, {_arms_sql(True, 13, 50)},
en AS (SELECT *, s + 2 * arm + loop AS e, {_ENERGY} + CASE WHEN loop = 0 THEN 4.0::DOUBLE ELSE 1.75::DOUBLE + 0.6::DOUBLE * ln(loop) END AS energy FROM arm WHERE arm >= 8),
rw AS (SELECT *, round(least(1.0::DOUBLE, -energy / 20.0::DOUBLE), 6) AS raw FROM en WHERE energy <= -5.0),
kp AS (SELECT seq_id, k FROM {_greedy_sql('(SELECT * FROM rw WHERE raw > 0.2)', 'seq_id', "{'s': s, 'e': e, 'raw': raw}", 'raw DESC, e - s DESC, s, arm DESC')})
SELECT seq_id, 'Cruciform forming IRs' AS subclass, k.s + 1 AS start_pos, k.e AS end_pos, '+' AS strand, k.raw AS raw_score, {_score_sql('k.raw', '0.2::DOUBLE', '1.0::DOUBLE', 'k.e - k.s', 200)} AS score, 'CRU' AS pattern_id FROM kp"""

_MIRRORS = f"""{WITH_SEQ}, {_arms_sql(False, 9, 100)},
pu AS (SELECT *, s + 2 * arm + loop AS e, length(regexp_replace(word, '[^AG]', '', 'g')) AS pur FROM arm WHERE arm >= 10),
pr AS (SELECT *, greatest(pur, arm - pur)::DOUBLE / arm AS purity, least(pur, arm - pur) AS odd FROM pu),
rw AS (SELECT *, round(1 + 2 * least(1.0::DOUBLE, 0.35::DOUBLE * least(1.0::DOUBLE, ln(arm) / ln(35)) + 0.20::DOUBLE * exp(-0.4::DOUBLE * loop) + 0.30::DOUBLE * (purity - 0.8::DOUBLE) / 0.2::DOUBLE + 0.15::DOUBLE / (1 + odd)), 3) AS raw FROM pr WHERE purity >= 0.9),
kp AS (SELECT seq_id, k FROM {_greedy_sql('rw', 'seq_id', "{'s': s, 'e': e, 'raw': raw}", 'arm DESC, loop, s')})
SELECT seq_id, 'H-DNA' AS subclass, k.s + 1 AS start_pos, k.e AS end_pos, '+' AS strand, k.raw AS raw_score, {_score_sql('k.raw', '1.0::DOUBLE', '3.0::DOUBLE', 'k.e - k.s', 150)} AS score, 'TRX_MIRROR' AS pattern_id FROM kp"""

# Every run counts at least 20 bases and two units, so ten letters of it stand again one unit on.
_SLIPPED = f"""{WITH_SEQ},
w10 AS (SELECT seq_id, p, substr(seq, p + 1, 10) AS w FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 9)) AS p FROM sequences WHERE length(seq) >= 10)),
eq AS (SELECT a.seq_id, b.p - a.p AS k, a.p AS p FROM w10 a JOIN w10 b ON a.seq_id = b.seq_id AND a.w = b.w AND b.p - a.p BETWEEN 1 AND {kernels.UNIT}),
isl AS (SELECT *, p - row_number() OVER (PARTITION BY seq_id, k ORDER BY p) AS g FROM eq),
rn AS (SELECT seq_id, k, min(p) AS a, count(*) + 9 AS run FROM isl GROUP BY seq_id, k, g),
un AS (SELECT r.*, substr(seq, a + 1, k) AS unit, run // k + 1 AS copies FROM rn r JOIN sequences USING (seq_id) WHERE run >= (greatest(2, ceil(20.0 / k)::INT) - 1) * k AND k <= length(seq) // 2 - 1),
bs AS (SELECT *, coalesce(substr(unit, 1, list_filter(range(1, k // 2 + 1), lambda j: substr(repeat(substr(unit, 1, j), k // j + 1), 1, k) = unit)[1]), unit) AS base, repeat(unit, copies) AS part FROM un),
pu AS (SELECT *, length(base) AS b, length(part) AS n, list_sum(list_transform(range(1, length(part) + 1), lambda i: CASE WHEN substr(part, i, 1) = substr(base, (i - 1) % length(base) + 1, 1) THEN 1 ELSE 0 END))::DOUBLE / length(part) AS purity FROM bs),
ok AS (SELECT *, a + n AS e, length(regexp_replace(part, '[^GC]', '', 'g'))::DOUBLE / n AS gc FROM pu WHERE n >= 20 AND purity >= 0.9 AND n::DOUBLE / b >= CASE WHEN b <= 4 THEN 6 ELSE 2 END),
rw AS (SELECT *, CASE WHEN b <= 9 THEN 'STR' ELSE 'Direct Repeat' END AS subclass, round(least(3.0::DOUBLE, greatest(1.0::DOUBLE, (1 + 2 * least(1.0::DOUBLE, 0.30::DOUBLE * least(1.0::DOUBLE, ln(n) / ln(25) / 2) + 0.30::DOUBLE * least(1.0::DOUBLE, ln(copies) / ln(4) / 2) + 0.15::DOUBLE * CASE WHEN b BETWEEN 2 AND 4 THEN 1.0::DOUBLE WHEN b IN (1, 5, 6) THEN 0.75::DOUBLE WHEN b <= 20 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END + 0.15::DOUBLE * purity * purity + 0.10::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * gc)))
 * CASE WHEN base IN ({", ".join(f"'{u}'" for u in sorted(kernels.UNITS))}) THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)), 3) AS raw FROM ok),
kp AS (SELECT seq_id, k FROM {_greedy_sql('(SELECT seq_id, k AS unit_size, a, e, b, raw, subclass FROM rw)', 'seq_id', "{'s': a, 'e': e, 'raw': raw, 'subclass': subclass}", 'a, b DESC, unit_size')})
SELECT seq_id, k.subclass AS subclass, k.s + 1 AS start_pos, k.e AS end_pos, '+' AS strand, k.raw AS raw_score, CASE WHEN k.subclass = 'STR' THEN {_score_sql('k.raw', '1.0::DOUBLE', '3.0::DOUBLE', 'k.e - k.s', 1000)} ELSE {_score_sql('k.raw', '1.0::DOUBLE', '3.0::DOUBLE', 'k.e - k.s', 500)} END AS score, 'SLP' AS pattern_id FROM kp"""

_PARTS = {
    "Curved_DNA": ("d_global_curvature", "d_local_curvature"),
    "Slipped_DNA": (_SLIPPED,),
    "Cruciform": (_CRUCIFORMS,),
    "R-Loop": ("d_r_loop",),
    "Triplex": (_MIRRORS, "d_sticky"),
    "G-Quadruplex": ("d_g_quadruplex",),
    "i-Motif": ("d_i_motif",),
    "Z-DNA": ("d_z_dna", "d_egz"),
    "A-philic_DNA": ("d_a_philic",),
}
_HITS = " UNION ALL ".join(f"SELECT '{c}' AS class, seq_id, subclass, start_pos, end_pos, score FROM ({(_REGISTRY | _MORE)[p][1] if p.startswith('d_') else p})" for c, parts in _PARTS.items() for p in parts)
#: The whole scan: every motif, hybrid and cluster.
SCAN = f"""WITH hits AS MATERIALIZED ({_HITS}),
kept AS MATERIALIZED (SELECT seq_id, class, subclass, k.s + 1 AS start_pos, k.e AS end_pos, k.score AS score FROM {_greedy_sql('hits', 'seq_id, class, subclass', "{'s': start_pos - 1, 'e': end_pos, 'score': score}", 'score DESC, end_pos - start_pos DESC, start_pos, end_pos')}),
prs AS (SELECT a.seq_id, a.start_pos AS s1, a.end_pos AS e1, a.class AS c1, b.start_pos AS s2, b.end_pos AS e2, b.class AS c2, (least(a.end_pos, b.end_pos) - b.start_pos + 1)::DOUBLE / least(a.end_pos - a.start_pos + 1, b.end_pos - b.start_pos + 1) AS share
  FROM kept a JOIN kept b ON a.seq_id = b.seq_id AND a.class <> b.class AND b.start_pos <= a.end_pos AND (a.start_pos, a.end_pos) < (b.start_pos, b.end_pos)),
hyb AS (SELECT seq_id, 'Hybrid' AS class, c1 || '_' || c2 || '_Overlap' AS subclass, s1 AS start_pos, greatest(e1, e2) AS end_pos,
  row_number() OVER (PARTITION BY seq_id, s1, greatest(e1, e2), least(c1, c2), greatest(c1, c2) ORDER BY s1, e1, s2, e2, c1 || '_' || c2 || '_Overlap') AS r FROM prs WHERE share > 0.5 AND share < 0.99),
cl AS (SELECT DISTINCT seq_id, 'Non-B_DNA_Clusters' AS class, 'Mixed_Cluster_' || c || '_classes' AS subclass, start_pos, e AS end_pos FROM (SELECT seq_id, start_pos, count(*) OVER w AS n, count(DISTINCT class) OVER w AS c, max(end_pos) OVER w AS e FROM kept WINDOW w AS (PARTITION BY seq_id ORDER BY start_pos RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING)) WHERE n >= 4 AND c >= 3),
scan AS (SELECT seq_id, class, subclass, start_pos, end_pos FROM kept UNION ALL SELECT seq_id, class, subclass, start_pos, end_pos FROM hyb WHERE r = 1 UNION ALL SELECT * FROM cl)"""
_SUMS = " SELECT class, subclass, count(*) AS n, sum(end_pos - start_pos + 1)::BIGINT AS sum_length FROM scan GROUP BY 1, 2"


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class", "subclass").agg(F.count("*").alias("n"), F.sum("length").alias("sum_length"))


def _store(spark: SparkSession, sf_dir: str, size: int = 512, reach: int = 128) -> SequenceStore:
    """The sequences stored in small tiles, so that most slices span several."""
    return SequenceStore.create(sequences(spark, sf_dir), scratch(spark), size, reach)


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seq_id").cast("long")
    store = _store(spark, sf_dir)
    every = store.sequences().select("seq_id", F.explode(F.array(*map(F.lit, range(4)))).alias("k"), "length")
    regions = every.select("seq_id", "k", (i * 37 % 900 + 211 * F.col("k")).alias("start"), "length").withColumn("end", F.least("length", F.col("start") + 20 + (i * 53) % 1900)).filter("start < length")
    return store.letters(regions).select("seq_id", "k", "start", "end", F.md5("seq").alias("md5"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).chunks(CHUNK, 100).select("seq_id", "chunk", "start", "end", F.md5("seq").alias("md5"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return store.sequences().join(store.whole(), "seq_id").select("seq_id", "length", "n_tiles", F.md5("seq").alias("md5"))


def chunk_differences(seqs: DataFrame, size: int) -> DataFrame:
    """(class, subclass, n_exact, n_chunked, n_different): rows that both modes of the scan give, or one alone.

    The sequences are a written table, so that they aren't derived again for each detector.
    """
    seqs = written(seqs)
    fields = ["seq_id", "class", "subclass", "start_pos", "end_pos", "score", "strand", "pattern_id"]
    counted = lambda df, name: df.groupBy(*fields).agg(F.count("*").alias(name))
    both = counted(scan(seqs), "exact").unionByName(counted(scan(seqs, mode="chunked", size=size), "chunked"), allowMissingColumns=True)
    rows = both.groupBy(*fields).agg(F.coalesce(F.sum("exact"), F.lit(0)).alias("a"), F.coalesce(F.sum("chunked"), F.lit(0)).alias("b"))
    return rows.groupBy("class", "subclass").agg(F.sum("a").alias("n_exact"), F.sum("b").alias("n_chunked"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("n_different"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of features of every sequence, as a scan of regions reads them."""
    q = sequences(spark, sf_dir)
    i = F.col("seq_id").cast("long")
    features = q.select("seq_id", F.lit("gene").alias("type"), (i % 300).alias("start"), F.least(F.length("seq").cast("long"), i % 300 + 12 + (i * 71) % 5000).alias("end"))
    return readers.region_sequences(features, q).select("seq_id", F.md5("seq").alias("md5"))


def _json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motifs written as JSON objects, one for each sequence, and read again."""
    at = scratch(spark)
    writers.write(motifs(spark, sf_dir), at, "json")
    read = spark.read.schema("version string, analysis_type string, total_motifs long, motifs array<struct<seq_id: string, event_id: long, start_pos: long>>").json(at)
    return read.filter("version is not null").select("version", "total_motifs", F.explode("motifs").alias("m")).select("version", "total_motifs", "m.seq_id", "m.event_id", "m.start_pos")


def _stored_results(spark: SparkSession, sf_dir: str) -> ResultStore:
    """Motifs in a result store, in three batches; one is tried twice, and one crashed before it was committed."""
    store, rows = ResultStore(spark, scratch(spark)), motifs(spark, sf_dir)
    for k in (0, 1, 2, 1):
        store.append(rows.filter(F.col("event_id") % 3 == k), f"part-{k}")
    rows.write.parquet(f"{store.path}/data/part-9.{'0' * 32}")
    return store


def _accumulated(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Motifs as a stream of files, accumulated batch by batch, the stream started twice."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = scratch(spark)
        rows = motifs(spark, sf_dir)
        for part in (0, 1):
            rows.filter(F.substring("seq_id", 2, 9).cast("int") % 2 == part).coalesce(1).write.mode("append").parquet(f"{at}/in")
            arriving = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
            stream.accumulate(arriving, f"{at}/store", f"{at}/check", LENGTH).awaitTermination()
        return stream.accumulated(spark, f"{at}/store", kind)

    return run


def _null_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = sequences(spark, sf_dir)
    observed = detect(q, _NULL_CLASSES).groupBy("seq_id", "class").agg(F.count("*").alias("observed"))
    return statistics.with_null_model(observed, statistics.null_counts(q, _NULL_CLASSES, 2), 2)


_NULL_CLASSES = ["Curved_DNA", "Z-DNA"]
_MIXED = WITH_SEQ + """, turns AS (SELECT seq_id, seq, unnest(range(0, 2)) AS r FROM sequences), mixed AS MATERIALIZED (SELECT r || chr(9) || seq_id AS seq_id,
 array_to_string(list_transform(list_sort(list_transform(range(0, length(seq)), lambda i: {'k': md5('1:' || r || ':' || seq_id || ':' || i), 'c': substr(seq, i + 1, 1)})), lambda x: x.c), '') AS seq FROM turns)"""


def _counted(mixed: bool) -> str:
    rows = [(c, p) for c in _NULL_CLASSES for p in _PARTS[c]]
    swap = lambda sql: sql.replace(WITH_SEQ, "WITH sequences AS (SELECT seq_id, seq FROM mixed)", 1) if mixed else sql
    return " UNION ALL ".join(f"SELECT '{c}' AS class, seq_id FROM ({swap(_REGISTRY[p][1])})" for c, p in rows)


_NULL_SQL = f"""{_MIXED}, ob AS (SELECT seq_id, class, count(*) AS observed FROM ({_counted(False)}) GROUP BY 1, 2), bg AS (SELECT split_part(seq_id, chr(9), 2) AS seq_id, split_part(seq_id, chr(9), 1) AS round, class, count(*) AS n FROM ({_counted(True)}) GROUP BY 1, 2, 3),
st AS (SELECT ob.seq_id, ob.class, any_value(observed) AS observed, coalesce(sum(n), 0)::DOUBLE / 2 AS e, coalesce(sum(n * n), 0)::DOUBLE / 2 AS sq, count(*) FILTER (n >= observed) AS many FROM ob LEFT JOIN bg ON ob.seq_id = bg.seq_id AND ob.class = bg.class GROUP BY 1, 2), sd AS (SELECT *, sqrt(greatest(0.0::DOUBLE, sq - e * e)) AS std FROM st)
SELECT seq_id, class, observed, round(e, 6) AS expected, round(std, 6) AS std, round(CASE WHEN e > 0 THEN observed / e END, 6) AS fold, round((observed + 1) / (e + 1), 6) AS ratio, round(CASE WHEN std > 0 THEN (observed - e) / std END, 6) AS z_score, round((many + 1)::DOUBLE / 3, 6) AS p_value FROM sd"""

_CURVES_SQL = """, g AS (SELECT class, count(*) AS n, min(length)::DOUBLE AS lo, max(length)::DOUBLE AS hi, stddev_samp(length) AS sd FROM motifs GROUP BY 1), h AS (SELECT *, sd * pow(n::DOUBLE, -0.2::DOUBLE) AS h, (hi - lo) / 400 AS w FROM g WHERE sd > 0),
b AS (SELECT class, least(floor((length - lo) / w), 399) AS b, count(*) AS c FROM motifs JOIN h USING (class) GROUP BY 1, 2), p AS (SELECT class, n, h, c, lo + (b + 0.5::DOUBLE) * w AS m, i, lo - 3 * h + i * ((hi - lo + 6 * h) / 19) AS x FROM b JOIN h USING (class), (SELECT unnest(range(0, 20))::INT AS i))
SELECT class, i, round(any_value(x), 6) AS x, round(sum(c * exp(-0.5::DOUBLE * pow((x - m) / h, 2.0::DOUBLE))) / (any_value(n) * any_value(h) * sqrt(2.0::DOUBLE * pi())), 9) AS density FROM p GROUP BY class, i"""

_KEPT = _MORE["i_remove_overlaps"][1]
_RESOLVED = _MORE["i_resolve_cross_class"][1]
_PLACES = "seq_id::BIGINT % 300"

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_full": (lambda s, d: _sums(scan(sequences(s, d))), SCAN + _SUMS),
    "scan_chunked": (lambda s, d: _sums(scan(sequences(s, d), mode="chunked", size=CHUNK)), SCAN + _SUMS),
    "scan_chunk_differences": (lambda s, d: chunk_differences(sequences(s, d), CHUNK), SCAN + " SELECT class, subclass, count(*) AS n_exact, count(*) AS n_chunked, 0::BIGINT AS n_different FROM scan GROUP BY 1, 2"),
    "d_slipped": (_q(lambda q: _picked(detectors.slipped(q))), _SLIPPED),
    "d_cruciform": (_q(lambda q: _picked(detectors.cruciform(q))), _CRUCIFORMS),
    "d_h_dna": (_q(lambda q: _picked(detectors.h_dna(q))), _MIRRORS),
    "s_store_slices": (_slices, WITH_SEQ + ", g AS (SELECT seq_id, unnest(range(0, 4))::INT AS k, seq_id::BIGINT AS i, seq FROM sequences), r AS (SELECT *, i * 37 % 900 + 211 * k AS s, least(length(seq), i * 37 % 900 + 211 * k + 20 + (i * 53) % 1900) AS e FROM g) SELECT seq_id, k, s AS \"start\", e AS \"end\", md5(substr(seq, s + 1, e - s)) AS md5 FROM r WHERE s < length(seq)"),
    "s_store_chunks": (_chunks, WITH_SEQ + f", t AS (SELECT *, greatest(0, ceil((length(seq) - {CHUNK}) / {CHUNK - 100}.0))::BIGINT AS last FROM sequences), u AS (SELECT *, unnest(range(0, last + 1)) AS chunk FROM t) SELECT seq_id, chunk, chunk * {CHUNK - 100} AS \"start\", least(chunk * {CHUNK - 100} + {CHUNK}, length(seq)) AS \"end\", md5(substr(seq, chunk * {CHUNK - 100} + 1, {CHUNK})) AS md5 FROM u"),
    "s_store_list": (_stored, WITH_SEQ + " SELECT seq_id, length(seq)::BIGINT AS length, greatest(1, ceil(length(seq) / 512.0))::BIGINT AS n_tiles, md5(seq) AS md5 FROM sequences"),
    "s_region_sequences": (_regions, WITH_SEQ + f", r AS (SELECT seq_id, seq, {_PLACES} AS s, least(length(seq), {_PLACES} + 12 + (seq_id::BIGINT * 71) % 5000) AS e FROM sequences) SELECT seq_id || ':' || s || '-' || e || ':gene' AS seq_id, md5(substr(seq, s + 1, e - s)) AS md5 FROM r WHERE e - s >= 12"),
    "i_remove_overlaps_segments": (_m(lambda m, n: intervals.select_greedy(m, ["seq_id", "class", "subclass"], [-F.col("score"), -F.col("length"), F.col("start_pos")], F.col("start_pos") - 1, F.col("end_pos"), spread=True, width=5000).select("seq_id", "class", "start_pos", "end_pos", "score")), _KEPT),
    "i_resolve_cross_class_segments": (_m(lambda m, n: intervals.resolve_cross_class(m.withColumn("class", F.lit("Z-DNA")), spread=True).select("seq_id", "start_pos", "end_pos", "score")), _RESOLVED),
    "k_result_store": (lambda s, d: _stored_results(s, d).read().select("event_id", "seq_id", "class", "batch"), WITH_MOTIF + " SELECT event_id, seq_id, class, 'part-' || event_id % 3 AS batch FROM motifs"),
    "k_result_summary": (lambda s, d: _stored_results(s, d).summary(), WITH_MOTIF + " SELECT class, count(*) AS n, sum(length)::BIGINT AS bases, round(avg(score), 6) AS mean_score FROM motifs GROUP BY 1"),
    "k_result_batches": (lambda s, d: _stored_results(s, d).batches().select("batch", "rows", F.size("classes").alias("n_classes")), WITH_MOTIF + " SELECT 'part-' || event_id % 3 AS batch, count(*) AS rows, count(DISTINCT class)::INT AS n_classes FROM motifs GROUP BY 1"),
    "x_accumulated_bins": (_accumulated("bins"), WITH_MOTIF + f" SELECT class, what, bin, count(*) AS n FROM (SELECT class, 'start' AS what, least(floor((start_pos - 1) * 100 / {LENGTH}.0::DOUBLE)::BIGINT, 99) AS bin FROM motifs UNION ALL SELECT class, 'length', least(floor(length * 100 / 10000.0::DOUBLE)::BIGINT, 99) FROM motifs) GROUP BY 1, 2, 3"),
    "x_accumulated_pairs": (_accumulated("pairs"), WITH_MOTIF + ", h AS (SELECT DISTINCT seq_id, class FROM motifs) SELECT x.class AS class_a, y.class AS class_b, count(*) AS n FROM h x JOIN h y ON x.seq_id = y.seq_id AND x.class < y.class GROUP BY 1, 2"),
    "x_accumulated_sums": (_accumulated("sums"), WITH_MOTIF + " SELECT class, count(*) AS rows, sum(length)::BIGINT AS bases FROM motifs GROUP BY 1"),
    "a_null_model": (_null_model, _NULL_SQL),
    "a_shuffled_letters": (_q(lambda q: statistics.shuffled_letters(q, 2, size=512).select("seq_id", "round", F.md5("seq").alias("md5"))), _MIXED + " SELECT split_part(seq_id, chr(9), 2) AS seq_id, split_part(seq_id, chr(9), 1)::INT AS round, md5(seq) AS md5 FROM mixed"),
    "w_density_curves": (_m(lambda m, n: series.density_curves(m, points=20)), WITH_MOTIF + _CURVES_SQL),
    "k_json": (_json_file, WITH_MOTIF + " SELECT '1' AS version, count(*) OVER (PARTITION BY seq_id) AS total_motifs, seq_id, event_id, start_pos FROM motifs"),
    "i_segments": (_m(lambda m, n: intervals.segmented(m, ["seq_id", "class"], F.col("start_pos") - 1, F.col("end_pos"), width=5000).groupBy("seq_id", "class", "_segment").agg(F.count("*").alias("n"), F.min("start_pos").alias("first"), F.max("end_pos").alias("last")).drop("_segment")), WITH_MOTIF + """, b AS (SELECT seq_id, class, (start_pos - 1) // 1000 AS f, min(start_pos - 1) AS s, max(end_pos) AS e FROM motifs GROUP BY ALL),
c AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY seq_id, class ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS clean FROM b), d AS (SELECT *, clean AND row_number() OVER (PARTITION BY seq_id, class, f // 5, clean ORDER BY f) = 1 AS opens FROM c),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY seq_id, class ORDER BY f) AS seg FROM d) SELECT m.seq_id, m.class, count(*) AS n, min(start_pos) AS first, max(end_pos) AS last FROM motifs m JOIN g ON m.seq_id = g.seq_id AND m.class = g.class AND (m.start_pos - 1) // 1000 = g.f GROUP BY m.seq_id, m.class, seg"""),
}
