"""Steps whose work or results changed with the size of a table."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helixspark.functions import scoring
from helixspark.operators import detectors, intervals, kernels, regexscan, reports, series, statistics, tiling
from helixspark.sources import writers


def test_json_objects_stay_whole_where_heads_and_rows_fill_other_numbers_of_partitions(spark, tmp_path):
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for size in sizes:
        spark.conf.set(size, "4kb")
    try:
        rows = spark.range(4000).selectExpr("concat('s', id % 7) AS seq_id", "'Z-DNA' AS class", "'Z-DNA' AS subclass", "id + 1 AS start_pos", "id + 9 AS end_pos", "9L AS length", "1.5D AS score")
        writers.write(rows, str(tmp_path / "out"), "json")
    finally:
        for size in sizes:
            spark.conf.unset(size)
    read = spark.read.schema("total_motifs long, motifs array<struct<seq_id: string>>").json(str(tmp_path / "out")).filter("total_motifs is not null")
    assert sorted((r.motifs[0].seq_id, len(r.motifs)) for r in read.collect()) == [(f"s{k}", len(range(k, 4000, 7))) for k in range(7)]


def test_choice_between_rows_of_equal_order_depends_on_no_input_order(spark):
    rows = [("s", 5 * (k // 2), 5 * (k // 2) + 5, 1.0, f"p{k % 2}") for k in range(40)]
    for turn in (rows, rows[::-1]):
        df = spark.createDataFrame(turn, "seq_id string, a long, b long, score double, pattern_id string").coalesce(1)
        kept = intervals.select_greedy(df, ["seq_id"], [-F.col("score")], F.col("a"), F.col("b")).collect()
        assert sorted(r.a for r in kept) == list(range(0, 100, 5)) and {r.pattern_id for r in kept} == {"p0"}


def test_clusters_score_depends_on_no_order(spark):
    rows = [("s", 1, 9, c, x) for c, x in zip("abcabc", (1.001, 1.103, 2.308, 1.009, 1.703, 1.107), strict=True)]
    for turn in itertools.islice(itertools.permutations(rows), 0, 720, 90):
        df = spark.createDataFrame(list(turn), "seq_id string, start_pos long, end_pos long, class string, score double").coalesce(1)
        assert [r.score for r in intervals.clusters(df).collect()] == [1.372]


def test_places_of_odd_letters_of_a_long_sequence(spark):
    seq = "ACGT" * 100_000 + "X" + "ACG" * 5 + "*\\X" + "X" * 20
    df = spark.createDataFrame([("a", seq), ("b", "ACGTN"), ("c", "\\E.é")], "seq_id string, raw string")
    got = {r.seq_id: {x.letter: x.places for x in r.invalid} for r in reports.preprocessed(df).collect()}
    text = seq.upper()
    assert got["a"] == {c: [i for i, x in enumerate(text) if x == c][:10] for c in "X*\\"} and got["b"] == {}
    assert got["c"] == {"\\": [0], "E": [1], ".": [2], "É": [3]}


def test_regex_hits_shuffle_nothing(spark):
    df = spark.createDataFrame([("a", "GGGATTT_GGGG"), ("b", None), ("c", "")], "seq_id string, seq string")
    hits = regexscan.regex_hits(df, {"g": "G{3,}", "t": "T+"})
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hits.collect())) == [("a", "g", 0, 3, "GGG"), ("a", "g", 8, 12, "GGGG"), ("a", "t", 4, 7, "TTT")]


def test_words_that_stand_again_are_found_as_backtracking_finds_them():
    rng = random.Random(5)
    for pattern in (r"([ATGC]{5,20})(?:[ATGC]{0,100})\2", r"([ATGC]{10,50})(?:[ATGC]{0,200})\2"):
        spans, plain = regexscan._finder(pattern), re.compile(f"({pattern})")
        assert "repeats_apart" in spans.__qualname__
        for n in (0, 9, 10, 11, 60, 700):
            for letters in ("A", "AC", "ACGT", "ACGTNé"):
                s = "".join(rng.choices(letters, k=n))
                s += s[5:40] * 3 + "N" + s[:60]
                assert list(spans(s)) == [m.span() for m in plain.finditer(s)]


def test_letters_are_dealt_where_they_stand_and_long_sequences_in_buckets(spark):
    rng = random.Random(2)
    texts = {"a": "".join(rng.choices("ACGT", k=700)), "b": "é" + "AC" * 40, "c": "", "d": "G"}
    df = spark.createDataFrame(list(texts.items()), "seq_id string, seq string")
    plain = lambda i, r: "".join(texts[i][p] for p in sorted(range(len(texts[i])), key=lambda p: hashlib.md5(f"4:{r}:{i}:{p}".encode()).hexdigest()))
    want = {(i, r): plain(i, r) for i in texts if texts[i] for r in (0, 1)}
    for whole in (1 << 20, 64):
        got = statistics.shuffled_letters(df, 2, 4, 50, whole)
        assert {(r.seq_id, r["round"]): r.seq for r in got.collect()} == want
    one = statistics.shuffled_letters(df.filter("seq_id = 'a'"), 2, 4)
    assert one.count() == 2 and one._jdf.queryExecution().optimizedPlan().toString().count("Explode") == 0


def test_overlaps_are_counted_and_united_without_a_row_for_each_pair(spark):
    rng = random.Random(4)
    rows = [("s" if rng.random() < 0.7 else "t", a, a + rng.choice([0, 3, 12, 40, 900]), rng.choice("XYZ"), rng.randrange(1000, 3000) / 1000, k) for k, a in enumerate(rng.choices(range(1, 4000), k=400))]
    df = spark.createDataFrame(rows, "seq_id string, start_pos long, end_pos long, class string, score double, event_id long")
    later = [(a, b) for a in rows for b in rows if a[0] == b[0] and (a[1], a[2], a[5]) < (b[1], b[2], b[5])]
    pairs, sets = Counter(), {}
    for a, b in later:
        if b[1] < a[2]:
            sets.setdefault(a, {a[3]}).add(b[3])
            if a[3] != b[3]:
                pairs[tuple(sorted((a[3], b[3])))] += 1
    found = series.overlap_counts(df, top=None)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.b): r.n for r in found.collect()} == pairs
    assert {r["classes"]: r.n for r in series.class_combinations(df).collect()} == Counter("+".join(sorted(x)) for x in sets.values())
    unions = {}
    for a, b in later:
        share = max(0, min(a[2], b[2]) - b[1] + 1) / min(a[2] - a[1] + 1, b[2] - b[1] + 1)
        if a[3] != b[3] and 0.5 < share < 0.99:
            key, row = (a[0], a[1], max(a[2], b[2]), tuple(sorted((a[3], b[3])))), (a[2], b[1], b[2], f"{a[3]}_{b[3]}_Overlap", -(a[4] + b[4]))
            unions[key] = min(unions.get(key, row), row)
    got = {(r.seq_id, r.start_pos, r.end_pos, tuple(r.component_classes)): r for r in intervals.hybrids(df).collect()}
    assert set(got) == set(unions) and all(got[k].subclass == v[3] and abs(got[k].score + v[4] / 2) < 6e-4 for k, v in unions.items())
    assert intervals.hybrids(df.limit(0)).count() == 0 and series.class_combinations(df.drop("event_id").limit(0)).count() == 0


def test_tiles_give_no_row_for_a_short_run_at_their_border(spark):
    rng = random.Random(31)
    seq = "".join(rng.choices("ACGT", k=6000)) + "CAG" * 200 + "".join(rng.choices("ACGT", k=6000)) + "AAGGCTTACGATCGA" * 2
    df = spark.createDataFrame([("s", seq)], "seq_id string, seq string")
    tiles = tiling.cut(df, 100, tiling.CONTEXT, tiling.CONTEXT, safe=True)
    rows = kernels.repeat_runs_of_tiles(tiles).collect()
    assert len(rows) < 300 and tiles.count() > 50  # some 50 a tile when every run at a border counts
    fields = ("subclass", "start_pos", "end_pos", "raw_score", "pattern_id")
    chosen = lambda found: sorted(tuple(r[f] for f in fields) for r in found.collect())
    assert chosen(detectors.slipped(tiles)) == chosen(detectors.slipped(df)) and len(chosen(detectors.slipped(df))) >= 2


def test_rows_that_are_looked_at_together_give_what_each_gives_alone():
    rng = random.Random(32)
    turn = str.maketrans("ACGT", "TGCA")
    texts = []
    for _ in range(150):
        arm, gap = "".join(rng.choices(rng.choice(["AG", "ACGT", "GC"]), k=rng.randrange(6, 60))), "".join(rng.choices("ACGTN", k=rng.randrange(14)))
        texts.append(rng.choice([arm + gap + arm[::-1], arm + gap + arm[::-1].translate(turn), arm * rng.randrange(1, 9), gap]))
    texts += ["", "A", "N" * 300, "AT" * 400, "é" + "GAA" * 20]
    rows = [(t, 0, len(t), True, True) for t in texts]
    for kernel in (kernels.slipped_rows, kernels.cruciform, kernels.mirror):
        alone = [(i, *hit[1:]) for i, row in enumerate(rows) for hit in kernel([row])]
        assert sorted(map(str, kernel(rows))) == sorted(map(str, alone)) and alone


def test_palindromes_of_a_large_repeat_take_no_square_of_it():
    seq = "AT" * 100_000  # every place is a centre that grows to the nearer end
    assert scoring.longest_palindrome(seq) == len(seq) and scoring.longest_palindrome("N" + seq + "C") == len(seq)
    assert scoring.alternation("ACGCGTAN") == 7.5 and scoring.most_skewed("GGGCCCC", 3) == 3


def test_copies_of_a_unit_are_those_of_the_regular_expression():
    rng = random.Random(33)
    words = ["", "AAA", "xxxxxx", "éAAAA", "ACACACACAGACAGACAGACAG"] + ["".join(rng.choices(rng.choice(["AC", "ACG", "ACGTN", "ANx"]), k=rng.randrange(1, 90))) for _ in range(600)]
    for w in words:
        for k in range(1, 7):
            assert scoring.most_copies(w, k) == max((len(m[0]) // k for m in re.finditer(rf"([ACGTN]{{{k}}})\1{{2,}}", w)), default=0), (w, k)


def test_near_duplicates_are_looked_for_among_near_rows_only(spark):
    rng = random.Random(34)
    rows = []
    for k in range(60_000):  # one island of each sequence
        a = 10 * (k // 2) + rng.randrange(8)
        rows.append(("st"[k % 2], "Z-DNA", "Z-DNA", a + 1, a + rng.choice((40, 40, 60, 20)), rng.randrange(9) / 4))
    df = spark.createDataFrame(rows, "seq_id string, class string, subclass string, start_pos long, end_pos long, score double")

    def plain(mine: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for s, e, w in sorted((r[3] - 1, r[4], -r[5]) for r in mine):
            near = [k for k in range(max(0, len(kept) - 100), len(kept)) if kept[k][0] >= s - 2000 and min(e, kept[k][1]) - max(s, kept[k][0]) >= 0.5 * min(e - s, kept[k][1] - kept[k][0])]
            if not near:
                kept.append((s, e, w))
            elif w < kept[best := min(near, key=lambda k: (kept[k][2], -k))][2]:
                kept[best] = (s, e, w)
        return kept

    began = time.monotonic()
    got = sorted((r.seq_id, r.start_pos - 1, r.end_pos, -r.score) for r in intervals.dedup_near(df).collect())
    took = time.monotonic() - began
    assert got == sorted((n, *r) for n in "st" for r in plain([r for r in rows if r[0] == n])) and took < 20


def _of_tracts(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    parts = ["AAAAATGCGC", "TTTTAGCGCGC", "GGGTTAGGGT", "GGGACGGGAAGGGCCGGG", "CCCTACCCTTCCCAGTCCC", "ACGTGCATGACT", "AAACGTACCCATGACCCAATTCCC"]
    return "".join(rnd.choice(parts) for _ in range(n))


def test_patterns_chosen_where_the_text_is_shuffle_nothing(spark):
    df = spark.createDataFrame([("a", _of_tracts(1, 300) + "AAAAATGCGCG" * 5)], "seq_id string, seq string")
    for detector in (detectors.global_curvature, detectors.quadruplexes, detectors.i_motifs):
        found = detector(df)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString(), detector.__name__
        assert found.count() > 0


def test_chains_over_borders_of_tiles(spark):
    seqs = [("a", "AAAAATGCGCG" * 300), ("b", _of_tracts(2, 400)), ("c", "AAAACTGTGTG" * 3 + "CTCTAGAGTCAGACTCATGA" * 9 + "AAAACTGTGTG" * 4), ("d", "AAAT")]
    df = spark.createDataFrame(seqs, "seq_id string, seq string")
    rows = lambda d: sorted((r.seq_id, r.start_pos, r.end_pos, r.raw_score, r.attrs["tracts"]) for r in d.collect())
    exact = rows(detectors.global_curvature(df))
    assert {r[0] for r in exact} == {"a", "b", "c"}
    for size in (24, 40, 100):
        assert rows(detectors.global_curvature(tiling.cut(df, size, 2048, 2048, safe=True))) == exact


def test_i_motifs_are_those_chosen_from_all_hits(spark):
    df = spark.createDataFrame([(str(k), _of_tracts(k, 60)) for k in range(6)], "seq_id string, seq string")
    got = sorted((r.seq_id, r.start_pos - 1, r.end_pos, r.strand, r.pattern_id, r.raw_score) for r in detectors.i_motifs(df).collect())
    relaxed = (F.col("pattern_id") == "IM_EXT").cast("int")
    order = [-F.col("raw"), relaxed, F.col("start") - F.col("end"), (F.col("strand") == "-").cast("int")]
    kept = [intervals.select_greedy(h, ["seq_id"], order, F.col("start"), F.col("end")) for h in (detectors.i_motif_hits(df), detectors.ac_motif_hits(df))]
    assert got == sorted((r.seq_id, r.start, r.end, r.strand, r.pattern_id, r.raw) for d in kept for r in d.collect())
    assert {r[4][:3] for r in got} == {"IM_", "HUR"}


def test_half_up_is_spark_round(spark):
    values = [0.0078125, 0.12345650000000001, 0.0000005, 1.0, 0.3 - 0.1, 2 / 3, 92 / 128 + 0.24]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 6).alias("r"))
    assert [kernels.half_up(x) for x in values] == [r.r for r in df.collect()]


def test_hybrids_of_many_stretches_need_no_call_for_each(spark):
    rnd = random.Random(5)
    rows = [(f"s{rnd.randrange(40)}", at, at + rnd.randint(5, 60), rnd.choice("ABC"), rnd.randint(1000, 3000) / 1000) for at in (rnd.randrange(1, 30_000) for _ in range(12_000))]
    df = spark.createDataFrame(rows, "seq_id string, start_pos long, end_pos long, class string, score double").coalesce(1)
    found = intervals.hybrids(df)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for name, mine in by.items():
        mine.sort(key=lambda r: r[1:3])
        for i, (_, s, e, c, x) in enumerate(mine):
            for _, t, f, d, y in itertools.takewhile(lambda r: r[1] <= e, mine[i + 1 :]):
                if c != d and 0.5 < (min(e, f) - t + 1) / min(e - s + 1, f - t + 1) < 0.99:
                    key, value = (name, s, max(e, f), *sorted((c, d))), (s, e, t, f, f"{c}_{d}_Overlap", -(x + y))
                    want[key] = min(want.get(key, value), value)
    got = {(r.seq_id, r.start_pos, r.end_pos, *r.component_classes): (r.subclass, r.length) for r in found.collect()}
    assert len(got) > 100 and got == {k: (v[4], k[2] - k[1] + 1) for k, v in want.items()}


def test_quadruplexes_take_one_python_pass(spark):
    df = spark.createDataFrame([("a", "GGGAGGGAGGGAGGG")], "seq_id string, seq string")
    assert detectors.quadruplexes(df)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_an_audit_runs_the_detectors_once(spark, tmp_path):
    from helixspark.operators import detector_api
    from helixspark.plans.scan import detect

    df = spark.createDataFrame([("a", _of_tracts(1, 60) + "CAG" * 9 + "GGGTTAGGGTTAGGGTTAGGG")], "seq_id string, seq string")
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    hits = detect(df)
    audited = detector_api.audit(hits.mapInArrow(counted, hits.schema))
    rows = audited.collect()
    assert ran.value == sum(r.candidates for r in rows) == hits.count() and all(r.reported + r.filtered == r.candidates for r in rows)


def test_tiles_choose_what_they_see_the_whole_of():
    """Of tiles with all letters around, islands away from borders are settled in the tile; with what is open chosen over the sequence, the hits are the sequence's."""
    rng = random.Random(35)
    turn, settled = str.maketrans("ACGT", "TGCA"), Counter()
    for _ in range(6):
        parts = []
        while sum(map(len, parts)) < 4000:
            arm = "".join(rng.choices(rng.choice(["AG", "ACGT", "GC", "AC"]), k=rng.randrange(8, 70)))
            parts.append(rng.choice([arm + arm[::-1], arm + "ACGT" + arm[::-1].translate(turn), arm[:9] * rng.randrange(2, 40), arm]))
            parts.append("".join(rng.choices("ACGT", k=60)))
        seq, rows, at = "".join(parts), [], 0
        while at < len(seq):
            rows.append((seq, at, min(len(seq), at + 300), True, True))
            at += 300
        for tile, whole, order in ((kernels.mirror_of_tile, kernels.mirror, lambda r: (-int(r[4]["arm"]), int(r[4]["loop"]), r[0])), (kernels.cruciform_of_tile, kernels.cruciform, lambda r: (-r[3], r[0] - r[1], r[0], -int(r[4]["arm"])))):
            found = [r[1:] for r in tile(rows)]
            still = sorted((r[:5] for r in found if r[5]), key=order)
            got = [r[:5] for r in found if not r[5]] + [still[j] for j in kernels.first_free([r[:2] for r in still])]
            assert sorted(map(str, got)) == sorted(str(r[1:]) for r in whole([(seq, 0, len(seq), True, True)]))
            settled[tile] += len(found) - len(still)
    assert len(settled) == 2 and all(settled.values())


def test_digests_of_places_are_made_together():
    heads = [(b"1:0:s:", 0, 30), (b"1:1:s:", 95, 1200), (b"", 0, 1), (b"x" * 51, 9_990, 20), (b"y" * 70, 0, 12), (b"4:1:a:", 999_990, 40_000), (b"z" * 30, (1 << 32) - 5, 10), ("é:".encode(), 7, 0)]
    want = b"".join(hashlib.md5(head + b"%d" % i).digest() for head, at, n in heads for i in range(at, at + n))
    assert statistics._digests(heads).astype(">u8").tobytes() == want
    assert statistics._digests([]).shape == (0, 2)
    keys, letters = np.array([[5, 2], [5, 1], [1, 9]], ">u8"), np.array([65, 66, 67], "<u4")
    assert statistics._in_order(keys, letters) == "CBA"
