import gzip
import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from helixspark import catalog
from helixspark.functions import registry, scoring, tables
from helixspark.functions import sequence as fn
from helixspark.operators import detectors, intervals, kernels, reports, series, statistics
from helixspark.plans.scan import scan
from helixspark.sources import readers, writers
from helixspark.streaming import stream
from tests import naive

DIR = "/root/testdata/sf0.001"


def dna(rng, n, weights=(1, 1, 1, 1)):
    return "".join(rng.choices("ACGT", weights, k=n))


def planted(rng, n):
    out = []
    for i in range(n):
        arm, pur = dna(rng, rng.randrange(8, 20)), "".join(rng.choices("AG", k=rng.randrange(10, 25)))
        rc = "".join(naive.COMPLEMENT[x] for x in reversed(arm))
        parts = [dna(rng, rng.randrange(60)), arm, dna(rng, rng.randrange(13)), rc, dna(rng, rng.randrange(40)), pur, dna(rng, rng.randrange(9)), pur[::-1], dna(rng, rng.randrange(300), (1, 1, 6, 1)), "GGGAGGGTGGGTAGGG" * rng.randrange(3), "GGGGT" * rng.randrange(90), dna(rng, 30)]
        out.append((f"q{i}", "".join(parts)))
    return out


def sequences(spark, rows):
    return spark.createDataFrame(rows, "seq_id string, seq string")


def test_tables():
    assert len(tables.z_tenmers()) == 126 and len(tables.a_tenmers()) == 208
    assert dict(tables.z_tenmers())["CGCGCGCGCG"] == 63.0 and round(dict(tables.a_tenmers())["AGGGGGGGGG"], 6) == 2.702429
    assert sum(map(len, tables.TAXONOMY.values())) == 24


ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert cols == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    expect = sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=key)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == expect


def test_kernels_equal_plain_search(spark):
    rows = planted(random.Random(1), 12)
    df = sequences(spark, rows)
    got = {}
    for name, f in (("c", detectors.cruciform), ("m", detectors.h_dna)):
        for r in f(df).collect():
            got.setdefault((name, r.seq_id), []).append((r.start_pos - 1, r.end_pos, r.raw_score))
    hits = 0
    for i, s in rows:
        c, m = naive.cruciforms(s, tables.STACKING), naive.mirrors(s)
        assert sorted(got.get(("c", i), [])) == c and sorted(got.get(("m", i), [])) == m
        hits += bool(c) + bool(m)
    assert hits > 12


def test_r_loops_and_quadruplexes_equal_plain_search(spark):
    rows = planted(random.Random(2), 10)
    df = sequences(spark, rows)
    loops, quads = {}, {}
    for r in detectors.r_loops(df).collect():
        loops.setdefault(r.seq_id, []).append((r.start_pos - 1, r.end_pos, r.strand, r.pattern_id, float(r.attrs["riz_percent_g"]), float(r.attrs["rez_percent_g"])))
    for r in detectors.quadruplexes(df).collect():
        quads.setdefault(r.seq_id, []).append((r.start_pos - 1, r.end_pos, r.pattern_id, r.raw_score))
    order = {p: i for i, p in enumerate(detectors.G4_NAMES)}
    for i, s in rows:
        assert sorted(loops.get(i, [])) == naive.rloops(s)
        assert sorted(quads.get(i, [])) == naive.quadruplexes(s, detectors.QUADRUPLEXES, order)
    assert any(x[5] > 0 for v in loops.values() for x in v) and quads


def test_repeats_and_sticky(spark):
    df = sequences(spark, [("a", "GAA" * 13), ("b", "TTC" * 10), ("c", "GAAGAAGAAGAAGAAGAAATTATTTTCTTCTTCTTCTTCTTC"), ("d", "CAG" * 9 + "TCAGTTACCA"), ("e", "TTCA" + "ACGTTGCATTACGGATCA" * 2 + "CCTG")])
    got = {(r.seq_id, r.subclass) for r in scan(df, ["Slipped_DNA", "Triplex", "Cruciform"]).collect()}
    assert {("a", "Sticky DNA"), ("b", "Sticky DNA"), ("c", "Sticky DNA"), ("a", "STR"), ("c", "Cruciform forming IRs"), ("d", "STR"), ("e", "Direct Repeat")} <= got
    assert kernels.primitive("GAAGAAGA") == "GAA" and kernels.slipped("N" * 40) == []


def test_no_overlaps_after_the_scan_and_order_of_rows(spark):
    rows = planted(random.Random(3), 6)
    one = {tuple(r) for r in scan(sequences(spark, rows)).drop("attrs", "component_classes").collect()}
    two = {tuple(r) for r in scan(sequences(spark, rows[::-1]).repartition(5)).drop("attrs", "component_classes").collect()}
    assert one == two
    spans = {}
    for r in one:
        if r[1] not in ("Hybrid", "Non-B_DNA_Clusters"):
            spans.setdefault(r[:3], []).append((r[3], r[4]))
        assert r[5] == r[4] - r[3] + 1
    for s in spans.values():
        s.sort()
        assert all(a[1] < b[0] for a, b in zip(s, s[1:], strict=False))


def test_greedy_equals_plain_loop(spark):
    rng = random.Random(5)
    rows = [("s", "c", "x", a := rng.randrange(1, 3000), a + (n := rng.randrange(1, 60)) - 1, n, rng.randrange(100) / 10) for _ in range(800)]
    df = spark.createDataFrame(rows, "seq_id string, class string, subclass string, start_pos long, end_pos long, length long, score double")
    got = sorted((r.start_pos, r.end_pos, r.score) for r in intervals.remove_overlaps(df).collect())
    best = sorted(((a - 1, e, s) for *_, a, e, n, s in rows), key=lambda r: (-r[2], -(r[1] - r[0]), r[0]))
    assert got == sorted((a + 1, e, s) for a, e, s in naive.greedy(best))


def test_chunked_scan_equals_the_exact_one_for_short_motifs(spark):
    rng = random.Random(7)
    s = "".join(dna(rng, 400) + "A" * rng.randrange(8, 20) + "C" for _ in range(30))
    df = sequences(spark, [("one", s)])
    key = lambda d: sorted((r.start_pos, r.end_pos) for r in d.filter("subclass = 'Local Curvature'").collect())
    assert key(scan(df, ["Curved_DNA"], mode="chunked", size=1000)) == key(scan(df, ["Curved_DNA"]))


def test_functions(spark):
    r = spark.createDataFrame([("ACGTNACGTT", "GATTACA" * 9)], "a string, b string").select(
        fn.is_palindrome(F.lit("ACGT")).alias("p"), fn.melting_temperature(F.lit("ACGT")).alias("tm"), fn.primitive_unit(F.lit("GAAGAAGA")).alias("u"), fn.primitive_unit(F.lit("ACGT")).alias("v"), fn.invalid_characters(F.lit("ACGTXZX")).alias("bad"), fn.invalid_positions(F.lit("AXGZ")).alias("at"),
        fn.wrapped(F.lit("A" * 10), 4).alias("w"), fn.wrapped(F.lit("A" * 8), 4).alias("w2"), fn.reverse_complement(F.lit("acgtrysw")).alias("rc"), fn.validity(F.lit("")).alias("e"), fn.gc_content(F.lit("NNN")).alias("gc"), F.length(fn.shuffled(F.col("b"), 3)).alias("n"),
    ).first()
    assert (r.p, r.tm, r.u, r.v, r.bad, r.at, r.w, r.w2, r.rc, r.e, r.gc, r.n) == (True, 12.0, "GAA", "ACGT", "XZ", [2, 4], "AAAA\nAAAA\nAA", "AAAA\nAAAA", r.rc, "empty", 0.0, 63)


def test_scores_and_units_of_whole_sequences(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(1, 90)))) for i in range(10)] + [(20, "g" * 50), (21, "at" * 40), (22, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seqs = {r.seq_id: r.seq for r in catalog.sequences(spark, str(tmp_path)).collect()}
    got = {r.seq_id: r.asDict() for r in catalog.queries()["f_scores"](spark, str(tmp_path)).collect()}
    for i, s in seqs.items():
        want = naive.scores(s)
        assert all(got[i][k] == pytest.approx(x, abs=2e-6) for k, x in want.items()), (i, want, got[i])
    assert len({tuple(sorted((k, v) for k, v in r.items() if k != "seq_id")) for r in got.values()}) == len(rows)
    units = {r.seq_id: r.u for r in catalog.queries()["f_primitive"](spark, str(tmp_path)).collect()}
    assert units == {i: naive.unit(s) for i, s in seqs.items()}


def test_units_and_palindromes_equal_plain_search(spark):
    rng = random.Random(10)
    words = ["", "A", "N", "ACGT", "ANT", "AANTT", "GAAGAAGA", "AAAAB", "ABABA"] + ["".join(rng.choices(rng.choice(["AT", "ACGT", "ACGTN", "A"]), k=rng.randrange(1, 40))) for _ in range(400)]
    words += [w * 3 + w[: len(w) // 2] for w in words[9:80]]
    for w in words:
        assert fn.shortest_unit(w) == naive.unit(w) and scoring.longest_palindrome(w) == naive.palindrome(w), w
    got = spark.createDataFrame([(w,) for w in words if len(w) > 0], "w string").select("w", scoring.g4hunter(F.col("w"), 7).alias("g")).collect()
    for w, g in got:
        k = min(7, len(w))
        assert g == max(abs(w[i : i + k].count("G") - w[i : i + k].count("C")) for i in range(len(w) - k + 1)) / k
    assert spark.createDataFrame([("",), (None,)], "w string").select(fn.primitive_unit(F.col("w")).alias("u"), scoring.g4hunter(F.col("w")).alias("g")).first() == ("", 0.0)


def test_fasta(spark, tmp_path):
    text = "; a comment\n>one first\nACGT\r\nac gt\n>two A->G mutant\nNNNNXX\n>one first\nTTTT\n>empty\n\n>\nGG\n  >three  x\nCC-C\n>\nAA"
    (tmp_path / "a.fa").write_text(text)
    want = {"one first": "TTTT", "two A->G mutant": "NNNN", "sequence_1": "GG", "three  x": "CCC", "sequence_2": "AA"}
    got = readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    assert {r.seq_id: r.seq for r in got} == want and all(r.length == len(r.seq) and r.source_file.endswith("a.fa") for r in got)
    assert readers.read_fasta(spark, str(tmp_path / "a.fa"), last_wins=False).count() == 6
    assert {r.seq_id for r in readers.read_fasta(spark, str(tmp_path / "a.fa"), header="token").collect()} == {"one", "two", "sequence_1", "three", "sequence_2"}
    assert {r.seq for r in readers.read_fasta(spark, str(tmp_path / "a.fa"), clean=False).collect()} >= {"NNNNXX", "CC-C"}
    for name in ("b.fa.gz", "c.bgz", "odd"):
        (tmp_path / name).write_bytes(gzip.compress(text[:40].encode()) + gzip.compress(text[40:].encode()))
    assert {r.seq_id: r.seq for r in readers.read_fasta(spark, str(tmp_path / "b.fa.gz")).collect()} == want
    for name in ("b.fa.gz", "c.bgz", "odd", "a.fa"):
        assert {r.seq_id: r.seq for r in readers.read_fasta_compressed(spark, str(tmp_path / name)).collect()} == want
    contents = spark.createDataFrame([(text, "x"), (">a\nAC", "y"), (None, "z")], "value string, source_file string")
    assert {(r.source_file, r.seq_id): r.seq for r in readers.parse_fasta(contents).collect()} == {("x", k): v for k, v in want.items()} | {("y", "a"): "AC"}
    rng = random.Random(4)  # a file cut into many splits
    rows = {f"name {i} >{i}": dna(rng, rng.randrange(1, 900)) for i in range(400)}
    (tmp_path / "large.fa").write_text("\n".join(f">{n}\n{s}" for n, s in rows.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = readers.read_fasta(spark, str(tmp_path / "large.fa"))
        assert {r.seq_id: r.seq for r in df.collect()} == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert readers.subsequence(df, "name 3 >3", 2, 9).first().seq == rows["name 3 >3"][2:9]


def test_files(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff\ns\tx\tgene\t3\t20\t.\t+\t.\tID=1\nbad line\ns\tx\tgene\tq\t9\t.\t+\t.\t.\n")
    gff = readers.read_gff(spark, str(tmp_path / "a.gff"))
    assert [(r.start, r.end, r.type) for r in gff.collect()] == [(2, 20, "gene")]
    seqs = sequences(spark, [("s", "ACGTACGTACGTACGTACGTACGT")])
    assert readers.region_sequences(gff, seqs).first().seq == "ACGTACGTACGTACGTACGTACGT"[2:20]
    source = sequences(spark, [("s", "CG" * 20 + "A" * 12 + "GAA" * 8), ("t", "T" * 9 + "ACGT" * 3)])
    motifs = writers.with_sequence(scan(source), source)
    plain = [r for r in motifs.collect() if r["class"] not in ("Hybrid", "Non-B_DNA_Clusters")]
    for kind in ("parquet", "csv", "bed", "gff3", "json", "jsonl"):
        writers.write(motifs, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == motifs.count() > len(plain) / 2
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert rows.columns == [*writers.CORE, "attrs", "class_diversity", "component_classes", "motif_count"] and rows.count() == len(plain)
    assert all(r.sequence == dict(source.collect())[r.seq_id][int(r.start_pos) - 1 : int(r.end_pos)] for r in rows.collect())
    text = lambda kind: "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part*")))
    tracks = text("bed").split("track name")[1:]
    assert len(tracks) == 2 and sum(len(t.splitlines()) - 1 for t in tracks) == len(plain)
    sections = text("gff3").split("##gff-version 3\n")[1:]
    assert len(sections) == 2
    for part in sections:
        head, *lines = part.splitlines()
        name = head.split()[1]
        assert head == f"##sequence-region {name} 1 {max(r.end_pos for r in motifs.collect() if r.seq_id == name)}"
        assert [x.split("\t")[8].split(";")[0] for x in lines] == [f"ID=motif_{i}" for i in range(1, len(lines) + 1)]
    region = writers.gff3_lines(motifs, spark.createDataFrame([("s", 76), ("t", 21)], "seq_id string, seq_length long"), length_of_name=True)
    assert {r.value for r in region.filter("value like '##seq%'").collect()} == {"##sequence-region s 1 1", "##sequence-region t 1 1"}
    objects = [json.loads('{"version"' + x) for x in text("json").split('{"version"')[1:]]
    assert sum(o["total_motifs"] for o in objects) == sum(len(o["motifs"]) for o in objects) == len(plain) and len(objects) == 2
    assert sum(1 for _ in text("jsonl").splitlines()) == motifs.count()
    writers.append_jsonl(motifs, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2 * motifs.count()
    with_file = motifs.withColumn("source_file", F.lit("f1"))
    writers.write(with_file, str(tmp_path / "by_file"))
    assert (tmp_path / "by_file" / "source_file=f1").is_dir()
    writers.save_job(str(tmp_path / "jobs" / "j1"), motifs, seqs, {"name": "x"})
    back = writers.load_job(spark, str(tmp_path / "jobs" / "j1"))
    assert back[2] == {"name": "x"} and back[0].count() == motifs.count()
    assert writers.job_exists(spark, str(tmp_path / "jobs" / "j1")) and not writers.job_exists(spark, str(tmp_path / "jobs" / "j2"))
    assert [tuple(r) for r in writers.list_jobs(spark, str(tmp_path / "jobs")).collect()] == [("j1", "name", "x")]
    assert writers.job_summary(spark, str(tmp_path / "jobs" / "j1")).agg(F.sum("n")).first()[0] == motifs.count()
    sheets = reports.statistics_workbook(motifs, spark.createDataFrame([("s", 76), ("t", 21)], "seq_id string, seq_length long"))
    assert {r.metric: r.value for r in sheets["Summary"].filter("seq_id = 't'").collect()}["total_motifs"] == sum(r.seq_id == "t" for r in plain)
    assert sheets["Subclass"].count() == len({(r.seq_id, r.subclass) for r in plain}) and sheets["Score_Distribution"].count() == len({r["class"] for r in plain})


def test_input_reports(spark):
    raw = spark.createDataFrame([(1, ">Head one\nacgt\nACGN\n>second\nGG"), (2, "  "), (3, "AC!G!T?"), (4, "NNN"), (5, None), (6, "GGGGGGCCCCA"), (7, " acgTN ")], "i int, raw string")
    got = {r.i: r for r in reports.report_text(reports.preprocessed(raw)).collect()}
    assert (got[1].header, got[1].seq, got[1].status, got[1].n_n, got[1].balance) == ("HEAD ONE", "ACGTACGNGG", "warning", 1, "GC-rich")
    assert [got[i].problem for i in (2, 3, 4, 5)] == ["empty sequence", "invalid characters: !?", "no valid bases", "empty sequence"]
    assert [(x.letter, x.places) for x in got[3].invalid] == [("!", [2, 4]), ("?", [6])] and got[6].status == "valid"
    assert "GC: 66.67%" in got[1].report and "Status: WARNING" in got[1].report
    total = reports.quality_report(reports.preprocessed(raw)).first()
    assert (total.total_sequences, total.n_valid, total.n_warning, total.n_error) == (7, 1, 2, 4)
    assert {r.i for r in reports.plain_input(raw).collect()} == {4, 6, 7}


def test_near_duplicates_equal_plain_loop(spark):
    rng = random.Random(11)
    fields = "seq_id string, class string, subclass string, start_pos long, end_pos long, length long, score double"
    rows = [(f"s{i % 3}", "c", f"x{i % 2}", a := rng.randrange(1, 6000), a + (n := rng.choice([5, 40, 900])) - 1, n, rng.randrange(30) / 10) for i in range(900)] + [("u", "c", "x", 1, 1000, 1000, 1.0), ("u", "c", "x", 1, 20, 20, 2.0)]
    want = []
    for key in {r[:3] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:3] == key), key=lambda r: (r[3], r[4], -r[6])):
            best = None
            for k in range(len(kept) - 1, -1, -1):
                shared = min(r[4], kept[k][4]) - max(r[3], kept[k][3]) + 1
                if kept[k][3] >= r[3] - 2000 and shared >= 0.5 * min(r[5], kept[k][5]) and (best is None or kept[k][6] > kept[best][6]):
                    best = k
            if best is None:
                kept.append(r)
            elif r[6] > kept[best][6]:
                kept[best] = r
        want += kept
    got = intervals.dedup_near(spark.createDataFrame(rows, fields))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and ("u", "c", "x", 1, 20, 20, 2.0) in want


def test_patterns_that_refer_back_equal_plain_search(spark):
    rng = random.Random(12)
    rows = [(f"q{i}", dna(rng, 60) + dna(rng, 4) * rng.randrange(1, 7) + "CA" * rng.randrange(3, 9) + dna(rng, 80) * 2) for i in range(8)]
    got = {tuple(r) for r in registry.scan_with_registry(sequences(spark, rows), "Slipped_DNA").select("seq_id", "pattern_id", "start", "end").collect()}
    want = {(i, p, m.start(), m.end()) for c, p, rx, _, _ in registry.PATTERNS if c == "Slipped_DNA" for i, s in rows for m in re.finditer(rx.replace("\\2", "\\1"), s)}
    assert got == want and len(want) > 10


def test_chunked_scan_equals_the_exact_one(spark):
    rng = random.Random(13)
    rows = [(f"q{k}", "".join(dna(rng, rng.randrange(150, 600)) + rng.choice(["A" * 12, "GAA" * 6, "CG" * 12, "CAG" * 9, "TTAGGG" * 5, "CCCTAA" * 5, "AAAAATGCGCG" * 4, "ACGGTCATTGCA" + "TTT" + "TGCAATGACCGT", "AGGAGAGGAAGGAG" + "T" + "GAGGAAGGAGAGGA"]) for _ in range(60))) for k in range(3)]
    key = lambda d: {(r.seq_id, r["class"], r.subclass, r.start_pos, r.end_pos, r.score) for r in d.collect()}
    whole, cut = key(scan(sequences(spark, rows))), key(scan(sequences(spark, rows), mode="chunked", size=6000))
    assert whole == cut and {c for _, c, *_ in whole} >= {"Curved_DNA", "Slipped_DNA", "Cruciform", "Triplex", "G-Quadruplex", "i-Motif", "Z-DNA"}


def test_stream(spark, tmp_path):
    sequences(spark, [("a", "A" * 20 + "CGTACGATCG"), ("b", "CG" * 20)]).write.parquet(str(tmp_path / "in"))
    query = stream.scan_stream(stream.stream_sequences(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), ["Curved_DNA", "Z-DNA"])
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r["class"] for r in found.collect()} == {"Curved_DNA", "Z-DNA"}
    assert {r["class"]: r["n"] for r in stream.running_counts(found).collect()}["Z-DNA"] == 1


def test_enrichment_and_plots(spark):
    seqs = sequences(spark, [("a", "CG" * 40 + dna(random.Random(1), 200))])
    r = statistics.enrichment(seqs, ["Z-DNA"], rounds=3).first()
    assert r.observed >= 1 and r.p_value <= 1
    motifs = catalog.motifs(spark, DIR)
    assert series.gc_fit(series.gc_windows(catalog.sequences(spark, DIR), motifs.withColumn("seq_id", F.substring("seq_id", 2, 9)))).count() > 0
    assert series.attribute_lengths(detectors.cruciform(sequences(spark, planted(random.Random(1), 4))), "loop").count() > 0
    assert scan(sequences(spark, [("x", None), ("y", ""), ("z", "ACGT!")])).count() == 0


def test_merged_equals_plain_union(spark):
    rng = random.Random(21)
    rows = [(f"s{i % 2}", a := rng.randrange(5000), a + rng.choice([3, 40, 700])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id string, start long, end long")
    want = []
    for k in ("s0", "s1"):
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if want and want[-1][0] == k and a <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(want[-1][2], b))
            else:
                want.append((k, a, b))
    for width in (100, 1_000_000):
        assert sorted(tuple(r) for r in intervals.merged(df, ["seq_id"], width=width).collect()) == sorted(want)
