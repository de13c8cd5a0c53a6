"""Tiles, stored sequences, chunked scans, segments, the automaton and the FASTA data source."""

import gzip
import random
import re
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixspark.operators import automaton, detectors, intervals, tiling
from helixspark.plans.scan import scan
from helixspark.sources import fasta_source, readers, writers
from helixspark.sources.store import SequenceStore
from tests.test_library import dna, planted, sequences

PATTERNS = {**detectors.LOCAL_CURVES, **detectors.STICKY, **detectors.EGZ, **detectors.RLOOPS, **detectors.QUADRUPLEXES, **detectors.IMOTIFS, **detectors.AC_MOTIFS, "tract": "A{3,}|T{3,}"}
TURN = str.maketrans("ACGT", "TGCA")
REPEATS = ["GAA", "TTC", "CGG", "GCC", "TTAGGG", "CCCTAA", "A", "T", "GGGA", "CCCT", "GGAAC", "AAACCCAACCCAACCC", "CAG"]


def repetitive(rng, n):
    """Sequences in which runs, tracts and repeats of many kinds follow each other."""
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice([lambda: dna(rng, rng.randrange(1, 90)), lambda: dna(rng, rng.randrange(1, 60), rng.choice([(1, 1, 6, 1), (1, 6, 1, 1), (6, 1, 1, 1)])), lambda: rng.choice(REPEATS) * rng.randrange(1, 30), lambda: "".join(rng.choice(["GGG", "GG", "G"]) + dna(rng, rng.randrange(1, 13), (1, 1, 0, 1)) for _ in range(9))])())
    return "".join(out)[:n]


def test_no_match_crosses_a_safe_place():
    rng = random.Random(31)
    places = 0
    for _ in range(60):
        s = repetitive(rng, 4000)
        if rng.random() < 0.3:
            s = s[:2000] + "N" * rng.randrange(1, 40) + s[2000:]
        cuts = sorted({tiling.safe_end(s, k) for k in range(0, len(s), 150)} - {0, len(s)})
        places += len(cuts)
        edges = [0, *cuts, len(s)]
        for p in PATTERNS.values():
            for whole, back in ((s, False), (s.translate(TURN)[::-1], True)):
                parts = [(a, s[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                pieces = [(len(s) - a - len(x), x.translate(TURN)[::-1]) for a, x in parts[::-1]] if back else parts
                assert [m.span() for m in re.finditer(p, whole)] == [(a + m.start(), a + m.end()) for a, x in pieces for m in re.finditer(p, x)]
    assert places > 500
    assert tiling.safe_end("GAA" * 90, 10) == 270 and tiling.safe_end("ACGTN" + "A" * 9, 3) == 4


def rows_of(df):
    return sorted((r.seq_id, r["class"], r.subclass, r.start_pos, r.end_pos, r.score, r.strand or "", r.pattern_id or "", str(sorted((r.attrs or {}).items()))) for r in df.collect())


def test_chunked_scan_equals_the_exact_one_for_all_classes(spark):
    rng = random.Random(17)
    rows = [(f"q{k}", repetitive(rng, 9000)) for k in range(3)] + [("p", "".join(s for _, s in planted(rng, 14))), ("short", "ACGTACGTAC"), ("n", "N" * 500 + "GGGAGGGTGGGTAGGG" * 4), ("unit", dna(rng, 97) * 40 + "GAA" * 700)]
    df = sequences(spark, rows)
    whole = rows_of(scan(df))
    found = {c for _, c, *_ in whole}
    assert found >= {"Curved_DNA", "Slipped_DNA", "Cruciform", "R-Loop", "Triplex", "G-Quadruplex", "i-Motif", "Z-DNA", "Hybrid", "Non-B_DNA_Clusters"}
    assert any(e - a > 2000 for _, c, _, a, e, *_ in whole if c == "Slipped_DNA")  # longer than a tile and its context
    for size in (700, 2500):
        assert rows_of(scan(df, mode="chunked", size=size)) == whole


def test_tiles_of_a_long_sequence_take_time_in_proportion(spark):
    letters = dna(random.Random(1), 1 << 20) * 40
    began = time.time()
    got = intervals.tiles(spark.createDataFrame([("s", letters)], "seq_id string, seq string").coalesce(1), 50_000, 2000).select("tile_id", "tile_start", "tile_end", F.length("tile_seq").alias("n"), F.md5("tile_seq").alias("m")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("tile_end").alias("e")).first()
    assert got.e == len(letters) and got.n == len(letters) + 2000 * (got.k - 1)
    assert time.time() - began < 40  # ten on a free machine


def test_stored_sequences(spark, tmp_path):
    rng = random.Random(3)
    seqs = {f"s{k}": dna(rng, n) for k, n in enumerate([0, 1, 99, 100, 101, 5000, 12_345])}
    store = SequenceStore.create(sequences(spark, [*seqs.items(), ("null", None)]), str(tmp_path / "store"), size=100, reach=20)
    assert {r.seq_id: r.seq for r in store.whole().collect()} == seqs
    assert {r.seq_id: (r.length, r.n_tiles) for r in store.sequences().collect()} == {k: (len(s), max(1, -(-len(s) // 100))) for k, s in seqs.items()}
    for name, a, b in [("s6", 0, 12_345), ("s6", 95, 105), ("s6", 100, 200), ("s5", 4990, 9999), ("s3", 0, 100), ("s6", 7, 8), ("s6", -5, 3)]:
        assert [(r.start, r.seq) for r in store.slice(name, a, b).collect()] == [(max(0, a), seqs[name][max(0, a) : b])]
    assert store.slice("s6", 50_000, 60_000).collect() == store.slice("none", 0, 9).collect() == store.slice("s0", 0, 9).collect() == []
    for size, overlap in ((1000, 0), (333, 40)):
        step, want = size - overlap, []
        for name, s in seqs.items():
            last = max(0, -(-(len(s) - size) // step))
            want += [(name, k, k * step, min(len(s), k * step + size), s[k * step : k * step + size]) for k in range(last + 1)]
        assert sorted(tuple(r) for r in store.chunks(size, overlap).collect()) == sorted(want)
    again = SequenceStore(spark, str(tmp_path / "store"))
    assert "PushedFilters: [" in again.slice("s6", 5, 9)._jdf.queryExecution().toString() and again.drop() and not again.drop()
    with pytest.raises(Exception, match="store|PATH"):
        SequenceStore(spark, str(tmp_path / "store"))


def test_letters_of_regions(spark):
    rng = random.Random(5)
    seqs = {"a": dna(rng, 9000), "b": dna(rng, 40)}
    regions = [(n, a, a + k, i) for i, (n, a, k) in enumerate([("a", 0, 9), ("a", 95, 10), ("a", 100, 8000), ("b", 39, 5), ("c", 1, 5), ("a", 100, 8000), ("a", 8990, 3000), ("b", 3, 0)])]
    df = spark.createDataFrame(regions, "seq_id string, start long, end long, i int")
    got = {r.i: r.seq for r in tiling.letters(df, tiling.pieces(sequences(spark, list(seqs.items())), 100, 20), F.col("start"), F.col("end"), size=100, reach=20).collect()}
    assert got == {i: seqs[n][a:b] if n in seqs else None for n, a, b, i in regions}


@pytest.mark.parametrize("width", [1000, 20_000])
def test_segments_hold_whole_islands_and_choices_are_the_same(spark, width):
    rng = random.Random(width)
    rows = [(f"s{i % 2}", "c", f"x{i % 3}", a := rng.randrange(1, 90_000), a + (n := rng.choice([3, 40, 300, 6000])) - 1, n, rng.randrange(100) / 10) for i in range(1500)]
    df = spark.createDataFrame(rows, "seq_id string, class string, subclass string, start_pos long, end_pos long, length long, score double")
    order = [-F.col("score"), -F.col("length"), F.col("start_pos")]
    plain, spread = (sorted(tuple(r) for r in intervals.select_greedy(df, ["seq_id", "subclass"], order, F.col("start_pos") - 1, F.col("end_pos"), spread=s, width=width).collect()) for s in (False, True))
    assert plain == spread and len(plain) > 100
    found = intervals.segmented(df, ["seq_id", "subclass"], F.col("start_pos") - 1, F.col("end_pos"), gap=7, width=width).collect()
    assert len(found) == len(rows)
    for key in {(r.seq_id, r.subclass) for r in found}:
        reach, before = {}, -1
        for r in sorted((r for r in found if (r.seq_id, r.subclass) == key), key=lambda r: r.start_pos):
            assert r._segment >= before and all(e + 7 < r.start_pos - 1 for s, e in reach.items() if s != r._segment)
            before, reach[r._segment] = r._segment, max(r.end_pos, reach.get(r._segment, 0))
    dense = df.withColumn("end_pos", F.col("start_pos") + 9).withColumn("length", F.lit(10).cast("long"))
    assert intervals.segmented(dense, ["seq_id"], F.col("start_pos"), F.col("end_pos"), width=1000).select("seq_id", "_segment").distinct().count() > 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ABÄ", min_size=0, max_size=5), max_size=8), st.lists(st.text("ABÄx🎉", max_size=60), max_size=4), st.integers(1, 9))
def test_automaton_equals_plain_search(words, texts, lane):
    machine = automaton.Automaton(words)
    got = sorted((int(t), machine.words[w], int(s)) for ts, ws, ss in machine.hits(texts, lane) for t, w, s in zip(ts, ws, ss, strict=True))
    assert got == sorted((i, w, k) for i, t in enumerate(texts) for w in set(words) - {""} for k in range(len(t)) if t.startswith(w, k))


def test_words_of_groups(spark):
    df = spark.createDataFrame([("a", "GGGTTAGGG"), ("b", None), ("c", "")], "seq_id string, seq string")
    got = sorted(tuple(r) for r in automaton.multi_pattern_hits(df, {"runs": ["GGG"], "tel": ["TTAGGG", "GGG", "", "q"]}).collect())
    assert got == sorted([("a", g, "GGG", k, k + 3) for g in ("runs", "tel") for k in (0, 6)] + [("a", "tel", "TTAGGG", 3, 9)])
    assert automaton.multi_pattern_hits(df, []).collect() == automaton.multi_pattern_hits(df, {}).collect() == []


def blocks(data, size=300):
    """data as a block-gzip file, with the empty last block."""
    out = []
    for part in [*(data[k : k + size] for k in range(0, len(data), size)), b""]:
        machine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = machine.compress(part) + machine.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def test_fasta_data_source(spark, tmp_path):
    rng = random.Random(6)
    records = {f"name {i} >{i}": dna(rng, rng.randrange(1, 400)) for i in range(200)}
    text = "junk before\n" + "".join(f">{n}\n" + "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + rng.choice(["\n", "\r\n", "\n\n"]) for n, s in records.items())
    (tmp_path / "plain.fa").write_bytes(text.encode())
    (tmp_path / "blocks.bgz").write_bytes(blocks(text.encode()))
    (tmp_path / "odd.gz").write_bytes(gzip.compress(text[:999].encode()) + gzip.compress(text[999:].encode()))
    assert gzip.decompress(blocks(text.encode())) == text.encode()
    fasta_source.register(spark)
    for name in ("plain.fa", "blocks.bgz", "odd.gz"):
        for size in (777, 5000, 1 << 20):
            df = spark.read.format("fasta").option("partitionBytes", size).load(str(tmp_path / name))
            got = df.collect()
            assert {r.seq_id: r.seq for r in got} == records and len(got) == len(records), (name, size)
            assert df.rdd.getNumPartitions() > 10 or size > 777 or name == "odd.gz"
    both = spark.read.format("fasta").option("header", "token").load(str(tmp_path / "*[az]")).select("seq_id", "length", "source_file")
    assert both.count() == 600 and both.select("source_file").distinct().count() == 3 and both.select("seq_id").distinct().count() == 1
    with pytest.raises(Exception, match="no FASTA file"):
        spark.read.format("fasta").load(str(tmp_path / "missing*")).collect()
    one = readers.read_fasta_compressed(spark, str(tmp_path / "blocks.bgz"), partition_bytes=2000)
    two = readers.read_fasta(spark, str(tmp_path / "plain.fa"))
    assert sorted(one.select("seq_id", "seq", "length").collect()) == sorted(two.select("seq_id", "seq", "length").collect())


@settings(max_examples=300, deadline=None)
@given(st.text("\n>a", max_size=40), st.lists(st.integers(1, 7), min_size=1, max_size=4), st.integers(1, 9))
def test_every_piece_has_one_owner(text, reads, size):
    data, out = text.encode(), []
    for start in range(0, max(1, len(data)), size):
        def chunks(at=start, end=min(len(data), start + size)):
            k = 0
            while at < len(data):
                n = min(reads[k % len(reads)], end - at) if at < end else reads[k % len(reads)]
                yield data[at : at + n], at < end
                at, k = at + n, k + 1

        out += fasta_source.owned(chunks(), start == 0)
    assert out == [p if i == 0 else b">" + p for i, p in enumerate(data.split(b"\n>"))]


def test_fasta_stream(spark, tmp_path):
    fasta_source.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\nACGT\n>b\nGG")

    def run():
        stream = spark.readStream.format("fasta").load(str(tmp_path / "in")).select("seq_id", "seq")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a", "ACGT"), ("b", "GG")]
    (tmp_path / "in" / "b.fa.gz").write_bytes(gzip.compress(b">c\nTT\n"))
    assert run() == run() == [("a", "ACGT"), ("b", "GG"), ("c", "TT")]


def test_motifs_with_letters_and_written_folders(spark):
    seqs = sequences(spark, [("s", "ACGTACGTAC" * 700), ("t", "GG")])
    motifs = spark.createDataFrame([("s", 1, 4), ("s", 6999, 7000), ("s", 3, 6900), ("u", 1, 2), ("t", 1, 2)], "seq_id string, start_pos long, end_pos long")
    got = {(r.seq_id, r.start_pos): r.sequence for r in writers.with_sequence(motifs, seqs).collect()}
    assert got == {("s", 1): "ACGT", ("s", 6999): "AC", ("s", 3): ("ACGTACGTAC" * 700)[2:6900], ("u", 1): None, ("t", 1): "GG"}
