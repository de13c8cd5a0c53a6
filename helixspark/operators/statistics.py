"""Statistics of motif tables. ``lengths`` is a table (seq_id, seq_length); main motifs are all but hybrids and clusters."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import taxonomy
from ..sources.shared import written
from .intervals import DERIVED, coverage, stretched
from .tiling import cut

try:  # a digest of a few letters takes about half the time without the library behind hashlib
    from _md5 import md5
except ImportError:
    from hashlib import md5


def main_motifs(motifs: DataFrame) -> DataFrame:
    return motifs.filter(~F.col("class").isin(*DERIVED))


def class_counts(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("class").agg(F.count("*").alias("n"))


def sequence_summary(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("seq_id").agg(F.count("*").alias("n_motifs"), F.count_distinct("class").alias("n_classes"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum("length").alias("sum_length"), F.min("start_pos").alias("first_start"), F.max("end_pos").alias("last_end"))


def diversity(motifs: DataFrame) -> DataFrame:
    """Simpson index, effective number of classes and the largest class's share, per sequence."""
    shares = motifs.groupBy("seq_id", "class").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("seq_id")))
    return shares.groupBy("seq_id").agg(F.round(1 - F.sum(F.col("p") * F.col("p")), 4).alias("simpson"), F.round(1 / F.sum(F.col("p") * F.col("p")), 4).alias("effective_classes"), F.round(F.max("p"), 4).alias("dominance"))


def gap_statistics(motifs: DataFrame) -> DataFrame:
    """Mean and coefficient of variation of the distances from an end to the next start, per sequence."""
    gap = F.lead("start_pos").over(Window.partitionBy("seq_id").orderBy("start_pos", "end_pos")) - F.col("end_pos")
    return motifs.select("seq_id", gap.alias("gap")).filter("gap is not null").groupBy("seq_id").agg(F.round(F.avg("gap"), 2).alias("mean_gap"), F.round(F.stddev_pop("gap") / F.abs(F.nullif(F.avg("gap"), F.lit(0.0))), 4).alias("cv_gap"))


def motif_statistics(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """The main table of a sequence: counts, coverage, density, occupancy, intensity, gaps, diversity."""
    main = main_motifs(motifs)
    top = F.when(F.max("score") > 0, F.max("score")).otherwise(1.0)
    counts = main.groupBy("seq_id").agg(
        F.count("*").alias("total_motifs"), F.count_distinct("class").alias("classes_detected"), F.count_distinct("subclass").alias("subclasses_detected"), F.sum("length").alias("raw_occupancy_bp"), F.sum(F.col("score") * F.col("length")).alias("_sl"), top.alias("_top"),
        F.round(F.avg("score"), 3).alias("score_mean"), F.round(F.stddev_pop("score"), 3).alias("score_std"), F.round(F.min("score"), 3).alias("score_min"), F.round(F.max("score"), 3).alias("score_max"),
        F.round(F.avg("length"), 1).alias("length_mean"), F.round(F.stddev_pop("length"), 1).alias("length_std"), F.min("length").alias("length_min"), F.max("length").alias("length_max"),
    )
    derived = motifs.groupBy("seq_id").agg(F.count("*").alias("total_motifs_all"), F.count_if(F.col("class") == "Hybrid").alias("hybrid_count"), F.count_if(F.col("class") == "Non-B_DNA_Clusters").alias("cluster_count"))
    out = lengths.join(derived, "seq_id").join(counts, "seq_id", "left").join(coverage(main, ["seq_id"]), "seq_id", "left").join(diversity(main), "seq_id", "left").join(gap_statistics(main), "seq_id", "left")
    g = F.col("seq_length")
    return out.select(
        "seq_id", F.coalesce("total_motifs", F.lit(0)).alias("total_motifs"), "total_motifs_all", "hybrid_count", "cluster_count", "classes_detected", "subclasses_detected", "covered_bp",
        F.round(F.col("covered_bp") * 100.0 / g, 2).alias("coverage_pct"), F.round(F.col("total_motifs") * 1000.0 / g, 2).alias("density"), "raw_occupancy_bp", F.round(F.col("raw_occupancy_bp") / g, 6).alias("normalized_occupancy"),
        F.round(F.col("raw_occupancy_bp") / F.col("covered_bp"), 4).alias("mean_overlap_depth"), F.round(F.col("_sl") / g, 6).alias("structural_intensity"), F.round(F.col("_sl") / F.col("_top") / g, 6).alias("weighted_structural_coverage"),
        "mean_gap", "cv_gap", "simpson", "effective_classes", F.round(F.col("covered_bp") / g * F.col("effective_classes"), 4).alias("sci"), "dominance",
        "score_mean", "score_std", "score_min", "score_max", "length_mean", "length_std", "length_min", "length_max",
    )


def class_coverage(motifs: DataFrame, lengths: DataFrame, by: str = "class") -> DataFrame:
    """Covered bases of each class (or subclass) of a sequence: share of the sequence, and of all covered bases."""
    main = main_motifs(motifs)
    each, total = coverage(main, ["seq_id", by]), coverage(main, ["seq_id"]).withColumnRenamed("covered_bp", "_all")
    return each.join(lengths, "seq_id").join(total, "seq_id").select("seq_id", by, "covered_bp", F.round(F.col("covered_bp") * 100.0 / F.col("seq_length"), 4).alias("coverage_pct"), F.round(F.col("covered_bp") / F.col("_all"), 4).alias("contribution"))


def local_maxima(motifs: DataFrame, reach: int = 1000) -> DataFrame:
    """Most motifs, most classes and greatest score sum that start within ``reach`` bases of a start, and mean overlap of neighbours."""
    ahead = Window.partitionBy("seq_id", "_part").orderBy("start_pos").rangeBetween(0, reach - 1)
    after = Window.partitionBy("seq_id").orderBy("start_pos", "end_pos", "class", "score")
    shared = F.greatest(F.lit(0), F.least("end_pos", F.lead("end_pos").over(after)) - F.lead("start_pos").over(after) + 1)
    placed = stretched(main_motifs(motifs).select("seq_id", "start_pos", "class", "score"), "start_pos", 0, reach)
    rows = placed.select("seq_id", "_own", F.count("*").over(ahead).alias("n"), F.size(F.collect_set("class").over(ahead)).alias("c"), F.sum("score").over(ahead).alias("s")).filter("_own")
    most = rows.groupBy("seq_id").agg(F.max("n").alias("max_local_motifs"), F.max("c").alias("max_local_classes"), F.round(F.max("s"), 3).alias("max_cluster_score"))
    neighbours = main_motifs(motifs).select("seq_id", (shared / F.least("length", F.lead("length").over(after))).alias("o"))
    return most.join(neighbours.groupBy("seq_id").agg(F.round(F.avg("o"), 4).alias("mean_neighbour_overlap")), "seq_id")


def detection_report(motifs: DataFrame) -> DataFrame:
    """Every class and subclass of the taxonomy with its number of rows and whether there are any."""
    n = motifs.groupBy("class", "subclass").agg(F.count("*").alias("n"))
    return taxonomy(motifs.sparkSession).join(n, ["class", "subclass"], "left").select("class_id", "class", "subclass", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("detected"))


def genomic_density(motifs: DataFrame, lengths: DataFrame, by: str = "class") -> DataFrame:
    """Per cent of a sequence that each class covers, at most 100, and the same for all together ("Overall")."""
    main = main_motifs(motifs)
    each = coverage(main, ["seq_id", by]).unionByName(coverage(main, ["seq_id"]).withColumn(by, F.lit("Overall")))
    return each.join(lengths, "seq_id").select("seq_id", by, F.round(F.least(F.lit(100.0), F.col("covered_bp") * 100.0 / F.col("seq_length")), 4).alias("density_pct"))


def positional_density(motifs: DataFrame, lengths: DataFrame, unit: int = 1000) -> DataFrame:
    """Motifs per ``unit`` bases by class, and over all classes ("Overall"); hybrids and clusters count."""
    n = motifs.rollup("seq_id", "class").agg(F.count("*").alias("n")).filter("seq_id is not null")
    return n.join(lengths, "seq_id").select("seq_id", F.coalesce("class", F.lit("Overall")).alias("class"), F.round(F.col("n") * float(unit) / F.col("seq_length"), 6).alias("per_unit"))


def five_numbers(motifs: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, greatest, mean, median and sample deviation of a column for each group."""
    return motifs.groupBy(by).agg(F.count("*").alias("n"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"), F.round(F.avg(value), 4).alias("mean"), F.round(F.median(value), 4).alias("median"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("std"))


def class_sequence_coverage(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per cent of all sequences (those without motifs too) that have a class."""
    total = lengths.count()
    return motifs.groupBy("class").agg(F.count_distinct("seq_id").alias("n")).select("class", F.round(F.col("n") * 100.0 / total, 4).alias("pct_sequences"))


def density_per_sequence(motifs: DataFrame, lengths: DataFrame) -> DataFrame:
    n = motifs.groupBy("seq_id").agg(F.count("*").alias("n"))
    return lengths.join(n, "seq_id", "left").select("seq_id", F.round(F.coalesce("n", F.lit(0)) * 1000.0 / F.col("seq_length"), 6).alias("per_kb"))


def positional_conservation(motifs: DataFrame, bin_size: int = 1000) -> DataFrame:
    """How many sequences have a motif in each bin of positions."""
    bins = F.explode(F.sequence(F.floor(F.col("start_pos") / bin_size), F.floor(F.col("end_pos") / bin_size)))
    return motifs.select("seq_id", bins.alias("bin")).groupBy("bin").agg(F.count_distinct("seq_id").alias("n_sequences"))


def positional_depth(motifs: DataFrame, keys: list[str]) -> DataFrame:
    """Depth of motifs as steps: (keys, pos, depth) where the depth changes. A sweep over starts and ends, not over positions."""
    steps = motifs.select(*keys, F.explode(F.array(F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end_pos") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("s"))
    summed = steps.groupBy(*keys, F.col("s.pos").alias("pos")).agg(F.sum("s.d").alias("d"))
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return summed.withColumn("depth", F.sum("d").over(run)).filter("d <> 0").drop("d")


def group_statistics(motifs: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean length and score, motifs per kb and coverage of each group; keys hold seq_id."""
    each = motifs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("length"), 4).alias("mean_length"), F.round(F.avg("score"), 4).alias("mean_score"))
    return each.join(coverage(motifs, keys), keys).join(lengths, "seq_id").select(*keys, "n", "mean_length", "mean_score", F.round(F.col("n") * 1000.0 / F.col("seq_length"), 6).alias("per_kb"), F.round(F.col("covered_bp") * 100.0 / F.col("seq_length"), 4).alias("coverage_pct"))


def class_pivot(motifs: DataFrame, classes: list[str], value: Column | None = None) -> DataFrame:
    """Sequences against classes: counts, or an aggregate given."""
    return motifs.groupBy("seq_id").pivot("class", classes).agg(F.count(F.lit(1)) if value is None else value).na.fill(0)


def start_frequencies(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("start_pos").agg(F.count("*").alias("n"))


def file_types(seqs: DataFrame) -> DataFrame:
    """single, multi_equal or multi for each source_file of (source_file, seq)."""
    n = seqs.groupBy("source_file").agg(F.count("*").alias("n"), F.count_distinct(F.length("seq")).alias("k"))
    return n.select("source_file", F.when(F.col("n") == 1, "single").when(F.col("k") == 1, "multi_equal").otherwise("multi").alias("file_type"), "n")


def feature_counts(features: DataFrame, motifs: DataFrame) -> DataFrame:
    """Motifs that start inside features (seq_id, type, start from 0, end), per type, and per kb of features."""
    size = features.groupBy("type").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))
    width = 1000
    f = features.select("seq_id", "type", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin"))
    m = motifs.select("seq_id", (F.col("start_pos") - 1).alias("at"), F.floor((F.col("start_pos") - 1) / width).alias("_bin"))
    n = f.join(m, ["seq_id", "_bin"]).filter("at >= start and at < end").groupBy("type").agg(F.count("*").alias("n"))
    return size.join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) * 1000.0 / F.col("bp"), 6).alias("per_kb"))


def gc_of_set(seqs: DataFrame) -> DataFrame:
    """Length-weighted GC per cent of a set, without ambiguous bases, and over all letters."""
    from ..functions.sequence import count_of

    gc, known, n = count_of(F.col("seq"), "GC"), count_of(F.col("seq"), "ACGT"), F.length("seq")
    return seqs.agg(F.count("*").alias("sequences"), F.sum(n).cast("long").alias("total_bp"), F.round(F.sum(gc) * 100.0 / F.sum(known), 6).alias("gc_pct"), F.round(F.sum(gc) * 100.0 / F.sum(n), 6).alias("gc_of_total_pct"))


def enrichment(seqs: DataFrame, classes: list[str] | None = None, rounds: int = 100, seed: int = 1) -> DataFrame:
    """Counts of each class against ``rounds`` shuffles of the sequences: fold, share of shuffles with as many, mean, deviation.

    Every shuffle of a sequence is a row of its own, so the whole background is one distributed scan.
    """
    from ..plans.scan import detect

    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    turns = seqs.select("seq_id", letters.alias("letters"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    # a random order: letters by a hash of seed, round, name and place
    mixed = F.transform(F.array_sort(F.transform("letters", lambda c, i: F.struct(F.xxhash64(F.lit(seed), "r", "seq_id", i).alias("h"), c.alias("c")))), lambda x: x["c"])
    background = turns.select(F.concat_ws("\t", F.col("r").cast("string"), "seq_id").alias("seq_id"), F.array_join(mixed, "").alias("seq"))
    observed = detect(seqs, classes).groupBy("class").agg(F.count("*").alias("observed"))
    per_round = detect(background, classes).groupBy(F.split("seq_id", "\t")[0].alias("round"), "class").agg(F.count("*").alias("n"))
    joined = observed.join(per_round, "class", "left").groupBy("class", "observed").agg((F.coalesce(F.sum("n"), F.lit(0)) / rounds).alias("mean"), (F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)) / rounds).alias("_sq"), (F.count_if(F.col("n") >= F.col("observed")) / rounds).alias("p_value"))
    return joined.select("class", "observed", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("mean") * F.col("mean"))).alias("std"), F.when(F.col("mean") > 0, F.col("observed") / F.col("mean")).otherwise(F.lit(float("inf"))).alias("fold"), F.when(F.col("mean") > 0, F.col("p_value")).otherwise(1.0).alias("p_value"))


#: Letters of a sequence that is dealt in one piece: 16 bytes of its digest stand beside a letter.
WHOLE = 1 << 20


#: Digests that are made together, so that numpy's arrays stay in a core's cache.
_TOGETHER = 1 << 14
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_of_words(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """MD5 of n messages of one block, column by column: words[k] is the k-th word of each, 0 where there is none."""
    begin = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in begin)
    f = np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        word = words.get((i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16)
        if word is not None:
            f += word
        turn = _TURNS[kind][i % 4]
        np.left_shift(f, turn, out=a)
        np.right_shift(f, 32 - turn, out=f)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), begin, strict=True)], axis=1).astype("<u4", copy=False)


def _least(digits: int) -> int:
    return 10 ** (digits - 1) if digits > 1 else 0


@functools.lru_cache(96)
def _written_places(digits: int, block: int, shift: int) -> list[np.ndarray]:
    """The words of a block of places as decimal numbers of so many digits, ``shift`` bytes behind a word's begin."""
    first = _least(digits) + block * _TOGETHER
    place = np.arange(first, first + _TOGETHER, dtype=np.uint64)
    words = [np.zeros(_TOGETHER, np.uint32) for _ in range((shift + digits + 3) // 4)]
    for j in range(shift + digits - 1, shift - 1, -1):
        place, digit = np.divmod(place, 10)
        words[j // 4] += (digit + 48).astype(np.uint32) << np.uint32(8 * (j % 4))
    return words


def _digests(heads: list[tuple[bytes, int, int]]) -> np.ndarray:
    """MD5 of each head and a place behind it, for its n places from ``at`` on, (head, at, n) by (head, at, n): two numbers each."""
    out = np.empty((sum(n for *_, n in heads), 4), "<u4")
    pieces: list[tuple[bytes, int, int, int]] = []  # head, first place, places, digits
    held = done = 0

    def make() -> None:
        words: dict[int, np.ndarray] = {}
        at = 0
        for head, first, n, digits in pieces:
            size = len(head) + digits
            message = np.frombuffer((head + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
            for k in np.flatnonzero(message).tolist():
                words.setdefault(k, np.zeros(held, np.uint32))[at : at + n] = message[k]
            block, skip = divmod(first - _least(digits), _TOGETHER)
            for k, part in enumerate(_written_places(digits, block, len(head) % 4), len(head) // 4):
                words.setdefault(k, np.zeros(held, np.uint32))[at : at + n] += part[skip : skip + n]
            at += n
        out[done : done + held] = _md5_of_words(words, held)

    for head, at, n in heads:
        end = at + n
        if len(head) + len(str(end)) > 55:  # more than one block
            if held:
                make()
                done, pieces, held = done + held, [], 0
            out[done : done + n] = np.frombuffer(b"".join([md5(head + b"%d" % i).digest() for i in range(at, end)]), "<u4").reshape(-1, 4)
            done += n
            continue
        while at < end:
            digits = len(str(at))
            to = min(end, 10**digits, at + _TOGETHER - held, at + _TOGETHER - (at - _least(digits)) % _TOGETHER)
            pieces.append((head, at, to - at, digits))
            held, at = held + to - at, to
            if held == _TOGETHER:
                make()
                done, pieces, held = done + held, [], 0
    if held:
        make()
    return out.reshape(-1).view(">u8").reshape(-1, 2)


def _head(name: str | None, turn: int, seed: int) -> bytes:
    return ":".join([str(seed), str(turn), *([] if name is None else [name]), ""]).encode()


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _in_order(keys: np.ndarray, letters: np.ndarray) -> str:
    first = keys[:, 0].astype(np.uint64)
    order = np.argsort(first)
    if len(first) > 1 and (np.diff(first[order]) == 0).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))
    return letters[order].astype("<u4").tobytes().decode("utf-32-le")


def shuffled_letters(seqs: DataFrame, rounds: int, seed: int = 1, size: int = 4096, whole: int = WHOLE) -> DataFrame:
    """(seq_id, round, seq): each sequence's letters in a random order, ``rounds`` times, the same for a seed every time.

    A letter's place is decided by a hash of (seed, round, sequence, place in the sequence): a generator that counts, so
    parts of a sequence are dealt on their own. A sequence of up to ``whole`` letters is dealt where it stands, and nothing is
    shuffled. Longer ones are cut into tiles of ``whole`` letters (of ``size``, if that is more); a tile packs its letters and digests
    for as many buckets as the sequence has tiles, by the digest's first part; each bucket is sorted by the whole of it, and the
    buckets follow each other: no task holds the digests of a longer sequence.
    """
    part = max(size, whole)
    named = seqs.select(F.col("seq_id").cast("string"), "seq")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            keys = _digests([(_head(name, turn, seed), 0, len(letters)) for name, letters in rows for turn in range(rounds)])
            mixed, at = [], 0
            for _, letters in rows:
                for _ in range(rounds):
                    mixed.append(_in_order(keys[at : at + len(letters)], letters))
                    at += len(letters)
            return pa.RecordBatch.from_arrays([pa.array([name for name, _ in rows for _ in range(rounds)], pa.string()), pa.array([*range(rounds)] * len(rows), pa.int32()), pa.array(mixed, pa.string())], names=["seq_id", "round", "seq"])

        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                rows.append((batch.column(0)[k].as_py(), _letters(batch.column(1)[k].as_py())))
                held += len(rows[-1][1])
                if held * rounds >= 4 * _TOGETHER:  # some rows, or one longer sequence
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                letters, buckets = _letters(row["seq"]), -(-row["n"] // part)
                for turn in range(rounds):
                    keys = _digests([(_head(row["seq_id"], turn, seed), row["at"], len(letters))])
                    to = ((keys[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    for b in np.unique(to).tolist():
                        mine = to == b
                        body = keys[mine].tobytes() + letters[mine].tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([row["seq_id"]], pa.string()), pa.array([turn], pa.int32()), pa.array([b], pa.int64()), pa.array([body], pa.binary())], names=["seq_id", "round", "b", "body"])

    def sort(rows: pa.Table) -> pa.Table:
        bodies = rows.column("body").to_pylist()
        counts = [len(x) // 20 for x in bodies]
        keys = np.concatenate([np.frombuffer(x, ">u8", 2 * n).reshape(-1, 2) for x, n in zip(bodies, counts, strict=True)])
        letters = np.concatenate([np.frombuffer(x, "<u4", n, 16 * n) for x, n in zip(bodies, counts, strict=True)])
        return rows.select(["seq_id", "round", "b"]).slice(0, 1).append_column("part", pa.array([_in_order(keys, letters)], pa.string()))

    n = F.length("seq")
    short = named.filter((n > 0) & (n <= whole)).mapInArrow(deal, "seq_id string, round int, seq string")
    packed = cut(named.filter(n > whole), part).select("seq_id", "n", "at", "seq").mapInArrow(pack, "seq_id string, round int, b long, body binary")
    parts = packed.groupBy("seq_id", "round", "b").applyInArrow(sort, "seq_id string, round int, b long, part string")
    return short.unionByName(parts.groupBy("seq_id", "round").agg(F.array_join(F.array_sort(F.collect_list(F.struct("b", "part")))["part"], "").alias("seq")))


def null_counts(seqs: DataFrame, classes: list[str] | None = None, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(seq_id, class, round, n): hits of each class in shuffled sequences, the background of ``with_null_model``; rounds without hits have no row."""
    from ..plans.scan import detect

    mixed = written(shuffled_letters(seqs, rounds, seed).select(F.concat_ws("\t", F.col("round").cast("string"), "seq_id").alias("seq_id"), "seq"))  # each detector reads it
    part = F.split("seq_id", "\t", 2)
    return detect(mixed, classes).groupBy(part[1].alias("seq_id"), "class", part[0].cast("int").alias("round")).agg(F.count("*").alias("n"))


def with_null_model(observed: DataFrame, background: DataFrame, rounds: int) -> DataFrame:
    """observed (seq_id, class, observed) with expected, std, fold, ratio, z_score and p_value against a background (seq_id, class, round, n) of so many rounds.

    expected and std are over all rounds, those without a row as 0. fold is observed over expected (null if that is 0), ratio
    (observed + 1) / (expected + 1), p_value (rounds with as many + 1) / (rounds + 1).
    """
    both = background.join(observed, ["seq_id", "class"], "right")
    sums = both.groupBy("seq_id", "class", "observed").agg((F.coalesce(F.sum("n"), F.lit(0)) / rounds).alias("e"), (F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)) / rounds).alias("sq"), F.count_if((F.col("n") >= F.col("observed")) & (F.col("observed") > 0)).alias("as_many"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("e") * F.col("e")))
    return sums.select(
        "seq_id", "class", "observed", F.round("e", 6).alias("expected"), F.round(std, 6).alias("std"), F.round(F.when(F.col("e") > 0, F.col("observed") / F.col("e")), 6).alias("fold"), F.round((F.col("observed") + 1) / (F.col("e") + 1), 6).alias("ratio"),
        F.round(F.when(std > 0, (F.col("observed") - F.col("e")) / std), 6).alias("z_score"), F.round(F.when(F.col("observed") > 0, (F.col("as_many") + 1) / F.lit(rounds + 1)).otherwise(1.0), 6).alias("p_value"),
    )
