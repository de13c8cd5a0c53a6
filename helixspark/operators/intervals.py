"""Interval operators over tables of (seq_id, start_pos, end_pos, ...), places from 1 and inclusive unless said otherwise."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tiling import cut

DERIVED = ("Hybrid", "Non-B_DNA_Clusters")


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """Adds ``island``: rows whose half-open intervals overlap, touch, or are at most ``gap`` apart have the same number in their keys."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col(start) > reach + gap, 1).otherwise(0)
    return df.withColumn("_first", F.coalesce(first, F.lit(1))).withColumn("island", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1_000_000, sums: tuple[str, ...] = ()) -> DataFrame:
    """The union of the intervals: (keys, start, end, sums of columns over its intervals).

    Stretches of ``width`` bases are merged first, each by a task of its own, so that only their unions meet for one key:
    a chromosome with most of the rows doesn't end up in one task.
    """
    added = [F.sum(c).alias(c) for c in sums]
    local = islands(df.withColumn("_part", F.floor(F.col(start) / width)), [*keys, "_part"], start, end)
    parts = local.groupBy(*keys, "_part", "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), *added).drop("island", "_part")
    return islands(parts, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *added).drop("island")


def segmented(df: DataFrame, keys: list[str], start: Column, end: Column, gap: float = 0, width: int = 1_000_000, grain: int = 1000) -> DataFrame:
    """Adds ``_segment``: rows of different segments of a key neither overlap nor touch, nor lie ``gap`` or less apart.

    The carry of a scan over places, without the scan: every stretch of ``grain`` bases gives its least start and greatest
    end (partial sums, one row a stretch), and running maxima of these few rows tell which stretches nothing reaches into.
    The first of those in every ``width`` bases begins a segment. So all that depends on overlaps can run segment by
    segment, in as many tasks as there are; an island that crosses an edge stays whole. df is read twice.
    """
    fine = F.floor(start / grain)
    sums = df.groupBy(*keys, fine.alias("_fine")).agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_fine")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = sums.withColumn("_clean", F.coalesce(F.col("_s") > reach + gap, F.lit(True))).withColumn("_coarse", F.floor(F.col("_fine") * grain / width))
    first = F.col("_clean") & (F.row_number().over(Window.partitionBy(*keys, "_coarse", "_clean").orderBy("_fine")) == 1)
    found = flagged.withColumn("_first", F.when(first, F.col("_fine"))).withColumn("_segment", F.max("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("_fine", fine).join(found.select(*keys, "_fine", "_segment"), [*keys, "_fine"]).drop("_fine")


def coverage(df: DataFrame, keys: list[str], cap: Column | None = None) -> DataFrame:
    """(keys, covered_bp): bases that at least one row covers; ``cap`` clips ends."""
    end = F.col("end_pos") if cap is None else F.least(F.col("end_pos"), cap)
    half = df.select(*keys, (F.col("start_pos") - 1).alias("start"), end.alias("end")).filter("end > start")
    return merged(half, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered_bp"))


def coverage_raw(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """As coverage, of start_pos to end_pos taken as half open: a base less for each island."""
    half = df.select(*keys, F.col("start_pos").alias("start"), F.least(F.col("end_pos"), F.lit(cap)).alias("end")).filter("end > start")
    return merged(half, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered_bp"))


def _chosen(df: DataFrame, keys: list[str], order: list[Column], start: Column, end: Column, choose: Callable[[list[int], list[int], list[int], np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    """The rows that ``choose`` keeps of each island of overlapping [start, end) in its keys.

    One shuffle by the keys and a sort by place; then batches stream by, cut into islands by running maxima, and only an
    island that is still open waits for the next batch. A row alone in its island stays; choose(rows of an island in order
    of place, starts, ends, every row's rank in the given order, its first order value) gives the rows to keep of the others.
    """
    extra = ["_s", "_e", *(f"_o{i}" for i in range(len(order)))]
    named = df.select("*", start.cast("long").alias("_s"), end.cast("long").alias("_e"), *(c.cast("double").alias(f"_o{i}") for i, c in enumerate(order)))
    width = len(df.columns)

    def resolve(rows: pa.Table, closed: bool) -> tuple[pa.Table, pa.Table]:
        """(what stays of the islands that are over, the rows of the one that may go on)."""
        n = rows.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            c = pc.fill_null(rows.column(k).combine_chunks().cast(pa.string()), "\0")
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(new)
        s, e = (rows.column(c).to_numpy() for c in ("_s", "_e"))
        far = (int(e.max()) - int(s.min()) + 1) * group  # keys far apart, so that one running maximum serves all
        new[1:] |= (s + far)[1:] >= np.maximum.accumulate(e + far)[:-1]
        first = np.flatnonzero(new)
        until = n if closed else int(first[-1])
        size = np.diff(np.append(first, n))
        keep = np.zeros(n, bool)
        keep[first[size == 1]] = True
        many = np.flatnonzero((size > 1) & (first < until))
        if len(many):
            rank = np.empty(n, np.int64)
            rank[np.lexsort((e, s, *(rows.column(c).to_numpy() for c in reversed(extra[2:]))))] = np.arange(n)
            starts, ends, value = s.tolist(), e.tolist(), rows.column("_o0").to_numpy()
            for i in many.tolist():
                keep[choose(list(range(first[i], first[i] + size[i])), starts, ends, rank, value)] = True
        return rows.slice(0, until).filter(pa.array(keep[:until])), rows.slice(until)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                done, open_rows = resolve(rows if open_rows is None else pa.concat_tables([open_rows, rows]), False)
                yield from done.select(range(width)).combine_chunks().to_batches()
        if open_rows is not None and open_rows.num_rows:
            yield from resolve(open_rows, True)[0].select(range(width)).combine_chunks().to_batches()

    # the order of equal places doesn't matter to islands, but makes the result the same every time: rows of equal order by what else they hold
    rest = [f.name for f in df.schema.fields if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    placed = named.repartition(*keys).sortWithinPartitions(*keys, *extra, *rest)
    return placed.mapInArrow(run, df.schema)


def _best_first(island: list[int], starts: list[int], ends: list[int], rank: np.ndarray, value: np.ndarray) -> list[int]:
    kept: list[int] = []
    begin: list[int] = []
    stop: list[int] = []
    for i in sorted(island, key=rank.__getitem__):
        at = bisect.bisect_left(begin, ends[i])
        if at == 0 or stop[at - 1] <= starts[i]:
            kept.append(i)
            at = bisect.bisect_left(begin, starts[i])
            begin.insert(at, starts[i])
            stop.insert(at, ends[i])
    return kept


def select_greedy(df: DataFrame, keys: list[str], order: list[Column], start: Column, end: Column, spread: bool = False, width: int = 1_000_000) -> DataFrame:
    """Takes rows in the order given and keeps each that overlaps none kept before ([start, end) in its keys).

    No choice reaches across an island of overlapping rows. A task holds a batch and one island, never all rows of its keys.
    All rows of one key value stream through one task, or with ``spread`` those of one segment of about ``width`` bases;
    spread reads df twice, so give it a written table.
    """
    if not spread:
        return _chosen(df, keys, order, start, end, _best_first)
    return _chosen(segmented(df, keys, start, end, width=width), [*keys, "_segment"], order, start, end, _best_first).select(df.columns)


def remove_overlaps(motifs: DataFrame, spread: bool = False) -> DataFrame:
    """One class and subclass of a sequence at a time: best score, then longest, first; the rest must not share a base."""
    return select_greedy(motifs, ["seq_id", "class", "subclass"], [-F.col("score"), -F.col("length"), F.col("start_pos")], F.col("start_pos") - 1, F.col("end_pos"), spread)


def resolve_cross_class(motifs: DataFrame, mode: str = "strict", spread: bool = False) -> DataFrame:
    """All classes of a sequence together; rows may share a border base. mode "hybrid" leaves hybrids and clusters alone."""
    free = motifs.filter(F.col("class").isin(*DERIVED)) if mode == "hybrid" else motifs.limit(0)
    rest = motifs.filter(~F.col("class").isin(*DERIVED)) if mode == "hybrid" else motifs
    return select_greedy(rest, ["seq_id"], [-F.col("score"), -(F.col("end_pos") - F.col("start_pos")), F.col("start_pos")], F.col("start_pos"), F.col("end_pos"), spread).unionByName(free)


def merge_results(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several detectors, each row tagged, resolved against each other."""
    tagged = [df.withColumn("detector", F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return resolve_cross_class(out)


def dedup_exact(motifs: DataFrame) -> DataFrame:
    """One row, of the best score, for each sequence, class, subclass, start and end."""
    return motifs.groupBy("seq_id", "class", "subclass", "start_pos", "end_pos").agg(F.max("score").alias("score"))


def dedup_near(motifs: DataFrame, share: float = 0.5, reach: int = 2000) -> DataFrame:
    """One row of those that chunks report twice: rows of a class and subclass that share ``share`` of the shorter one.

    Rows come in order of start and end. A row that shares enough with a kept one that starts at most ``reach`` before it is
    a duplicate of the best-scored of those (the latest, if scores are equal), and takes its place if its own score is higher.
    A row is only compared with kept ones that it may share a base with, and a task holds those and a batch.
    """

    keys = ["seq_id", "class", "subclass"]
    worse = -F.coalesce("score", F.lit(0.0)).cast("double")
    named = motifs.select("*", (F.col("start_pos") - 1).cast("long").alias("_s"), F.col("end_pos").cast("long").alias("_e"), worse.alias("_w"))
    width = len(motifs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple[int, int, float, int]] = []  # kept rows that a later one may be a duplicate of: start, end, -score, number
        waits: dict[int, pa.RecordBatch] = {}  # those rows, by number, if they are of an earlier batch
        last, far, at = None, 0, 0
        for batch in batches:
            found: list[int] = []
            for i, (*key, s, e, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*keys, "_s", "_e", "_w")), strict=True), at):
                if key != last or s >= far:  # another island
                    found += [k[3] for k in near]
                    last, far, near = key, e, []
                far = max(far, e)
                found += [k[3] for k in near if k[0] < s - reach or k[1] < s]  # rows come by start: nothing later shares a base with these
                near = [k for k in near if k[0] >= s - reach and k[1] >= s]
                match = -1
                for m in range(len(near) - 1, -1, -1):
                    k = near[m]
                    if min(e, k[1]) - max(s, k[0]) >= share * min(e - s, k[1] - k[0]) and (match < 0 or k[2] < near[match][2]):
                        match = m
                if match < 0:
                    near.append((s, e, w, i))
                elif w < near[match][2]:
                    near[match] = (s, e, w, i)
            yield from (waits[i] for i in found if i < at)
            yield batch.select(range(width)).take(pa.array(sorted(i - at for i in found if i >= at), pa.int64()))
            own = batch.select(range(width))
            # a row that waits is copied, so that its batch can go
            waits = {k[3]: waits[k[3]] if k[3] < at else own.take(pa.array([k[3] - at])) for k in near}
            at += batch.num_rows
        yield from (waits[k[3]] for k in near)

    rest = [f.name for f in motifs.schema.fields if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    return named.repartition(*keys).sortWithinPartitions(*keys, "_s", "_e", "_w", *rest).mapInArrow(run, motifs.schema)


def overlap_fraction(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared bases over the shorter length."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    return shared / F.least(e1 - s1 + 1, e2 - s2 + 1)


def overlapping_pairs(motifs: DataFrame, columns: list[str], reach: int = 0, width: int = 1000) -> DataFrame:
    """Pairs (columns with suffixes 1 and 2) of a sequence whose inclusive intervals overlap or are at most ``reach`` apart.

    Each row goes to every bin that it touches; pairs meet in a bin and are taken where the later of their starts lies, so
    once. Both sides are shuffled by sequence and bin; a crowded bin is a skewed partition that can be split. The first of
    a pair is the one with the smaller (start, end, id).
    """
    base = motifs.select("seq_id", "start_pos", "end_pos", *[c for c in columns if c not in ("seq_id", "start_pos", "end_pos")]).withColumn("_id", F.monotonically_increasing_id() if "event_id" not in columns else F.col("event_id"))
    binned = base.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / width), F.floor((F.col("end_pos") - 1 + reach) / width))))
    a, b = (binned.select("seq_id", "_bin", *(F.col(c).alias(f"{c}{k}") for c in base.columns if c != "seq_id")) for k in (1, 2))
    first = (F.col("start_pos1") < F.col("start_pos2")) | ((F.col("start_pos1") == F.col("start_pos2")) & ((F.col("end_pos1") < F.col("end_pos2")) | ((F.col("end_pos1") == F.col("end_pos2")) & (F.col("_id1") < F.col("_id2")))))
    near = (F.col("start_pos2") <= F.col("end_pos1") + reach) & (F.col("_bin") == F.floor((F.col("start_pos2") - 1) / width))
    return a.join(b, ["seq_id", "_bin"]).filter(first & near).drop("_bin", "_id1", "_id2")


def ahead(motifs: DataFrame, columns: list[str], kernel: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[dict[str, pa.Array]]], schema: str, reach: int = 0, stacked: bool = False) -> DataFrame:
    """What ``kernel`` gives of each stretch's motifs and those that start after them before they end (plus ``reach``), without a row for each pair.

    A motif goes to the stretch in which it starts, and to the one before it if a motif there may reach it; a stretch is as wide
    as the longest motif, or 1000 bases. kernel(rows by start, end, id; which of them are the stretch's own; the first
    and the last + 1 of those after each that start at most ``reach`` behind its end) gives columns of the schema without seq_id.

    ``stacked``: the kernel is called for a batch of whole stretches, whose places are moved far apart; each of its rows names
    in ``_row`` the motif whose sequence it is of, and start_pos and end_pos are moved back. A task holds a batch and one stretch.
    """
    far = int(motifs.agg(F.max(F.col("end_pos") - F.col("start_pos") + 1)).first()[0] or 1) + reach
    width = max(1000, far)
    place = F.col("start_pos") - 1
    named = motifs.select("seq_id", "start_pos", "end_pos", *[c for c in columns if c not in ("seq_id", "start_pos", "end_pos")], (F.col("event_id") if "event_id" in columns else F.monotonically_increasing_id()).alias("_id"))
    dealt = named.withColumn("_bin", F.explode(F.sequence(F.floor((place - far) / width), F.floor(place / width)))).withColumn("_own", F.col("_bin") == F.floor(place / width))

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(group))
        s, e, i = (rows.column(c).to_numpy() for c in ("start_pos", "end_pos", "_id"))
        order = np.lexsort((i, e, s))
        rows, s, e = rows.take(pa.array(order)), s[order], e[order]
        own = np.flatnonzero(rows.column("_own").to_numpy(zero_copy_only=False))
        first = own + 1
        for found in kernel(rows, own, first, np.maximum(first, np.searchsorted(s, e[own] + reach, "right"))):
            n = len(next(iter(found.values())))
            yield pa.RecordBatch.from_arrays([pa.array([rows.column("seq_id")[0].as_py()] * n, pa.string()), *found.values()], names=["seq_id", *found])

    def resolve(rows: pa.Table, closed: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        """(what the kernel gives of the stretches that are over, the rows of the one that may go on)."""
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in ("seq_id", "_bin"):
            c = pc.fill_null(rows.column(k).combine_chunks().cast(pa.string()), "\0")
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        until = rows.num_rows if closed else int(np.flatnonzero(new)[-1])
        rows, rest = rows.slice(0, until), rows.slice(until)
        if not until:
            return [], rest
        s, e = (rows.column(c).to_numpy() for c in ("start_pos", "end_pos"))
        moved = (np.cumsum(new[:until]) - 1) * (max(int(e.max()), int(s.max())) - min(int(s.min()), int(e.min())) + reach + 2)
        s, e = s + moved, e + moved
        own = np.flatnonzero(rows.column("_own").to_numpy(zero_copy_only=False))
        first = own + 1
        out = []
        apart = rows.set_column(rows.schema.get_field_index("start_pos"), "start_pos", pa.array(s)).set_column(rows.schema.get_field_index("end_pos"), "end_pos", pa.array(e))
        for found in kernel(apart, own, first, np.maximum(first, np.searchsorted(s, e[own] + reach, "right"))):
            row = found.pop("_row")
            found |= {c: pc.subtract(found[c], pa.array(moved).take(row)) for c in ("start_pos", "end_pos")}
            out.append(pa.RecordBatch.from_arrays([rows.column("seq_id").combine_chunks().take(row), *found.values()], names=["seq_id", *found]))
        return out, rest

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                done, open_rows = resolve(rows if open_rows is None else pa.concat_tables([open_rows, rows]), False)
                yield from done
        if open_rows is not None and open_rows.num_rows:
            yield from resolve(open_rows, True)[0]

    if stacked:
        return dealt.repartition("seq_id", "_bin").sortWithinPartitions("seq_id", "_bin", "start_pos", "end_pos", "_id").mapInArrow(stream, f"seq_id string, {schema}")
    return dealt.groupBy("seq_id", "_bin").applyInArrow(run, f"seq_id string, {schema}")


def class_counts_ahead(rows: pa.Table, by: str, first: np.ndarray, last: np.ndarray) -> tuple[list, np.ndarray]:
    """The groups, and how many rows [first, last) of each there are: differences of running counts."""
    code = rows.column(by).combine_chunks().dictionary_encode()
    names, index = code.dictionary.to_pylist(), pc.fill_null(code.indices, -1).to_numpy()
    counts = [np.concatenate([[0], np.cumsum(index == k)]) for k in range(len(names))]
    return names, np.stack([c[last] - c[first] for c in counts], axis=1) if names else np.zeros((len(first), 0), np.int64)


#: Pairs that a task expands at once.
_PAIRS = 1 << 20


def hybrids(motifs: DataFrame, least: float = 0.5, most: float = 0.99) -> DataFrame:
    """Unions of two motifs of different classes that share more than ``least`` and less than ``most`` of the shorter one.

    All pairs of one union begin in one stretch, which takes the first of them (by places, name and score); pairs are expanded
    some at a time and never shuffled. A task looks at many stretches at once.
    """

    def kernel(rows: pa.Table, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        s, e = (rows.column(c).to_numpy() for c in ("start_pos", "end_pos"))
        score = rows.column("score").to_numpy()
        names = sorted(set(rows.column("class").drop_null().to_pylist()))
        code = pc.fill_null(pc.index_in(rows.column("class").combine_chunks(), pa.array(names, pa.string())), -1).to_numpy()
        titles = [f"{x}_{y}_Overlap" for x in names for y in names]
        place = np.argsort(np.argsort(np.array(titles))) if titles else np.zeros(0, np.int64)
        words = pa.array(names, pa.string())
        opens = np.flatnonzero(np.append(True, s[own][1:] != s[own][:-1])) if len(own) else np.zeros(0, np.int64)
        run = np.concatenate([[0], np.cumsum(last - first)])
        at = 0
        while at < len(opens):  # whole starts: a union's pairs come together
            to = max(at + 1, int(np.searchsorted(run[opens], run[opens[at]] + _PAIRS)))
            lo, hi = int(opens[at]), int(opens[to]) if to < len(opens) else len(own)
            at, n = to, last[lo:hi] - first[lo:hi]
            a = np.repeat(own[lo:hi], n)
            b = np.repeat(first[lo:hi] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            part = np.maximum(0, np.minimum(e[a], e[b]) - s[b] + 1) / np.minimum(e[a] - s[a] + 1, e[b] - s[b] + 1)
            keep = (part > least) & (part < most) & (code[a] != code[b]) & (code[a] >= 0) & (code[b] >= 0)
            a, b = a[keep], b[keep]
            end, x, y = np.maximum(e[a], e[b]), np.minimum(code[a], code[b]), np.maximum(code[a], code[b])
            value = score[a] + score[b]
            union = (end * len(names) + x) * len(names) + y
            order = np.lexsort((-value, place[code[a] * len(names) + code[b]], e[b], s[b], e[a], union, s[a]))
            a, b, union = a[order], b[order], union[order]
            one = np.append(True, (union[1:] != union[:-1]) | (s[a][1:] != s[a][:-1]))[: len(a)]
            order, a, b = order[one], a[one], b[one]
            both = pa.array(np.stack([x[order], y[order]], axis=1).ravel())
            yield {
                "_row": pa.array(a), "subclass": pc.binary_join_element_wise(words.take(pa.array(code[a])), words.take(pa.array(code[b])), "Overlap", "_"), "start_pos": pa.array(s[a]), "end_pos": pa.array(end[order]),
                "sum": pa.array(value[order]), "component_classes": pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(a) + 1, 2), pa.int32()), words.take(both)),
            }

    typed = motifs.select("seq_id", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), "class", F.col("score").cast("double").alias("score"))
    found = ahead(typed, ["class", "score"], kernel, "subclass string, start_pos long, end_pos long, sum double, component_classes array<string>", stacked=True)
    return found.select("seq_id", F.lit("Hybrid").alias("class"), "subclass", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos") + 1).alias("length"), F.round(F.col("sum") / 2, 3).alias("score"), "component_classes")


def stretched(df: DataFrame, place: str, before: int, after: int, width: int = 1_000_000) -> DataFrame:
    """Rows by stretches of ``width`` bases (column ``_part``), each with the rows up to ``before`` and ``after`` bases around it (``_own`` false).

    A window over a range of places gives a stretch's own rows the same as over the whole sequence.
    """
    parts = F.sequence(F.floor((F.col(place) - after) / width), F.floor((F.col(place) + before) / width))
    return df.withColumn("_part", F.explode(parts)).withColumn("_own", F.col("_part") == F.floor(F.col(place) / width))


def clusters(motifs: DataFrame, reach: int = 300, motifs_least: int = 4, classes_least: int = 3) -> DataFrame:
    """Starts from which, within ``reach``, enough motifs of enough classes start. They aren't merged.

    The mean score is of whole millionths: a sum of doubles would depend on the order of rows that start together.
    """
    ahead = Window.partitionBy("seq_id", "_part").orderBy("start_pos").rangeBetween(0, reach)
    placed = stretched(motifs.select("seq_id", "start_pos", "end_pos", "class", "score"), "start_pos", 0, reach)
    counted = placed.select("seq_id", "start_pos", "_own", F.count("*").over(ahead).alias("motif_count"), F.sort_array(F.collect_set("class").over(ahead)).alias("component_classes"), F.max("end_pos").over(ahead).alias("end_pos"), (F.sum(F.round(F.col("score") * 1_000_000).cast("long")).over(ahead) / (1_000_000 * F.count("score").over(ahead))).alias("score"))
    found = counted.filter(F.col("_own") & (F.col("motif_count") >= motifs_least) & (F.size("component_classes") >= classes_least)).dropDuplicates(["seq_id", "start_pos"])
    return found.select("seq_id", F.lit("Non-B_DNA_Clusters").alias("class"), F.concat(F.lit("Mixed_Cluster_"), F.size("component_classes").cast("string"), F.lit("_classes")).alias("subclass"), "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos") + 1).alias("length"), F.round("score", 3).alias("score"), "component_classes", F.col("motif_count").cast("int").alias("motif_count"), F.size("component_classes").alias("class_diversity"))


def tiles(seqs: DataFrame, size: int = 50_000, overlap: int = 2000) -> DataFrame:
    """Overlapping tiles of each sequence; a row belongs to the tile whose core [core_start, core_end) its start lies in."""
    step = size - overlap
    found = cut(seqs, step, right=overlap, tail=True)
    return found.select("seq_id", F.floor(F.col("at") / step).alias("tile_id"), F.col("at").alias("tile_start"), (F.col("at") + F.length("seq")).cast("long").alias("tile_end"), F.col("at").alias("core_start"), (F.col("at") + F.col("hi")).alias("core_end"), F.col("seq").alias("tile_seq"))


def quality_issues(motifs: DataFrame, length: int, top: int | None = None) -> DataFrame:
    """(seq_id, issue, n): rows that break a rule, and pairs of a class that overlap by more than a border base.

    ``top``: only so many rows of the report, by sequence and issue.
    """
    checks = F.array(
        F.when(F.col("start_pos").isNull() | F.col("end_pos").isNull() | F.col("class").isNull(), "missing field"),
        F.when(F.col("start_pos") >= F.col("end_pos"), "start not before end"),
        F.when(F.col("length") != F.col("end_pos") - F.col("start_pos") + 1, "length differs"),
        F.when(F.col("end_pos") > length, "beyond the sequence"),
    )
    rows = motifs.select("seq_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("issue"))
    whole = motifs.filter("start_pos <= end_pos and class is not null")
    pairs = overlapping_pairs(whole, [c for c in ("class", "event_id") if c in motifs.columns]).filter("class1 = class2 and start_pos2 < end_pos1").select("seq_id", F.lit("overlap within a class").alias("issue"))
    out = rows.unionByName(pairs).groupBy("seq_id", "issue").agg(F.count("*").alias("n"))
    return out.orderBy("seq_id", "issue").limit(top) if top else out


def by_subclass_choice(motifs: DataFrame, classes: list[str], subclasses: list[str]) -> DataFrame:
    """Rows of chosen classes and subclasses; hybrids and clusters if any of their parts is chosen."""
    derived = F.col("class").isin(*DERIVED)
    return motifs.filter(F.when(derived, F.arrays_overlap("component_classes", F.array(*map(F.lit, classes)))).otherwise(F.col("class").isin(classes) & F.col("subclass").isin(subclasses)))
