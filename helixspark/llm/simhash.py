"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits, by deletion-variant signatures.

Three differing bits over two halves of 32 bits: one half differs in at most one bit. Every distinct fingerprint is
therefore indexed under each half as it is, and under each half with one bit left out (a wildcard): 66 keys. Two
fingerprints that are linked meet under the key of their equal half, or under the one wildcard at which the half differs.
Who meets is verified on all 64 bits.

Keys are dealt out by hash and read in sorted runs; a run longer than ``GROUP`` is not compared all against all, but dealt
out again under longer keys: the bits that may still differ (at most 3 of them do) are cut in four, of which one part must
be equal. Each time a quarter of the free bits gets fixed, so a run of distinct fingerprints ends up short. Nothing is
dropped on the way. Of a run, a spanning forest of its links goes on, not every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .components import connected_components

SEED, SHINGLE, BITS = 42, 3, 3
#: Fingerprints of one key that are compared with each other in a task; more are dealt out under longer keys.
GROUP = 2048
#: Fingerprints of one key that a task holds at once; beyond, they are dealt out unread.
HELD = 1 << 20
FREE = 12
HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)
ROWS = "key long, fixed long, fp long"


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the shingles' hash bits. data: UTF-8; A-Z are lower-cased, words end at ASCII white space."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)), "<u8", to - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): one row per input row. A null text counts as empty; its fingerprint is zero."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t or b"", shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rows(fixed: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    key = _mix(_mix(fp & fixed) + fixed)
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, fixed, fp)], names=["key", "fixed", "fp"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = [h for h in HALVES] + [h & ~(1 << i) for h in HALVES for i in range(64) if h >> i & 1]
    masks = np.array(masks, np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            yield _rows(np.tile(masks, len(part)), np.repeat(part, len(masks)))


@cache
def _wild(fixed: int) -> int:
    """The wildcard bit of a key: the one bit that its half leaves out; 0 if none."""
    return next((h & ~fixed for h in HALVES if (h & ~fixed).bit_count() == 1), 0)


@cache
def _free(fixed: int) -> int:
    """How many bits may differ, the wildcard aside. With fewer than FREE there are too few fingerprints to deal out again."""
    half = max(HALVES, key=lambda h: (fixed & h).bit_count())
    return 64 - (half | fixed).bit_count()


def _longer(fixed: int) -> list[int]:
    """The four longer keys' fixed bits."""
    half = max(HALVES, key=lambda h: (fixed & h).bit_count())
    free = [i for i in range(64) if not (half | fixed) >> i & 1]
    return [fixed | sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(free), 4) if len(part)]


def _forest(fps: np.ndarray, wild: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a run, as edges to the least member found: components of the verified graph."""
    left = np.arange(len(fps))
    side = (fps & np.uint64(wild)) != 0
    out = []
    while len(left):
        seen, reached = [left[:1]], left[:1]
        left = left[1:]
        while len(reached) and len(left):
            near = np.bitwise_count(fps[reached][:, None] ^ fps[left][None, :]) <= bits
            if wild:
                near &= side[reached][:, None] != side[left][None, :]
            hit = near.any(axis=0)
            reached, left = left[hit], left[~hit]
            seen.append(reached)
        if len(members := np.concatenate(seen)) > 1:
            out.append((np.repeat(fps[members[:1]], len(members) - 1), fps[members[1:]]))
    return out


def _compare(bits: int, group: int):
    """Sorted runs of keys in; links (key null), and rows under longer keys, out."""

    def batch_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["key", "fixed", "fp"])

    def again(fixed: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for mask in _longer(fixed):
            yield _rows(np.full(len(fps), mask, np.uint64), fps)

    def run_of(fixed: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        wild = _wild(fixed)
        if wild and len(set(((fps & np.uint64(wild)) != 0).tolist())) < 2:
            return
        if len(fps) > group and _free(fixed) >= FREE:
            yield from again(fixed, fps)
            return
        for u, v in _forest(fps, wild, bits):
            yield batch_of(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the run that the batch before ended in
        last, last_fixed, n_held, flooded = None, 0, 0, False
        for batch in batches:
            key, fixed, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            first, final = 0, len(cuts) - 2
            if last is not None and key[0] == last:
                held.append(fp[: cuts[1]])
                n_held += int(cuts[1])
                if (flooded or n_held > HELD) and _free(last_fixed) >= FREE:
                    flooded = True
                    for part in held:
                        yield from again(last_fixed, part)
                    held = []
                first = 1
            if first <= final:  # another run begins in this batch
                if last is not None and held and not flooded and n_held > 1:
                    yield from run_of(last_fixed, np.concatenate(held))
                sizes = np.diff(cuts)
                whole = np.arange(first, final)
                pairs = whole[sizes[whole] == 2]
                if len(pairs):  # most runs by far
                    a, b = fp[cuts[pairs]], fp[cuts[pairs] + 1]
                    near = np.bitwise_count(a ^ b) <= bits
                    yield batch_of(a[near], b[near])
                for g in whole[sizes[whole] > 2].tolist():
                    yield from run_of(int(fixed[cuts[g]]), fp[cuts[g] : cuts[g + 1]])
                last, last_fixed, held, flooded = key[-1], int(fixed[-1]), [fp[cuts[final] :]], False
                n_held = len(held[0])
        if held and not flooded and n_held > 1:
            yield from run_of(last_fixed, np.concatenate(held))

    return run


def links(distinct: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(u, v): links between distinct fingerprints (one long column), enough of them to connect all that are linked."""
    if bits > 3:
        raise ValueError("two halves with one wildcard find at most 3 differing bits")
    rows, found = distinct.mapInArrow(_variants, ROWS), None
    while True:
        done = materialize(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(bits, group), ROWS))
        new = done.filter("key is null").select(F.col("fixed").alias("u"), F.col("fp").alias("v"))
        found = new if found is None else found.union(new)
        rows = done.filter("key is not null")
        if rows.isEmpty():
            return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): one row per input row.

    component_id is the smallest id that can be reached over links, the row's own included. A null text counts as empty
    (fingerprint zero, linked like any other). A null id takes part in linking but is never a component's id, unless all
    of the component's ids are null: then that is null. Repeated rows each give a row; ties of text are the same
    fingerprint. Other columns are left out. An empty table gives an empty table.
    """
    docs = materialize(fingerprints(df, id_col, text_col, shingle))
    distinct = docs.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = connected_components(links(distinct.select("fp"), bits, group))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir))
