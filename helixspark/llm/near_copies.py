"""Near copies by exact Jaccard similarity of word shingles: every pair at the limit or above is found, and no other.

Two sets with Jaccard similarity of at least 4/5 share an element among the first n // 5 + 1 of each, in any order of the
elements that is the same for all sets (prefix filter). Those elements are the keys that a text is listed under. Who
shares a key is a group; groups of the same members are one. Members of a group are first told apart by fingerprints: bitmaps of
about as many bits as the set has elements, where each element turns one bit. Where two of them differ in more bits than
two alike sets may differ in elements, the sets are not alike; this loses no pair. Who may still be alike is compared by
whole sets.

SimHash finds most near copies first: texts whose 64-bit fingerprints (majority of the shingles' hash bits) are linked at 3 or
fewer differing bits are a group, and its members are compared by whole sets. Near copies further apart come from the
prefix filter: its groups are compared unless their members are all connected by then.

The order is by hash, but shingles that repeat in a sample of the texts come last, so that common lines seldom are keys.
The sample decides on speed only: the filter holds for any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, slices
from .components import connected_components

SEED, SHINGLE = 42, 5
#: Texts, and characters of each, that the order of shingles is learnt from.
SAMPLE, SAMPLE_CHARS = 2000, 20_000


def digest_of(data: bytes) -> int:
    """Which text it is: its words without regard to A-Z and white space, as a signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(b" ".join(data.lower().split()), digest_size=8).digest(), "little", signed=True)


def shingles_of(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a shorter text is one shingle, an empty one has none."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def alike(shared, a, b):
    """Whether sets of a and b elements have a Jaccard similarity of at least 4/5."""
    return 9 * shared >= 4 * (a + b)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The parity of how many elements fall on each bit; a power of two of 64-bit words."""
    bits = 64
    while bits < len(h):
        bits *= 2
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def simhash_of(h: np.ndarray) -> int:
    """The SimHash of a set of shingles: the majority of their bits, as a signed 64-bit number; zero for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def _folded(fp: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(fp.reshape(-1, words), axis=0)


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles that more than one text of a sample has. texts: (text)."""
    share = max(1, texts.count() // SAMPLE)
    rows = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select(F.substring("text", 1, SAMPLE_CHARS).cast("binary").alias("t")).distinct().limit(2 * SAMPLE).collect()
    sets = [shingles_of(bytes(r["t"] or b"")) for r in rows]
    found, times = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
    return found[times > 1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by their first column, run by run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _name(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) sorted by key: the members of every key that more than one text has, as (group, digest)."""
    ids, members, n = [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.empty(0, np.int64)])) for x in (ids, members)], names=["grp", "digest"])

    held = np.empty(0, np.int64)
    last = None

    def close(found: np.ndarray) -> None:
        nonlocal n
        found = np.unique(found)
        if len(found) > 1:
            ids.append(np.full(len(found), _name(found), np.int64))
            members.append(found)
            n += len(found)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        first = 0
        if last is not None and key[0] == last:
            held, first = np.concatenate([held, digest[: cuts[1]]]), 1
        if first < len(cuts) - 1:  # another run begins in this batch
            close(held)
            sizes = np.diff(cuts)
            for g in np.flatnonzero(sizes[first:-1] > 1) + first:
                close(digest[cuts[g] : cuts[g + 1]])
            held, last = digest[cuts[-2] :], key[-1]
        if n > 50_000:
            yield out()
            ids, members, n = [], [], 0
    close(held)
    yield out()


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all of the sets that are alike, directly or by others."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    if len(sets) == 2:
        return [(0, 1)] if alike(len(np.intersect1d(*sets, assume_unique=True)), *size) else []
    sets, size = [sets[i] for i in order], size[order]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(codes.max() + 1, bool)
    left = np.ones(len(sets), bool)
    out = []
    for k in range(len(sets)):
        todo = [k] if left[k] else []
        left[k] = False
        while todo:
            i = todo.pop()
            # only sets of at least 4/5 and at most 5/4 of the size can be alike
            a, b = np.searchsorted(size, -(-4 * size[i] // 5)), np.searchsorted(size, 5 * size[i] // 4, side="right")
            if not left[a:b].any():
                continue
            mark[codes[starts[i] : ends[i]]] = True
            shared = np.add.reduceat(mark[codes[starts[a] : ends[b - 1]]].astype(np.int64), starts[a:b] - starts[a])
            mark[codes[starts[i] : ends[i]]] = False
            hit = np.flatnonzero(left[a:b] & alike(shared, size[i], size[a:b])) + a
            left[hit] = False
            todo += hit.tolist()
            out += [(int(order[i]), int(order[j])) for j in hit]
    return out


def possible(size: np.ndarray, prints: list[np.ndarray]) -> list[np.ndarray]:
    """Parts of a group: whoever may be alike, by size and fingerprint, directly or by others. Only parts of two or more."""
    order = np.argsort(size, kind="stable")
    size, prints = size[order], [prints[i] for i in order]
    words = np.array([len(p) for p in prints])
    # sets that may be alike have the same number of words, or one has twice as many: the larger is folded
    at = {int(w): (a := int(np.searchsorted(words, w)), np.stack(prints[a : int(np.searchsorted(words, w, side="right"))])) for w in np.unique(words)}
    left = np.ones(len(size), bool)
    out = []
    for k in range(len(size)):
        if not left[k]:
            continue
        left[k] = False
        part, todo = [k], [k]
        while todo:
            i = todo.pop()
            w = int(words[i])
            for v in (w // 2, w, 2 * w):
                if v not in at:
                    continue
                start, table = at[v]
                a, b = max(start, np.searchsorted(size, -(-4 * size[i] // 5))), min(start + len(table), np.searchsorted(size, 5 * size[i] // 4, side="right"))
                near = np.flatnonzero(left[a:b]) + a if a < b else ()
                if not len(near):
                    continue
                rows = table[near - start]
                apart = np.bitwise_count((rows[:, :w] ^ rows[:, w:] if v > w else rows) ^ (_folded(prints[i], v) if v < w else prints[i])).sum(axis=1, dtype=np.int64)
                hit = near[9 * apart <= size[i] + size[near]]
                left[hit] = False
                part += hit.tolist()
                todo += hit.tolist()
        if len(part) > 1:
            out.append(order[part])
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, digest, size, fingerprint) sorted by group: smaller groups, of members that may be alike."""
    for run in _runs(batches):
        digest = run.column(1).to_numpy()
        for part in possible(run.column(2).to_numpy(), [np.frombuffer(x, np.uint64) for x in run.column(3).to_pylist()]):
            members = np.sort(digest[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), _name(members), np.int64)), pa.array(members)], names=["grp", "digest"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, digest, shingles) sorted by group: the links between alike members."""
    for run in _runs(batches):
        digest = run.column(1).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in run.column(2).to_pylist()]
        if pairs := forest(sets):
            at = np.array(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(digest[at[:, 0]]), pa.array(digest[at[:, 1]])], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles_of((t or "").encode()).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["digest", "shingles"])


def links(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """docs: as listed() gives them; texts: (digest, text). (u, v): links between digests, enough to connect all alike texts."""
    listed = docs.select(F.explode("keys").alias("key"), "digest").repartition("key").sortWithinPartitions("key").mapInArrow(_groups, "grp long, digest long")
    prints = docs.select("digest", "size", "print").dropDuplicates(["digest"])
    rows = listed.distinct().join(prints, "digest").select("grp", "digest", "size", "print")
    members = materialize(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_parts, "grp long, digest long").distinct())
    # texts of linked SimHashes; members are told apart by size and fingerprint as in any group
    fps = materialize(docs.select("digest", "size", "print", "fp").dropDuplicates(["digest"]))
    block = connected_components(simhash.links(fps.select("fp").distinct())).withColumnRenamed("node", "fp")
    blocks = fps.join(block, "fp", "left").select(F.coalesce("root", "fp").alias("grp"), "digest", "size", "print")
    several = blocks.groupBy("grp").count().filter("count > 1").select("grp")
    close = materialize(blocks.join(several, "grp", "left_semi").repartition("grp").sortWithinPartitions("grp").mapInArrow(_parts, "grp long, digest long"))
    sets = materialize(texts.join(members.select("digest").union(close.select("digest")).distinct(), "digest", "left_semi").dropDuplicates(["digest"]).mapInArrow(_sets, "digest long, shingles binary"))

    def compared(some: DataFrame) -> DataFrame:
        rows = some.join(sets, "digest").select("grp", "digest", "shingles")
        return materialize(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_links, "u long, v long"))

    # near copies by SimHash first: of the other groups, those whose members are all connected by then need no comparison
    first = compared(close)
    roots = connected_components(first).withColumnRenamed("node", "digest")
    others = members.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    open_ = others.groupBy("grp").agg((F.min("root") < F.max("root")).alias("open")).filter("open").select("grp")
    return first.union(compared(others.join(open_, "grp", "left_semi").select("grp", "digest")))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, text): one row per input row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [digest_of((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(1)], names=["id", "digest", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, digest long, text string")


def listed(df: DataFrame, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, size, print, fp, keys): one row per input row."""
    kind = df.schema[id_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digest, size, prints, fps, keys = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                data = (t or "").encode()
                h = shingles_of(data)
                late = np.isin(h, held.value, assume_unique=True)
                digest.append(digest_of(data))
                size.append(len(h))
                prints.append(fingerprint(h).tobytes())
                fps.append(simhash_of(h))
                keys.append(np.concatenate([h[~late], h[late]])[: len(h) // 5 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.int64()), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "size", "print", "fp", "keys"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, digest long, size long, print binary, fp long, keys array<long>")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, component_id): one row per input row.

    component_id is the smallest id that can be reached over texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, the row's own included. Null and empty texts are copies of each other. A null id takes
    part in linking but is never a component's id, unless all of the component's ids are null: then that is null.
    """
    docs = materialize(listed(df, _common(df.select(F.col(text_col).cast("string").alias("text"))), id_col, text_col))
    distinct = docs.groupBy("digest").agg(F.min("id").alias("least"))
    roots = connected_components(links(docs, digests(df, id_col, text_col).select("digest", "text")))
    rooted = materialize(distinct.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "least", F.coalesce("root", "digest").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.select("id", "digest").join(rooted.join(least, "root").select("digest", "component_id"), "digest").select(F.col("id").alias(id_col), "digest", "component_id")
