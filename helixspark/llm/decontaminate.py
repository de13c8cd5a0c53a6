"""Benchmark decontamination: documents that hold a passage within a small edit distance of a benchmark item.

CGK random walks embed strings so that a small edit distance becomes a small Hamming distance: a walk copies the character
under its head at each of 3 L steps and moves on or not by a random bit of (step, character), so two walks fall into step
again after an edit. Bit-sampling LSH over the embeddings then finds the pairs: a signature is the embedding at a few
sampled steps, and a window is a candidate for an item if any of ``REPEATS`` signatures, over ``WALKS`` walks, is equal.
Candidates are verified by their exact edit distance (Myers' bit-parallel search over the window's surroundings).

Windows are item-sized and lie anywhere in the whole text. An item of L characters is held to leak when a substring lies
within L // 8 - 2 edits of it. So many edits leave at least two of the item's L // 8 blocks of 8 characters whole, which
are therefore to be found in the text, as far apart as in the item but for the edits: windows are laid where two blocks of
the item do so and nowhere else, and no window that could pass the verification is lost that way: what is found is what the
embeddings find among the windows at every place (``every_place``, a mode for tests, lays all of those; it costs some hundred
times the work).

The walks' bits are hashes of (walk, step, character), so nothing held grows with the longest item, and windows are embedded
together as long as their letters and steps fit in BATCH_BYTES. Items of fewer than 8 characters have no block: those are
leaks where they stand as they are.

The items are compared in one form with the texts: A-Z lower-cased, white space (ASCII) and NUL as single spaces. Items are a stated set that every task holds, in parts of at most MAX_ITEM_BYTES: one pass over the texts for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

BLOCK = 8
WALKS, REPEATS, SAMPLES, SEED = 3, 72, 4, 11
#: Benchmark text that a task may hold.
MAX_ITEM_BYTES = 64 << 20
#: Windows that are embedded at once, and bytes of their letters and steps; steps whose bits a task keeps.
CHUNK, BATCH_BYTES, KEPT_STEPS = 4096, 24 << 20, 2048
HASH = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().replace(b"\0", b" ").split())


def limit_of(item: bytes) -> int:
    """Edits within which an item is held to leak; one shorter than three blocks must be there as it is."""
    return max(0, len(item) // BLOCK - 2)


def edit_distance_within(pattern: bytes, text: bytes) -> int:
    """Least edit distance of the pattern to any substring of the text (Myers, one big integer per column)."""
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = mask, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best = score
    return best


@dataclass
class Index:
    """What a task holds of the items."""

    ids: list
    items: list[bytes]
    keys: np.ndarray  # blocks, sorted
    begin: np.ndarray  # of each block's postings
    item: np.ndarray
    offset: np.ndarray
    limit: np.ndarray  # of each item: edits
    alone: np.ndarray  # of each item: whether it has a single block
    bits: np.ndarray  # a bitmap over hashed blocks
    walks: int
    seed: int
    length: np.ndarray  # of each item
    last: np.ndarray  # of each item: the last step that is sampled
    steps: np.ndarray  # items x REPEATS x SAMPLES: sampled steps
    signs: np.ndarray  # items x REPEATS x SAMPLES: the items' characters there
    short: dict[int, tuple[np.ndarray, list[list[int]]]]  # by length: packed items of fewer than BLOCK characters, and their numbers


def _bits(walk: int, first: int, last: int, seed: int) -> np.ndarray:
    """Whether a walk's head moves on at each of the steps [first, last) over each character: steps x 256 of 0 and 1, 0 for character 0."""
    x = (np.arange(first, last, dtype=np.uint64)[:, None] * np.uint64(256) + np.arange(256, dtype=np.uint64) + np.uint64((seed * 1_000_003 + walk) << 40)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    out = ((x ^ (x >> np.uint64(29))) >> np.uint64(63)).astype(np.uint8)
    out[:, 0] = 0
    return out


@lru_cache(maxsize=16)
def _first_bits(walk: int, seed: int) -> np.ndarray:
    return _bits(walk, 0, KEPT_STEPS, seed)


def _walk(text: np.ndarray, start: np.ndarray, end: np.ndarray, walk: int, seed: int, n_steps: int) -> np.ndarray:
    """Embeddings of text[start:end) for each pair, n_steps x pairs; 0 past the end. No text has a character 0."""
    width = int((end - start).max()) + 1
    rows = np.zeros((len(start), width), np.uint8)
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        rows[k, : b - a] = text[a:b]
    flat = rows.ravel()
    head = np.arange(len(start)) * width
    out = np.empty((n_steps, len(start)), np.uint8)
    moves = _first_bits(walk, seed)
    for j in range(n_steps):
        if j and j % KEPT_STEPS == 0:
            moves = _bits(walk, j, j + KEPT_STEPS, seed)
        c = flat[head]
        out[j] = c
        head += moves[j % KEPT_STEPS][c]  # 0 stays where it is
    return out


def _packed(text: np.ndarray, size: int) -> np.ndarray:
    """The number of every run of ``size`` characters, below BLOCK."""
    out = np.zeros(max(0, len(text) - size + 1), np.uint64)
    for k in range(size):
        out |= text[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def build_index(rows: list[tuple[object, str | None]], walks: int = WALKS, repeats: int = REPEATS, samples: int = SAMPLES, seed: int = SEED) -> Index:
    """rows: (item id, text). Empty items are left out."""
    rng = np.random.default_rng(seed)
    every = [(i, x) for i, x in ((i, normal(t)) for i, t in rows) if x]
    known = [r for r in every if len(r[1]) >= BLOCK]
    every = known + [r for r in every if len(r[1]) < BLOCK]
    by_size: dict[int, dict[int, list[int]]] = {}
    for k, (_, x) in enumerate(every[len(known) :], len(known)):
        by_size.setdefault(len(x), {}).setdefault(int.from_bytes(x, "little"), []).append(k)
    short = {n: (np.array(sorted(found), np.uint64), [found[key] for key in sorted(found)]) for n, found in by_size.items()}
    posting: dict[int, list[tuple[int, int]]] = {}
    for k, (_, x) in enumerate(known):
        for o in range(0, len(x) - BLOCK + 1, BLOCK):
            posting.setdefault(int.from_bytes(x[o : o + BLOCK], "little"), []).append((k, o))
    keys = np.array(sorted(posting), np.uint64)
    counts = np.array([len(posting[int(k)]) for k in keys], np.int64)
    flat = [p for k in keys for p in posting[int(k)]]
    size = 20
    while 1 << size < 64 * len(keys):
        size += 1
    bits = np.zeros(1 << size, bool)
    bits[(keys * HASH) >> np.uint64(64 - size)] = True
    steps = np.zeros((len(known), repeats, samples), np.int32)
    signs = np.zeros((len(known), repeats, samples), np.uint8)
    for k, (_, x) in enumerate(known):
        data = np.frombuffer(x, np.uint8)
        # most walks are through after 2 L steps; samples beyond the item's end would tell nothing
        ends = [_walk(data, np.zeros(1, np.int64), np.array([len(x)]), w, seed, 3 * len(x))[:, 0] for w in range(walks)]
        for r in range(repeats):
            full = np.flatnonzero(ends[r % walks])
            steps[k, r] = np.sort(rng.choice(full, samples, replace=len(full) < samples))
            signs[k, r] = ends[r % walks][steps[k, r]]
    return Index([i for i, _ in every], [x for _, x in every], keys, np.concatenate([[0], np.cumsum(counts)]), np.array([p[0] for p in flat], np.int64), np.array([p[1] for p in flat], np.int64), np.array([limit_of(x) for _, x in known], np.int64), np.array([len(x) < 2 * BLOCK for _, x in known], bool), bits, walks, seed, np.array([len(x) for _, x in known], np.int64), steps.max(axis=(1, 2), initial=0) if len(known) else np.zeros(0, np.int32), steps, signs, short)


def windows_of(index: Index, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(item, start of the window) where a block of the item occurs; starts may lie outside of the text by a little."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(text) < BLOCK or not len(index.keys):
        return none  # an item has a block at least
    raw = np.frombuffer(text, np.uint8)
    grams = np.lib.stride_tricks.sliding_window_view(raw, BLOCK)
    at_all, k_all = [], []
    shift = np.uint64(64 - (len(index.bits).bit_length() - 1))
    for at in range(0, len(grams), 1 << 20):
        v = np.ascontiguousarray(grams[at : at + (1 << 20)]).view("<u8").ravel()
        p = np.flatnonzero(index.bits[(v * HASH) >> shift])
        k = np.minimum(np.searchsorted(index.keys, v[p]), len(index.keys) - 1)
        ok = index.keys[k] == v[p]
        at_all.append(p[ok] + at)
        k_all.append(k[ok])
    at, k = np.concatenate(at_all), np.concatenate(k_all)
    if not len(at):
        return none
    n = index.begin[k + 1] - index.begin[k]
    post = np.repeat(index.begin[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    item = index.item[post]
    start = np.repeat(at, n) - index.offset[post]
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    near = (item[1:] == item[:-1]) & (start[1:] - start[:-1] <= index.limit[item[1:]])
    keep = index.alone[item]
    keep[1:] |= near
    keep[:-1] |= near
    item, start = item[keep], start[keep]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    return item[new], start[new]


def all_windows(index: Index, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(item, start) of the windows at every place of a text, for every item."""
    item, start = np.meshgrid(np.arange(len(index.length)), np.arange(len(text)), indexing="ij")
    return item.ravel(), start.ravel()


def candidates(index: Index, raw: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows raw[begin:end) share a signature with their item."""
    found = np.zeros(len(item), bool)
    order = np.argsort(index.last[item], kind="stable")  # windows of like numbers of steps together
    n_walks = index.walks
    # letters and steps of the windows up to each, as rows of one array are as long as the longest
    need = (end - begin)[order] + index.last[item][order] + 2
    at = 0
    while at < len(item):
        stop = at + CHUNK
        while stop > at + 1 and int(need[at:stop].max()) * (min(stop, len(item)) - at) > BATCH_BYTES:
            stop = at + (min(stop, len(item)) - at + 1) // 2
        rows, at = order[at:stop], stop
        for w in range(n_walks):
            rows = rows[~found[rows]]
            if not len(rows):
                break
            i = item[rows]
            out = _walk(raw, begin[rows], end[rows], w, index.seed, int(index.last[i].max()) + 1)
            hit = np.zeros(len(rows), bool)
            for r in range(w, index.steps.shape[1], n_walks):
                steps = index.steps[i, r]
                some = np.flatnonzero(~hit & (out[steps[:, 0], np.arange(len(rows))] == index.signs[i, r, 0]))
                for q in range(1, steps.shape[1]):
                    some = some[out[steps[some, q], some] == index.signs[i[some], r, q]]
                hit[some] = True
            found[rows[hit]] = True
    return found


def leaks_of(index: Index, texts: list[bytes], every_place: bool = False) -> list[list[tuple[int, int]]]:
    """For each text, (item, its least edit distance) of the items that it holds. The windows of all texts are embedded together."""
    raw = np.frombuffer(b"".join(texts) or b" ", np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    per_text = [(all_windows if every_place else windows_of)(index, t) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(i) for i, _ in per_text])
    item = np.concatenate([i for i, _ in per_text] or [np.zeros(0, np.int64)])
    start = np.concatenate([s for _, s in per_text] or [np.zeros(0, np.int64)])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for n, (keys, numbers) in index.short.items():
        for t, x in enumerate(texts):
            there = np.isin(keys, _packed(np.frombuffer(x, np.uint8), n))
            out[t] += [(k, 0) for at in np.flatnonzero(there).tolist() for k in numbers[at]]
    if not len(item):
        return out
    size = bounds[text + 1] - bounds[text]
    length = index.length[item]
    a, b = np.clip(start, 0, size), np.clip(start + length, 0, size)
    keep = candidates(index, raw, item, bounds[text] + a, bounds[text] + b)
    for t in np.unique(text[keep]).tolist():
        mine = keep & (text == t)
        for k in np.unique(item[mine]).tolist():
            x = index.items[k]
            limit = limit_of(x)
            ranges: list[list[int]] = []  # the windows' surroundings, overlapping ones as one
            for s in start[mine & (item == k)].tolist():
                lo, hi = max(0, s - limit), min(len(texts[t]), s + len(x) + limit)
                if ranges and lo <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], hi)
                else:
                    ranges.append([lo, hi])
            d = min(edit_distance_within(x, texts[t][lo:hi]) for lo, hi in ranges)
            if d <= limit:
                out[t].append((k, d))
    return out


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, part_bytes: int = MAX_ITEM_BYTES, every_place: bool = False) -> DataFrame:
    """One row per input row: id (or with ``keep`` the input's columns), n_leaks, leaks (array of item_id and edits).

    Null and empty texts hold nothing, and null and empty items are passed over. Items of fewer than BLOCK characters must stand as they are;
    items of one text are reported each. Repeated rows are judged one by one. Columns of the input named like an output are replaced. An empty
    table gives an empty table; an empty benchmark, no leaks.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // part_bytes) or 1
    outs = ("n_leaks", "leaks")
    names = [c for c in df.columns if c not in outs] if keep else [id_col]
    kind = benchmark.schema["item_id"].dataType.simpleString()
    now = df.select(*(F.col(c) for c in names), F.col(text_col).cast("string").alias("_t"), F.array().cast(f"array<struct<item_id: {kind}, edits: int>>").alias("leaks"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.drop("_t", "leaks").schema) + f", _t string, leaks array<struct<item_id: {kind}, edits: int>>"
    for p in range(parts):
        mine = benchmark if parts == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        rows = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()]  # about part_bytes
        rows = sorted({(i, t) for i, t in rows if normal(t)}, key=lambda r: (str(r[0]), r[1]))
        index = df.sparkSession.sparkContext.broadcast(build_index(rows))
        now = now.mapInArrow(_with_leaks(index, len(names), every_place), schema)
        if p + 1 < parts:
            now = materialize(now)
    return now.select(*names, F.size("leaks").alias("n_leaks"), "leaks")


def _with_leaks(index, width: int, every_place: bool):
    """Adds an index's leaks to the rows' lists; the text is column ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in slices(batches, 1024):
            found = leaks_of(held, [normal(t) for t in batch.column(width).to_pylist()], every_place)
            before = batch.column(width + 1)
            leaks = pa.array([a + [{"item_id": held.ids[k], "edits": d} for k, d in f] for a, f in zip(before.to_pylist(), found, strict=True)], before.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], leaks], schema=batch.schema)

    return run


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds."""
    return find_leaks(table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
