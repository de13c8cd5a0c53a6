"""Exact duplicate spans by a depth-limited radix sort of suffixes.

A byte goes if it is covered by a string of ``window`` bytes that also starts earlier in the corpus. Suffixes are ordered
only through ``window`` bytes, most significant digits first, and a suffix leaves the sort as soon as its group is itself
alone. Equal groups after the last digit are exactly the repeated windows.

1. First digit. Sorting every suffix of the corpus would move many times its bytes. A window's digit of ``GRAM`` bytes is
   therefore taken at its minimizer, the place in the window where the hash of the next GRAM bytes is least: equal windows
   have it at the same place, and about one place in 35 is one at all (an *anchor*). Anchors whose digit occurs once in
   the corpus leave. Within a task a repeated digit is sent on once, so a frequent one costs a row per task, not per place.
2. Contexts. An anchor that stays brings the bytes of the windows whose minimizer it is. A context that a task has met before is settled there: all its windows repeat.
3. Remaining digits. Contexts are dealt out by first digit and sorted; windows at the same distance from the anchor are
   compared over all their bytes. A group above ``GROUP`` contexts is dealt out again under longer digits: its range of
   distances is halved, and either half has more bytes that all its windows share. This ends at single windows.
4. The windows' runs are gathered for each document and cut.

A document that is a whole copy of an earlier one is told by its digest and takes no part in the steps after the first.

Texts cross the network twice, compressed. No group is held whole that grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, table

WINDOW, GRAM = 100, 16
#: Contexts of one digit that a task compares at once.
GROUP = 16_384
#: Parts into which the copies of one text are dealt.
SALTS = 32
#: Bytes of text hashed at once; anchors and contexts that a task holds before it sends them on.
BLOCK, ANCHORS, CONTEXTS = 1 << 19, 1 << 18, 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)
CONTEXT_ROWS = "key long, doc long, pos long, far int, near int, lead int, context binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each place on."""
    h, n, power = data.astype(np.uint64) + np.uint64(1), 1, np.array([BASE])
    while n < gram:
        h = h[:-n] * power + h[n:]
        n, power = 2 * n, power * power
    return _mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def _anchors(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The (first) minimizers of the windows inside the texts that bounds cuts data into: place, hash, and the farthest
    and the nearest start, before that place, of the windows that have it. These are all windows between the two."""
    width = window - gram + 1
    h = _gram_hashes(data, gram)
    least = _sliding_min(h, width)
    inside = np.ones(len(least), bool)
    for b in bounds[1:-1]:
        inside[max(0, b - window + 1) : b] = False
    starts = np.flatnonzero(inside)
    least = least[starts]
    # places that are the least of some window; a window's first of them with its least hash is its minimizer
    marks = np.zeros(len(h), bool)
    part = np.searchsorted(bounds, starts, "right")
    pad = np.zeros(width - 1, np.uint64)
    full = np.zeros(len(h) - width + 1, np.uint64)
    full[starts] = least
    marks[:] = h == ~_sliding_min(~np.concatenate([pad, full, pad]), width)
    at = np.flatnonzero(marks)
    own = np.searchsorted(at, starts)
    todo = np.flatnonzero(h[at[own]] != least)
    while len(todo):
        own[todo] += 1
        todo = todo[h[at[own[todo]]] != least[todo]]
    head = np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(own)]]) - 1
    place = at[own[first]]
    return place, h[place], place - starts[first], place - starts[last]


def _blocks(texts: list[bytes], window: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Texts of at least a window, put together or (long ones) cut with an overlap: [(number, offset)], parts."""
    where, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), BLOCK):
            part = t[at : at + BLOCK + window - 1]
            if len(part) < window:
                continue
            where.append((i, at))
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield where, parts
                where, parts, size = [], [], 0
    if parts:
        yield where, parts


def _find_anchors(window: int, gram: int):
    def flush(keys: list, docs: list, places: list) -> pa.RecordBatch:
        key, doc, pos = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        key, doc, pos = key[order], doc[order], pos[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        repeats = np.diff(np.concatenate([np.flatnonzero(head), [len(key)]])) > 1
        stays = ~head
        stays[head] = repeats
        key = np.where(head, key, _mix(doc.view(np.uint64) * BASE + pos.astype(np.uint64)))  # the others need no partner
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(stays)], names=["key", "doc", "pos", "stays"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, n = [], [], [], 0
        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            for where, parts in _blocks([t or b"" for t in batch.column(1).to_pylist()], window):
                data = np.frombuffer(b"".join(parts), np.uint8)
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                at, h, far, near = _anchors(data, bounds, window, gram)
                part = np.searchsorted(bounds, at, "right") - 1
                number, offset = (np.array(x, np.int64) for x in zip(*where, strict=True))
                keys.append(h)
                docs.append(ids[number[part]])
                places.append((at - bounds[part] + offset[part]) << 16 | far << 8 | near)
                n += len(at)
                if n >= ANCHORS:
                    yield flush(keys, docs, places)
                    keys, docs, places, n = [], [], [], 0
        if n:
            yield flush(keys, docs, places)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc", "pos", "far", "near", "lead", "context"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _contexts(window: int, gram: int):
    """A settled run of bytes is sent on as (doc, pos = its start, lead = its length), without a context."""
    import xxhash
    import zstandard

    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        held: dict[tuple[int, bytes], tuple[int, int]] = {}
        settled: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows = settled + [(_signed(xxhash.xxh64_intdigest(c[lead : lead + gram])), doc, pos, reach, 0, lead, c) for (lead, c), (doc, pos) in held.items()]  # the group's distances; a row's own are in lead and the context's size
            held.clear()
            settled.clear()
            return _context_batch(rows)

        for batch in slices(batches):
            for doc, packed, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = inflate.decompress(packed)
                for place in sorted(set(places)):
                    pos, lead, near = place >> 16, place >> 8 & 255, place & 255
                    context = text[pos - lead : pos - near + window]
                    mine, key = (doc, pos), (lead, context)
                    first = held.setdefault(key, mine)
                    if first != mine:
                        if mine < first:
                            held[key], mine = mine, first
                        settled.append((xxhash.xxh32_intdigest(b"%d %d" % mine), mine[0], mine[1] - lead, 0, 0, len(context), None))
                if len(held) >= CONTEXTS or len(settled) >= CONTEXTS:
                    yield flush()
        if held or settled:
            yield flush()

    return run


def _longer(rows: dict, window: int) -> Iterator[pa.RecordBatch]:
    """The two longer digits of each context of a large group."""
    import xxhash

    out = []
    for doc, pos, far, near, lead, context in zip(*(rows[c].tolist() if c != "context" else rows[c] for c in ("doc", "pos", "far", "near", "lead", "context")), strict=True):
        half = (near + far) // 2
        for lo, hi in ((near, half), (half + 1, far)):  # distances of a window's start before the anchor
            a, b = lead - lo, lead - hi + window
            if lead >= lo and len(context) >= b:  # else no window of this half fits into the text
                out.append((_signed(xxhash.xxh64_intdigest(context[a:b], seed=1 + 256 * lo + hi)), doc, pos, hi, lo, lead, context))
    yield _context_batch(out)


def _compare(window: int, gram: int, group: int):
    reach = window - gram
    width, step = reach + window, max(1, group // 8)
    shift = np.array([pow(int(BASE), window, 1 << 64)], np.uint64)

    def runs_of(rows: dict) -> pa.RecordBatch:
        """Whole groups, sorted by key, doc and pos: the byte runs that repeat earlier ones."""
        n = len(rows["key"])
        size = np.fromiter(map(len, rows["context"]), np.int64, n)
        lead, near, far = rows["lead"].astype(np.int64), rows["near"], rows["far"]
        text = np.zeros((n, width), np.uint8)
        begin = reach - lead
        column = np.arange(width)
        text[(column >= begin[:, None]) & (column < (begin + size)[:, None])] = np.frombuffer(b"".join(rows["context"]), np.uint8)
        prefix = np.zeros((width + 1, n), np.uint64)
        for c in range(width):
            prefix[c + 1] = prefix[c] * BASE + text[:, c] + np.uint64(1)
        repeats = np.zeros((n, reach + 2), np.int8)
        key = rows["key"].view(np.uint64)
        for d in range(reach + 1):
            ok = np.flatnonzero((lead >= d) & (size - lead >= window - d) & (near <= d) & (d <= far))
            if len(ok) < 2:
                continue
            h = _mix(prefix[reach - d + window][ok] - prefix[reach - d][ok] * shift) + key[ok]
            order = np.argsort(h, kind="stable")  # rows are in order of doc and pos inside a key: the first stays
            again = np.concatenate([[False], h[order][1:] == h[order][:-1]])
            at, begin_at = np.flatnonzero(again), reach - d
            same = text[ok[order], begin_at : begin_at + window]
            if not (same[at] == same[at - 1]).all():  # equal hashes of different bytes: by the bytes alone
                seen: set[tuple[int, bytes]] = set()
                again[:] = False
                for i, row in sorted(enumerate(ok[order].tolist()), key=lambda x: x[1]):
                    mine = (int(key[row]), same[i].tobytes())
                    again[i] = mine in seen
                    seen.add(mine)
            repeats[ok[order[again]], d] = 1
        step = np.diff(np.concatenate([np.zeros((n, 1), np.int8), repeats], axis=1), axis=1)
        row, lo = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        pos = rows["pos"][row]
        first, last = pos - (end - 1), pos - lo + window
        empty = pa.nulls(len(row), pa.binary())
        zero = pa.array(np.zeros(len(row), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row), np.int64)), pa.array(rows["doc"][row]), pa.array(first), zero, zero, pa.array((last - first).astype(np.int32)), empty], names=["key", "doc", "pos", "far", "near", "lead", "context"])

    def single(rows: dict) -> bool:
        return int(rows["far"][0]) == int(rows["near"][0])

    def part(rows: dict, at) -> dict:
        return {k: v[at] for k, v in rows.items()}

    def joined(many: list[dict]) -> dict:
        return many[0] if len(many) == 1 else {k: np.concatenate([m[k] for m in many]) for k in many[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # rows of the last key so far
        n_held, flooded, waiting, n_waiting = 0, False, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, flooded, n_waiting
            if held and n_held > 1 and not flooded:
                waiting.append(joined(held))
                n_waiting += n_held
            held, n_held, flooded = [], 0, False
            if n_waiting >= group:
                yield runs_of(joined(waiting))
                waiting.clear()
                n_waiting = 0

        for batch in batches:
            free = batch.column(6).is_null().to_numpy(zero_copy_only=False)
            if free.any():
                yield batch.filter(pa.array(free))
                batch = batch.filter(pa.array(~free))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                rows = {name: piece.column(i).to_numpy() for i, name in enumerate(("key", "doc", "pos", "far", "near", "lead"))}
                context = np.empty(piece.num_rows, object)
                context[:] = piece.column(6).to_pylist()
                rows["context"] = context
                key = rows["key"]
                cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
                first = 0
                if held and held[-1]["key"][-1] != key[0]:
                    yield from close()
                elif held:  # the run goes on
                    held.append(part(rows, slice(0, cuts[1])))
                    n_held += int(cuts[1])
                    first = 1
                    if (flooded or n_held > group) and not single(held[0]):
                        for some in held[1:] if flooded else held:
                            yield from _longer(some, window)
                        held, flooded = held[-1:], True
                    elif n_held > group:  # one window: all but the first repeat it
                        yield runs_of(joined(held))
                        held = [part(held[0], slice(0, 1))]
                        n_held = 1
                    if len(cuts) > 2:
                        yield from close()
                    else:
                        continue
                if first < len(cuts) - 2:
                    sizes = np.diff(cuts)
                    keep = np.repeat(sizes > 1, sizes)
                    keep[: cuts[first]] = False
                    keep[cuts[-2] :] = False
                    if keep.any():
                        waiting.append(part(rows, keep))
                        n_waiting += int(keep.sum())
                held = [part(rows, slice(cuts[-2], cuts[-1]))]
                n_held = int(cuts[-1] - cuts[-2])
        yield from close()
        if waiting:
            yield runs_of(joined(waiting))

    return run


def later_copies(texts: DataFrame) -> DataFrame:
    """(doc) of the texts that an earlier document has as a whole."""
    digests = materialize(texts.select("doc", F.sha2("body", 256).alias("digest")))
    first = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = digests.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))  # one text may be a third of all rows
    return materialize(dealt.join(first, ["digest", "salt"]).filter("doc > first").select("doc"))


def repeated_runs(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, copies: DataFrame | None = None) -> DataFrame:
    """texts: (doc long, unique and not null; body binary). Gives (doc, runs: array of (pos, size)), runs of bytes
    whose windows start earlier too; they may overlap. Documents without any are left out, and so are the ``copies``: all
    of their windows repeat, and nothing repeats theirs that doesn't repeat the first copy's."""
    if window - gram > 255:
        raise ValueError("a window may be at most 255 bytes longer than its first digit")
    anchors = texts.mapInArrow(_find_anchors(window, gram), "key long, doc long, pos long, stays boolean")
    met = anchors.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("stays or n > 1")
    places = met.groupBy("doc").agg(F.collect_list("pos").alias("places"))
    if copies is not None:
        places = places.join(copies, "doc", "left_anti")
    rows = compressed(texts).join(places, "doc").select("doc", "body", "places").mapInArrow(_contexts(window, gram), CONTEXT_ROWS)
    found = None
    while True:
        done = materialize(rows.repartition("key").sortWithinPartitions("key", "doc", "pos").mapInArrow(_compare(window, gram, group), CONTEXT_ROWS))
        new = done.filter("context is null").select("doc", "pos", F.col("lead").alias("size"))
        found = new if found is None else found.union(new)
        rows = done.filter("context is not null")
        if rows.isEmpty():
            break
    return found.groupBy("doc").agg(F.collect_list(F.struct("pos", "size")).alias("runs"))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [start, end): overlapping and touching ones become one."""
    out: list[list[int]] = []
    for pos, size in sorted(runs):
        if out and pos <= out[-1][1]:
            out[-1][1] = max(out[-1][1], pos + size)
        else:
            out.append([pos, pos + size])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that they cut no UTF-8 character; empty ones go."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def compressed(texts: DataFrame, level: int = 1) -> DataFrame:
    """The bodies in zstd: what a shuffle of them moves is less than half."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=level)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([deflate.compress(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["doc", "body"])

    return texts.mapInArrow(run, "doc long, body binary")


def remove_repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, group: int = GROUP, keep: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of [start, end) in bytes), text
    (what is left, where spans are first shrunk to whole characters). With ``keep``, the input's columns with the new
    text, and n_removed and n_spans.

    Earlier means a smaller id, or the same document and an earlier start. A null text counts as empty (with ``keep`` it
    stays null); a null id comes after all others. Rows that repeat id and text are one document and get the same result;
    different texts under one id go by text. Without ``keep`` other columns are left out; with it, columns named like an
    output are replaced. An empty table gives an empty table.
    """
    import zstandard

    raw = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    integral = isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    plain = integral and raw.groupBy("_id").count().filter("_id is null or count > 1").isEmpty()
    if plain:
        numbered = raw.select(F.col("_id").cast("long").alias("doc"), F.col("_text").cast("binary").alias("body"))
    else:  # number the distinct rows in order; the number of a range-sorted row grows with the order
        order = (F.col("_id").asc_nulls_last(), F.col("_text"))
        known = materialize(raw.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()))
        numbered = known.select("doc", F.col("_text").cast("binary").alias("body"))
        names = known.select("doc", "_id", F.sha2("_text", 256).alias("_digest"))
    copies = later_copies(numbered)
    runs = repeated_runs(numbered, window, gram, group, copies)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        for b in slices(batches):
            out = []
            for packed, found, copy in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                data = inflate.decompress(packed)
                spans = [(0, len(data))] if copy and len(data) >= window else merged([(r["pos"], r["size"]) for r in found or []])
                out.append((len(data), sum(y - x for x, y in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest(), [{"start": x, "end": y} for x, y in spans], _kept(data, whole_characters(data, spans)).decode()))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 6
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["_doc", "_bytes", "_removed", "_spans", "_sha", "_where", "_left"])

    joined = compressed(numbered).join(runs, "doc", "left").join(copies.withColumn("copy", F.lit(True)), "doc", "left").select("doc", "body", "runs", "copy")
    done = joined.mapInArrow(finish, "_doc long, _bytes long, _removed long, _spans long, _sha string, _where array<struct<start: long, end: long>>, _left string")
    outs = [F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.col("_sha").alias("kept_sha256"), F.col("_where").alias("spans"), F.col("_left").alias(text_col)]
    if plain and not keep:
        return done.select(F.col("_doc").cast(df.schema[id_col].dataType).alias(id_col), *outs)
    rest = [c for c in df.columns if c not in (id_col, text_col, "n_removed", "n_spans")] if keep else []
    rows = df.select(F.col(id_col).alias("_row_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("_row_digest"), F.col(text_col).isNull().alias("_null"), *(F.col(c).alias(f"_rest{k}") for k, c in enumerate(rest)))
    if plain:
        back = rows.join(done, F.col("_row_id") == F.col("_doc"))
    else:
        back = rows.join(names, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_digest") == F.col("_digest"))).join(done, F.col("doc") == F.col("_doc"))
    if not keep:
        return back.select(F.col("_row_id").alias(id_col), *outs)
    new = {id_col: F.col("_row_id"), text_col: F.when(~F.col("_null"), F.col("_left")), **{c: F.col(f"_rest{k}") for k, c in enumerate(rest)}}
    return back.select(*(new[c].alias(c) for c in df.columns if c in new), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after the repeated 100-byte strings went."""
    return remove_repeats(table(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
