"""The detectors that compare a sequence with itself or look far ahead: Arrow batch functions over whole sequences, plain numpy inside.

Each gives (seq_id, start, end, subclass, raw_score, length_scored, attrs) with places from 0, half open.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.tables import STACKING
from .tiling import tiled

ROWS = "seq_id string, start long, end long, subclass string, raw_score double, attrs map<string,string>"
CODE = np.full(256, 255, np.uint8)
CODE[[65, 67, 71, 84]] = [0, 1, 2, 3]  # A, C, G, T; the complement of x is 3 - x
#: Longest unit of a tandem repeat.
UNIT = 100
UNITS = frozenset({"CAG", "CTG", "CGG", "CCG", "GAA", "TTC"})


_TURN = str.maketrans("ACGT", "TGCA")

#: A row that a kernel looks at: its letters, its core [lo, hi) within them, whether they begin and end where the sequence does.
Row = tuple[str, int, int, bool, bool]
#: Letters that a kernel looks at together, so that numpy's calls are few and their arrays stay in a core's cache.
STACK = 1 << 18


def _apply(seqs: DataFrame, kernel: Callable[[list[Row]], Iterable[tuple]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """seq_id and what the kernel gives of every sequence or tile, its first two numbers moved to the sequence's places.

    kernel(rows) looks at all letters of some rows and gives the row's number and what begins in its core. One stack of
    ``STACK`` letters (or one longer text) and some hits are held at once.
    """
    places = seqs.select("seq_id", "seq", *(("at", "lo", "hi", "n") if tiled(seqs) else ()))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * (1 + len(kinds))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *kinds.values()), strict=True)], names=["seq_id", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stack: list[Row] = []
        names: list[tuple[str, int]] = []
        held = 0

        def hits() -> Iterator[tuple]:
            for i, a, b, *rest in kernel(stack):
                yield (names[i][0], a + names[i][1], b + names[i][1], *rest)

        for batch in batches:
            for k in range(batch.num_rows):
                name, seq, *place = (c[k].as_py() for c in batch.columns)
                if seq:
                    at, lo, hi, n = place or (0, 0, len(seq), len(seq))
                    stack.append((seq.upper(), lo, hi, at == 0, at + len(seq) >= n))
                    names.append((name, at))
                    held += len(seq) + UNIT
                if held >= STACK:
                    rows += hits()
                    stack, names, held = [], [], 0
                if len(rows) >= 1 << 14:
                    yield out(rows)
                    rows = []
        rows += hits()
        yield out(rows)

    return places.mapInArrow(run, schema)


def one_by_one(kernel: Callable[[str, int, int], list[tuple]]) -> Callable[[list[Row]], Iterator[tuple]]:
    """A kernel of rows that looks at one row after another."""
    return lambda rows: ((i, *hit) for i, (seq, lo, hi, *_) in enumerate(rows) for hit in kernel(seq, lo, hi))


def apply_kernel(seqs: DataFrame, kernel: Callable[[list[Row]], Iterable[tuple]], settled: bool = False) -> DataFrame:
    """A detector's hits of sequences or tiles; ``settled``: with ``open``, of those that other tiles may overlap."""

    def listed(rows: list[Row]) -> Iterator[tuple]:
        return ((*row[:5], list(row[5].items()), *row[6:]) for row in kernel(rows))

    kinds = {"start": pa.int64(), "end": pa.int64(), "subclass": pa.string(), "raw_score": pa.float64(), "attrs": pa.map_(pa.string(), pa.string())}
    return _apply(seqs, listed, kinds | ({"open": pa.bool_()} if settled else {}), ROWS + (", open boolean" if settled else ""))


def _stacked(rows: list[Row], before: int, after: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of the rows, each with ``before`` and ``after`` letters around its core at most, one behind another.

    Zeros stand ``gap`` places before, between and after them; letters that aren't ASCII are marks. With it: where each row's
    first letter would stand, and which row each place belongs to (-1: none, or not its core).
    """
    parts, at, own = [bytes(gap)], [], [np.full(gap, -1, np.int32)]
    size = gap
    for i, (seq, lo, hi, *_) in enumerate(rows):
        begin = max(0, lo - before)
        part = seq[begin : hi + after].encode("ascii", "replace")
        parts += [part, bytes(gap)]
        at.append(size - begin)
        mine = np.full(len(part) + gap, -1, np.int32)
        mine[lo - begin : hi - begin] = i
        own.append(mine)
        size += len(part) + gap
    return np.frombuffer(b"".join(parts), np.uint8), np.array(at, np.int64), np.concatenate(own)


def first_free(rows: list[tuple[int, int]]) -> list[int]:
    """Indexes of the intervals that, taken in order, overlap none taken before."""
    kept: list[tuple[int, int]] = []
    out = []
    for i, (s, e) in enumerate(rows):
        at = bisect.bisect_left(kept, (e, 0))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
            bisect.insort(kept, (s, e))
            out.append(i)
    return out


def anchored(pattern: re.Pattern, first: str) -> Callable[..., Iterator[re.Match]]:
    """``pattern.finditer(text, begin, end)`` for a pattern whose matches all begin with the letters ``first``: it is tried only where these stand."""

    def find(text: str, begin: int = 0, end: int | None = None) -> Iterator[re.Match]:
        end = len(text) if end is None else end
        at = text.find(first, begin, end)
        while at >= 0:
            m = pattern.match(text, at, end)
            if m:
                yield m
            at = text.find(first, m.end() if m else at + 1, end)

    return find


def _head(pattern: str) -> str:
    """The letters that all matches of a pattern begin with: X{n} or X{n,} of one letter."""
    letter, n = re.match(r"([ACGT])\{(\d+)", pattern).groups()
    return letter * int(n)


def _percent(part: int, whole: int) -> float:
    """Two places, halves up."""
    return math.floor(part * 10_000 / whole + 0.5 + 1e-9) / 100


def r_loops(patterns: dict[str, str]) -> Callable[[str, int, int], list[tuple]]:
    """Initiation zones by the patterns on both strands; (.., strand and pattern, raw score, G shares)."""
    compiled = {name: anchored(re.compile(p), _head(p)) for name, p in patterns.items()}

    def run(seq: str, lo: int, hi: int) -> list[tuple]:
        out = []
        for strand, s in (("+", seq[lo:]), ("-", seq[:hi].translate(_TURN)[::-1])):  # from the core on, downstream
            g, n = None, len(s)
            for name, find in compiled.items():
                for m in find(s, 0, hi - lo):
                    begin, end = m.span()
                    riz = _percent(s.count("G", begin, end), end - begin)
                    if riz < 50:
                        continue
                    if g is None:
                        g = np.concatenate([[0], np.cumsum(np.frombuffer(s.encode("ascii", "replace"), np.uint8) == 71)])
                    stop, last, rez = min(n, end + 2000), end, 0.0
                    grid = np.arange(end + 50, stop, 50)  # zones begin at every second place, and end at all behind it
                    best, starts = 0, grid[::2]
                    until_b = np.minimum(starts + 100, stop)
                    for i in np.flatnonzero((g[until_b] - g[starts]) * 100 >= 40 * (until_b - starts)).tolist():
                        a, to = int(starts[i]), grid[2 * i + 1 :]
                        count = g[to] - g[a]
                        count[count * 100 < 40 * (to - a)] = 0
                        if len(count) and count.max() > best:
                            k = int(count.argmax())
                            best, last = int(count[k]), int(to[k])
                            rez = _percent(best, last - a)
                    raw = round(min(1.0, riz / 100 + rez / 100), 6)
                    span = (lo + begin, lo + last) if strand == "+" else (hi - last, hi - begin)
                    out.append((*span, f"{strand}\t{name}", raw, {"riz_percent_g": str(riz), "rez_percent_g": str(rez)}))
        return out

    return run


def half_up(x: float, places: int = 6) -> float:
    """Rounded as Spark rounds: the decimal digits of x, halves up."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def _free_of_islands(hits: list[tuple], order: Callable[[tuple], tuple]) -> Iterator[tuple]:
    """Of overlapping hits (start, end, ..), those that come first in order, then by place: island by island."""
    island: list[tuple] = []
    reach = 0

    def taken() -> Iterator[tuple]:
        first = sorted(island, key=lambda h: (*order(h), h[0], h[1])) if len(island) > 1 else island
        return (first[j] for j in first_free([h[:2] for h in first]))

    for hit in sorted(hits, key=lambda h: h[:2]):
        if island and hit[0] >= reach:
            yield from taken()
            island = []
        reach = max(reach, hit[1]) if island else hit[1]
        island.append(hit)
    yield from taken()


def quadruplexes(patterns: dict[str, str], names: Iterable[str], choose: bool) -> Callable[[str, int, int], Iterator[tuple]]:
    """Matches of the patterns in the windows around runs of G, 50 letters before and 200 behind a run's start: (start, end, pattern, raw score, its place in names).

    ``choose``: of overlapping ones those that come first by score, place in names, length. Matches don't leave their window, so it is
    made window by window.
    """
    compiled = [(name, i, re.compile(patterns[name])) for i, name in enumerate(names)]
    g = re.compile("G{3,}")

    def windows(seq: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        begin, end = -1, -1
        for m in g.finditer(seq, max(0, lo - 200), min(len(seq), hi + 53)):  # windows of other runs end before the core, or begin behind it
            a, b = max(lo, m.start() - 50), min(hi, m.start() + 200)
            if a >= b:
                continue
            if begin >= 0 and a <= end:
                end = b
                continue
            if begin >= 0:
                yield begin, end
            begin, end = a, b
        if begin >= 0:
            yield begin, end

    def score(part: str) -> float:
        n = len(part)
        w = min(25, n)
        most = count = part.count("G", 0, w)
        for i in range(n - w):
            count += (part[i + w] == "G") - (part[i] == "G")
            most = max(most, count)
        return half_up(most / w * (n / w))

    def run(seq: str, lo: int, hi: int) -> Iterator[tuple]:
        for begin, end in windows(seq, lo, hi):
            part = seq[begin:end]
            hits = []
            for name, i, p in compiled:
                for m in p.finditer(part):
                    a, b = m.span()
                    if b - a >= 8:
                        hits.append((begin + a, begin + b, name, score(m[0]), i))
            yield from _free_of_islands(hits, lambda h: (-h[3], h[4], h[0] - h[1])) if choose else hits

    return run


def _places(s: np.ndarray, letter: str, n: int) -> np.ndarray:
    """Where n times the letter stands, as marks."""
    return _all_of(s == ord(letter), n)


def i_motifs(tracts: dict[str, str], with_a: dict[str, str], relaxed: str, far: tuple[str, ...]) -> Callable[[list[Row]], Iterator[tuple]]:
    """Matches on the core and its reverse complement: (row, start, end, strand, pattern, raw score), those of ``tracts`` chosen among themselves, and so those ``with_a``.

    Patterns are tried only where letters allow: those of tracts in chains of CCC at most 15 letters apart that are long
    enough for four of them, fixed ones in rows where all their runs of letters stand at their distances.
    """
    near, long = 3 + 12, 3 * (3 + 1)
    chained = [(name, anchored(re.compile(p), _head(p))) for name, p in tracts.items()]
    fixed = []
    for name, p in with_a.items():
        runs, size = [], 0
        for letter, n in re.findall(r"([ACGT]|\[ACGT\])\{(\d+)\}", p):
            runs += [(letter, size, int(n))] if len(letter) == 1 else []
            size += int(n)
        turned = [(x.translate(_TURN), size - at - n, n) for x, at, n in runs]
        fixed.append((name, anchored(re.compile(p), _head(p)), {"+": runs, "-": turned}))
    cs, long_a, long_c = re.compile("C{2,}"), re.compile("A{3,}"), re.compile("C{3,}")

    def tract_score(part: str, name: str) -> float:
        found = cs.findall(part)
        n, k = len(part), len(found)
        return 0.0 if n < 12 or k < 3 else half_up(min(1.0, sum(map(len, found)) / n + min(0.4, 0.12 * (k - 2))))

    def a_score(part: str, name: str) -> float:
        both = 0.5 if long_a.search(part) and len(long_c.findall(part)) >= 3 else 0.0
        return half_up(min(1.0, min(0.6, (part.count("A") + part.count("C")) / len(part) * 0.8) + both + (0.12 if name in far else 0.25)))

    def tries(s: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[dict[int, list], dict[int, list]]:
        """By row: (strand, begin, end) of chains, in stacked places; (strand, name, finder) of fixed patterns."""
        chains: dict[int, list] = {}
        rows: dict[int, list] = {}
        for strand, letter in (("+", "C"), ("-", "G")):
            place = np.flatnonzero(_places(s, letter, 3))
            if len(place):
                last = np.append(np.flatnonzero(np.diff(place) > near), len(place) - 1)
                begin, end = place[np.append(0, last[:-1] + 1)], place[last]
                for j in np.flatnonzero(end - begin >= long).tolist():
                    chains.setdefault(int(own[begin[j]]), []).append((strand, int(begin[j]), int(end[j]) + 3))
            for name, find, runs in fixed:
                marks = None
                for x, offset, n in runs[strand]:
                    here = _places(s, x, n)[offset:]
                    marks = here if marks is None else marks[: len(here)] & here[: len(marks)]
                place = np.flatnonzero(marks)
                for i in np.unique(own[place + runs[strand][0][1]] if len(place) else place).tolist():
                    rows.setdefault(i, []).append((strand, name, find))
        return chains, rows

    def run(rows: list[Row]) -> Iterator[tuple]:
        if not rows:
            return
        s, at, own = _stacked(rows, 0, 0, 64)  # more than a chain's step or a fixed pattern reaches over
        chains, others = tries(s, at, own)
        for i in sorted({*chains, *others}):
            seq, lo, hi, *_ = rows[i]
            texts, n = {"+": seq[lo:hi]}, hi - lo
            texts["-"] = texts["+"].translate(_TURN)[::-1]

            def found(strand: str, name: str, find: Callable, score: Callable, begin: int, end: int, least: int) -> Iterator[tuple]:
                for m in find(texts[strand], begin, end):  # noqa: B023  used at once
                    a, b = m.span()
                    if b - a >= least:
                        span = (lo + a, lo + b) if strand == "+" else (lo + n - b, lo + n - a)  # noqa: B023
                        yield (*span, strand, name, score(m[0], name))

            hits = []
            for strand, a, b in chains.get(i, ()):
                a, b = a - int(at[i]) - lo, b - int(at[i]) - lo
                a, b = (a, b) if strand == "+" else (n - b, n - a)
                hits += [hit for name, find in chained for hit in found(strand, name, find, tract_score, a, b, 10)]
            more = [hit for strand, name, find in others.get(i, ()) for hit in found(strand, name, find, a_score, 0, n, 0)]
            for mine in (hits, more):
                for hit in _free_of_islands(mine, lambda h: (-h[4], h[3] == relaxed, h[0] - h[1], h[2] == "-")):
                    yield i, *hit

    return run


def phased_tracts(rows: list[Row]) -> Iterator[tuple]:
    """(row, start, end, n, off, lead, tail, open) of chains of A and T tracts whose centres are 9.9 to 11.1 bases apart.

    off: the sum of the steps' distances from 11; lead and tail: from the start to the first centre, from the last one to the
    end. A chain at a core's border may go on in the next tile (open) and is given whatever its length; of others, those of three and more.
    """
    s, at, own = _stacked(rows, 0, 0, 1)
    edge = np.flatnonzero(s[1:] != s[:-1]) + 1  # a gap ends every run
    start, end = edge[:-1], edge[1:]
    tract = (end - start >= 3) & ((s[start] == 65) | (s[start] == 84)) if len(edge) else np.zeros(0, bool)
    start, end = start[tract], end[tract]
    if not len(start):
        return
    center, row = start + (end - start - 1) / 2.0, own[start]
    step = np.diff(center)
    begins = row[1:] != row[:-1]
    first = np.append(0, np.flatnonzero(begins | (step < 9.9) | (step > 11.1)) + 1)
    last = np.append(first[1:], len(center)) - 1
    lo, hi, opens, ends = (np.array(c) for c in zip(*((lo, hi, opens and lo == 0, ends and hi == len(seq)) for seq, lo, hi, opens, ends in rows), strict=True))
    at_first, at_last = np.append(True, begins)[first], np.append(begins, True)[last]
    of = row[first]
    is_open = (at_first & ~opens[of] & (center[first] - at[of] - lo[of] < 12)) | (at_last & ~ends[of] & (hi[of] - center[last] + at[of] < 12))
    off = np.append(0, np.cumsum(np.abs(step - 11.0)))  # whole halves, so exact
    for j in np.flatnonzero(is_open | (last - first >= 2)).tolist():
        a, b, i = first[j], last[j], int(of[j])
        yield i, int(start[a] - at[i]), int(end[b] - at[i]), int(b - a + 1), float(off[b] - off[a]), float(center[a] - start[a]), float(end[b] - center[b]), bool(is_open[j])


@functools.lru_cache(1 << 16)
def primitive(unit: str) -> str:
    n = len(unit)
    return next((unit[:k] for k in range(1, n // 2 + 1) if (unit[:k] * (n // k + 1))[:n] == unit), unit)


def slippage_score(length: int, unit: str, copies: int, purity: float, gc: float) -> float:
    """Energy of slippage on 1 to 3, from length, copies, size of the unit, purity and GC share."""
    k = len(unit)
    size = 1.0 if 2 <= k <= 4 else 0.75 if k in (1, 5, 6) else 0.5 if k <= 20 else 0.3
    sums = 0.30 * min(1, math.log(length, 25) / 2) + 0.30 * min(1, math.log(copies, 4) / 2) + 0.15 * size + 0.15 * purity**2 + 0.10 * (0.6 + 0.4 * gc)
    return round(min(3.0, max(1.0, (1 + 2 * min(1.0, sums)) * (1.15 if unit in UNITS else 1.0))), 3)


def least_run(k: int) -> int:
    """Least run of places that equal the one k on: two copies, and 20 bases."""
    return (max(2, -(-20 // k)) - 1) * k


def repeat_runs(seq: str, lo: int, hi: int, whole: bool) -> list[tuple[int, int, int, str, bool]]:
    """(start, end, k, unit, open) of the runs of places in [lo, hi) whose letter stands again k places on.

    ``whole``: [lo, hi) is the whole text. Else runs at its borders are open: they may go on in the next tile, so short ones count too.
    """
    s = np.frombuffer(seq.encode(), np.uint8)
    n, out = len(s), []
    for k in range(1, min(UNIT, n // 2 - 1 if whole else n - lo - 1) + 1):
        until = min(hi, n - k)
        same = np.concatenate([[False], s[lo:until] == s[lo + k : until + k], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2] + lo, edge[1::2] + lo
        is_open = np.zeros(len(begin), bool) if whole else ((begin == lo) & (lo > 0)) | ((end == hi) & (hi < n))
        for i in np.flatnonzero(is_open | (end - begin >= least_run(k))).tolist():
            a = int(begin[i])
            out.append((a, int(end[i]), k, seq[a : a + k], bool(is_open[i])))
    return out


def tandem(a: int, run: int, unit: str) -> tuple[int, int, int, str, int, float, float] | None:
    """(start, -primitive unit's length, end, primitive unit, copies, purity, times) of a run, if it is a tandem repeat."""
    if "N" in unit:
        return None
    k, base = len(unit), primitive(unit)
    copies, b = run // k + 1, len(base)
    n = k * copies
    times = n / b
    if n < 20 or times < (6 if b <= 4 else 2):
        return None
    purity = 1.0 if k % b == 0 else sum(map(operator.eq, unit * copies, base * (n // b + 1))) / n
    return (a, -b, a + n, base, copies, purity, times) if purity >= 0.9 else None


def tandem_row(found: tuple[int, int, int, str, int, float, float], unit: str) -> tuple:
    a, _, end, base, copies, purity, times = found
    gc = (unit.count("G") + unit.count("C")) * copies / (end - a)
    return a, end, "STR" if len(base) <= 9 else "Direct Repeat", slippage_score(end - a, base, copies, purity, gc), {"unit": base, "copy_number": f"{times:g}", "purity": f"{purity:g}"}


#: A run of this many places or more may be seen in part only by a tile; it is longer than any least run.
LONG = 128


def _all_of(same: np.ndarray, n: int) -> np.ndarray:
    """Places from which on n places hold, by halves."""
    w = 1
    while 2 * w <= n:
        same, w = same[:-w] & same[w:], 2 * w
    return same[: w - n] & same[n - w :] if w < n else same


def stacked_runs(rows: list[Row], whole: bool) -> Iterator[tuple[int, int, int, int, str, bool]]:
    """(row, start, end, k, unit, open): ``repeat_runs`` of all rows at once, but without runs that are too short as a whole.

    A tile sees the whole of a run of less than ``LONG`` places, which is given where it starts, behind the core's end too.
    Of longer ones each tile gives its part. Rows that show less than that around their core are looked at one by one.
    """
    is_whole = [whole or (lo == 0 and hi == len(seq)) for seq, lo, hi, *_ in rows]
    fits = [seq.isascii() and (w or ((opens or lo >= LONG) and (ends or len(seq) - hi >= LONG + UNIT))) for (seq, lo, hi, opens, ends), w in zip(rows, is_whole, strict=True)]
    for i, (seq, lo, hi, *_) in enumerate(rows):
        if not fits[i]:
            yield from ((i, *r) for r in repeat_runs(seq, lo, hi, is_whole[i]))
    index = [i for i, fit in enumerate(fits) if fit]
    if not index:
        return
    s, at, _ = _stacked([rows[i] for i in index], LONG, LONG + UNIT, UNIT)
    other = np.where(s == 0, np.uint8(1), s)  # a gap equals nothing
    first = np.array([max(0, rows[i][1] - LONG) for i in index]) + at
    seen = [min(len(rows[i][0]), rows[i][2] + LONG) for i in index]
    looked = np.zeros(len(s), bool)
    for a, b in zip(first.tolist(), (np.array(seen) + at).tolist(), strict=True):
        looked[a:b] = True
    for k in range(1, UNIT + 1):
        if len(s) <= k:
            break
        place = _marked(_all_of((s[:-k] == other[k:]) & looked[:-k], least_run(k)))
        if not len(place):
            continue
        new = np.flatnonzero(np.diff(place, prepend=-9) > 1)
        begin, end = place[new], place[np.append(new[1:], len(place)) - 1] + least_run(k)
        row = np.searchsorted(first, begin, "right") - 1
        for j, a, b in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist(), strict=True):
            i = index[j]
            seq, lo, hi, *_ = rows[i]
            if is_whole[i]:
                if k <= len(seq) // 2 - 1:
                    yield i, a, b, k, seq[a : a + k], False
            elif b - a < LONG:
                if lo <= a < hi:
                    yield i, a, b, k, seq[a : a + k], False
            elif (a := max(a, lo)) < (b := min(b, hi)):
                yield i, a, b, k, seq[a : a + k], (a == lo and lo > 0) or (b == hi and hi < len(seq))


def slipped(seq: str) -> list[tuple]:
    """Tandem repeats of a whole sequence."""
    return [hit[1:] for hit in slipped_rows([(seq, 0, len(seq), True, True)])]


def slipped_rows(rows: list[Row]) -> Iterator[tuple]:
    """Tandem repeats of whole sequences: short ones of at least six copies of up to four bases, longer units of two."""
    found: dict[int, list] = {}
    for i, a, end, k, unit, _ in stacked_runs(rows, True):
        if t := tandem(a, end - a, unit):
            found.setdefault(i, []).append((t, k, unit))
    for i, mine in found.items():
        mine.sort(key=lambda r: (*r[0][:2], r[1]))
        for j in first_free([(t[0], t[2]) for t, *_ in mine]):
            yield i, *tandem_row(mine[j][0], mine[j][2])


def placed(seqs: DataFrame, kernel: Callable[[list[Row]], Iterable[tuple]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """seq_id, start, end and the further columns that a kernel gives of sequences or tiles."""
    return _apply(seqs, kernel, {"start": pa.int64(), "end": pa.int64()} | kinds, f"seq_id string, start long, end long, {schema}")


def phased_tracts_of(seqs: DataFrame) -> DataFrame:
    """(seq_id, start, end, n, off, lead, tail, open) of sequences or tiles, as ``phased_tracts`` gives them."""
    kinds = {"start": pa.int64(), "end": pa.int64(), "n": pa.int64(), "off": pa.float64(), "lead": pa.float64(), "tail": pa.float64(), "open": pa.bool_()}
    return _apply(seqs, phased_tracts, kinds, "seq_id string, start long, end long, n long, off double, lead double, tail double, open boolean")


def settled_runs(rows: list[Row]) -> Iterator[tuple]:
    """(row, start, end, k, unit, open, taken): of the runs of tiles' cores the tandem repeats that are taken, the open ones, and those that may overlap what other tiles see."""
    runs, hits = [], []
    for run in stacked_runs(rows, False):
        i, a, end, k, unit, is_open = run
        if is_open or (t := tandem(a, end - a, unit)) is not None:
            runs.append(run)
            hits.append((i, a, end + UNIT, 0, k, True) if is_open else (i, a, t[2], t[1], k, False))
    if not runs:
        return
    row, start, end, base, k, is_open = (np.array(c) for c in zip(*hits, strict=True))
    taken, rest = _settled(rows, row, start, end, (start, base, k), LONG + UNIT, 0, is_open)
    yield from ((*runs[j], True) for j in taken.tolist())
    yield from ((*runs[j], False) for j in rest.tolist())


def repeat_runs_of_tiles(tiles: DataFrame) -> DataFrame:
    """(seq_id, start, end, k, unit, open, taken): the runs of the tiles' cores, as ``settled_runs`` gives them."""
    kinds = {"start": pa.int64(), "end": pa.int64(), "k": pa.int32(), "unit": pa.string(), "open": pa.bool_(), "taken": pa.bool_()}
    return _apply(tiles, settled_runs, kinds, "seq_id string, start long, end long, k int, unit string, open boolean, taken boolean")


def tandem_repeats(runs: DataFrame) -> DataFrame:
    """Tandem repeats of runs (seq_id, start, end, k, unit), with the primitive unit's length and k, by which the first of several is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32())
        for batch in batches:
            rows = []
            for name, a, end, k, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (found := tandem(a, end - a, unit)) is not None:
                    row = tandem_row(found, unit)
                    rows.append((name, *row[:4], list(row[4].items()), -found[1], k))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["seq_id", "start", "end", "subclass", "raw_score", "attrs", "base", "k"])

    return runs.select("seq_id", "start", "end", "k", "unit").mapInArrow(run, f"{ROWS}, base int, k int")


#: What a kernel of arms finds: stacked letters, each row's first place there, and rows, left starts, arms and loops in order.
Arms = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _arms(rows: list[Row], complement: bool, loops: range, longest: int, least: int) -> Arms:
    """Seeds of six bases that start in a row's core and their (complemented) mirror image, grown outwards to ``least`` bases or more.

    A seed is the inner end of its arm, so each comes once. Left starts are stacked places.
    """
    s, at, own = _stacked(rows, longest, 2 * longest, 2 * len(loops))
    code = CODE[s]
    want = np.where(code < 4, 3 - code, 254).astype(np.uint8) if complement else np.where(code < 4, code, 254).astype(np.uint8)
    mine = own >= 0
    left, loop = [], []
    for n in loops:
        m = len(code) - 12 - n + 1
        if m <= 0:
            break
        ok = mine[:m] & (code[:m] == want[11 + n : 11 + n + m])
        for t in range(1, 6):
            ok &= code[t : t + m] == want[11 + n - t : 11 + n - t + m]
        left.append(_marked(ok))
        loop.append(np.full(len(left[-1]), n))
    left = np.concatenate(left) if left else np.zeros(0, np.int64)
    loop = np.concatenate(loop) if loop else np.zeros(0, np.int64)
    row, right, arm = own[left], left + 12 + loop, np.full(len(left), 6)
    grows = np.arange(len(left))
    for _ in range(longest - 6):
        grows = grows[code[left[grows] - 1] == want[right[grows]]]
        if not len(grows):
            break
        left[grows] -= 1
        right[grows] += 1
        arm[grows] += 1
    far = np.flatnonzero(arm >= least)
    far = far[np.lexsort((loop[far], arm[far], left[far], row[far]))]
    return s, at, row[far], left[far], arm[far], loop[far]


def _marked(marks: np.ndarray) -> np.ndarray:
    """Places of few marks, eight looked at together."""
    n = len(marks) // 8 * 8
    some = np.flatnonzero(marks[:n].view(np.uint64))
    near = (some[:, None] * 8 + np.arange(8))[marks[:n].reshape(-1, 8)[some]]
    return np.concatenate([near, n + np.flatnonzero(marks[n:])])


#: Rounds of _free; what is left then (one island with many hits in a row) is taken one after another.
_ROUNDS = 24


def _free(row: np.ndarray, start: np.ndarray, end: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Indexes of the hits that, taken in order (by the first key, then the next ..), overlap none taken before in their row.

    In each round the first of every island of overlapping hits is taken, and those that overlap it go.
    """
    if not len(row):
        return np.zeros(0, np.int64)
    far = (int(end.max()) - min(0, int(start.min())) + 1) * row.astype(np.int64)
    rank = np.empty(len(row), np.int64)
    rank[np.lexsort(order[::-1])] = np.arange(len(row))
    at = np.argsort(start + far, kind="stable")
    s, e, rank = (start + far)[at], (end + far)[at], rank[at]
    taken = []
    for _ in range(_ROUNDS):
        first = np.append(0, np.flatnonzero(s[1:] >= np.maximum.accumulate(e)[:-1]) + 1)
        island = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
        best = np.flatnonzero(rank == np.minimum.reduceat(rank, first)[island])
        taken.append(at[best])
        left = (e <= s[best][island]) | (s >= e[best][island])
        at, s, e, rank = at[left], s[left], e[left], rank[left]
        if not len(at):
            break
    else:
        by_rank = np.argsort(rank)
        taken.append(at[by_rank[first_free(list(zip(s[by_rank].tolist(), e[by_rank].tolist(), strict=True)))]])
    return np.sort(np.concatenate(taken))


def _settled(rows: list[Row], row: np.ndarray, start: np.ndarray, end: np.ndarray, order: tuple[np.ndarray, ...], left: int, right: int, loose: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hits that are taken, hits whose island other tiles may have a part in): islands are settled where a tile sees the whole of them.

    Other tiles' hits reach less than ``left`` letters into a core, and begin ``right`` letters before its end or later. An
    island with a ``loose`` row isn't settled.
    """
    if not len(row):
        return row, row
    lowest = np.array([-1 << 60 if opens and lo == 0 else lo + left for _, lo, _, opens, _ in rows])
    highest = np.array([1 << 60 if ends and hi == len(seq) else hi - right for seq, _, hi, _, ends in rows])
    far = (int(end.max()) - min(0, int(start.min())) + 1) * row.astype(np.int64)
    at = np.argsort(start + far, kind="stable")
    s, e = (start + far)[at], (end + far)[at]
    first = np.append(0, np.flatnonzero(s[1:] >= np.maximum.accumulate(e)[:-1]) + 1)
    island = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
    over = (start[at] < lowest[row[at]]) | (end[at] > highest[row[at]])
    if loose is not None:
        over |= loose[at]
    is_open = np.empty(len(at), bool)
    is_open[at] = np.logical_or.reduceat(over, first)[island]
    closed = np.flatnonzero(~is_open)
    return closed[_free(row[closed], start[closed], end[closed], tuple(k[closed] for k in order))], np.flatnonzero(is_open)


@functools.lru_cache(1 << 16)
def _stacking(arm: str) -> float:
    return sum(STACKING[arm[j : j + 2]] for j in range(len(arm) - 1))


_STACKED = np.zeros((4, 4), np.int64)
for _pair, _value in STACKING.items():
    _STACKED[CODE[ord(_pair[0])], CODE[ord(_pair[1])]] = round(100 * _value)

#: Of the hits of arms: row, start, end, raw score, arm, loop, and the keys by which overlapping ones are taken.
_Hits = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]


def _inverted(rows: list[Row]) -> _Hits:
    """Inverted repeats of stable arms around a short loop; best, longest, first, longest arm first."""
    s, at, row, left, arm, loop = _arms(rows, True, range(13), 50, 8)
    code = CODE[s]
    pairs = np.where((code[:-1] < 4) & (code[1:] < 4), _STACKED[code[:-1] & 3, code[1:] & 3], 0)
    sums = np.concatenate([[0], np.cumsum(pairs)])
    around = np.array([4.0, *(1.75 + 0.6 * math.log(n) for n in range(1, 13))])
    energy = (sums[left + arm - 1] - sums[left]) / 100 + around[loop]
    near = np.flatnonzero(energy <= -5.0 + 1e-6)
    row, left, arm, loop, energy = row[near], left[near], arm[near], loop[near], energy[near]
    raw = np.round(np.minimum(1.0, -energy / 20.0), 6)
    keep = np.ones(len(row), bool)
    millionths = -energy / 20.0 * 1e6
    for j in np.flatnonzero((energy > -5.0 - 1e-6) | (np.abs(millionths - np.floor(millionths) - 0.5) < 1e-4)).tolist():  # as the sum of doubles in order has it
        exact = _stacking(s[left[j] : left[j] + arm[j]].tobytes().decode()) + around[loop[j]]
        keep[j], raw[j] = exact <= -5.0, round(min(1.0, -exact / 20.0), 6)
    row, start, arm, loop, raw = row[keep], (left - at[row])[keep], arm[keep], loop[keep], raw[keep]
    end = start + 2 * arm + loop
    return row, start, end, raw, arm, loop, (-raw, start - end, start, -arm, loop)


@functools.lru_cache(1 << 16)
def _mirror_score(arm: int, purines: int, loop: int) -> float:
    purity, odd = max(purines, arm - purines) / arm, min(purines, arm - purines)
    return round(1 + 2 * min(1.0, 0.35 * min(1, math.log(arm) / math.log(35)) + 0.20 * math.exp(-0.4 * loop) + 0.30 * (purity - 0.8) / 0.2 + 0.15 / (1 + odd)), 3)


def _mirrored(rows: list[Row]) -> _Hits:
    """Mirror repeats of arms nine tenths purine or pyrimidine; longest arm, shortest loop, first."""
    s, at, row, left, arm, loop = _arms(rows, False, range(9), 100, 10)
    sums = np.concatenate([[0], np.cumsum((s == 65) | (s == 71))])
    purines = sums[left + arm] - sums[left]
    pure = np.flatnonzero(np.maximum(purines, arm - purines) / arm >= 0.9)
    row, left, arm, loop, purines = row[pure], left[pure], arm[pure], loop[pure], purines[pure]
    kind, of = np.unique((arm * 128 + purines) * 16 + loop, return_inverse=True)
    raw = np.array([_mirror_score(k >> 11, k >> 4 & 127, k & 15) for k in kind.tolist()])[of]
    start = left - at[row]
    return row, start, start + 2 * arm + loop, raw, arm, loop, (-arm, loop, start)


def _arm_rows(hits: _Hits, some: np.ndarray, subclass: str, *more: object) -> Iterator[tuple]:
    row, start, end, raw, arm, loop, _ = hits
    for i, a, b, x, n, gap in zip(*(c[some].tolist() for c in (row, start, end, raw, arm, loop)), strict=True):
        yield i, a, b, subclass, x, {"arm": str(n), "loop": str(gap)}, *more


def _taken_arms(find: Callable[[list[Row]], _Hits], subclass: str) -> Callable[[list[Row]], Iterator[tuple]]:
    """Of whole sequences the hits that are taken."""

    def run(rows: list[Row]) -> Iterator[tuple]:
        row, start, end, *_, order = hits = find(rows)
        yield from _arm_rows(hits, _free(row, start, end, order), subclass)

    return run


def _settled_arms(find: Callable[[list[Row]], _Hits], subclass: str, left: int, right: int) -> Callable[[list[Row]], Iterator[tuple]]:
    """Of tiles the hits that are taken, and open ones."""

    def run(rows: list[Row]) -> Iterator[tuple]:
        row, start, end, *_, order = hits = find(rows)
        taken, is_open = _settled(rows, row, start, end, order, left, right)
        yield from _arm_rows(hits, taken, subclass, False)
        yield from _arm_rows(hits, is_open, subclass, True)

    return run


# a seed of six begins in the core, its arms grow outwards: to the left by longest - 6, to the right by 6, the loop and the longest arm
cruciform = _taken_arms(_inverted, "Cruciform forming IRs")
cruciform_of_tile = _settled_arms(_inverted, "Cruciform forming IRs", 6 + 12 + 50, 50 - 6)
mirror = _taken_arms(_mirrored, "H-DNA")
mirror_of_tile = _settled_arms(_mirrored, "H-DNA", 6 + 8 + 100, 100 - 6)
