"""Places of regular expressions and of table k-mers, in Arrow batches; literal words are in automaton."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import multi_pattern_hits  # noqa: F401  also known from here
from .tiling import core, tiled


def repeats_apart(least: int, most: int, gap: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Spans of ``([ATGC]{least,most})(?:[ATGC]{0,gap})\\1``, as the regular expression finds them from left to right: the longest
    word that stands again, at its farthest place. Where words of ``least`` letters stand again is known from their codes, so
    only those places are looked at."""
    reach = most + gap
    digits = np.full(256, 4, np.int64)
    digits[[65, 67, 71, 84]] = range(4)

    def seeds(d: np.ndarray) -> np.ndarray:
        """Places whose first ``least`` letters stand again ``least`` to ``reach`` places on."""
        n = len(d) - least + 1
        if n <= least:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for t in range(least):
            code = code * 4 + (d[t : t + n] & 3)
            known &= d[t : t + n] < 4
        place = np.flatnonzero(known)
        key = np.sort(code[place] * (len(d) + reach + 1) + place)  # by word, then by place
        after = np.searchsorted(key, key + least)
        again = np.zeros(len(key), bool)
        some = after < len(key)
        again[some] = key[after[some]] <= key[some] + reach
        return np.sort(key[again] % (len(d) + reach + 1))

    def spans(text: str) -> Iterator[tuple[int, int]]:
        if not text.isascii():
            text = re.sub(r"[^\x00-\x7f]", "?", text)
        d = digits[np.frombuffer(text.encode(), np.uint8)]
        odd = np.append(np.flatnonzero(d == 4), len(d))
        until = 0
        for p in seeds(d).tolist():
            if p < until:
                continue
            stop = int(odd[np.searchsorted(odd, p)])  # the match has no other letters
            for k in range(min(most, (stop - p) // 2), least - 1, -1):
                at = text.rfind(text[p : p + k], p + k, min(stop, p + 2 * k + gap))
                if at >= 0:
                    until = at + k
                    yield p, until
                    break

    return spans


#: A word, a gap and the word again: thousands of trials for a letter, if it is left to backtracking.
_APART = re.compile(r"\(\[ATGC\]\{(\d+),(\d+)\}\)\(\?:\[ATGC\]\{0,(\d+)\}\)\\2\Z")


#: Copies of one word, so many or more.
_COPIES = re.compile(r"(?:\(\?:([ACGT]+)\)|([ACGT]))\{(\d+),\}\Z")


def copies(word: str, least: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Spans of ``(?:word){least,}``, as the regular expression finds them: the least number is looked for as a text."""
    k, first = len(word), word * least

    def spans(text: str) -> Iterator[tuple[int, int]]:
        at = text.find(first)
        while at >= 0:
            end = at + len(first)
            while text.startswith(word, end):
                end += k
            yield at, end
            at = text.find(first, end)

    return spans


def _finder(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    if (m := _COPIES.match(pattern)) and int(m[3]) > 0:
        return copies(m[1] or m[2], int(m[3]))
    apart = _APART.match(pattern)
    if apart is not None:
        return repeats_apart(*map(int, apart.groups()))
    compiled = re.compile(f"({pattern})")
    return lambda text: (m.span() for m in compiled.finditer(text))


def regex_hits(seqs: DataFrame, patterns: dict[str, str], keys: tuple[str, ...] = ("seq_id",), seq_col: str = "seq", matched: bool = True) -> DataFrame:
    """(keys, pattern_id, start, end, matched): places from 0, half open. The keys name a row. Without ``matched`` its column is left out.

    Each pattern goes over a text once, where the text is; only matches leave the task, and nothing is shuffled. Back
    references count from the group that is put around the pattern.
    """
    named = seqs.select(*keys, F.col(seq_col).alias("_text"))
    names = [*keys, "pattern_id", "start", "end", *(["matched"] if matched else [])]
    schema = named.select(*keys).schema.add("pattern_id", "string").add("start", "long").add("end", "long")
    if matched:
        schema = schema.add("matched", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(name, _finder(p)) for name, p in patterns.items()]
        for batch in batches:
            rows: list[int] = []
            found: list[str] = []
            starts: list[int] = []
            ends: list[int] = []
            parts: list[str] = []

            def out() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                columns = [*(batch.column(k).take(at) for k in range(len(keys))), pa.array(found, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
                return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.string())] if matched else columns, names=names)

            for row in range(batch.num_rows):
                text = batch.column(len(keys))[row].as_py() or ""
                for name, spans in finders:
                    for a, b in spans(text):
                        rows.append(row)
                        found.append(name)
                        starts.append(a)
                        ends.append(b)
                        if matched:
                            parts.append(text[a:b])
                if len(rows) >= 1 << 14:
                    yield out()
                    rows, found, starts, ends, parts = [], [], [], [], []
            yield out()

    return named.mapInArrow(run, schema)


def placed_hits(seqs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """regex_hits, without what is matched, of whole sequences, or of tiles that end at safe places: then ``at`` (the tile's first base) is kept, and places are the sequence's."""
    if not tiled(seqs):
        return regex_hits(seqs, patterns, matched=False)
    hits = regex_hits(core(seqs), patterns, ("seq_id", "at"), matched=False)
    return hits.withColumn("start", F.col("start") + F.col("at")).withColumn("end", F.col("end") + F.col("at"))


def stranded_hits(seqs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Matches on the sequence (or safe tile) and on its reverse complement, in forward coordinates, with the strand."""
    rows = core(seqs) if tiled(seqs) else seqs.withColumn("at", F.lit(0).cast("long"))
    both = rows.select("seq_id", "at", F.length("seq").cast("long").alias("n"), F.explode(F.create_map(F.lit("+"), F.col("seq"), F.lit("-"), F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca")))).alias("strand", "seq"))
    hits = regex_hits(both, patterns, ("seq_id", "at", "n", "strand"))
    minus = F.col("strand") == "-"
    return hits.withColumn("_s", F.col("at") + F.when(minus, F.col("n") - F.col("end")).otherwise(F.col("start"))).withColumn("end", F.col("at") + F.when(minus, F.col("n") - F.col("start")).otherwise(F.col("end"))).withColumn("start", F.col("_s")).drop("_s")


def kmer_hits(seqs: DataFrame, table: list[tuple[str, float]]) -> DataFrame:
    """(seq_id, start, kmer, value) of every place where an entry of the table stands; overlaps count. Of tiles, each gives those that start in its core.

    All k-mers are of one length of at most 12 and of A, C, G and T. Their codes of two bits a base are looked up in an
    array over all codes, for a whole sequence at once; exploding every place into a row to join a small table with would
    make some thousand rows for each hit.
    """
    k = len(table[0][0])
    digits = np.full(256, 255, np.int64)
    digits[[65, 67, 71, 84]] = range(4)
    entry = np.full(4**k, -1, np.int32)
    for i, (word, _) in enumerate(table):
        entry[int("".join(str(digits[ord(x)]) for x in word), 4)] = i
    words, values = np.array([w for w, _ in table]), np.array([v for _, v in table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, found = [], [], []
            for row in range(batch.num_rows):
                i, s, first = (c[row].as_py() for c in batch.columns)
                d = digits[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
                if len(d) < k:
                    continue
                word, code, size, done = (d & 3).astype(np.int32), None, 1, 0  # codes of 1, 2, 4 .. letters, put together to those of k
                while size <= k:
                    if k & size:
                        part = word[done:]
                        code, done = part if code is None else (code[: len(part)] << 2 * size) + part, done + size
                    word, size = (word[:-size] << 2 * size) + word[size:], 2 * size
                hit = entry[code]
                if (odd := np.cumsum(np.append(0, d > 3)))[-1]:
                    hit[odd[k:] > odd[:-k]] = -1
                at = np.flatnonzero(hit >= 0)
                ids += [i] * len(at)
                starts.append(at + first)
                found.append(hit[at])
            at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            hit = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(words[hit].tolist(), pa.string()), pa.array(values[hit], pa.float64())], names=["seq_id", "start", "kmer", "value"])

    rows = core(seqs, k - 1) if tiled(seqs) else seqs.withColumn("at", F.lit(0).cast("long"))
    return rows.select(F.col("seq_id").cast("string"), "seq", "at").mapInArrow(run, "seq_id string, start long, kmer string, value double")
