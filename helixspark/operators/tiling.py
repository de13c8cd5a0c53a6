"""Sequences cut into tiles in one pass over their letters, and letters of regions by joins with tiles.

A tile: seq_id, n (letters of the whole sequence), at (the place of its first letter, from 0), lo and hi (its core, within
its own letters), seq. The cores of a sequence's tiles follow each other without gaps; around its core a tile shows some
letters of its neighbours. Work on tiles doesn't grow with a sequence, and no text is walked from its start for each piece.

Safe places. Scanning for a pattern from left to right gives other matches when it starts elsewhere, so a tile may only end
where no match of any detector's pattern goes on: ``SAFE`` finds the next such place behind a tile's nominal end. Where there
is none (a run of one repeat over a megabase) the tile goes on until there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a tile's core, and those it shows around: the longest reach of a detector is 2000.
SIZE, CONTEXT = 50_000, 2048
#: A letter that no pattern has; or, in 24 letters without GG and CC, a step from A or G to C or T in the middle. Patterns of
#: G and C tracts allow 20 letters between two tracts at most, 3 behind the last and 9 before the first one; runs of A, of T
#: and the repeats of GAA, TTC, CGG, GGC, CCG and GCC never take that step outside a GG or CC.
SAFE = re.compile(r"(?P<odd>[^ACGT])|(?:(?!GG|CC)[ACGT]){11}[AG](?!CC)[CT](?:(?!GG|CC)[ACGT]){11}")
_BATCH = 4 << 20
TILE = "seq_id string, n long, at long, lo long, hi long, seq string"


def safe_end(seq: str, nominal: int) -> int:
    """The first safe place from ``nominal`` on, else the sequence's end."""
    m = SAFE.search(seq, nominal) if nominal < len(seq) else None
    return len(seq) if m is None else m.start() if m["odd"] else m.start() + 12


def cut(seqs: DataFrame, size: int = SIZE, left: int = 0, right: int = 0, safe: bool = False, tail: bool = False) -> DataFrame:
    """The tiles of sequences (seq_id, seq); cores of ``size`` letters, with ``left`` and ``right`` letters around.

    ``safe``: cores end at safe places of upper-case sequences. ``tail``: a last core of at most size + right letters isn't
    cut again. An empty sequence is one empty tile, a null one none. A task holds one sequence and some tiles of it.
    """

    def cores(seq: str) -> Iterator[tuple[int, int]]:
        n, at = len(seq), 0
        while True:
            end = n if tail and n - at <= size + right else min(n, at + size)
            if safe:
                end = safe_end(seq, end)
            yield at, end
            if end >= n:
                return
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["seq_id", "n", "at", "lo", "hi", "seq"])

        for batch in batches:
            for k in range(batch.num_rows):
                name, seq = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for start, end in cores(seq) if seq is not None else ():
                    begin = max(0, start - left)
                    rows.append((name, len(seq), begin, start - begin, end - begin, seq[begin : end + right]))
                    held += len(rows[-1][5]) + 100
                    if held >= _BATCH:
                        yield out()
                        rows, held = [], 0
        yield out()

    return seqs.select(F.col("seq_id").cast("string"), "seq").mapInArrow(run, TILE)


def tiled(seqs: DataFrame) -> bool:
    """Whether these are tiles, not whole sequences."""
    return "at" in seqs.columns


def core(tiles: DataFrame, more: int = 0) -> DataFrame:
    """Tiles (seq_id, n, at, seq) of their cores alone, with ``more`` letters behind."""
    return tiles.select("seq_id", "n", (F.col("at") + F.col("lo")).alias("at"), F.substr(F.col("seq"), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + more).cast("int")).alias("seq"))


def pieces(seqs: DataFrame, size: int = 4096, reach: int = 2048) -> DataFrame:
    """(seq_id, tile, n, bases): letters from tile * size on, ``reach`` more than ``size`` of them: what ``letters`` looks regions up in."""
    return cut(seqs, size, right=reach).select("seq_id", F.floor(F.col("at") / size).alias("tile"), "n", F.col("seq").alias("bases"))


def letters(regions: DataFrame, tiles: DataFrame, start: Column, end: Column, name: str = "seq", size: int = 4096, reach: int = 2048) -> DataFrame:
    """regions (with seq_id) and the letters [start, end) of their sequences as column ``name``; null where there are none.

    tiles: as ``pieces`` gives them. A region of up to ``reach`` letters lies in the tile in which it starts: one join. Of
    longer ones, each different place is put together from its tiles, and joined back.
    """
    placed = regions.withColumn("_s", F.greatest(F.lit(0).cast("long"), start.cast("long"))).withColumn("_e", end.cast("long")).withColumn("tile", F.floor(F.col("_s") / size))
    own = F.col("tile") * size
    part = lambda to: F.substr(F.col("bases"), (F.greatest(F.col("_s"), own) - own + 1).cast("int"), F.greatest(F.lit(0), to - F.greatest(F.col("_s"), own)).cast("int"))
    held = tiles.select("seq_id", "tile", "bases")
    is_long = F.coalesce(F.col("_e") - F.col("_s") > reach, F.lit(False))
    short = placed.filter(~is_long).join(held, ["seq_id", "tile"], "left").withColumn(name, part(F.col("_e")))
    long = placed.filter(is_long)
    spread = long.select("seq_id", "_s", "_e").distinct().withColumn("tile", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor((F.col("_e") - 1) / size))))
    texts = spread.join(held, ["seq_id", "tile"]).groupBy("seq_id", "_s", "_e").agg(F.array_sort(F.collect_list(F.struct("tile", part(F.least(F.col("_e"), own + size)).alias("p")))).alias("ps"))
    whole = long.join(texts.select("seq_id", "_s", "_e", F.array_join("ps.p", "").alias(name)), ["seq_id", "_s", "_e"], "left")
    columns = [*(c for c in regions.columns if c != name), name]
    return short.select(columns).unionByName(whole.select(columns))
