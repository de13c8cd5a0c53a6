"""Alignment of two tokenizers' tokens: groups of tokens that cover the same bytes, and how often ids stand in one group.

Pieces. Every text is cut at single spaces between two characters that are no white space. No token of either vocabulary
reaches across such a place (``Aligner`` checks the second vocabulary's entries), so tokens and groups of a text are those
of its pieces, one after another, and each different piece of a block is encoded and aligned once.

Groups. The B tokens are a static interval index: sorted starts and ends. Each A token stabs it by bisection and gets the
run of B tokens that it overlaps. A gap between two A tokens whose runs share no B token is spanned by no token of
either side: there a group ends.

Counts. A task packs the documents of about ``BLOCK`` bytes into one block: the pieces of each document, the id pairs of
each piece, and for each different id pair the number of the block's documents that link it. Only these pairs are shuffled,
one row for a block and pair, not one for each document; their corpus-wide counts come back to the block, which then adds up
its documents. The highest count of an A id is one number for each entry of A's vocabulary, which bounds that broadcast.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, slices, table
from .tokenizing import CHUNK, SOLID, SPACE, byte_letters, load

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a block, and of the longest piece that is encoded together with others.
BLOCK, SHORT = 3 << 20, 256
#: A group of more links is counted by its different ids.
MANY = 1 << 16

def stabbed(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run [first, last) of the index's intervals that overlap each [begin, end), by bisection."""
    return np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first A token and the first B token of each group of two token rows over the same bytes."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    first, last = stabbed(b_ends - b_sizes, b_ends, a_ends - a_sizes, a_ends)
    spanned = first[1:] < last[:-1]  # a B token of the A token before goes on: it spans the gap
    open_a = np.concatenate([np.zeros(min(1, len(first)), np.int64), np.flatnonzero(~spanned) + 1])
    return open_a, first[open_a]


class Aligner:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_name: str = A_NAME, b_name: str = B_NAME):
        import public_tokenizers
        from tokenizers import Tokenizer

        a, self.b = load(a_name), load(b_name).model
        self.quick = getattr(a, "encoding", None)
        self.library = Tokenizer.from_file(str(a_name if "/" in a_name else public_tokenizers.path(a_name)))
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        byte = byte_letters()
        self.a_bytes = {i: bytes(byte[c] for c in token) for token, i in self.library.get_vocab().items() if all(c in byte for c in token)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = dict(enumerate(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)))
        self.sizes = [np.zeros(max(known) + 1, np.int64) for known in (self.a_bytes, self.b_bytes)]
        for size, known in zip(self.sizes, (self.a_bytes, self.b_bytes), strict=True):
            size[list(known)] = [len(x) for x in known.values()]
        # pieces end at single spaces only if no entry goes on behind one
        self.cuts = self.quick is not None and not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i)))
        # each id as text with what follows it: , or | for A; , or ; (a group's end) or a line feed (a piece's end) for B
        self.shown = np.array([f"{i}{mark}" for size, marks in zip(self.sizes, (",|", ",;\n"), strict=True) for mark in marks for i in range(len(size))], object)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides of space+text; None if the bytes of one differ from it."""
        whole = f" {text}"
        a = self.quick.encode_ordinary(whole) if self.quick is not None and len(text) <= CHUNK else self.library.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        same = text and b"".join([self.a_bytes[i] for i in a]) == whole.encode() == b"".join([self.b_bytes[i] for i in b])
        return (a, b) if same else None

    def encode_pieces(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of all pieces of either side, one after another, and the pieces whose bytes are given back.

        Short pieces are encoded many at a time, with the single spaces between them at which they were cut. A text's first
        piece may begin with white space and its last one end with it; a space beside it would join it, so these stand alone.
        """
        ids: tuple[list[np.ndarray], list[np.ndarray]] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        good = np.ones(len(pieces), bool)

        def add(lo: int, hi: int) -> None:
            found = self.encode(" ".join(pieces[lo:hi]))
            if found is not None:
                for side, new in zip(ids, found, strict=True):
                    side.append(np.array(new, np.int64))
            elif hi - lo == 1:
                good[lo] = False
            else:
                for middle in (((lo, (lo + hi) // 2)), ((lo + hi) // 2, hi)):
                    add(*middle)

        at, held = 0, 0
        for k, piece in enumerate(pieces):
            alone = len(piece) > SHORT or SOLID.match(piece) is None
            if k > at and (held + len(piece) >= CHUNK or not self.cuts or alone):
                add(at, k)
                at, held = k, 0
            held += len(piece) + 1
            if alone:  # nothing need be known of where it ends
                add(k, k + 1)
                at, held = k + 1, 0
        if at < len(pieces):
            add(at, len(pieces))
        return [np.concatenate(side) for side in ids], good


_DOC = ("n_a", "n_b", "n_groups", "n_links")
_LISTS = {**dict.fromkeys(_DOC, "long"), "groups_sha256": "string", "pairs": "long", "docs": "long"}
_TYPES = {"long": pa.int64(), "string": pa.string()}
#: Arrays that travel squeezed, and whether by their steps: they rise, or rise for a while.
_SQUEEZED = {"piece_ends": True, "pieces": True, "times": False, "pair_ends": True, "piece_pairs": False, "piece_links": False}


def _squeezed(x: np.ndarray, steps: bool) -> bytes:
    """Whole numbers byte by byte (all first bytes, all second ones ...), compressed."""
    import zstandard

    x = np.diff(x, prepend=0) if steps else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueezed(data: bytes, steps: bool) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(raw.T).view("<i8").ravel()
    return np.cumsum(x) if steps else x


@cache
def _aligner(a_name: str, b_name: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(a_name, b_name)


def _links(a: np.ndarray, b: np.ndarray, starts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, links) of all groups; groups of very many links by their different ids."""
    many = counts[0] * counts[1] > MANY
    n = np.where(many, 0, counts[1])
    per_a = np.repeat(n, counts[0])
    place = np.repeat(np.repeat(starts[1], counts[0]) - np.concatenate([[0], np.cumsum(per_a)[:-1]]), per_a) + np.arange(per_a.sum())
    out = [(np.repeat(np.repeat(np.arange(len(n)), counts[0]), per_a), np.repeat(a, per_a) << 32 | b[place], np.ones(len(place), np.int64))]
    for g in np.flatnonzero(many).tolist():
        (x, m), (y, k) = (np.unique(side[s[g] : s[g] + c[g]], return_counts=True) for side, s, c in zip((a, b), starts, counts, strict=True))
        out.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), (m[:, None] * k).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(aligner: Aligner, texts: list[str]) -> dict[str, list | np.ndarray]:
    """The block of some documents."""
    numbers: dict[str, int] = defaultdict(itertools.count().__next__)
    rows: list[np.ndarray] = []
    for text in texts:
        found = (SPACE.split(text) if aligner.cuts else [text]) if text else []
        rows.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
    pieces = list(numbers)
    (a, b), good = aligner.encode_pieces(pieces)
    if not good.all():  # bytes of a piece differ: then those of the whole text decide
        bad = [k for k, r in enumerate(rows) if not good[r].all()]
        whole = [k for k in bad if aligner.encode(texts[k]) is not None]
        for k in bad:
            rows[k] = np.array([len(pieces) + whole.index(k)], np.int64) if k in whole else np.zeros(0, np.int64)
        for k in whole:
            more = aligner.encode(texts[k])
            a, b, good = np.append(a, more[0]), np.append(b, more[1]), np.append(good, True)
        pieces += [texts[k] for k in whole]
    number = np.cumsum(good) - 1
    rows = [number[r] for r in rows]
    n_pieces = int(good.sum())
    stops = np.cumsum([len(p.encode()) + 1 for p, g in zip(pieces, good.tolist(), strict=True) if g])
    starts = list(groups(aligner.sizes[0][a], aligner.sizes[1][b]))
    counts = [np.diff(np.append(s, len(x))) for s, x in zip(starts, (a, b), strict=True)]
    at = np.cumsum(aligner.sizes[0][a]) - aligner.sizes[0][a]
    owner = np.searchsorted(stops, at[starts[0]], "right")  # the piece of each group
    sizes = np.stack([np.bincount(owner, w, minlength=n_pieces).astype(np.int64) for w in (*counts, np.ones(len(owner)), counts[0] * counts[1])], axis=1)

    # the groups as text, piece by piece
    side = [np.repeat(np.arange(len(owner)), c) for c in counts]
    last = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in side]
    ends_piece = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    base = 2 * len(aligner.sizes[0])
    written = [last[0] * len(aligner.sizes[0]) + a, base + (last[1].astype(np.int64) + (last[1] & ends_piece[side[1]])) * len(aligner.sizes[1]) + b]
    order = np.argsort(np.concatenate([2 * side[0], 2 * side[1] + 1]), kind="stable")
    shown = "".join(aligner.shown[np.concatenate(written)[order]].tolist()).split("\n")
    sums = np.array([sizes[r].sum(axis=0) for r in rows], np.int64).reshape(-1, 4)
    out: dict[str, list | np.ndarray] = {name: sums[:, k] for k, name in enumerate(_DOC)}
    out["groups_sha256"] = [hashlib.sha256(";".join([shown[i] for i in r.tolist()]).encode()).hexdigest() if len(r) else "" for r in rows]
    each = [np.unique(r, return_counts=True) for r in rows]
    size = np.array([len(u) for u, _ in each], np.int64)
    used, times = (np.concatenate([e[k] for e in each]) if each else np.zeros(0, np.int64) for k in (0, 1))
    out |= {"piece_ends": np.cumsum(size), "pieces": used, "times": times}

    in_group, keys, links = _links(a, b, starts, counts)
    pairs, place, often = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")  # frequent pairs first: small numbers are squeezed best
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, place = pairs[order], rank[place]
    held, inverse = np.unique(owner[in_group] * max(1, len(pairs)) + place, return_inverse=True)
    links = np.bincount(inverse, links, minlength=len(held)).astype(np.int64)
    own, place = held // max(1, len(pairs)), held % max(1, len(pairs))
    n_pairs = np.bincount(own, minlength=n_pieces)
    ends = np.cumsum(n_pairs)
    out |= {"pair_ends": ends, "piece_pairs": place, "piece_links": links, "pairs": pairs}
    # documents of the block that hold each pair
    docs = np.zeros(len(pairs), np.int64)
    start = ends - n_pairs
    for k in range(0, len(rows), 256):
        part, doc = used[(lo := int(size[:k].sum())) : (hi := int(size[: k + 256].sum()))], np.repeat(np.arange(len(size[k : k + 256])), size[k : k + 256])
        if hi > lo:
            n = n_pairs[part]
            at = np.repeat(start[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.sort(np.repeat(doc, n) * len(pairs) + place[at])  # np.unique by hashes keeps memory that it took
            both = both[np.append(True, both[1:] != both[:-1])]
            docs += np.bincount(both % len(pairs), minlength=len(pairs))
    out["docs"] = docs
    return out


def align_tokens(df: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a_name: a byte-level .json; b_name: a .model; special strings in texts are plain text. A link is a pair of an A and a B
    token of one group; the count of an id pair is the number of rows that link it. n_best counts the links whose count is
    the highest that their A id has, count_sum adds the counts of all links. Null and empty texts, and texts whose bytes either
    side doesn't give back, have no tokens: zeros and ''. A null id stays null; repeated rows are rows of their own and count
    each; other columns are left out; an empty table gives an empty table. A text longer than ``block`` is a block of its own.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.string()
    typed = df.select(F.col(id_col).alias("id") if id_type == pa.int64() else F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = _aligner(a_name, b_name), TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        size = n = 0

        def packed() -> pa.RecordBatch:
            found = _pack(aligner, texts)
            lists = [pa.array([found[c]], pa.list_(_TYPES[t])) for c, t in _LISTS.items()]
            bodies = [pa.array([_squeezed(found[c], steps)], pa.binary()) for c, steps in _SQUEEZED.items()]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(id_type)), *lists, *bodies], names=["block", "ids", *_LISTS, *_SQUEEZED])

        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and size + len(t or "") > block:
                    yield packed()
                    n += 1
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t or "")
                size += len(t or "")
        if texts:
            yield packed()

    schema = f"block long, ids array<{'long' if id_type == pa.int64() else 'string'}>, " + ", ".join([*(f"{c} array<{t}>" for c, t in _LISTS.items()), *(f"{c} binary" for c in _SQUEEZED)])
    with arrow_rows(spark, 256):  # whole texts, and rows of a megabyte back
        blocks = materialize(typed.mapInArrow(run, schema), row_check=4)
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    with arrow_rows(spark, 2048, read=4):  # a row holds the lists of a block
        counts = materialize(held.groupBy("pair").agg(F.sum("docs").alias("n")))
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # as many rows as A's vocabulary has entries, at most
    known = counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = held.select("block", "place", "pair").join(known, "pair").select("block", "place", "n", "best")
    out_names = ["id", *_DOC, "n_best", "count_sum", "groups_sha256"]

    def add(rows: pa.Table, known: pa.Table) -> pa.Table:
        row = {c: rows.column(c).combine_chunks()[0].values for c in ("ids", "groups_sha256", *_DOC)}
        number = {c: row[c].to_numpy() for c in _DOC} | {c: _unsqueezed(rows.column(c)[0].as_py(), steps) for c, steps in _SQUEEZED.items()}
        n, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        if known.num_rows:
            place = known.column("place").to_numpy()
            n[place], best[place] = known.column("n").to_numpy(), known.column("best").to_numpy()
        links = number["piece_links"]

        def by_doc(of_pair: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(links * of_pair[number["piece_pairs"]])])
            of_piece = np.diff(run[np.concatenate([[0], number["pair_ends"]])])
            run = np.concatenate([[0], np.cumsum(number["times"] * of_piece[number["pieces"]])])
            return np.diff(run[np.concatenate([[0], number["piece_ends"]])])

        return pa.Table.from_arrays([row["ids"], *(pa.array(number[c]) for c in _DOC), pa.array(by_doc(best)), pa.array(by_doc(n)), row["groups_sha256"]], names=out_names)

    left = blocks.drop("pairs", "docs").withColumnRenamed("block", "own")
    sums = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    with arrow_rows(spark, 2048, read=4):
        out = materialize(left.groupBy("own").cogroup(answers.groupBy("block")).applyInArrow(add, f"id {'long' if id_type == pa.int64() else 'string'}, {sums}"))
    return out.select(F.col("id").cast(kind).alias(id_col), *out_names[1:])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level and the piece vocabulary, aligned."""
    return align_tokens(table(spark, sf_dir))
