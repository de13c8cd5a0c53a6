"""Exact ranked lexical search over a clustered index whose documents stand in the order of recursive graph bisection.

Order. Documents and the terms that items ask for are a bipartite graph. A set of documents is halved, and documents change
sides as long as that lowers the sum of ``d * log2(n / (d + 1))`` over the terms and halves (d of a half's n documents have
the term): documents with the same terms gather. The first halvings run over all documents at once, as passes on Spark: a
pass adds up degrees or a histogram of gains, at most ``NODES`` parts x 2 halves x ``BUCKETS`` hashed terms of them, and
equal numbers of both halves move, the highest gains first. The parts are then dealt into shards of about ``SHARD`` postings,
and a task halves its shard on, down to clusters of about ``CLUSTER`` documents. The order saves work and decides nothing.

Index. A shard is one row: its documents cluster by cluster, the postings of a term in that order, and for each term and
cluster that has it a cell with the largest part of a score in it. A shard's own maxima are a small table.

Search. An item's shards are visited by falling bound (the sum of its terms' maxima), in rounds over ever more shards, and
the clusters of a shard again by falling bound. A bound below the k-th best score so far ends the visit: bounds fall, so
nothing behind it can enter. Equal bounds are visited, since a document of an equal score and a smaller doc_id comes first.
Places in the order are mapped back to doc_ids before ties are decided. All parts of a score are whole numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_rows, materialize, slices, table
from .search import _ranges

K = 10
SHARD, CLUSTER = 2_000_000, 64
#: Parts of the distributed halvings, hashed terms they tell apart, moves of each halving (there, and within a shard).
NODES, BUCKETS, MOVES, LOCAL_MOVES = 64, 4096, 2, 4
#: Bytes of the items that one index serves: what the driver and every task hold of them. More items are served in parts.
ITEM_BYTES = 32 << 20
#: By how many times a round has more of an item's shards than all before it.
WIDEN = 8
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BINS = 64


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8, A-Z in lower case."""
    return _TERM.findall((text or "").encode().lower())


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the size of each list."""
    return column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)


def _noise(row: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each row, the same in every task."""
    x = (row.astype(np.uint64) + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)) / 2.0**53


def gains(degrees: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By how much the cost falls when a document of [node, side] with the term leaves for the other side."""

    def cost(d: np.ndarray, n: np.ndarray) -> np.ndarray:
        return d * np.log2(np.maximum(n, 1)[..., None] / (d + 1.0))

    other, n = degrees[:, ::-1], counts.astype(float)
    return (cost(degrees, n) + cost(other, n[:, ::-1]) - cost(np.maximum(degrees - 1, 0), n) - cost(other + 1, n[:, ::-1])).astype(np.float32)


def halved(sizes: np.ndarray, terms: np.ndarray, cluster: int, moves: int = LOCAL_MOVES) -> np.ndarray:
    """The cluster of each document, numbered in the order of the bisection; ``terms`` are numbers below BUCKETS."""
    docs = len(sizes)
    node, owner = np.zeros(docs, np.int64), np.repeat(np.arange(docs), sizes)
    width = int(terms.max()) + 1 if len(terms) else 1
    for _ in range(max(0, math.ceil(math.log2(max(1, docs) / cluster)))):
        order = np.argsort(node, kind="stable")
        count = np.bincount(node)
        rank = np.empty(docs, np.int64)
        rank[order] = np.arange(docs) - np.repeat(np.cumsum(count) - count, count)
        side = (rank >= (count[node] + 1) // 2).astype(np.int64)
        for _ in range(moves):
            key = node * 2 + side
            counts = np.bincount(key, minlength=2 * len(count)).reshape(-1, 2)
            table = gains(np.bincount(key[owner] * width + terms, minlength=counts.size * width).reshape(-1, 2, width), counts).ravel()
            gain = np.bincount(owner, table[key[owner] * width + terms], minlength=docs)
            order = np.lexsort((-gain, key))
            start = np.cumsum(counts.ravel()) - counts.ravel()
            place = np.arange(docs) - start[key[order]]
            left, right = (order[side[order] == s] for s in (0, 1))
            pair_left, pair_right = (node[x] * docs + place[side[order] == s] for s, x in ((0, left), (1, right)))
            _, i, j = np.intersect1d(pair_left, pair_right, assume_unique=True, return_indices=True)
            better = gain[left[i]] + gain[right[j]] > 1e-6
            if not better.any():
                break
            side[left[i[better]]], side[right[j[better]]] = 1, 0
        node = node * 2 + side
    return np.unique(node, return_inverse=True)[1]


class _Moves:
    """The halving of one level: where documents begin, and the moves so far."""

    def __init__(self, level: int, nodes: int):
        self.level, self.nodes = level, nodes
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bins(self, tables: np.ndarray, key: np.ndarray, sizes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(key)), sizes)
        gain = np.bincount(owner, tables.reshape(-1)[key[owner] * BUCKETS + buckets], minlength=len(key))
        return (np.clip(np.round(np.sign(gain) * 4 * np.log2(1 + np.abs(gain))), 1 - _BINS, _BINS - 1) + _BINS).astype(np.int64)

    def sides(self, rows: np.ndarray, node: np.ndarray, sizes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        side = (_noise(rows, self.level) < 0.5).astype(np.int64)
        for k, (tables, cut, share) in enumerate(self.rounds):
            key = node * 2 + side
            b = self.bins(tables, key, sizes, buckets)
            side ^= (b > cut[key]) | ((b == cut[key]) & (_noise(rows, 1000 * (k + 1) + self.level) < share[key]))
        return side

    def add(self, tables: np.ndarray, histogram: np.ndarray) -> None:
        """Equal numbers of both sides move, the highest gains first, as long as two together gain."""
        cut, share = np.full(2 * self.nodes, 2 * _BINS), np.zeros(2 * self.nodes)
        value = np.sign(np.arange(2 * _BINS) - _BINS) * (2.0 ** (np.abs(np.arange(2 * _BINS) - _BINS) / 4) - 1)
        for node in range(self.nodes):
            left = [histogram[2 * node], histogram[2 * node + 1]]
            at, taken = [2 * _BINS - 1] * 2, [0, 0]
            while min(at) >= 0 and value[at[0]] + value[at[1]] > 0:
                free = [int(left[s][at[s]]) - taken[s] for s in (0, 1)]
                step = min(free)
                for s in (0, 1):
                    taken[s] += step
                    cut[2 * node + s], share[2 * node + s] = at[s], taken[s] / max(1, int(left[s][at[s]]))
                    if free[s] == step:
                        at[s], taken[s] = at[s] - 1, 0
        self.rounds.append((tables, cut, share))


def _buckets(terms: np.ndarray) -> np.ndarray:
    return (terms.astype(np.int64) * 2_654_435_761 >> 7) % BUCKETS


def _count(docs: DataFrame, run, size: int) -> np.ndarray:
    """Sums of what the tasks count, by place: BUCKETS x 2 x NODES numbers at most."""
    total = np.zeros(size, np.int64)
    for r in docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    return total


def _sums(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])


def _halve(docs: DataFrame, level: int) -> DataFrame:
    """Every part (node) of the documents as two parts."""
    nodes = 2**level
    moves = _Moves(level, nodes)
    seen = docs.select("row", "node", "terms")

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        terms, sizes = _flat(batch.column(2))
        return batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), sizes, _buckets(terms)

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * nodes * (BUCKETS + 1), np.int64)
        for batch in batches:
            rows, node, sizes, buckets = arrays(batch)
            key = node * 2 + moves.sides(rows, node, sizes, buckets)
            total[: 2 * nodes * BUCKETS] += np.bincount(np.repeat(key, sizes) * BUCKETS + buckets, minlength=2 * nodes * BUCKETS)
            total[2 * nodes * BUCKETS :] += np.bincount(key, minlength=2 * nodes)
        yield _sums(total)

    for _ in range(MOVES):
        total = _count(seen, degrees, 2 * nodes * (BUCKETS + 1))
        tables = gains(total[: 2 * nodes * BUCKETS].reshape(nodes, 2, BUCKETS), total[2 * nodes * BUCKETS :].reshape(nodes, 2))

        def histogram(batches: Iterator[pa.RecordBatch], tables: np.ndarray = tables) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * nodes * 2 * _BINS, np.int64)
            for batch in batches:
                rows, node, sizes, buckets = arrays(batch)
                key = node * 2 + moves.sides(rows, node, sizes, buckets)
                total += np.bincount(key * 2 * _BINS + moves.bins(tables, key, sizes, buckets), minlength=len(total))
            yield _sums(total)

        moves.add(tables, _count(seen, histogram, 2 * nodes * 2 * _BINS).reshape(2 * nodes, 2 * _BINS))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("row", "node", "terms")}
            terms, sizes = _flat(batch.column(at["terms"]))
            node = batch.column(at["node"]).to_numpy().astype(np.int64)
            side = moves.sides(batch.column(at["row"]).to_numpy(), node, sizes, _buckets(terms))
            yield batch.set_column(at["node"], "node", pa.array((node * 2 + side).astype(np.int32)))

    return materialize(docs.mapInArrow(moved, docs.schema))


_INDEX = {"terms": "int", "term_most": "int", "term_ends": "int", "posts": "int", "parts": "int", "cell_ends": "int", "cell_clusters": "int", "cell_starts": "int", "cell_most": "int"}


def _build(n: int, words: int, cluster: int):
    """The function that makes a shard's row of its documents."""

    def build(rows: pa.Table) -> pa.Table:
        terms, sizes = _flat(rows.column("terms").combine_chunks())
        times, _ = _flat(rows.column("times").combine_chunks())
        owner = np.repeat(np.arange(rows.num_rows), sizes)
        own = halved(sizes, _buckets(terms), cluster)
        order = np.argsort(own, kind="stable")
        place = np.empty(rows.num_rows, np.int64)
        place[order] = np.arange(rows.num_rows)
        length = rows.column("n").to_numpy()[owner]
        parts = 1_000_000_000 * times.astype(np.int64) // (1000 * times.astype(np.int64) + 8 * (10 + 90 * length * n // words))
        by = np.lexsort((place[owner], terms))
        terms, posts, parts, in_cluster = terms[by], place[owner][by], parts[by], own[owner][by]
        starts = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(in_cluster, prepend=-1))
        most = np.maximum.reduceat(parts, starts)
        first = np.flatnonzero(np.diff(terms[starts], prepend=-1))  # cells that begin a term
        found = {
            "terms": terms[starts[first]], "term_most": np.maximum.reduceat(most, first), "term_ends": np.append(starts[first[1:]], len(terms)), "posts": posts, "parts": parts,
            "cell_ends": np.append(first[1:], len(starts)), "cell_clusters": in_cluster[starts], "cell_starts": starts, "cell_most": most,
        }
        ids = rows.column("id").combine_chunks().take(pa.array(order))
        sent = [pa.array([found[c].astype(np.int32)], pa.list_(pa.int32())) for c in _INDEX]
        return pa.Table.from_arrays([rows.column("shard").slice(0, 1).combine_chunks(), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), ids), *sent], names=["shard", "ids", *_INDEX])

    return build


class Shard:
    """A shard's row, open for search."""

    def __init__(self, row: dict[str, pa.Array]):
        self.ids = row["ids"]
        for name in _INDEX:
            setattr(self, name, row[name].to_numpy().astype(np.int64))
        self.clusters = int(self.cell_clusters.max()) + 1
        # the rank of each document's id, null last: what ties go by
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(self.ids))
        self.cell_stops = np.append(self.cell_starts[1:], len(self.posts))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, threshold: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, postings read) of the k best documents that reach the threshold, the best first."""
        at = np.searchsorted(self.terms, terms)
        held = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, weights = at[held], weights[held]
        begin = np.where(at > 0, self.cell_ends[at - 1], 0)
        n = self.cell_ends[at] - begin
        cells, factor = _ranges(begin, n), np.repeat(weights, n)
        bound = np.bincount(self.cell_clusters[cells], factor * self.cell_most[cells], minlength=self.clusters).astype(np.int64)  # below 2 ** 53
        order = np.argsort(-bound, kind="stable")
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        read, lo, step = 0, 0, 1
        while lo < len(order) and bound[order[lo]] >= max(threshold, 1):
            now = order[lo : lo + step]
            chosen = np.zeros(self.clusters, bool)
            chosen[now[bound[now] >= max(threshold, 1)]] = True
            used = chosen[self.cell_clusters[cells]]
            size = self.cell_stops[cells[used]] - self.cell_starts[cells[used]]
            posts = _ranges(self.cell_starts[cells[used]], size)
            total = np.bincount(self.posts[posts], np.repeat(factor[used], size) * self.parts[posts]).astype(np.int64)
            read += len(posts)
            new = np.flatnonzero(total >= max(threshold, 1))
            places, scores = np.concatenate([places, new]), np.concatenate([scores, total[new]])
            best = np.lexsort((self.rank[places], -scores))[:k]
            places, scores = places[best], scores[best]
            if len(scores) == k:
                threshold = max(threshold, int(scores[-1]))
            lo, step = lo + step, 2 * step
        return places, scores, read


def _search(index: DataFrame, tasks: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], k: int, id_type: str) -> DataFrame:
    """(item, id, score): the k best of every (shard, item, threshold) of tasks. Only tasks move, unless they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {c: batch.column(batch.schema.get_field_index(c))[0].values for c in ("ids", *_INDEX, "items", "thresholds")}
            shard = Shard(row)
            items, ids, scores = [], [], []
            for item, threshold in zip(row["items"].to_pylist(), row["thresholds"].to_pylist(), strict=True):
                places, found, _ = shard.top(*asked[item], k, threshold)
                items += [item] * len(places)
                ids.append(shard.ids.take(pa.array(places)))
                scores.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.concat_arrays(ids) if ids else pa.array([], shard.ids.type), pa.array(np.concatenate(scores) if scores else [], pa.int64())], names=["item", "id", "score"])

    packed = tasks.groupBy("shard").agg(F.collect_list(F.struct("item", "threshold")).alias("t")).select("shard", F.col("t.item").alias("items"), F.col("t.threshold").alias("thresholds"))
    with arrow_rows(index.sparkSession, 1, read=1):
        return materialize(index.join(packed, "shard").mapInArrow(run, f"item long, id {id_type}, score long"))


def _rank_part(texts: DataFrame, items: list, k: int, shard: int, cluster: int, item_kind: str) -> DataFrame:
    """The rows of some items, which the driver holds: (item_id, rank, id, score)."""
    spark, id_type = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    wanted = [sorted(set(terms_of(r["text"]))) for r in items]
    vocabulary = sorted(set().union(*wanted))
    number = {t: i for i, t in enumerate(vocabulary)}
    empty = spark.createDataFrame([], f"item_id {item_kind}, rank int, id {id_type}, score long")
    if not vocabulary:
        return empty

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keep, n, sizes, terms, times = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    held = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                    keep.append(i)
                    n.append(len(words))
                    sizes.append(len(held))
                    terms += [t for t, _ in held]
                    times += [c for _, c in held]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), _lists(np.array(terms, np.int32), np.array(sizes, np.int64)), _lists(np.array(times, np.int32), np.array(sizes, np.int64))], names=["id", "n", "terms", "times"])

    docs = materialize(texts.mapInArrow(forward, f"id {id_type}, n long, terms array<int>, times array<int>").withColumn("row", F.monotonically_increasing_id()).withColumn("node", F.lit(0)))
    whole = docs.agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.sum(F.size("terms")).alias("postings")).first()
    n, words, postings = whole["n"], whole["words"], whole["postings"]
    if not postings:
        return empty
    df = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # the vocabulary at most
        df[r["t"]] = r["n"]
    weights = np.array([weight(n, int(d)) for d in df], np.int64)

    docs = docs.filter(F.size("terms") > 0)
    for level in range(min(int(math.log2(NODES)), max(0, math.ceil(math.log2(postings / shard))))):
        docs = _halve(docs, level)
    shards = sorted((r["node"], max(1, math.ceil(r["postings"] / shard))) for r in docs.groupBy("node").agg(F.sum(F.size("terms")).alias("postings")).collect())  # NODES at most
    first = np.cumsum([0, *(m for _, m in shards)]).tolist()
    dealt = F.create_map(*(F.lit(x) for (node, m), s in zip(shards, first, strict=False) for x in (node, F.struct(F.lit(s).alias("first"), F.lit(m).alias("shards")))))[F.col("node")]
    placed = docs.withColumn("_d", dealt).withColumn("shard", (F.col("_d.first") + F.pmod(F.xxhash64("row"), F.col("_d.shards"))).cast("long")).select("shard", "id", "n", "terms", "times")
    index = materialize(placed.groupBy("shard").applyInArrow(_build(n, words, cluster), f"shard long, ids array<{id_type}>, " + ", ".join(f"{c} array<{t}>" for c, t in _INDEX.items())), row_check=2)

    asked = []
    for terms in wanted:
        at = np.array([number[t] for t in terms], np.int64)
        asked.append((at, weights[at]))
    pairs = spark.createDataFrame(pa.table({"item": np.repeat(np.arange(len(asked)), [len(a) for a, _ in asked]), "term": np.concatenate([a for a, _ in asked]), "weight": np.concatenate([w for _, w in asked])}))
    maxima = index.select("shard", F.explode(F.arrays_zip("terms", "term_most")).alias("m")).select("shard", F.col("m.terms").cast("long").alias("term"), F.col("m.term_most").cast("long").alias("most"))
    bounds = maxima.join(pairs, "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")).filter("bound > 0")
    with arrow_rows(spark, 1, read=1):  # a row of the index is a whole shard
        visits = materialize(bounds.withColumn("visit", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard")) - 1))

    found, lo, hi = None, 0, 1
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    while lo < first[-1]:
        now = visits.filter((F.col("visit") >= lo) & (F.col("visit") < hi))
        if found is None:
            tasks = now.withColumn("threshold", F.lit(0).cast("long"))
        else:
            least = found.filter(F.col("rank") == k).select("item", F.col("score").alias("threshold"))
            tasks = now.join(least, "item", "left").fillna(0, ["threshold"]).filter("bound >= threshold")
        new = _search(index, tasks.select("shard", "item", "threshold"), asked, k, id_type)
        both = new if found is None else found.drop("rank").unionByName(new)
        found = materialize(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        lo, hi = hi, hi * WIDEN
    named = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int64()), "item_id": pa.array([r["item_id"] for r in items], pa.int64() if item_kind == "bigint" else pa.string())}))
    return found.join(named, "item").select("item_id", "rank", "id", "score")


def rank_documents(df: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD, cluster: int = CLUSTER, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best-scored documents of each item: item id, rank, id, score.

    Every row of df is a document and every row of items an item, repeated ids too. Null and empty texts, and texts without
    a term, are no documents; an item without terms, or whose terms no document has, gives no rows. Equal scores go by
    ascending id, null last. Other columns are left out. Empty tables give an empty table. The index covers all
    documents for the terms of all items; items of more than ``item_bytes`` are served in parts, each with an index of its own.
    """
    typed = lambda d, c, name: (F.col(c) if d.schema[c].dataType.simpleString() == "bigint" else F.col(c).cast("string")).alias(name)
    kinds = df.schema[id_col].dataType, items.schema[item_id_col].dataType
    texts = df.select(typed(df, id_col, "id"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(typed(items, item_id_col, "item_id"), F.col(item_text_col).cast("string").alias("text"))
    total = wanted.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / item_bytes))
    dealt = wanted if parts == 1 else materialize(wanted.withColumn("_part", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(parts))))
    out = None
    for part in range(parts):
        rows = (dealt if parts == 1 else dealt.filter(F.col("_part") == part).drop("_part")).collect()  # about item_bytes
        found = _rank_part(texts, rows, k, shard, cluster, wanted.schema["item_id"].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item_id").cast(kinds[1]).alias(item_id_col), F.col("rank").cast("int").alias("rank"), F.col("id").cast(kinds[0]).alias(id_col), "score")


def op13_sql() -> str:
    """The same ranking by scoring every document, in DuckDB."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(UPPER, LOWER)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS words FROM d WHERE len(ws) > 0),
i AS (SELECT iid, item_id, unnest(list_distinct(ws)) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {words} AS ws FROM benchmark)),
p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(size) AS size, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(ws)::BIGINT AS size, unnest(ws) AS term FROM d)
      WHERE term IN (SELECT term FROM i) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
sc AS (SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // words))))::BIGINT AS score
       FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY iid, rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
