"""Exact BM25 top-k: an inverted index in shards, block-max WAND pruning, exact merge by global statistics.

Index. Rows are dealt into shards of about ``TOKENS`` words. A task builds one shard after another and writes each as one
row: terms, postings (document, times) and, for every term and block of ``BLOCK`` documents that has it, a *cell* with the
largest impact of the term in the block. A shard's documents stand in order of their most repeated word and their length,
so that the documents of a block are alike (one language, like lengths) and a block's maxima say something.

Search. For a query and a shard, the sum of a block's cells bounds what any of its documents can score; a block whose bound
is below the threshold (the k-th best score known) is skipped. A pivot splits the query's terms by their maxima: the
weakest, frequent words whose maxima together stay below ``SPLIT`` of the threshold, can lift no document into the top k
alone. Only the postings from the pivot on are read. What they give a document, and the block maxima of the words before
the pivot, bound its score again; the documents that could still reach the threshold get those words' parts too. No
document that could enter the top k is passed over.

Statistics. Document count, average length and document frequencies are those of the whole corpus, and a word's part of a
score is rounded to a multiple of 2 ** -32, so that sums are exact in any order: scores are the same whatever the shards. A query goes over the shards in
rounds: its first shard alone, then up to ``WIDEN`` shards, ``WIDEN`` squared and so on, and takes the k-th best score so
far into the next round as its threshold; the first round takes one from the blocks of its shard's highest bounds. Within a
round, a task that goes over several shards raises the thresholds by what it has found itself. So a round gives about k times WIDEN rows a query at
most, however many shards there are. A ranking over the query merges the rounds. Each round of a pass opens every shard,
which costs as much as some hundred searches in it: so there are few rounds, and passes of many queries.

Queries are a table: their words are joined to the document frequencies and packed, one row a query. They are dealt into
blocks of bounded size; the tasks of a pass hold one such block and go over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, slices, table

K, K1, B = 10, 1.2, 0.75
TOKENS, BLOCK = 1_000_000, 128
#: Distinct words of the queries of a pass, about 20 bytes each: what every task holds of the queries.
PASS_WORDS = 3_000_000
FIELDS = ("terms", "term_ends", "posting_ends", "docs", "times", "lengths", "id_ranks", "cell_ends", "cell_blocks", "cell_starts", "cell_most")
#: By how many times a round has more shards than all before it.
WIDEN = 12
#: Share of the threshold that the words before the pivot may reach.
SPLIT = 0.5
#: A word in more than this share of a shard's documents also has a row of impacts there.
FREQUENT = 0.125
#: Scores are whole numbers of this unit; bounds aren't rounded, so they get some slack.
UNIT, LESS = 2.0**-32, 1 - 1e-9


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[i] ... start[i] + size[i] - 1, one after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _norms(lengths: np.ndarray, average: float) -> np.ndarray:
    return K1 * (1 - B + B * lengths / average)


def pack_shard(ids: list, tokens: list[np.ndarray], words: list[bytes], average: float, block: int) -> dict[str, bytes | list]:
    """ids: of the documents; tokens: of each, as places in words. The columns of an index row."""
    n, v = len(ids), max(1, len(words))
    lengths = np.array([len(t) for t in tokens], np.int64)
    pair, times = np.unique(np.repeat(np.arange(n), lengths) * v + np.concatenate(tokens), return_counts=True)
    doc, term = pair // v, pair % v
    # like documents together: by the word that a document repeats most (of those, the one with most documents), then length
    held = np.bincount(term, minlength=v)
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    top = np.zeros(n, np.int64)
    if len(doc):
        at = np.flatnonzero(first)
        top[doc[at]] = np.maximum.reduceat((times * (n + 1) + held[term]) * v + term, at) % v
    order = np.lexsort((lengths, top, -held[top]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    rank = np.empty(v, np.int64)
    rank[by_word] = np.arange(len(by_word))
    sort = np.argsort(rank[term] * n + place[doc], kind="stable")
    term, doc, times = rank[term[sort]], place[doc[sort]], times[sort]
    lengths = lengths[order]
    impact = times * (K1 + 1) / (times + _norms(lengths, average)[doc])
    cell = term * (n // block + 1) + doc // block
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    ordered = [words[i] for i in by_word]
    ids = [ids[i] for i in order]
    id_rank = np.empty(n, np.int64)
    id_rank[sorted(range(n), key=ids.__getitem__)] = np.arange(n)
    return {
        "ids": ids,
        "terms": b"".join(ordered),
        "term_ends": np.cumsum([0, *map(len, ordered)]).astype("<i4").tobytes(),
        "posting_ends": np.searchsorted(term, np.arange(len(words)), "right").astype("<i4").tobytes(),
        "docs": doc.astype("<i4").tobytes(),
        "times": times.astype("<i4").tobytes(),
        "lengths": lengths.astype("<i4").tobytes(),
        "id_ranks": id_rank.astype("<i4").tobytes(),
        "cell_ends": np.searchsorted(term[start], np.arange(len(words)), "right").astype("<i4").tobytes(),
        "cell_blocks": (doc[start] // block).astype("<i4").tobytes(),
        "cell_starts": start.astype("<i4").tobytes(),
        "cell_most": (np.maximum.reduceat(impact, start) if len(start) else np.zeros(0)).astype("<f8").tobytes(),
    }


def build_index(texts: DataFrame, shards: int, average: float, block: int = BLOCK) -> DataFrame:
    """texts: (id, text). One row per shard. A task holds one shard at a time."""
    kind = texts.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, tokens, known, id_type = None, [], [], {}, None

        def out() -> pa.RecordBatch:
            row = pack_shard(ids, tokens, list(known), average, block)
            columns = [pa.array([now], pa.int32()), pa.array([row["ids"]], pa.list_(id_type)), *(pa.array([row[f]], pa.binary()) for f in FIELDS)]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", *FIELDS])

        for batch in slices(batches):
            id_type = batch.schema.field(1).type
            for shard, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if ids:
                        yield out()
                    now, ids, tokens, known = shard, [], [], {}
                ids.append(i)
                found = words_of(t)
                tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found)))
        if ids:
            yield out()

    dealt = texts.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "text").repartition(shards, "shard").sortWithinPartitions("shard")
    with arrow_rows(texts.sparkSession, 256):
        return materialize(dealt.mapInArrow(build, f"shard int, ids array<{kind}>, " + ", ".join(f"{f} binary" for f in FIELDS)))


class Shard:
    """One index row, for search. ids stay in Arrow: only those of hits are needed."""

    def __init__(self, row: dict, average: float, block: int = BLOCK):
        number = lambda f, t="<i4": np.frombuffer(row[f], t)
        self.block, self.read = block, 0  # postings that searches have read
        ends = row["term_ends"]
        self.terms = pa.Array.from_buffers(pa.binary(), len(ends) // 4 - 1, [None, pa.py_buffer(ends), pa.py_buffer(row["terms"])])
        self.sizes = np.diff(np.concatenate([[0], number("posting_ends")]))
        self.docs, times = number("docs"), number("times")
        self.id_ranks = number("id_ranks")
        self.impacts = times * (K1 + 1) / (times + _norms(number("lengths").astype(np.int64), average)[self.docs]) if len(times) else np.zeros(0)
        self.cell_ends = np.concatenate([[0], number("cell_ends")])
        self.cell_blocks, self.cell_starts, self.cell_most = number("cell_blocks"), number("cell_starts"), number("cell_most", "<f8")
        self.cell_sizes = np.diff(np.append(self.cell_starts, len(self.docs)))
        n = len(self.id_ranks)
        self.blocks, self.block_of = -(-n // block), np.arange(n) // block
        self.most = np.maximum.reduceat(self.cell_most, self.cell_ends[:-1]) if len(self.cell_most) else np.zeros(0)
        often = np.flatnonzero(self.sizes > FREQUENT * n)
        self.row = np.full(len(self.sizes), -1)
        self.row[often] = np.arange(len(often))
        self.frequent = np.zeros((len(often), n))
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        for i, t in enumerate(often.tolist()):
            span = slice(ends[t], ends[t + 1])
            self.frequent[i, self.docs[span]] = self.impacts[span]

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place among the terms, -1 if it is none."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy()

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """terms: places; weights, threshold and scores in units. (documents, scores) of the k best, of those that reach the threshold.

        Without a threshold, the blocks of the highest bounds are scored alone first: the k-th best of their documents is one.
        """
        counts = self.cell_ends[terms + 1] - self.cell_ends[terms]
        cells = _ranges(self.cell_ends[terms], counts)
        term = np.repeat(np.arange(len(terms)), counts)
        block = self.cell_blocks[cells]
        most = weights[term] * self.cell_most[cells]
        if threshold <= 0 and self.blocks > 2 * (first := 1 + 4 * k // self.block):
            bound = np.bincount(block, weights=most, minlength=self.blocks)
            threshold = self._kth(cells, weights[term], np.isin(block, np.argsort(-bound, kind="stable")[:first]), k)
        least = threshold * LESS - len(terms)  # each part of a score is rounded by half a unit at most, bounds aren't
        if threshold > 0:
            alive = np.bincount(block, weights=most, minlength=self.blocks) >= least
            if not alive.any():
                return np.zeros(0, np.int64), np.zeros(0)
            ceiling = weights * self.most[terms]
            weakest = np.argsort(ceiling, kind="stable")
            weak = np.zeros(len(terms), bool)
            weak[weakest[np.cumsum(ceiling[weakest]) < SPLIT * threshold]] = True
            weak &= self.row[terms] >= 0
            behind = weak[term]
            rest = np.bincount(block[behind], weights=most[behind], minlength=self.blocks)
            ahead = alive[block] & ~behind
            cells, term = cells[ahead], term[ahead]
        size = self.cell_sizes[cells]
        self.read += int(size.sum())
        at = _ranges(self.cell_starts[cells], size)
        score = np.bincount(self.docs[at], weights=np.rint(np.repeat(weights[term], size) * self.impacts[at]), minlength=len(self.id_ranks))
        if threshold > 0:
            doc = np.flatnonzero((score + rest[self.block_of] >= least) & alive[self.block_of])
            score = score[doc] + np.rint(weights[weak][:, None] * self.frequent[np.ix_(self.row[terms[weak]], doc)]).sum(axis=0)
            reach = score >= least
            doc, score = doc[reach], score[reach]
        else:
            doc = np.flatnonzero(score > 0)
            score = score[doc]
        if len(doc) > k:  # ties with the k-th stay for the order by id
            reach = score >= np.partition(score, len(score) - k)[len(score) - k]
            doc, score = doc[reach], score[reach]
        best = np.lexsort((self.id_ranks[doc], -score))[:k]
        return doc[best], score[best]

    def _kth(self, cells: np.ndarray, weights: np.ndarray, chosen: np.ndarray, k: int) -> float:
        """The k-th best score in the chosen cells' blocks, 0 if they have fewer documents of the query."""
        size = self.cell_sizes[cells[chosen]]
        self.read += int(size.sum())
        at = _ranges(self.cell_starts[cells[chosen]], size)
        score = np.bincount(self.docs[at], weights=np.rint(np.repeat(weights[chosen], size) * self.impacts[at])) if len(at) else np.zeros(0)
        return float(np.partition(score, len(score) - k)[len(score) - k]) if (score > 0).sum() >= k else 0.0


def _packed(asked: DataFrame, frequencies: DataFrame, shards: int) -> DataFrame:
    """asked: (query, query_id, text). (query, first shard, words in order, their document frequencies), words that no row has left out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            query, word = [], []
            for q, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = set(words_of(t))
                query += [q] * len(found)
                word += found
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(word, pa.binary())], names=["query", "word"])

    words = asked.select("query", "text").mapInArrow(split, "query long, word binary").join(frequencies, "word")
    rows = words.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("word", "df"))).alias("w"))
    return rows.select("query", F.pmod(F.xxhash64("query"), F.lit(shards)).cast("int").alias("first"), F.col("w.word").alias("words"), F.col("w.df").alias("dfs"))


def _search(index: DataFrame, part: pa.Table, n: int, shards: int, average: float, k: int, block: int, id_kind: str) -> DataFrame:
    """The queries of one pass over all shards."""
    sc = index.sparkSession.sparkContext
    words = pc.unique(pa.chunked_array(part["words"].chunks).combine_chunks().flatten()) if part.num_rows else pa.array([], pa.binary())
    flat = part["words"].combine_chunks().flatten()
    df = part["dfs"].combine_chunks().flatten().to_numpy()
    sizes = pc.list_value_length(part["words"]).to_numpy()
    held = {"query": part["query"].to_numpy(), "first": part["first"].to_numpy(), "words": words, "place": pc.index_in(flat, value_set=words).to_numpy(), "weight": np.log(1 + (n - df + 0.5) / (df + 0.5)) / UNIT, "ends": np.concatenate([[0], np.cumsum(sizes)]), "threshold": np.zeros(part.num_rows)}

    def run(sent, lo: int, hi: int):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            threshold = q["threshold"].copy()
            best = np.zeros((len(threshold), k))  # of this task's shards
            for batch in slices(batches, 1):
                number, ids = batch.column("shard")[0].as_py(), batch.column("ids").flatten()
                turn = (number - q["first"]) % shards  # the shards after a query's first one, in a ring
                mine = np.flatnonzero((turn >= lo) & (turn < hi))
                hits, docs, scores = [], [], []
                if len(mine):
                    shard = Shard({f: batch.column(f)[0].as_py() for f in FIELDS}, average, block)
                    where = shard.places(q["words"])
                    for i in mine.tolist():
                        span = slice(q["ends"][i], q["ends"][i + 1])
                        terms, weights = where[q["place"][span]], q["weight"][span]
                        there = terms >= 0
                        if there.any():
                            doc, score = shard.top(terms[there], weights[there], k, threshold[i])
                            if len(score) and score[0] > best[i, 0]:
                                best[i] = np.sort(np.append(best[i], score))[-k:]
                                threshold[i] = max(threshold[i], best[i, 0])
                            hits += [i] * len(doc)
                            docs.append(doc)
                            scores.append(score)
                found = np.concatenate(docs) if docs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q["query"][hits] if hits else [], pa.int64()), ids.take(pa.array(found)), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["query", "doc_id", "score"])

        return search

    found, lo, hi = None, 0, 1
    with arrow_rows(index.sparkSession, 1):
        while lo < shards:
            rows = materialize(index.mapInArrow(run(sc.broadcast(held), lo, hi), f"query long, doc_id {id_kind}, score double"))
            found = rows if found is None else found.union(rows)
            lo, hi = hi, min(shards, hi * WIDEN) if hi < shards else hi
            if lo == hi:
                break
            best = found.groupBy("query").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), k - 1).alias("kth")).filter("kth is not null").toArrow()  # a number a query
            of = dict(zip(best["query"].to_pylist(), best["kth"].to_pylist(), strict=True))
            held["threshold"] = np.array([of.get(q, 0.0) for q in held["query"].tolist()])
    return found


def top_k(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, block: int = BLOCK, pass_words: int = PASS_WORDS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of df for each row of queries, by BM25 over its distinct words.

    Words: A-Z lower-cased, by ASCII white space. Rows without a word in common are no hits, so a query may get fewer than
    k rows; null and empty texts neither find nor are found; rows with a null id are left out, as query and as hit. Ids may
    be of any type that can be ordered. Equal scores go by id; of rows that repeat an id each counts, as a hit and as a
    query. Scores are rounded to 6 places for the report, after ranking. Other columns are left out. Empty tables give an
    empty table.
    """
    spark = df.sparkSession
    id_kind, query_kind = df.schema[id_col].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    texts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.filter(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("query_id"), F.col(text_col).cast("string").alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["n"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            terms, ends = batch.column("terms")[0].as_py(), batch.column("term_ends")[0].as_py()
            words = pa.Array.from_buffers(pa.binary(), len(ends) // 4 - 1, [None, pa.py_buffer(ends), pa.py_buffer(terms)])
            size = np.diff(np.concatenate([[0], np.frombuffer(batch.column("posting_ends")[0].as_py(), "<i4")]))
            yield pa.RecordBatch.from_arrays([words, pa.array(size, pa.int64())], names=["word", "df"])

    n, total = texts.mapInArrow(sizes, "n long").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n or not total:
        return spark.createDataFrame([], f"query_id {query_kind}, rank int, doc_id {id_kind}, score double")
    shards, average = max(1, -(-total // tokens)), total / n
    asked = materialize(asked)
    index = build_index(texts, shards, average, block)
    df_of = index.select("terms", "term_ends", "posting_ends").mapInArrow(frequencies, "word binary, df long").groupBy("word").agg(F.sum("df").alias("df"))
    packed = _packed(asked, df_of, shards)
    with arrow_rows(spark, 256):
        packed = materialize(packed.withColumn("_size", F.size("words")))
    n_words = packed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    passes = max(1, -(-n_words // pass_words))
    found = None
    for p in range(passes):
        part = packed.filter(F.pmod(F.xxhash64("query", F.lit(1)), F.lit(passes)) == p).drop("_size").toArrow()  # bounded by pass_words
        rows = _search(index, part, n, shards, average, k, block, id_kind)
        found = rows if found is None else found.union(rows)
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", F.round(F.col("score") * UNIT, 6).alias("score"))


def op8_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every hundredth document's whole text."""
    documents = table(spark, sf_dir)
    return top_k(documents, documents.filter("doc_id % 100 = 0"))
