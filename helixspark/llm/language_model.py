"""Brown class-based bigrams: exchange clustering, class transitions and word emissions; and a smoothed unigram base.

Counting. Words of the training texts are counted in each task and summed over the cluster; the vocabulary stays a table.
Its ``TOP`` most frequent words (a fixed number) are held by every task: most tokens are settled there.

Classes. Every word of the vocabulary gets one of ``CLASSES`` classes, by exchange: a word moves to the class that raises
the likelihood of the class bigrams most.

* The held words, in rounds over the whole corpus. Tasks count each word's neighbours by class; the counts are added up by
  blocks of words (of many tasks, in groups of ``GROUP`` first), and the executors decide each word's move against the class bigrams of the round (a small matrix). Half
  of the words may move in a round, the other half in the next. The best round's classes stay.
* All other words, in one pass: the counts of a word's neighbours' classes are gathered over the corpus, and the word takes
  the class that they fit best. Their bigrams join the transitions: those with a held word or an end as they were gathered,
  those of two others by joining both words to their classes.

The end of a text is a class of its own. Words that no training text has belong to the class with most words.

Score. log10 of the product of P(class | class before) P(word | class); before the first word stands an end. Transitions
and emissions are smoothed by additive constants, so unknown words have a probability too. A text's words that aren't held
are joined to the vocabulary by a shuffle, one row per text and word; the text itself travels as compressed word numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, crc_mod, discard, materialize, slices, table

TOP, CLASSES, ROUNDS = 50_000, 48, 4
ADD, ADD_CLASS = 0.5, 0.1
#: Words that a task counts before it sends its counts on; words of a block; tokens of a chunk.
HELD, WORDS, CHUNK = 300_000, 500, 1 << 20
#: Tasks whose counts are added up before those of all tasks are.
GROUP = 64
#: The number that stands for a word that isn't held.
TAIL = 0xFFFF


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """texts: (text). Gives (word binary, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return batch

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                counts.update(words_of(t))
            if len(counts) > HELD:
                yield out()
        yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encode_corpus(texts: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(chunk binary): the texts' word numbers, TAIL for words that aren't held; an end (len(ids)) stands before and after each text."""
    import zstandard

    held, end = texts.sparkSession.sparkContext.broadcast(ids), len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = held.value, [end]
        pack = zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack.compress(np.array(codes, "<u2").tobytes())], pa.binary())], names=["chunk"])

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                codes += map(known.get, words_of(t), repeat(TAIL))
                codes.append(end)
                if len(codes) >= CHUNK:
                    yield out()
                    codes = [end]
        if len(codes) > 1:
            yield out()

    return materialize(texts.mapInArrow(run, "chunk binary"))


def _neighbours(encoded: DataFrame, of: np.ndarray, m: int) -> DataFrame:
    """(block, counts binary): for WORDS held words a block, how often each class stands right and left of them (words x 2 m), by the classes ``of``."""
    import zstandard

    held, n = encoded.sparkSession.sparkContext.broadcast(of.astype(np.uint16)), len(of)
    blocks = -(-n // WORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, unpack, pack = held.value, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        total = np.zeros(blocks * WORDS * 2 * m, np.int32)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                w = np.frombuffer(unpack.decompress(chunk), "<u2").astype(np.int64)
                there = (w[1:] != TAIL) & (w[:-1] != TAIL)  # pairs with a word that isn't held are counted with that word
                a, b = w[:-1][there], w[1:][there]
                total += np.bincount(np.concatenate([a * 2 * m + classes[b], b * 2 * m + m + classes[a]]), minlength=len(total)).astype(np.int32)
        rows = total.reshape(blocks, WORDS * 2 * m)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack.compress(rows[k].astype("<i4").tobytes()) for k in some], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block stand together, in batches (block, counts, ...)."""
        unpack, pack, now, total = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack.compress(total.astype("<i8").tobytes())], pa.binary())], names=["block", "counts"])

        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if block != now:  # parts of one block may come one after another: their sums need not be apart
                    if now is not None:
                        yield out()
                    now, total = block, np.zeros(WORDS * 2 * m, np.int64)
                raw = unpack.decompress(packed)
                total += np.frombuffer(raw, "<i4" if len(raw) == WORDS * 2 * m * 4 else "<i8")
        if now is not None:
            yield out()

    counts = encoded.mapInArrow(count, "block int, counts binary")
    groups = -(-encoded.rdd.getNumPartitions() // GROUP)
    with arrow_rows(encoded.sparkSession, 64):
        if groups > 1:
            counts = counts.withColumn("part", F.spark_partition_id() % groups).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(add, "block int, counts binary")
        return materialize(counts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary"))


def _blocks(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, WORDS x 2 m counts) of the rows of _neighbours."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield block, np.frombuffer(unpack.decompress(counts), "<i8").reshape(WORDS, 2 * m)


def _class_bigrams(counted: DataFrame, of: np.ndarray, m: int) -> np.ndarray:
    """m x m: how often a class follows a class."""
    held = counted.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.zeros((m, m), np.int64)
        for block, counts in _blocks(batches, m):
            mine = held.value[block * WORDS : (block + 1) * WORDS]
            np.add.at(big, mine, counts[: len(mine), :m])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), pa.array(big.ravel())], names=["code", "n"])

    with arrow_rows(counted.sparkSession, 64):
        found = counted.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m * m, np.int64)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(m, m)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(big: np.ndarray) -> float:
    """Of the class bigrams: what exchange raises."""
    big = big.astype(np.float64)
    return float(_xlogx(big).sum() - _xlogx(big.sum(0)).sum() - _xlogx(big.sum(1)).sum())


def best_class(right: np.ndarray, left: np.ndarray, here: int, big: np.ndarray, classes: int) -> int:
    """The class to which a word moves: where the likelihood is highest when its bigrams are taken out of its class and put there.

    right, left: the word's counts by the classes after and before it (bigrams of the word with itself count with its class).
    """
    big = big.astype(np.float64)
    big[here] -= right
    big[:, here] -= left
    np.maximum(big, 0.0, out=big)
    rows = _xlogx(big + right) - _xlogx(big)  # if the word joins the row's class
    cols = _xlogx(big + left[:, None]) - _xlogx(big)  # if it joins the column's class
    both = big.diagonal() + right + left
    gain = rows.sum(1) - rows.diagonal() + cols.sum(0) - cols.diagonal() + _xlogx(both) - _xlogx(big.diagonal())
    out, into = big.sum(1), big.sum(0)
    gain -= _xlogx(out + right.sum()) - _xlogx(out) + _xlogx(into + left.sum()) - _xlogx(into)
    best = int(np.argmax(gain[:classes]))
    return best if gain[best] > gain[here] + 1e-9 else here


def exchange(encoded: DataFrame, n: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the n held words and the end (its class is ``classes``), their class bigrams, and the likelihood of each round."""
    m = classes + 1
    of = np.append(np.arange(n) % max(1, classes), classes).astype(np.int64)
    best, trace = None, []
    for r in range(rounds + 1):
        if r:
            discard(counted)
        counted = _neighbours(encoded, of, m)
        big = _class_bigrams(counted, of, m)
        trace.append(likelihood(big))
        if best is None or trace[-1] > best[0]:
            best = (trace[-1], of.copy(), big)
        if r == rounds:
            break
        held = encoded.sparkSession.sparkContext.broadcast((of, big))

        def decide(batches: Iterator[pa.RecordBatch], r: int = r, held=held) -> Iterator[pa.RecordBatch]:
            now, big = held.value
            for block, counts in _blocks(batches, m):
                rows = counts.astype(np.float64)
                words = [w for w in range(block * WORDS, min(n, (block + 1) * WORDS)) if (w // max(1, classes) + r) % 2 == 0 and rows[w % WORDS].any()]
                moved = [best_class(rows[w % WORDS, :m], rows[w % WORDS, m:], int(now[w]), big, classes) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(moved, pa.int64())], names=["word", "class"])

        with arrow_rows(encoded.sparkSession, 64):
            moves = counted.mapInArrow(decide, "word long, class long").toArrow()  # at most a number a held word
        before = of.copy()
        of[moves["word"].to_numpy()] = moves["class"].to_numpy()
        if r % 2 and (of == before).all():
            break
    discard(counted)
    return best[1], best[2], trace


def other_bigrams(texts: DataFrame, ids: dict[bytes, int], others: DataFrame) -> DataFrame:
    """(a, b, n): how often a class follows a class where neither word is held; others: (word, class)."""
    held = texts.sparkSession.sparkContext.broadcast(frozenset(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in counts], pa.binary()), pa.array([b for _, b in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "after", "n"])
            counts.clear()
            return batch

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                there = list(map(known.__contains__, words))
                counts.update([(a, b) for a, b, x, y in zip(words, words[1:], there, there[1:], strict=False) if not (x or y)])
            if len(counts) > HELD:
                yield out()
        yield out()

    classes = others.select("word", "class")
    first = texts.mapInArrow(run, "word binary, after binary, n long").join(classes, "word").groupBy(F.col("class").alias("a"), F.col("after").alias("word")).agg(F.sum("n").alias("n"))
    return first.join(classes, "word").groupBy("a", F.col("class").alias("b")).agg(F.sum("n").alias("n"))


def classify_others(texts: DataFrame, ids: dict[bytes, int], of: np.ndarray, big: np.ndarray) -> DataFrame:
    """(word, c, class, pairs) of the words that aren't held: the class that their neighbours fit best.

    pairs: (class before, class after, times) with -1 for a neighbour that isn't held either (see other_bigrams); at most one for each pair of
    classes, however often the word occurs.
    """
    m = len(big)
    held = texts.sparkSession.sparkContext.broadcast(({w: int(of[i]) for w, i in ids.items()}, int(of[-1])))
    total = big.sum() + 1.0
    after, before = big.sum(0) + ADD_CLASS * m, big.sum(1) + ADD_CLASS * m
    fit = np.log((big + ADD_CLASS) * (total + ADD_CLASS * m * m) / np.outer(before, after))
    score = texts.sparkSession.sparkContext.broadcast(fit)

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = held.value
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([-1 if k[1] is None else k[1] for k in keys], pa.int32()), pa.array([-1 if k[2] is None else k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "before", "after", "n"])
            counts.clear()
            return batch

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                cs = [end, *map(known.get, words), end]
                counts.update([(w, a, b) for w, a, c, b in zip(words, cs, cs[1:], cs[2:], strict=False) if c is None])
            if len(counts) > HELD:
                yield out()
        yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = score.value
        for batch in slices(batches, 1024):
            pairs = batch.column(1)
            size, flat = pairs.value_lengths().to_numpy(), pairs.flatten()
            before, after, n = (flat.field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(len(size)), size)
            sides = []
            for side in (before, after):  # counts of each word's neighbours by class
                ok = side >= 0
                sides.append(np.bincount(row[ok] * m + side[ok], weights=n[ok], minlength=len(size) * m).reshape(len(size), m))
            gain = sides[0] @ fit + sides[1] @ fit.T
            best = gain[:, : m - 1].argmax(axis=1) if m > 1 else np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pairs], names=["word", "class", "pairs"])

    found = texts.mapInArrow(context, "word binary, before int, after int, n long").groupBy("word", "before", "after").agg(F.sum("n").alias("n"))
    rows = found.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("before", "after", "n")).alias("pairs"))
    chosen = rows.select("word", "pairs").mapInArrow(choose, "word binary, class int, pairs array<struct<before: int, after: int, n: bigint>>")
    with arrow_rows(texts.sparkSession, 256):  # a row may hold many pairs
        return materialize(chosen.withColumn("c", F.aggregate("pairs", F.lit(0).cast("long"), lambda a, p: a + p["n"])))


@dataclass
class Model:
    tokens: int  # N
    distinct: int  # V
    ends: int
    ids: dict[bytes, int]  # the held words
    base: np.ndarray  # log10 of each held word's base probability; the last is the end's
    emit: np.ndarray  # log10 P(word | class) of each held word; the last is the end's
    of: np.ndarray  # class of each held word; the last is the end's
    step: np.ndarray  # log10 P(class | class before)
    bigrams: int  # that the transitions were counted from
    mass: np.ndarray  # tokens of each class
    size: np.ndarray  # words of each class
    unknown: int  # the class of words that no training text has

    def emission(self, c: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words that occur c times."""
        return np.log10((c + ADD) / (self.mass[of] + ADD * (self.size[of] + (of == self.unknown))))


def train(texts: DataFrame, top: int = TOP, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the words that aren't held as a table (word, c, class). texts: (text), the training rows."""
    if top >= TAIL:
        raise ValueError(f"at most {TAIL - 1} words can be held")
    vocabulary = materialize(count_words(texts))
    ends = texts.count()
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = vocabulary.orderBy(F.desc("c"), "word").limit(top).toArrow()
    head_words, head_counts = head["word"].to_pylist(), head["c"].to_numpy()
    ids = {w: i for i, w in enumerate(head_words)}
    classes = min(classes, max(1, len(head_words) // 2))
    m = classes + 1
    discard(vocabulary)
    encoded = encode_corpus(texts, ids)
    of, big, _ = exchange(encoded, len(ids), classes, rounds)
    discard(encoded)
    mass = np.bincount(of[:-1], weights=head_counts, minlength=m)
    size = np.bincount(of[:-1], minlength=m).astype(np.float64)
    steps = big.astype(np.float64)
    others = classify_others(texts, ids, of, big)
    for r in others.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["class"]] += r["c"]
        size[r["class"]] += r["n"]
    pair = others.select("class", F.explode("pairs").alias("p"))
    ways = F.array(F.struct(F.col("p.before").alias("a"), F.col("class").alias("b")), F.struct(F.col("class").alias("a"), F.col("p.after").alias("b")))
    for r in pair.select(F.col("p.n").alias("n"), F.explode(ways).alias("w")).filter("w.a >= 0 and w.b >= 0").groupBy("w.a", "w.b").agg(F.sum("n").alias("n")).unionByName(other_bigrams(texts, ids, others)).collect():  # two numbers a pair of classes
        steps[r["a"], r["b"]] += r["n"]
    step = np.log10((steps + ADD_CLASS) / (steps.sum(1, keepdims=True) + ADD_CLASS * m))
    tokens, distinct = n + ends, v + (ends > 0)
    base = np.log10((np.append(head_counts, ends) + ADD) / (tokens + ADD * (distinct + 1)))
    model = Model(tokens, distinct, ends, ids, base, np.zeros(len(ids) + 1), of, step, int(steps.sum()), mass, size, int(np.argmax(size[:classes])) if classes else 0)
    model.emit[:-1] = model.emission(head_counts.astype(np.float64), of[:-1])
    return model, others.select("word", "c", "class")


def score_texts(df: DataFrame, model: Model, others: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity): one row per input row.

    A null text counts as empty: one token, the end. Repeated rows are scored one by one; null ids stay; other columns are
    left out. An empty table gives an empty table. A model of no texts gives every token the same small probability.
    """
    import zstandard

    kind = df.schema[id_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(model)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the text, under a key that no word is and no other row has, and one for each of its words that aren't held."""
        known, pack = held.value.ids, zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            rows, words, places, texts = [], [], [], []
            for r, t in enumerate(batch.column(2).to_pylist()):
                tail: dict[bytes, int] = {}
                found = words_of(t)
                codes = [TAIL + tail.setdefault(w, len(tail)) if c is None else c for w, c in zip(found, map(known.get, found), strict=True)]
                rows += [r] * (1 + len(tail))
                words += [b" %d" % batch.column(0)[r].as_py(), *tail]
                places += [None, *tail.values()]
                texts += [pack.compress(np.array(codes, "<u4").tobytes()), *([None] * len(tail))]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.binary()), pa.array(places, pa.int32()), pa.array(texts, pa.binary())], names=["_row", "_id", "word", "_place", "_text"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, unpack = held.value, zstandard.ZstdDecompressor()
        end = len(m.base) - 1
        all_mass = float(np.log10(m.tokens + ADD * (m.distinct + 1)))
        for batch in slices(batches, 1024):
            out = []
            for packed, met in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                code = np.frombuffer(unpack.decompress(packed), "<u4").astype(np.int64)
                tail = code >= TAIL
                flat = met.values
                place, c, of = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                count, klass = np.zeros(len(place) + 1), np.full(len(place) + 1, m.unknown)
                count[place], klass[place] = c, np.where(of < 0, m.unknown, of)
                local = code[tail] - TAIL
                word = np.where(tail, end, code)
                classes, emit, base = m.of[word], m.emit[word], m.base[word]
                classes[tail] = klass[local]
                emit[tail] = m.emission(count[local], klass[local])
                base[tail] = np.log10(count[local] + ADD) - all_mass
                path = np.concatenate([m.of[[end]], classes, m.of[[end]]])
                out.append((len(code) + 1, int((~tail).sum() + (count[local] > 0).sum()) + (m.ends > 0), float(base.sum() + m.base[end]), float(emit.sum() + m.emit[end] + m.step[path[:-1], path[1:]].sum())))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    inner = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    pieces = inner.mapInArrow(number, f"_row long, _id {kind}, word binary, _place int, _text binary").join(others, "word", "left")
    found = F.when(F.col("_place").isNotNull(), F.struct(F.col("_place").alias("place"), F.coalesce("c", F.lit(0)).cast("long").alias("c"), F.coalesce("class", F.lit(-1)).alias("class")))
    rows = pieces.groupBy("_row").agg(F.first(F.when(F.col("_place").isNull(), F.struct("_id", "_text")), ignorenulls=True).alias("own"), F.collect_list(found).alias("met")).select("own._id", "own._text", "met")
    with arrow_rows(df.sparkSession, 512):  # a row holds a whole text
        scored = materialize(rows.mapInArrow(score, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double"))
    return scored.select(id_col, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; the model learns from those that are not held out."""
    documents = table(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 1
    model, others = train(documents.filter(~F.coalesce(held_out, F.lit(False))).select("text"))
    return score_texts(documents, model, others).withColumn("held_out", F.coalesce(held_out, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
