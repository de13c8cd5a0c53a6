"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its first 3, 4 and 5 letters, so that an unseen
ending of a known stem still counts. Filters of widths 1, 2 and 3 run over the words of the whole text; each is
max-pooled, and a logistic layer weighs the maxima. The score is calibrated on labelled rows that training leaves out, and
so is a threshold for each language: ``rejected`` says whether the score reaches the threshold of the row's language. The
language chooses the threshold only; the score comes from the text alone.

Every labelled row that isn't held out takes part. A bounded sample, which the driver holds, gives the weights to start
from: about ``PER_CLASS`` rows of each language and label, and at most ``SAMPLE`` rows and ``SAMPLE_CHARS`` characters over
all languages. Its rows are chosen by the hash of their id and shares that come from the groups' counts alone. Four fifths
of all rows then learn on from those weights, shard by shard on the executors, and the shards' weights are averaged; how
many texts have a word is counted over all of them. The last fifth gives scale and thresholds, by a histogram. Scoring
goes over all rows, batch by batch, without a shuffle. A word's filter responses are worked out once per task and looked
up afterwards.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialize, slices, table

PER_CLASS, SAMPLE, SAMPLE_CHARS = 1000, 16_000, 40_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
FEATURES, PAD = 4, max(WIDTHS) - 1
#: Passes over the sample: fewer for a large one.
EPOCHS, VISITS, BATCH, RATE = (8, 40), 40_000, 32, 0.05
#: Training texts that a hashed word or stem must occur in.
MIN_TEXTS = 3
#: Rows that a language's groups get at least: bounds the number of languages that are sampled apart.
MIN_GROUP = 100
#: Words whose responses a task keeps, and characters that it looks at together.
KNOWN, CHARS = 100_000, 200_000
#: Rows that learn on side by side from the same weights, and how fast; what weights are rounded to when averaged.
SHARD, LATE_RATE, UNIT = 8192, 0.01, 1 << 24
#: Parts of a logit that calibration tells apart, and languages with a threshold of their own at most.
BIN, MOST_LANGUAGES = 64, 100
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashed(word: str) -> tuple[int, ...]:
    """Rows of the embedding table of a word and its stems; row 0 stays zero."""
    one = [zlib.crc32(word.encode()) % (BUCKETS - 1) + 1]
    return (*one, *(zlib.crc32(b"%d_" % k + word[:k].encode()) % (BUCKETS - 1) + 1 for k in (3, 4, 5)))


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # width x DIM x FILTERS for each width
    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)  # by language; "" for any other
    descent: _Descent | None = None  # how learning may go on; stays on the driver

    def responses(self, words: list[str]) -> np.ndarray:
        """Responses of every filter's every place to each word; their sums along a text are the convolutions."""
        x = self.table[np.array([hashed(w) for w in words], np.int32).reshape(-1, FEATURES)].sum(axis=1)
        return np.concatenate([x @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def logits(self, responses: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """responses: a row per word, PAD zero rows after each text; starts: each text's first row."""
        pooled, at = [], 0
        end = len(responses)
        for width in WIDTHS:
            s = responses[:, at : at + FILTERS].copy()
            for j in range(1, width):
                s[: end - j] += responses[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            for k in range(width - 1):  # windows that would reach into the next text
                s[np.append(starts[1:], end) - 1 - k] = 0
            pooled.append(np.maximum.reduceat(s, starts, axis=0))
            at += width * FILTERS
        return np.concatenate(pooled, axis=1) @ self.weight + self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("", 0.5))


class _Descent:
    """Adagrad over all weights of a model, batch by batch."""

    def __init__(self, emb: np.ndarray, filters: list[np.ndarray], weight: np.ndarray, bias: float):
        self.emb, self.filters, self.weight, self.bias = emb, filters, weight, bias
        self.g_emb = np.full_like(emb, 1e-4)
        self.g_filters, self.g_weight, self.g_bias = [np.full_like(f, 1e-4) for f in filters], np.full_like(weight, 1e-4), 1e-4

    def step(self, ids: list[np.ndarray], y: np.ndarray, up: float, rate: float, learnt: np.ndarray | None = None) -> None:
        """One step over a batch. ids: rows of the embedding table, by word, of each text. up: weight of a positive row. learnt: what may move; row 0 never does."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        starts, words, text = np.cumsum(size) - size, np.concatenate(ids), np.repeat(np.arange(len(ids)), size)
        last = np.cumsum(size) - 1
        x = self.emb[words].sum(axis=1)
        best, pooled = [], []
        for f in self.filters:
            s = x @ f[0]
            for j in range(1, len(f)):
                s[: len(s) - j] += x[j:] @ f[j]
            for k in range(len(f) - 1):  # windows that would reach into the next text; one of zeros stands before
                s[last - k] = -1
            top = np.maximum.reduceat(s, starts, axis=0)
            place, column = np.nonzero(s == top[text])
            at = np.zeros_like(top, dtype=np.int64)
            at[text[place[::-1]], column[::-1]] = place[::-1]  # the first of equal ones
            best.append(at)
            pooled.append(top)
        h = np.concatenate(pooled, axis=1)
        p = 1 / (1 + np.exp(-np.clip(h @ self.weight + self.bias, -40, 40)))
        d = ((p - y) * np.where(y > 0, up, 1.0) / len(ids)).astype(np.float32)
        dh = d[:, None] * self.weight
        d_filters, hit_rows, hit_grads = [np.zeros_like(f) for f in self.filters], [], []
        for k, f in enumerate(self.filters):
            mine = dh[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(f)):
                place = best[k] + j
                d_filters[k][j] = np.einsum("bfd,bf->df", x[place], mine)
                hit_rows.append(words[place].ravel())
                hit_grads.append(np.repeat((f[j].T * mine[:, :, None]).reshape(-1, DIM), FEATURES, axis=0))
        for f, g, df in zip(self.filters, self.g_filters, d_filters, strict=True):
            g += df * df
            f -= rate * df / np.sqrt(g)
        d_weight, d_bias = d @ h, float(d.sum())
        self.g_weight += d_weight * d_weight
        self.weight -= rate * d_weight / np.sqrt(self.g_weight)
        self.g_bias += d_bias * d_bias
        self.bias -= rate * d_bias / np.sqrt(self.g_bias)
        rows = np.concatenate(hit_rows)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        hit, d_emb = rows[first], np.add.reduceat(np.concatenate(hit_grads)[order], first, axis=0)
        moves = (hit > 0) if learnt is None else learnt[hit]
        hit, d_emb = hit[moves], d_emb[moves]
        self.g_emb[hit] += d_emb * d_emb
        self.emb[hit] -= rate * d_emb / np.sqrt(self.g_emb[hit])


def _positive_weight(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return min(8.0, (1 - share) / share)


def _fit(ids: list[np.ndarray], y: np.ndarray, seed: int) -> _Descent:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    seen_in = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=BUCKETS)
    emb[seen_in < MIN_TEXTS] = 0  # what few texts have is not learnt, and unknown words say nothing
    emb[0] = 0
    learnt = seen_in >= MIN_TEXTS
    learnt[0] = False
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    weight = rng.normal(0, 0.5, FILTERS * len(WIDTHS)).astype(np.float32)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    out = _Descent(emb, filters, weight, float(np.log(share / (1 - share))))
    epochs = min(max(VISITS // len(ids), EPOCHS[0]), EPOCHS[1])
    for epoch in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            out.step([ids[r] for r in rows], y[rows], _positive_weight(float(y.mean())), RATE * (1 - epoch / (epochs + 1)), learnt)
    return out


def _gap(values: np.ndarray, y: np.ndarray) -> float:
    """The cut with most F1; in the middle of the gap that it lies in."""
    order = np.argsort(-values, kind="stable")
    v, hits = values[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(v) + 1) + y.sum())
    f1[:-1][v[:-1] == v[1:]] = -1
    k = int(np.argmax(f1))
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k])


def _encoded(text: str, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Rows of the embedding table, by word, with zeros behind. known: what words are hashed to; grows."""
    if len(known) > KNOWN:
        known.clear()
    found = [known.get(w) or known.setdefault(w, hashed(w)) for w in words_of(text)]
    return np.concatenate([np.array(found, np.int32).reshape(-1, FEATURES), np.zeros((PAD + 1, FEATURES), np.int32)])


def train(rows: list[tuple[str, int, str]], seed: int = 7, per_language: int = 20) -> Model:
    """rows: (text, label, language). A fifth of them is left out of fitting and calibrates the score and the thresholds.

    The score is scaled so that the best cut over all languages lies at 0.5. A language gets a threshold of its own from
    ``per_language`` positive rows among the left out on. Without rows of both labels the model scores every text alike.
    """
    y = np.array([r[1] for r in rows], np.float32)
    if len(rows) < 10 or y.min() == y.max():
        flat = Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0)
        flat.shift = 1.0 if len(rows) and y.mean() > 0.5 else -1.0
        return flat
    known: dict[str, tuple[int, ...]] = {}
    ids = [_encoded(text, known) for text, _, _ in rows]
    del known
    out = np.zeros(len(rows), bool)  # every fifth of either label
    for label in (0, 1):
        out[np.flatnonzero(y == label)[::5]] = True
    fitted = _fit([ids[i] for i in np.flatnonzero(~out)], y[~out], seed)
    model = Model(fitted.emb, fitted.filters, fitted.weight, fitted.bias, descent=fitted)
    check = np.flatnonzero(out)
    logits = []
    for i in check:
        x = model.table[ids[i]].sum(axis=1)
        logits.append(model.logits(np.concatenate([x @ f[j] for f in model.filters for j in range(len(f))], axis=1), np.array([0]))[0])
    logits = np.array(logits, np.float64)
    cut, spread = _gap(logits, y[out]), float(np.std(logits)) or 1.0
    model.scale, model.shift = 2.0 / spread, -2.0 * cut / spread
    scores = model.score(logits)
    model.thresholds = {"": 0.5}
    langs = np.array([rows[i][2] or "" for i in check])
    for lang in sorted(set(langs.tolist()) - {""}):
        mine = langs == lang
        if y[out][mine].sum() >= per_language:
            model.thresholds[lang] = min(0.9, max(0.1, _gap(scores[mine], y[out][mine])))
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, held_out: int | None = 0) -> list[tuple[str, int, str]]:
    """(text, label, language) of about per_class rows of each language and label, by the hash of the id; the held-out fifth is left out.

    A group of n rows and c characters keeps the rows whose hash lies in its first per_class / n, or less where ``sample``
    rows or ``chars`` characters shared evenly by all groups allow less. Null labels and null ids are left out;
    of different labels of one id the greater holds; no text is cut. Rows that repeat an id stay together, unless they are
    so many that the sample would be twice as large as allowed: then rows are drawn by a hash of their own.
    """
    known = labels.filter(f"doc_id is not null and {label_col} is not null").groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_label"))
    docs = documents.filter("doc_id is not null").select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), F.col("text").cast("string").alias("_text"))
    if held_out is not None:
        known = known.filter(crc_mod("doc_id", 5) != held_out)
    size = F.coalesce(F.length("_text"), F.lit(0)).cast("long")
    named = docs.select("doc_id", "_lang", size.alias("_size")).join(known, "doc_id")
    n_langs = 1 + SAMPLE // (4 * MIN_GROUP)  # the languages with most rows; the others share a group
    top = [r["_lang"] for r in named.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(n_langs).collect()]
    group = F.when(F.col("_lang").isin(top), F.col("_lang")).otherwise(F.lit("")) if top else F.lit("")
    counts = named.groupBy(group.alias("_lang"), "_label").agg(F.count("*").alias("n"), F.sum("_size").alias("chars")).collect()
    each, each_chars = min(per_class, sample // max(1, len(counts))), chars // max(1, len(counts))
    share = F.lit(0.0)
    for r in counts:
        part = min(1.0, each / r["n"], each_chars / max(1, r["chars"]))
        share = F.when((group == r["_lang"]) & (F.col("_label") == r["_label"]), F.lit(part)).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    picked = named.filter(place < share)
    chosen = picked.select("doc_id", "_label").distinct()
    n, held = picked.filter(F.col("_size") <= max(1, each_chars)).agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    over = max(n / (2 * sample), held / (2 * chars))
    rows = docs.join(F.broadcast(chosen), "doc_id").filter(size <= max(1, each_chars)).select("doc_id", "_text", "_label", "_lang")
    if over > 1:
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("doc_id", "_text", F.monotonically_increasing_id()), 11) / float(1 << 53) < 1 / over)
    rows = rows.collect()  # about twice ``sample`` rows and ``chars`` characters at most
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or ""))
    return [(r[1] or "", r[2], r[3]) for r in rows]


def _logits(model: Model, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the logits of its texts, which stand in the column of that number."""
    known: dict[str, int] = {"": 0}
    table = np.zeros((1024, sum(WIDTHS) * FILTERS), np.float32)  # grows by halves
    for batch in batches:
        texts = batch.column(column).to_pylist()
        logits = np.zeros(len(texts))
        at = 0
        while at < len(texts):  # as many texts at once as have CHARS characters
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHARS):
                size += len(texts[to] or "")
                to += 1
            starts, words = [], []
            for t in texts[at:to]:
                starts.append(len(words))
                words += words_of(t or "")
                words += [""] * (PAD + 1)
            if new := list(dict.fromkeys(w for w in words if w not in known)):
                if len(known) + len(new) > KNOWN:
                    known = {"": 0}
                    new = list(dict.fromkeys(w for w in words if w))
                n = len(known)
                known.update(zip(new, range(n, n + len(new)), strict=True))
                if len(known) > len(table):
                    table = np.concatenate([table[:n], np.zeros((max(len(known), n + n // 2) - n, table.shape[1]), np.float32)])
                table[n : len(known)] = model.responses(new)
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            logits[at:to] = model.logits(table[ids], np.array(starts))
            at = to
        yield batch, logits


def _checks(key: Column) -> Column:
    """Whether a row calibrates instead of being learnt from. key: its id as text."""
    return F.pmod(F.xxhash64(F.lit("check"), key), F.lit(5)) == 0


def _labelled(documents: DataFrame, labels: DataFrame, label_col: str, held_out: int | None, checks: bool, n: int) -> DataFrame:
    """(_shard, _lang, _text, _label): every row of documents with a label, but the held-out fifth; those that calibrate, or the others.

    Of different labels of one id the greater holds. Rows and labels are dealt out by shard together, so texts move once;
    a shard's rows are in the order of a hash. A bitmap of the labelled ids, a few bits for each of n, tells most texts
    without a label before they move.
    """
    key = F.col("doc_id").cast("string").alias("_key")
    known = labels.filter(f"doc_id is not null and {label_col} is not null").select(key, F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("string").alias("_text"), F.col(label_col).cast("int").alias("_known"))
    docs = documents.filter("doc_id is not null").select(key, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.lit(None).cast("int").alias("_known"))
    fit = _checks(F.col("_key")) == checks
    if held_out is not None:
        fit &= crc_mod("_key", 5) != held_out
    docs, known = docs.filter(fit), known.filter(fit)
    bits = 1 << min(32, max(10, (8 * n).bit_length()))
    word, bit = F.expr(f"shiftright(pmod(xxhash64('bit', _key), {bits}L), 6)"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64('bit', _key), 64L) as int))")
    held = known.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    docs = docs.withColumn("_bit", bit).join(F.broadcast(held), (word == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_bit")) != 0), "left_semi").drop("_bit")
    both = docs.unionByName(known).withColumn("_order", F.xxhash64("_key")).withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(max(1, -(-n // SHARD)))))
    dealt = both.repartition("_shard").sortWithinPartitions("_shard", "_order", "_key", "_text")
    label = F.max("_known").over(Window.partitionBy("_shard", "_order", "_key"))
    return dealt.withColumn("_label", label).filter("_text is not null and _label is not null").select("_shard", "_lang", "_text", "_label")


def _went_on(rows: DataFrame, start: Model, up: float) -> Model:
    """start, learnt on over every row of rows (as _labelled gives them): shards go on from it side by side, and their weights are averaged.

    An embedding's part in the mean is the number of the shard's texts that have it. Sums are of whole numbers, so they
    don't depend on the order. Embeddings that fewer than MIN_TEXTS texts of all have say nothing.
    """
    d = start.descent
    held = rows.sparkSession.sparkContext.broadcast(d)
    small = [*(f.shape for f in d.filters), d.weight.shape, (1,)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        now, mine, texts, ids, y = None, None, None, [], []

        def step() -> None:
            if ids:
                mine.step(ids, np.array(y, np.float32), up, LATE_RATE)
            ids.clear()
            y.clear()

        def out() -> pa.RecordBatch:
            step()
            hit = np.flatnonzero(texts)
            rest = np.concatenate([*(f.ravel() for f in mine.filters), mine.weight, [mine.bias]])
            rest = np.append(rest, np.zeros(-len(rest) % DIM)).reshape(-1, DIM)
            bucket = np.concatenate([hit, BUCKETS + np.arange(len(rest))])
            count = np.concatenate([texts[hit], np.full(len(rest), texts[0])])
            value = np.round(np.concatenate([mine.emb[hit], rest]).astype(np.float64) * UNIT).astype(np.int64) * count[:, None]
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(count), *(pa.array(value[:, k]) for k in range(DIM))], names=["bucket", "n", *(f"v{k}" for k in range(DIM))])

        for batch in slices(batches):
            for shard, text, label in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if shard != now:
                    if now is not None:
                        yield out()
                    now, mine, texts = shard, copy.deepcopy(held.value), np.zeros(BUCKETS, np.int64)
                ids.append(_encoded(text, known))
                y.append(label)
                texts[np.unique(ids[-1])] += 1  # row 0 is in every text
                if len(ids) == BATCH:
                    step()
        if now is not None:
            yield out()

    sums = rows.select("_shard", "_text", "_label").mapInArrow(run, "bucket long, n long, " + ", ".join(f"v{k} long" for k in range(DIM))).groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM))).toArrow()
    bucket, count = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    value = np.stack([sums.column(f"v{k}").to_numpy() for k in range(DIM)], axis=1) / (count[:, None] * UNIT)
    emb = np.zeros_like(d.emb)
    some = (bucket < BUCKETS) & (bucket > 0) & (count >= MIN_TEXTS)
    emb[bucket[some]] = value[some]
    rest = np.zeros((int(bucket.max()) + 1 - BUCKETS, DIM))
    rest[bucket[bucket >= BUCKETS] - BUCKETS] = value[bucket >= BUCKETS]
    parts = np.split(rest.ravel(), np.cumsum([int(np.prod(x)) for x in small]))
    *filters, weight, bias = (p.reshape(x).astype(np.float32) for p, x in zip(parts, small, strict=False))
    return Model(emb, filters, weight, float(bias[0]), start.scale, start.shift, start.thresholds)


def _cut(bins: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The cut with most F1 over a histogram (distinct bins, their rows and positive rows); in the middle of the gap that it lies in."""
    order = np.argsort(-bins)
    bins, n, hits = bins[order], np.cumsum(n[order]), np.cumsum(hits[order])
    k = int(np.argmax(2 * hits / (n + hits[-1])))
    return float(bins[k] + bins[k + 1]) / 2 if k + 1 < len(bins) else float(bins[k])


def _calibrated(rows: DataFrame, model: Model, per_language: int = 20) -> Model:
    """model with scale, shift and thresholds of every row of rows (as _labelled gives them), which it has not learnt from. Logits are counted to a BIN-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, logits in _logits(model, slices(batches), 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.clip(logits, -40, 40) * BIN).astype(np.int64)), batch.column(2)], names=["lang", "bin", "label"])

    counted = materialize(rows.select("_lang", "_text", "_label").mapInArrow(run, "lang string, bin long, label int").groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("hits")))
    histogram = lambda df: tuple(df.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow().column(k).to_numpy() for k in range(3))
    bins, n, hits = histogram(counted)
    if not hits.sum() or hits.sum() == n.sum():
        return model
    cut, mean = _cut(bins, n, hits) / BIN, np.average(bins, weights=n)
    spread = float(np.sqrt(np.average((bins - mean) ** 2, weights=n))) / BIN or 1.0
    out = replace(model, scale=2.0 / spread, shift=-2.0 * cut / spread, thresholds={"": 0.5})
    langs = [r["lang"] for r in counted.filter("lang <> ''").groupBy("lang").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= per_language).orderBy(F.desc("hits"), "lang").limit(MOST_LANGUAGES).collect()]
    mine = counted.filter(F.col("lang").isin(langs)).toPandas() if langs else None
    for lang in langs:
        of = mine[mine["lang"] == lang]
        own = _cut(of["bin"].to_numpy(), of["n"].to_numpy(), of["hits"].to_numpy()) / BIN
        out.thresholds[lang] = min(0.9, max(0.1, float(out.score(np.array([own]))[0])))
    return out


def learn(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: int | None = 0) -> Model:
    """A model of every labelled row but the held-out fifth. A balanced sample gives the weights to start from, four fifths of all rows go on from them, the others calibrate."""
    key = F.col("doc_id").cast("string")
    start = train(labelled_sample(documents.filter(~_checks(key)), labels, label_col, held_out=held_out))
    if start.descent is None:
        return start
    known = labels.filter(f"{label_col} is not null").groupBy(key.alias("_key")).agg(F.max(label_col).cast("int").alias("_label"))
    n, positive = documents.select(key.alias("_key")).join(known, "_key").agg(F.count("*"), F.sum(F.when(F.col("_label") > 0, 1).otherwise(0))).first()
    of = lambda checks: _labelled(documents, labels, label_col, held_out, checks, n)
    return _calibrated(of(True), _went_on(of(False), start, _positive_weight(positive / n)))


def score_toxicity(df: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """(doc_id, score, predicted, threshold, rejected), one row per input row; with ``keep`` the input's columns too.

    A null text counts as empty and gets the score of no words; a null language has the general threshold. Repeated rows
    are scored one by one. An empty table gives an empty table. Columns of the input named like an output are replaced.
    """
    outs = ("score", "predicted", "threshold", "rejected")
    names = [c for c in df.columns if c not in outs] if keep else ["doc_id"]
    inner = df.select(*(F.col(c) for c in names), F.col("text").cast("string").alias("_t"), F.col("lang").cast("string").alias("_l"))
    schema = inner.drop("_t", "_l").schema
    for name, kind in zip(outs, ("double", "integer", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)

    lean = replace(model, descent=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, logits in _logits(lean, slices(batches), len(names)):
            score = lean.score(logits)
            cut = np.array([lean.threshold(x) for x in batch.column(len(names) + 1).to_pylist()], np.float64)
            columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(cut), pa.array(score >= cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, *outs])

    return inner.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that are not held out."""
    documents = table(spark, sf_dir)
    model = learn(documents, table(spark, sf_dir, "labels"))
    return score_toxicity(documents, model).withColumn("held_out", crc_mod("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted", "threshold", "rejected")
