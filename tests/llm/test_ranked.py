"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from helixspark.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    found = [(i, Counter(ws), len(ws)) for i, t in docs if (ws := terms(t))]
    n, words = len(found), sum(size for _, _, size in found)
    df = Counter(w for _, c, _ in found for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in found:
            m = 100 - 90 + (90 * size * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng, n):
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(6)]
    return [" ".join(rng.choices(rng.choice(topics) + ["the", "of", "and"] * 5, k=rng.randint(1, 60))) for _ in range(n)]


def test_ranking_equals_plain_scores(spark):
    rng = random.Random(5)
    texts = corpus(rng, 500)
    docs = [*enumerate(texts), (900, None), (901, ""), (902, " -- \n"), (None, texts[3]), (7, texts[7]), (7, texts[9]), (903, "ÄÖ x² THE Of"), *((k, texts[0]) for k in range(1000, 1100))]
    items = [(k, " ".join(rng.choices(t.split(), k=min(8, len(t.split()))))) for k, t in enumerate(rng.sample(texts, 25))]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "the THE of"), (103, "äÖ X²"), (None, "t1w1 t2w2"), (104, texts[0])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(3)
    asked = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, score string")
    want = plain(docs, items)
    assert rows(ranked.rank_documents(df, asked)) == want
    assert rows(ranked.rank_documents(df, asked, shard=700, cluster=8)) == want
    assert rows(ranked.rank_documents(df, asked, shard=3000, cluster=4, item_bytes=400)) == want


def test_nothing_to_rank(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(ranked.rank_documents(none, items)) == rows(ranked.rank_documents(some, items.limit(0))) == rows(ranked.rank_documents(some, items.withColumn("text", items.text.cast("string").substr(9, 1)))) == []
    named = ranked.rank_documents(some.selectExpr("'k' AS doc_id", "text"), items)
    assert rows(named) == [(1, 1, "k", named.first()["score"])]


def test_bisection_gathers_documents_and_bounds_skip_postings():
    rng = random.Random(8)
    topics = [list(range(40 * k, 40 * k + 40)) for k in range(8)]
    docs = [sorted(set(rng.choices(topics[rng.randrange(8)], k=25)) | {320, 321}) for _ in range(512)]
    sizes, flat = np.array([len(d) for d in docs]), np.array([t for d in docs for t in d])
    own = ranked.halved(sizes, flat, 64)
    assert sorted(np.bincount(own)) == [64] * 8
    topic = np.array([d[0] // 40 for d in docs])
    assert sum(np.bincount(topic[own == c]).max() for c in range(8)) > 300  # 512 if each cluster is one topic; some 100 by chance
    table = pa.table({"shard": [0] * 512, "id": list(range(512)), "n": [len(d) for d in docs], "terms": pa.array(docs, pa.list_(pa.int32())), "times": pa.array([[rng.choice([1, 1, 2, 9]) for _ in d] for d in docs], pa.list_(pa.int32()))})
    row = ranked._build(512, int(sizes.sum()), 16)(table)
    shard = ranked.Shard({c: row.column(c).combine_chunks()[0].values for c in ("ids", *ranked._INDEX)})
    asked, weights = np.array(topics[2][:6]), np.full(6, 1000)
    places, scores, read = shard.top(asked, weights, 10)
    _, full, whole = shard.top(asked, weights, 1000)
    assert len(places) == 10 and scores.tolist() == full[:10].tolist()
    assert read < whole == sum(t in set(asked.tolist()) for d in docs for t in d)
    assert shard.top(asked, weights, 10, int(scores[-1]))[0].tolist() == places.tolist()  # equal scores still enter
    assert shard.top(asked, weights, 10, int(scores[0]) + 1)[2] <= read


def test_distributed_halvings_keep_all_rows_and_balance(spark):
    rng = random.Random(2)
    topics = [list(range(30 * k, 30 * k + 30)) for k in range(4)]
    docs = [(k, 1, sorted(set(rng.choices(topics[rng.randrange(4)], k=15))), k, 0) for k in range(800)]
    df = spark.createDataFrame([(i, n, t, [1] * len(t), r, node) for i, n, t, r, node in docs], "id long, n long, terms array<int>, times array<int>, row long, node int")
    for level in range(2):
        df = ranked._halve(df, level)
    found = df.collect()
    assert sorted(r.id for r in found) == list(range(800))
    count = Counter(r.node for r in found)
    assert set(count) == {0, 1, 2, 3} and min(count.values()) > 120
    topic = Counter((r.node, r.terms[0] // 30) for r in found)
    assert sum(max(topic[node, t] for t in range(4)) for node in range(4)) > 400  # some 200 by chance
