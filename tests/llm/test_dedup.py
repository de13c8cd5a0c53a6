import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.llm import simhash, suffixes
from helixspark.llm.components import connected_components
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def near_texts(rng, n):
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 30, 200]))) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        t = rng.choice(base).split(" ")
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("group", [2048, 8])
def test_simhash_components(spark, group):
    rng = random.Random(group)
    rows = list(enumerate(near_texts(rng, 160))) + [(500, None), (501, ""), (502, "  \n"), (503, "One"), (504, "one"), (505, "É é"), (506, "x" * 200_000)]
    rows += [(7, rows[7][1])]
    want = {i: brute.simhash(t) for i, t in rows}
    reach = brute.components(want)
    got = simhash.near_duplicates(docs(spark, rows), group=group).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in want.items()}
    assert {r.doc_id: r.component_id for r in got} == reach


def test_simhash_links_of_close_fingerprints(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(3):  # families that share a half, or differ in few bits all over: long runs of a key
        root = rng.getrandbits(64)
        fps |= {root ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) ^ (rng.getrandbits(3) << 40) for _ in range(150)}
        fps |= {root ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for group in (2048, 10):
        got = connected_components(simhash.links(df, group=group)).collect()
        root = {r.node % 2**64: r.root for r in got}
        want = brute.components({x: x for x in fps})
        groups = {}
        for x in fps:
            groups.setdefault(root.get(x, f"own{x}"), set()).add(x)
        expect = {}
        for x in fps:
            expect.setdefault(want[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_simhash_nulls_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "a b c d", 1, 2), (None, "a b c d", 1, 2), (3, "a b c d", 1, 2), (None, "q r s t u", 1, 2)], "doc_id long, text string, fp int, component_id int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert set(got.values()) == {3, None} and len(got) == 3
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_components_long_path_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(200, 400)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[j] == 100 for j in (100, *range(200, 400)))


def suffix_rows(rng, n, alphabet, lo, hi):
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(lo, hi))) for _ in range(5)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(shared)[rng.randrange(3) :] if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(hi))))
        out.append((i * 3, "".join(parts)))
    return out


@pytest.mark.parametrize(("window", "gram", "alphabet", "group"), [(100, 32, "abcdé ", 16_384), (12, 4, "ab", 16_384), (12, 4, "abé", 2), (20, 8, "a", 4), (16, 8, "abcdefgh", 3)])
def test_suffix_runs(spark, window, gram, alphabet, group):
    rng = random.Random(window + group)
    rows = suffix_rows(rng, 60, alphabet, 2 * window // 3, 4 * window)
    rows += [(901, None), (902, ""), (903, "short"), (904, rows[3][1]), (905, "ab" * window)]
    rows += [rows[4], rows[4], (6, "another text under the same id " * 9)]
    got = suffixes.remove_repeats(docs(spark, rows), window=window, gram=gram, group=group).collect()
    assert len(got) == len(rows)
    order = sorted({(i, t or "") for i, t in rows})
    want = dict(zip(order, brute.removed([(i, t.encode()) for i, t in order], window), strict=True))
    seen = sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert seen == sorted((i, *want[i, t or ""]) for i, t in rows)


def test_suffix_runs_with_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_mix", lambda x: x & np.uint64(0xF))  # in the driver: tasks get the module by import, so compare directly
    rng = random.Random(5)
    window, gram = 12, 4
    texts = [t.encode() for _, t in suffix_rows(rng, 30, "ab", 8, 40)]
    rows = []
    for doc, t in enumerate(texts):
        for pos in range(len(t) - window + 1):
            rows.append((1, doc, pos, 0, 0, 0, t[pos : pos + window]))
    batches = [suffixes._context_batch(rows)]
    found = [r for b in suffixes._compare(window, gram, 10**6)(iter(batches)) for r in b.to_pylist()]
    first = {}
    for _, doc, pos, *_, c in rows:
        first.setdefault(c, (doc, pos))
    want = {(doc, pos) for _, doc, pos, *_, c in rows if first[c] != (doc, pos)}
    assert {(r["doc"], r["pos"]) for r in found} == want and want


def test_suffix_plain_ids_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CONTEXTS", 7)
    monkeypatch.setattr(suffixes, "ANCHORS", 50)
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(40))
    rows = [(i, "".join(rng.choice("xy") for _ in range(rng.randrange(30))) + shared + "".join(rng.choice("xy") for _ in range(rng.randrange(30)))) for i in range(300)]
    want = brute.removed([(i, t.encode()) for i, t in rows], 16)
    got = suffixes.remove_repeats(docs(spark, rows), window=16, gram=8, group=20).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want


def test_suffix_edges(spark):
    assert suffixes.remove_repeats(docs(spark, []).limit(0)).count() == 0
    t = "é" * 60 + "the rest of it"
    rows = spark.createDataFrame([(1, t, 0, "x"), (2, "a" + t, 0, "x"), (None, t, 0, "x")], "doc_id long, text string, n_bytes int, spans string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(rows).collect()}
    assert got[2].text == "a" and got[None].text == "" and got[1].n_removed > 0
    long = "".join(random.Random(1).choices("abcdefghij klm", k=5_000_000))
    got = suffixes.remove_repeats(docs(spark, [(1, long), (2, long[2_000_000:2_300_000] + "z")])).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 300_000]
