"""Token counts, packing, toxicity and decontamination."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixspark.llm import decontaminate, packing, token_counts, tokenizing, toxicity
from tests.llm.test_dedup import docs

TEXTS = ["", "Hello world", "it's  we'll\n\n x", "<|endoftext|>", "a<|endoftext|> b", "é漢字 🎉 ١٢", "　 \x1c\x85 tab\t", "x" * 3000, " ".join(f"word{i}" for i in range(2000)), "\n".join(["line of text"] * 300), " " * 500]
LIBRARY = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ranks_give_the_ids_of_the_library(text):
    assert tokenizing.load("byte_bpe_50k.tiktoken").ids(text).tolist() == library(text)
    for joined in (text, f"a {text}\n{text} b"):
        assert tokenizing.load("byte_bpe_50k.json").ids(joined).tolist() == library(joined)


def test_json_ranks_are_those_of_the_rank_file():
    one, two = tokenizing.load("byte_bpe_50k.json"), tokenizing.load("byte_bpe_50k.tiktoken")
    assert (one.sizes == two.sizes).all() and one.encoding._mergeable_ranks == two.encoding._mergeable_ranks
    points = [chr(c) for c in range(0x3500) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3500, 0x110000, 997) if not 0xD800 <= c < 0xE000]
    text = " ".join(f"a{c}b {c}{c}" for c in points)
    for at in range(0, len(text), 30_000):
        assert one.ids(text[at : at + 30_000]).tolist() == library(text[at : at + 30_000])


def test_huge_texts_of_blanks_and_other_scripts():
    encoder, rng = tokenizing.load("byte_bpe_50k.json"), random.Random(1)
    for blank in (" ", "\n", " \n", "\u3000"):
        text = blank * (1_200_000 // len(blank))
        assert tokenizing.encode_spliced(encoder, text)[0].tolist() == library(text)
    words = ["слово", "ещё", "и", "длинное", "καί", "λόγος", "हिन्दी", "١٢"]
    spaced = " ".join(rng.choice(words) for _ in range(60_000))
    han = "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他") + ("。" if rng.random() < 0.05 else "") for _ in range(150_000))
    for text in (spaced, han):
        assert len(text) > 2 * tokenizing.CHUNK
        ids, splices, widened = tokenizing.encode_spliced(encoder, text)
        assert ids.tolist() == library(text) and splices >= 2 and not widened


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_splices_equal_the_whole(name):
    encoder, rng = tokenizing.load(name), random.Random(2)
    for text in TEXTS + ["".join(rng.choices(["the ", "cat", "'s", "\n", "  ", "été ", "12", "!", "<|endoftext|>"], k=800)) for _ in range(5)]:
        whole = encoder.ids(text)
        for chunk, overlap in ((200, 16), (300, 80), (64, 8)):
            ids, splices, widened = tokenizing.encode_spliced(encoder, text, chunk, overlap)
            assert ids.tolist() == whole.tolist()
    ids, splices, widened = tokenizing.encode_spliced(encoder, TEXTS[8], 500, 40)
    assert splices > 10
    _, splices, widened = tokenizing.encode_spliced(encoder, "x" * 3000, 500, 40)
    assert widened > 0 and splices == 0


def test_count_tokens(spark):
    rows = list(enumerate(TEXTS)) + [(50, None), (50, None), (None, "two words")]
    got = token_counts.count_tokens(docs(spark, rows), chunk=400, overlap=64, limit=500).collect()
    want = sorted((str(i), len((t or "").encode()), len(library(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 500) for r in got)
    for name, n in (("byte_bpe_50k.json", len(library("two words"))), ("piece_bpe_32k.model", len(sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model"))).encode("two words")))):
        assert token_counts.count_tokens(docs(spark, [(1, "two words")]), name).first().n_tokens == n
    clash = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id int, text string, n_tokens int, n_bytes int")
    assert token_counts.count_tokens(clash).columns[:3] == ["doc_id", "n_bytes", "n_tokens"]
    assert token_counts.count_tokens(docs(spark, []).limit(0)).count() == 0


def sequential_best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


def test_best_fit_runs_equal_the_sequential_packing():
    rng = random.Random(4)
    for size in (10, 64, 2048):
        for _ in range(30):
            lengths = [rng.randint(1, size) for _ in range(rng.randrange(1, 300))] + [rng.randint(1, max(1, size // 3))] * rng.randrange(50)
            counts = {}
            for n in lengths:
                counts[n] = counts.get(n, 0) + 1
            plan = packing.best_fit(counts, size)
            spans, placed = {}, {}
            for n, a, b, seq, off in plan:
                for r in range(a, b):
                    placed[n] = placed.get(n, 0) + 1
                    spans.setdefault(seq + r - a, []).append((off, off + n))
            assert placed == counts
            for s in spans.values():
                s.sort()
                assert s[0][0] == 0 and s[-1][1] <= size and all(x[1] == y[0] for x, y in zip(s, s[1:], strict=False))
            assert len(spans) == sequential_best_fit(lengths, size)


def test_pack(spark):
    rows = list(enumerate(TEXTS)) + [(50, None), (50, None), (None, "two words"), (51, "many words " * 100)]
    got = packing.pack(docs(spark, rows), size=64).collect()
    ids = {i: [*library(t or ""), 0] for i, t in rows}
    whole = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.length == 64 or r.piece == 0
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {i: len(x) * (2 if i == 50 else 1) for i, x in ids.items()}
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 64 and all(x[1] == y[0] for x, y in zip(s, s[1:], strict=False))
    assert packing.pack(docs(spark, []).limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 7, "x", 9)], "doc_id int, text string, piece int, length string, offset int")
    assert packing.pack(clash).first().length == len(library("a b")) + 1


def toxic_rows(rng, n):
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        bad = rng.random() < 0.2
        t = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if bad:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["awful", "vilest", "grim" + rng.choice("abcdefgh")])
        out.append((" ".join(t), int(bad), "en" if i % 3 else "fr"))
    return out


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(9)
    model = toxicity.train(toxic_rows(rng, 900))
    test = toxic_rows(rng, 300)
    df = docs(spark, [(i, t) for i, (t, _, _) in enumerate(test)])
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    right = sum(got[i].predicted == y for i, (_, y, _) in enumerate(test))
    assert right >= 290 and all(0 <= r.score <= 1 for r in got.values())
    assert set(model.thresholds) >= {"", "en"}


def test_toxicity_edges(spark):
    model = toxicity.train(toxic_rows(random.Random(1), 200))
    odd = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3), (None, "", "xx", 4), (2, "awful " * 40_000, "en", 5)], "doc_id long, text string, lang string, score int")
    got = toxicity.score_toxicity(odd, model, keep=True)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted", "threshold", "rejected"] and got.count() == 4
    assert len({r.score for r in got.filter("doc_id is null or doc_id = 1").collect()}) == 1
    assert toxicity.score_toxicity(docs(spark, []).limit(0), model).count() == 0
    flat = toxicity.train([])
    assert not toxicity.score_toxicity(odd, flat).filter("rejected").count()
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(odd, labels, held_out=None) == [("", 1, "")] * 2


def test_toxicity_logits_equal_a_plain_convolution(spark):
    model = toxicity.train(toxic_rows(random.Random(1), 200))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["awful", "w1", "w2", "grimx", "new", "Ü"]) for _ in range(n)) for n in (0, 1, 2, 3, 40, 900)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        vectors = [sum(model.table[k] for k in toxicity.hashed(w)) for w in toxicity.words_of(t)] + [np.zeros(toxicity.DIM)] * (toxicity.PAD + 1)
        pooled = []
        for f in model.filters:
            for c in range(toxicity.FILTERS):
                pooled.append(max(sum(float(vectors[p + j] @ f[j][:, c]) for j in range(len(f))) for p in range(len(vectors) - len(f) + 1)))
        logit = float(np.dot(pooled, model.weight)) + model.bias
        assert abs(got[i].score - 1 / (1 + np.exp(-np.clip(model.scale * logit + model.shift, -40, 40)))) < 1e-4


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, "word " * (50 if i % 7 else 4000)) for i in range(2000)]
    labels = spark.createDataFrame([(i, 1, int(i % 20 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs(spark, rows), labels, per_class=60, held_out=0)
    ones = sum(y for _, y, _ in got)
    assert 40 <= ones <= 80 and 35 <= len(got) - ones <= 90
    few = toxicity.labelled_sample(docs(spark, rows), labels, chars=60_000, held_out=None)
    assert 0 < sum(len(t) for t, _, _ in few) < 150_000
    many = spark.createDataFrame([(i, "a b", f"l{i % 500}", "s", 3) for i in range(1000)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(toxicity.labelled_sample(many, labels, sample=200, held_out=None)) < 500
    same = docs(spark, rows[:50] + [(1, f"copy {k}") for k in range(3000)] + [(1, "copy")] * 3000)
    assert 0 < len(toxicity.labelled_sample(same, labels, sample=100, held_out=None)) < 400


def substring_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=40))
def test_edit_distance(p, t):
    assert decontaminate.edit_distance_within(p.encode(), t.encode()) == substring_distance(p, t)


def edited(rng, x, n):
    x = list(x)
    for _ in range(n):
        k = rng.randrange(len(x))
        x[k : k + rng.randrange(2)] = rng.choice(["", "q", "zz"[:1]])
    return "".join(x)


def test_decontamination(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "rho", "sigma", "tau", "omega", "psi"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(8, 40))) for i in range(30)] + [(90, None), (91, "a"), (92, "tiny item"), (0, text(9))]
    rows = []
    for i in range(120):
        t = text(rng.randrange(30, 80))
        if i % 2:
            x = rng.choice(items[:30])[1]
            t += "\n " + edited(rng, x.upper() if i % 3 else x, rng.randrange(len(x) // 6 + 2)) + "  " + text(20)
        rows.append((i, t))
    rows += [(200, None), (201, ""), (None, items[0][1]), (203, text(3000) + " Tiny \x00 Item"), (203, "tiny ite")]
    got = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    found = {(str(r.doc_id), r.n_leaks > 0): {x.item_id: x.edits for x in r.leaks} for r in got}
    hits = misses = 0
    for i, t in rows:
        want = {}
        for k, x in items:
            n = decontaminate.normal(x)
            if n and (d := substring_distance(n, decontaminate.normal(t))) <= decontaminate.limit_of(n):
                want[k] = min(d, want.get(k, d))
        have = found.get((str(i), True), {})
        if i != 203:
            assert {k: have[k] for k in have if k != 0} == {k: want[k] for k in have if k != 0}  # nothing but what holds
            hits += len(set(want) & set(have))
            misses += len(set(want) - set(have))
    assert hits > 40 and misses <= 0.1 * (hits + misses)
    assert found["203", True] == {91: 0, 92: 0} and found["203", False] == {}
    parted = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), part_bytes=900).collect()
    assert sorted((str(r.doc_id), sorted((x.item_id, x.edits) for x in r.leaks)) for r in parted) == sorted((str(r.doc_id), sorted((x.item_id, x.edits) for x in r.leaks)) for r in got)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs(spark, rows[:3]), empty).filter("n_leaks > 0").count() == 0
    assert decontaminate.find_leaks(docs(spark, []).limit(0), empty).count() == 0


def test_embeddings_alone_reach_the_recall():
    """Windows at every place, no filter by blocks: CGK and bit sampling find nine of ten windows within the edits; the filter loses none."""
    rng = random.Random(18)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "rho", "sigma", "tau", "omega", "psi", "kappa"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(10, 30))) for i in range(12)]
    index = decontaminate.build_index(items)
    found = wanted = 0
    for i in range(90):
        x = items[i % 12][1]
        limit = decontaminate.limit_of(x.encode())
        t = decontaminate.normal(text(6) + " " + edited(rng, x, rng.randrange(limit + 1)) + " " + text(6))
        want = {k for k, (_, y) in enumerate(items) if substring_distance(y, t.decode()) <= decontaminate.limit_of(y.encode())}
        every = {k for k, _ in decontaminate.leaks_of(index, [t], every_place=True)[0]}
        some = {k for k, _ in decontaminate.leaks_of(index, [t])[0]}
        assert some <= every <= want and i % 12 in want
        found += len(every)
        wanted += len(want)
    assert found >= 0.9 * wanted and wanted >= 90


def test_batches_and_kept_bits_change_nothing(monkeypatch):
    rng = random.Random(28)
    text = lambda n: "".join(rng.choices("abcdef gh", k=n))
    items = [(k, text(n)) for k, n in enumerate([3, 7, 8, 30, 200, 900, 900, 4000])]
    texts = [decontaminate.normal(text(50) + edited(rng, x, rng.randrange(max(1, len(x) // 9))) + text(50)) for _, x in items for _ in range(3)] + [b"", b"a"]
    want = decontaminate.leaks_of(decontaminate.build_index(items), texts)
    assert sum(map(len, want)) > 15 and any(k < 2 for f in want for k, _ in f)
    monkeypatch.setattr(decontaminate, "BATCH_BYTES", 1)
    assert decontaminate.leaks_of(decontaminate.build_index(items), texts) == want
    for walk in range(3):
        bits = np.concatenate([decontaminate._bits(walk, a, a + 500, 11) for a in range(0, 4000, 500)])
        assert (bits == decontaminate._bits(walk, 0, 4000, 11)).all() and 0.48 < bits[:, 1:].mean() < 0.52


def test_a_very_long_item_takes_little_memory():
    import tracemalloc

    rng = random.Random(29)
    item = "".join(rng.choices("abcdefgh ", k=60_000))
    tracemalloc.start()
    index = decontaminate.build_index([(1, item)])
    raw = np.frombuffer(decontaminate.normal(item), np.uint8)
    assert decontaminate.candidates(index, raw, np.zeros(40, np.int64), np.arange(40), np.full(40, len(raw))).any()
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_splicing_goes_on_after_a_long_run(name):
    encoder, rng = tokenizing.load(name), random.Random(1)
    run = "".join(rng.choices("abcdefghij", k=30_000))
    for text in ("x" * 9000 + " y" * 9000, run + " " + " ".join(f"word{i}" for i in range(9000)), "a b " * 6000 + run + " c d" * 5000 + run, run):
        ids, splices, _ = tokenizing.encode_spliced(encoder, text, 4096, 256)
        assert ids.tolist() == encoder.ids(text).tolist()
        assert (splices > 3) == (" " in text)


def test_byte_level_files_with_other_options_go_to_their_library(tmp_path):
    import json

    raw = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for change in ({"pre_tokenizer": raw["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": raw["pre_tokenizer"] | {"use_regex": False}}, {"model": raw["model"] | {"ignore_merges": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(raw | change), encoding="utf-8")
        assert type(tokenizing._json(str(path))) is tokenizing.Json
    assert type(tokenizing.load("byte_bpe_50k.json")) is tokenizing.ByteLevelJson


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    rng = random.Random(3)
    rows = toxic_rows(rng, 1500)
    odd = [(" ".join(["plain"] * rng.randrange(5, 30) + ["zyx"] * (k % 2)), k % 2, "en") for k in range(600)]  # a word that only few of the sample have
    rows += odd
    table = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, _, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample
    monkeypatch.setattr(toxicity, "labelled_sample", lambda d, *a, **b: sample(d.filter("doc_id < 1500"), *a, **b))
    monkeypatch.setattr(toxicity, "SHARD", 500)
    model = toxicity.learn(table, labels)
    bucket = toxicity.hashed("zyx")[0]
    assert np.abs(model.table[bucket]).sum() > 0 and not model.table[0].any() and model.descent is None
    again = toxicity.learn(table.repartition(7), labels)
    assert np.array_equal(model.table, again.table) and model.thresholds == again.thresholds and model.shift == again.shift
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, (_, y, _) in enumerate(rows[:1500])) > 1450
    bins, n, hits = np.array([3, 1, 2]), np.array([4, 5, 2]), np.array([4, 0, 1])
    assert toxicity._cut(bins, n, hits) == 1.5
    step = toxicity._fit([toxicity._encoded(t, {}) for t, _, _ in rows[:40]], np.array([y for _, y, _ in rows[:40]], np.float32), 1)
    assert np.isfinite(step.emb).all() and not step.emb[0].any()
