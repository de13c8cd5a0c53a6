"""Result batches, accumulators, progress of a scan, density curves and the null model."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixspark import catalog
from helixspark.operators import series, statistics
from helixspark.plans.progress import Progress
from helixspark.plans.scan import scan
from helixspark.sources.results import ResultStore, append_batches
from helixspark.streaming import stream
from tests.test_library import DIR, planted, sequences

FIELDS = "seq_id string, class string, start_pos long, end_pos long, length long, score double"


def rows_of(rng, n, names=("Z-DNA", "Triplex")):
    return [(f"s{rng.randrange(3)}", rng.choice(names), a := rng.randrange(1, 900), a + (k := rng.randrange(5, 50)) - 1, k, rng.randrange(10, 30) / 10) for _ in range(n)]


def test_batches_are_added_once_and_read_whole(spark, tmp_path):
    rng = random.Random(1)
    store, parts = ResultStore(spark, f"{tmp_path}/store"), {f"b{k}": rows_of(rng, 40 + k) for k in range(3)}
    with pytest.raises(ValueError, match="nothing committed"):
        store.read()
    assert store.batches().count() == 0 and store.clean() == 0
    for name, rows in parts.items():
        assert store.append(spark.createDataFrame(rows, FIELDS), name)
        assert not store.append(spark.createDataFrame(rows, FIELDS), name)
    assert sorted(tuple(r) for r in store.read().collect()) == sorted((*r, name) for name, rows in parts.items() for r in rows)
    assert store.read(["b1"]).count() == 41 and store.first(50).count() == 50 and store.first(1).select("batch").first()[0] == "b0"
    every = [r for rows in parts.values() for r in rows]
    want = {c: (sum(r[1] == c for r in every), sum(r[4] for r in every if r[1] == c), round(sum(r[5] for r in every if r[1] == c) / sum(r[1] == c for r in every), 6)) for c in ("Z-DNA", "Triplex")}
    assert {r["class"]: (r.n, r.bases, pytest.approx(r.mean_score, abs=1e-6)) for r in store.summary().collect()} == want
    # a writer that lost the race: its rows are gone, the other's stay
    store.committed, seen = lambda batch: seen.pop(), [True, False]
    assert not store.append(spark.createDataFrame(parts["b0"], FIELDS), "b2")
    del store.committed
    spark.createDataFrame(parts["b0"], FIELDS).write.parquet(f"{tmp_path}/store/data/b9.{'0' * 32}")  # a crash before the commit
    again = ResultStore(spark, f"{tmp_path}/store")
    assert again.read().count() == 123 and again.clean() == 1 and again.read().count() == 123
    assert again.remove("b0") and not again.remove("b0") and again.read().count() == 83
    assert again.append(spark.createDataFrame([], FIELDS), "empty") and again.read().count() == 83
    with pytest.raises(ValueError, match="name"):
        again.append(spark.createDataFrame([], FIELDS), "../x")


def test_a_stream_adds_each_batch_once(spark, tmp_path):
    rng = random.Random(2)
    store = ResultStore(spark, f"{tmp_path}/store")
    every = []
    for k in range(2):
        rows = rows_of(rng, 30)
        every += rows
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(FIELDS).parquet(f"{tmp_path}/in")
        write = append_batches(store, "m")
        arriving.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        write(spark.createDataFrame(rows, FIELDS), k)  # as if the batch were tried again
    assert sorted(tuple(r)[:6] for r in store.read().collect()) == sorted(every)


def test_partial_counts_add_up(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 200, ("Z-DNA", "Triplex", "R-Loop"))
    parts = [stream.partial_counts(spark.createDataFrame([r for r in rows if r[0] in names], FIELDS), 900, 10).collect() for names in (("s0",), ("s1", "s2"))]
    got = Counter()
    for r in parts[0] + parts[1]:
        got[r.kind, r["class"], r.other, r.what, r.bin] += r.n
    want = Counter()
    for s, c, a, _, k, _ in rows:
        want["bins", c, None, "start", (a - 1) * 10 // 900] += 1
        want["bins", c, None, "length", 0] += 1
        want["sums", c, None, "rows", None] += 1
        want["sums", c, None, "bases", None] += k
    for s in ("s0", "s1", "s2"):
        held = sorted({r[1] for r in rows if r[0] == s})
        want.update(("pairs", a, b, None, None) for i, a in enumerate(held) for b in held[i + 1 :])
    assert got == want


def test_progress_counts_without_a_second_job(spark):
    df = sequences(spark, planted(random.Random(4), 6))
    events = []
    told = Progress(lambda *event: events.append(event))
    found = scan(df, mode="chunked", size=900, progress=told)
    assert told.rows["motifs"] == found.filter("class not in ('Hybrid', 'Non-B_DNA_Clusters')").count()
    assert {"tiles", "hits", "motifs"} <= set(told.seconds) and told.rows["tiles"] >= 6
    whole = Counter(r.subclass for r in found.collect())
    assert told.rows["local_curvature"] >= whole["Local Curvature"] and told.rows["cruciform"] >= whole["Cruciform forming IRs"] > 0
    assert [e[0] for e in events if e[0] in told.seconds] == ["tiles", "hits", "motifs"] and ("sticky", told.seconds["hits"], told.rows["sticky"]) in events


def test_density_curves_equal_the_sum_of_kernels(spark):
    rng = random.Random(5)
    values = {"a": [float(rng.randrange(100)) for _ in range(300)], "b": [1.0, 2.0, 4.0], "one": [3.0, 3.0]}
    df = spark.createDataFrame([(c, x) for c, xs in values.items() for x in xs] + [("b", None)], "class string, score double")
    got = {}
    for r in series.density_curves(df, "score", points=50, bins=2000).collect():
        got.setdefault(r["class"], []).append((r.i, r.x, r.density))
    assert set(got) == {"a", "b"}
    for c, curve in got.items():
        xs, curve = values[c], sorted(curve)
        mean = sum(xs) / len(xs)
        h = math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) * len(xs) ** -0.2
        for _, x, d in curve:
            assert d == pytest.approx(sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in xs) / len(xs) / h / math.sqrt(2 * math.pi), rel=0.02, abs=1e-6)
        step = curve[1][1] - curve[0][1]
        assert sum(d for *_, d in curve) * step == pytest.approx(1, abs=0.02)


def test_letters_are_shuffled_the_same_in_any_tiles(spark):
    rng = random.Random(6)
    seqs = {"a": "".join(rng.choices("ACGTN", k=3000)), "b": "AC", "none": ""}
    df = sequences(spark, list(seqs.items()))
    want = {(i, r): "".join(s[k] for k in sorted(range(len(s)), key=lambda k: hashlib.md5(f"7:{r}:{i}:{k}".encode()).hexdigest())) for i, s in seqs.items() if s for r in range(2)}
    for size in (100, 4096):
        assert {(r.seq_id, r["round"]): r.seq for r in statistics.shuffled_letters(df, 2, 7, size).collect()} == want
    assert want["a", 0] != want["a", 1] and sorted(want["a", 0]) == sorted(seqs["a"])


def test_null_model_columns(spark):
    observed = spark.createDataFrame([("s", "x", 6), ("s", "y", 2), ("s", "z", 0)], "seq_id string, class string, observed long")
    background = spark.createDataFrame([("s", "x", 0, 2), ("s", "x", 1, 6), ("s", "z", 2, 1), ("t", "x", 0, 9)], "seq_id string, class string, round int, n long")
    got = {r["class"]: (r.expected, r.std, r.fold, r.ratio, r.z_score, r.p_value) for r in statistics.with_null_model(observed, background, 4).collect()}
    sd = math.sqrt(40 / 4 - 4)
    assert got == {"x": (2.0, round(sd, 6), 3.0, round(7 / 3, 6), round(4 / sd, 6), 0.4), "y": (0.0, 0.0, None, 3.0, None, 0.2), "z": (0.25, round(math.sqrt(1 / 4 - 1 / 16), 6), 0.0, 0.8, round(-0.25 / math.sqrt(3 / 16), 6), 1.0)}


def test_accumulated_kinds(spark):
    with pytest.raises(ValueError, match="bins, pairs or sums"):
        path = spark.conf.get("spark.checkpoint.dir") + "/kinds"
        ResultStore(spark, path).append(stream.partial_counts(catalog.motifs(spark, DIR), catalog.LENGTH), "a")
        assert stream.accumulated(spark, path, "pairs").filter(F.col("n") > 0).count() > 0
        stream.accumulated(spark, path, "other")
