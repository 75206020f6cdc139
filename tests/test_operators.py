"""Operators that SQL cannot express, against plain recomputation on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import vectors as V
from tallyframe.operators import compare, geometry, joins, logs, losses, metrics, prep, sampling, scoring, stats
from tallyframe.streaming.plateau import Params, State, advance, plateau_monitor


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(10).tolist(), int(rng.integers(0, 10))) for i in range(100)]
    return rows, spark.createDataFrame(rows, "id long, x array<double>, label int")


def test_topk_accuracy_ties(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], 0), ([1.0, 1.0, 0.0], 1)], "x array<double>, label int")
    assert metrics.topk_accuracy(df, 1).first()["accuracy"] == 0.5  # the larger index ranks first


def test_topk_accuracy_nothing_left(spark):
    df = spark.createDataFrame([([1.0, 0.0], 1)], "x array<double>, label int")
    r = metrics.topk_accuracy(df, 1, ignore=1).first()
    assert r["n"] == 0 and r["accuracy"] is None


def test_softmax_sums_to_one(scores):
    sums = scores[1].select(V.vsum(V.softmax("x")).alias("s")).collect()
    assert all(math.isclose(r["s"], 1) for r in sums)


def test_concat_then_slice_is_identity(scores):
    parts = V.slice_vec("x", [3, 7])
    assert all(r["same"] for r in scores[1].select((V.concat_vec(*parts) == F.col("x")).alias("same")).collect())


def test_binary_encode(scores):
    rows, df = scores
    got = {r["id"]: r["b"] for r in df.select("id", V.binary_encode("x", 40).alias("b")).collect()}
    for i, x, _ in rows:
        assert got[i] == np.unpackbits(np.array(x, "<f4").view(np.uint8), bitorder="little")[:40].tolist()


def test_confusion_rows_sum_to_one(scores):
    cells = metrics.confusion_matrix(scores[1].withColumn("pred", V.argmax("x")), normalize=True)
    assert all(math.isclose(r["s"], 1) for r in cells.groupBy("actual").agg(F.sum("share").alias("s")).collect())


def test_entropy_and_divergence_of_a_constant(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "x")], "source string, f string")
    counts = stats.field_counts(df, ["f"])
    assert all(r["entropy"] == 0 for r in stats.entropy(counts).collect())
    assert all(r["kl"] == 0 for r in stats.kl_divergence(counts).collect())


def test_long_mean_vector_is_the_short_one(scores, monkeypatch):
    short = {r["pos"]: r["mean"] for r in stats.mean_vector(scores[1], "x").collect()}
    monkeypatch.setattr(stats, "EXPLODE_DIMS", 4)
    long = {r["pos"]: r["mean"] for r in stats.mean_vector(scores[1], "x").collect()}
    assert short.keys() == long.keys() and all(math.isclose(short[k], long[k]) for k in short)


def test_refit(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "vec array<double>, target double")
    assert np.allclose(stats.refit(df), [1, -2, 0.5, 3])


def test_standardize_guard(spark):
    df = spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 3.0])], "id int, vec array<double>")
    rows = {(r["id"], r["pos"]): r["standard"] for r in stats.standardize(df).collect()}
    assert rows[1, 0] is None and rows[2, 1] == 1


def test_nms_against_loops(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 50, 2)
        rows.append((i, int(i % 4), float(x), float(y), float(x + rng.uniform(5, 20)), float(y + rng.uniform(5, 20)), float(rng.integers(0, 30))))
    df = spark.createDataFrame(rows, "det_id long, image int, xmin double, ymin double, xmax double, ymax double, score double")
    got = {r["det_id"] for r in geometry.nms(df, ["image"]).collect()}

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)

    want = set()
    for image in range(4):
        kept = []
        for r in sorted((r for r in rows if r[1] == image), key=lambda r: (-r[6], r[0])):
            if all(iou(k, r) <= 0.3 for k in kept):
                kept.append(r)
        want |= {r[0] for r in kept}
    assert got == want


def test_pairwise_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((23, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {(r["a"], r["b"]): r["d"] for r in compare.pairwise_distances(df, block=5).collect()}
    assert len(got) == 23 * 22 // 2
    assert all(math.isclose(d, float(np.linalg.norm(x[a] - x[b]))) for (a, b), d in got.items())
    near = compare.pairwise_distances(df, block=5, nearest=2).collect()
    for a in range(23):
        want = sorted((float(np.linalg.norm(x[a] - x[b])), b) for b in range(23) if b != a)[:2]
        got = sorted((r["d"], r["b"]) for r in near if r["a"] == a)
        assert [b for _, b in got] == [b for _, b in want] and [d for d, _ in got] == pytest.approx([d for d, _ in want])


def test_polygon_iou(spark):
    square, half, far = [0, 0, 1, 0, 1, 1, 0, 1], [0.5, 0, 1.5, 0, 1.5, 1, 0.5, 1], [5, 5, 6, 5, 6, 6, 5, 6]
    rows = [(list(map(float, a)), list(map(float, b))) for a, b in ((square, half), (square, square), (square, far), (square, half[6:] + half[4:6] + half[2:4] + half[:2]))]
    got = [r["iou"] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(geometry.polygon_iou("a", "b").alias("iou")).collect()]
    assert got == pytest.approx([1 / 3, 1, 0, 1 / 3])


def test_center_without_mass(spark):
    df = spark.createDataFrame([(1, h, w, 0.0) for h in range(3) for w in range(5)], "item int, h int, w int, v double")
    r = geometry.center_of_mass(df, ["item"]).first()
    assert (r["ch"], r["cw"]) == (1, 2)


def test_drd(spark):
    gt = np.full((8, 8), 255)
    gt[2:5, 2:6] = 0
    same = [int(v) for v in gt.ravel()]
    wrong = gt.copy()
    wrong[6, 6] = 0
    df = spark.createDataFrame([(0, 8, 8, same, same), (1, 8, 8, [int(v) for v in wrong.ravel()], same)], "image long, height int, width int, pred array<int>, gt array<int>")
    got = {r["image"]: r["drd"] for r in metrics.drd(df).collect()}
    assert got[0] == 0 and 0 < got[1] <= 1


def test_substitute_rejects(spark):
    good, bad = prep.substitute(spark.createDataFrame([("None",), ("Most",), ("odd",), (None,)], "v string"), "v", {"None": 0, "Some": 0.5, "Most": 1})
    assert sorted(str(r["v_value"]) for r in good.collect()) == ["0.0", "1.0", "None"]
    assert [r["reason"] for r in bad.collect()] == ["v: odd"]


def test_vocabulary_only_grows(spark):
    first = spark.createDataFrame([(1, "b"), (2, "a")], "i int, v string")
    vocab = prep.vocabulary(first, "v", "i")
    more = prep.vocabulary(spark.createDataFrame([(1, "c"), (2, "a")], "i int, v string"), "v", "i", vocab)
    assert {r["value"]: r["code"] for r in more.collect()} == {"b": 0, "a": 1, "c": 2}


def test_shuffle_is_a_permutation_and_index_is_whole(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    order = [r["k"] for r in sampling.shuffle(df, "k", 3).collect()]
    assert sorted(order) == list(range(500)) and order != list(range(500))
    assert order == [r["k"] for r in sampling.shuffle(df.repartition(7), "k", 3).collect()]
    rows = sampling.with_index(df, ["k"]).collect()
    assert all(r["k"] == r["idx"] for r in rows)


def test_split_share(spark):
    n = sampling.split(spark.range(20_000), "id", 0.25, 1).where("split = 'test'").count()
    assert abs(n - 5000) < 300


def test_augment_and_resize(spark):
    px = list(map(float, range(12)))
    df = spark.createDataFrame([(1, 3, 4, px)], "key long, height int, width int, pixels array<double>")
    got = {r["transform"]: r for r in scoring.augment(df, ["mirror", "crop 2 2 0 1", "shift 1 0", "corner 3 2 2", "resize 3 4"]).collect()}
    assert got["mirror"]["pixels"][:4] == [3, 2, 1, 0]
    assert got["crop 2 2 0 1"]["pixels"] == [1, 2, 5, 6]
    assert got["shift 1 0"]["pixels"][:8] == [0, 1, 2, 3, 0, 1, 2, 3]
    assert got["corner 3 2 2"]["pixels"] == [6, 7, 10, 11]
    assert got["resize 3 4"]["pixels"] == px
    bad = spark.createDataFrame([(1, 3, 4, px), (2, 3, 4, [1.0])], "key long, height int, width int, pixels array<double>")
    assert [r["key"] for r in scoring.resize_center_crop(bad, 2).collect()] == [1]


def test_score_pads_the_last_batch(spark):
    seen = []

    def model(x):
        assert x.shape == (8, 2)
        return x.sum(1, keepdims=True)

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(11)], "id long, vec array<double>")
    got = {r["id"]: r["probs"] for r in scoring.score(df, model, 8).collect()}
    assert got == {i: [i + 1.0] for i in range(11)} and not seen
    with pytest.raises(TypeError):
        scoring.register_op("empty", object)


def test_otsu():
    assert scoring.otsu(np.array([10] * 50 + [200] * 50)) == 10


def test_detect(spark):
    im = spark.createDataFrame([(0, 4, 4, [float(v) for v in range(16)])], "image_index int, height int, width int, pixels array<double>")
    win = spark.createDataFrame([(0, 0, 0, 2, 2), (0, 2, 2, 4, 4)], "image_index int, y1 int, x1 int, y2 int, x2 int")
    got = {r["y1"]: r["probs"] for r in scoring.detect(im, win, lambda x: x.mean(1, keepdims=True), 2).collect()}
    assert got == {0: [2.5], 2: [12.5]}


def _plateau(rows, p):
    s, out = State(), []
    for i, x in rows:
        s = advance(s, i, x, p)
        out.append((i, s.steps, s.periods, s.nonfinite, s.stopped))
    return out


def test_plateau_batch_and_stream(spark, tmp_path):
    p = Params(max_steps=2, max_periods=2)
    data = {1: [5.0, 4.0, 4.0, 4.5, float("nan"), 3.0, 3.0, 3.0], 2: [1.0, 2.0, 2.0, 2.0, 2.0]}
    rows = [(r, i, x) for r, xs in data.items() for i, x in enumerate(xs)]
    want = sorted((r, *t) for r, xs in data.items() for t in _plateau(list(enumerate(xs)), p))
    pick = ["run", "iteration", "steps", "periods", "nonfinite", "stop"]
    df = spark.createDataFrame(rows, "run long, iteration long, loss double")
    got = sorted(tuple(r) for r in plateau_monitor(df, p).select(*pick).collect())
    assert got == want
    from tallyframe.streaming.plateau import plateau_stream

    src = tmp_path / "in"
    for part in (rows[:4] + rows[8:10], rows[4:8] + rows[10:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(src))
        q = plateau_stream(spark.readStream.schema(df.schema).parquet(str(src)), p).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*pick).collect()) == want


def test_stream_logs(spark, tmp_path):
    from tallyframe.streaming.plateau import stream_logs

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "runA.txt").write_text("I0210 13:39:22.381027 25210 solver.cpp:204] Iteration 100, lr = 0.00992565\nI0210 13:39:22.4 1 s] Test net output #0: accuracy = 0.5\n")
    q = stream_logs(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("tail").collect()
    assert {(r["run"], r["iteration"], r["metric"]) for r in rows if r["iteration"] or r["metric"]} == {("runA", 100, None), ("runA", None, 0.5)}


def test_join_mismatch_report(spark):
    a, b = spark.createDataFrame([(1, 0), (2, 0)], "id int, label int"), spark.createDataFrame([(2, 1), (3, 0)], "id int, label int")
    assert {tuple(r) for r in joins.stitch_mismatches([a, b]).collect()} == {(1, 1, 1), (2, 2, 2), (3, 1, 1)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, x array<double>, label int, probs array<double>, transform string")
    assert metrics.topk_accuracy(df).first()["n"] == 0
    assert losses.log_loss(df).first()["loss"] is None
    assert stats.mean_vector(df, "x").count() == 0
    assert logs.best_iteration(spark.createDataFrame([], "run int, iteration int, value double")).count() == 0


def test_draws_reach_every_place_of_large_tables(spark):
    size = 200_000_000
    keys = spark.range(100_000)
    row = keys.select(sampling.draw("id", 9, size).alias("d")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.countDistinct("d").alias("n"), F.sum((F.col("d") >= size // 2).cast("int")).alias("upper")).first()
    assert 0 <= row["lo"] < size // 100 and size - size // 100 < row["hi"] < size
    assert row["n"] > 99_000 and abs(row["upper"] - 50_000) < 2_000
    # keys that are alike in 31 bits do not repeat their draws
    again = keys.where((sampling.draw("id", 9, size) == sampling.draw(F.col("id") + 2**31, 9, size)) | (sampling.draw("id", 9, size) == sampling.draw(F.col("id") + 2**32, 9, size)))
    assert again.count() < 100
    # up to 2^25 places the draws of 31-bit keys are as in the SQL
    c, m = 12345, 2**31
    narrow = lambda k: (((k + 9) % m * 1103515245 + c) % m // 8 * 1103515245 + c) % m // 64
    got = [r["d"] for r in keys.limit(50).select(sampling.draw("id", 9, 1 << 25).alias("d")).collect()]
    assert got == [narrow(k) % (1 << 25) for k in range(50)]


@pytest.mark.parametrize(
    "spec,size,want",
    [
        # worked by hand: whole numbers are cut off, then moved to a multiple of the bin away from N
        ("64l", (100, 75), (64, 64)),  # 48 is 16 below 64, half a bin of 32, so it goes up
        ("64l", (100, 60), (64, 32)),  # 38.4 -> 38 is 6 above 32
        ("64l", (10, 100), (32, 64)),  # 6.4, but 32 at least
        ("64l", (50, 50), (64, 64)),
        ("64s", (75, 100), (64, 96)),  # 85.3 -> 85 is 21 above 64, over half a bin
        ("64s", (100, 500), (64, 128)),  # 320, but 128 at most
        ("64s", (79, 64), (64, 64)),  # 79 is 15 above 64, under half a bin
        ("10x20", (5, 5), (10, 20)),
        ("33", (5, 9), (33, 33)),
        ("10a", (30, 30), (9, 9)),  # steps from 0.5 by 0.15 give 0.95 and 1.1; 1.1 is 0.1 away, over half a step: 0.95; 0.95 * 11 -> 10 * 11 >= 100, so 10 wide
        ("10a", (10, 100), (6, 13)),  # held at 0.5: 0.5 * 14 = 7, 98; 15 wide is 7 * 15 = 105
    ],
)
def test_target_size_by_hand(spark, spec, size, want):
    df = spark.createDataFrame([size], "height int, width int")
    r = prep.target_size(df, spec).first()
    if spec == "10a":  # the rule itself, step by step
        ratio, g = min(max(size[0] / size[1], 0.5), 2.0), 0.5
        while g < ratio:
            g += 0.15
        g = g - 0.15 if g - ratio > 0.075 else g
        w = 1
        while int(g * w) * w < 100:
            w += 1
        want = (int(g * (w - 1)), w - 1)
    assert (r["new_h"], r["new_w"]) == want


def test_batches_over_epochs(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "source string, k int")
    pick = lambda rows: sorted((r["source"], r["epoch"], r["k"], r["batch"], r["slot"]) for r in rows.collect())
    wrap = [r for r in pick(sampling.assign_batches(df, 2, "k", "source", epochs=2)) if r[0] == "a"]
    assert [r[3:] for r in wrap] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]
    cut = [r for r in pick(sampling.assign_batches(df, 2, "k", "source", epochs=2, no_wrap=True)) if r[0] == "a"]
    assert [r[3:] for r in cut] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (4, 0), (4, 1), (5, 0)]


def test_thin_walks_by_its_gaps(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    gaps = [r["g"] + 1 for r in df.select("k", sampling.draw("k", 3, 7).alias("g")).orderBy("k").collect()]
    want, at = [], 0
    for g in gaps:
        want.append(at)
        at += g
    assert sorted(r["k"] for r in sampling.thin(df, "k", 7, 3).collect()) == [x for x in want if x < 300]


def test_mix_of_many_sources(spark):
    df = spark.createDataFrame([(f"s{i:04d}", j) for i in range(300) for j in range(1 + i % 3)], "source string, k int")
    made = sampling.mix_sources(df, None, 400, 2, "k", seed=5).collect()
    assert len(made) == 800 and len({r["source"] for r in made}) > 150
    by = {}
    for r in made:
        by.setdefault(r["mix_batch"], set()).add(r["source"])
    assert len(by) == 400 and all(len(v) == 1 for v in by.values())


def test_nms_carries_a_group_over_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, 7 if i % 3 else None, x, y, x + 9.0, y + 9.0, float(rng.integers(0, 9)), "b") for i, (x, y) in enumerate(rng.uniform(0, 60, (400, 2)).tolist())]
    df = spark.createDataFrame(rows, "det_id long, image int, xmin double, ymin double, xmax double, ymax double, score double, _bucket string")
    whole = {r["det_id"] for r in geometry.nms(df, ["image"]).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        made = geometry.nms(df, ["image"])
        assert made.columns == df.columns and {r["det_id"] for r in made.collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mean_vector_of_ragged_vectors(spark, monkeypatch):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0],), (None,), ([],)], "x array<double>")
    want = {0: 2.0, 1: 2.0, 2: 3.0}
    assert {r["pos"]: r["mean"] for r in stats.mean_vector(df, "x").collect()} == want
    monkeypatch.setattr(stats, "EXPLODE_DIMS", 1)
    assert {r["pos"]: r["mean"] for r in stats.mean_vector(df, "x").collect()} == want


def test_rows_without_values(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, vec array<double>")
    got = {r["id"]: r["probs"] for r in scoring.score(df, lambda x: x * 2, 4).collect()}
    assert got == {1: [2.0, 4.0], 2: None}
    im = spark.createDataFrame([(1, 1, 2, [5.0, 200.0]), (2, 1, 2, None), (3, None, 2, [1.0, 2.0])], "key long, height int, width int, pixels array<double>")
    assert [(r["key"], r["threshold"], r["pixels"]) for r in scoring.binarize_pad(im).collect()] == [(1, 5, [1, 0, 0, 0])]
    assert {r["key"] for r in scoring.augment(im, ["none"]).collect()} == {1}


def test_label_patches_scores_the_first_keys_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(x):
        seen.add(int((x[:, 0] > 0).sum()))
        return np.stack([1 - x[:, 0] / 100, x[:, 0] / 100], 1)

    df = spark.createDataFrame([(i, i % 2, [float(i + 1)]) for i in range(50)], "patch long, label int, values array<double>").repartition(3)
    got = {r["patch"]: (r["label"], r["p"]) for r in scoring.label_patches(df, model, 4).collect()}
    assert got == {i: (i % 2, pytest.approx((i + 1) / 100 if i % 2 else 1 - (i + 1) / 100)) for i in range(4)}
    assert seen.value == 4
