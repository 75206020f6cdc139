"""Polygons of any shape, kernels, and selection by histograms against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import compare, geometry, logs, polygons, stats
from tallyframe.operators.neighbours import nearest_neighbours


def flat(*points):
    return [float(c) for p in points for c in p]


SQUARE = flat((0, 0), (4, 0), (4, 4), (0, 4))
DART = flat((0, 0), (4, 0), (4, 4), (3, 1))  # drawn in at (3, 1)
STAR = [v for k in range(10) for v in (math.cos(k * math.pi / 5) * (2 if k % 2 else 5), math.sin(k * math.pi / 5) * (2 if k % 2 else 5))]


def raster_iou(a, b, n=1200):
    a, b = np.reshape(a, (-1, 2)), np.reshape(b, (-1, 2))
    lo, hi = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    x, y = (lo[k] + (np.arange(n) + 0.5) * (hi[k] - lo[k]) / n for k in (0, 1))

    def inside(p):
        out = np.zeros((n, n), bool)
        for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, 0), strict=True):
            if y1 != y2:
                out ^= ((y1 > y) != (y2 > y))[:, None] & (x[None] < (x1 + (y - y1) * (x2 - x1) / (y2 - y1))[:, None])
        return out

    p, q = inside(a), inside(b)
    return (p & q).sum() / max(1, (p | q).sum())


def ious(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    return [r["iou"] for r in df.select("i", geometry.polygon_iou("a", "b").alias("iou")).orderBy("i").collect()]


def backwards(p):
    return [v for k in range(len(p) - 2, -1, -2) for v in p[k : k + 2]]


def moved(p, dx, dy, scale=1.0):
    return [v * scale + (dx if k % 2 == 0 else dy) for k, v in enumerate(p)]


def test_polygon_iou_worked_cases(spark):
    cases = [
        (DART, DART, 1.0), (DART, backwards(DART), 1.0),  # concave against itself, and going round the other way
        (SQUARE, moved(SQUARE, 4, 0), 0.0), (SQUARE, moved(SQUARE, 4, 4), 0.0),  # touching along an edge, in a corner
        (SQUARE, moved(SQUARE, 1, 1, 0.5), 0.25), (SQUARE, moved(SQUARE, 9, 9), 0.0),  # nested, apart
        (SQUARE, moved(SQUARE, 2, 0), 1 / 3), (SQUARE, DART, 0.25),
        (flat((0, 0), (4, 4), (4, 0), (0, 4)), SQUARE, 0.5),  # edges that cross: inside by odd counts
        (flat((1, 1), (2, 2)), SQUARE, 0.0), ([], SQUARE, 0.0), ([], [], 0.0), (flat((1, 1)), flat((1, 1)), 0.0),
        (flat((0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4)), SQUARE, 1.0),  # repeated corners
        (None, SQUARE, None), (SQUARE, None, None), (SQUARE, [1.0, 2.0, 3.0], None), ([0.0, float("nan"), 1.0, 1.0, 2.0, 0.0], SQUARE, None), ([0.0, None, 1.0, 1.0, 2.0, 0.0], SQUARE, None),
    ]
    got = ious(spark, [(a, b) for a, b, _ in cases])
    for g, (_, _, want) in zip(got, cases, strict=True):
        assert (g is None) == (want is None) and (want is None or g == pytest.approx(want, abs=1e-12))


def test_polygon_iou_against_a_raster(spark):
    rng = random.Random(4)
    pairs = [(STAR, moved(STAR, 1, 0.5)), (STAR, SQUARE), (backwards(STAR), moved(DART, -2, -1, 1.5))]
    for _ in range(25):  # star-shaped around a centre: simple, mostly concave
        def star(n):
            angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
            x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
            out = [v for t in angles for r in [rng.uniform(0.5, 3)] for v in (x + r * math.cos(t), y + r * math.sin(t))]
            return out if rng.random() < 0.5 else backwards(out)

        pairs.append((star(rng.randrange(3, 12)), star(rng.randrange(3, 12))))
    got = ious(spark, pairs)
    assert got == pytest.approx([raster_iou(a, b) for a, b in pairs], abs=0.004)
    assert ious(spark, [(b, a) for a, b in pairs]) == pytest.approx(got, abs=1e-12)


def test_polygon_areas_and_slabs_by_parts(spark, monkeypatch):
    p, q = np.reshape(STAR, (1, -1, 2)), np.reshape(moved(STAR, 1, 1), (1, -1, 2))
    whole = polygons.overlap_areas(p, q)
    x, y = p[0].T
    assert whole[0, 0] == pytest.approx(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)
    monkeypatch.setattr(polygons, "CELLS", 50)  # a few slabs at a time
    assert polygons.overlap_areas(p, q) == pytest.approx(whole)


def test_gram_kernels_against_plain_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.random((40, 5))
    x[3] = 0  # chi-squared: 0 + 0 counts nothing
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(99, None)], "id int, vec array<double>").repartition(6)
    a, b = x.T[:, None], x.T[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        chi = np.nansum((a - b) ** 2 / (a + b), 2)
    dot, n = x.T @ x, len(x)
    want = {
        "linear": dot, "polynomial": (10 / n * dot + 1) ** 3, "sigmoid": np.tanh(10 / n * dot + 1), "rbf": np.exp(-10 / n * ((a - b) ** 2).sum(2)),
        "laplacian": np.exp(-10 / n * np.abs(a - b).sum(2)), "chi2": np.exp(-chi), "additive_chi2": -chi, "cosine": dot / np.sqrt(np.outer(np.diag(dot), np.diag(dot))),
    }
    for kernel, w in want.items():
        got = {r["i"]: r["row"] for r in stats.gram_matrix(df, kernel=kernel).collect()}
        assert np.allclose([got[i] for i in range(5)], w, rtol=1e-10, atol=1e-12), kernel
    got = {r["i"]: r["row"] for r in stats.gram_matrix(df, kernel="polynomial", gamma=0.5, degree=2, coef0=0.25).collect()}
    assert np.allclose([got[i] for i in range(5)], (0.5 * dot + 0.25) ** 2)
    assert stats.gram_matrix(df.where("false"), kernel="laplacian").collect() == []
    with pytest.raises(ValueError):
        stats.gram_matrix(df, kernel="none")
    with pytest.raises(Exception, match="0 or more"):
        stats.gram_matrix(df.select(F.transform("vec", lambda v: -v).alias("vec")), kernel="chi2").collect()


def by_window(rows, k):
    """{(id, pos): value} by sorting: largest first, then least id; not-a-number above all, null below."""
    n = max(1, int(k) if k >= 1 else int(len(rows) * k))
    out = {}
    for pos in range(len(rows[0][1])):
        odd = lambda v: 0 if v is not None and math.isnan(v) else 2 if v is None else 1
        rank = lambda r: (odd(r[1][pos]), -r[1][pos] if odd(r[1][pos]) == 1 else 0.0, r[0])  # noqa: E731, B023
        for i, r in enumerate(sorted(rows, key=rank)):
            out[r[0], pos] = r[1][pos] if i < n else 0.0
    return out


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("k", [1, 7, 0.5, 0.93])
def test_selected_rows_are_those_of_the_window(spark, kind, k):
    rng = random.Random(2)
    inf, nan = float("inf"), float("nan")
    value = [lambda: rng.choice([0.0, 0.0, 0.0, 1.0]), lambda: rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300), lambda: 1 + rng.randrange(4) * 2.0**-52, lambda: rng.choice([None, nan, inf, -inf, 2.0, -0.5])]
    ids = rng.sample(range(-(10**15), 10**15), 200)
    rows = [(i if kind == "long" else f"k{i:020d}", [v() for v in value]) for i in ids]
    df = spark.createDataFrame(rows, f"id {kind}, vec array<double>").repartition(5)
    want = by_window(rows, k)
    n = max(1, int(k) if k >= 1 else int(len(rows) * k))
    for made in (logs._selected(df, n, "vec", "id"), logs.topk_per_feature(df, k)):
        got = {(r["id"], r["pos"]): r["value"] for r in made.collect()}
        assert got.keys() == want.keys()
        assert not [(key, got[key], want[key]) for key in want if not same(got[key], want[key])][:3]


def test_selection_of_whole_numbers_and_everything(spark):
    big = 2**62
    df = spark.createDataFrame([(1, v) for v in (-big - 1, -big, 0, big, big + 1, big + 1)] + [(2, 5)], "pos int, x long")
    cut = lambda n: {r["pos"]: (r["cut"], r["need"]) for r in logs.kth_largest(df, "x", n).collect()}
    assert cut(1) == {1: (big + 1, 1), 2: (5, 1)} and cut(2)[1] == (big + 1, 2) and cut(3)[1] == (big, 1) and cut(6) == {1: (-big - 1, 1)}
    all_ = logs.topk_per_feature(spark.createDataFrame([(1, [2.0]), (2, [-3.0])], "id long, vec array<double>"), 5).collect()
    assert sorted((r["id"], r["value"]) for r in all_) == [(1, 2.0), (2, -3.0)]


def test_a_share_of_the_rows_is_not_one_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(logs, "WINDOW_ROWS", 10)
    df = spark.range(2000).select("id", F.array((F.col("id") * 7919 % 2003).cast("double"), F.lit(1.0)).alias("vec"))
    made = logs.topk_per_feature(df, 0.5)
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.groupBy("pos").agg(F.sum((F.col("value") != 0).cast("int")).alias("n")).collect()
    assert {r["pos"]: r["n"] for r in got} == {0: 1000, 1: 1000}


def greedy(rows, overlap):
    """det_ids kept, of (det_id, key, xmin, ymin, xmax, ymax, score)."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        area = lambda q: (q[4] - q[2]) * (q[5] - q[3])
        for q in kept:
            both = max(0, min(r[4], q[4]) - max(r[2], q[2])) * max(0, min(r[5], q[5]) - max(r[3], q[3]))
            if q[1] == r[1] and both and both / (area(r) + area(q) - both) > overlap:
                break
        else:
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("overlap", [0.3, 0.5])
def test_suppression_by_rounds_keeps_what_the_loop_keeps(spark, overlap):
    rng = random.Random(int(overlap * 100))
    rows = []
    for i in range(400):
        x, y, size = rng.uniform(-20, 20), rng.uniform(-20, 20), 2 ** rng.uniform(-3, 4)
        if i % 3 == 0:  # a pile of boxes in one place
            x, y, size = rng.gauss(0, 0.3), rng.gauss(0, 0.3), 4 + rng.random()
        if i % 11 == 0:
            x, y, size = float(round(x)), float(round(y)), 2.0  # on the grid's lines
        rows.append((i, "big" if i % 10 else None, x, y, x + size, y + size * rng.choice([0.5, 1.0, 1.0, 2.0]) * (i % 97 > 0), float(rng.randrange(40))))
    df = spark.createDataFrame(rows, "det_id long, image string, xmin double, ymin double, xmax double, ymax double, score double").repartition(5)
    want = greedy(rows, overlap)
    assert sorted(r["det_id"] for r in geometry.nms(df, ["image"], overlap, large=60).collect()) == want
    assert sorted(r["det_id"] for r in geometry.nms(df, ["image"], overlap).collect()) == want


def test_rounds_keep_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0, 5.0)] * 40 + [(2, "a", 5.0, 5.0, 6.0, 6.0, None)], "det_id long, image string, xmin double, ymin double, xmax double, ymax double, score double")
    assert sorted(r["det_id"] for r in geometry.nms(df, ["image"], large=1).collect()) == [1, 2]


def test_nearest_neighbours_are_exact_and_leave_blocks_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 50
    x = np.concatenate([centres[i % 8] + rng.normal(size=6) for i in range(250)] + [np.ones(6)] * 60 + [centres[0]]).reshape(-1, 6)  # a pile of equal rows
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(999, None)], "id long, vec array<double>").repartition(5)
    made = nearest_neighbours(df, 4, pivots=12, part=20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, k + 1): (j, d[i, j]) for i in range(len(x)) for k, j in enumerate([j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:4])}
    got = {(r["a"], r["k"]): (r["b"], r["d"]) for r in made.rows.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    pairs = {(r["block"], r["other"]): r["queries"] for r in made.visited.collect()}
    assert sum(n for (b, o), n in pairs.items() if b == o) == len(x)
    assert len(pairs) < made.blocks**2 / 2  # block pairs that were looked at
    few = nearest_neighbours(df.where("id < 3"), 5).rows.collect()
    assert len(few) == 6 and nearest_neighbours(df.where("id < 1"), 5).rows.collect() == []


def test_nearest_neighbours_write_no_row_for_each_block_asked(spark, monkeypatch):
    """Vectors without clusters look into nearly all blocks; what is written stays in proportion to the rows.  Keys may be text."""
    from tallyframe.operators import neighbours

    rng, staged, stage = np.random.default_rng(5), [], neighbours.stage

    def counted(df, *a, **options):
        staged.append((made := stage(df, *a, **options)).count())
        return made

    monkeypatch.setattr(neighbours, "stage", counted)
    x = rng.normal(size=(600, 16))
    x[500:520] = x[0]  # equal distances go by key
    names = [f"n{i:03d}" for i in rng.permutation(600)]
    df = spark.createDataFrame([(n, row.tolist()) for n, row in zip(names, x, strict=True)], "id string, vec array<double>").repartition(3)
    made = neighbours.nearest_neighbours(df, 3, pivots=12, part=64)
    got = {(r["a"], r["k"]): (r["b"], r["d"]) for r in made.rows.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order = {i: [j for j in np.lexsort((names, d[i])) if j != i][:3] for i in range(600)}
    assert {k: b for k, (b, _) in got.items()} == {(names[i], k + 1): names[j] for i in order for k, j in enumerate(order[i])}
    assert sum(r["queries"] for r in made.visited.collect()) > 3 * 600
    assert max(staged) <= 3 * 600


def test_distances_of_equal_rows_are_zero(spark):
    df = spark.createDataFrame([(i, [1e3 + i // 2, 0.1]) for i in range(6)], "id long, vec array<double>")
    got = {(r["a"], r["b"]): r["d"] for r in compare.pairwise_distances(df, block=2).collect()}
    assert len(got) == 15 and got[0, 1] == 0 and got[0, 5] == 2
