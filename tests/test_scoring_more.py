"""Context crops, stitched tiles, user aggregates, random choice and phases against worked cases and plain versions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import geometry, scoring

IMAGE = np.arange(80, dtype=float).reshape(8, 10)
PICTURES = "key long, height int, width int, pixels array<double>"


def picture(spark, *more):
    return spark.createDataFrame([(1, 8, 10, IMAGE.ravel().tolist()), *more], PICTURES)


# side 8, 2 pixels of context: windows of 4 by 4 become 9 by 9 about their centre, at 8/9 of their size
@pytest.mark.parametrize(
    ("box", "place", "source"),
    [
        ((2, 3, 5, 6), (slice(0, 8), slice(0, 8)), (slice(0, 8), slice(1, 9))),  # 0 to 8 down ends with the picture, 1 to 9 across
        ((0, 3, 3, 6), (slice(2, 8), slice(0, 8)), (slice(0, 6), slice(1, 9))),  # over the upper edge: -2 to 6
        ((2, 0, 5, 3), (slice(0, 8), slice(2, 8)), (slice(0, 8), slice(0, 6))),  # over the left one
        ((5, 3, 8, 6), (slice(0, 5), slice(0, 8)), (slice(3, 8), slice(1, 9))),  # over the lower one: 3 to 11, and 8 - 3 + 1 lines at 8/9
        ((2, 7, 5, 10), (slice(0, 8), slice(0, 5)), (slice(0, 8), slice(5, 10))),  # over the right one
    ],
)
def test_context_crop_over_each_edge(box, place, source):
    got = scoring.context_crop(IMAGE, box, 8, 2, np.asarray(-1.0))
    part = IMAGE[source]
    h, w = (s.stop - s.start for s in place)
    want = np.full((8, 8), -1.0)
    want[place] = scoring.resize(part, h, w)
    assert np.allclose(got, want)


def test_detect_with_context_and_without(spark):
    win = spark.createDataFrame([(1, 0, 3, 3, 6), (1, 2, 3, 5, 6), (1, 40, 40, 44, 44), (2, 0, 0, 1, 1), (3, 0, 0, 1, 1)], "image_index long, y1 int, x1 int, y2 int, x2 int")
    images = picture(spark, (2, 2, 2, [1.0, 2.0]), (3, 1, 1, None)).withColumnRenamed("key", "image_index")  # the last two do not fit their size
    own, fill = lambda x: x, [float(i) for i in range(64)]
    got = {(r["y1"], r["x1"]): np.reshape(r["probs"], (8, 8)) for r in scoring.detect(images, win, own, 8, context_pad=2, mean=fill).collect()}
    assert set(got) == {(0, 3), (2, 3), (40, 40)} and np.allclose(got[40, 40], np.reshape(fill, (8, 8)))
    assert np.allclose(got[0, 3][:2], np.reshape(fill, (8, 8))[:2]) and np.allclose(got[0, 3], scoring.context_crop(IMAGE, (0, 3, 3, 6), 8, 2, np.reshape(fill, (8, 8))))
    plain = {(r["y1"], r["x1"]): np.reshape(r["probs"], (4, 4)) for r in scoring.detect(images, win, own, 4).collect()}
    assert np.allclose(plain[0, 3], scoring.resize(IMAGE[0:3, 3:6], 4, 4)) and (plain[40, 40] == 0).all()
    with pytest.raises(ValueError):
        scoring.detect(images, win, own, 4, context_pad=2)


@pytest.mark.parametrize(("tile", "stride", "pad"), [(4, 4, 0), (5, 3, 1), (3, 1, 0), (16, 16, 0), (8, 2, 3)])
def test_stitched_pictures_are_those_of_a_pointwise_model(spark, tile, stride, pad):
    rng = np.random.default_rng(tile)
    sizes = [(8, 10), (1, 1), (5, 17), (3, 4)]
    rows = [(i, h, w, rng.random(h * w).tolist()) for i, (h, w) in enumerate(sizes)]
    df = spark.createDataFrame([*rows, (90, 2, 2, [1.0]), (91, None, 2, [1.0]), (92, 1, 1, None)], PICTURES)
    got = {r["key"]: (r["height"], r["width"], r["pixels"]) for r in scoring.predict_stitched(df, lambda x: x * 3 + 1, tile, stride, pad).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert all(got[i][:2] == (h, w) and np.allclose(got[i][2], np.array(p) * 3 + 1) for i, h, w, p in rows)


def test_stitching_takes_the_pixels_that_stitch_tiles_takes(spark):
    seen = lambda x: np.broadcast_to(x[:, :1] * 100, x.shape) + x  # noqa: E731  a tile's answer shows which tile it was
    df = picture(spark)
    (got,) = scoring.predict_stitched(df, seen, 4, 2, 1).collect()
    tiles = scoring.score(scoring.cut_tiles(df, 4, 2, 1), seen, vec="values", out="made").drop("values").withColumnRenamed("made", "values")
    cells = {(r["h"], r["w"]): r["v"] for r in geometry.stitch_tiles(tiles, "key", 4).collect()}
    assert np.allclose(np.reshape(got["pixels"], (8, 10)), [[cells[y, x] for x in range(10)] for y in range(8)])
    with pytest.raises(ValueError):
        scoring.predict_stitched(df, seen, 4, 4, 1)


def longest():
    """A class of a function, so that it travels to the tasks by value."""

    class Longest:
        """Longest text, how many states were merged, and a list of all lengths."""

        def state(self):
            return "longest string, merged long, sizes array<long>"

        def shape(self):
            return "longest string, merged long, sizes array<long>"

        def init(self):
            return None, 0, []

        def update(self, state, batch):
            texts = [t for t in batch["text"] if t is not None]
            best = max([*texts, *([state[0]] if state[0] is not None else [])], key=len, default=None)
            return best, 1, [*state[2], *map(len, texts)]

        def merge(self, a, b):
            best = max((x for x in (a[0], b[0]) if x is not None), key=len, default=None)
            return best, a[1] + b[1], [*a[2], *b[2]]

        def finish(self, state):
            return state[0], state[1], sorted(state[2])

    return Longest


def test_user_aggregates(spark, monkeypatch):
    scoring.register_aggregate("longest", longest())
    rows = [(k, n, "x" * (i % 7)) for i in range(40) for k, n in (("a", 1), ("a", None), (None, 2))] + [("b", 3, None)]
    df = spark.createDataFrame(rows, "k string, n long, text string").repartition(4)
    want = collections.defaultdict(list)
    for k, n, t in rows:
        want[k, n] += [] if t is None else [len(t)]
    for most in (scoring.STATES, 1):  # a task may send its states more than once
        monkeypatch.setattr(scoring, "STATES", most)
        got = {(r["k"], r["n"]): r for r in scoring.apply_aggregate(df, ["k", "n"], "longest").collect()}
        assert set(got) == set(want) and all(list(got[g]["sizes"]) == sorted(want[g]) for g in want)
        assert got["b", 3]["longest"] is None and len(got["a", 1]["longest"]) == 6
        assert all(r["merged"] <= 4 for r in got.values())  # a state a group and partition (batches are whole partitions here)
    (whole,) = scoring.apply_aggregate(df, [], "longest").collect()
    assert len(whole["sizes"]) == 120 and scoring.apply_aggregate(df.where("false"), ["k"], "longest").collect() == []
    with pytest.raises(TypeError):
        scoring.register_aggregate("none", scoring.RowOp)


def test_random_choice_by_weight(spark):
    df = spark.range(8000).select(F.col("id").alias("key"))
    specs, weights = ["a", "b", "c", "d"], [5, 0, 2, 1]
    one = [tuple(r) for r in scoring.choose_transform(df, specs, weights, seed=3).collect()]
    assert one == [tuple(r) for r in scoring.choose_transform(df.repartition(7), specs, weights, seed=3).orderBy("key").collect()]
    n = collections.Counter(t for _, t in one)
    assert n["b"] == 0 and all(abs(n[s] / 8000 - w / 8) < 0.02 for s, w in zip(specs, weights, strict=True))
    assert collections.Counter(r["transform"] for r in scoring.choose_transform(df, ["a", "b"]).collect())["a"] == pytest.approx(4000, abs=200)
    for bad in ([1], [0, 0], [-1, 2]):
        with pytest.raises(ValueError):
            scoring.choose_transform(df, ["a", "b"], bad)
    made = {r["key"]: r for r in scoring.augment_choice(picture(spark, (2, 8, 10, IMAGE.ravel().tolist()), (3, 2, 2, [0.0])), ["crop 2 2 0 0", "mirror"], [0, 1]).collect()}
    assert set(made) == {1, 2} and all(r["transform"] == "mirror" and np.allclose(np.reshape(r["pixels"], (8, 10)), IMAGE[:, ::-1]) for r in made.values())


def test_phases_of_crops(spark):
    df = spark.createDataFrame([(i, 8, 10, IMAGE.ravel().tolist()) for i in range(300)] + [(900, 3, 90, [0.0] * 270), (901, 8, 10, [0.0]), (902, None, 10, None)], PICTURES)
    for phase in ("train", "test"):
        rows = scoring.phase_crop(df, 4, phase, True, 5).collect()
        assert len(rows) == 300
        for r in rows:
            cut = IMAGE[r["top"] : r["top"] + 4, r["left"] : r["left"] + 4]
            assert r["pixels"] == (cut[:, ::-1] if r["mirrored"] else cut).ravel().tolist()
        places = {(r["top"], r["left"]) for r in rows}
        assert places == {(2, 3)} if phase == "test" else places == {(y, x) for y in range(5) for x in range(7)}
        assert 100 < sum(r["mirrored"] for r in rows) < 200
        assert not any(r["mirrored"] for r in scoring.phase_crop(df, 4, phase).collect())
    with pytest.raises(ValueError):
        scoring.phase_crop(df, 4, "other")
