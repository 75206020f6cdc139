"""Batch scoring with any model, feature extraction, tiles and patches, pixel augmentation and resizing.

A model is a function of a 2-d numpy array (records, values) that returns an array with a row a record, or a
dict of such arrays.  It is sent to each task once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import at

Model = Callable[[np.ndarray], np.ndarray | dict[str, np.ndarray]]


def _schema(df: DataFrame, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in extra]])


def _batches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def score(df: DataFrame, model: Model, batch_size: int = 256, vec: str = "vec", out: str = "probs") -> DataFrame:
    """Adds the model's output; the model always sees ``batch_size`` rows, the last batch padded with zeros that are cut off again.
    A row without a vector stays, with a null output."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(parts, batch_size):
            known = part[vec].notna().to_numpy()
            made = np.full(len(part), None, object)
            if known.any():
                x = np.stack(part[vec][known].to_numpy()).astype(float)
                full = np.concatenate([x, np.zeros((batch_size - len(x), x.shape[1]))])
                for i, v in zip(np.flatnonzero(known), np.asarray(model(full), float), strict=False):
                    made[i] = v
            yield part.assign(**{out: made})

    return df.mapInPandas(run, _schema(df, [(out, T.ArrayType(T.DoubleType()))]))


def extract_features(df: DataFrame, model: Model, names: list[str], batch_size: int = 256, vec: str = "vec", key: str = "id", pool: bool = False) -> dict[str, DataFrame]:
    """One table an output name: key (10 digits), vec.  A name that the model does not return raises KeyError.

    An output of more than two axes is flattened, or with ``pool`` gives the largest value of each channel (second axis) over all places.
    """

    def row(made: np.ndarray, n: int) -> list:
        made = np.asarray(made, float)
        return list(made.max(tuple(range(2, made.ndim))) if pool and made.ndim > 2 else made.reshape(n, -1))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(parts, batch_size):
            made = model(np.stack(part[vec].to_numpy()).astype(float))
            yield pd.DataFrame({key: part[key], **{n: row(made[n], len(part)) for n in names}})

    fields = [df.schema[key], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]]
    made = df.select(key, vec).mapInPandas(run, T.StructType(fields))
    return {n: made.select(F.format_string("%010d", F.col(key)).alias("key"), F.col(n).alias("vec")) for n in names}


def context_crop(image: np.ndarray, box: tuple[float, float, float, float], side: int, pad: int, fill: np.ndarray) -> np.ndarray:
    """The window (y1, x1, y2, x2) and its surroundings at side * side, of which ``pad`` pixels a side are context; ``fill`` stands
    where the picture ends.

    The window is widened about its centre by side / (side - 2 pad) and rounded to whole pixels.  What lies in the picture keeps the scale
    of the whole.
    """
    out = np.array(np.broadcast_to(fill, (side, side)), float)
    grow = side / (side - 2 * pad)
    place, source = [], []
    for lo, hi, size in ((box[0], box[2], image.shape[0]), (box[1], box[3], image.shape[1])):
        half = (hi - lo + 1) / 2
        first, last = np.round(lo + half - grow * half), np.round(lo + half + grow * half)
        scale = side / (last - first + 1)
        start = int(np.round(max(0.0, -first) * scale))
        first, last = np.clip([first, last], 0, size)
        place.append((start, min(int(np.round((last - first + 1) * scale)), side - start)))
        source.append((int(first), int(last)))
    (top, h), (left, w) = place
    part = image[slice(*source[0]), slice(*source[1])]
    if part.size and h > 0 and w > 0:
        out[top : top + h, left : left + w] = resize(part, h, w)
    return out


def detect(images: DataFrame, windows: DataFrame, model: Model, side: int, key: str = "image_index", context_pad: int = 0, mean: float | list[float] = 0.0) -> DataFrame:
    """Windows with probs: each window (y1, x1, y2, x2, ends left out) of images (height, width, pixels) resized to side * side and scored.

    With ``context_pad`` a crop has that many pixels of surroundings a side, and ``mean`` (a number, or side * side of them) stands beyond the picture; so it
    does for a window that meets no pixel.  Pictures that do not fit their size have no result.
    """
    if not 0 <= 2 * context_pad < side:
        raise ValueError("the context has to leave room for the window")
    fill = np.asarray(mean, float)
    fill = fill.reshape(side, side) if fill.ndim else fill
    rows = windows.join(images, key)

    def crop(p, h, w, box) -> np.ndarray:
        image = np.asarray(p, float).reshape(int(h), int(w))
        if context_pad:
            return context_crop(image, box, side, context_pad, fill)
        y1, x1, y2, x2 = (int(max(v, 0)) for v in box)
        part = image[y1:y2, x1:x2]
        return resize(part, side, side) if part.size else np.array(np.broadcast_to(fill, (side, side)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(parts, 256):
            part = part[[_fits(h, w, p) for h, w, p in zip(part["height"], part["width"], part["pixels"], strict=True)]]
            if len(part):
                boxes = part[["y1", "x1", "y2", "x2"]].itertuples(index=False, name=None)
                crops = [crop(p, h, w, b).ravel() for p, h, w, b in zip(part["pixels"], part["height"], part["width"], boxes, strict=True)]
                yield part.drop(columns=["pixels"]).assign(probs=list(np.asarray(model(np.stack(crops)), float)))

    kept = rows.drop("pixels")
    return rows.select(*kept.columns, "pixels").mapInPandas(run, _schema(kept, [("probs", T.ArrayType(T.DoubleType()))]))


def predict_tiled(tiles: DataFrame, model: Model, key: str = "id", **options) -> DataFrame:
    """key, cls, p: tiles scored, then averaged over each item."""
    from .metrics import average_crops

    return average_crops(score(tiles, model, vec="values", **options).select(key, "probs"), key)


def cut_tiles(images: DataFrame, tile: int, stride: int, pad: int = 0) -> DataFrame:
    """``geometry.tile_boxes`` with values: the tile's pixels in row order, 0 where it reaches beyond the picture."""
    from .geometry import tile_boxes

    boxes = tile_boxes(images, tile, stride, pad=pad)
    here = F.least(F.lit(tile), F.col("width") - F.col("x"))
    line = lambda r: F.concat(F.slice("pixels", ((F.col("y") + r) * F.col("width") + F.col("x") + 1).cast("int"), here.cast("int")), F.array_repeat(F.lit(0.0), (F.lit(tile) - here).cast("int")))
    lines = F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda r: F.when(F.col("y") + r < F.col("height"), line(r)).otherwise(F.array_repeat(F.lit(0.0), tile)))
    return boxes.withColumn("values", F.flatten(lines)).drop("pixels")


def predict_stitched(images: DataFrame, model: Model, tile: int, stride: int | None = None, pad: int = 0, key: str = "key", **options) -> DataFrame:
    """key, height, width, pixels: every tile of a picture scored by a model that answers with a tile, put together again.

    Tiles start every ``stride`` pixels and at the far edges.  Each gives the pixels that are ``pad`` or more from its borders (up to the picture's own edge);
    where tiles still overlap, the one that starts last does.  Tiles are rows of arrays: they are cut and scored
    where the picture is read, and meet again in one exchange by picture.  Pictures that do not fit their size have no result.
    """
    if 2 * pad >= tile or (stride or tile) > tile - 2 * pad:
        raise ValueError("tiles of this stride leave pixels out")
    good = (F.col("height") >= 1) & (F.col("width") >= 1) & (F.size("pixels") == F.col("height") * F.col("width"))
    rows = images.where(good).select(key, F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("pixels").cast("array<double>").alias("pixels"))
    scored = score(cut_tiles(rows, tile, stride or tile, pad), model, vec="values", out="made", **options).drop("values")

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        out = np.zeros((h, w))
        for r in pdf.sort_values(["y", "x"]).itertuples(index=False):
            made = np.asarray(r.made, float).reshape(tile, tile)
            y1, x1 = min(r.y1, h), min(r.x1, w)
            out[r.y0 : y1, r.x0 : x1] = made[r.y0 - r.y : y1 - r.y, r.x0 - r.x : x1 - r.x]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "height": h, "width": w, "pixels": [out.ravel()]})

    schema = T.StructType([rows.schema[key], rows.schema["height"], rows.schema["width"], rows.schema["pixels"]])
    return scored.groupBy(key).applyInPandas(assemble, schema)


def label_patches(patches: DataFrame, model: Model, n: int, key: str = "patch", label: str = "label", **options) -> DataFrame:
    """key, label, p (of the true label) of at most n patches, least keys first; only those are scored."""
    made = score(patches.orderBy(key).limit(n), model, vec="values", **options)
    return made.select(key, label, at("probs", label).alias("p"))


class RowOp(Protocol):
    """A user's operator: ``setup`` once a task, ``shape`` names and types its outputs, ``forward`` maps a batch."""

    def setup(self) -> None: ...

    def shape(self) -> str: ...

    def forward(self, batch: pd.DataFrame) -> pd.DataFrame: ...


_OPS: dict[str, type] = {}


def register_op(name: str, op: type) -> None:
    for method in ("setup", "shape", "forward"):
        if not callable(getattr(op, method, None)):
            raise TypeError(f"{name} lacks {method}()")
    _OPS[name] = op


def apply_op(df: DataFrame, name: str, *args) -> DataFrame:
    kind = _OPS[name]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        op = kind(*args)
        op.setup()
        for part in parts:
            yield op.forward(part)

    return df.mapInPandas(run, kind(*args).shape())


class Aggregate(Protocol):
    """A user's aggregate: ``state`` and ``shape`` name and type the fields of a state and of a result, which travel as tuples.

    ``init`` gives an empty state, ``update`` takes a batch of one group's rows into a state, ``merge`` joins two states, ``finish`` makes the result.
    """

    def state(self) -> str: ...

    def shape(self) -> str: ...

    def init(self) -> tuple: ...

    def update(self, state: tuple, batch: pd.DataFrame) -> tuple: ...

    def merge(self, a: tuple, b: tuple) -> tuple: ...

    def finish(self, state: tuple) -> tuple: ...


_AGGREGATES: dict[str, type] = {}
#: Groups whose states a task holds; with more, it sends what it has and starts again.
STATES = 50_000


def register_aggregate(name: str, kind: type) -> None:
    for method in ("state", "shape", "init", "update", "merge", "finish"):
        if not callable(getattr(kind, method, None)):
            raise TypeError(f"{name} lacks {method}()")
    _AGGREGATES[name] = kind


def apply_aggregate(df: DataFrame, keys: list[str], name: str, *args) -> DataFrame:
    """The keys and the aggregate's result of each group.

    Rows are taken into states before the exchange, so that a group sends one state a task, however many rows it has.  Null keys are groups; without ``keys``
    all rows are one.  The states of one group are merged in the order of the tasks that made them.
    """
    kind = _AGGREGATES[name]
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select("*", *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    key_schema = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys, strict=True)])
    state = T.StructType([T.StructField(f"s_{f.name}", f.dataType) for f in T.StructType.fromDDL(kind(*args).state()).fields])
    shape = T.StructType.fromDDL(kind(*args).shape())
    partial = T.StructType([*key_schema.fields, T.StructField("part", T.LongType()), *state.fields])

    def frame(held: dict, part: int) -> pd.DataFrame:
        return pd.DataFrame([(*k, part, *s) for k, (_, s) in held.items()], columns=partial.names).astype({"part": "int64"})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        op, held, sent = kind(*args), {}, 0
        part = lambda: (TaskContext.get().partitionId() << 33) + sent
        for pdf in batches:
            groups = pdf.groupby(names, sort=False, dropna=False) if names else [((), pdf)]
            for k, group in groups:
                k = tuple(None if pd.api.types.is_scalar(x) and pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))
                before = held[k][1] if k in held else op.init()
                held[k] = (None, op.update(before, group.drop(columns=names)))
            if len(held) > STATES:
                yield frame(held, part())
                held, sent = {}, sent + 1
        if held:
            yield frame(held, part())

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        op = kind(*args)
        total = op.init()
        pdf = pdf.sort_values("part")
        for s in pdf[state.names].itertuples(index=False, name=None):
            total = op.merge(total, s)
        return pd.DataFrame([(*pdf[names].iloc[0], *op.finish(total))], columns=[*names, *shape.names])

    made = rows.mapInPandas(gather, partial).groupBy(*names).applyInPandas(settle, T.StructType([*key_schema.fields, *shape.fields]))
    return made.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *shape.names)


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = axis(image.shape[0], h)
    x0, x1, fx = axis(image.shape[1], w)
    rows = image[y0] * (1 - fy)[:, None] + image[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def _fits(h, w, pixels) -> bool:
    """Whether a picture has a size and as many pixels; what does not fit is left out of all results."""
    return pixels is not None and h is not None and w is not None and h >= 1 and w >= 1 and len(pixels) == h * w


def resize_center_crop(df: DataFrame, side: int) -> DataFrame:
    """key, pixels: the short side resized to ``side``, the centre cut out; rows whose pixels do not fit their size are dropped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys, out = [], []
            for k, h, w, p in zip(part["key"], part["height"], part["width"], part["pixels"], strict=True):
                if not _fits(h, w, p):
                    continue
                s = side / min(h, w)
                nh, nw = max(side, round(h * s)), max(side, round(w * s))
                big = resize(np.asarray(p, float).reshape(h, w), nh, nw)
                y, x = (nh - side) // 2, (nw - side) // 2
                keys.append(k)
                out.append(big[y : y + side, x : x + side].ravel().tolist())
            if keys:
                yield pd.DataFrame({"key": keys, "pixels": out})

    schema = T.StructType([df.schema["key"], T.StructField("pixels", T.ArrayType(T.DoubleType()))])
    return df.select("key", "height", "width", "pixels").mapInPandas(run, schema)


def otsu(values: np.ndarray) -> int:
    """Threshold of 8-bit values that parts them with the largest variance between; the first of equals."""
    n = np.bincount(values.astype(int).clip(0, 255), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass * below[-1]) ** 2 / (below * (below[-1] - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarize_pad(df: DataFrame) -> DataFrame:
    """key, threshold, side, pixels: inverted Otsu binarisation (dark is 1), padded at the end with 0 to a square; rows whose
    pixels do not fit their size are dropped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, h, w, p in zip(part["key"], part["height"], part["width"], part["pixels"], strict=True):
                if not _fits(h, w, p):
                    continue
                h, w = int(h), int(w)
                a = np.asarray(p, float).reshape(h, w)
                t, side = otsu(a.ravel()), max(h, w)
                square = np.zeros((side, side), int)
                square[:h, :w] = a <= t
                out.append((k, t, side, square.ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "threshold", "side", "pixels"])

    schema = T.StructType([df.schema["key"], T.StructField("threshold", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.IntegerType()))])
    return df.select("key", "height", "width", "pixels").mapInPandas(run, schema)


def parse_transforms(lines: DataFrame, value: str = "value") -> DataFrame:
    """spec_no, spec, step, op, args, fixed: ``;`` chains of operations, lower-cased; # starts a comment; a chain is fixed
    if none of its steps is a dense crop."""
    clean = F.trim(F.lower(F.regexp_replace(value, "#.*$", "")))
    rows = lines.select("line_no", clean.alias("spec")).where("spec <> ''")
    rows = rows.withColumn("fixed", ~F.col("spec").contains("dense")).select("line_no", "spec", "fixed", F.posexplode(F.split("spec", r"\s*;\s*")).alias("step", "text")).where("text <> ''")
    words = F.split(F.trim("text"), r"\s+")
    return rows.select("line_no", "spec", "step", words[0].alias("op"), F.slice(words, F.lit(2), F.size(words)).alias("args"), "fixed")


def _augment(a: np.ndarray, op: str, args: list[str], rng: np.random.Generator) -> np.ndarray:
    n = [float(x) for x in args]
    if op == "none":
        return a
    if op == "mirror":
        return a[:, ::-1]
    if op == "crop":  # height, width, and y and x, else the centre
        h, w = int(n[0]), int(n[1])
        y, x = (int(n[2]), int(n[3])) if len(n) > 3 else ((a.shape[0] - h) // 2, (a.shape[1] - w) // 2)
        return a[y : y + h, x : x + w]
    if op == "corner":  # corner 0 to 3, height, width
        h, w = int(n[1]), int(n[2])
        y, x = (0 if n[0] < 2 else a.shape[0] - h), (0 if n[0] % 2 == 0 else a.shape[1] - w)
        return a[y : y + h, x : x + w]
    if op == "randcrop":
        y, x = (int(rng.integers(0, s - int(m) + 1)) for s, m in zip(a.shape, n, strict=False))
        return a[y : y + int(n[0]), x : x + int(n[1])]
    if op == "shift":  # down, right; edges repeat
        y, x = np.clip(np.arange(a.shape[0]) - int(n[0]), 0, a.shape[0] - 1), np.clip(np.arange(a.shape[1]) - int(n[1]), 0, a.shape[1] - 1)
        return a[y][:, x]
    if op == "salt":
        return np.where(rng.random(a.shape) < n[0], 255.0, a)
    if op == "gauss":
        return a + rng.normal(0, n[0], a.shape)
    if op == "resize":
        return resize(a, int(n[0]), int(n[1]))
    raise ValueError(f"no transform named {op}")


def augment(df: DataFrame, specs: list[str], seed: int = 0) -> DataFrame:
    """key, transform, height, width, pixels: every record whose pixels fit its size, under every spec; draws depend on the
    seed, key and spec only.

    The specs are a parameter of fixed size; records are expanded inside the task that reads them.
    """
    each = df.select("key", "height", "width", "pixels", F.lit(None).cast("string").alias("transform"))
    return _augmented(each, specs, seed)


def _augmented(df: DataFrame, specs: list[str], seed: int) -> DataFrame:
    """Records (key, height, width, pixels) under their spec ``transform``, or under all of them where that is null."""
    import zlib

    chains = {spec: [(s.split()[0], s.split()[1:]) for s in spec.lower().split(";") if s.strip()] for spec in specs}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(parts, 64):
            out = []
            for k, h, w, p, only in zip(part["key"], part["height"], part["width"], part["pixels"], part["transform"], strict=True):
                if not _fits(h, w, p):
                    continue
                h, w = int(h), int(w)
                base = np.asarray(p, float).reshape(h, w)
                for spec, chain in chains.items() if only is None else [(only, chains[only])]:
                    rng, a = np.random.default_rng(zlib.crc32(f"{seed}:{k}:{spec}".encode())), base
                    for op, args in chain:
                        a = _augment(a, op, args, rng)
                    out.append((k, spec, a.shape[0], a.shape[1], a.ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "transform", "height", "width", "pixels"])

    schema = T.StructType([df.schema["key"], T.StructField("transform", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def choose_transform(df: DataFrame, specs: list[str], weights: list[float] | None = None, key: str = "key", seed: int = 0, name: str = "transform") -> DataFrame:
    """Adds ``name``: one of the specs for each row, drawn by weight (alike without weights) from the key and the seed."""
    from .sampling import LCG_M, draw

    weights = [1.0] * len(specs) if weights is None else [float(w) for w in weights]
    if len(weights) != len(specs) or min(weights, default=-1) < 0 or sum(weights) <= 0:
        raise ValueError("a weight of 0 or more for each spec, and not all of them 0")
    place, upto = draw(key, seed) / F.lit(float(LCG_M)) * F.lit(float(sum(weights))), 0.0
    chosen, held = F.lit(None).cast("string"), [(s, w) for s, w in zip(specs, weights, strict=True) if w > 0]
    for i, (spec, w) in enumerate(held):
        upto += w
        chosen = F.coalesce(chosen, F.when(place < F.lit(upto) if i + 1 < len(held) else F.lit(True), F.lit(spec)))
    return df.withColumn(name, chosen)


def augment_choice(df: DataFrame, specs: list[str], weights: list[float] | None = None, seed: int = 0) -> DataFrame:
    """key, transform, height, width, pixels: every record under the one spec that ``choose_transform`` draws for it."""
    return _augmented(choose_transform(df.select("key", "height", "width", "pixels"), specs, weights, "key", seed), specs, seed)


def phase_crop(df: DataFrame, crop: int, phase: str, mirror: bool = False, seed: int = 0) -> DataFrame:
    """key, top, left, mirrored, pixels: a crop * crop cut at a drawn place in phase ``train``, from the centre in ``test``.

    With ``mirror`` half of the records are turned left to right, in either phase.  Draws depend on the key and the seed only.  All of it is
    column expressions.  Records whose pixels do not fit their size, or that are smaller than the cut, are dropped.
    """
    from .sampling import draw

    if phase not in ("train", "test"):
        raise ValueError(f"no phase named {phase}")
    good = (F.size("pixels") == F.col("height") * F.col("width")) & (F.col("height") >= crop) & (F.col("width") >= crop)
    place = lambda size, no: draw(F.col("key") * 3 + no, seed, F.col(size) - crop + 1) if phase == "train" else F.floor((F.col(size) - crop) / 2)
    flip = draw(F.col("key") * 3 + 2, seed, 2) == 1 if mirror else F.lit(False)
    rows = df.where(good).select("key", "width", "pixels", place("height", 0).cast("int").alias("top"), place("width", 1).cast("int").alias("left"), flip.alias("mirrored"))
    line = lambda r: F.slice("pixels", ((F.col("top") + r) * F.col("width") + F.col("left") + 1).cast("int"), crop)
    lines = F.transform(F.sequence(F.lit(0), F.lit(crop - 1)), lambda r: F.when(F.col("mirrored"), F.reverse(line(r))).otherwise(line(r)))
    return rows.select("key", "top", "left", "mirrored", F.flatten(lines).alias("pixels"))
