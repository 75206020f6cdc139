"""Boxes, windows, tiles, polygons and grid centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .polygons import polygon_iou, polygon_overlap
from .suppression import LEAST_OVERLAP, open_after_rounds

__all__ = ["best_windows", "center_of_mass", "context_box", "iou", "median_center", "nms", "polygon_area", "polygon_iou", "polygon_overlap", "stitch_tiles", "ten_crops", "tile_boxes", "tile_starts", "window_classes"]


def iou(a: str, b: str) -> Column:
    """Intersection over union of two structs (xmin, ymin, xmax, ymax); areas without the extra pixel."""
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")), F.lit(0))
    inter = side("xmin", "xmax") * side("ymin", "ymax")
    area = lambda s: (F.col(f"{s}.xmax") - F.col(f"{s}.xmin")) * (F.col(f"{s}.ymax") - F.col(f"{s}.ymin"))
    return inter / (area(a) + area(b) - inter)


#: Boxes that ``nms`` compares with the kept ones at once, and rows from which a key is more than one task's work.
NMS_ROWS, LARGE_KEY = 2048, 200_000


def _overlaps(a: np.ndarray, b: np.ndarray, overlap: float) -> np.ndarray:
    """Whether each box of a has an overlap above ``overlap`` with each of b."""
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    wide = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    high = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.maximum(wide, 0) * np.maximum(high, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return inter / (area(a)[:, None] + area(b)[None, :] - inter) > overlap


def nms(dets: DataFrame, keys: list[str], overlap: float = 0.3, id_col: str = "det_id", large: int = LARGE_KEY) -> DataFrame:
    """Rows kept by greedy suppression within each key: best score first (ties: smaller id), a box goes if its overlap with a
    kept one is above ``overlap``.

    A task reads its rows in order of key and score, a batch at a time, and holds only the boxes kept of the present key.
    Keys of more than ``large`` rows first go through rounds over a grid (``suppression``), which all tasks share, until
    fewer are open; that takes whole-number ids and an ``overlap`` of 0.1 or more.
    """
    if overlap < LEAST_OVERLAP or not isinstance(dets.schema[id_col].dataType, (T.LongType, T.IntegerType)):
        return _in_order(dets, keys, overlap, id_col)
    sizes = dets.groupBy(F.struct(*keys).alias("_k")).count()
    big = sizes.where(F.col("count") > large).select("_k")
    if big.isEmpty():
        return _in_order(dets, keys, overlap, id_col)
    own = dets.withColumn("_k", F.struct(*keys))
    kept, rest = open_after_rounds(own.join(big, "_k", "left_semi").select(*dets.columns), keys, overlap, id_col, large)
    small = own.join(big, "_k", "left_anti").select(*dets.columns)
    return kept.select(*dets.columns).unionByName(_in_order(rest.select(*dets.columns).unionByName(small), keys, overlap, id_col))


def _in_order(dets: DataFrame, keys: list[str], overlap: float, id_col: str) -> DataFrame:
    """``nms`` with a task a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, kept = None, np.empty((0, 4))
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            names = [tuple(None if pd.isna(x) else x for x in row) for row in pdf[keys].itertuples(index=False)]
            boxes = pdf[["xmin", "ymin", "xmax", "ymax"]].to_numpy(float)
            out, start = [], 0
            while start < len(pdf):
                if names[start] != here:
                    here, kept = names[start], np.empty((0, 4))
                stop = start + 1
                while stop < len(pdf) and stop - start < NMS_ROWS and names[stop] == here:
                    stop += 1
                part = boxes[start:stop]
                alive = np.ones(len(part), bool)
                for at in range(0, len(kept), NMS_ROWS):
                    alive &= ~_overlaps(part, kept[at : at + NMS_ROWS], overlap).any(1)
                some = np.flatnonzero(alive)
                clash = _overlaps(part[some], part[some], overlap)
                free = np.ones(len(some), bool)
                for i in range(len(some)):
                    if free[i]:
                        free[i + 1 :] &= ~clash[i, i + 1 :]
                out += (start + some[free]).tolist()
                kept = np.concatenate([kept, part[some[free]]])
                start = stop
            yield pdf.iloc[out]

    ordered = dets.repartition(*keys).sortWithinPartitions(*keys, F.col("score").desc(), id_col)
    return ordered.mapInPandas(run, dets.schema)


def best_windows(dets: DataFrame, cls: str = "cls", score: str = "score") -> DataFrame:
    """cls, score, and the box of the best window (ties: the smallest id)."""
    best = F.max_by(F.struct("det_id", "xmin", "ymin", "xmax", "ymax"), F.struct(F.col(score), -F.col("det_id")))
    return dets.groupBy(cls).agg(F.max(score).alias("score"), best.alias("box")).select(cls, "score", "box.*")


def window_classes(df: DataFrame, fg: float = 0.5, bg: float = 0.5, label: str = "label", overlap: str = "overlap") -> DataFrame:
    """kind, label, n: foreground at or above ``fg``, background (label 0) below ``bg``; between them rows are dropped."""
    kind = F.when(F.col(overlap) >= fg, F.lit("foreground")).when(F.col(overlap) < bg, F.lit("background"))
    rows = df.withColumn("kind", kind).where("kind is not null")
    return rows.groupBy("kind", F.when(F.col("kind") == "background", 0).otherwise(F.col(label)).alias("label")).agg(F.count("*").alias("n"))


def center_of_mass(cells: DataFrame, keys: list[str], iters: int = 0, radius: float | None = None, normalize: bool = False) -> DataFrame:
    """keys, ch, cw: mass centre of cells (keys, h, w, v), then ``iters`` passes over the cells within ``radius`` of it.

    A key without mass has the centre of its grid.  A pass is a join on the keys.
    """
    size = cells.groupBy(*keys).agg(F.max("h").alias("mh"), F.max("w").alias("mw"))

    def centre(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("v").alias("m"), F.sum(F.col("h") * F.col("v")).alias("sh"), F.sum(F.col("w") * F.col("v")).alias("sw"))

    def settle(mass: DataFrame) -> DataFrame:
        made = size.join(mass, keys, "left")
        return made.select(*keys, "mh", "mw", F.when(F.col("m") != 0, F.col("sh") / F.col("m")).otherwise(F.col("mh") / 2).alias("ch"), F.when(F.col("m") != 0, F.col("sw") / F.col("m")).otherwise(F.col("mw") / 2).alias("cw"))

    out = settle(centre(cells))
    for _ in range(iters):
        near = cells.join(out, keys).where((F.col("h") - F.col("ch")) * (F.col("h") - F.col("ch")) + (F.col("w") - F.col("cw")) * (F.col("w") - F.col("cw")) <= radius * radius)
        out = settle(centre(near.select(*keys, "h", "w", "v")))
    if normalize:
        return out.select(*keys, (F.col("ch") / F.greatest(F.col("mh"), F.lit(1))).alias("ch"), (F.col("cw") / F.greatest(F.col("mw"), F.lit(1))).alias("cw"))
    return out.select(*keys, "ch", "cw")


def median_center(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mh, mw: where the running row (column) mass passes half of all, interpolated between lines."""

    def axis(a: str, out: str) -> DataFrame:
        lines = cells.groupBy(*keys, a).agg(F.sum("v").alias("m"))
        w = Window.partitionBy(*keys)
        run = lines.withColumn("upto", F.sum("m").over(w.orderBy(a).rowsBetween(Window.unboundedPreceding, 0))).withColumn("half", F.sum("m").over(w) / 2)
        at = run.where((F.col("upto") >= F.col("half")) & (F.col("upto") - F.col("m") < F.col("half")))
        return at.groupBy(*keys).agg(F.min(F.col(a) + (F.col("half") - (F.col("upto") - F.col("m"))) / F.col("m")).alias(out))

    return axis("h", "mh").join(axis("w", "mw"), keys)


def polygon_area(points: Column | str) -> Column:
    """Shoelace area of a flat array x0, y0, x1, y1 ..."""
    p = F.col(points) if isinstance(points, str) else points
    n = (F.size(p) / 2).cast("int")
    x = lambda i: F.element_at(p, (2 * (i % n) + 1).cast("int"))
    y = lambda i: F.element_at(p, (2 * (i % n) + 2).cast("int"))
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: x(i) * y(i + 1) - y(i) * x(i + 1))
    return F.abs(0.5 * F.aggregate(cross, F.lit(0.0), lambda s, v: s + v))


def tile_starts(size: Column, tile: Column, stride: Column) -> Column:
    """Starts of tiles along one side: every ``stride``, and one that ends at the edge if the last does not."""
    last = F.greatest(size - tile, F.lit(0))
    grid = F.sequence(F.lit(0), last.cast("int"), stride.cast("int"))
    return F.array_union(grid, F.array(last.cast("int")))


def tile_boxes(df: DataFrame, tile: int, stride: int, h: str = "height", w: str = "width", pad: int = 0) -> DataFrame:
    """A row for each tile: y, x, edge_y and edge_x (first, last, both or inner), and the inner box that it owns."""
    t, s = F.lit(tile), F.lit(stride)

    def edge(v: Column, size: Column) -> Column:
        first, last = v == 0, v + t >= size
        return F.when(first & last, "both").when(first, "first").when(last, "last").otherwise("inner")

    rows = df.withColumn("y", F.explode(tile_starts(F.col(h), t, s))).withColumn("x", F.explode(tile_starts(F.col(w), t, s)))
    rows = rows.withColumn("edge_y", edge(F.col("y"), F.col(h))).withColumn("edge_x", edge(F.col("x"), F.col(w)))
    low = lambda v, e: F.when(F.col(e).isin("first", "both"), F.col(v)).otherwise(F.col(v) + pad)
    high = lambda v, e, size: F.when(F.col(e).isin("last", "both"), F.col(size)).otherwise(F.col(v) + tile - pad)
    return rows.withColumn("y0", low("y", "edge_y")).withColumn("y1", high("y", "edge_y", h)).withColumn("x0", low("x", "edge_x")).withColumn("x1", high("x", "edge_x", w))


def stitch_tiles(tiles: DataFrame, key: str = "id", tile: int = 0) -> DataFrame:
    """key, h, w, v: cells of tiles (y, x, y0, y1, x0, x1, values in row order) at their places, inside the inner boxes.

    Where inner boxes overlap, the tile that starts last wins."""
    cells = tiles.select(key, "y", "x", "y0", "y1", "x0", "x1", F.posexplode("values").alias("i", "v"))
    cells = cells.withColumn("h", F.col("y") + F.floor(F.col("i") / tile).cast("int")).withColumn("w", F.col("x") + F.col("i") % tile)
    inner = cells.where("h >= y0 and h < y1 and w >= x0 and w < x1")
    return inner.groupBy(key, "h", "w").agg(F.max_by("v", F.struct("y", "x")).alias("v"))


def ten_crops(df: DataFrame, ch: int, cw: int, h: str = "height", w: str = "width") -> DataFrame:
    """Ten rows: crop, top, left, mirrored; four corners and the centre, plain then mirrored."""
    bottom, right = F.col(h) - ch, F.col(w) - cw
    places = [(F.lit(0), F.lit(0)), (F.lit(0), right), (bottom, F.lit(0)), (bottom, right), (F.floor(bottom / 2), F.floor(right / 2))]
    boxes = [F.struct(F.lit(i + 5 * m).alias("crop"), t.cast("int").alias("top"), x.cast("int").alias("left"), F.lit(bool(m)).alias("mirrored")) for m in (0, 1) for i, (t, x) in enumerate(places)]
    return df.select("*", F.inline(F.array(*boxes)))


def context_box(df: DataFrame, crop: int, pad: int, square: bool = False, width: str = "width", height: str = "height") -> DataFrame:
    """Adds bx1, by1, bx2, by2 (the padded box, clipped) and pad_x1, pad_y1, pad_x2, pad_y2 (what was beyond the image)."""
    scale = crop / (crop - 2 * pad)
    hw, hh = (F.col("x2") - F.col("x1") + 1) / 2, (F.col("y2") - F.col("y1") + 1) / 2
    cx, cy = F.col("x1") + hw, F.col("y1") + hh
    if square:
        hw = hh = F.greatest(hw, hh)
    raw = {"bx1": F.round(cx - hw * scale), "by1": F.round(cy - hh * scale), "bx2": F.round(cx + hw * scale), "by2": F.round(cy + hh * scale)}
    out = df.withColumns({k: v.cast("int") for k, v in raw.items()})
    out = out.withColumns({"pad_x1": F.greatest(F.lit(0), -F.col("bx1")), "pad_y1": F.greatest(F.lit(0), -F.col("by1")), "pad_x2": F.greatest(F.lit(0), F.col("bx2") - F.col(width) + 1), "pad_y2": F.greatest(F.lit(0), F.col("by2") - F.col(height) + 1)})
    return out.withColumns({"bx1": F.greatest(F.lit(0), "bx1"), "by1": F.greatest(F.lit(0), "by1"), "bx2": F.col("bx2") - F.col("pad_x2"), "by2": F.col("by2") - F.col("pad_y2")})
