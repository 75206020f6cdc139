"""Greedy suppression inside keys of any size: rounds over grid cells, each in proportion to the boxes that are still open.

Two boxes with an overlap above t have widths (and heights) within a factor of 1 / t.  So a box is put into the cells that it
touches at its own scale, a power of two, and at the few coarser ones of boxes that it may meet; two boxes meet at the
scale of the larger one, along each axis.  In a round, each cell shows its ``SHOWN`` best open boxes, and those are compared.
A box that is shown in all its cells and that no better one covers has none before it in the greedy order, so it is kept;
what it covers goes.  A cell holds few kept boxes, since they hardly cover each other, so no round makes pairs of all boxes
of a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import drop_stage, stage

#: Overlaps from which the grid is used: below, a box would have to be put into too many scales.
LEAST_OVERLAP = 0.1
#: Boxes of a cell that a round compares.
SHOWN = 16
_CELL = ["_k", "lx", "ly", "cx", "cy"]


def _cells(boxes: DataFrame, scales: int) -> DataFrame:
    """A row for each scale and cell of a box, and how many it has; kind has bit 2 where the scale is the box's own along x, bit 1 along y."""
    own = lambda lo, hi: F.floor(F.log2(F.col(hi) - F.col(lo))).cast("int")
    steps = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + scales))
    place = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level + 1))
    touched = lambda lo, hi, level: F.explode(F.sequence(place(lo, F.col(level)), place(hi, F.col(level))))
    many = lambda lo, hi, o: F.aggregate(F.sequence(F.col(o), F.col(o) + scales), F.lit(0).cast("long"), lambda n, v: n + place(hi, v) - place(lo, v) + 1)
    out = boxes.withColumn("ox", own("xmin", "xmax")).withColumn("oy", own("ymin", "ymax"))
    out = out.withColumn("n_cells", many("xmin", "xmax", "ox") * many("ymin", "ymax", "oy"))
    out = out.withColumn("lx", steps("ox")).withColumn("ly", steps("oy"))
    out = out.withColumn("cx", touched("xmin", "xmax", "lx")).withColumn("cy", touched("ymin", "ymax", "ly"))
    return out.withColumn("kind", (F.col("lx") == F.col("ox")).cast("int") * 2 + (F.col("ly") == F.col("oy")).cast("int")).drop("ox", "oy")


def _covers(a: str, b: str, overlap: float) -> Column:
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")), F.lit(0.0))
    area = lambda s: (F.col(f"{s}xmax") - F.col(f"{s}xmin")) * (F.col(f"{s}ymax") - F.col(f"{s}ymin"))
    both = side("xmin", "xmax") * side("ymin", "ymax")
    return both / (area(a) + area(b) - both) > overlap


def open_after_rounds(dets: DataFrame, keys: list[str], overlap: float, id_col: str, enough: int) -> tuple[DataFrame, DataFrame]:
    """(kept, open): rows of ``dets`` that are surely kept, and those still open when no key has more than ``enough`` of them.

    No open row is covered by a kept one, so a greedy pass over the open ones alone finishes the work.  ``id_col`` holds
    whole numbers.  Boxes without an area cover nothing and are kept.
    """
    scales = math.ceil(math.log2(1 / min(overlap, 1.0)) + 1e-9)
    base = stage(dets.withColumn("_n", F.monotonically_increasing_id()), "dets")
    edges = [F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    boxes = base.select("_n", F.struct(*keys).alias("_k"), F.struct(F.col("score"), (-F.col(id_col)).alias("i"), (-F.col("_n")).alias("n")).alias("p"), *edges)
    solid = F.coalesce((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")) & (F.col("xmax") - F.col("xmin") < float("inf")) & (F.col("ymax") - F.col("ymin") < float("inf")), F.lit(False))
    kept = [boxes.where(~solid).select("_n")]
    left = stage(boxes.where(solid), "open")
    while (left.groupBy("_k").count().agg(F.max("count").alias("n")).first()["n"] or 0) > enough:
        cells = _cells(left, scales)
        shown = cells.withColumn("r", F.row_number().over(Window.partitionBy(*_CELL).orderBy(F.desc("p")))).where(F.col("r") <= SHOWN)
        shown = stage(shown.drop("r"), "shown")
        # boxes meet in a cell whose scale is that of one of them along each axis
        better = shown.select(*_CELL, F.col("kind").alias("wkind"), F.col("p").alias("wp"), *[F.col(c).alias(f"w{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
        beaten = shown.join(better, _CELL).where((F.col("kind").bitwiseOR(F.col("wkind")) == 3) & (F.col("wp") > F.col("p")) & _covers("", "w", overlap)).select("_n").distinct()
        seen = shown.groupBy("_n").agg(F.count("*").alias("n"), F.first("n_cells").alias("n_cells")).where("n = n_cells")
        won = seen.join(beaten, "_n", "left_anti").select("_n")
        winners = stage(left.join(won, "_n", "left_semi"), "kept")
        theirs = _cells(winners, scales).select(*_CELL, F.col("kind").alias("wkind"), F.col("_n").alias("wn"), *[F.col(c).alias(f"w{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
        met = cells.join(theirs, _CELL).where((F.col("kind").bitwiseOR(F.col("wkind")) == 3) & (F.col("_n") != F.col("wn")) & _covers("", "w", overlap))
        gone = met.select("_n").unionByName(winners.select("_n")).distinct()
        new = stage(left.join(gone, "_n", "left_anti"), "open")
        drop_stage(left, shown)
        left = new
        kept.append(winners.select("_n"))
    sure = kept[0]
    for k in kept[1:]:
        sure = sure.unionByName(k)
    return base.join(sure, "_n", "left_semi").drop("_n"), base.join(left.select("_n"), "_n", "left_semi").drop("_n")
