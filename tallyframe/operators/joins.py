"""Joins of aligned sources, ground truth, windows, curves and class names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stitch_sources(dfs: list[DataFrame], key: str = "id", vec: str = "vec", label: str = "label") -> DataFrame:
    """key, vec (of all sources, in order), label of the keys that every source has."""
    parts = [d.select(key, F.col(vec).alias(f"_v{i}"), F.col(label).alias(f"_l{i}")) for i, d in enumerate(dfs)]
    joined = reduce(lambda a, b: a.join(b, key), parts)
    return joined.select(key, F.concat(*[F.col(f"_v{i}") for i in range(len(dfs))]).alias(vec), F.col("_l0").alias(label))


def stitch_mismatches(dfs: list[DataFrame], key: str = "id", label: str = "label") -> DataFrame:
    """key, present, labels of the keys that a source lacks or that differ in label; only keys and labels are moved."""
    every = reduce(DataFrame.unionByName, [d.select(key, F.col(label).alias("_l"), F.lit(i).alias("_s")) for i, d in enumerate(dfs)])
    by = every.groupBy(key).agg(F.count_distinct("_s").alias("present"), F.count_distinct("_l").alias("labels"))
    return by.where((F.col("present") < len(dfs)) | (F.col("labels") > 1))


def join_gt(preds: DataFrame, gt: DataFrame, classes: DataFrame, name: str = "name") -> DataFrame:
    """Predictions with the id of the true class: gt(name, cls), classes(cls, cls_id)."""
    return preds.join(gt.join(classes, "cls").select(name, "cls", "cls_id"), name)


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side (left, right) of the keys that one table lacks."""
    left = a.select(key).distinct().join(b, key, "left_anti").select(key, F.lit("left").alias("side"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


def join_windows(images: DataFrame, windows: DataFrame, key: str = "image_index") -> DataFrame:
    return windows.join(images, key)


def join_curves(metrics: DataFrame, keys: tuple[str, ...] = ("run", "output", "iteration")) -> DataFrame:
    """keys, train, test: both phases of a curve on one axis; null where a phase has no point."""
    side = lambda p: metrics.where(F.col("phase") == p).select(*keys, F.col("value").alias(p))
    return side("train").join(side("test"), list(keys), "full_outer")


def base_name(col: str):
    """File name without folders and the last extension."""
    return F.regexp_replace(F.regexp_replace(F.col(col), r"^.*/", ""), r"\.[^.]*$", "")


def match_triples(preds: DataFrame, gts: DataFrame, weights: DataFrame, path: str = "path") -> DataFrame:
    """The three tables by base name; columns but the path must differ."""
    keyed = [d.withColumn("item", base_name(path)).drop(path) for d in (preds, gts, weights)]
    return keyed[0].join(keyed[1], "item").join(keyed[2], "item")


def pending(todo: DataFrame, done: DataFrame, key: list[str], base: str | None = None) -> DataFrame:
    """Rows of ``todo`` without a result; with ``base``, whether the base transform is among them."""
    left = todo.join(done, key, "left_anti")
    if base is None:
        return left
    flag = left.agg(F.coalesce(F.max((F.col("transform") == base).cast("int")), F.lit(0)).alias("redo_base"))
    return left.join(F.broadcast(flag))


def label_names(topk: DataFrame, names: DataFrame, cls: str = "cls") -> DataFrame:
    """Adds the name of each predicted class; names(cls, name)."""
    return topk.join(names, cls, "left")


def hedged_topk(scores: DataFrame, probmat: DataFrame, nodes: DataFrame, k: int = 5, key: str = "id", tradeoff: float = 0.1) -> DataFrame:
    """key, rank, node, gain: expected information gain of tree nodes, less ``tradeoff`` times their preference.

    scores(key, leaf, p), probmat(leaf, node, p_node) sparse, nodes(node, infogain, preference).
    """
    mass = scores.join(probmat, "leaf").groupBy(key, "node").agg(F.sum(F.col("p") * F.col("p_node")).alias("mass"))
    gain = mass.join(nodes, "node").withColumn("gain", F.col("mass") * (F.col("infogain") - tradeoff * F.col("preference")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("gain").desc(), "node"))
    return gain.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "node", "gain")


def union_sources(dfs: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All tables in one, with the name of each."""
    return reduce(DataFrame.unionByName, [d.withColumn(source, F.lit(n)) for n, d in dfs.items()])
