"""Comparing representations: invariance and reconstruction metrics, distances, groups, neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import argmax, l2, sq_distance, vsum
from .neighbours import nearest_neighbours


def _kl(p: str, q: str) -> Column:
    """Terms of p ln(p / m), m the mean of both; 0 where p is 0."""
    return vsum(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log(a / ((a + b) / 2))).otherwise(0.0)))


def sqrt_jsd(p: str, q: str) -> Column:
    return F.sqrt(F.greatest(0.5 * _kl(p, q) + 0.5 * _kl(q, p), F.lit(0.0)))


def pair_with_base(df: DataFrame, base: str, key: str = "id") -> DataFrame:
    """Each row with the base transform's row of its item: vec0, probs0 beside vec, probs."""
    zero = df.where(F.col("transform") == base).select(key, F.col("vec").alias("vec0"), F.col("probs").alias("probs0"))
    return df.join(zero, key)


def invariance_metrics(df: DataFrame, base: str, label: str = "label") -> DataFrame:
    """transform, avg_l2, magnitude, norm_l2, similarity, agreement, accuracy, norm_accuracy, jsd, jss."""
    rows = pair_with_base(df, base)
    hit = (argmax("probs") == F.col(label)).cast("int")
    hit0 = (argmax("probs0") == F.col(label)).cast("int")
    by = rows.groupBy("transform").agg(
        F.avg(F.sqrt(sq_distance("vec", "vec0"))).alias("avg_l2"), F.avg(l2("vec0")).alias("magnitude"), F.avg((argmax("probs") == argmax("probs0")).cast("int")).alias("agreement"),
        F.avg(hit).alias("accuracy"), F.avg(hit0).alias("base_accuracy"), F.avg(sqrt_jsd("probs", "probs0")).alias("jsd"),
    )
    norm = F.col("avg_l2") / F.col("magnitude")
    return by.select("transform", "avg_l2", "magnitude", norm.alias("norm_l2"), (1 - norm).alias("similarity"), "agreement", "accuracy", F.when(F.col("base_accuracy") > 0, F.col("accuracy") / F.col("base_accuracy")).alias("norm_accuracy"), "jsd", (1 - F.col("jsd")).alias("jss"))


def equivalence_metrics(df: DataFrame, label: str = "label") -> DataFrame:
    """mean L2 over dimension of vec against vec0, raw and over its scale, mean root JSD, accuracy and agreement."""
    gap = F.sqrt(sq_distance("vec", "vec0")) / F.size("vec")
    scaled = F.sqrt(sq_distance("scaled", "scaled0")) / F.size("scaled")
    return df.agg(
        F.avg(gap).alias("l2"), F.avg(scaled).alias("l2_scaled"), F.avg(sqrt_jsd("probs", "probs0")).alias("jsd"),
        F.avg((argmax("probs") == F.col(label)).cast("int")).alias("accuracy"), F.avg((argmax("probs") == argmax("probs0")).cast("int")).alias("agreement"),
    )


def pairwise_distances(df: DataFrame, key: str = "id", vec: str = "vec", block: int = 256, nearest: int | None = None) -> DataFrame:
    """a, b, d (and share of the total of all): Euclidean distances of all pairs, a < b, by blocks of ids.

    This is an all-pairs table by its own meaning: its size is the square of the input's, so it is for tables of
    models or categories.  With ``nearest`` it is that many partners a row instead (a, b, d, k), found without all pairs.
    """
    if nearest is not None:
        return nearest_neighbours(df, nearest, key, vec).rows
    n = max(1, -(-df.count() // block))
    blocks = df.select(key, F.col(vec).alias("vec"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("g"))
    kind = df.schema[key].dataType
    left = blocks.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least(F.col("g"), o).alias("i"), F.greatest(F.col("g"), o).alias("j")))))

    def run(pair: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pair
        a, b = pdf[pdf["g"] == i], pdf[pdf["g"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pdf[key][:0], "b": pdf[key][:0], "d": np.empty(0)})
        x, y = np.stack(a["vec"].to_numpy()).astype(float), np.stack(b["vec"].to_numpy()).astype(float)
        own = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
        square = own - 2 * x @ y.T
        for m, o in np.argwhere(square <= 1e-6 * own):  # too near for a product's rounding
            square[m, o] = ((x[m] - y[o]) ** 2).sum()
        d = np.sqrt(np.maximum(square, 0))
        ia, ib = np.meshgrid(a[key].to_numpy(), b[key].to_numpy(), indexing="ij")
        keep = ia < ib if i == j else ia != ib
        lo, hi = np.minimum(ia, ib)[keep], np.maximum(ia, ib)[keep]
        return pd.DataFrame({"a": lo, "b": hi, "d": d[keep]})

    return left.select(key, "vec", "g", "pair.i", "pair.j").groupBy("i", "j").applyInPandas(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("d", T.DoubleType())]))


def normalised(dist: DataFrame) -> DataFrame:
    """Distances over the total of the full symmetric matrix."""
    total = dist.agg((2 * F.sum("d")).alias("total"))
    return dist.join(F.broadcast(total)).select("a", "b", "d", (F.col("d") / F.col("total")).alias("share"))


def symmetrize(dist: DataFrame) -> DataFrame:
    """a, b (a < b), mean and gap of d(a, b) and d(b, a)."""
    back = dist.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("d").alias("e"))
    return dist.join(back, ["a", "b"]).where("a < b").select("a", "b", ((F.col("d") + F.col("e")) / 2).alias("mean"), F.abs(F.col("d") - F.col("e")).alias("gap"))


def group_distances(dist: DataFrame, groups: DataFrame) -> DataFrame:
    """group_a, group_b, distance: mean between (and within) groups over the largest of the means.

    ``dist(a, b, d)`` in both directions, ``groups(item, grp)``.
    """
    ga, gb = groups.select(F.col("item").alias("a"), F.col("grp").alias("group_a")), groups.select(F.col("item").alias("b"), F.col("grp").alias("group_b"))
    means = dist.where("a <> b").join(ga, "a").join(gb, "b").groupBy("group_a", "group_b").agg(F.avg("d").alias("d"))
    top = means.agg(F.max("d").alias("top"))
    return means.join(F.broadcast(top)).select("group_a", "group_b", (F.col("d") / F.col("top")).alias("distance"))


def knn_group_curve(dist: DataFrame, groups: DataFrame) -> DataFrame:
    """k, share: ordered same-group pairs whose second is among the k nearest of the first, over all of them."""
    ga, gb = groups.select(F.col("item").alias("a"), F.col("grp").alias("group_a")), groups.select(F.col("item").alias("b"), F.col("grp").alias("group_b"))
    ranked = dist.where("a <> b").withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("d", "b")))
    hits = ranked.join(ga, "a").join(gb, "b").groupBy("k").agg(F.sum((F.col("group_a") == F.col("group_b")).cast("int")).alias("n"))
    # a row a rank, which is at most the number of items: the running sum is over that short table
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = hits.agg(F.sum("n").alias("total"))
    return hits.withColumn("run", F.sum("n").over(upto)).join(F.broadcast(total)).select("k", (F.col("run") / F.col("total")).alias("share"))


def knn_group_shares(near: DataFrame, groups: DataFrame) -> DataFrame:
    """k, share, random: the curve up to the k of ``near(a, b, k)``, without the distances of all pairs, and what chance would give.

    All ordered same-group pairs are counted from the sizes of the groups; by chance k of n - 1 others are among the k nearest.
    """
    ga, gb = groups.select(F.col("item").alias("a"), F.col("grp").alias("group_a")), groups.select(F.col("item").alias("b"), F.col("grp").alias("group_b"))
    hits = near.join(ga, "a").join(gb, "b").groupBy("k").agg(F.sum((F.col("group_a") == F.col("group_b")).cast("int")).alias("n"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum("n").alias("items"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row a rank
    return hits.withColumn("run", F.sum("n").over(upto)).join(F.broadcast(sizes)).select("k", (F.col("run") / F.col("pairs")).alias("share"), (F.col("k") / (F.col("items") - 1)).alias("random"))
