"""Evaluation of predictions: accuracy, confusion, precision and recall, votes, ensembles, partial credit, pixels."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import argmax, at, rank_of, sq_distance


def _ratio(a: Column, b: Column, default: float | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def drop_ignored(df: DataFrame, label: str = "label", ignore: int | None = None) -> DataFrame:
    return df if ignore is None else df.where(F.col(label) != ignore)


def topk_accuracy(df: DataFrame, k: int = 1, ignore: int | None = None, scores: str = "x", label: str = "label") -> DataFrame:
    """n, accuracy over all rows that are not ignored; null without any.  Equal scores: the larger index ranks first."""
    hit = (rank_of(scores, label) <= k).cast("int")
    return drop_ignored(df, label, ignore).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def topk_accuracy_by_class(df: DataFrame, classes: int, k: int = 1, ignore: int | None = None, scores: str = "x", label: str = "label") -> DataFrame:
    """label, n, accuracy; 0 for classes without rows."""
    hit = (rank_of(scores, label) <= k).cast("int")
    seen = drop_ignored(df, label, ignore).groupBy(label).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    return every.join(seen, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def confusion_matrix(df: DataFrame, actual: str = "label", predicted: str = "pred", normalize: bool = False) -> DataFrame:
    """actual, predicted, n and, normalized, share of the row."""
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    if not normalize:
        return cells
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def discretize(col: Column | str, width: float) -> Column:
    """width * round(v / width), halves away from zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c / F.lit(float(width))) * F.lit(float(width))


def binary_metrics(df: DataFrame, score: str = "score", label: str = "label", thresh: float = 0.5, ignore: int | None = None) -> DataFrame:
    """precision, recall (0 if undefined), accuracy, true-negative rate (null if undefined), F."""
    pos, true = F.col(score) >= thresh, F.col(label) != 0
    count = lambda c: F.count(F.when(c, 1))
    c = drop_ignored(df, label, ignore).agg(count(pos & true).alias("tp"), count(pos & ~true).alias("fp"), count(~pos & true).alias("fn"), count(~pos & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp, 0.0), _ratio(tp, tp + fn, 0.0)
    return c.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tn, fp + tn).alias("tnr"), _ratio(2 * p * r, p + r, 0.0).alias("f"))


def weighted_fmeasure(df: DataFrame, margin: float = 0.0, lam: float = 1.0, per_item: bool = False, fallback: bool = True, item: str = "item") -> DataFrame:
    """loss over cells (item, x, t, wr, wp): 1 - F of weighted recall and precision; where either is 0 and
    ``fallback``, lam times half the weighted mean square.  ``per_item`` averages the losses of the items."""
    x, t = F.col("x"), F.col("t")
    if 0 < margin < 0.5:
        x = F.when((t > 0.5) & (x >= 0.5 + margin), t).when((t <= 0.5) & (x <= 0.5 - margin), t).otherwise(x)
    rows = df.withColumn("x", x)
    sums = [F.sum(x).alias(n) for n, x in {"rn": F.expr("x * t * wr"), "rd": F.expr("t * wr"), "pn": F.expr("x * t * wp"), "pd": F.expr("x * wp"), "sq": F.expr("wp * (t - x) * (t - x)"), "w": F.col("wp")}.items()]
    by = rows.groupBy(item).agg(*sums) if per_item else rows.agg(*sums)
    r, p = _ratio(F.col("rn"), F.col("rd"), 0.0), _ratio(F.col("pn"), F.col("pd"), 0.0)
    f = 1 - _ratio(2 * p * r, p + r, 0.0)
    loss = F.when((p == 0) | (r == 0), lam * 0.5 * F.col("sq") / F.col("w")).otherwise(f) if fallback else f
    return by.select(loss.alias("loss")).agg(F.avg("loss").alias("loss"))


def average_crops(df: DataFrame, key: str = "id", probs: str = "probs", zero: list[int] | None = None) -> DataFrame:
    """key, n, cls and p (mean probability of each class over an item's rows), classes in ``zero`` set to 0."""
    long = df.select(key, F.posexplode(probs).alias("cls", "p"))
    if zero:
        long = long.withColumn("p", F.when(F.col("cls").isin(zero), 0.0).otherwise(F.col("p")))
    return long.groupBy(key, "cls").agg(F.avg("p").alias("p"), F.count("*").alias("n"))


def pick(cells: DataFrame, key: str = "id", value: str = "p") -> DataFrame:
    """key, pred: the class of largest value, the first of equals."""
    best = F.max(F.struct(F.col(value), (-F.col("cls")).alias("c")))
    return cells.groupBy(key).agg((-best["c"]).alias("pred"))


def combine_models(df: DataFrame, key: str = "id", probs: str = "probs", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """((key, pred, label) by mean probabilities over models, keys whose models disagree on label or length)."""
    bad = df.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.count_distinct(F.size(probs)).alias("lengths")).where("labels <> 1 or lengths <> 1")
    labels = df.groupBy(key).agg(F.max(label).alias(label))
    return pick(average_crops(df, key, probs), key).join(labels, key), bad


def transform_weights(df: DataFrame, hard: bool = False, probs: str = "probs", label: str = "label") -> DataFrame:
    """transform, weight: mean probability of the true label, or share of right votes."""
    w = (argmax(probs) == F.col(label)).cast("double") if hard else at(probs, label)
    return df.groupBy("transform").agg(F.avg(w).alias("weight"))


def weighted_vote(df: DataFrame, weights: DataFrame, key: str = "id", probs: str = "probs") -> DataFrame:
    """key, pred: transforms' probabilities summed by weight.  A row a transform is small, so Spark may broadcast it."""
    long = df.join(weights, "transform").select(key, "weight", F.posexplode(probs).alias("cls", "p"))
    return pick(long.groupBy(key, "cls").agg(F.sum(F.col("p") * F.col("weight")).alias("p")), key)


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label", by: str | None = None) -> DataFrame:
    hit = F.avg((F.col(pred) == F.col(label)).cast("int")).alias("accuracy")
    return df.groupBy(by).agg(F.count("*").alias("n"), hit) if by else df.agg(F.count("*").alias("n"), hit)


def partial_credit(df: DataFrame, probs: str = "probs", first: str = "cls1", second: str = "cls2") -> DataFrame:
    """Adds points: two labels, both in the top two 4, only the top one 2, only the second 1, none -2; one label, in the
    top two 4, else -2.  The second is the maximum once the top value is set to 0."""
    top = argmax(probs)
    rest = F.transform(probs, lambda p, i: F.when(i == F.col("top"), 0.0).otherwise(p))
    out = df.withColumn("top", top).withColumn("next", argmax(rest))
    a, b = F.col(first), F.col(second)
    t, n = F.col("top"), F.col("next")
    two = F.when(((t == a) & (n == b)) | ((t == b) & (n == a)), 4).when((t == a) | (t == b), 2).when((n == a) | (n == b), 1).otherwise(-2)
    one = F.when((t == a) | (n == a), 4).otherwise(-2)
    return out.withColumn("points", F.when(b.isNull(), one).otherwise(two))


def partial_credit_summary(scored: DataFrame, second: str = "cls2") -> DataFrame:
    single = F.col(second).isNull()
    return scored.agg(F.avg("points").alias("all"), F.avg(F.when(single, F.col("points"))).alias("single"), F.avg(F.when(~single, F.col("points"))).alias("double"))


def prob_histogram(df: DataFrame, prob: str = "p", bins: int = 100, weight: str | None = None, label: str = "label") -> DataFrame:
    """part (all, background, foreground), bin, n: weighted counts of probabilities in equal bins; 1 is in the last."""
    w = F.col(weight) if weight else F.lit(1.0)
    bin_ = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    parts = F.array(F.lit("all"), F.when(F.col(label) != 0, F.lit("foreground")).otherwise(F.lit("background")))
    return df.select(F.explode(parts).alias("part"), bin_.alias("bin"), w.alias("w")).groupBy("part", "bin").agg(F.sum("w").alias("n"))


def error_reduction(x1: Column, x2: Column, smooth: float = 0.02) -> Column:
    """How much of the error of x1 is gone in x2; 0 where 1 - x1 + smooth is not positive."""
    return F.when(x1 < 1 + smooth, ((1 - x1) - (1 - x2)) / (1 - x1 + smooth)).otherwise(0.0)


def metric_series(df: DataFrame, keys: list[str], kinds: tuple[str, str] = ("equivariance", "invariance")) -> DataFrame:
    """keys, metric, value: one ordered series a metric; the first kind, or the second where it is missing.

    ``df`` has the keys, kind, metric and value.
    """
    wide = df.groupBy(*keys, "metric").pivot("kind", list(kinds)).agg(F.first("value"))
    return wide.select(*keys, "metric", F.coalesce(*kinds).alias("value"))


def binarization_metrics(pixels: DataFrame) -> DataFrame:
    """image, accuracy, psnr, precision, recall, f, pseudo_f of cells (image, pred, gt, r_weight, p_weight); 0 is foreground."""
    p0, g0 = F.col("pred") == 0, F.col("gt") == 0
    count = lambda c: F.sum(c.cast("double"))
    by = pixels.groupBy("image").agg(
        F.count("*").alias("n"), count(F.col("pred") != F.col("gt")).alias("wrong"), F.max("gt").cast("double").alias("top"),
        F.avg((F.col("pred") - F.col("gt")) * (F.col("pred") - F.col("gt"))).alias("mse"),
        count(p0 & g0).alias("tp"), count(p0).alias("pp"), count(g0).alias("gp"),
        F.sum(F.when(p0 & g0, F.col("r_weight")).otherwise(0.0)).alias("rn"), F.sum(F.when(g0, F.col("r_weight")).otherwise(0.0)).alias("rd"),
        F.sum(F.when(p0 & g0, F.col("p_weight")).otherwise(0.0)).alias("pn"), F.sum(F.when(p0, F.col("p_weight")).otherwise(0.0)).alias("pd"),
    )
    p, r = _ratio(F.col("tp"), F.col("pp"), 0.0), _ratio(F.col("tp"), F.col("gp"), 0.0)
    wp, wr = _ratio(F.col("pn"), F.col("pd"), 0.0), _ratio(F.col("rn"), F.col("rd"), 0.0)
    psnr = F.when(F.col("mse") > 0, 10 * F.log10(F.col("top") * F.col("top") / F.col("mse")))
    return by.select("image", (100 * (1 - F.col("wrong") / F.col("n"))).alias("accuracy"), psnr.alias("psnr"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r, 0.0).alias("f"), _ratio(2 * wp * wr, wp + wr, 0.0).alias("pseudo_f"))


def binary_agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """both, only_a, only_b, none: counts of cells of two binary images of the same keys."""
    both = a.select(*keys, (F.col(value) != 0).cast("int").alias("x")).join(b.select(*keys, (F.col(value) != 0).cast("int").alias("y")), keys)
    code = 2 * F.col("x") + F.col("y")
    return both.agg(*[F.count(F.when(code == c, 1)).alias(n) for c, n in ((3, "both"), (2, "only_a"), (1, "only_b"), (0, "none"))])


def drd(images: DataFrame, block: int = 8, reach: int = 2) -> DataFrame:
    """image, drd: distance-reciprocal distortion of (image, height, width, pred, gt), arrays in row order; 0 is foreground.

    Every wrong pixel adds the weighted disagreement of its (2 reach + 1)^2 surroundings with its own value; the sum
    is over the number of blocks that are not of one value.
    """
    import numpy as np
    import pandas as pd

    d = np.hypot(*np.mgrid[-reach : reach + 1, -reach : reach + 1].astype(float))
    w = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
    w /= w.sum()

    def one(h: int, wd: int, pred, gt) -> float:
        p, g = (np.asarray(v, float).reshape(h, wd) != 0 for v in (pred, gt))
        rows, cols = (-h) % block, (-wd) % block
        cut = np.pad(g, ((0, rows), (0, cols)), mode="edge").reshape((h + rows) // block, block, -1, block)
        mixed = int((cut.any((1, 3)) & ~cut.all((1, 3))).sum())
        wide = np.pad(g.astype(float), reach, mode="edge")
        total = 0.0
        for y, x in zip(*np.nonzero(p != g), strict=True):
            total += float((np.abs(wide[y : y + 2 * reach + 1, x : x + 2 * reach + 1] - p[y, x]) * w).sum())
        return total / mixed if mixed else float("nan") if total else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image": pdf["image"], "drd": [one(h, x, p, g) for h, x, p, g in zip(pdf["height"], pdf["width"], pdf["pred"], pdf["gt"], strict=True)]})

    return images.select("image", "height", "width", "pred", "gt").mapInPandas(run, "image long, drd double")


def reconstruction(df: DataFrame, a: str, b: str) -> Column:
    """Mean square gap by dimension."""
    return sq_distance(a, b) / F.size(a)
