"""Losses of predictions: one value a row as a column expression, and dataset totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import at, dot, softmax, sq_distance, vsum

#: Smallest normal float32, and the floor of probabilities in the multinomial loss; fixed values.
FLT_MIN, LOG_FLOOR = 1.1754943508222875e-38, 1e-20


def softmax_loss_row(x: str, label: str, weights: list[float] | None = None) -> Column:
    p = F.greatest(at(softmax(x), label), F.lit(FLT_MIN))
    w = at(F.array(*[F.lit(float(v)) for v in weights]), label) if weights else F.lit(1.0)
    return -w * F.log(p)


def softmax_log_loss(df: DataFrame, x: str = "x", label: str = "label", ignore: int | None = None, weights: list[float] | None = None, normalize: bool = True) -> DataFrame:
    """Mean over the rows that are not ignored, or over all rows (``normalize=False``)."""
    valid = F.lit(True) if ignore is None else F.col(label) != ignore
    n = F.count(F.when(valid, 1)) if normalize else F.count(F.lit(1))
    return df.agg((F.sum(F.when(valid, softmax_loss_row(x, label, weights))) / n).alias("loss"))


def log_loss(df: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    return df.agg(F.avg(-F.log(F.greatest(at(probs, label), F.lit(LOG_FLOOR)))).alias("loss"))


def infogain_loss(df: DataFrame, h: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """``h(label, row)`` holds a row of the matrix for each label; its size is that of the label set."""
    gains = h.select(F.col("label").alias("_l"), F.col("row").alias("_row"))
    logs = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(LOG_FLOOR))))
    return df.join(gains, F.col(label) == F.col("_l")).agg(F.avg(-dot(F.col("_row"), logs)).alias("loss"))


def euclidean_loss(df: DataFrame, a: str = "a", b: str = "b", by_element: bool = False) -> DataFrame:
    n = F.sum(F.size(a)) if by_element else F.count("*")
    return df.agg((F.sum(sq_distance(a, b)) / n / 2).alias("loss"))


def hinge_loss(df: DataFrame, x: str = "x", label: str = "label", norm: str = "L1") -> DataFrame:
    margins = F.transform(x, lambda v, i: F.greatest(F.lit(0.0), 1 + F.when(i == F.col(label), -v).otherwise(v)))
    return df.agg((F.sum(vsum(margins) if norm == "L1" else dot(margins, margins)) / F.count("*")).alias("loss"))


def sigmoid_ce_row(x: str, target: str, pos_mult: float = 0.0) -> Column:
    """Stable form; positive targets weigh 1 + pos_mult."""
    return vsum(
        F.zip_with(x, target, lambda v, t: -(v * (t - F.when(v >= 0, 1.0).otherwise(0.0)) - F.log1p(F.exp(-F.abs(v)))) * (1 + t * F.lit(float(pos_mult))))
    )


def sigmoid_ce(df: DataFrame, x: str = "x", target: str = "target", pos_mult: float = 0.0, by_element: bool = False) -> DataFrame:
    n = F.sum(F.size(x)) if by_element else F.count("*")
    return df.agg((F.sum(sigmoid_ce_row(x, target, pos_mult)) / n).alias("loss"))


def soft_ce_row(probs: str, target: str) -> Column:
    return vsum(F.zip_with(probs, target, lambda p, t: -t * F.log(F.greatest(p, F.lit(FLT_MIN)))))


def soft_ce(df: DataFrame, probs: str = "probs", target: str = "target", by_element: bool = False) -> DataFrame:
    n = F.sum(F.size(probs)) if by_element else F.count("*")
    return df.agg((F.sum(soft_ce_row(probs, target)) / n).alias("loss"))


def contrastive_row(a: str, b: str, similar: str, margin: float = 1.0, legacy: bool = False) -> Column:
    d2 = sq_distance(a, b)
    gap = F.greatest(F.lit(float(margin)) - (d2 if legacy else F.sqrt(d2)), F.lit(0.0))
    return F.when(F.col(similar) != 0, d2).otherwise(gap if legacy else gap * gap)


def contrastive_loss(pairs: DataFrame, margin: float = 1.0, legacy: bool = False, a: str = "a", b: str = "b", similar: str = "similar") -> DataFrame:
    return pairs.agg((F.sum(contrastive_row(a, b, similar, margin, legacy)) / F.count("*") / 2).alias("loss"))


def tukey_row(x: str, target: str, c: float = 4.685, scales: list[float] = (1.0,), slope: float = 0.0) -> Column:
    table = F.array(*[F.lit(float(s)) for s in scales])
    gaps = F.zip_with(x, target, lambda v, t: F.abs(v - t))
    top = c * c / 6

    def one(d: Column, i: Column) -> Column:
        r = d / F.element_at(table, i % len(scales) + 1)
        u = 1 - (r / c) * (r / c)
        return F.when(r < c, F.lit(top) * (1 - u * u * u)).otherwise(F.lit(top) + (r - c) * F.lit(float(slope)))

    return vsum(F.transform(gaps, one))


def tukey_loss(df: DataFrame, x: str = "x", target: str = "target", **options) -> DataFrame:
    return df.agg((F.sum(tukey_row(x, target, **options)) / F.count("*")).alias("loss"))
