"""Column functions over array<double>: maps, reductions, softmax, top-k, slices.  All stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column | str


def _c(v: Vec) -> Column:
    return F.col(v) if isinstance(v, str) else v


def at(v: Vec, index: Vec) -> Column:
    """The element at a 0-based index."""
    return F.element_at(_c(v), (_c(index) + 1).cast("int"))


def vsum(v: Vec) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Vec, b: Vec) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sq_distance(a: Vec, b: Vec) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l1(v: Vec) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + F.abs(x))


def l2(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def softmax(v: Vec) -> Column:
    """Softmax with the maximum taken off first."""
    top = F.array_max(_c(v))
    e = F.transform(_c(v), lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / vsum(e))


def argmax(v: Vec) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("int")


def max_indicator(v: Vec) -> Column:
    """1 at the first maximum, 0 elsewhere."""
    at = argmax(v)
    return F.transform(_c(v), lambda x, i: F.when(i == at, 1.0).otherwise(0.0))


def ranked(v: Vec) -> Column:
    """Structs (v, i), largest value first, of equal values the larger index first."""
    return F.sort_array(F.transform(_c(v), lambda x, i: F.struct(x.alias("v"), i.alias("i"))), asc=False)


def argmax_topk(v: Vec, k: int, with_values: bool = False) -> Column:
    """The k largest as indices, or as structs (v, i)."""
    top = F.slice(ranked(v), 1, k)
    return top if with_values else F.transform(top, lambda s: s["i"])


def topk_mask(v: Vec, k: int) -> Column:
    """The k largest values stay, the rest become 0."""
    kept = argmax_topk(v, k)
    return F.transform(_c(v), lambda x, i: F.when(F.array_contains(kept, i), x).otherwise(0.0))


def rank_of(v: Vec, index: Vec) -> Column:
    """1-based rank of an element in ``ranked`` order, by counting what is above it."""
    own = at(v, index)
    above = F.filter(_c(v), lambda x, i: (x > own) | ((x == own) & (i > _c(index))))
    return F.size(above) + 1


def vec_map(v: Vec, op: str, **p) -> Column:
    """Element-wise sigmoid, tanh, relu, prelu, power, exp, log, abs, bnll, threshold."""
    slope, shift, scale, power, base = p.get("slope", 0.0), p.get("shift", 0.0), p.get("scale", 1.0), p.get("power", 1.0), p.get("base")
    maps = {
        "sigmoid": lambda x: 1.0 / (1.0 + F.exp(-x)),
        "tanh": F.tanh,
        "relu": lambda x: F.greatest(x, F.lit(0.0)) + F.lit(float(slope)) * F.least(x, F.lit(0.0)),
        "power": lambda x: F.pow(F.lit(float(shift)) + F.lit(float(scale)) * x, F.lit(float(power))),
        "exp": lambda x: F.exp(shift + scale * x) if base is None else F.pow(F.lit(float(base)), shift + scale * x),
        "log": lambda x: F.log(shift + scale * x) / (F.log(F.lit(float(base))) if base else F.lit(1.0)),
        "abs": F.abs,
        "bnll": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
        "threshold": lambda x: F.when(x > p.get("threshold", 0.0), 1.0).otherwise(0.0),
    }
    if op == "prelu":
        slopes, per = p["slopes"], p.get("per_channel", 1)
        table = F.array(*[F.lit(float(s)) for s in slopes])
        return F.transform(_c(v), lambda x, i: F.greatest(x, F.lit(0.0)) + at(table, (i / per).cast("int") % len(slopes)) * F.least(x, F.lit(0.0)))
    return F.transform(_c(v), maps[op])


def _times(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(float(w)))


def eltwise(vs: list[Vec], op: str = "sum", coeffs: list[float] | None = None) -> Column:
    """Product, coefficient sum or maximum of several vectors; coefficients count for sums only."""
    cols = [_c(v) for v in vs]
    if op == "sum":
        scaled = [_times(c, w) for c, w in zip(cols, coeffs or [1.0] * len(cols), strict=True)]
    else:
        scaled = cols
    join = {"prod": lambda x, y: x * y, "sum": lambda x, y: x + y, "max": lambda x, y: F.when(x > y, x).otherwise(y)}[op]
    out = scaled[0]
    for c in scaled[1:]:
        out = F.zip_with(out, c, join)
    return out


def reduce_vec(v: Vec, op: str = "sum", coeff: float = 1.0) -> Column:
    total = {"sum": vsum, "asum": l1, "sumsq": lambda x: dot(x, x), "mean": lambda x: vsum(x) / F.size(_c(x))}[op](v)
    return total * F.lit(float(coeff))


def mvn(v: Vec, channels: int = 1, variance: bool = True, eps: float = 1e-9) -> Column:
    """Each channel less its mean, over its deviation plus eps."""
    size = (F.size(_c(v)) / channels).cast("int")

    def one(c: int) -> Column:
        part = F.slice(_c(v), F.lit(c) * size + 1, size)
        mean = vsum(part) / size
        dev = F.sqrt(F.greatest(dot(part, part) / size - mean * mean, F.lit(0.0))) + eps
        return F.transform(part, lambda x: (x - mean) / dev if variance else x - mean)

    return F.concat(*[one(c) for c in range(channels)])


def preprocess(v: Vec, means: list[float] | Column, scale: float = 1.0, per_channel: int | None = None) -> Column:
    """scale * (x - mean); one mean an element, or one for each ``per_channel`` elements."""
    table = means if isinstance(means, Column) else F.array(*[F.lit(float(m)) for m in means])
    own = lambda i: (i / per_channel).cast("int") if per_channel else i
    return F.transform(_c(v), lambda x, i: F.lit(float(scale)) * (x - at(table, own(i))))


def scale_bias(v: Vec, scale: Vec | None = None, bias: Vec | None = None) -> Column:
    out = _c(v)
    if scale is not None:
        out = F.zip_with(out, _c(scale), lambda x, s: x * s)
    if bias is not None:
        out = F.zip_with(out, _c(bias), lambda x, b: x + b)
    return out


def concat_vec(*vs: Vec) -> Column:
    return F.concat(*[_c(v) for v in vs])


def slice_vec(v: Vec, points: list[int]) -> list[Column]:
    """Parts between the given 0-based points; the last reaches the end."""
    starts = [0, *points]
    ends = [*[F.lit(p) for p in points], F.size(_c(v))]
    return [F.slice(_c(v), F.lit(a + 1), b - a) for a, b in zip(starts, ends, strict=True)]


def remove_at(v: Vec, index: Vec) -> Column:
    """Without the element at a 0-based index."""
    return F.filter(_c(v), lambda x, i: i != _c(index))


def binary_encode(v: Vec, bits: int) -> Column:
    """The first bits of the float32 payload, least significant bit of each byte first."""
    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda a: np.unpackbits(np.asarray(a, "<f4").view(np.uint8), bitorder="little")[:bits].tolist())

    return encode(_c(v))


def inner_product(v: Vec, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """W x + b of every row, a batch at a time."""
    w, b = np.asarray(weights, float), np.asarray(bias if bias is not None else np.zeros(len(weights)), float)

    @F.pandas_udf("array<double>")
    def product(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(s.to_numpy()) @ w.T + b))

    return product(_c(v))
