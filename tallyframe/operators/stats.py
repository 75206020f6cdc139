"""Dataset profiles: means, moments, histograms of fields, entropy, divergence, Gram matrices, least squares."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors up to this many elements are summed as rows (element, value); longer ones as partial vectors.
EXPLODE_DIMS = 1024


def element_stats(df: DataFrame, vec: str = "vec") -> DataFrame:
    """pos, n, mean, std (population), second (root mean square) of each element; partial sums before the shuffle."""
    long = df.select(F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("second"))


def mean_vector(df: DataFrame, vec: str = "vec") -> DataFrame:
    """pos, mean, over the vectors that reach that place.  Vectors are added up a batch at a time where the longest has more than
    ``EXPLODE_DIMS`` values; one vector a partition is then shuffled."""
    import numpy as np
    import pandas as pd

    longest = df.agg(F.max(F.size(vec)).alias("n")).first()["n"]
    if longest is None or longest <= EXPLODE_DIMS:
        return element_stats(df, vec).select("pos", "mean")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(longest), np.zeros(longest, np.int64)
        for pdf in batches:
            held = [np.asarray(v, float) for v in pdf["v"] if v is not None]
            for size in {len(v) for v in held}:
                some = np.stack([v for v in held if len(v) == size])
                known = ~np.isnan(some)  # nulls inside a vector come as not-a-number
                total[:size] += np.where(known, some, 0).sum(0)
                n[:size] += known.sum(0)
        yield pd.DataFrame({"pos": np.arange(longest, dtype="int32"), "s": total, "n": n})

    sums = df.select(F.col(vec).alias("v")).mapInPandas(partial, "pos int, s double, n long")
    return sums.groupBy("pos").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))


def channel_means(df: DataFrame, channels: int, vec: str = "vec") -> DataFrame:
    """channel, mean: vectors are laid out channel after channel."""
    size = F.size(vec) / channels
    long = df.select(F.posexplode(vec).alias("pos", "x"), size.alias("per"))
    return long.groupBy(F.floor(F.col("pos") / F.col("per")).cast("int").alias("channel")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


def _beside_stats(df: DataFrame, vec: str, key: str) -> DataFrame:
    """key, pos, x, mean, std, second of each element: the statistics travel as one row of arrays, as long as a vector is."""
    stats = element_stats(df, vec).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std", "second"))).alias("_stats"))
    both = df.select(key, F.col(vec).alias("_v")).join(F.broadcast(stats))
    cells = F.transform("_v", lambda x, i: F.struct(i.alias("pos"), x.cast("double").alias("x"), F.get("_stats", i).alias("s")))
    return both.select(key, F.inline(cells)).select(key, "pos", "x", "s.mean", "s.std", "s.second")


def standardize(df: DataFrame, vec: str = "vec", key: str = "id", guard: float | None = None) -> DataFrame:
    """key, pos, centered, standard.  A deviation of 0 gives null, or ``guard`` in its place."""
    std = F.when(F.col("std") != 0, F.col("std")).otherwise(F.lit(guard).cast("double"))
    centered = F.col("x") - F.col("mean")
    return _beside_stats(df, vec, key).select(key, "pos", centered.alias("centered"), (centered / std).alias("standard"))


def second_moment_scale(df: DataFrame, vec: str = "vec", key: str = "id", inverse: bool = False) -> DataFrame:
    """key, pos, scaled: over (or, inverse, times) the root second moment around 0; a moment of 0 counts as 1."""
    second = F.when(F.col("second") == 0, 1.0).otherwise(F.col("second"))
    return _beside_stats(df, vec, key).select(key, "pos", (F.col("x") * second if inverse else F.col("x") / second).alias("scaled"))


def batch_norm(df: DataFrame, vec: str = "vec", key: str = "id", eps: float = 1e-5, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """key, pos, y: dataset statistics, eps added to the variance, then scale and shift."""
    y = (F.col("x") - F.col("mean")) / F.sqrt(F.col("std") * F.col("std") + F.lit(eps)) * F.lit(scale) + F.lit(shift)
    return _beside_stats(df, vec, key).select(key, "pos", y.alias("y"))


def field_counts(df: DataFrame, fields: list[str], source: str = "source") -> DataFrame:
    """field, source (null: all of them), value, n: one pass over all fields, unpivoted, then rolled up."""
    long = df.unpivot([source], [F.col(f).cast("string").alias(f) for f in fields], "field", "value").where("value is not null")
    by = long.groupBy("field", "value", source).agg(F.count("*").alias("n"))
    every = by.groupBy("field", "value").agg(F.sum("n").alias("n")).withColumn(source, F.lit(None).cast("string"))
    return by.withColumn(source, F.coalesce(F.col(source), F.lit(""))).unionByName(every)


def shares(counts: DataFrame, source: str = "source") -> DataFrame:
    """Adds p: the share of a value among those of its field and source (totals are a row each)."""
    totals = counts.groupBy(F.col("field").alias("_f"), F.col(source).alias("_s")).agg(F.sum("n").alias("_n"))
    both = counts.join(totals, (F.col("field") == F.col("_f")) & F.col(source).eqNullSafe(F.col("_s")))
    return both.withColumn("p", F.col("n") / F.col("_n")).drop("_f", "_s", "_n")


def entropy(counts: DataFrame, source: str = "source") -> DataFrame:
    """field, source, entropy in bits."""
    return shares(counts, source).groupBy("field", source).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def kl_divergence(counts: DataFrame, source: str = "source", missing: float = 1e-4) -> DataFrame:
    """field, source, kl in nats of each source against all; a value that one side lacks has p = ``missing`` there."""
    p = shares(counts, source)
    every = p.where(F.col(source).isNull()).select("field", "value", F.col("p").alias("q"))
    names = p.where(F.col(source).isNotNull()).select("field", source).distinct()
    grid = names.join(every, "field")  # the values of a field are those of all sources together
    own = p.where(F.col(source).isNotNull()).select("field", source, "value", "p")
    both = grid.join(own, ["field", source, "value"], "left").withColumn("p", F.coalesce("p", F.lit(missing)))
    return both.groupBy("field", source).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def field_moments(df: DataFrame, fields: list[str], source: str = "source") -> DataFrame:
    """source (null: all), field, n, mean, std (population); mean and std are null where there are no values."""
    long = df.unpivot([source], [F.col(f).cast("double").alias(f) for f in fields], "field", "x")
    return long.rollup("field", source).agg(F.grouping_id().alias("g"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).where("g < 3").select(
        "field", F.when(F.col("g") == 0, F.coalesce(F.col(source), F.lit(""))).alias(source), "n", "mean", "std"
    )


def label_counts(df: DataFrame, col: str = "label") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def max_where_present(df: DataFrame, text: str, num: str, default: int = -1) -> DataFrame:
    """Largest ``num`` among rows whose ``text`` is not empty."""
    return df.agg(F.coalesce(F.max(F.when(F.col(text) != "", F.col(num))), F.lit(default)).alias("highest"))


def batch_plan(df: DataFrame, batch_size: int, source: str = "source") -> DataFrame:
    """source (null: totals), n, iterations, extra."""
    by = df.groupBy(source).agg(F.count("*").alias("n"))
    by = by.select(F.coalesce(F.col(source), F.lit("")).alias(source), "n", F.ceil(F.col("n") / batch_size).cast("long").alias("iterations"), (F.col("n") % batch_size).alias("extra"))
    return by.unionByName(by.agg(F.lit(None).cast("string").alias(source), *[F.sum(c).alias(c) for c in ("n", "iterations", "extra")]))


def norms(df: DataFrame, vec: str = "vec", name: str = "name") -> DataFrame:
    """name, n, l1, l2, mean_abs over all elements of a name's vectors."""
    one = df.select(name, F.size(vec).alias("k"), F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.abs(x)).alias("a"), F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x).alias("q"))
    return one.groupBy(name).agg(F.sum("k").alias("n"), F.sum("a").alias("l1"), F.sqrt(F.sum("q")).alias("l2"), (F.sum("a") / F.sum("k")).alias("mean_abs"))


def mean_scores(df: DataFrame, output: str = "output", value: str = "value", weight: float = 1.0) -> DataFrame:
    return df.groupBy(output).agg((F.avg(value) * F.lit(weight)).alias("mean_score"))


#: Kernels of ``gram_matrix``: what each needs of a pair of elements, summed over all rows.
KERNELS = {"linear": "product", "cosine": "product", "polynomial": "product", "sigmoid": "product", "rbf": "product", "laplacian": "distance", "chi2": "chi2", "additive_chi2": "chi2"}


def _pair_sums(df: DataFrame, vec: str, kind: str) -> DataFrame:
    """i, j, x, n: sums over n rows of the product, the absolute difference or (a - b)^2 / (a + b) of elements i and j.

    Partial matrices, a matrix row a message, not a cell; a batch is taken an element at a time, so that it holds
    rows * elements numbers.  Rows without a vector are left out.
    """
    import numpy as np
    import pandas as pd

    def add(x: np.ndarray) -> np.ndarray:
        if kind == "product":
            return x.T @ x
        if kind == "chi2" and (x < 0).any():
            raise ValueError("chi-squared kernels are for values of 0 or more")
        out = np.zeros((x.shape[1], x.shape[1]))
        for i in range(x.shape[1]):
            one, rest = x[:, i : i + 1], x[:, i:]
            gap = np.abs(one - rest)
            if kind == "chi2":
                both = one + rest
                gap = np.divide(gap * gap, both, out=np.zeros_like(gap), where=both > 0)
            out[i, i:] = out[i:, i] = gap.sum(0)
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                made = add(x)
                total, n = made if total is None else total + made, n + len(x)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype="int32"), "row": list(total), "n": n})

    parts = df.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v")).mapInPandas(partial, "i int, row array<double>, n long")
    return parts.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def gram_matrix(df: DataFrame, vec: str = "vec", kernel: str = "linear", gamma: float | None = None, degree: int = 3, coef0: float = 1.0) -> DataFrame:
    """i, row: the kernel of each two elements of the vectors, each element being the vector of its values over all rows.

    linear x.y, cosine x.y / |x||y|, polynomial (gamma x.y + coef0)^degree, sigmoid tanh(gamma x.y + coef0), rbf
    exp(-gamma |x - y|^2), laplacian exp(-gamma |x - y|_1), additive_chi2 -sum (x - y)^2 / (x + y) (0 where both are 0),
    chi2 exp(gamma times that).  Without ``gamma`` it is 10 over the number of rows, and 1 for chi2.
    """
    if kernel not in KERNELS:
        raise ValueError(f"no kernel named {kernel}")
    cells = _pair_sums(df, vec, KERNELS[kernel])
    x, g = F.col("x"), F.lit(float(gamma)) if gamma is not None else F.lit(1.0) if kernel == "chi2" else F.lit(10.0) / F.col("n")
    if kernel in ("cosine", "rbf"):  # as many numbers as a vector has
        own = cells.where("i = j")
        cells = cells.join(F.broadcast(own.select("i", F.col("x").alias("xi"))), "i").join(F.broadcast(own.select("j", F.col("x").alias("xj"))), "j")
    size = F.sqrt(F.col("xi") * F.col("xj"))
    far = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.greatest(F.col("xi") + F.col("xj") - 2 * x, F.lit(0.0)))
    value = {
        "linear": lambda: x, "cosine": lambda: F.when(size > 0, x / size).otherwise(0.0), "polynomial": lambda: F.pow(g * x + F.lit(coef0), F.lit(float(degree))),
        "sigmoid": lambda: F.tanh(g * x + F.lit(coef0)), "rbf": lambda: F.exp(-g * far), "laplacian": lambda: F.exp(-g * x), "chi2": lambda: F.exp(-g * x), "additive_chi2": lambda: -x,
    }[kernel]()
    made = cells.select("i", "j", value.alias("x"))
    return made.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("row"))


def refit(df: DataFrame, features: str = "vec", target: str = "target", keep: list[int] | None = None) -> list[float]:
    """Least-squares weights and, last, the intercept; features at ``keep`` only.  The driver solves the normal equations."""
    import numpy as np

    x = F.col(features) if keep is None else F.array(*[F.element_at(features, k + 1) for k in keep])
    joint = df.select(F.concat(x, F.array(F.lit(1.0), F.col(target).cast("double"))).alias("vec"))
    rows = {r["i"]: r["row"] for r in gram_matrix(joint).collect()}
    g = np.array([rows[i] for i in range(len(rows))])
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0].tolist()
