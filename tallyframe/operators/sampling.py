"""Shuffles, splits, samples, pairs, batches and mixes.  All draws are functions of a key and a seed, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import stage

#: A draw is a linear congruential step of the key, which any SQL engine can repeat; fixed values.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648
#: Places that one draw reaches, and what keys are multiplied by for the second one.
DRAWN, LCG_B = 1 << 25, 69069


def draw(key: Column | str, seed: int, below: Column | int | None = None) -> Column:
    """Integer draw from a whole-number key: two congruential steps; in 0 .. below - 1 if ``below`` is given.

    Up to 2^25 places and keys of 31 bits take one draw, larger ones 53 bits of two.
    """
    k = F.col(key) if isinstance(key, str) else key
    step = lambda x: (x * F.lit(LCG_A) + F.lit(LCG_C)) % F.lit(LCG_M)
    twice = lambda x: step(F.floor(step(x % F.lit(LCG_M)) / 8))
    whole = (k + F.lit(seed)).cast("long")
    # keys beyond 2^31 bring their high part in by a draw of its own, so that draws do not repeat
    high = F.shiftright(F.abs(whole), 31)
    drawn = lambda of: F.when(high == 0, twice(of(whole))).otherwise(twice(twice(of(whole)) + twice(of(high))))
    d = drawn(lambda x: x % F.lit(LCG_M))
    if below is None:
        return d
    below = F.lit(below) if isinstance(below, int) else below
    other = drawn(lambda x: x % F.lit(LCG_M) * F.lit(LCG_B) + F.lit(1))
    wide = F.floor(other / 8) * F.lit(DRAWN) + F.floor(d / 64)
    return F.when(below <= F.lit(DRAWN), F.floor(d / 64) % below).otherwise(wide % below)


def with_index(df: DataFrame, order: list, name: str = "idx", sums: dict[str, str] | None = None) -> DataFrame:
    """0-based position in a global order, without a single-task window: range parts are numbered and written once, and the
    counts of the parts before (a row a part) are added.  Bounds are sampled, so the parts may not be computed twice.

    ``sums`` adds running sums of columns over the rows before, in the same way: new name -> column.
    """
    sums = sums or {}
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = stage(parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")), "index")
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    before = counts.select("_part", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in ("_n", *[f"_sum_{n}" for n in sums])])
    inside = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = local.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}) if sums else local
    rows = rows.join(F.broadcast(before), "_part").withColumns({name: F.col("_n_before") + F.col("_i")} | {n: F.col(n) + F.col(f"_sum_{n}_before") for n in sums})
    return rows.drop("_part", "_i", "_n_before", *[f"_sum_{n}_before" for n in sums])


def place_in(df: DataFrame, group: str, order: list, name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """0-based position (and running sums) of each row within its group: the global ones less those of the group's first row,
    so that a large group is more than one task's work."""
    rows = with_index(df, [group, *order], name, sums)
    first = rows.groupBy(F.col(group).alias("_group")).agg(*[F.min(c).alias(f"_first_{c}") for c in (name, *(sums or {}))])
    made = rows.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return made.withColumns({c: F.col(c) - F.col(f"_first_{c}") for c in (name, *(sums or {}))}).drop("_group", *[f"_first_{c}" for c in (name, *(sums or {}))])


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a seeded order of their keys (a range exchange)."""
    return df.orderBy(draw(key, seed), key)


def subset(df: DataFrame, max_label: int, n: int, key: str, seed: int = 0, label: str = "label") -> DataFrame:
    """At most n rows of labels below ``max_label``, first in the seeded order."""
    return df.where(F.col(label) < max_label).orderBy(draw(key, seed), key).limit(n)


def rand_skip(df: DataFrame, n: int, order: str, seed: int = 0) -> DataFrame:
    """Without the first 0 .. n - 1 rows (one draw from the seed)."""
    skip = ((((seed * LCG_A + LCG_C) % LCG_M) // 8 * LCG_A + LCG_C) % LCG_M) // 64 % n
    return with_index(df, [order]).where(F.col("idx") >= skip).drop("idx")


def thin(df: DataFrame, key: str, max_gap: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """A row, then again after a drawn gap of 1 .. ``max_gap`` rows: those where the running sum of gaps passes their place.

    The place is that in the whole table, or within each group of ``by``.
    """
    rows = df.withColumn("_gap", draw(key, seed, max_gap) + 1)
    rows = with_index(rows, [key], "_place", {"_at": "_gap"}) if by is None else place_in(rows, by, [key], "_place", {"_at": "_gap"})
    if by is None:
        return rows.join(rows.select(F.col("_at").alias("_pick")), F.col("_place") == F.col("_pick"), "left_semi").drop("_place", "_gap", "_at")
    picks = rows.select(F.col(by).alias("_by"), F.col("_at").alias("_pick"))
    return rows.join(picks, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_place") == F.col("_pick")), "left_semi").drop("_place", "_gap", "_at")


def split(df: DataFrame, key: str, frac: float, seed: int = 0) -> DataFrame:
    """Adds split: test for about ``frac`` of the keys, else train."""
    return df.withColumn("split", F.when(draw(key, seed, 1000) < int(frac * 1000), "test").otherwise("train"))


def make_pairs(df: DataFrame, n: int, key: str, label: str = "label", vec: str | None = None, seed: int = 0) -> DataFrame:
    """pair, a, b, similar (and both vectors): for each pair two drawn rows, which may be the same."""
    rows = with_index(df.select(key, label, *([vec] if vec else [])), [key])
    size = rows.agg(F.count("*").alias("size"))
    pairs = df.sparkSession.range(n).withColumnRenamed("id", "pair").join(F.broadcast(size))
    pairs = pairs.select("pair", draw(F.col("pair") * 2, seed, F.col("size")).alias("i"), draw(F.col("pair") * 2 + 1, seed, F.col("size")).alias("j"))
    side = lambda s, i: rows.select(F.col("idx").alias(i), F.col(key).alias(s), F.col(label).alias(f"{s}_label"), *([F.col(vec).alias(f"{s}_{vec}")] if vec else []))
    made = pairs.join(side("a", "i"), "i").join(side("b", "j"), "j")
    out = ["pair", "a", "b", (F.col("a_label") == F.col("b_label")).cast("int").alias("similar")]
    return made.select(*out, *([f"a_{vec}", f"b_{vec}"] if vec else []))


def assign_batches(df: DataFrame, batch_size: int, order: str, source: str, epochs: int = 1, no_wrap: bool = False) -> DataFrame:
    """Adds epoch, idx (order of arrival in the source, over all epochs), batch and slot.

    A source is read ``epochs`` times.  A batch that meets the end goes on with the first rows, or with ``no_wrap`` is cut
    off there, and the next epoch starts a batch of its own.
    """
    rows = place_in(df, source, [order], "_place")
    size = rows.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("_size"))
    rows = rows.join(size, F.col(source).eqNullSafe(F.col("_s"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("idx", F.col("epoch") * F.col("_size") + F.col("_place"))
    if no_wrap:
        batch, slot = F.col("epoch") * F.ceil(F.col("_size") / batch_size) + F.floor(F.col("_place") / batch_size), F.col("_place") % batch_size
    else:
        batch, slot = F.floor(F.col("idx") / batch_size), F.col("idx") % batch_size
    return rows.withColumn("batch", batch.cast("int")).withColumn("slot", slot).drop("_s", "_size", "_place")


def mix_sources(df: DataFrame, weights: DataFrame | None, n_batches: int, batch_size: int, order: str, source: str = "source", seed: int = 0) -> DataFrame:
    """mix_batch, slot and the row: each drawn batch is of one source, by weight (or by size), and sources wrap around.

    The sources' shares lie one after the other between 0 and 1.  That line is cut into as many cells as there are sources, so
    that a draw meets the few shares of its cell by an equal join, however many sources there are.
    """
    rows = place_in(df, source, [order], "idx")
    sizes = rows.groupBy(source).agg(F.count("*").alias("size"))
    w = sizes.withColumn("weight", F.col("size").cast("double")) if weights is None else sizes.join(weights, source)
    w = with_index(w, [source], "_no", {"_run": "weight"})
    totals = w.agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    cell = lambda x: F.least(F.floor(x * F.col("n")), F.col("n") - 1)
    table = w.join(F.broadcast(totals)).select(F.col(source).alias("_s"), "size", "n", F.when(F.col("_no") == F.col("n") - 1, 1.0).otherwise((F.col("_run") + F.col("weight")) / F.col("total")).alias("hi"), (F.col("_run") / F.col("total")).alias("lo"))
    table = table.select("_s", "size", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    draws = df.sparkSession.range(n_batches).select(F.col("id").alias("mix_batch"), (draw("id", seed) / LCG_M).alias("u")).join(F.broadcast(totals)).select("mix_batch", "u", cell(F.col("u")).alias("cell"))
    picked = draws.join(table, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("mix_batch", "_s", "size")
    places = place_in(picked, "_s", ["mix_batch"], "nth").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))))
    places = places.withColumn("_at", (F.col("nth") * batch_size + F.col("slot")) % F.col("size"))
    return places.select("mix_batch", "slot", "_s", "_at").join(rows, (F.col(source) == F.col("_s")) & (F.col("idx") == F.col("_at"))).drop("_s", "_at", "idx")


def sample_quota(df: DataFrame, n_batches: int, batch: int, frac: float, key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """batch, slot, key, label: floor(batch * frac) foreground rows (label not 0) a batch, the rest background, with replacement."""
    fg = int(batch * frac)
    parts = []
    for kind, where, lo, hi in ((1, F.col(label) != 0, 0, fg), (0, F.col(label) == 0, fg, batch)):
        rows = with_index(df.where(where).select(key, label), [key])
        size = rows.agg(F.count("*").alias("size"))
        slots = df.sparkSession.range(n_batches * (hi - lo)).select(F.floor(F.col("id") / (hi - lo)).alias("batch"), (F.col("id") % (hi - lo) + lo).alias("slot")).join(F.broadcast(size))
        drawn = slots.withColumn("_at", draw(F.col("batch") * batch + F.col("slot"), seed + kind, F.col("size")))
        parts.append(drawn.join(rows, F.col("_at") == F.col("idx")).select("batch", "slot", key, label))
    return parts[0].unionByName(parts[1])
