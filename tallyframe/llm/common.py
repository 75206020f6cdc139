"""Shared pieces of the training-data operators: stage tables, ranks, loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import drop_stage, stage, stage_buckets, stage_path

__all__ = ["WORD", "drop_stage", "free_names", "hash_sample", "let", "likely", "stage", "stage_buckets", "stage_path", "table", "with_likely", "with_rank"]

#: Words are maximal runs of characters outside these: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, where the value is computed once: what a lambda refers to is computed anew at each of its calls."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names`` changed so that none is a name of ``columns``, letter case aside (Spark's names ignore it)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        new, n = f"_{name}", 0
        while new.lower() in taken:
            new, n = f"_{name}_{n}", n + 1
        taken.add(new.lower())
        out.append(new)
    return out


#: Bits of the largest map that ``with_likely`` broadcasts (16 MB).
MOST_BITS = 1 << 27


def with_likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, name: str) -> DataFrame:
    """Adds ``name``: whether the hash ``key`` of a row may be among ``wanted``, by a bit map that is broadcast; an exact join has to follow.

    It keeps what the join does not need out of its shuffle.  The map has 16 bits a wanted row, ``MOST_BITS`` at most, from
    where on it lets more and more pass.  A null key never passes.
    """
    bits = 1 << 18
    while bits < min(MOST_BITS, 16 * wanted.count()):
        bits *= 2
    group, slot = (lambda c: F.shiftright(c.bitwiseAND(F.lit(bits - 1)), 15)), (lambda c: c.bitwiseAND(F.lit(32767)))
    group_, map_ = free_names(rows.columns, "group", "map")
    maps = wanted.groupBy(group(F.col(wanted_key)).alias(group_)).agg(F.bitmap_construct_agg(slot(F.col(wanted_key))).alias(map_))
    byte = F.conv(F.hex(F.substring(F.col(map_), (F.shiftright(slot(F.col(key)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), F.col(key).bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(byte) != 0
    return rows.join(F.broadcast(maps), group(F.col(key)) == F.col(group_), "left").withColumn(name, F.coalesce(held, F.lit(False))).drop(group_, map_)


def likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows that ``with_likely`` lets pass."""
    (name,) = free_names(rows.columns, "likely")
    return with_likely(rows, key, wanted, wanted_key, name).where(name).drop(name)


def with_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add the 0-based position of each row in a global order, without a single-task window.

    Range partitions are counted and the counts (one row a partition) are summed into offsets.
    ``df`` must be cheap to recompute or already staged.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mid")), "rank")
    spark = df.sparkSession
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    base = spark.createDataFrame(offsets, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_base", T.LongType())]))
    ranked = numbered.join(F.broadcast(base), "_part")
    return ranked.withColumn(name, F.col("_base") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_part", "_mid", "_base")


def hash_sample(rows: DataFrame, by: list[str], n: int, total: int | None = None) -> DataFrame:
    """The n rows of least hash of ``by`` (or fewer), found from about 1.5 n of them however many there are.

    ``total`` saves a count if it is known.  Rows of one hash are taken in any order.
    """
    total = rows.count() if total is None else total
    part = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    near = rows if total <= 2 * n else rows.where(part < int(1.5 * n / total * (1 << 30)) + 1)
    return near.orderBy(part, *by).limit(n)
