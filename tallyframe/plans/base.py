"""What the registered queries share: registration, rounding, and views of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import softmax

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals; never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def sql6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*[F.col(k) for k in keys], *[r6(v).alias(v) for v in values])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, v (64 values), x (the first 10, class scores)."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v")).withColumn("x", F.slice("v", 1, 10))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("probs", softmax("x"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, h, w, pos, v: each embedding as a grid of 8 rows and 8 columns."""
    long = vectors(spark, sf_dir).select("id", "label", F.posexplode("v").alias("pos", "v"))
    return long.select("id", "label", F.col("pos").cast("long").alias("pos"), F.floor(F.col("pos") / 8).alias("h"), (F.col("pos") % 8).cast("long").alias("w"), "v")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, label, height, width, pixels (0 to 255): each embedding as an 8 by 8 picture."""
    px = F.transform("v", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x + 3.0) * 42.5))).cast("double"))
    return vectors(spark, sf_dir).select(F.col("id").alias("key"), "label", F.lit(8).alias("height"), F.lit(8).alias("width"), px.alias("pixels"))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, iteration, loss, kind: the events of a user as a training run."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("iteration"), F.col("value").alias("loss"), F.col("event_type").alias("kind"), "ts")


#: The same views for DuckDB, to put after WITH.
VECTORS = "e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings), s AS (SELECT *, v[1:10] AS x FROM e)"
PREDS = VECTORS + ", p AS (SELECT *, list_transform(x, lambda z: exp(z - list_max(x)) / list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) AS probs FROM s)"
CELLS = VECTORS + ", c AS (SELECT id, label, CAST(i - 1 AS BIGINT) AS pos, CAST((i - 1) // 8 AS BIGINT) AS h, CAST((i - 1) % 8 AS BIGINT) AS w, v[i] AS v FROM s, (SELECT unnest(range(1, 65)) AS i))"
LOSSES = "l AS (SELECT user_id AS run, event_id AS iteration, value AS loss, event_type AS kind, ts FROM events)"
