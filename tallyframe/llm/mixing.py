"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Everything here is DataFrame expressions; the driver sees two sums a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stage, table, with_rank

#: Sources weigh 5, 2, 1, repeating, by code point.
WEIGHT_CYCLE = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED, BINS, GROUP = 1.5, 2, 17, 1 << 16, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sizes: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """Give each row of ``sizes(source, source_size)`` a weight by its rank in code-point order, null last."""
    ranked = with_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank")
    return ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int")).alias("weight"))


def water_fill(weighted: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of ``weighted(source, source_size, weight)``: ``share`` of all sizes dealt by weight, none above
    ``max_epochs`` times its size; what is clamped off is dealt again by weight, until nothing is above.

    Returns source, source_size, weight, target.  A source of size 0 gets 0.  If every source is clamped
    the rest of the share is left undealt.  Each round is one aggregation of the source table.
    """
    weighted = stage(weighted, "weights")
    cap = F.col("source_size") * float(max_epochs)
    totals = weighted.agg(F.sum("source_size").alias("n")).first()
    wanted = share * float(totals["n"] or 0)
    level, clamped = None, -1
    while True:
        # what stands above the present level is clamped; the rest shares what the clamped leave
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        got = weighted.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("cap"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if got["n"] == clamped or not got["weight"]:
            break
        level, clamped = (wanted - got["cap"]) / got["weight"], got["n"]
    free = F.lit(0.0) if level is None else F.col("weight") * F.lit(level)
    return weighted.withColumn("target", F.least(free, cap))


def _level(parts: DataFrame, order: list[str], targets: DataFrame, start: Column) -> DataFrame:
    """The part of each source in which its running size (from ``start``) passes its rest, with the size before it."""
    run = F.sum("n").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.withColumn("_run", F.coalesce(run, F.lit(0))).join(targets, F.col("source").eqNullSafe(F.col("_source")))
    return rows.withColumn("before", start + F.col("_run")).where("before <= rest and rest < before + n")


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Mix ``docs(doc_id, text, source, ...)`` to the water-filled targets.

    Returns every row of ``docs`` with these columns added: ``mix_size`` (words of the text, 0 for null),
    ``mix_source_size``, ``mix_target`` (of its source), ``mix_whole`` (whole repetitions) and ``mix_rest``
    (words of one more, partial repetition) and ``mix_taken = whole * size + rest``.

    Each source of size S and target t takes all documents ``floor(t / S)`` times.  The rest of the target
    is filled in a seeded order of its documents: those before the fill level once more, the one on the
    level for as many of its leading words as are missing.  So a source's taken words equal its target
    rounded to a word, and no document exceeds ``ceil(max_epochs)`` times its size.

    The seeded order is that of md5(seed:doc_id:text).  Its first 16 bits are the bin of a
    histogram (at most 65,536 rows a source), which finds the bin that the level is in; only the documents
    of that one bin are sorted.  Rows of one id and text are interchangeable.  Null sources are one
    source, ordered last.  Documents without words take 0; empty input gives an empty result.  Columns of docs keep
    their names, whatever they are, but for those that start with ``mix_``, which raise ValueError.
    ``weights(source, weight)`` replaces the 5, 2, 1 cycle; sources that it lacks get no words.
    """
    own = [c for c in docs.columns if c.lower().startswith("mix_")]
    if own:
        raise ValueError(f"columns {own} would be overwritten")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    # the row travels as one column, so that no name of its own meets the names used here
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", key.alias("_key"), word_count(F.col("text")).alias("mix_size"))
    bins = stage(
        sized.select("source", "mix_size", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int").alias("bin")).groupBy("source", "bin").agg(F.sum("mix_size").alias("n")), "bins"
    )
    sizes = bins.groupBy("source").agg(F.sum("n").alias("source_size"))
    if weights is None:
        weighted = cycle_weights(sizes)
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.max("weight").cast("double").alias("weight"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    filled = water_fill(weighted, share, max_epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    filled = filled.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # the fill level: the bin where the running size passes what is missing; first among groups of bins, then inside one
    targets = filled.select(F.col("source").alias("_source"), "rest")
    coarse = bins.groupBy("source", F.floor(F.col("bin") / GROUP).alias("group")).agg(F.sum("n").alias("n"))
    above = _level(coarse, ["group"], targets, F.lit(0)).select("_source", F.col("group").alias("_group"), F.col("before").alias("_above"), "rest")
    inside = bins.join(above, F.col("source").eqNullSafe(F.col("_source")) & (F.floor(F.col("bin") / GROUP) == F.col("_group")))
    at = _level(inside.select("source", "bin", "n"), ["bin"], above.select("_source", "rest", "_above"), F.col("_above"))
    at = at.select("_source", F.col("bin").alias("_level"), "before")
    plan = filled.join(at, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_src"), "source_size", "target", "whole", "rest", F.coalesce("_level", F.lit(BINS)).alias("_level"), F.coalesce("before", F.lit(0)).alias("_before")
    )
    plan = stage(plan, "mixplan")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_src")), "left")
    joined = joined.withColumn("_bin", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"))
    on = joined.where(F.col("_bin") == F.col("_level"))
    off = joined.where(F.col("_bin") != F.col("_level"))
    order = Window.partitionBy("_src").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    on = on.withColumn("_gone", F.col("_before") + F.coalesce(F.sum("mix_size").over(order), F.lit(0)))
    on = on.withColumn("mix_rest", F.greatest(F.lit(0).cast("long"), F.least(F.col("mix_size"), F.col("rest") - F.col("_gone")))).drop("_gone")
    off = off.withColumn("mix_rest", F.when(F.col("_bin") < F.col("_level"), F.col("mix_size")).otherwise(F.lit(0).cast("long")))
    # a document may not pass its own limit: the rest is at most one repetition, the whole ones at most max_epochs
    both = on.unionByName(off)
    taken = F.col("whole") * F.col("mix_size") + F.col("mix_rest")
    return both.select(
        "row.*", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), "mix_rest", taken.alias("mix_taken")
    )


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that the mix takes: each whole repetition is a row, a partial one a row with its leading
    words, joined by one space."""
    whole = F.col("mix_whole") + F.when((F.col("mix_rest") == F.col("mix_size")) & (F.col("mix_rest") > 0), 1).otherwise(0)
    partial = (F.col("mix_rest") > 0) & (F.col("mix_rest") < F.col("mix_size"))
    out = [F.col(f"`{c}`") for c in columns]
    some = mixed.where((whole > 0) & (F.col("mix_size") > 0)).select(*out, F.explode(F.sequence(F.lit(1), whole.cast("int"))).alias("mix_copy")).drop("mix_copy")
    cut = mixed.where(partial).withColumn("text", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("mix_rest").cast("int")), " "))
    return some.unionByName(cut.select(*out))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), r AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left, row_number() OVER (ORDER BY source_size / weight, source_size) AS k
  FROM w WINDOW o AS (ORDER BY source_size / weight, source_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT (1.5::DOUBLE * total - cap_before) / weight_left AS level FROM r
  WHERE weight * ((1.5::DOUBLE * total - cap_before) / weight_left) <= 2.0::DOUBLE * source_size ORDER BY k LIMIT 1
), f AS (
  SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target FROM w LEFT JOIN lv ON true
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM f
), o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, CAST(round(g.target - g.whole * g.source_size) AS BIGINT) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || coalesce(d.text, ''))
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - gone)) AS BIGINT) AS taken FROM o
"""


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all documents; see ``mix``."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
