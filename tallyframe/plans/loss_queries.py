"""Queries of the losses; a row a query but for the values by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses as L
from .base import PREDS, VECTORS, preds, query, r6, sql6, vectors

_SUM = "list_sum(list_transform(range(1, 11), lambda i: {}))"


def _one(df):
    return df.select(*[r6(c).alias(c) for c in df.columns])


@query(f"WITH {PREDS} SELECT {sql6('sum(-ln(greatest(probs[label + 1], 1.1754943508222875e-38)) * (1 + label * 0.1)) / count(*)')} AS loss FROM p WHERE label <> 3")
def a14_softmax_log_loss(spark, d):
    return _one(L.softmax_log_loss(vectors(spark, d), ignore=3, weights=[1 + c * 0.1 for c in range(10)]))


@query(f"WITH {PREDS} SELECT {sql6('sum(CASE WHEN label <> 3 THEN -ln(greatest(probs[label + 1], 1.1754943508222875e-38)) END) / count(*)')} AS loss FROM p")
def a14_softmax_log_loss_all_rows(spark, d):
    return _one(L.softmax_log_loss(vectors(spark, d), ignore=3, normalize=False))


@query(f"WITH {PREDS} SELECT {sql6('avg(-ln(greatest(probs[label + 1], 1e-20)))')} AS loss FROM p")
def a15_log_loss(spark, d):
    return _one(L.log_loss(preds(spark, d)))


@query(f"WITH {PREDS} SELECT {sql6('avg(-' + _SUM.format('1.0 / (1 + abs(label - (i - 1))) * ln(greatest(probs[i], 1e-20))') + ')')} AS loss FROM p")
def a16_infogain_loss(spark, d):
    rows = vectors(spark, d).select("label").distinct()
    h = rows.select("label", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.lit(1.0) / (1 + F.abs(F.col("label") - j))).alias("row"))
    return _one(L.infogain_loss(preds(spark, d), h))


@query(f"WITH {VECTORS} SELECT {sql6('sum(' + _SUM.format('pow(v[i] - v[i + 10], 2)') + ') / count(*) / 2')} AS loss, {sql6('sum(' + _SUM.format('pow(v[i] - v[i + 10], 2)') + ') / (count(*) * 10) / 2')} AS by_element FROM s")
def a17_euclidean_loss(spark, d):
    rows = vectors(spark, d).select(F.col("x").alias("a"), F.slice("v", 11, 10).alias("b"))
    one, two = L.euclidean_loss(rows), L.euclidean_loss(rows, by_element=True).withColumnRenamed("loss", "by_element")
    return _one(one.join(F.broadcast(two)))


_MARGIN = "greatest(0, 1 + CASE WHEN i - 1 = label THEN -x[i] ELSE x[i] END)"


@query(f"WITH {VECTORS} SELECT {sql6('sum(' + _SUM.format(_MARGIN) + ') / count(*)')} AS l1, {sql6('sum(' + _SUM.format('pow(' + _MARGIN + ', 2)') + ') / count(*)')} AS l2 FROM s")
def a18_hinge_loss(spark, d):
    rows = vectors(spark, d)
    return _one(L.hinge_loss(rows).withColumnRenamed("loss", "l1").join(F.broadcast(L.hinge_loss(rows, norm="L2").withColumnRenamed("loss", "l2"))))


_T = "(CASE WHEN (i + label) % 3 = 0 THEN 1.0 ELSE 0.0 END)"
_CE = f"-(x[i] * ({_T} - CASE WHEN x[i] >= 0 THEN 1.0 ELSE 0.0 END) - ln(1 + exp(-abs(x[i])))) * (1 + {_T} * 0.5)"


def _targets(df):
    return df.withColumn("target", F.transform("x", lambda z, i: F.when((i + 1 + F.col("label")) % 3 == 0, 1.0).otherwise(0.0)))


@query(f"WITH {VECTORS} SELECT id, {sql6(_SUM.format(_CE))} AS loss FROM s")
def a19_sigmoid_ce_rows(spark, d):
    return _targets(vectors(spark, d)).select("id", r6(L.sigmoid_ce_row("x", "target", 0.5)).alias("loss"))


@query(f"WITH {VECTORS} SELECT {sql6('sum(' + _SUM.format(_CE) + ') / (count(*) * 10)')} AS loss FROM s")
def a19_sigmoid_ce(spark, d):
    return _one(L.sigmoid_ce(_targets(vectors(spark, d)), pos_mult=0.5, by_element=True))


@query(f"WITH {PREDS} SELECT id, {sql6(_SUM.format('-' + _T + ' * ln(greatest(probs[i], 1.1754943508222875e-38))'))} AS loss FROM p")
def a20_soft_ce_rows(spark, d):
    return _targets(preds(spark, d)).select("id", r6(L.soft_ce_row("probs", "target")).alias("loss"))


@query(f"WITH {PREDS} SELECT {sql6('sum(' + _SUM.format('-' + _T + ' * ln(greatest(probs[i], 1.1754943508222875e-38))') + ') / count(*)')} AS loss FROM p")
def a20_soft_ce(spark, d):
    return _one(L.soft_ce(_targets(preds(spark, d))))


_D2 = _SUM.format("pow(v[i] - v[i + 10], 2)")


@query(
    f"WITH {VECTORS}, q AS (SELECT label % 2 AS alike, {_D2} AS d2 FROM s) SELECT {sql6('sum(CASE WHEN alike <> 0 THEN d2 ELSE pow(greatest(4 - sqrt(d2), 0), 2) END) / count(*) / 2')} AS loss,"
    f" {sql6('sum(CASE WHEN alike <> 0 THEN d2 ELSE greatest(20 - d2, 0) END) / count(*) / 2')} AS legacy FROM q"
)
def a21_contrastive_loss(spark, d):
    pairs = vectors(spark, d).select(F.col("x").alias("a"), F.slice("v", 11, 10).alias("b"), (F.col("label") % 2).alias("similar"))
    return _one(L.contrastive_loss(pairs, 4.0).join(F.broadcast(L.contrastive_loss(pairs, 20.0, legacy=True).withColumnRenamed("loss", "legacy"))))


_R = "(abs(v[i] - v[i + 10]) / [1.0, 0.5][CAST((i - 1) % 2 + 1 AS INT)])"
_TUKEY = f"CASE WHEN {_R} < 2 THEN 4.0 / 6 * (1 - pow(1 - pow({_R} / 2, 2), 3)) ELSE 4.0 / 6 + ({_R} - 2) * 0.05 END"


@query(f"WITH {VECTORS} SELECT {sql6('sum(' + _SUM.format(_TUKEY) + ') / count(*)')} AS loss FROM s")
def a22_tukey_loss(spark, d):
    rows = vectors(spark, d).select("x", F.slice("v", 11, 10).alias("target"))
    return _one(L.tukey_loss(rows, c=2.0, scales=[1.0, 0.5], slope=0.05))
