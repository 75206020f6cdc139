"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import argmax
from ..operators import compare as K
from ..operators import metrics as M
from .base import CELLS, PREDS, VECTORS, cells, preds, query, r6, rounded, sql6, table, vectors

_RANK = "1 + len(list_filter(x, lambda z, i: z > x[label + 1] OR (z = x[label + 1] AND i > label + 1)))"
_PRED = "list_position({0}, list_max({0})) - 1"


@query(f"WITH {VECTORS} SELECT count(*) AS n, {sql6('avg(CASE WHEN ' + _RANK + ' <= 5 THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM s WHERE label <> 3")
def a9_topk_accuracy(spark, d):
    return rounded(M.topk_accuracy(vectors(spark, d), 5, ignore=3), ["n"], ["accuracy"])


@query(f"WITH {VECTORS} SELECT k.label, count(s.id) AS n, {sql6('coalesce(avg(CASE WHEN ' + _RANK + ' <= 2 THEN 1.0 ELSE 0.0 END) FILTER (s.id IS NOT NULL), 0)')} AS accuracy FROM (SELECT unnest(range(0, 12)) AS label) k LEFT JOIN s ON s.label = k.label GROUP BY 1".replace("x[label + 1]", "x[s.label + 1]").replace("i > label + 1", "i > s.label + 1"))
def a9_topk_accuracy_by_class(spark, d):
    made = M.topk_accuracy_by_class(vectors(spark, d).withColumn("label", F.col("label").cast("int")), 12, 2)
    return made.select(F.col("label").cast("long").alias("label"), "n", r6("accuracy").alias("accuracy"))


@query(f"WITH {VECTORS}, q AS (SELECT label AS actual, {_PRED.format('x')} AS predicted, count(*) AS n FROM s GROUP BY ALL) SELECT actual, CAST(predicted AS BIGINT) AS predicted, n, {sql6('n / sum(n) OVER (PARTITION BY actual)')} AS share FROM q")
def a10_confusion_matrix(spark, d):
    rows = vectors(spark, d).withColumn("pred", argmax("x").cast("long"))
    return rounded(M.confusion_matrix(rows, normalize=True), ["actual", "predicted", "n"], ["share"])


@query(f"SELECT {sql6('round(l_quantity / 5.0) * 5.0')} AS actual, {sql6('round(l_tax / 0.02) * 0.02')} AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a11_discretized_confusion(spark, d):
    rows = table(spark, d, "lineitem").select(r6(M.discretize("l_quantity", 5.0)).alias("label"), r6(M.discretize("l_tax", 0.02)).alias("pred"))
    return M.confusion_matrix(rows)


@query(
    f"WITH {VECTORS}, q AS (SELECT x[1] >= 0.25 AS p, label >= 5 AS t FROM s WHERE label <> 9), n AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM q)"
    f" SELECT tp, fp, fn, tn, {sql6('tp / (tp + fp)')} AS precision, {sql6('tp / (tp + fn)')} AS recall, {sql6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {sql6('tn / (fp + tn)')} AS tnr, {sql6('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))')} AS f FROM n"
)
def a12_binary_metrics(spark, d):
    rows = vectors(spark, d).where("label <> 9").select(F.element_at("x", 1).alias("score"), (F.col("label") >= 5).cast("int").alias("label"))
    return rounded(M.binary_metrics(rows, thresh=0.25), ["tp", "fp", "fn", "tn"], ["precision", "recall", "accuracy", "tnr", "f"])


_FCELLS = (
    CELLS + ", f0 AS (SELECT id, 1 / (1 + exp(-v)) AS x, CAST((label + pos) % 2 AS DOUBLE) AS t, 1 + pos / 64 AS wr, 1.0::DOUBLE AS wp FROM c), f1 AS (SELECT id, t, wr, wp, CASE WHEN t > 0.5 AND x >= 0.7 THEN t WHEN t <= 0.5 AND x <= 0.3 THEN t ELSE x END AS x FROM f0)"
    ", g AS (SELECT {by} sum(x * t * wr) / sum(t * wr) AS r, sum(x * t * wp) / sum(x * wp) AS p FROM f1 {group})"
)


def _fcells(spark, d):
    c = cells(spark, d)
    return c.select(F.col("id").alias("item"), (1 / (1 + F.exp(-F.col("v")))).alias("x"), ((F.col("label") + F.col("pos")) % 2).cast("double").alias("t"), (1 + F.col("pos") / 64).alias("wr"), F.lit(1.0).alias("wp"))


@query(f"WITH {_FCELLS.format(by='', group='')} SELECT {sql6('1 - 2 * p * r / (p + r)')} AS loss FROM g")
def a13_weighted_fmeasure(spark, d):
    return M.weighted_fmeasure(_fcells(spark, d), margin=0.2).select(r6("loss").alias("loss"))


@query(f"WITH {_FCELLS.format(by='id,', group='GROUP BY id')} SELECT {sql6('avg(1 - 2 * p * r / (p + r))')} AS loss FROM g")
def a13_weighted_fmeasure_items(spark, d):
    return M.weighted_fmeasure(_fcells(spark, d), margin=0.2, per_item=True).select(r6("loss").alias("loss"))


def _views(spark, d):
    """Four rows an item: id, transform, probs, vec, label."""
    p = preds(spark, d)
    return p.select(F.floor(F.col("id") / 4).alias("id"), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("transform"), "probs", F.col("v").alias("vec"), (F.floor(F.col("id") / 4) % 10).alias("label"))


_VIEWS = PREDS + ", q AS (SELECT id // 4 AS id, 't' || (id % 4) AS transform, probs, v AS vec, (id // 4) % 10 AS label FROM p)"
_LONG = _VIEWS + ", g AS (SELECT id, transform, label, i - 1 AS cls, probs[i] AS p FROM q, (SELECT unnest(range(1, 11)) AS i))"


@query(f"WITH {_LONG} SELECT id, CAST(cls AS BIGINT) AS cls, {sql6('avg(CASE WHEN cls IN (0, 1) THEN 0 ELSE p END)')} AS p, count(*) AS n FROM g GROUP BY id, cls")
def a23_average_crops(spark, d):
    made = M.average_crops(_views(spark, d), zero=[0, 1])
    return made.select("id", F.col("cls").cast("long").alias("cls"), r6("p").alias("p"), "n")


@query(f"WITH {_LONG}, m AS (SELECT id, label, cls, avg(p) AS p FROM g GROUP BY ALL) SELECT id, label, CAST(arg_max(cls, p) AS BIGINT) AS pred FROM m GROUP BY id, label")
def a24_combine_models(spark, d):
    made, _ = M.combine_models(_views(spark, d))
    return made.select("id", "label", F.col("pred").cast("long").alias("pred"))


_W = ", w AS (SELECT transform, avg(probs[label + 1]) AS weight, avg(CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1.0 ELSE 0.0 END) AS hard FROM q GROUP BY 1)"


@query(f"WITH {_VIEWS}{_W} SELECT transform, {sql6('weight')} AS weight, {sql6('hard')} AS hard FROM w")
def a25_transform_weights(spark, d):
    rows = _views(spark, d)
    return rounded(M.transform_weights(rows).join(M.transform_weights(rows, hard=True).withColumnRenamed("weight", "hard"), "transform"), ["transform"], ["weight", "hard"])


@query(f"WITH {_LONG}{_W}, m AS (SELECT id, label, cls, sum(p * weight) AS p FROM g JOIN w USING (transform) GROUP BY ALL), o AS (SELECT id, label, arg_max(cls, p) AS pred FROM m GROUP BY id, label) SELECT label, count(*) AS n, {sql6('avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM o GROUP BY label")
def a26_weighted_vote(spark, d):
    rows = _views(spark, d)
    votes = M.weighted_vote(rows, M.transform_weights(rows)).join(rows.select("id", "label").distinct(), "id")
    return rounded(M.accuracy(votes, by="label"), ["label", "n"], ["accuracy"])


_KL = "list_sum(list_transform(range(1, 11), lambda i: CASE WHEN {0}[i] > 0 THEN {0}[i] * ln({0}[i] / (({0}[i] + {1}[i]) / 2)) ELSE 0 END))"
_JSD = f"sqrt(greatest(0.5 * {_KL.format('a.probs', 'b.probs')} + 0.5 * {_KL.format('b.probs', 'a.probs')}, 0))"
_ARG = "list_position({0}, list_max({0}))"


@query(
    f"WITH {_VIEWS}, j AS (SELECT a.transform, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.vec[i] - b.vec[i], 2)))) AS l2, sqrt(list_sum(list_transform(b.vec, lambda z: z * z))) AS mag,"
    f" {_ARG.format('a.probs')} = {_ARG.format('b.probs')} AS same, {_ARG.format('a.probs')} - 1 = a.label AS hit, {_ARG.format('b.probs')} - 1 = a.label AS hit0, {_JSD} AS jsd FROM q a JOIN q b ON a.id = b.id AND b.transform = 't0')"
    f" SELECT transform, {sql6('avg(l2)')} AS avg_l2, {sql6('avg(mag)')} AS magnitude, {sql6('avg(l2) / avg(mag)')} AS norm_l2, {sql6('1 - avg(l2) / avg(mag)')} AS similarity, {sql6('avg(CAST(same AS INT))')} AS agreement,"
    f" {sql6('avg(CAST(hit AS INT))')} AS accuracy, {sql6('CASE WHEN avg(CAST(hit0 AS INT)) > 0 THEN avg(CAST(hit AS INT)) / avg(CAST(hit0 AS INT)) END')} AS norm_accuracy, {sql6('avg(jsd)')} AS jsd, {sql6('1 - avg(jsd)')} AS jss FROM j GROUP BY transform"
)
def a27_invariance_metrics(spark, d):
    made = K.invariance_metrics(_views(spark, d), "t0")
    return rounded(made, ["transform"], [c for c in made.columns if c != "transform"])


@query(
    f"WITH {_VIEWS}, j AS (SELECT sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.vec[i] - b.vec[i], 2)))) / 64 AS l2, {_ARG.format('a.probs')} = {_ARG.format('b.probs')} AS same, {_ARG.format('a.probs')} - 1 = a.label AS hit, {_JSD} AS jsd"
    f" FROM q a JOIN q b ON a.id = b.id AND b.transform = 't0' WHERE a.transform = 't1') SELECT {sql6('avg(l2)')} AS l2, {sql6('avg(l2 / 2)')} AS l2_scaled, {sql6('avg(jsd)')} AS jsd, {sql6('avg(CAST(hit AS INT))')} AS accuracy, {sql6('avg(CAST(same AS INT))')} AS agreement FROM j"
)
def a28_equivalence_metrics(spark, d):
    half = lambda c: F.transform(c, lambda x: x / 2)
    rows = K.pair_with_base(_views(spark, d), "t0").where("transform = 't1'").withColumn("scaled", half("vec")).withColumn("scaled0", half("vec0"))
    return rounded(K.equivalence_metrics(rows), [], ["l2", "l2_scaled", "jsd", "accuracy", "agreement"])


_REL = _VIEWS + ", t AS (SELECT label, transform, avg(probs[label + 1]) AS value FROM q GROUP BY ALL)"


@query(f"WITH {_REL} SELECT a.label, {sql6('CASE WHEN a.value < 1.02 THEN ((1 - a.value) - (1 - b.value)) / (1 - a.value + 0.02) ELSE 0 END')} AS reduction FROM t a JOIN t b ON a.label = b.label AND a.transform = 't0' AND b.transform = 't1'")
def a29_error_reduction(spark, d):
    t = _views(spark, d).groupBy("label", "transform").agg(F.avg(F.element_at("probs", (F.col("label") + 1).cast("int"))).alias("value"))
    a, b = t.where("transform = 't0'").select("label", F.col("value").alias("x1")), t.where("transform = 't1'").select("label", F.col("value").alias("x2"))
    return a.join(b, "label").select("label", r6(M.error_reduction(F.col("x1"), F.col("x2"))).alias("reduction"))


@query(
    f"WITH {_VIEWS}, t AS (SELECT transform, label, CASE WHEN label < 5 THEN 'equivariance' ELSE 'invariance' END AS kind, avg(probs[1]) AS value FROM q GROUP BY ALL), u AS (SELECT transform, label % 5 AS model, 'p0' AS metric, kind, value FROM t)"
    f" SELECT transform, model, metric, {sql6('coalesce(max(value) FILTER (kind = $$equivariance$$), max(value) FILTER (kind = $$invariance$$))')} AS value FROM u GROUP BY ALL"
)
def a30_metric_series(spark, d):
    kind = F.when(F.col("label") < 5, "equivariance").otherwise("invariance")
    t = _views(spark, d).groupBy("transform", "label").agg(F.avg(F.element_at("probs", 1)).alias("value"))
    rows = t.select("transform", (F.col("label") % 5).alias("model"), F.lit("p0").alias("metric"), kind.alias("kind"), "value")
    return rounded(M.metric_series(rows, ["transform", "model"]), ["transform", "model", "metric"], ["value"])


_PIX = CELLS + ", x AS (SELECT id AS image, CASE WHEN v > 0 THEN 255 ELSE 0 END AS pred, CASE WHEN (label + pos) % 3 = 0 THEN 0 ELSE 255 END AS gt, 1 + pos / 64 AS rw, 1.0::DOUBLE AS pw FROM c)"


def _pixels(spark, d):
    c = cells(spark, d)
    return c.select(F.col("id").alias("image"), F.when(F.col("v") > 0, 255).otherwise(0).alias("pred"), F.when((F.col("label") + F.col("pos")) % 3 == 0, 0).otherwise(255).alias("gt"), (1 + F.col("pos") / 64).alias("r_weight"), F.lit(1.0).alias("p_weight"))


@query(
    f"WITH {_PIX}, g AS (SELECT image, count(*) AS n, count(*) FILTER (pred <> gt) AS wrong, max(gt) AS top, avg(pow(pred - gt, 2)) AS mse, count(*) FILTER (pred = 0 AND gt = 0) AS tp, count(*) FILTER (pred = 0) AS pp, count(*) FILTER (gt = 0) AS gp,"
    f" coalesce(sum(rw) FILTER (pred = 0 AND gt = 0), 0) AS rn, sum(rw) FILTER (gt = 0) AS rd, coalesce(sum(pw) FILTER (pred = 0 AND gt = 0), 0) AS pn, sum(pw) FILTER (pred = 0) AS pd FROM x GROUP BY image),"
    f" h AS (SELECT *, tp / pp AS p, tp / gp AS r, pn / pd AS wp, rn / rd AS wr FROM g)"
    f" SELECT image, {sql6('100 * (1 - wrong / n)')} AS accuracy, {sql6('CASE WHEN mse > 0 THEN 10 * log10(top * top / mse) END')} AS psnr, {sql6('coalesce(p, 0)')} AS precision, {sql6('coalesce(r, 0)')} AS recall, {sql6('coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0)')} AS f, {sql6('coalesce(CASE WHEN wp + wr > 0 THEN 2 * wp * wr / (wp + wr) END, 0)')} AS pseudo_f FROM h"
)
def a35_binarization_metrics(spark, d):
    made = M.binarization_metrics(_pixels(spark, d))
    return rounded(made, ["image"], [c for c in made.columns if c != "image"])


_DRD = (
    VECTORS + ", px AS (SELECT id, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, CASE WHEN v[i] > 0 THEN 1 ELSE 0 END AS p, CASE WHEN (label + i - 1) % 3 = 0 THEN 0 ELSE 1 END AS g FROM s, (SELECT unnest(range(1, 65)) AS i)),"
    " w AS (SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE 1 / sqrt(dy * dy + dx * dx) END AS w FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),"
    " wrong AS (SELECT id, y, x, p FROM px WHERE p <> g),"
    " d AS (SELECT e.id, sum(abs(q.g - e.p) * w.w) / (SELECT sum(w) FROM w) AS total FROM wrong e, w, px q WHERE q.id = e.id AND q.y = least(greatest(e.y + dy, 0), 7) AND q.x = least(greatest(e.x + dx, 0), 7) GROUP BY e.id)"
)


@query(f"WITH {_DRD} SELECT DISTINCT px.id AS image, {sql6('coalesce(d.total, 0)')} AS drd FROM px LEFT JOIN d ON d.id = px.id")
def a36_drd(spark, d):
    px = vectors(spark, d).select(F.col("id").alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("v", lambda z: F.when(z > 0, 255).otherwise(0)).alias("pred"), F.transform("v", lambda z, i: F.when((F.col("label") + i) % 3 == 0, 0).otherwise(255)).alias("gt"))
    return rounded(M.drd(px), ["image"], ["drd"])


_PC = PREDS + ", k AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS t, label AS c1, CASE WHEN id % 2 = 0 THEN (label + 3) % 10 END AS c2 FROM p), n AS (SELECT *, list_position(list_transform(probs, lambda z, i: CASE WHEN i = t + 1 THEN 0.0 ELSE z END), list_max(list_transform(probs, lambda z, i: CASE WHEN i = t + 1 THEN 0.0 ELSE z END))) - 1 AS u FROM k), o AS (SELECT id, c2, CASE WHEN c2 IS NULL THEN CASE WHEN t = c1 OR u = c1 THEN 4 ELSE -2 END WHEN (t = c1 AND u = c2) OR (t = c2 AND u = c1) THEN 4 WHEN t = c1 OR t = c2 THEN 2 WHEN u = c1 OR u = c2 THEN 1 ELSE -2 END AS points FROM n)"


def _credit(spark, d):
    rows = preds(spark, d).withColumn("cls1", F.col("label")).withColumn("cls2", F.when(F.col("id") % 2 == 0, (F.col("label") + 3) % 10))
    return M.partial_credit(rows)


@query(f"WITH {_PC} SELECT id, CAST(points AS BIGINT) AS points FROM o")
def a37_partial_credit(spark, d):
    return _credit(spark, d).select("id", F.col("points").cast("long").alias("points"))


@query(f"WITH {_PC} SELECT {sql6('avg(points)')} AS everything, {sql6('avg(points) FILTER (c2 IS NULL)')} AS single, {sql6('avg(points) FILTER (c2 IS NOT NULL)')} AS double FROM o")
def a37_partial_credit_summary(spark, d):
    return rounded(M.partial_credit_summary(_credit(spark, d)).withColumnRenamed("all", "everything"), [], ["everything", "single", "double"])


_HIST = PREDS + ", h AS (SELECT least(floor(probs[1] * 100), 99) AS bin, 1 + label * 0.5 AS w, label FROM p), g AS (SELECT 'all' AS part, * FROM h UNION ALL SELECT CASE WHEN label <> 0 THEN 'foreground' ELSE 'background' END, * FROM h)"


@query(f"WITH {_HIST} SELECT part, CAST(bin AS BIGINT) AS bin, {sql6('sum(w)')} AS n FROM g GROUP BY 1, 2")
def a43_prob_histogram(spark, d):
    rows = preds(spark, d).select(F.element_at("probs", 1).alias("p"), "label", (1 + F.col("label") * 0.5).alias("w"))
    return M.prob_histogram(rows, weight="w").select("part", F.col("bin").cast("long").alias("bin"), r6("n").alias("n"))


@query(f"WITH {CELLS}, x AS (SELECT v > 0 AS a, (label + pos) % 3 <> 0 AS b FROM c) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (NOT a AND NOT b) AS none FROM x")
def a48_binary_agreement(spark, d):
    c = cells(spark, d)
    a = c.select("id", "h", "w", (F.col("v") > 0).cast("int").alias("v"))
    b = c.select("id", "h", "w", ((F.col("label") + F.col("pos")) % 3).alias("v"))
    return M.binary_agreement(a, b, ["id", "h", "w"])
