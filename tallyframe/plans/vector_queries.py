"""Queries of the vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from .base import PREDS, VECTORS, images, preds, query, r6, sql6, vectors

LEN = "list_sum(list_transform({v}, lambda z: {f}))"


def _sum(v: str, f: str) -> str:
    return sql6(LEN.format(v=v, f=f))


@query(
    f"WITH {VECTORS} SELECT id, {_sum('v', '1 / (1 + exp(-z))')} AS sigmoid, {_sum('v', '(exp(z) - exp(-z)) / (exp(z) + exp(-z))')} AS tanh, {_sum('v', 'greatest(z, 0) + 0.1 * least(z, 0)')} AS relu,"
    f" {_sum('v', 'pow(2.0 + 0.5 * z, 2)')} AS power, {_sum('v', 'exp(0.5 * z)')} AS exp, {_sum('v', 'ln(9 + z)')} AS log, {_sum('v', 'abs(z)')} AS abs,"
    f" {_sum('v', 'CASE WHEN z > 0 THEN z + ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END')} AS bnll, {_sum('v', 'CASE WHEN z > 0.5 THEN 1.0 ELSE 0.0 END')} AS threshold FROM s"
)
def f1_vector_maps(spark, d):
    ops = {"sigmoid": {}, "tanh": {}, "relu": {"slope": 0.1}, "power": {"shift": 2, "scale": 0.5, "power": 2}, "exp": {"scale": 0.5}, "log": {"shift": 9}, "abs": {}, "bnll": {}, "threshold": {"threshold": 0.5}}
    return vectors(spark, d).select("id", *[r6(V.vsum(V.vec_map("v", op, **p))).alias(op) for op, p in ops.items()])


@query(f"WITH {VECTORS} SELECT id, {sql6('list_sum(list_transform(v, lambda z, i: greatest(z, 0) + [0.1, 0.2, 0.3, 0.4][CAST((i - 1) // 16 + 1 AS INT)] * least(z, 0)))')} AS total FROM s")
def f1_channel_slopes(spark, d):
    return vectors(spark, d).select("id", r6(V.vsum(V.vec_map("v", "prelu", slopes=[0.1, 0.2, 0.3, 0.4], per_channel=16))).alias("total"))


@query(f"WITH {PREDS} SELECT id, CAST(i - 1 AS BIGINT) AS cls, {sql6('probs[i]')} AS p FROM p, (SELECT unnest(range(1, 11)) AS i)")
def f2_softmax(spark, d):
    return preds(spark, d).select("id", F.posexplode("probs").alias("cls", "p")).select("id", F.col("cls").cast("long").alias("cls"), r6("p").alias("p"))


@query(f"WITH {VECTORS} SELECT id, CAST(i - 1 AS BIGINT) AS cls, CASE WHEN list_position(x, list_max(x)) = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot FROM s, (SELECT unnest(range(1, 11)) AS i)")
def f3_max_indicator(spark, d):
    return vectors(spark, d).select("id", F.posexplode(V.max_indicator("x")).alias("cls", "hot")).select("id", F.col("cls").cast("long").alias("cls"), "hot")


_A, _B, _C = "v[1:16]", "v[17:32]", "v[33:48]"


@query(
    f"WITH {VECTORS} SELECT id, {sql6('list_sum(list_transform(range(1, 17), lambda i: v[i] * v[i + 16] * v[i + 32]))')} AS prod,"
    f" {sql6('list_sum(list_transform(range(1, 17), lambda i: v[i] - 2.0 * v[i + 16] + 0.5 * v[i + 32]))')} AS total, {sql6('list_sum(list_transform(range(1, 17), lambda i: greatest(v[i], v[i + 16], v[i + 32])))')} AS top FROM s"
)
def f4_eltwise(spark, d):
    parts = V.slice_vec("v", [16, 32, 48])[:3]
    return vectors(spark, d).select("id", r6(V.vsum(V.eltwise(parts, "prod"))).alias("prod"), r6(V.vsum(V.eltwise(parts, "sum", [1, -2, 0.5]))).alias("total"), r6(V.vsum(V.eltwise(parts, "max"))).alias("top"))


@query(f"WITH {VECTORS} SELECT id, {sql6('2.3 * list_sum(v)')} AS sum, {_sum('v', '2.3 * abs(z)')} AS asum, {_sum('v', '2.3 * z * z')} AS sumsq, {sql6('2.3 * list_sum(v) / 64')} AS mean FROM s")
def f5_reductions(spark, d):
    return vectors(spark, d).select("id", *[r6(V.reduce_vec("v", op, 2.3)).alias(op) for op in ("sum", "asum", "sumsq", "mean")])


def _weights(i: int, j: int) -> float:
    return ((i * j) % 7 - 3) / 10.0


@query(f"WITH {VECTORS} SELECT id, CAST(j AS BIGINT) AS out, {sql6('list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * ((i * j) % 7 - 3) / 10.0)) + 0.5 * j')} AS y FROM s, (SELECT unnest(range(0, 3)) AS j)")
def f6_inner_product(spark, d):
    w = [[_weights(i, j) for i in range(64)] for j in range(3)]
    made = vectors(spark, d).select("id", F.posexplode(V.inner_product("v", w, [0.0, 0.5, 1.0])).alias("out", "y"))
    return made.select("id", F.col("out").cast("long").alias("out"), r6("y").alias("y"))


@query(
    f"WITH {VECTORS}, k AS (SELECT id, ch, v[ch * 16 + 1 : ch * 16 + 16] AS q FROM s, (SELECT unnest(range(0, 4)) AS ch)), m AS (SELECT *, list_sum(q) / 16 AS m, list_sum(list_transform(q, lambda z: z * z)) / 16 AS ms FROM k)"
    f" SELECT id, CAST(ch * 16 + i - 1 AS BIGINT) AS pos, {sql6('(q[i] - m) / (sqrt(greatest(ms - m * m, 0)) + 1e-9)')} AS y FROM m, (SELECT unnest(range(1, 17)) AS i)"
)
def f7_mvn(spark, d):
    return vectors(spark, d).select("id", F.posexplode(V.mvn("v", 4)).alias("pos", "y")).select("id", F.col("pos").cast("long").alias("pos"), r6("y").alias("y"))


@query(f"WITH {VECTORS} SELECT id, {sql6('list_sum(list_transform(v, lambda z, i: i * 0.25 * (z - [0.1, -0.2, 0.3, 0.0][CAST((i - 1) // 16 + 1 AS INT)])))')} AS weighed FROM s")
def f9_preprocess(spark, d):
    y = V.preprocess("v", [0.1, -0.2, 0.3, 0.0], 0.25, per_channel=16)
    return vectors(spark, d).select("id", r6(V.vsum(F.transform(y, lambda z, i: z * (i + 1)))).alias("weighed"))


@query(f"WITH {VECTORS} SELECT id, CAST(i - 1 AS BIGINT) AS cls, {sql6('x[i] * v[i + 10] + v[i + 20]')} AS y FROM s, (SELECT unnest(range(1, 11)) AS i)")
def f10_scale_bias(spark, d):
    y = V.scale_bias("x", F.slice("v", 11, 10), F.slice("v", 21, 10))
    return vectors(spark, d).select("id", F.posexplode(y).alias("cls", "y")).select("id", F.col("cls").cast("long").alias("cls"), r6("y").alias("y"))


@query()
def f11_binary_encode(spark, d):
    return vectors(spark, d).select("id", F.concat_ws("", F.transform(V.binary_encode("x", 96), lambda b: b.cast("string"))).alias("bits"))


@query(f"WITH {VECTORS} SELECT id, {sql6('list_sum(v)')} AS total, {sql6('list_sum(v[1:20]) - 2 * list_sum(v[21:50]) + 3 * list_sum(v[51:64])')} AS parts, CAST(74 AS BIGINT) AS joined FROM s")
def p16_p17_concat_slice(spark, d):
    a, b, c = V.slice_vec("v", [20, 50])
    whole = V.concat_vec(a, b, c)
    return vectors(spark, d).select("id", r6(V.vsum(whole)).alias("total"), r6(V.vsum(a) - 2 * V.vsum(b) + 3 * V.vsum(c)).alias("parts"), F.size(V.concat_vec(whole, "x")).cast("long").alias("joined"))


@query(f"WITH {VECTORS} SELECT id, CAST(9 AS BIGINT) AS left_over, {sql6('list_sum(list_transform(list_filter(x, lambda z, i: i - 1 <> label), lambda z, i: z * i))')} AS weighed FROM s")
def p18_remove_at(spark, d):
    y = V.remove_at("x", "label")
    return vectors(spark, d).select("id", F.size(y).cast("long").alias("left_over"), r6(V.vsum(F.transform(y, lambda z, i: z * (i + 1)))).alias("weighed"))


_TOP = "list_reverse_sort(list_transform(range(1, 11), lambda i: {'v': x[i], 'i': i - 1}))[1:%d]"


@query(f"WITH {VECTORS} SELECT id, CAST(k AS BIGINT) AS rank, CAST(t[k].i AS BIGINT) AS cls, {sql6('t[k].v')} AS value FROM (SELECT id, {_TOP % 5} AS t FROM s), (SELECT unnest(range(1, 6)) AS k)")
def t2_argmax_topk(spark, d):
    made = vectors(spark, d).select("id", F.posexplode(V.argmax_topk("x", 5, with_values=True)).alias("k", "t"))
    return made.select("id", (F.col("k") + 1).cast("long").alias("rank"), F.col("t.i").cast("long").alias("cls"), r6("t.v").alias("value"))


@query(f"WITH {VECTORS} SELECT id, {sql6('list_sum(list_transform(t, lambda z: z.v * (z.i + 1)))')} AS weighed, CAST(len(list_filter(t, lambda z: z.v <> 0)) AS BIGINT) AS kept FROM (SELECT id, {_TOP % 3} AS t FROM s)")
def t3_topk_mask(spark, d):
    y = V.topk_mask("x", 3)
    return vectors(spark, d).select("id", r6(V.vsum(F.transform(y, lambda z, i: z * (i + 1)))).alias("weighed"), F.size(F.filter(y, lambda z: z != 0)).cast("long").alias("kept"))


_OTSU = (
    "px AS (SELECT vec_id AS key, floor(greatest(0.0, least(255.0, (CAST(embedding[i] AS DOUBLE) + 3.0) * 42.5))) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),"
    " c AS (SELECT a.key, a.v AS t, count(*) AS below, sum(b.v) AS mass FROM (SELECT DISTINCT key, v FROM px) a JOIN px b ON a.key = b.key AND b.v <= a.v GROUP BY a.key, a.v),"
    " s AS (SELECT key, sum(v) AS total FROM px GROUP BY key),"
    " m AS (SELECT c.key, t, below, CASE WHEN below < 64 THEN pow(total * below - mass * 64, 2) / (below * (64 - below)) ELSE -1 END AS between_ FROM c JOIN s ON s.key = c.key),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY between_ DESC, t) AS k FROM m)"
)


@query(f"WITH {_OTSU} SELECT key, CAST(CASE WHEN between_ < 0 THEN 0 ELSE t END AS BIGINT) AS threshold, CAST(8 AS BIGINT) AS side, CASE WHEN between_ < 0 AND t > 0 THEN 0 ELSE below END AS ink FROM r WHERE k = 1")
def f23_binarize_pad(spark, d):
    from ..operators.scoring import binarize_pad

    made = binarize_pad(images(spark, d)).withColumn("ink", F.aggregate("pixels", F.lit(0), lambda s, x: s + x))
    return made.select("key", *[F.col(c).cast("long").alias(c) for c in ("threshold", "side", "ink")])
