"""Queries of the dataset profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .base import CELLS, PREDS, VECTORS, preds, query, r6, rounded, sql6, table, vectors


@query(f"WITH {CELLS} SELECT pos, {sql6('avg(v)')} AS mean FROM c GROUP BY pos")
def a1_mean_vector(spark, d):
    return S.mean_vector(vectors(spark, d), "v").select(F.col("pos").cast("long").alias("pos"), r6("mean").alias("mean"))


@query(f"WITH {CELLS} SELECT pos // 16 AS channel, {sql6('avg(v)')} AS mean FROM c GROUP BY 1")
def a1_channel_means(spark, d):
    return S.channel_means(vectors(spark, d), 4, "v").select(F.col("channel").cast("long").alias("channel"), r6("mean").alias("mean"))


_FIELDS = "u AS (SELECT source, 'lang' AS field, lang AS value FROM documents UNION ALL SELECT source, 'long' AS field, CASE WHEN n_chars > 1000 THEN 'Y' ELSE 'N' END FROM documents)"
_COUNTS = _FIELDS + ", k AS (SELECT field, value, coalesce(source, '') AS source, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT field, value, NULL, count(*) FROM u WHERE value IS NOT NULL GROUP BY ALL)"
_SHARES = _COUNTS + ", h AS (SELECT *, n / sum(n) OVER (PARTITION BY field, source) AS p FROM k)"


def _counts(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", F.when(F.col("n_chars") > 1000, "Y").otherwise("N").alias("long"))
    return S.field_counts(docs, ["lang", "long"])


@query(f"WITH {_COUNTS} SELECT field, value, source, n FROM k")
def a2_field_counts(spark, d):
    return _counts(spark, d).select("field", "value", "source", "n")


@query(f"WITH {_SHARES} SELECT field, source, {sql6('sum(-p * log2(p))')} AS entropy FROM h GROUP BY ALL")
def a3_entropy(spark, d):
    return rounded(S.entropy(_counts(spark, d)), ["field", "source"], ["entropy"])


@query(
    f"WITH {_SHARES}, g AS (SELECT n.field, n.source, a.value, a.p AS q FROM (SELECT DISTINCT field, source FROM h WHERE source IS NOT NULL) n JOIN h a ON a.field = n.field AND a.source IS NULL)"
    f" SELECT g.field, g.source, {sql6('sum(coalesce(h.p, 1e-4) * ln(coalesce(h.p, 1e-4) / g.q))')} AS kl FROM g LEFT JOIN h ON h.field = g.field AND h.source = g.source AND h.value = g.value GROUP BY ALL"
)
def a4_kl_divergence(spark, d):
    return rounded(S.kl_divergence(_counts(spark, d)), ["field", "source"], ["kl"])


@query(
    f"WITH u AS (SELECT source, 'quantity' AS field, l_quantity AS x FROM (SELECT l_returnflag AS source, * FROM lineitem) UNION ALL SELECT source, 'price', l_extendedprice FROM (SELECT l_returnflag AS source, * FROM lineitem))"
    f" SELECT field, source, count(x) AS n, {sql6('avg(CAST(x AS DOUBLE))')} AS mean, round(stddev_pop(CAST(x AS DOUBLE)), 4) AS std FROM u GROUP BY field, source"
    f" UNION ALL SELECT field, NULL, count(x), {sql6('avg(CAST(x AS DOUBLE))')}, round(stddev_pop(CAST(x AS DOUBLE)), 4) FROM u GROUP BY field"
)
def a5_field_moments(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    made = S.field_moments(rows, ["quantity", "price"])
    return made.select("field", "source", "n", r6("mean").alias("mean"), F.round("std", 4).alias("std"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a6_label_counts(spark, d):
    return S.label_counts(table(spark, d, "documents"), "lang")


@query("SELECT coalesce(max(CASE WHEN source <> '' THEN n_chars END), -1) AS highest FROM documents")
def a7_max_where_present(spark, d):
    return S.max_where_present(table(spark, d, "documents"), "source", "n_chars")


@query(
    "WITH b AS (SELECT coalesce(source, '') AS source, count(*) AS n, CAST(ceil(count(*) / 32.0) AS BIGINT) AS iterations, count(*) % 32 AS extra FROM documents GROUP BY 1)"
    " SELECT * FROM b UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(iterations) AS BIGINT), CAST(sum(extra) AS BIGINT) FROM b"
)
def a8_batch_plan(spark, d):
    return S.batch_plan(table(spark, d, "documents"), 32)


_STATS = CELLS + ", m AS (SELECT pos, avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS second FROM c GROUP BY pos)"


@query(f"WITH {_STATS} SELECT id, pos, {sql6('v - mean')} AS centered, {sql6('(v - mean) / CASE WHEN std <> 0 THEN std END')} AS standard FROM c JOIN m USING (pos)")
def a31_standardize(spark, d):
    made = S.standardize(vectors(spark, d), "v")
    return rounded(made.withColumn("pos", F.col("pos").cast("long")), ["id", "pos"], ["centered", "standard"])


@query(f"WITH {_STATS} SELECT id, pos, {sql6('v / CASE WHEN second = 0 THEN 1 ELSE second END')} AS scaled FROM c JOIN m USING (pos)")
def a32_second_moment_scale(spark, d):
    made = S.second_moment_scale(vectors(spark, d), "v")
    return rounded(made.withColumn("pos", F.col("pos").cast("long")), ["id", "pos"], ["scaled"])


@query(f"WITH {_STATS} SELECT id, pos, {sql6('(v - mean) / sqrt(std * std + 1e-5) * 1.5 - 0.25')} AS y FROM c JOIN m USING (pos)")
def f8_batch_norm(spark, d):
    made = S.batch_norm(vectors(spark, d), "v", scale=1.5, shift=-0.25)
    return rounded(made.withColumn("pos", F.col("pos").cast("long")), ["id", "pos"], ["y"])


@query(f"WITH {CELLS} SELECT label AS name, count(*) AS n, {sql6('sum(abs(v))')} AS l1, {sql6('sqrt(sum(v * v))')} AS l2, {sql6('avg(abs(v))')} AS mean_abs FROM c GROUP BY label")
def a33_norms(spark, d):
    return rounded(S.norms(vectors(spark, d), "v", "label").withColumnRenamed("label", "name").withColumn("n", F.col("n").cast("long")), ["name", "n"], ["l1", "l2", "mean_abs"])


@query(f"SELECT event_type AS output, {sql6('avg(value) * 0.5')} AS mean_score FROM events GROUP BY 1")
def a34_mean_scores(spark, d):
    return rounded(S.mean_scores(table(spark, d, "events").withColumnRenamed("event_type", "output"), weight=0.5), ["output"], ["mean_score"])


@query(f"WITH {CELLS} SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 5) + 0.0 AS x FROM c a JOIN c b USING (id) GROUP BY 1, 2")
def a40_gram_matrix(spark, d):
    made = S.gram_matrix(vectors(spark, d), "v").select(F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "x"))
    return made.select("i", F.col("j").cast("long").alias("j"), (F.round("x", 5) + 0.0).alias("x"))


#: Sums over all rows of each two class probabilities i and j.
_PAIRS = PREDS + ", y AS (SELECT id, CAST(k - 1 AS BIGINT) AS pos, probs[k] AS v FROM p, (SELECT unnest(range(1, 11)) AS k)), w AS (SELECT a.pos AS i, b.pos AS j, count(*) AS n, sum(a.v * b.v) AS xy, sum(pow(a.v - b.v, 2)) AS sq, sum(abs(a.v - b.v)) AS l1, sum(pow(a.v - b.v, 2) / (a.v + b.v)) AS chi FROM y a JOIN y b USING (id) GROUP BY 1, 2)"


@query(
    f"WITH {_PAIRS} SELECT 'polynomial' AS kernel, i, j, {sql6('pow(10 * xy / n + 1, 3)')} AS x FROM w UNION ALL SELECT 'sigmoid', i, j, {sql6('tanh(10 * xy / n + 1)')} FROM w UNION ALL SELECT 'rbf', i, j, {sql6('exp(-10 * sq / n)')} FROM w"
    f" UNION ALL SELECT 'laplacian', i, j, {sql6('exp(-10 * l1 / n)')} FROM w UNION ALL SELECT 'chi2', i, j, {sql6('exp(-0.01 * chi)')} FROM w UNION ALL SELECT 'additive_chi2', i, j, {sql6('-chi')} FROM w"
    f" UNION ALL SELECT 'cosine', w.i, w.j, {sql6('w.xy / sqrt(a.xy * b.xy)')} FROM w JOIN w a ON a.i = a.j AND a.i = w.i JOIN w b ON b.i = b.j AND b.i = w.j"
)
def a40_gram_kernels(spark, d):
    rows, made = preds(spark, d), None
    for kernel, gamma in (("polynomial", None), ("sigmoid", None), ("rbf", None), ("laplacian", None), ("chi2", 0.01), ("additive_chi2", None), ("cosine", None)):
        one = S.gram_matrix(rows, "probs", kernel, gamma).select(F.lit(kernel).alias("kernel"), F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "x"))
        one = one.select("kernel", "i", F.col("j").cast("long").alias("j"), r6("x").alias("x"))
        made = one if made is None else made.unionByName(one)
    return made


@query(f"WITH {VECTORS} SELECT 0::BIGINT AS pos, {sql6('regr_slope(v[2], v[1])')} AS weight FROM s UNION ALL SELECT 1, {sql6('regr_intercept(v[2], v[1])')} FROM s")
def a41_refit(spark, d):
    rows = vectors(spark, d).select("v", F.element_at("v", 2).alias("target"))
    w = S.refit(rows, "v", "target", [0])
    return spark.createDataFrame([(i, round(float(x), 6) + 0.0) for i, x in enumerate(w)], "pos long, weight double")
