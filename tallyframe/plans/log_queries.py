"""Queries of training logs: the events of a user are a run, and log text is made of them where text is parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import logs as G
from ..streaming.plateau import Params, plateau_monitor
from .base import LOSSES, losses, query, r6, rounded, sql6, table

_RUN = "OVER (PARTITION BY run ORDER BY iteration"


@query(f"WITH {LOSSES} SELECT run, iteration, {sql6(f'avg(loss) {_RUN} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS smoothed FROM l")
def w1_smoothed_loss(spark, d):
    return rounded(G.smoothed_loss(losses(spark, d), 5), ["run", "iteration"], ["smoothed"])


_BEST = LOSSES + f", i AS (SELECT *, min(loss) {_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, min(loss) {_RUN}) AS best FROM l), m AS (SELECT *, was IS NULL OR loss < was AS improved FROM i), k AS (SELECT *, sum(CAST(improved AS INT)) {_RUN}) AS isle FROM m)"


@query(f"WITH {_BEST} SELECT run, iteration, best, improved, row_number() OVER (PARTITION BY run, isle ORDER BY iteration) - 1 AS steps FROM k")
def w2_improvement(spark, d):
    return G.improvement(losses(spark, d)).select("run", "iteration", "best", "improved", F.col("steps").cast("long").alias("steps"))


@query(f"WITH {LOSSES}, b AS (SELECT *, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS bad FROM l), k AS (SELECT *, sum(1 - bad) {_RUN}) AS isle FROM b) SELECT run, iteration, CAST(sum(bad) OVER (PARTITION BY run, isle ORDER BY iteration) AS BIGINT) AS nonfinite FROM k")
def w3_nonfinite_runs(spark, d):
    rows = losses(spark, d).withColumn("loss", F.when(F.col("kind") == "error", float("nan")).otherwise(F.col("loss")))
    return G.nonfinite_runs(rows).select("run", "iteration", F.col("nonfinite").cast("long").alias("nonfinite"))


@query(f"WITH {LOSSES}, b AS (SELECT run, iteration, CASE WHEN kind = 'click' THEN loss END AS lr FROM l) SELECT run, iteration, last_value(lr IGNORE NULLS) {_RUN}) AS lr FROM b")
def w4_fill_forward(spark, d):
    rows = losses(spark, d).select("run", "iteration", F.when(F.col("kind") == "click", F.col("loss")).alias("lr"))
    return G.fill_forward(rows, ("lr",), "iteration")


@query(f"WITH {LOSSES}, b AS (SELECT run, iteration, CASE WHEN kind <> 'view' THEN loss END AS lr FROM l) SELECT run, iteration, CASE WHEN row_number() {_RUN}) = 1 AND lr IS NULL THEN lead(lr) {_RUN}) ELSE lr END AS lr FROM b")
def w5_fix_first_lr(spark, d):
    rows = losses(spark, d).select("run", "iteration", F.when(F.col("kind") != "view", F.col("loss")).alias("lr"))
    return G.fix_first_lr(rows)


@query(f"WITH {LOSSES} SELECT run, iteration, {sql6('(epoch_us(ts) - epoch_us(min(CASE WHEN kind = $$purchase$$ THEN ts END) OVER (PARTITION BY run))) / 1e6')} AS seconds FROM l")
def w6_elapsed_seconds(spark, d):
    rows = losses(spark, d).withColumn("value", F.when(F.col("kind") == "purchase", "Solving net").otherwise("other"))
    return rounded(G.elapsed_seconds(rows), ["run", "iteration"], ["seconds"])


@query(f"WITH {LOSSES}, r AS (SELECT *, row_number() {_RUN}) - 1 AS r, count(*) OVER (PARTITION BY run) AS n FROM l) SELECT run, iteration, loss FROM r WHERE r % CAST(pow(2, greatest(0, ceil(log2(n / 20.0)))) AS BIGINT) = 0")
def w7_downsample(spark, d):
    return G.downsample(losses(spark, d), 20).select("run", "iteration", "loss")


@query("WITH c AS (SELECT vec_id AS id, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY v DESC, id) AS r FROM c) SELECT id, pos, round(CASE WHEN r <= 25 THEN v ELSE 0 END, 6) + 0.0 AS value FROM r")
def w8_topk_per_feature(spark, d):
    from .base import vectors

    made = G.topk_per_feature(vectors(spark, d), 25, "v")
    return made.select("id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query(
    "WITH n AS (SELECT greatest(1, CAST(floor(count(*) * 0.8) AS BIGINT)) AS n FROM orders), u AS (SELECT o_orderkey AS id, 0::BIGINT AS pos, CAST(o_totalprice AS DOUBLE) AS x FROM orders UNION ALL SELECT o_orderkey, 1, o_custkey % 50 + 1 FROM orders UNION ALL SELECT o_orderkey, 2, o_custkey + 1 FROM orders),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY x DESC, id) AS r FROM u) SELECT pos, CAST(sum(id) AS DOUBLE) AS ids, CAST(sum(CASE WHEN r <= n THEN id ELSE 0 END) AS DOUBLE) AS kept_ids, CAST(sum(CASE WHEN r <= n THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN r <= n THEN CAST(x AS DECIMAL(18, 2)) ELSE 0 END) AS DOUBLE) AS total FROM r, n GROUP BY pos"
)
def w8_topk_share_of_rows(spark, d):
    """The larger four fifths of price, customer and group over all orders: many equal values, cut by their ids."""
    vec = F.array(F.col("o_totalprice").cast("double"), (F.col("o_custkey") % 50 + 1).cast("double"), (F.col("o_custkey") + 1).cast("double"))
    made = G.topk_per_feature(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), vec.alias("vec")), 0.8)
    kept = F.col("value") != 0  # no value is 0
    return made.groupBy(F.col("pos").cast("long").alias("pos")).agg(
        F.sum("id").cast("double").alias("ids"), F.sum(F.when(kept, F.col("id")).otherwise(0)).cast("double").alias("kept_ids"),
        F.sum(kept.cast("long")).alias("kept"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query(
    f"WITH {LOSSES}, a AS (SELECT run, iteration, loss, row_number() OVER (PARTITION BY run ORDER BY loss DESC, iteration DESC) AS hi, row_number() OVER (PARTITION BY run ORDER BY loss, iteration) AS lo FROM l)"
    " SELECT run, max(iteration) FILTER (hi = 1) AS top_iteration, max(loss) FILTER (hi = 1) AS top, max(iteration) FILTER (lo = 1) AS low_iteration, max(loss) FILTER (lo = 1) AS low FROM a GROUP BY run"
)
def t4_best_iteration(spark, d):
    rows = losses(spark, d).select("run", "iteration", F.col("loss").alias("value"))
    top = G.best_iteration(rows).select("run", F.col("iteration").alias("top_iteration"), F.col("value").alias("top"))
    return top.join(G.best_iteration(rows, "min").select("run", F.col("iteration").alias("low_iteration"), F.col("value").alias("low")), "run")


@query(
    f"WITH {LOSSES}, g AS (SELECT run, iteration // 100 AS it, avg(loss / 1000) FILTER (kind = 'click') AS p, avg(loss / 500) FILTER (kind = 'view') AS r FROM l GROUP BY ALL), f AS (SELECT run, it, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM g)"
    f" SELECT run, arg_max(it, {{'a': f, 'b': it}}) AS iteration, {sql6('max(f)')} AS value FROM f GROUP BY run"
)
def t4_best_f(spark, d):
    rows = losses(spark, d).where("kind in ('click', 'view')")
    rows = rows.select("run", F.floor(F.col("iteration") / 100).alias("iteration"), F.when(F.col("kind") == "click", "precision").otherwise("recall").alias("output"), F.when(F.col("kind") == "click", F.col("loss") / 1000).otherwise(F.col("loss") / 500).alias("value"))
    # runs have a window without either; those rows have F 0, as all rows of the window table do
    every = losses(spark, d).select("run", F.floor(F.col("iteration") / 100).alias("iteration")).distinct()
    mean = rows.groupBy("run", "iteration", "output").agg(F.avg("value").alias("value"))
    blank = every.withColumn("output", F.lit("none")).withColumn("value", F.lit(0.0))
    return rounded(G.best_f(mean.unionByName(blank)), ["run", "iteration"], ["value"])


@query(f"WITH {LOSSES}, b AS (SELECT run, iteration // 50 AS iteration, kind AS output, CASE WHEN iteration % 2 = 0 THEN 'train' ELSE 'test' END AS phase, avg(loss) AS value FROM l GROUP BY ALL) SELECT run, output, iteration, {sql6('max(value) FILTER (phase = $$train$$)')} AS train, {sql6('max(value) FILTER (phase = $$test$$)')} AS test FROM b GROUP BY ALL")
def j9_join_curves(spark, d):
    rows = losses(spark, d).select("run", F.floor(F.col("iteration") / 50).alias("iteration"), F.col("kind").alias("output"), F.when(F.col("iteration") % 2 == 0, "train").otherwise("test").alias("phase"), "loss")
    means = rows.groupBy("run", "iteration", "output", "phase").agg(F.avg("loss").alias("value"))
    return rounded(J.join_curves(means), ["run", "output", "iteration"], ["train", "test"])


def _lines(spark, d):
    """run, line_no, value: two log lines an event."""
    rows = losses(spark, d)
    stamp = F.date_format("ts", "MMdd HH:mm:ss.SSSSSS")
    first = F.format_string("I%s 25210 solver.cpp:204] Iteration %d, lr = %s", stamp, F.col("iteration"), (F.col("loss") / 1000).cast("string"))
    second = F.format_string("I%s 25210 solver.cpp:347]     %s net output #%d: %s = %s (* 1 = 0 loss)", stamp, F.when(F.col("iteration") % 2 == 0, "Train").otherwise("Test"), (F.col("iteration") % 3).cast("int"), F.col("kind"), F.col("loss").cast("string"))
    both = rows.select("run", F.explode(F.array(F.struct((F.col("iteration") * 2).alias("line_no"), first.alias("value")), F.struct((F.col("iteration") * 2 + 1).alias("line_no"), second.alias("value")))).alias("l"))
    return both.select("run", "l.line_no", "l.value")


@query(f"WITH {LOSSES} SELECT run, iteration * 2 + k AS line_no, epoch_us(ts) AS us FROM l, (SELECT unnest(range(0, 2)) AS k)")
def f12_log_timestamps(spark, d):
    return _lines(spark, d).select("run", "line_no", F.unix_micros(G.parse_log_ts("value", 2024)).alias("us"))


@query(
    f"WITH {LOSSES} SELECT run, iteration * 2 AS line_no, iteration, {sql6('loss / 1000')} AS lr, NULL AS phase, NULL AS output_no, NULL AS output, NULL AS metric FROM l"
    f" UNION ALL SELECT run, iteration * 2 + 1, NULL, NULL, CASE WHEN iteration % 2 = 0 THEN 'train' ELSE 'test' END, iteration % 3, kind, {sql6('loss')} FROM l"
)
def f13_log_metrics(spark, d):
    made = G.parse_log_metrics(_lines(spark, d))
    return made.select("run", "line_no", "iteration", r6("lr").alias("lr"), "phase", F.col("output_no").cast("long").alias("output_no"), "output", r6("metric").alias("metric"))


@query(f"WITH {LOSSES} SELECT run, CASE WHEN iteration % 2 = 0 THEN 'train' ELSE 'test' END AS phase, iteration, CASE WHEN kind = 'click' THEN loss END AS click, CASE WHEN kind = 'view' THEN loss END AS view FROM l")
def f13_metric_table(spark, d):
    """Parsed lines, the iteration carried forward, one row a phase and iteration; rows without an output are kept."""
    parsed = G.fill_forward(G.parse_log_metrics(_lines(spark, d)), ("iteration",))
    return G.metric_table(parsed, ["click", "view"])


def _debug(spark, d):
    rows = losses(spark, d)
    line = F.format_string("I0101 00:00:00.000000 1 net.cpp:591]     [%s] Layer %s, %s blob b%d data: %s", F.when(F.col("iteration") % 3 == 0, "Forward").when(F.col("iteration") % 3 == 1, "Backward").otherwise("Update"), F.col("kind"), F.when(F.col("iteration") % 3 == 0, "top").when(F.col("iteration") % 3 == 1, "bottom").otherwise("param"), (F.col("iteration") % 2).cast("int"), F.col("loss").cast("string"))
    return G.parse_debug_log(rows.select("run", F.col("iteration").alias("line_no"), line.alias("value")))


@query(f"WITH {LOSSES} SELECT run, iteration AS line_no, CASE iteration % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' ELSE 'update' END AS category, kind AS layer, CASE iteration % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' ELSE 'param' END AS part, 'b' || (iteration % 2) AS blob, {sql6('loss')} AS magnitude FROM l")
def f14_debug_log(spark, d):
    return _debug(spark, d).select("run", "line_no", "category", "layer", F.col("kind").alias("part"), "blob", r6("magnitude").alias("magnitude"))


@query(f"WITH {LOSSES} SELECT run, iteration // 200 AS iteration, kind AS layer, 'b' || (iteration % 2) AS blob, {sql6('avg(loss)')} AS mean FROM l WHERE iteration % 3 = 0 GROUP BY ALL")
def a47_mean_test_activations(spark, d):
    rows = _debug(spark, d).withColumn("iteration", F.floor(F.col("line_no") / 200))
    return rounded(G.mean_test_activations(rows), ["run", "iteration", "layer", "blob"], ["mean"])


@query(f"WITH {LOSSES} SELECT run, iteration AS line_no, CAST(iteration % 10 AS DOUBLE) AS actual, CAST(run % 10 AS DOUBLE) AS predicted FROM l WHERE iteration % 10 <> 7")
def f15_prediction_log(spark, d):
    rows = losses(spark, d)
    a, p = (F.col("iteration") % 10).cast("int"), (F.col("run") % 10).cast("int")
    line = F.when(F.col("iteration") % 2 == 0, F.format_string("[net] Actual: %d Predicted: %d", a, p)).otherwise(F.format_string("[net] Actual values: %d Predicted value: %d", a, p))
    return G.parse_prediction_log(rows.select("run", F.col("iteration").alias("line_no"), line.alias("value")), ignore=7)


_NEED = "iteration - since >= CASE WHEN periods = 0 THEN 500 ELSE 1000 END AND steps >= 4 AND NOT stop"
_MONITOR = (
    f"RECURSIVE {LOSSES}, o AS (SELECT run, iteration, loss, row_number() OVER (PARTITION BY run ORDER BY iteration) AS n FROM l),"
    " m AS (SELECT run, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS iteration, CAST(NULL AS DOUBLE) AS loss, CAST(NULL AS DOUBLE) AS best, CAST(0 AS BIGINT) AS steps, CAST(0 AS BIGINT) AS periods, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS nonfinite, false AS stop FROM o WHERE n = 1"
    f" UNION ALL SELECT run, n, iteration, loss, best, CASE WHEN {_NEED} THEN 0 ELSE steps END, CASE WHEN {_NEED} THEN periods + 1 ELSE periods END, CASE WHEN {_NEED} THEN iteration ELSE since END, nonfinite, stop OR ({_NEED} AND periods + 1 >= 3)"
    " FROM (SELECT o.run, o.n, o.iteration, o.loss, CASE WHEN bad OR o.loss >= m.best THEN m.best ELSE o.loss END AS best, CASE WHEN NOT bad AND (m.best IS NULL OR o.loss < m.best) THEN 0 ELSE m.steps + 1 END AS steps,"
    " m.periods, m.since, CASE WHEN bad THEN m.nonfinite + 1 ELSE 0 END AS nonfinite, m.stop"
    " FROM m JOIN (SELECT *, loss IS NULL OR NOT isfinite(loss) AS bad FROM o) o ON o.run = m.run AND o.n = m.n + 1))"
)


@query(f"WITH {_MONITOR} SELECT run, iteration, loss, best, steps, periods, {sql6('0.01 * pow(0.1::DOUBLE, periods)')} AS lr, nonfinite, stop FROM m WHERE n > 0")
def st1_plateau_monitor(spark, d):
    made = plateau_monitor(losses(spark, d).select("run", "iteration", "loss"), Params(max_steps=4, max_periods=3, min_iters=(500, 1000)))
    return made.withColumn("lr", r6("lr"))
