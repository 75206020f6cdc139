"""Training logs: parsing, carrying forward, smoothing, best iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .sampling import place_in

_NUM = r"([-+]?(?:[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|inf|nan))"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(line, pattern, group).try_cast("double")


def parse_log_ts(line: Column | str, year: int) -> Column:
    """Timestamp of a line like ``I0210 13:39:22.381027``; null for others."""
    c = _c(line)
    stamp = F.concat(F.lit(f"{year}-"), F.regexp_replace(F.regexp_extract(c, r"^[IWEF](\d{4} \d{2}:\d{2}:\d{2}\.\d+)", 1), r"^(\d\d)(\d\d)", "$1-$2"))
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def parse_log_metrics(lines: DataFrame) -> DataFrame:
    """run, line_no, iteration, lr, phase, output_no, output, value of ``lines(run, line_no, value)``, nulls where a line has none."""
    c = F.col("value")
    out = r"(Train|Test) net output #(\d+): (\S+) = " + _NUM
    return lines.select(
        "run", "line_no", _num(c, r"Iteration (\d+)").cast("long").alias("iteration"), _num(c, r"lr = " + _NUM).alias("lr"),
        F.nullif(F.lower(F.regexp_extract(c, out, 1)), F.lit("")).alias("phase"), _num(c, out, 2).cast("int").alias("output_no"),
        F.nullif(F.regexp_extract(c, out, 3), F.lit("")).alias("output"), _num(c, out, 4).alias("metric"), _num(c, r", loss = " + _NUM).alias("loss"),
    )


def parse_debug_log(lines: DataFrame) -> DataFrame:
    """run, line_no, category, layer, kind, blob, magnitude of debug lines ([Forward], [Backward], [Update] and the totals)."""
    c = F.col("value")
    one = r"\[(Forward|Backward|Update)\] Layer (\S+), (top|bottom|param) blob (\S+) (?:data|diff): " + _NUM
    whole = r"All net params \(data, diff\): L1 norm = \(" + _NUM + ", " + _NUM + r"\); L2 norm = \(" + _NUM + ", " + _NUM + r"\)"
    pick = lambda p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    rows = lines.where(c.rlike(one) | c.rlike(whole))
    return rows.select(
        "run", "line_no", F.coalesce(F.lower(pick(one, 1)), F.lit("totals")).alias("category"), pick(one, 2).alias("layer"), pick(one, 3).alias("kind"), pick(one, 4).alias("blob"),
        _num(c, one, 5).alias("magnitude"), *[_num(c, whole, g).alias(n) for g, n in enumerate(("l1_data", "l1_diff", "l2_data", "l2_diff"), 1)],
    )


def parse_prediction_log(lines: DataFrame, ignore: float | None = None) -> DataFrame:
    """run, line_no, actual, predicted of lines of either format."""
    c = F.col("value")
    pattern = r"Actual(?: values)?: " + _NUM + r"\s+Predicted(?: value)?: " + _NUM
    out = lines.select("run", "line_no", _num(c, pattern, 1).alias("actual"), _num(c, pattern, 2).alias("predicted")).where("actual is not null")
    return out if ignore is None else out.where(F.col("actual") != ignore)


def _run(order: str = "line_no"):
    return Window.partitionBy("run").orderBy(order)


def fill_forward(df: DataFrame, cols: tuple[str, ...] = ("iteration", "lr"), order: str = "line_no") -> DataFrame:
    """Each column carries its last value that was not null along the run."""
    w = _run(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fix_first_lr(df: DataFrame, lr: str = "lr", order: str = "iteration") -> DataFrame:
    """The first row's missing rate is the second's."""
    w = _run(order)
    return df.withColumn(lr, F.when((F.row_number().over(w) == 1) & F.col(lr).isNull(), F.lead(lr).over(w)).otherwise(F.col(lr)))


def elapsed_seconds(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds seconds since the run's first line that says Solving."""
    start = F.min(F.when(F.col(value).contains("Solving"), F.col(ts))).over(Window.partitionBy("run"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.withColumn("seconds", (micros(F.col(ts)) - micros(start)) / 1e6)


def smoothed_loss(df: DataFrame, n: int, value: str = "loss", order: str = "iteration") -> DataFrame:
    return df.withColumn("smoothed", F.avg(value).over(_run(order).rowsBetween(-(n - 1), 0)))


def improvement(df: DataFrame, value: str = "loss", order: str = "iteration") -> DataFrame:
    """Adds best (so far), improved (strictly below all before) and steps since the last improvement."""
    w = _run(order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("improved", F.col(value).isNotNull() & (before.isNull() | (F.col(value) < before)))
    out = out.withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_i", island)
    inside = Window.partitionBy("run", "_i").orderBy(order)
    return out.withColumn("steps", F.when(F.col("_i") == 0, F.row_number().over(inside)).otherwise(F.row_number().over(inside) - 1)).drop("_i")


def nonfinite_runs(df: DataFrame, value: str = "loss", order: str = "iteration") -> DataFrame:
    """Adds nonfinite: how many losses in a row, up to this one, are not finite."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    out = df.withColumn("_bad", bad.cast("int")).withColumn("_i", F.sum(1 - F.col("_bad")).over(_run(order).rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("run", "_i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("nonfinite", F.sum("_bad").over(w)).drop("_bad", "_i")


def downsample(df: DataFrame, max_points: int = 18_000, order: str = "iteration") -> DataFrame:
    """Every second point, again and again, until a run has at most ``max_points``."""
    n = F.count("*").over(Window.partitionBy("run"))
    halvings = F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(max_points)))))
    out = df.withColumn("_r", F.row_number().over(_run(order)) - 1).withColumn("_k", F.pow(F.lit(2.0), halvings).cast("long"))
    return out.where(F.col("_r") % F.col("_k") == 0).drop("_r", "_k")


#: Rows a feature that ``topk_per_feature`` still ranks by a window; more are selected by histograms.
WINDOW_ROWS = 10_000
#: Bins of a histogram, and those of a factor of two in the first one over doubles.
BINS, OCTAVE = 65_536, 16


def kth_largest(rows: DataFrame, value: str, need: int | DataFrame, group: str = "pos") -> DataFrame:
    """group, cut, need: the value at place ``need`` of each group, and how many of the rows equal to it are among the first ``need``.

    A histogram shows the bin of that place and the range of its values, which the next one cuts finer, until the range is
    one value: no row is ranked and no task holds a group.  Bins are of equal width, and in the first pass over doubles of equal
    ratio, so that five passes reach the last digit.  Not-a-number is above all, null below.  ``need`` may be a table (group,
    need).  The groups' ranges, a row each, go through the driver.
    """
    spark, real = rows.sparkSession, not isinstance(rows.schema[value].dataType, (T.LongType, T.IntegerType))
    cells = rows.select(F.col(group).alias("g"), F.col(value).cast("double" if real else "long").alias("x"))
    schema = T.StructType([T.StructField("g", rows.schema[group].dataType), T.StructField("lo", cells.schema["x"].dataType), T.StructField("hi", cells.schema["x"].dataType), T.StructField("need", T.LongType())])
    x = F.col("x")
    from_lo = lambda c: (c - F.col("lo") if real else c.cast("decimal(20,0)") - F.col("lo")).cast("double")
    ratio = F.signum(x) * (F.log2(F.abs(x)) + 1100) * OCTAVE
    coarse = F.when(x.isNull(), -1e6).when(F.isnan(x), 1e6).when(x == 0, 0.0).otherwise(F.greatest(F.lit(-5e5), F.least(F.lit(5e5), F.floor(ratio).cast("double")))) if real else F.lit(0.0)
    fine = F.floor(from_lo(x) / from_lo(F.col("hi")) * BINS).cast("double")

    def look(part: DataFrame, bin_: Column) -> list:
        bins = part.groupBy("g", "need", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy(F.desc_nulls_last("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return bins.withColumn("above", above).where("above < need and need <= above + n").select("g", "lo", "hi", (F.col("need") - F.col("above")).cast("long").alias("need")).collect()

    table = need.select(F.col(group).alias("g"), F.col("need").cast("long").alias("need")) if isinstance(need, DataFrame) else None
    first = cells.withColumn("need", F.lit(need).cast("long")) if table is None else cells.join(F.broadcast(table), "g")
    found = look(first, coarse)  # a group with fewer rows has no such place and drops out
    done = []
    one = lambda r: r["lo"] is None or r["lo"] == r["hi"] or r["lo"] != r["lo"]
    while True:
        done += [r for r in found if one(r)]
        found = [r for r in found if not one(r)]
        if not found:
            break
        spans = F.broadcast(spark.createDataFrame([tuple(r) for r in found], schema))
        found = look(cells.join(spans, "g").where((x >= F.col("lo")) & (x <= F.col("hi"))), fine)
    return spark.createDataFrame([(r["g"], r["lo"], r["need"]) for r in done], T.StructType([schema["g"], T.StructField("cut", schema["lo"].dataType), schema["need"]])).withColumnRenamed("g", group)


def _selected(df: DataFrame, n: int, vec: str, key: str) -> DataFrame:
    """``topk_per_feature`` without ranks: the cut of each element, and where not all equal rows have a place, the cut of their keys."""
    long = df.select(key, F.posexplode(vec).alias("pos", "x"))
    cuts = kth_largest(long, "x", n)
    tied = long.join(F.broadcast(cuts), "pos").where(F.col("x").eqNullSafe(F.col("cut")))
    short = F.broadcast(tied.groupBy("pos", "need").agg(F.count("*").alias("ties")).where("ties > need").select("pos", "need"))
    some = tied.select("pos", "x", key).join(short, "pos")
    if isinstance(df.schema[key].dataType, (T.LongType, T.IntegerType)):
        # least keys first
        last = kth_largest(some.select("pos", (-F.col(key).cast("long")).alias("k")), "k", short).select("pos", (-F.col("cut")).alias("last"))
        kept = F.col("last").isNull() | (F.col(key) <= F.col("last"))
        cells = long.join(F.broadcast(cuts.join(last, "pos", "left")), "pos")
    else:
        first = place_in(some, "pos", [key], "_place").where(F.col("_place") < F.col("need")).select("pos", F.col(key).alias("_key"))
        cells = long.join(F.broadcast(cuts.join(short.select("pos", F.lit(True).alias("short")), "pos", "left")), "pos")
        tie = F.col("short") & F.col("x").eqNullSafe(F.col("cut"))
        open_ = cells.where(tie).join(first.withColumn("held", F.lit(True)), (F.col(key) == F.col("_key")) & (cells["pos"] == first["pos"]), "left").select(key, cells["pos"], "x", "cut", F.col("held").isNotNull().alias("kept"))
        cells = cells.where(~F.coalesce(tie, F.lit(False))).select(key, "pos", "x", "cut", F.lit(True).alias("kept")).unionByName(open_)
        kept = F.col("kept")
    above = F.when(F.col("cut").isNull(), F.col("x").isNotNull()).otherwise(F.coalesce(F.col("x") > F.col("cut"), F.lit(False)))
    return cells.select(key, "pos", F.when(above | (F.col("x").eqNullSafe(F.col("cut")) & kept), F.col("x")).otherwise(0.0).alias("value"))


def topk_per_feature(df: DataFrame, k: float, vec: str = "vec", key: str = "id") -> DataFrame:
    """key, pos, value: the k largest values of each element over all rows stay, the rest are 0; of equal values those of least key.

    k below 1 is a share of the rows.  Up to ``WINDOW_ROWS`` Spark thins each partition to its own k best before the
    exchange; more are selected by histograms (``kth_largest``), so that no task holds an element's rows.  Keys are distinct.
    """
    total = df.count()
    n = max(1, int(k) if k >= 1 else int(total * k))
    if n >= total:
        return df.select(key, F.posexplode(vec).alias("pos", "value"))
    if n > WINDOW_ROWS:
        return _selected(df, n, vec, key)
    long = df.select(key, F.posexplode(vec).alias("pos", "x"))
    top = long.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy(F.col("x").desc(), key))).where(F.col("r") <= n)
    # back to a row a vector before the join, so that it is not of all elements
    kept = top.groupBy(F.col(key).alias("_key")).agg(F.collect_set("pos").alias("_kept"))
    cells = df.select(key, F.col(vec).alias("_v")).join(kept, F.col(key) == F.col("_key"), "left").select(key, F.col("_kept"), F.posexplode("_v").alias("pos", "x"))
    return cells.select(key, "pos", F.when(F.array_contains("_kept", F.col("pos")), F.col("x")).otherwise(0.0).alias("value"))


def best_iteration(metrics: DataFrame, kind: str = "max", value: str = "value", order: str = "iteration") -> DataFrame:
    """run, iteration, value of the best: the latest of equal maxima, the earliest of equal minima."""
    if kind == "max":
        best = F.max(F.struct(F.col(value).alias("v"), F.col(order).alias("i")))
    else:
        best = F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("i")))
    return metrics.where(F.col(value).isNotNull()).groupBy("run").agg(best.alias("b")).select("run", F.col("b.i").alias(order), F.col("b.v").alias(value))


def best_f(metrics: DataFrame) -> DataFrame:
    """Best iteration by F of the outputs precision and recall of (run, iteration, output, value)."""
    wide = metrics.groupBy("run", "iteration").pivot("output", ["precision", "recall"]).agg(F.first("value"))
    p, r = F.col("precision"), F.col("recall")
    return best_iteration(wide.withColumn("value", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)))


def mean_test_activations(debug: DataFrame) -> DataFrame:
    """run, iteration, layer, blob, mean magnitude of the forward lines."""
    return debug.where("category = 'forward'").groupBy("run", "iteration", "layer", "blob").agg(F.avg("magnitude").alias("mean"))


def metric_table(parsed: DataFrame, outputs: list[str]) -> DataFrame:
    """run, phase, iteration and a column an output; rows with missing outputs are kept."""
    return parsed.where("output is not null").groupBy("run", "phase", "iteration").pivot("output", outputs).agg(F.first("metric"))
