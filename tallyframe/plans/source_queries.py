"""Queries of readers and writers: files are written from the tables, read back, and what was read is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs as G
from ..operators.sampling import with_index
from ..sources import files as I
from ..sources.stages import stage_path
from ..streaming.plateau import follow_logs, stream_logs
from .base import VECTORS, losses, query, r6, sql6, table, vectors


def _write_lines(lines: DataFrame, by: str, order: str, name: str) -> str:
    """A folder of text files, one file a value of ``by``, with its lines in order; returns the path."""
    path = stage_path(lines.sparkSession, name)
    lines.repartition(by).sortWithinPartitions(by, order).select(by, "line").write.partitionBy(by).text(path)
    return path


def _folder(column: str, name: str):
    """The value that a partition folder of a path names."""
    return F.regexp_extract(column, f"{name}=([^/]*)", 1)


_PLACE = "row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1"


@query(
    f"SELECT line_no, CASE WHEN doc_id % 11 <> 0 THEN 'i' || doc_id || '.png' END AS path, CASE WHEN doc_id % 11 <> 0 THEN n_chars % 10 END AS label, CASE WHEN doc_id % 11 = 0 THEN 'i' || doc_id || '.png' END AS malformed"
    f" FROM (SELECT doc_id, n_chars, {_PLACE} AS line_no FROM documents)"
)
def s1_read_manifest(spark, d):
    name = F.format_string("i%d.png", "doc_id")
    line = F.when(F.col("doc_id") % 11 == 0, name).otherwise(F.concat_ws(" ", name, (F.col("n_chars") % 10).cast("string")))
    path = _write_lines(table(spark, d, "documents").select("source", "doc_id", line.alias("line")), "source", "doc_id", "manifest")
    good, bad = I.read_manifest(spark, path)
    none = F.lit(None)
    both = good.select("line_no", "path", "label", none.cast("string").alias("malformed")).unionByName(bad.select("line_no", none.cast("string").alias("path"), none.cast("int").alias("label"), F.col("value").alias("malformed")))
    return both.select(F.col("line_no").cast("long").alias("line_no"), "path", F.col("label").cast("long").alias("label"), "malformed")


@query("SELECT printf('%08d', item_id) AS line_no, item_id % 5 AS label, md5(text || chr(10)) AS content FROM benchmark")
def s2_ingest_images(spark, d):
    """A file an item; the manifest names the files as they were written."""
    path = _write_lines(table(spark, d, "benchmark").select("item_id", F.col("text").alias("line")), "item_id", "line", "images")
    name = F.regexp_extract(F.col("_metadata.file_path"), "(item_id=.*)$", 1)
    files = spark.read.format("binaryFile").load(path).select(name.alias("path"), F.col("item_id").cast("long").alias("line_no")).withColumn("label", F.col("line_no") % 5)
    made = I.ingest_images(spark, files, path)
    return made.select(F.substring("key", 1, 8).alias("line_no"), "label", F.md5("content").alias("content"))


@query(f"SELECT source, {_PLACE} AS idx, 48 + n_chars % 10 AS label, printf('%08d', doc_id) || chr(10) AS data FROM documents")
def s3_read_fixed_records(spark, d):
    """Records of a label byte and nine bytes, a file a source."""
    line = F.concat((F.col("n_chars") % 10).cast("string"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    path = _write_lines(table(spark, d, "documents").select("source", "doc_id", line.alias("line")), "source", "doc_id", "records")
    made = I.read_fixed_records(spark, f"{path}/*/*.txt", 9)
    return made.select(_folder("file", "source").alias("source"), F.col("idx").cast("long").alias("idx"), F.col("label").cast("long").alias("label"), F.col("data").cast("string").alias("data"))


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, item_id % 10 AS label, CAST(2 AS BIGINT) AS height, CAST(2 AS BIGINT) AS width, upper(md5(text))[1:8] AS data FROM benchmark")
def s4_read_idx(spark, d):
    """Pairs of files of 64 items each: the items' first digest bytes as 2 by 2 pictures, and their labels."""
    word = lambda n: F.lpad(F.hex(n), 8, "0")
    items = table(spark, d, "benchmark").select("item_id", F.substring(F.upper(F.md5("text")), 1, 8).alias("px"), F.lpad(F.hex(F.col("item_id") % 10), 2, "0").alias("label"))
    shard = F.format_string("%010d", F.floor(F.col("place") / 64)).alias("shard")
    rows = with_index(items, ["item_id"], "place").groupBy(shard).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "px", "label"))).alias("all"))
    joined = lambda part: F.array_join(F.transform("all", lambda x: x[part]), "")
    files = {"images": F.concat(word(F.lit(2051)), word("n"), word(F.lit(2)), word(F.lit(2)), joined("px")), "labels": F.concat(word(F.lit(2049)), word("n"), joined("label"))}
    paths = {n: stage_path(spark, n) for n in files}
    for n, content in files.items():
        rows.select("shard", F.unhex(content).cast("string").alias("value")).write.partitionBy("shard").text(paths[n])
    made = I.read_idx(spark, *[f"{p}/*/*.txt" for p in paths.values()])
    return made.select(*[F.col(c).cast("long").alias(c) for c in ("idx", "label", "height", "width")], F.hex("data").alias("data"))


@query("SELECT user_id || ' ' || event_id || ' ' || event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no FROM events")
def s8_read_logs(spark, d):
    """A log file a run."""
    e = table(spark, d, "events")
    path = _write_lines(e.select("user_id", "event_id", F.concat_ws(" ", F.col("user_id").cast("string"), F.col("event_id").cast("string"), "event_type").alias("line")), "user_id", "event_id", "logs")
    return I.read_logs(spark, f"{path}/*/*.txt").where("value <> ''").select("value", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {VECTORS} SELECT id, {sql6('list_sum(list_transform(v, lambda z: CAST(CAST(z AS FLOAT) AS DOUBLE)))')} AS total, CAST(10 AS BIGINT) AS n FROM s")
def s9_vector_set(spark, d):
    path = stage_path(spark, "vectors")
    I.write_vector_set(vectors(spark, d).select("id", "v", "x"), path, ["v", "x"], "id")
    made = I.read_vector_set(spark, path)
    return made.select("id", r6(F.aggregate("v", F.lit(0.0), lambda s, z: s + z.cast("double"))).alias("total"), F.size("x").cast("long").alias("n"))


@query("SELECT p_size % 4 + 1 AS height, p_size % 3 + 1 AS width, count(*) AS n, min(p_partkey) AS first, sum(p_partkey) AS total FROM part GROUP BY 1, 2")
def s10_write_by_size(spark, d):
    path = stage_path(spark, "sizes")
    I.write_by_size(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("height"), (F.col("p_size") % 3 + 1).alias("width")), path)
    made = spark.read.parquet(path).groupBy("height", "width").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.sum("p_partkey").alias("total"))
    return made.select(*[F.col(c).cast("long").alias(c) for c in made.columns])


@query(f"SELECT event_type AS phase, user_id AS run, event_id AS iteration, {sql6('value')} AS loss FROM events")
def s11_log_csv(spark, d):
    path = stage_path(spark, "logcsv")
    I.write_log_csv(losses(spark, d).select(F.col("kind").alias("phase"), "run", "iteration", "loss"), path, ";")
    made = spark.read.option("basePath", path).csv(path, header=True, sep=";")
    return made.select("phase", F.col("run").cast("long").alias("run"), F.col("iteration").cast("long").alias("iteration"), r6(F.col("loss").cast("double")).alias("loss"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'i' || doc_id || '.png ' || n_chars % 10 AS line FROM documents")
def p12_write_splits(spark, d):
    path = stage_path(spark, "splits")
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.format_string("i%d.png", "doc_id").alias("path"), (F.col("n_chars") % 10).alias("label"))
    I.write_splits(rows, path)
    return spark.read.text(path).select("split", F.col("value").alias("line"))


@query(f"SELECT event_id AS iteration, {sql6('value / 1000')} AS lr FROM events")
def st2_stream_logs(spark, d):
    """Log files replayed as a stream until all are read, into a table."""
    line = F.format_string("I0210 13:39:22.381027 25210 solver.cpp:204] Iteration %d, lr = %s", "iteration", (F.col("loss") / 1000).cast("string"))
    logs, out, marks = stage_path(spark, "tail"), stage_path(spark, "tailed"), stage_path(spark, "tailmarks")
    losses(spark, d).select(line.alias("value")).write.text(logs)
    query_ = stream_logs(spark, logs).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(out).where("iteration is not null").select("iteration", r6("lr").alias("lr"))


_FOLLOWED = (
    "WITH l AS (SELECT CAST(user_id % 20 AS VARCHAR) AS run, event_id, event_type, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS line_no FROM events),"
    " c AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS iteration, last_value(CASE WHEN event_type = 'click' THEN value / 1000 END IGNORE NULLS) OVER w AS lr FROM l WINDOW w AS (PARTITION BY run ORDER BY event_id))"
)


def part_width(most: int) -> int:
    """Iterations of a log's part: 5,000, more so that there are no more than 64 parts, but 250,000 at most (files of a megabyte)."""
    return min(max(5000, -(-(most + 1) // 64)), 250_000)


@query(f"{_FOLLOWED} SELECT run, line_no, iteration, {sql6('lr')} AS lr, CASE WHEN event_type <> 'click' THEN 'test' END AS phase, {sql6("CASE WHEN event_type <> 'click' THEN value END")} AS metric FROM c WHERE event_id % 5 <> 0 OR event_type = 'click'")
def st2_follow_logs(spark, d):
    """Logs of twenty runs in parts, followed until all are read: iteration and rate go on from line to line."""
    say = F.when(F.col("kind") == "click", F.format_string("I0210 13:39:22.381027 25210 solver.cpp:204] Iteration %d, lr = %s", "iteration", (F.col("loss") / 1000).cast("string")))
    say = say.when(F.col("iteration") % 5 == 0, F.lit("I0210 13:39:22.381027 25210 solver.cpp:204] nothing of it")).otherwise(F.format_string("I0210 13:39:22.381027 25210 solver.cpp:204]     Test net output #0: accuracy = %s", F.col("loss").cast("string")))
    logs, out, marks = stage_path(spark, "parts"), stage_path(spark, "followed"), stage_path(spark, "followmarks")
    width = part_width(losses(spark, d).agg(F.max("iteration")).first()[0] or 0)
    lines = losses(spark, d).select((F.col("run") % 20).alias("run"), F.format_string("%08d", F.floor(F.col("iteration") / width)).alias("part"), "iteration", say.alias("value"))
    lines.repartition("run", "part").sortWithinPartitions("run", "part", "iteration").select("run", "part", "value").write.partitionBy("run", "part").text(logs)
    query_ = follow_logs(spark, logs, r"run=([^/]*)").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(out).select("run", "line_no", "iteration", r6("lr").alias("lr"), "phase", r6("metric").alias("metric"))


@query("SELECT 'r' || user_id AS run, event_id AS line_no, event_id AS iteration FROM events WHERE event_type = 'click'")
def f13_only_matching_lines(spark, d):
    """Of mixed lines, those that name an iteration."""
    text = F.when(F.col("kind") == "click", F.format_string("Iteration %d, loss = 1", "iteration")).otherwise("I0101 nothing of it")
    lines = losses(spark, d).select(F.format_string("r%d", "run").alias("run"), F.col("iteration").alias("line_no"), text.alias("value"))
    return G.parse_log_metrics(lines).where("iteration is not null").select("run", "line_no", "iteration")
