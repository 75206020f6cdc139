"""Readers and writers: manifests, binary records, idx pairs, window files, sidecars, predictions, logs, vector sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of whole text files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((line_no, path, label), malformed lines)."""
    lines = _numbered(spark, path).where("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+")
    made = lines.select("line_no", parts[0].alias("path"), parts[1].try_cast("int").alias("label"), F.size(parts).alias("n"), "value")
    good = (F.col("n") == 2) & F.col("label").isNotNull()
    return made.where(good).select("line_no", "path", "label"), made.where(~F.coalesce(good, F.lit(False))).select("line_no", "value")


def ingest_images(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """key, label, content of the manifest's files under ``root``; files that cannot be read are left out.

    key is the line number in 8 digits, then the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"), "content")
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    name = F.regexp_replace(F.regexp_replace("file", "^[a-z0-9]+:/+", ""), "^\\Q" + base + "\\E/", "")
    made = manifest.join(files.withColumn("path", name), "path").where(F.length("content") > 0)
    return made.select(F.format_string("%08d_%s", F.col("line_no").cast("int"), F.col("path")).alias("key"), "label", "content")


def read_fixed_records(spark: SparkSession, path: str, payload: int = 3072, label_bytes: int = 1) -> DataFrame:
    """file, idx, label, data of files of records: label byte(s), then the payload.  A cut-off last record is left out."""
    size = payload + label_bytes
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    at = F.explode(F.expr(f"filter(sequence(0, cast(length(content) / {size} as int)), i -> (i + 1) * {size} <= length(content))"))
    rows = files.select("file", "content", at.alias("idx"))
    return rows.select("file", "idx", F.conv(F.hex(F.expr(f"substring(content, idx * {size} + 1, {label_bytes})")), 16, 10).cast("int").alias("label"), F.expr(f"substring(content, idx * {size} + {label_bytes} + 1, {payload})").alias("data"))


def read_idx(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """idx, label, height, width, data of image and label files; wrong magic numbers or counts raise.

    Paths may name many files: in order of their paths, the k-th of one kind goes with the k-th of the other, and idx runs
    on over them.  A file is one row while it is cut, so large sets come in many files (Spark reads up to 2 GB as one).
    """
    word = lambda i, kind="long": F.conv(F.hex(F.expr(f"substring(content, {4 * i + 1}, 4)")), 16, 10).cast(kind)
    cut = lambda item: F.inline(F.expr(f"if(n > 0, transform(sequence(0L, n - 1), i -> named_struct('i', i, {item})), array())"))

    def load(path: str, magic: int) -> tuple[DataFrame, DataFrame]:
        files = spark.read.format("binaryFile").load(path).select("path", "content", word(0).alias("magic"), word(1).alias("n"))
        order = Window.orderBy("path")  # a row a file
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        heads = files.select("path", (F.col("magic") == magic).alias("right"), "n", F.row_number().over(order).alias("file_no"), before.alias("start"))
        return files, heads

    (im, im_heads), (la, la_heads) = load(images, 2051), load(labels, 2049)
    a, b = im_heads.alias("a"), la_heads.alias("b")
    same = F.col("a.right") & F.col("b.right") & (F.col("a.n") == F.col("b.n"))
    wrong = a.join(b, "file_no", "full").where(~F.coalesce(same, F.lit(False))).select("a.path", "b.path").first()
    if wrong:
        raise ValueError(f"not an idx pair: {wrong[0]} and {wrong[1]}")
    pix = im.withColumns({"height": word(2, "int"), "width": word(3, "int")})
    pix = pix.select("path", "height", "width", cut("'data', substring(content, cast(17 + i * height * width as int), height * width)"))
    lab = la.select("path", cut("'label', cast(conv(hex(substring(content, cast(9 + i as int), 1)), 16, 10) as int)"))
    # the pair's image file and where it starts travel with the labels, so that data move once
    pairs = b.join(a, "file_no").select(F.col("b.path").alias("path"), F.col("a.path").alias("images"), "a.start")
    lab = lab.join(pairs, "path").select(F.col("images").alias("path"), "i", (F.col("start") + F.col("i")).alias("idx"), "label")
    return pix.join(lab, ["path", "i"]).select("idx", "label", "height", "width", "data")


def parse_windows(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, windows) of ``blocks(value)``: index, path, channels, height, width, count, then the window lines."""
    lines = F.split(F.trim("value"), r"\s*\n\s*")
    b = blocks.where("trim(value) <> ''").select(lines.alias("l"))
    num = lambda i: F.col("l")[i].cast("int")
    images = b.select(num(0).alias("image_index"), F.col("l")[1].alias("path"), num(2).alias("channels"), num(3).alias("height"), num(4).alias("width"), num(5).alias("n"))
    rows = b.select(num(0).alias("image_index"), F.posexplode(F.slice("l", F.lit(7), F.greatest(num(5), F.lit(0)))).alias("window", "text"))
    p = F.split("text", r"\s+")
    return images, rows.select("image_index", "window", p[0].cast("int").alias("label"), p[1].cast("double").alias("overlap"), *[p[i + 2].cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def read_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_windows(spark.read.text(path, lineSep="# "))


def parse_sidecars(files: DataFrame, sep: str = ",") -> DataFrame:
    """path, fields (map) of ``files(path, value)``: a line of names, a line of values."""
    lines = F.split(F.trim(F.regexp_replace("value", "\r", "")), "\n")
    names, values = (F.transform(F.split(lines[i], sep), lambda x: F.trim(x)) for i in (0, 1))
    return files.where(F.size(lines) >= 2).select("path", F.map_from_entries(F.arrays_zip(names, F.slice(F.concat(values, F.array_repeat(F.lit(""), F.size(names))), F.lit(1), F.size(names)))).alias("fields"))


def read_sidecars(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return parse_sidecars(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), sep)


def parse_predictions(lines: DataFrame) -> DataFrame:
    """name, probs of lines ``name p1 p2 ...``."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.where("trim(value) <> ''").select(p[0].alias("name"), F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: x.cast("double")).alias("probs"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return parse_predictions(spark.read.text(path))


def read_gt(spark: SparkSession, path: str) -> DataFrame:
    """name, cls1, cls2 (null if there is one label) of lines ``name cls1 [cls2]``."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("name"), p[1].alias("cls1"), F.try_element_at(p, F.lit(3)).alias("cls2"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """run (file name), line_no, value."""
    return _numbered(spark, path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("run"), "line_no", "value")


def write_vector_set(df: DataFrame, path: str, names: list[str], key: str = "idx") -> None:
    """The named arrays and the row key; a name with fewer values than another raises before anything is written."""
    n = df.agg(*[F.count(c).alias(c) for c in names]).first().asDict()
    if len(set(n.values())) > 1:
        raise ValueError(f"sets differ in rows: {n}")
    df.select(key, *[F.col(c).cast("array<float>").alias(c) for c in names]).write.parquet(path)


def read_vector_set(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    if len(set(n.values())) > 1:
        raise ValueError(f"sets differ in rows: {n}")
    return df


def write_by_size(df: DataFrame, path: str, salt: int = 8, max_records: int = 100_000) -> None:
    """One folder a height and width.  A size goes to up to ``salt`` tasks, so that a common one is not one task's work."""
    spread = F.pmod(F.xxhash64(*df.columns[:1]), F.lit(salt))
    df.repartition("height", "width", spread).write.option("maxRecordsPerFile", max_records).partitionBy("height", "width").parquet(path)


def write_log_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """One folder a phase, with a header."""
    df.write.partitionBy("phase").csv(path, header=True, sep=delimiter)


def detection_table(df: DataFrame, classes: int, probs: str = "probs") -> DataFrame:
    return df.select(*[c for c in df.columns if c != probs], *[F.element_at(probs, i + 1).alias(f"class{i}") for i in range(classes)])


def write_detections(df: DataFrame, path: str, classes: int, fmt: str = "csv") -> None:
    detection_table(df, classes).write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def sample_per_class(df: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first n records of each class; each partition is thinned to n a class before the exchange."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def doc_to_record(df: DataFrame) -> DataFrame:
    """Plain labelled records of document records: the label is dbid."""
    return df.select("key", F.struct("channels", "height", "width", "data").alias("image"), F.col("dbid").alias("label")).select("key", "image.*", "label")


def record_to_doc(df: DataFrame) -> DataFrame:
    """Document records of plain ones: collection is the label; other labels are missing."""
    none: Column = F.lit(None)
    return df.select("key", "channels", "height", "width", "data", none.cast("int").alias("dbid"), F.col("label").alias("collection"), none.cast("string").alias("language"))


def write_splits(df: DataFrame, path: str) -> None:
    """``path label`` lists, one folder a split."""
    df.select("split", F.concat_ws(" ", "path", F.col("label").cast("string")).alias("line")).write.partitionBy("split").text(path)


def stats_json(df: DataFrame, key: str) -> DataFrame:
    """key, json: all other columns of a row as one document."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("json"))
