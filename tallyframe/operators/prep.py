"""Label encodings, target scaling, filters, sizes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import place_in, with_index


def select_labels(df: DataFrame, names: list[str], missing: int = -1) -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(n).cast("int"), F.lit(missing)).alias(f"{n}_label") for n in names])


def vocabulary(df: DataFrame, col: str, order_col: str, vocab: DataFrame | None = None) -> DataFrame:
    """value, code in order of first appearance; values of ``vocab`` keep their codes, new ones follow.

    The ordering is over distinct values, after a map-side minimum, by range parts.
    """
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(order_col).alias("_at"))
    if vocab is None:
        return with_index(first, ["_at", "value"], "code").select("value", F.col("code").cast("int").alias("code"))
    start = vocab.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("start"))
    new = with_index(first.join(vocab, "value", "left_anti"), ["_at", "value"], "i")
    return vocab.select("value", "code").unionByName(new.join(F.broadcast(start)).select("value", (F.col("i") + F.col("start")).cast("int").alias("code")))


def encode_first_seen(df: DataFrame, col: str, order_col: str, vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``col``_code, the vocabulary to keep); nulls stay null.  Spark broadcasts the vocabulary while it is small."""
    table = vocabulary(df, col, order_col, vocab)
    codes = table.select(F.col("value").alias("_v"), F.col("code").alias(f"{col}_code"))
    return df.join(codes, F.col(col) == F.col("_v"), "left").drop("_v"), table


def scale_target(col: Column | str, scale: float, shift: float) -> Column:
    """v * scale + shift; null where the text is no number."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double") * F.lit(float(scale)) + F.lit(float(shift))


def substitute(df: DataFrame, col: str, mapping: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``col``_value, reject rows whose value is in no pair)."""
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, float(v))])
    out = df.withColumn(f"{col}_value", table[F.col(col)])
    bad = F.col(col).isNotNull() & F.col(f"{col}_value").isNull()
    return out.where(~bad | F.col(col).isNull()), out.where(bad).withColumn("reason", F.concat(F.lit(f"{col}: "), F.col(col)))


def binary_flag(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == "Y", 1).otherwise(0)


def choose_layout_type(df: DataFrame, gl_map: DataFrame, meta_map: DataFrame) -> DataFrame:
    """Adds layout: the manual label, else that of the grid-line code, else of the metadata code (by collection), else ''.

    Maps are (collection, code, layout); df has collection, manual, gl_code, meta_code.
    """
    g = gl_map.select(F.col("collection").alias("_gc"), F.col("code").alias("_g"), F.col("layout").alias("_gl"))
    m = meta_map.select(F.col("collection").alias("_mc"), F.col("code").alias("_m"), F.col("layout").alias("_ml"))
    out = df.join(g, (F.col("collection") == F.col("_gc")) & (F.col("gl_code") == F.col("_g")), "left").join(m, (F.col("collection") == F.col("_mc")) & (F.col("meta_code") == F.col("_m")), "left")
    manual = F.when(F.col("manual") != "", F.col("manual"))
    return out.withColumn("layout", F.coalesce(manual, "_gl", "_ml", F.lit(""))).drop("_gc", "_g", "_gl", "_mc", "_m", "_ml")


def group_number(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Adds group_no: the n first rows of a key in order are 0, the next n are 1 ..."""
    return place_in(df, key, order, "_place").withColumn("group_no", F.floor(F.col("_place") / n).cast("int")).drop("_place")


def filter_by_selector(df: DataFrame, selector: str) -> DataFrame:
    return df.where(F.col(selector) != 0)


def drop_bad_payloads(df: DataFrame, bad_sha1: str | list[str], content: str = "content") -> DataFrame:
    """Without empty payloads and those of the given SHA-1."""
    bad = [bad_sha1] if isinstance(bad_sha1, str) else bad_sha1
    return df.where(F.col(content).isNotNull() & (F.length(content) > 0) & ~F.sha1(F.col(content).cast("binary")).isin(bad))


def check_sizes(df: DataFrame, content: str = "content", key: str = "key") -> DataFrame:
    """Rows whose payload length is not that of the first key's."""
    first = df.agg(F.min_by(F.length(content), key).alias("expected"))
    return df.join(F.broadcast(first)).where(F.length(content) != F.col("expected")).select(key, F.length(content).alias("size"), "expected")


def guess_encoding(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1))


def target_size(df: DataFrame, spec: str, h: str = "height", w: str = "width", truncate: float = 2.0, ar_bin: int = 32, ar_bin2: float = 0.15) -> DataFrame:
    """Adds new_h, new_w by a size spec, sizes cut to whole numbers:

    ``HxW`` and ``N`` (square): as they say.  ``Nl``: the long side becomes N, the short one keeps the ratio but is N / ``truncate``
    at least, and goes to the nearest multiple of ``ar_bin`` away from N (halves away from 0 steps up).  ``Ns``: the short side
    becomes N, the long one N * ``truncate`` at most.  ``Na``: the ratio of height to width, held within ``truncate``, goes to the
    nearest step of ``ar_bin2`` from 1 / ``truncate`` up, and the size is the widest one before the area passes N * N.
    """
    hh, ww = F.col(h).cast("double"), F.col(w).cast("double")
    if "x" in spec:
        a, b = spec.split("x")
        return df.withColumns({"new_h": F.lit(int(a)), "new_w": F.lit(int(b))})
    kind, n = (spec[-1], int(spec[:-1])) if spec[-1] in "lsa" else ("", int(spec))
    if kind == "":
        return df.withColumns({"new_h": F.lit(n), "new_w": F.lit(n)})
    if kind == "a":
        return _under_area(df, hh / ww, float(n * n), truncate, ar_bin2)
    long, short = F.greatest(hh, ww), F.least(hh, ww)
    other = F.greatest(short * n / long, F.lit(n / truncate)) if kind == "l" else F.least(long * n / short, F.lit(n * truncate))
    whole = F.floor(other).cast("int")
    off = F.pmod(whole - n, F.lit(ar_bin))
    other = whole + F.when(off >= ar_bin // 2, ar_bin - off).otherwise(-off)
    tall = hh == (long if kind == "l" else short)
    return df.withColumns({"new_h": F.when(tall, n).otherwise(other).cast("int"), "new_w": F.when(tall, other).otherwise(n).cast("int")})


def _under_area(df: DataFrame, ratio: Column, area: float, truncate: float, step: float) -> DataFrame:
    low = 1.0 / truncate
    held = F.least(F.greatest(ratio, F.lit(low)), F.lit(float(truncate)))
    # steps are added one by one, as rounding of sums differs from that of products
    grid = [low]
    while grid[-1] < truncate:
        grid.append(grid[-1] + step)
    up = F.get(F.filter(F.array(*map(F.lit, grid)), lambda g: g >= F.col("_held")), F.lit(0))
    rows = df.withColumn("_held", held).withColumn("_up", up)
    rows = rows.withColumn("_ratio", F.when(F.col("_up") - F.col("_held") > step / 2, F.col("_up") - step).otherwise(F.col("_up")))
    # the first width whose area is reached lies between these two
    r = F.col("_ratio")
    span = F.sequence(F.ceil(F.sqrt(F.lit(area) / r)).cast("int") - 1, F.ceil((1 + F.sqrt(1 + 4 * r * F.lit(area))) / (2 * r)).cast("int") + 1)
    wide = F.get(F.filter(span, lambda x: F.floor(F.col("_ratio") * x) * x >= area), F.lit(0)) - 1
    rows = rows.withColumn("new_w", wide)
    return rows.withColumn("new_h", F.floor(F.col("_ratio") * F.col("new_w")).cast("int")).drop("_held", "_up", "_ratio")


def rejects(parts: Iterator[DataFrame]) -> DataFrame | None:
    """All reject tables of a run in one."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
