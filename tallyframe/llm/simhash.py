"""SimHash near-duplicates, linked by pivot distance tables.

Every distinct fingerprint x gets its Hamming distances to reference fingerprints (pivots).  By the triangle
inequality |d(x, p) - d(y, p)| <= d(x, y), so a pair with any coordinate further apart than the radius is
discarded unseen.  To find pairs without comparing all, the same distances are taken inside unions of bit
blocks: of ``BLOCKS`` blocks (more for more fingerprints) a pair within the radius differs in at most ``radius``, so on
some union of ``BLOCKS - radius`` blocks all its pivot distances are equal.  Pairs are joined on those coordinates,
thinned by the coordinates over all bits, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_stage, free_names, stage, table

SEED, RADIUS, SHINGLE, BLOCKS, PIVOTS = 42, 3, 3, 5, 16


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash, as a signed long: A-Z lower-cased, k-word shingles, a bit set if set in over half the hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        hashes = [xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def with_fingerprint(docs: DataFrame, name: str = "fp", k: int = SHINGLE) -> DataFrame:
    """The other columns of ``docs`` and ``name``, the fingerprint of ``text``.

    Rows go to Python and only short ones come back: beside a column function, the JVM would hold every text that waits
    for its fingerprint, in all tasks at once.
    """
    rest = [f for f in docs.schema if f.name != "text"]

    def fp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([fingerprint(t.as_py(), k) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], made], [*[f.name for f in rest], name])

    return docs.mapInArrow(fp, T.StructType([*rest, T.StructField(name, T.LongType())]))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints by rule: hashes of 0, 1, 2 ..."""
    from xxhash import xxh64_intdigest

    return [int.from_bytes(xxh64_intdigest(i.to_bytes(8, "little"), SEED).to_bytes(8, "big"), "big", signed=True) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Unions of ``blocks - radius`` of the bit blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(block, blocks - radius)]


def choose_blocks(n: int, radius: int = RADIUS) -> int:
    """Blocks so that the bits of a union tell about n / 16 fingerprints apart: few tables for few fingerprints, more and
    narrower ones as they grow, so that what meets on one key stays small."""
    blocks = radius + 2
    while (blocks - radius) * 64 // blocks < n.bit_length() - 4 and blocks < 2 * radius + 4:
        blocks += 1
    return blocks


def pivot_tables(prints: DataFrame, radius: int, blocks: int, n_pivots: int) -> DataFrame:
    """fp, c0, c1 ... (its distances to the pivots) and key: a row for each union of blocks, of the distances inside it."""
    ps = pivots(n_pivots)
    distance = lambda p, m: F.bit_count((F.col("fp").bitwiseXOR(F.lit(p))).bitwiseAND(F.lit(m))).cast("byte")
    tables = [F.xxhash64(F.lit(i), *[distance(p, m) for p in ps]) for i, m in enumerate(masks(radius, blocks))]
    return prints.select("fp", F.struct(*[distance(p, -1).alias(f"c{i}") for i, p in enumerate(ps)]).alias("c"), F.explode(F.array(*tables)).alias("key"))


def _survives(a: str, b: str, radius: int, n_pivots: int) -> Column:
    """Whether no coordinate tells the two apart by more than the radius."""
    near = F.abs(F.col(f"{a}.c.c0") - F.col(f"{b}.c.c0")) <= radius
    for i in range(1, n_pivots):
        near = near & (F.abs(F.col(f"{a}.c.c{i}") - F.col(f"{b}.c.c{i}")) <= radius)
    return near


def _verified(pairs: DataFrame, radius: int) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, n_pivots: int = PIVOTS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints ``prints(fp)`` that differ in 1 to ``radius`` bits.

    ``blocks`` is chosen by the number of fingerprints if it is not given.
    """
    rows = pivot_tables(prints, radius, blocks or choose_blocks(prints.count(), radius), n_pivots)
    # Spark guesses these rows from the files of the fingerprints, too low by far: it is not to broadcast them
    a, b = rows.hint("merge").alias("a"), rows.hint("merge").alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _survives("a", "b", radius, n_pivots))
    return _verified(pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")), radius)


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, n_pivots: int = PIVOTS) -> DataFrame:
    """Some of ``links``, in proportion to the fingerprints: each is tried against the first one and the one before it of each key."""
    rows = pivot_tables(prints, radius, blocks or choose_blocks(prints.count(), radius), n_pivots)
    me, order = F.struct("fp", "c"), Window.partitionBy("key").orderBy("fp")
    others = F.array(F.lag(me).over(order), F.first(me).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    pairs = rows.select(me.alias("b"), others.alias("others")).select("b", F.explode("others").alias("a")).where(F.col("a").isNotNull() & _survives("a", "b", radius, n_pivots))
    return _verified(pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")), radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the smallest node that it reaches.

    Each round takes the smallest label around and then the label's own label, so that labels travel in
    growing strides; rounds end when none changes.  Labels live in staged tables, never on the driver.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(None).cast("long").alias("was")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        least = labels.select("node", "root").join(around, "node").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stage(least.join(jump, "root").select("node", F.least("root", "far").alias("root"), "was"), "labels")
        done = new.where("was <> root").isEmpty()
        drop_stage(labels, *([both] if done else []))
        if done:
            return new.select("node", "root")
        labels = new


def classes(prints: DataFrame, **options) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``prints(doc_id, fp)``: the smallest doc_id linked with it."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = stage(links(distinct, **options), "links")
    comp = components(found)
    drop_stage(found)
    rooted = stage(distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs(doc_id, text)``.

    Null and wordless texts have fingerprint 0 and are linked like any other.  Rows with one doc_id are rows of
    their own.  component_id is the smallest doc_id in the class that is not null, null if there is none.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    prints = stage(with_fingerprint(rows, k=shingle), "fingerprints")
    made = stage(classes(prints, **options), "classes")
    return prints.join(made, "fp").select("doc_id", "fp", "component_id")


def first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The row of ``docs`` of smallest doc_id in each class of ``rooted(doc_id, row, root)``; row is ``row_hash`` of docs."""
    doc, row, id_, hash_ = free_names(docs.columns, "doc", "row", "id", "hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))).alias("first")
    keep = rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias(id_), F.col("first.row").alias(hash_)).distinct()
    rows = docs.withColumns({doc: F.col("doc_id").cast("long"), row: row_hash(docs)})
    here = F.col(doc).eqNullSafe(F.col(id_)) & (F.col(row) == F.col(hash_))
    kept = rows.join(keep, here, "left_semi")
    # rows alike in every column: one of them
    repeated = rooted.groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias(id_), F.col("row").alias(hash_))
    alike = kept.join(repeated, here, "left_semi").dropDuplicates([doc, row])
    return kept.join(repeated, here, "left_anti").unionByName(alike).drop(doc, row)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, go in as their sorted entries as text."""
    plain = lambda f: F.array_sort(F.map_entries(F.col(f"`{f.name}`"))).cast("string") if f.dataType.typeName() == "map" else F.col(f"`{f.name}`")
    return F.xxhash64(*[plain(f) for f in docs.schema])


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest doc_id (nulls last; equal doc_ids: the smaller row hash).

    All columns are kept as they are, whatever their names.  Null and wordless texts are one class; rows alike in
    every column are one; an empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), row_hash(docs).alias("row"))
    prints = stage(with_fingerprint(rows, "fp", shingle), "fingerprints")
    made = stage(classes(prints, **options), "classes")
    return first_rows(docs, prints.join(made, "fp").select("doc_id", "row", "root"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of all documents; see ``near_duplicates``."""
    made = near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
