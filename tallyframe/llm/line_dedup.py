"""Line deduplication by an exact set-similarity join; DataFrame functions only.

A line is its set of lower-cased words, and lines of one set are a class.  Classes are made first, so a line that
many documents share is one row in all that follows.  Words are ordered from rare to common; two sets with Jaccard
of at least ``SIMILARITY`` share one of the first ``n - ceil(t n) + 1`` of them.  Classes meet on these words, thinned
by their sizes, by how many words can still agree after the shared position and by a 128-bit parity of the sets,
and the survivors' sets are fetched and compared.

A class goes if it has one earlier similar class, so it need not meet all of them.  The first round compares each
class with a few earlier ones that share two of their least hashes, which settles the members of groups of near copies; only
what is still open then meets all earlier classes.  So a group gives rows in proportion to its size.

Rarity is counted over all lines in 65,536 bins of the words' hashes, which is a number a bin for every task, of
one size however large the corpus.  The order need only be the same everywhere to be exact; the bins make it
close to that of the words' own counts.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, drop_stage, free_names, let, likely, stage, table, with_likely

SIMILARITY, BINS = 0.8, 1 << 16
#: How many of a set's least hashes the first round pairs up to look for earlier classes, and how many before a class in order it tries.
NEAR_WORDS, NEAR_STEPS = 3, 4
#: Stands for no doc_id where rows are put in order; ties with a real id are told apart later.
_NO_ID = (1 << 63) - 1


def plain(text: Column) -> Column:
    """The text lower-cased, with spaces for the other white characters but line feeds."""
    low = F.lower(text)
    return F.when(low.rlike(r"[\x09\x0B-\x0D]"), F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)


def tokens(line: Column) -> Column:
    """Distinct hashes of the words of a line of a ``plain`` text."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def rarity(lines: DataFrame) -> Column:
    """The level of each bin as an array literal: thirds of octaves of how often ``lines(line)`` have a word of it, from 0 to 127."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''")
    seen = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    levels = [0] * BINS
    for r in seen.collect():  # at most BINS rows
        levels[r["bin"]] = min(127, 1 + int(3 * log2(r["n"])))
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<int>")


def _least(similarity: float, n: Column) -> Column:
    """ceil(t n), safe from rounding."""
    return F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("int")


def keyed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h (of the text), line_no, key, low, high (which name the set: a hash of it and the parity of its words in 128 places),
    n (its size), prefix (its rarest words, as many as a similar set must meet one of) and least (its least hashes) of all lines that have words.

    Texts are cut into words twice, to count them and to put their hashes in order; stored, the hashes would take as much disk as the texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line_no", "line")).where(F.col("line").rlike(WORD))
    levels = rarity(rows)
    hashed = rows.select("doc_id", "h", "line_no", tokens(F.col("line")).alias("tokens"))
    # a word is one number: its level above 56 bits of its hash, so that numbers sort from rare to common
    level = lambda h: F.coalesce(F.get(levels, h.bitwiseAND(F.lit(BINS - 1)).cast("int")), F.lit(0)).cast("long")
    number = lambda h: F.shiftleft(level(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    ranked = hashed.select("doc_id", "h", "line_no", F.sort_array(F.transform("tokens", number)).alias("ranked"), F.slice(F.sort_array("tokens"), 1, NEAR_WORDS).alias("least"))
    n = F.size("ranked")
    bits = lambda half: F.expr(f"aggregate(ranked, 0L, (b, t) -> if((t & 64) = {half}, b ^ shiftleft(1L, cast(t & 63 as int)), b))")
    return stage(ranked.select("doc_id", "h", "line_no", F.xxhash64("ranked").alias("key"), bits(0).alias("low"), bits(64).alias("high"), n.alias("n"), F.slice("ranked", F.lit(1), n - _least(similarity, n) + 1).alias("prefix"), "least"), "keyedlines")


ID = ["key", "low", "high"]


def line_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): lines(doc_id, h, line_no, key, low, high) and classes(key, low, high, n, prefix, least, first, n_lines).

    ``first`` is the earliest place of a class, (no id, doc_id, line_no, h).
    """
    keyed = keyed_lines(docs, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "h")
    classes = stage(keyed.groupBy(*ID).agg(F.min(place).alias("first"), F.count("*").alias("n_lines"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("least").alias("least")), "lineclasses")
    lines = stage(keyed.select("doc_id", "h", "line_no", *ID), "lines")
    drop_stage(keyed)
    return lines, classes


def _doc() -> Column:
    """The first id of a class, to put classes in order."""
    return F.coalesce("first.doc_id", F.lit(_NO_ID)).alias("doc")


def _differ(a: str, b: str) -> Column:
    """In how many words two sets differ at least: the bits in which their parities do."""
    return F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low"))) + F.bit_count(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high")))


def _may_match(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and parities leave room for the similarity."""
    an, bn = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(an, bn) >= F.greatest(an, bn) * F.lit(similarity) - F.lit(1e-9)) & (an + bn - _differ(a, b) >= 2 * _need(an, bn, similarity))


def _need(an: Column, bn: Column, similarity: float) -> Column:
    """Words that two similar sets of these sizes share at least."""
    return F.ceil((an + bn) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def _id(side: str) -> Column:
    return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ID])


def near_candidates(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of classes that share two of their least hashes and stand near each other, or b with the first, in the order of ids."""
    least = lambda i: F.get("least", F.lit(i))
    keys = F.array(F.xxhash64(least(0)), *[F.xxhash64(least(i), least(j)) for i, j in combinations(range(NEAR_WORDS), 2)])
    keys = F.when(F.size("least") < NEAR_WORDS, F.slice(keys, 1, 1)).otherwise(F.slice(keys, 2, NEAR_WORDS * (NEAR_WORDS - 1) // 2))
    posts = classes.select(*ID, "n", _doc(), F.explode(keys).alias("t"))
    me = F.struct(*ID, "n")
    order = Window.partitionBy("t").orderBy("doc", *ID)
    others = {"a0": F.first(me).over(order.rowsBetween(Window.unboundedPreceding, -1))} | {f"a{k}": F.lag(me, k).over(order) for k in range(1, NEAR_STEPS + 1)}
    near = posts.select(me.alias("b"), *[w.alias(n) for n, w in others.items()]).where("a1 is not null")
    # of those that may match, the one whose parity is nearest
    best = F.array_min(F.array(*[F.when(_may_match(n, "b", similarity), F.struct(_differ(n, "b").alias("differ"), _id(n).alias("a"))) for n in others]))
    return near.select(best["a"].alias("a"), _id("b").alias("b")).where("a is not null").distinct()


def open_candidates(classes: DataFrame, gone: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of classes that share a rare word and pass all filters, where the later one is not among ``gone``.

    A pair is looked at where it first shares a word; so nothing before that place is common to both.  Size, place and
    whether a class is open travel as one number, as these rows are most of what is shuffled.
    """
    known = gone.select(*ID, F.lit(True).alias("_gone"))
    rows = classes.join(known, ID, "left").select(*ID, _doc(), (F.col("n").cast("long") * 2 + F.col("_gone").isNull().cast("long")).alias("size"), F.posexplode("prefix").alias("pos", "t"))
    posts = rows.select(*ID, "doc", "t", (F.shiftleft("size", 31) + F.col("pos")).alias("at")).repartition("t")
    a, b = (posts.select("*", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).alias("pos"), (F.shiftright("at", 31).bitwiseAND(F.lit(1)) == 1).alias("open")).alias(s) for s in "ab")
    tie = (F.col("a.doc") == F.col("b.doc")) & (_id("a") < _id("b"))  # which is the later one is seen when sets are compared
    wanted = F.when(F.col("a.doc") < F.col("b.doc"), F.col("b.open")).when(tie, F.col("a.open") | F.col("b.open")).otherwise(False)
    room = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= _need(F.col("a.n"), F.col("b.n"), similarity)
    return a.join(b, (F.col("a.t") == F.col("b.t")) & wanted & room & _may_match("a", "b", similarity)).select(_id("a").alias("a"), _id("b").alias("b")).distinct()


def later_ones(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The class of each of ``pairs(a, b)`` that starts at the later place, of those whose whole sets are similar.

    A line's set is read from the first document that has it.
    """
    pairs = stage(pairs, "linepairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select(F.struct(*ID).alias("id"), "first"), "id")
    wanted = stage(wanted.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h")).agg(F.collect_list(F.struct("id", "first")).alias("want")), "linewanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    got = likely(texts, "h", wanted, "_h").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    line = lambda w, all_: F.struct(w["id"].alias("id"), w["first"].alias("first"), F.get(all_, w["first"]["line_no"]).alias("line"))
    got = got.select(F.inline(let(F.split(plain(F.col("text")), "\n"), lambda all_: F.transform("want", lambda w: line(w, all_)))))
    sets = stage(got.select("id", F.struct("first.none", "first.doc_id", "first.line_no").alias("place"), tokens(F.col("line")).alias("set")).dropDuplicates(["id"]), "linesets")
    side = lambda s: sets.select(F.col("id").alias(s), F.col("place").alias(f"place_{s}"), F.col("set").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    same = both.where(shared >= (F.size("set_a") + F.size("set_b") - shared) * F.lit(similarity) - F.lit(1e-9))
    later = F.when(F.col("place_a") < F.col("place_b"), F.col("b")).when(F.col("place_b") < F.col("place_a"), F.col("a"))
    made = stage(same.select(later.alias("id")).where("id is not null").distinct().select("id.*"), "linelater")
    drop_stage(pairs, wanted, sets)
    return made


def repeated_classes(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, low, high of the classes that are similar to a class with an earlier place."""
    gone = later_ones(near_candidates(classes, similarity), docs, classes, similarity)
    rest = later_ones(open_candidates(classes, gone, similarity), docs, classes, similarity)
    return gone.unionByName(rest).distinct()


def find_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h (hash of the text) and removed: the numbers of its lines that go, in order; texts that lose none are left out.

    A line goes if a line at an earlier place has a Jaccard of at least ``similarity`` with it, equal sets included, be
    that line kept or not.  Places are ordered by doc_id (nulls last), then line number; of rows with one doc_id, none is
    earlier by it, so lines of one number stay in both.
    """
    lines, classes = line_classes(docs, similarity)
    later = repeated_classes(docs, classes, similarity).withColumn("later", F.lit(True))
    known = stage(classes.join(later, ID, "left").where("n_lines > 1 or later").select(*ID, "first", F.coalesce("later", F.lit(False)).alias("later")), "lineknown")
    drop_stage(classes)
    here, first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no"), F.struct("first.none", "first.doc_id", "first.line_no")
    rows = lines.join(known, ID).where(F.col("later") | (first < here))
    made = stage(rows.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "linemarks")
    drop_stage(lines, known)
    return made


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, removed: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` without repeated lines (see ``find_repeats``); all columns keep their names and places.

    ``removed`` names a column to add, with the numbers of the lines that went; a name that docs has raises ValueError.
    Blank lines stay, and a text that loses all its lines is the empty one.  A null text stays null.  Ids may be null or
    repeated, other columns may have any name, and an empty table stays empty.
    """
    if removed is not None and removed.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {removed} would be overwritten")
    doc, h, doc2, h2, gone, may = free_names(docs.columns, "doc", "h", "doc2", "h2", "gone", "may")
    marks = find_repeats(docs.select("doc_id", "text"), similarity).select(F.col("doc_id").alias(doc2), F.col("h").alias(h2), F.col("removed").alias(gone))
    rows = with_likely(docs.withColumns({doc: F.col("doc_id").cast("long"), h: F.xxhash64("text")}), h, marks, h2, may)
    stays = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(gone))
    kept = let(F.split("text", "\n"), lambda all_: F.array_join(F.transform(stays(all_), lambda i: F.get(all_, i)), "\n"))
    text = F.when(F.col(gone).isNotNull(), kept).otherwise(F.col("text"))
    out = [text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    none = F.array().cast("array<int>")
    extra = lambda c: [c.alias(removed)] if removed else []
    # texts that lose no line take no part in the join
    cut = rows.where(may).join(marks, F.col(doc).eqNullSafe(F.col(doc2)) & (F.col(h) == F.col(h2)), "left").select(*out, *extra(F.coalesce(F.col(gone), none)))
    return rows.where(~F.col(may)).select(*[F.col(f"`{c}`") for c in docs.columns], *extra(none)).unionByName(cut)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the md5 of the text that is kept (null text: of the empty one) of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    made = dedup_lines(docs, removed="removed")
    return made.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, CAST(line_no - 1 AS BIGINT) AS line_no, line,
         list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
), c AS (
  SELECT ws, len(ws) AS n, row_number() OVER (ORDER BY ws) AS k, min(doc_id * 1000000 + line_no) AS first FROM l WHERE len(ws) > 0 GROUP BY ws
), t AS (
  SELECT k, n, unnest(ws) AS w FROM c
), f AS (
  SELECT w, count(*) AS df FROM t GROUP BY w
), p AS (
  SELECT k, n, w FROM (SELECT t.k, t.n, t.w, row_number() OVER (PARTITION BY t.k ORDER BY df, t.w) AS pos FROM t JOIN f USING (w))
  WHERE pos <= n - CAST(ceil(0.8 * n - 1e-9) AS INT) + 1
), q AS (
  SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.w = b.w AND a.k < b.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
), v AS (
  SELECT a, b FROM (SELECT q.a, q.b, len(list_intersect(x.ws, y.ws)) AS s, x.n + y.n AS m FROM q JOIN c x ON x.k = q.a JOIN c y ON y.k = q.b) WHERE s >= 0.8 * (m - s) - 1e-9
), e AS (
  SELECT a, b FROM v UNION ALL SELECT b, a FROM v
), g AS (
  SELECT c.k, c.ws, least(min(c.first), min(o.first)) AS best FROM c LEFT JOIN e ON e.a = c.k LEFT JOIN c o ON o.k = e.b GROUP BY c.k, c.ws
), m AS (
  SELECT l.doc_id, l.line_no, l.line, coalesce(g.best < l.doc_id * 1000000 + l.line_no, false) AS removed FROM l LEFT JOIN g ON g.ws = l.ws
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN removed THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(CASE WHEN removed THEN NULL ELSE line END, chr(10) ORDER BY line_no), '')) AS kept_md5
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, md5('') FROM documents WHERE text IS NULL
"""
