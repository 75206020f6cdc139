"""Near-duplicate texts by SimHash pivot tables, completed by an exact set-similarity join of word shingles.

A text is its set of hashed runs of ``SHINGLE`` words, A-Z lower-cased (all its words if there are fewer).  Texts of one
set are a class from the start.  Every set has a 64-bit SimHash; fingerprints within a few bits meet in the pivot distance
tables of ``simhash``, and the pairs are verified on their whole sets.  That links the closest copies, and most of a large
group, without looking at shingles.

A Jaccard of 0.8 is about ten differing bits, which no table of 64-bit fingerprints reaches, so the rest is found exactly.
Shingles are ordered from rare to common; two sets with a Jaccard of at least ``SIMILARITY`` share one of the first
``n - ceil(t n) + 1`` of them, so no pair can be missed.  Pairs are thinned by sizes and places only, and each is verified
on its whole sets.  Only shingles that texts of different components share are looked at.  They are linked by one
pair a post at most, to the nearest by SimHash, round by round; the last round takes every pair of texts that are not in one component yet and that sizes, places
and parity sketches leave room for.  So components are those of all similar pairs, without all pairs of a group.  Links join
components, not texts: what is known is contracted, so a group's links cost rows in proportion to its parts.

Rarity is counted in ``BINS`` bins of the hashes over all texts.  The order need only be the same everywhere to be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, likely, stage
from .hashing import run_hashes, word_hashes
from .simhash import components, first_rows, near_links, row_hash

SHINGLE, SIMILARITY, BINS, ROUNDS = 5, 0.8, 1 << 18, 3
#: How many posts before each in order a round chooses from, and in how many bits fingerprints of what it tries differ at most.
STEPS, CLOSE = 4, 16
#: How many open pairs a round has to take away for each post, for another one to be worth its sorting.
WORTH = 4
#: Longs of a folded sketch, and how many posts of other components a shingle has where the last round compares folded sketches.
FOLD, CROWD = 8, 4
#: Texts that are hashed at once, and bytes of them (a text may have more): about 60 times as much memory is used.
AT_ONCE, BYTES = 200, 500_000


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word runs of each text; empty for texts without words."""
    words, counts = word_hashes([(t or "").encode().lower() for t in texts])
    runs, ends = run_hashes(words, k), np.cumsum(counts)
    return [np.unique(runs[e - n : e - k + 1] if n >= k else run_hashes(words[e - n : e], max(1, int(n)))) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def runs_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of the rows that are hashed at once: all of them in order, ``AT_ONCE`` or about ``BYTES`` at a time."""
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at == AT_ONCE or total + size > BYTES):
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def _parts(pdf: pd.DataFrame, k: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for a, b in runs_of([len(t) if t else 0 for t in pdf["text"]]):
        part = pdf.iloc[a:b]
        yield part, shingle_sets(part["text"].tolist(), k)


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def rarity(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """How many sets hold a shingle of each bin: a table of one size however large the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BINS, np.int64)
        for pdf in batches:
            for _, sets in _parts(pdf, k):
                seen += np.bincount(_bins(np.concatenate(sets)), minlength=BINS)
        if seen.any():
            yield pd.DataFrame({"slot": range(64), "seen": [x.tobytes() for x in np.split(seen, 64)]})

    def add(slot, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["seen"])
        return pd.DataFrame({"slot": [slot[0]], "seen": [total.tobytes()]})

    made = docs.select("text").mapInPandas(count, "slot int, seen binary").groupBy("slot").applyInPandas(add, "slot int, seen binary")
    got = sorted((r["slot"], bytes(r["seen"])) for r in made.collect())  # 64 rows at most
    return np.minimum(np.frombuffer(b"".join(b for _, b in got), np.int64), 1 << 31).astype(np.uint32) if got else np.zeros(BINS, np.uint32)


def _key(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int.from_bytes(xxh64_intdigest(found.tobytes()).to_bytes(8, "big"), "big", signed=True)


def set_fingerprint(found: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes, as a signed long: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big", signed=True)


#: Places of the parity sketch of a set, by its size: the first that are more than its hashes, or the last.
PLACES = (1 << 10, 1 << 13, 1 << 16)


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity of a set's hashes in places, as longs.  Two sets differ in as many hashes at least as their sketches in bits."""
    places = next((p for p in PLACES if p > len(found)), PLACES[-1])
    odd = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


KEYED = "doc_id long, row long, key long, fp long, n int, prefix array<long>, sketch array<long>, data binary"


def keyed_texts(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """doc_id, row, key and fp (of the set), n (its size), prefix (its rarest shingles), sketch and data (the text, compressed); the
    last three are null for a set that the task has given."""
    order = docs.sparkSession.sparkContext.broadcast(rarity(docs, k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        seen: set[int] = set()
        press = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            for part, sets in _parts(pdf, k):
                keys, prefixes, sketches, data = [_key(s) for s in sets], [], [], []
                for key, s, t in zip(keys, sets, part["text"], strict=True):
                    if key in seen:
                        prefixes.append(None)
                        sketches.append(None)
                        data.append(None)
                        continue
                    seen.add(key)
                    m = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
                    prefixes.append(s[np.argsort(order.value[_bins(s)], kind="stable")[:m]].view(np.int64))
                    sketches.append(sketch(s))
                    data.append(press.compress((t or "").encode()))
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").array, "row": part["row"].to_numpy(), "key": keys, "fp": [set_fingerprint(s) for s in sets],
                        "n": [len(s) for s in sets], "prefix": prefixes, "sketch": sketches, "data": data,
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInPandas(run, KEYED)


def _need(an: Column, bn: Column, similarity: float) -> Column:
    """Shingles that two similar sets of these sizes share at least."""
    return F.ceil((an + bn) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def _ok(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and places leave room for the similarity, if this is the first shingle in order that the two share."""
    an, bn, ap, bp = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    return (F.least(an, bn) >= F.greatest(an, bn) * F.lit(similarity) - F.lit(1e-9)) & (F.least(an - ap, bn - bp) >= _need(an, bn, similarity))


def _folded(sketch: Column) -> Column:
    """A sketch of any length as one of ``FOLD`` longs: parities of places that many apart are added."""
    long = lambda j: F.aggregate(F.sequence(F.lit(0), (F.size(sketch) / FOLD).cast("int") - 1), F.lit(0).cast("long"), lambda t, m: t.bitwiseXOR(F.get(sketch, m * FOLD + j)))
    return F.array(*[long(j) for j in range(FOLD)])


def _unlike(a: str, b: str, an: Column, bn: Column, similarity: float) -> Column:
    """Whether folded sketches tell that sets of these sizes are not similar; false where one is null."""
    differ = sum((F.bit_count(F.get(f"{a}.fold", F.lit(j)).bitwiseXOR(F.get(f"{b}.fold", F.lit(j)))) for j in range(FOLD)), F.lit(0))
    return F.coalesce(an + bn - differ < 2 * _need(an, bn, similarity), F.lit(False))


def _open_pairs(live: DataFrame, folds: DataFrame, similarity: float) -> DataFrame:
    """All pairs (x, y) of keys of different components at the first shingle that they share, of those that may be similar.

    They are expanded from pairs of roots, so pairs inside a component cost nothing.  A root goes with the bounds of its posts
    of the shingle; one post is its own bound, with its folded sketch.
    """
    posts = stage(live.join(folds, "key", "left").select("key", "n", "root", "pos", "t", F.when(F.col("others") > CROWD, F.col("fold")).alias("fold")), "shingleopen")
    alone = F.count("*") == 1
    r = posts.groupBy("t", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("left"), F.when(alone, F.any_value("fold")).alias("fold"))

    def room(low_a, high_a, left_a, low_b, high_b, left_b) -> Column:
        share = F.lit(similarity)
        sizes = (high_a >= low_b * share - F.lit(1e-9)) & (high_b >= low_a * share - F.lit(1e-9))
        return sizes & (F.least(left_a, left_b) >= _need(low_a, low_b, similarity))

    bounds = lambda s: [F.col(f"{s}.{c}") for c in ("low", "high", "left")]
    likes = ~_unlike("a", "b", F.col("a.low"), F.col("b.low"), similarity)
    cross = r.alias("a").join(r.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.root") < F.col("b.root")) & room(*bounds("a"), *bounds("b")) & likes)
    cross = cross.select(F.col("a.t").alias("t"), F.col("a.root").alias("ra"), F.col("b.root").alias("rb"), F.struct("b.low", "b.high", "b.left", "b.fold").alias("b"))
    me = F.struct("key", "n", "pos", "fold")
    x, y = posts.select("t", F.col("root").alias("ra"), me.alias("x")), posts.select("t", F.col("root").alias("rb"), me.alias("y"))
    n, left = F.col("x.n"), F.col("x.n") - F.col("x.pos")
    some = cross.join(x, ["t", "ra"]).where(room(n, n, left, *bounds("b")) & ~_unlike("x", "b", n, F.col("b.low"), similarity)).select("t", "rb", "x")
    found = some.join(y, ["t", "rb"]).where(_ok("x", "y", similarity) & ~_unlike("x", "y", n, F.col("y.n"), similarity))
    made = stage(found.select(*_pairs(F.col("x.key"), F.col("y.key"))).distinct(), "shinglecrossing")
    drop_stage(posts)
    return made


def _verified(pairs: DataFrame, keyed: DataFrame, sketches: DataFrame, similarity: float, k: int) -> DataFrame:
    """The pairs whose whole sets have a Jaccard of at least ``similarity``; texts are fetched only where the sketches leave room for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for pdf in batches:
            for a, b in runs_of([zstandard.frame_content_size(d) for d in pdf["data"]]):
                part = pdf.iloc[a:b]
                sets = shingle_sets([press.decompress(d).decode() for d in part["data"]], k)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "set": [s.view(np.int64) for s in sets]})

    side = lambda c: sketches.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    # sketches of two lengths tell nothing
    differ = F.when(F.size("sa") == F.size("sb"), F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)).otherwise(0)
    room = F.col("na") + F.col("nb") - differ >= 2 * _need(F.col("na"), F.col("nb"), similarity)
    pairs = stage(pairs.join(side("a"), "a").join(side("b"), "b").where(room).select("a", "b"), "shinglepairs")
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "shinglewanted")
    # more than one task may have given a set
    texts = likely(keyed.where("data is not null").select("key", "data"), "key", wanted, "key").join(wanted, "key").groupBy("key").agg(F.any_value("data").alias("data"))
    sets = stage(texts.mapInPandas(run, "key long, set array<long>"), "shinglesets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    made = stage(both.where(shared >= (F.size("sa") + F.size("sb") - shared) * F.lit(similarity) - F.lit(1e-9)).select("a", "b"), "shinglelinks")
    drop_stage(pairs, wanted, sets)
    return made


def close_pairs(keyed: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of sets whose fingerprints are equal or linked by ``near_links``: each set with the smallest
    of its fingerprint, and those with each other."""
    sets = keyed.select("fp", "key").distinct()
    prints = stage(sets.groupBy("fp").agg(F.min("key").alias("first")), "shingleprints")
    near = stage(near_links(prints), "shinglenear")
    side = lambda s: prints.select(F.col("fp").alias(s), F.col("first").alias(f"{s}_key"))
    pairs = sets.join(prints, "fp").select(F.col("first").alias("x"), F.col("key").alias("y")).unionByName(near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_key").alias("x"), F.col("b_key").alias("y")))
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _live(posts: DataFrame, turn: int, similarity: float) -> DataFrame:
    """The ``posts(key, n, fp, root, pos, t)`` of shingles that different components share, with ``others`` (posts of the shingle in other
    components) and ``near``: the key of another component that is nearest by fingerprint, of those that may match, stand just before it in an
    order of the turn or first, and differ in ``CLOSE`` bits at most.  So a round tries one pair a post, and none of texts that have little in common."""
    by = Window.partitionBy("t")
    me = F.struct("key", "n", "fp", "pos", "root")
    rows = posts.withColumn("others", F.count("*").over(by) - F.count("*").over(Window.partitionBy("t", "root"))).where("others > 0")
    order = by.orderBy(*([F.xxhash64("key", F.lit(turn))] if turn else ["n"]), "key")
    names = [f"a{k}" for k in range(STEPS + 1)]
    rows = rows.select("*", me.alias("me"), F.first(me).over(order).alias("a0"), *[F.lag(me, k).over(order).alias(f"a{k}") for k in range(1, STEPS + 1)])
    differ = lambda a: F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col("fp")))
    best = F.array_min(F.array(*[F.when((F.col(f"{a}.root") != F.col("root")) & (differ(a) <= CLOSE) & _ok(a, "me", similarity), F.struct(differ(a).alias("differ"), F.col(f"{a}.key").alias("key"))) for a in names]))
    return stage(rows.select("key", "n", "fp", "root", "pos", "t", "others", best["key"].alias("near")), "shinglelive")


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(key, root)`` after ``links(a, b)`` between keys: components of the graph whose nodes are the roots so far (a key without one is its own)."""
    side = lambda c: roots.select(F.col("key").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    made = components(stage(ends.where("a <> b").select(*_pairs(F.col("a"), F.col("b"))).distinct(), "shingleends"))
    new = made.select(F.col("node").alias("key")).join(roots, "key", "left_anti").select("key", F.col("key").alias("root"))
    return stage(roots.unionByName(new).join(made.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("key", F.coalesce("far", "root").alias("root")), "shingleroots")


def similar_texts(keyed: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, most: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """(key, root) of the sets that are similar to another: root is the smallest key of its component.

    While more than ``most`` pairs a post are open, and the round before took away more than ``WORTH`` of them a post, a round links neighbours
    only, ``rounds`` times at most; then all open pairs are taken.  Between rounds only posts of shingles that are still shared by different components are kept.
    """
    sketches = stage(keyed.where("sketch is not null").groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "shinglesketches")
    links = _verified(close_pairs(keyed), keyed, sketches, similarity, k)
    roots = stage(components(links).select(F.col("node").alias("key"), "root"), "shingleroots")
    posts = keyed.where("prefix is not null").select("key", "n", "fp", "prefix").join(roots, "key", "left")
    posts = posts.select("key", "n", "fp", F.coalesce("root", "key").alias("root"), F.posexplode("prefix").alias("pos", "t")).repartition("t").dropDuplicates(["t", "key"])
    live, seen, before = _live(posts, 0, similarity), None, None
    for turn in range(1, rounds + 2):
        total = live.agg(F.coalesce(F.sum("others"), F.lit(0)).alias("p"), F.count("*").alias("m")).first()
        if not total["p"]:
            break
        slow = before is not None and (before["p"] - total["p"]) / 2 <= WORTH * before["m"]
        last, before = turn > rounds or slow or total["p"] / 2 <= most * total["m"], total
        if last:
            found = _open_pairs(live, sketches.select("key", _folded(F.col("sketch")).alias("fold")), similarity)
        else:
            found = live.where("near is not null").select(*_pairs(F.col("key"), F.col("near"))).distinct()
        # a pair is looked at once
        found = stage(found if seen is None else found.join(seen, ["a", "b"], "left_anti"), "shinglefound")
        new = _verified(found, keyed, sketches, similarity, k)
        was, seen = seen, found if seen is None or last else stage(seen.unionByName(found), "shingleseen")
        if was is not None and was is not seen:
            drop_stage(was)
        old, roots = roots, _joined(roots, new)
        drop_stage(links, new, old)
        if last:
            break
        old, live = live, _live(live.select("key", "n", "fp", "pos", "t").join(roots, "key", "left").select("key", "n", "fp", F.coalesce("root", "key").alias("root"), "pos", "t"), turn, similarity)
        drop_stage(old)
    drop_stage(live, links, sketches)
    return roots


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, **options) -> DataFrame:
    """One row of ``docs`` for each component of similar texts: that of the smallest doc_id (nulls last; equal doc_ids: the
    smaller row hash).  Null and wordless texts have the empty set, so they are one class.  All columns are kept, whatever
    their names; rows alike in every column are one; an empty table stays empty."""
    rows = docs.select("doc_id", F.col("text").alias("text"), row_hash(docs).alias("row"))
    keyed = stage(keyed_texts(rows, similarity, k), "shingles")
    roots = similar_texts(keyed, similarity, k, **options)
    # copies have one key and one fingerprint
    root = F.struct(F.coalesce("root", "key").alias("root"), F.when(F.col("root").isNull(), F.col("fp")).alias("fp"))
    prints = stage(keyed.select("doc_id", "row", "key", "fp").join(roots, "key", "left").select("doc_id", "row", root.alias("root")), "shinglerooted")
    drop_stage(keyed, roots)
    return first_rows(docs, prints)
