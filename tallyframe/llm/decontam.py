"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared token seeds (hashed runs of ``MIN_MATCH`` words).  For each pair that
shares one, the longest common run of unmarked words is found by running Karp-Rabin (hashes of all runs of one length,
the length by galloping and halving), compared word by word, tiled and marked, again and again until none of
``MIN_MATCH`` words is left.  Tiles may lie in any order, so reordered passages count.  An item is in a document if
tiles cover at least ``COVERAGE`` of its words.  Memory is in proportion to the words of the document and the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, stage, table
from .hashing import mix, run_hashes, word_hashes

MIN_MATCH, COVERAGE = 5, 0.8
#: Benchmarks whose packed words are below this are sent to every task; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: An odd base of the running hashes and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class _Runs:
    """Hashes of the runs of any length of one sequence, and which of its words are still free."""

    def __init__(self, words: np.ndarray, breaks: np.ndarray):
        n = len(words)
        powers = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)
        up, self.down = powers(_BASE), powers(_BACK)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * up[:n], dtype=np.uint64)])
        self.free, self.breaks = np.ones(n, bool), breaks
        self._reach()

    def _reach(self) -> None:
        """How many free words in a row start at each place."""
        n = len(self.free)
        ends = ~self.free
        ends[1:] |= self.breaks
        at = np.append(np.where(ends, np.arange(n), n), n)
        after = np.minimum.accumulate(at[::-1])[::-1][1:]
        self.reach = np.where(self.free, after - np.arange(n), 0)

    def mark(self, start: int, size: int) -> None:
        self.free[start : start + size] = False
        self._reach()

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the free runs of ``size`` words."""
        at = np.flatnonzero(self.reach >= size)
        return at, (self.sums[at + size] - self.sums[at]) * self.down[at]


def _common(doc: np.ndarray, item: np.ndarray, d: _Runs, i: _Runs, size: int) -> tuple[int, int] | None:
    """(start in item, start in doc) of the first common free run of ``size`` words."""
    at_i, hash_i = i.of(size)
    at_d, hash_d = d.of(size)
    known, first = np.unique(hash_i, return_index=True)
    if not len(known) or not len(at_d):
        return None
    place = np.minimum(np.searchsorted(known, hash_d), len(known) - 1)
    hit = known[place] == hash_d
    a, b = at_i[first[place[hit]]], at_d[hit]
    while len(a):
        x = int(a.min())
        y = int(b[a == x].min())
        if np.array_equal(item[x : x + size], doc[y : y + size]):
            return x, y
        left = (a != x) | (b != y)  # equal hashes of different words
        a, b = a[left], b[left]
    return None


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word numbers: (start in item, start in doc, length), longest first.

    Ties go to the earliest start in the item, then in the document.  An item shorter than ``min_match`` can
    only be matched whole.
    """
    n = min(min_match, len(item))
    if not n or len(doc) < n:
        return []
    # only words of the document that are in a run of n that the item has as well
    hit = np.flatnonzero(np.isin(run_hashes(doc, n), run_hashes(item, n)))
    if not len(hit):
        return []
    near = np.zeros(len(doc) + 1, np.int64)
    np.add.at(near, hit, 1)
    np.add.at(near, hit + n, -1)
    kept = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    doc = doc[kept]
    d, i = _Runs(doc, np.diff(kept) > 1), _Runs(item, np.zeros(len(item) - 1, bool))
    out, most = [], len(item)
    while most >= n and (best := _common(doc, item, d, i, n)):
        # a common run of one length has one of every shorter length: gallop up, then halve
        low, high, step = n, most + 1, 1
        while low + step < high and (found := _common(doc, item, d, i, low + step)):
            low, best, step = low + step, found, step * 2
        high = min(high, low + step)
        while high - low > 1:
            middle = (low + high) // 2
            if found := _common(doc, item, d, i, middle):
                low, best = middle, found
            else:
                high = middle
        out.append((best[0], int(kept[best[1]]), low))
        i.mark(best[0], low)
        d.mark(best[1], low)
        most = low
    return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode().lower()


def benchmark_words(benchmark: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """item (a number of the row), item_id, words (A-Z lower-cased, joined by spaces), n_words, seeds (array of long) of the items that have words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raws = [_raw(t) for t in pdf["text"]]
            hashes, counts = word_hashes(raws)
            parts = np.split(hashes, np.cumsum(counts)[:-1]) if len(pdf) else []
            seeds = [np.unique(run_hashes(w, min(min_match, max(1, len(w))))).view(np.int64).tolist() for w in parts]
            yield pd.DataFrame({"item": pdf["item"], "item_id": pdf["item_id"].astype("Int64").array, "words": [b" ".join(r.split()) for r in raws], "n_words": counts, "seeds": seeds})

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    return rows.mapInPandas(run, "item long, item_id long, words binary, n_words long, seeds array<long>").where("n_words > 0")


def _match(raw: bytes, items: list[tuple[int | None, list[bytes]]], min_match: int) -> list[dict]:
    """The tiles of a document with each of the items; words are numbered, so that equal numbers are equal words."""
    number: dict[bytes, int] = {}
    fresh = count()
    numbers = lambda ws: np.array([number[w] if w in number else number.setdefault(w, next(fresh)) for w in ws], np.uint64)
    doc, out = numbers(raw.split()), []
    for item_id, words in items:
        found = tiles(doc, numbers(words), min_match)
        if found:
            out.append({"item_id": item_id, "n_item_words": len(words), "n_covered": sum(x[2] for x in found), "n_tiles": len(found), "tiles": [list(x) for x in found]})
    return out


_LONG = T.LongType()
MATCHES = T.ArrayType(T.StructType([*[T.StructField(n, _LONG) for n in ("item_id", "n_item_words", "n_covered", "n_tiles")], T.StructField("tiles", T.ArrayType(T.ArrayType(_LONG)))]))


def _scan_small(min_match: int, shared):
    """Tile every document against the items that it shares a seed with; the items travel in the broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        words = [(i, w.split(b" ")) for i, w, _, _ in items]
        tables = []
        for n in sorted({min(min_match, k) for _, _, k, _ in items}):
            of = [(np.frombuffer(s, np.uint64), j) for j, (_, _, k, s) in enumerate(items) if min(min_match, k) == n]
            seeds = np.concatenate([s for s, _ in of])
            owner = np.repeat([j for _, j in of], [len(s) for s, _ in of])
            order = np.argsort(seeds, kind="stable")
            bitmap = np.zeros(1 << 16, bool)
            bitmap[(seeds >> np.uint64(48)).astype(np.int64)] = True
            tables.append((n, seeds[order], owner[order], bitmap))
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                raws = [_raw(t) for t in part["text"]]
                hashes, counts = word_hashes(raws)
                hits = []
                for raw, doc in zip(raws, np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
                    near: set[int] = set()
                    for n, seeds, owner, bitmap in tables:
                        own = run_hashes(doc, n)
                        own = np.unique(own[bitmap[(own >> np.uint64(48)).astype(np.int64)]])
                        lo, hi = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
                        for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                            near.update(owner[a:b].tolist())
                    hits.append(_match(raw, [words[j] for j in sorted(near)], min_match) if near else [])
                yield part.assign(matches=hits)

    return run


def _place(item) -> tuple[bool, int, int]:
    """Order of the matches of a document: by item_id, nulls last, then by the number of the row."""
    return item["item_id"] is None, item["item_id"] or 0, item["item"]


def _broadcastable(items: DataFrame) -> bool:
    size = items.agg(F.coalesce(F.sum(F.length("words") + F.size("seeds") * 8 + 64), F.lit(0)).alias("n")).first()["n"]
    return size <= BROADCAST_BYTES


def find_matches(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, broadcast: bool | None = None) -> DataFrame:
    """``docs`` with the column ``matches``: an array of (item_id, n_item_words, n_covered, n_tiles, tiles), one for each
    item that shares a tile; tiles are (start in item, start in document, length) in words.

    Words are compared with A-Z lower-cased.  Null texts and items have no words and match nothing.  Items with
    one id are items of their own.  Empty tables give no matches.  Columns of docs keep their names, whatever they are,
    but for one named ``matches``, which raises ValueError.  A benchmark within ``BROADCAST_BYTES`` goes to
    every task, and a document is tiled where it is read.  A larger one meets the documents' seeds in a shuffle
    (``broadcast=False``), and only documents with a seed in common are tiled; both ways give the same matches.
    """
    if "matches" in {c.lower() for c in docs.columns}:
        raise ValueError("the column matches would be overwritten")
    items = stage(benchmark_words(benchmark, min_match), "items")
    out = T.StructType([*docs.schema.fields, T.StructField("matches", MATCHES)])
    if _broadcastable(items) if broadcast is None else broadcast:
        rows = sorted(items.toLocalIterator(), key=_place)
        packed = [(r["item_id"], bytes(r["words"]), r["n_words"], np.array(r["seeds"], np.int64).tobytes()) for r in rows]
        return docs.mapInPandas(_scan_small(min_match, docs.sparkSession.sparkContext.broadcast(packed)), out)
    return _shuffled(docs, items, min_match, out)


def _shuffled(docs: DataFrame, items: DataFrame, min_match: int, out: T.StructType) -> DataFrame:
    """Texts are named by a hash; the name of a null text is that of its id, so that they do not meet in one task."""
    lengths = [r["n"] for r in items.select(F.least(F.lit(min_match), "n_words").cast("int").alias("n")).distinct().collect()]
    text_, of_, items_ = free_names(docs.columns, "text", "of", "items")

    @F.pandas_udf("array<long>")
    def seeds_of(texts: pd.Series) -> pd.Series:
        hashes, counts = word_hashes([_raw(t) for t in texts])
        parts = np.split(hashes, np.cumsum(counts)[:-1]) if len(texts) else []
        return pd.Series([np.unique(np.concatenate([run_hashes(w, n) for n in lengths] or [np.empty(0, np.uint64)])).view(np.int64).tolist() for w in parts])

    keyed = docs.withColumn(text_, F.when(F.col("text").isNull(), F.xxhash64(F.lit(0), "doc_id")).otherwise(F.xxhash64("text")))
    seeds = docs.where("text is not null").select(F.xxhash64("text").alias("of"), F.explode(seeds_of("text")).alias("seed"))
    near = seeds.join(items.select("item", F.explode("seeds").alias("seed")), "seed").select("of", "item").distinct()
    # a text has a row for each item that it may hold, before the items' words are fetched
    pairs = near.join(items.select("item", "item_id", "words"), "item").groupBy(F.col("of").alias(of_)).agg(F.collect_list(F.struct("item", "item_id", "words")).alias(items_))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = []
            for text, items in zip(pdf["text"], pdf[items_], strict=True):
                own = [] if items is None or not len(items) else [(x["item_id"], bytes(x["words"]).split(b" ")) for x in sorted(items, key=_place)]
                hits.append(_match(_raw(text), own, min_match) if own and text is not None else [])
            yield pdf.drop(columns=[items_]).assign(matches=hits)

    return keyed.join(pairs, F.col(text_) == F.col(of_), "left").drop(text_, of_).mapInPandas(run, out)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``find_matches`` with ``leaks``: the matches whose tiles cover at least ``coverage`` of the item's words.

    A column of docs named ``leaks`` raises ValueError.
    """
    if "leaks" in {c.lower() for c in docs.columns}:
        raise ValueError("the column leaks would be overwritten")
    enough = lambda m: m["n_covered"] >= m["n_item_words"] * F.lit(coverage)
    return find_matches(docs, benchmark, min_match).withColumn("leaks", F.filter("matches", enough))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_leaks, item_ids (sorted) and the best coverage of each document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = contaminated(docs, table(spark, sf_dir, "benchmark"))
    ratio = F.transform("matches", lambda m: m["n_covered"] / m["n_item_words"])
    return made.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_leaks"),
        F.array_sort(F.transform("leaks", lambda m: m["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(ratio), F.lit(0.0)).alias("coverage"),
    )
