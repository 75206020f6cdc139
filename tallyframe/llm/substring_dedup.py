"""Repeated passages, found level by level: runs of 9 words, then 18, then the whole window of 35.

The corpus is packed once into blocks of documents, bucketed by block, so that no level moves texts again.
Every window has one anchor, the 9-word run of smallest hash in it, and one half, the 18-word run that starts
or ends with the anchor's words.  Equal windows have equal anchors and halves.  So level 1 keeps the anchors that
occur at two places or more, level 2 the halves among them that do, and level 3 the windows among those.
What is sent around is a hash, once a block, with whether the block itself repeats it; a passage that
thousands of documents share is a row for each block that it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage, stage_buckets, table
from .hashing import join_hashes, run_hashes, word_hashes

WINDOW, SEED = 35, 9
#: Characters of text in a block; a longer document is a block of its own.
BLOCK = 2_000_000
#: Bytes of text in a bucket of the packed table.
BUCKET = 256 << 20


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pd.DataFrame:
        nonlocal seq, held, size
        ids = [i for i, _ in held]
        row = {
            "block": [(part << 32) + seq],
            "doc_ids": [[0 if i is None else i for i in ids]],
            "nulls": [[i is None for i in ids]],
            "lengths": [[len(t) for _, t in held]],
            "data": [press.compress(b"".join(t for _, t in held))],
        }
        seq, held, size = seq + 1, [], 0
        return pd.DataFrame(row)

    for pdf in batches:
        null = pdf["doc_id"].isna()
        for i, n, t in zip(pdf["doc_id"].fillna(0), null, pdf["text"], strict=True):
            raw = (t or "").encode()
            held.append((None if n else int(i), raw))
            size += len(raw)
            if size >= BLOCK:
                yield flush()
    if held:
        yield flush()


_BLOCK = "block long, doc_ids array<long>, nulls array<boolean>, lengths array<int>, data binary"


def pack(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs(doc_id, text)``, written as a table bucketed by block, ``BUCKET`` bytes of text a bucket or less."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    return stage_buckets(rows.mapInPandas(_pack, _BLOCK), "blocks", "block", n)


def _texts(lengths, data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.asarray(lengths, np.int64))
    return [raw[e - n : e] for n, e in zip(np.asarray(lengths).tolist(), ends.tolist(), strict=True)]


class Windows:
    """All windows of a block: their starts, anchors and halves; and the hash of each."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, window: int, seed: int):
        half = 2 * seed
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = doc[: len(doc) - window + 1] == doc[window - 1 :] if len(doc) >= window else np.empty(0, bool)
        self.starts = np.flatnonzero(inside)
        self.seeds = run_hashes(words, seed)
        if not len(self.starts):
            self.anchors = self.halves = self.starts
            self.half_hash = np.empty(0, np.uint64)
            return
        view = np.lib.stride_tricks.sliding_window_view(self.seeds, window - seed + 1)
        first = [view[self.starts[i : i + 65_536]].argmin(1) for i in range(0, len(self.starts), 65_536)]
        self.anchors = self.starts + np.concatenate(first)
        self.halves = np.where(self.anchors + half <= self.starts + window, self.anchors, self.anchors - (half - seed))
        self.half_hash = join_hashes(self.seeds[self.halves], self.seeds[self.halves + half - seed])
        self.window, self.seed, self.half = window, seed, half

    def whole(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows chosen by ``which``, each from two overlapping halves."""
        a = self.starts[which]
        b = a + self.window - self.half
        s, gap = self.seeds, self.half - self.seed
        left, right = join_hashes(s[a], s[a + gap]), join_hashes(s[b], s[b + gap])
        return join_hashes(left, right, 2), join_hashes(left, right, 3)


def _repeats(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each row, whether its hash is at more than one place in this block."""
    order = np.lexsort((places, hashes))
    h, p = hashes[order], places[order]
    more = (h[1:] == h[:-1]) & (p[1:] != p[:-1])
    group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    many = np.zeros(group[-1] + 1, bool)
    many[group[1:][more]] = True
    out = np.empty(len(h), bool)
    out[order] = many[group]
    return out


def _level12(window: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, lengths, data in zip(pdf["block"], pdf["lengths"], pdf["data"], strict=True):
                w = Windows(*word_hashes(_texts(lengths, data)), window, seed)
                if not len(w.starts):
                    continue
                anchor = w.seeds[w.anchors]
                rows = pd.DataFrame(
                    {"h1": anchor.view(np.int64), "h2": w.half_hash.view(np.int64), "again1": _repeats(anchor, w.anchors), "again2": _repeats(w.half_hash, w.halves)}
                ).drop_duplicates(["h1", "h2"])
                yield rows.assign(block=block)

    return run


def _level3(window: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, lengths, data, alive in zip(pdf["block"], pdf["lengths"], pdf["data"], pdf["alive"], strict=True):
                w = Windows(*word_hashes(_texts(lengths, data)), window, seed)
                which = np.isin(w.half_hash, np.asarray(alive, np.int64).view(np.uint64))
                if not which.any():
                    continue
                h, g = w.whole(which)
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "g": (g[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), "again": n > 1, "block": block})

    return run


def _final(window: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, nulls, lengths, data, alive in zip(pdf["doc_ids"], pdf["nulls"], pdf["lengths"], pdf["data"], pdf["alive"], strict=True):
                texts = _texts(lengths, data)
                words, counts = word_hashes(texts)
                gone = np.zeros(len(words) + 1, np.int64)
                if alive is not None and len(alive):
                    w = Windows(words, counts, window, seed)
                    hit = w.starts[np.isin(w.whole(np.ones(len(w.starts), bool))[0], np.asarray(alive, np.int64).view(np.uint64))]
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept, spans, removed = [], [], []
                for t, end, n in zip(texts, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    mask = gone[end - n : end]
                    own = t.split()
                    if mask.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        spans.append(edge.reshape(-1, 2).tolist())
                        own = [x for x, m in zip(own, mask.tolist(), strict=True) if not m]
                    else:
                        spans.append([])
                    removed.append(int(mask.sum()))
                    kept.append(b" ".join(own).decode())
                made = pd.DataFrame({"doc_id": pd.array([None if x else i for i, x in zip(np.asarray(ids).tolist(), nulls, strict=True)], "Int64")})
                yield made.assign(n_words=counts.tolist(), n_removed=removed, removed=spans, text=kept)

    return run


def _alive(rows: DataFrame, key: list[str], again: str, keep: list[str], name: str) -> DataFrame:
    """Rows whose key is in two blocks or is repeated in one.

    Keys are counted with partial sums before the exchange, and a join brings the repeated ones back, so a passage that is in
    every block is no one task's work.
    """
    rows = stage(rows, name)
    seen = rows.groupBy(*key).agg(F.min("block").alias("_lo"), F.max("block").alias("_hi"), F.max(again).alias("_again")).where("_again or _lo <> _hi")
    made = stage(rows.join(seen.select(*key), key, "left_semi").select(*keep), name)
    drop_stage(rows)
    return made


def dedup_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word spans [start, stop)), text (the words kept, joined by one space).

    A word goes if it is in a window of ``window`` words whose words also start anywhere else, in the same
    document or another (``window`` between 3 and 4 times ``seed`` less one).  Rows are documents of their own
    even if their ids are equal or null.  Null and short texts lose nothing; null becomes the empty text.  Other columns are ignored.
    """
    if not 2 * seed + seed - 1 <= window <= 4 * seed - 1:
        raise ValueError("a window must hold its anchor's half on one side or the other, and be covered by two halves")
    blocks = pack(docs)
    texts = blocks.select("block", "lengths", "data")
    rows = texts.mapInPandas(_level12(window, seed), "h1 long, h2 long, again1 boolean, again2 boolean, block long")
    anchors = _alive(rows, ["h1"], "again1", ["h2", "again2", "block"], "anchors")
    halves = _alive(anchors, ["h2"], "again2", ["h2", "block"], "halves")
    alive = halves.groupBy("block").agg(F.collect_set("h2").alias("alive"))
    rows = texts.join(alive, "block").mapInPandas(_level3(window, seed), "h long, g int, again boolean, block long")
    windows = _alive(rows, ["h", "g"], "again", ["h", "block"], "windows")
    drop_stage(anchors, halves)
    alive = windows.groupBy("block").agg(F.collect_list("h").alias("alive"))
    made = blocks.join(alive, "block", "left")
    return made.mapInPandas(_final(window, seed), "doc_id long, n_words long, n_removed long, removed array<array<int>>, text string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words kept, of all documents."""
    made = dedup_passages(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), r AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), c AS (
  SELECT DISTINCT doc_id, i + o AS p FROM w JOIN r USING (k), (SELECT unnest(range(0, 35)) AS o)
), p AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d
), k AS (
  SELECT p.doc_id, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY 1
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
