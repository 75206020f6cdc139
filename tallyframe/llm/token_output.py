"""Token ids as compressed byte or bit planes, with a chunk index.

A segment is a run of whole documents in order.  Its ids are cut into blocks of a fixed number of ids, each
block is transposed into byte planes (or bit planes), each plane is compressed with zstandard, and an index
in front names every chunk.  Segments are rows of a Parquet table, so that Spark commits them: a lost
executor's part is written again and no half file stays.

Segment, little-endian: magic ``TFPL``, u1 version, u1 planes a block, u2 0, u4 block size, u4 documents,
u8 ids, u8 ids of the shard before it; then for each document i8 doc_id, u1 whether it is null, u4 ids;
then for each block u4 its ids and u4 crc32 of these, and for each of its planes u4 compressed size; then the planes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_path, table
from .pieces import PieceEncoder, once, tokenizer_path

MAGIC, BLOCK, SEGMENT, END_ID = b"TFPL", 16_384, 65_536, 2
_HEAD = struct.Struct("<4sBBHIIQQ")
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of one block: plane p holds byte (or bit) p of every id."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [p.tobytes() for p in by_byte]
    return [np.packbits((by_byte[b // 8] >> (b % 8)) & 1).tobytes() for b in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T).view("<u4").ravel()
    out = np.zeros(n, "<u4")
    for b, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(b)
    return out


def write_segment(docs: list[tuple[int | None, bytes]], before: int, kind: str = "byte", block: int = BLOCK, level: int = 3) -> bytes:
    """Bytes of a segment of (doc_id, ids as little-endian u4) documents."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    names = np.array([(i or 0, i is None, len(d) // 4) for i, d in docs], _DOC)
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [press.compress(p) for p in to_planes(part, kind)]
        index.append(struct.pack(f"<{2 + len(planes)}I", len(part), zlib.crc32(part.tobytes()), *map(len, planes)))
        body += planes
    head = _HEAD.pack(MAGIC, 1, 4 if kind == "byte" else 32, 0, block, len(docs), len(ids), before)
    return b"".join([head, names.tobytes(), *index, *body])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, ids, ids of the shard before it).  A block that fails its checksum raises ValueError."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    magic, version, n_planes, _, block, n_docs, n_ids, before = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a plane segment")
    at = _HEAD.size
    docs = np.frombuffer(data, _DOC, n_docs, at)
    at += n_docs * _DOC.itemsize
    n_blocks = -(-n_ids // block)
    index = np.frombuffer(data, "<u4", n_blocks * (2 + n_planes), at).reshape(n_blocks, 2 + n_planes)
    at += index.nbytes
    parts = []
    for n, crc, *sizes in index.tolist():
        planes = []
        for s in sizes:
            planes.append(press.decompress(data[at : at + s]))
            at += s
        parts.append(from_planes(planes, n))
        if zlib.crc32(parts[-1].tobytes()) != crc:
            raise ValueError("a block fails its checksum")
    return docs, np.concatenate(parts) if parts else np.empty(0, "<u4"), before


def _segments(path: str, end_id: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard = once(PieceEncoder, path), TaskContext.get().partitionId()
        end = np.uint32(end_id).astype("<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        n = before = seq = 0

        def flush() -> pd.DataFrame:
            nonlocal held, n, before, seq
            row = pd.DataFrame({"shard": [shard], "seq": [seq], "n_ids": [n], "content": [write_segment(held, before, kind)]})
            held, n, before, seq = [], 0, before + n, seq + 1
            return row

        for pdf in batches:
            names = [None if null else int(i) for i, null in zip(pdf["doc_id"].fillna(0), pdf["doc_id"].isna(), strict=True)]
            texts = [t or "" for t in pdf["text"]]
            for at in range(0, len(texts), 2048):
                for name, ids in zip(names[at : at + 2048], enc.encode(texts[at : at + 2048]), strict=True):
                    held.append((name, ids + end))
                    n += len(ids) // 4 + 1
                    if n >= SEGMENT:
                        yield flush()
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, kind: str = "byte") -> None:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order and write the segments to ``path``.

    Null texts count as empty (the end id alone), null doc_ids come first, repeated doc_ids are all written, in
    the order of their texts' hashes and then texts.  Other columns are ignored.  An empty table writes no segments.
    """
    order = ["doc_id", "_h", "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions(*order).drop("_h")
    made = rows.mapInPandas(_segments(tokenizer or tokenizer_path(), end_id, kind), "shard int, seq int, n_ids long, content binary")
    made.write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
        for base, content in zip(pdf["base"], pdf["content"], strict=True):
            docs, ids, before = read_segment(content)
            ends = np.cumsum(docs["n"], dtype=np.int64)
            data = ids.tobytes()
            for i, null, n, e in zip(docs["doc_id"].tolist(), docs["null"].tolist(), docs["n"].tolist(), ends.tolist(), strict=True):
                out["doc_id"].append(None if null else i)
                out["start"].append(base + before + e - n)
                out["n_tokens"].append(n)
                out["ids"].append(data[4 * (e - n) : 4 * e])
        out["doc_id"] = pd.array(out["doc_id"], "Int64")
        yield pd.DataFrame(out)


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian u4) from the segments.

    Shards follow each other in doc_id order; the driver adds up one number a shard.
    """
    rows = spark.read.schema("shard int, seq int, n_ids long, content binary").parquet(path)
    total, bases = 0, []
    for r in sorted(rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        bases.append((r["shard"], total))
        total += r["n"]
    base = spark.createDataFrame(bases, "shard int, base long")
    return rows.join(F.broadcast(base), "shard").select("base", "content").mapInPandas(_read, "doc_id long, start long, n_tokens long, ids binary")


def token_output(spark, docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder in the shared place and read it back; see ``write_ids`` and ``read_ids``."""
    path = stage_path(spark, "planes")
    write_ids(docs, path, **options)
    return read_ids(spark, path)


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op1_bit_planes(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, from the segments as they are read back."""
    return digest(token_output(spark, table(spark, sf_dir, "documents")))
