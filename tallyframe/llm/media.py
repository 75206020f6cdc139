"""Media columns: payloads as PNG files in binary columns, and low-frequency cosine hashes of their pixels.

The PNG code is written out: zlib chunks with checksum tests, row filters undone with numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

#: Pixels a row; also what payloads are padded to a multiple of.
WIDTH = 192
PAD, LEVEL, IDAT = 32, 6, 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None, width: int = WIDTH) -> bytes:
    """UTF-8 with spaces appended up to a positive multiple of ``width``; null counts as empty."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (-len(raw) % width if raw else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(pixels: np.ndarray, level: int = LEVEL) -> bytes:
    """8-bit greyscale PNG of ``pixels(height, width)``; each row by none, left or upper filter, whichever is smallest."""
    h, w = pixels.shape
    left = pixels - np.pad(pixels, ((0, 0), (1, 0)))[:, :-1]
    up = pixels - np.pad(pixels, ((1, 0), (0, 0)))[:-1]
    kinds = np.stack([pixels, left, up])
    kind = np.abs(kinds.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    rows = np.concatenate([kind[:, None].astype(np.uint8), kinds[kind, np.arange(h)]], axis=1)
    body = zlib.compress(rows.tobytes(), level)
    parts = [_chunk(b"IDAT", body[i : i + IDAT]) for i in range(0, len(body), IDAT)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def _average(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, last = np.empty_like(row), 0
    for i, (x, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        out[i] = last = (x + (last + b) // 2) & 255
    return out


def _paeth(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, a, c = np.empty_like(row), 0, 0
    for i, (x, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        near = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = a = (x + near) & 255
        c = b
    return out


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Pixels of filtered rows (the filter in front of each)."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if not kinds.any():
        return out
    above = np.zeros(out.shape[1], np.uint8)
    for i, kind in enumerate(kinds.tolist()):
        if kind == 1:
            out[i] = np.cumsum(out[i], dtype=np.uint8)
        elif kind == 2:
            out[i] += above
        elif kind == 3:
            out[i] = _average(out[i], above)
        elif kind == 4:
            out[i] = _paeth(out[i], above)
        elif kind:
            raise ValueError(f"row filter {kind}")
        above = out[i]
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale, not interlaced PNG.  A false checksum or another kind of file raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + content)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("cut off, or not 8-bit greyscale")
    w, h = head[:2]
    return unfilter(np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w + 1))


@lru_cache(maxsize=256)
def _basis(n: int, k: int) -> np.ndarray:
    """First k rows of the cosine transform over n samples."""
    f, x = np.arange(k)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * f * (2 * x + 1) / (2 * n)) / n


def low_frequencies(pixels: np.ndarray, k: int = 8) -> np.ndarray:
    """The k*k lowest coefficients of the two-way cosine transform: k by k, or all rows of a picture of fewer than k rows by
    as many columns as make k*k (a row of pixels has no more than one frequency downwards)."""
    h, w = pixels.shape
    down = min(h, k)
    across = min(w, -(-k * k // down))
    right = _basis(w, across).T
    if h <= 4096:
        return _basis(h, down) @ (pixels.astype(np.float64) @ right)
    out = np.zeros((down, across))  # a tall picture goes by bands, so that memory stays bounded
    f = np.arange(down)[:, None]
    for at in range(0, h, 4096):
        part = pixels[at : at + 4096].astype(np.float64) @ right
        out += np.cos(np.pi * f * (2 * np.arange(at, at + len(part))[None, :] + 1) / (2 * h)) / h @ part
    return out


def cosine_hash(pixels: np.ndarray, k: int = 8) -> str:
    """k*k bits as hex, in row order: which of the ``low_frequencies`` are above the median of all but the mean; the mean's own bit is 0."""
    low = np.round(low_frequencies(pixels, k).ravel()[: k * k], 6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            part = pdf.iloc[at : at + 500]
            raw = [payload(t) for t in part["text"]]
            out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array})
            out["n_bytes"] = [len((t or "").encode()) for t in part["text"]]
            out["media"] = [write_png(np.frombuffer(r, np.uint8).reshape(-1, WIDTH)) for r in raw]
            yield out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            part = pdf.iloc[at : at + 500]
            pixels = [read_png(m) for m in part["media"]]
            yield part.assign(payload=[p.tobytes() for p in pixels], feature=[cosine_hash(p) for p in pixels])


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded UTF-8 as the pixels of a PNG, row by row.

    A null text is an empty one (one row of spaces).  Null and repeated doc_ids pass through; other columns are
    left out; an empty table gives an empty one.  A row's work is bounded by its own text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInPandas(_write, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds payload (the pixels read back) and feature (the cosine hash) to doc_id, n_bytes, media."""
    return media.select("doc_id", "n_bytes", "media").mapInPandas(_read, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Lengths, digests and features of all documents, from the PNG column as it is read back from its table."""
    read = read_media(stage(write_media(table(spark, sf_dir, "documents")), "media", "none"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
