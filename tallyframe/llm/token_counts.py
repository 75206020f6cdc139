"""Exact token counts of every prefix by dynamic programming.

Inside a piece, the encoding of a prefix ends with the one token whose pair with the last token of the rest
is stable, that is, encodes to just these two.  So one pass over a piece gives the token count of each of its
prefixes, from counts of shorter ones, and no prefix is encoded.  Pieces follow each other; three places need
care, since a cut there changes the pieces: contractions ('re cut to 'r), the last character of a run of white
space (which joins the run when nothing follows), and special strings (ordinary text until complete).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table
from .pieces import WHITE, Chunks, load_tokenizer, once, safe, tokenizer_path

LIMIT = 1024
#: The pieces of a byte-level BPE of this family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte: itself if it is printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts of texts for one tokenizer file."""

    def __init__(self, path: str, memo: int = 1_000_000):
        import regex

        self.tok = load_tokenizer(path)
        self.vocab = self.tok.get_vocab(with_added_tokens=False)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.letters = byte_letters()
        self.stable: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[int, int]] = {}
        self.memo_limit = memo
        self._run = ""
        self.cache = Chunks(lambda cs: [self.steps(" " + c).tobytes() for c in cs])

    def _stable(self, a: str, b: str) -> bool:
        got = self.stable.get((a, b))
        if got is None:
            if len(self.stable) > self.memo_limit:
                self.stable.clear()
            got = self.stable[a, b] = [t.value for t in self.tok.model.tokenize(a + b)] == [a, b]
        return got

    def piece(self, letters: str) -> list[int]:
        """Token count of each prefix of a piece, given as byte letters."""
        vocab, memo, stable = self.vocab, self.memo, self._stable
        if len(memo) > self.memo_limit:
            memo.clear()
        last, counts = [0], [0]  # length of the last token, count
        for i in range(1, len(letters) + 1):
            got = memo.get(key := letters[:i]) if i <= 24 else None
            if got is None:
                # likeliest first: the last token grown by one byte, a token of one byte, then all others
                grown = i - 1 - last[i - 1]
                for k in (grown, i - 1, *range(i - 2, -1, -1)):
                    t = letters[k:i]
                    if t in vocab and (k == 0 or stable(letters[k - last[k] : k], t)):
                        got = (i - k, counts[k] + 1)
                        break
                if i <= 24:
                    memo[key] = got
            last.append(got[0])
            counts.append(got[1])
        return counts

    def _counts(self, piece: str) -> list[int]:
        """Token count of each prefix of a piece, by character."""
        raw = piece.encode()
        by_byte = self.piece("".join(map(self.letters.__getitem__, raw)))
        if len(raw) == len(piece):
            return by_byte[1:]
        return [by_byte[e] for e in accumulate(len(c.encode()) for c in piece)]

    def steps(self, text: str) -> array:
        """What each character adds to the token count of the prefix that it ends; text without special strings."""
        out = array("i")
        previous, patch = "", 0
        for piece in self.pieces.findall(text):
            counts = self._counts(piece)
            if piece in CONTRACTIONS:
                counts[0] = 1
                if len(piece) == 3:
                    counts[1] = 1 + self._counts(piece[1])[0]
            steps = [b - a for a, b in zip([patch, *counts], counts, strict=False)]  # undoes what a cut there had joined
            patch = 0
            if previous in WHITE and piece[0] in WHITE:
                # a cut after the first character of this piece joins it to the run of white space before
                patch = self._counts(self._run + piece[0])[-1] - self._counts(self._run)[-1] - counts[0]
                steps[0] += patch
                if len(steps) > 1:
                    steps[1] -= patch
                    patch = 0
            out.extend(steps)
            previous = piece[-1]
            if previous in WHITE:
                self._run = piece
        return out

    def _plain(self, text: str, get=None) -> np.ndarray:
        chunks = text.split(" ")
        get = get or self.cache.learn(chunks[1:])
        if not chunks[0] or safe(chunks[0]):
            try:
                return np.frombuffer(self.steps(chunks[0]).tobytes() + b"".join(map(get, chunks[1:])), np.int32)
            except TypeError:  # a chunk beside other white space
                pass
        return np.frombuffer(self.steps(text), np.int32)

    def prefix(self, text: str, get=None) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ... characters.  ``get``: the lookup, if all chunks are learned."""
        if self.split is None or not any(s in text for s in self.special):
            out = np.zeros(len(text) + 1, np.int32)
            np.cumsum(self._plain(text, get), out=out[1:])
            return out
        parts, base = [np.zeros(1, np.int64)], 0
        segment = ""
        for i, part in enumerate(self.split.split(text)):
            if i % 2 == 0:
                segment = part
                if part:
                    parts.append(base + np.cumsum(self._plain(part)))
            else:
                here = np.cumsum(self._plain(segment + part[:-1]))
                parts.append(base + here[len(segment) :])
                base += (int(np.cumsum(self._plain(segment))[-1]) if segment else 0) + 1
                parts.append(np.array([base]))
                segment = ""
        return np.concatenate(parts)


def pack_counts(counts: np.ndarray) -> bytes:
    """The counts of the prefixes of 0, 1, 2 ... characters as what each character adds (i2, or i4 for a long special string), compressed."""
    import zstandard

    steps = np.diff(counts)
    kind = "<i2" if not len(steps) or np.abs(steps).max() < 1 << 15 else "<i4"
    return kind[1:].encode() + zstandard.ZstdCompressor(level=1).compress(steps.astype(kind).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 ... characters."""
    import zstandard

    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), "<" + data[:2].decode())
    out = np.zeros(len(steps) + 1, np.int64)
    np.cumsum(steps, out=out[1:])
    return out


def cut_within(counts: np.ndarray, limit: int) -> int:
    """Characters of the longest prefix of at most ``limit`` tokens (counts may fall, so the last one that fits)."""
    return len(counts) - 1 if counts[-1] <= limit else int(np.flatnonzero(counts <= limit)[-1])


def _run(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = once(PrefixCounter, path)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                texts = [t or "" for t in part["text"]]
                get = counter.cache.learn(c for t in texts for c in t.split(" ")[1:])
                tables = [counter.prefix(t, get) for t in texts]
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array})
                out["n_bytes"] = [len(t.encode()) for t in texts]
                out["prefix_counts"] = [pack_counts(p) for p in tables]
                yield out

    return run


def prefix_tables(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, prefix_counts: the token counts of all prefixes of each text (see ``pack_counts``).

    Counts are those of the tokenizer without added begin or end tokens.  A null text counts as empty (0 tokens).
    Rows are independent: nulls and repeats in doc_id and other columns are harmless, an empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInPandas(_run(tokenizer or tokenizer_path()), "doc_id long, n_bytes long, prefix_counts binary")


def answers(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, cut_chars (characters of the longest prefix of at most ``limit`` tokens), from ``prefix_tables``
    alone, without encoding anything again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = map(unpack_counts, pdf["prefix_counts"])
            found = [(int(c[-1]), cut_within(c, limit)) for c in counts]
            yield pdf[["doc_id", "n_bytes"]].assign(n_tokens=[n for n, _ in found], cut_chars=[c for _, c in found])

    return tables.select("doc_id", "n_bytes", "prefix_counts").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, cut_chars long")


def count_within(prefix_counts: bytes, start: int, stop: int) -> int:
    """How many tokens the prefix of ``stop`` characters has more than that of ``start``."""
    p = unpack_counts(prefix_counts)
    return int(p[stop]) - int(p[start])


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, answered from the prefix tables as they are read back from the shared folder."""
    stored = stage(prefix_tables(table(spark, sf_dir, "documents")), "prefixes", "none")
    return answers(stored).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "cut_chars")
