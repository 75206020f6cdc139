"""Byte-level BPE by cached chunks: exact, and several times faster than encoding whole texts.

A byte-level BPE first cuts a text into pieces by a fixed pattern and merges inside pieces only.  Cutting a
text at a space that has no white space beside it is always such a boundary, and so are both sides of a line feed
between other characters; so a text's ids are those of its chunks in a row.  Chunks repeat; each worker keeps what it made of the ones it met, in two
generations of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

#: Chunks that a worker keeps (``Chunks``: in each of two generations).
CACHE = 500_000
#: The characters of class White_Space, fixed by Unicode.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def safe(chunk: str) -> bool:
    """Whether a text may be cut at the spaces around this chunk."""
    return bool(chunk) and chunk[0] not in WHITE and chunk[-1] not in WHITE


class Chunks:
    """chunk -> bytes made of it.  ``make`` takes the list of new chunks of a batch; None marks an unsafe one."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int = CACHE):
        self.make, self.limit = make, limit
        self.now: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def learn(self, chunks) -> Callable[[str], bytes | None]:
        """Make what is new among ``chunks``; returns the lookup, good until the next call."""
        if len(self.now) >= self.limit:
            self.old, self.now = self.now, {}
        good = []
        for c in set(chunks).difference(self.now):
            if (v := self.old.get(c)) is not None:
                self.now[c] = v
            elif safe(c):
                good.append(c)
            else:
                self.now[c] = None
        self.now.update(zip(good, self.make(good), strict=True))
        return self.now.__getitem__


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each new chunk once.

    A line feed between other characters is a piece of its own, so chunks are led by a space or a line feed.  New chunks
    are encoded as one text; each starts at its only token that begins with a space or a line feed.
    """

    #: Characters of text whose chunks are learned at once.
    GROUP = 2_000_000

    def __init__(self, path: str, limit: int = CACHE):
        self.tok = load_tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.leads = np.zeros(self.tok.get_vocab_size(), bool)
        # fixed values: the letters of the bytes 32 and 10 in byte-level vocabularies
        self.leads[[i for t, i in self.tok.get_vocab().items() if t[0] in "\u0120\u010a"]] = True
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        """The known chunks, and where their ids stand in ``flat`` (size -1: not safe to cut at)."""
        import pyarrow as pa

        self.names = pa.array([], pa.large_string())
        self.at, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, how many each has)."""
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(chunks), 20_000):
            part = [c if c[0] == "\n" else " " + c for c in chunks[at : at + 20_000]]
            got = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.leads[got])
            if len(starts) == len(part) and starts[0] == 0:
                sizes.append(np.diff(np.append(starts, len(got))))
            else:  # not a vocabulary of this family
                each = self._batch(part)
                got, n = np.frombuffer(b"".join(each), "<u4"), np.array([len(e) // 4 for e in each])
                sizes.append(n)
            ids.append(got)
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, chunks) -> np.ndarray:
        """The place of each of these distinct chunks (an Arrow array) among the known ones; new ones are learned."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.names) > self.limit:
            self._forget()
        place = pc.fill_null(pc.index_in(chunks, value_set=self.names), -1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            fresh = chunks.filter(pa.array(new))
            names = fresh.to_pylist()
            good = np.array([safe(c[1:] if c[:1] == "\n" else c) for c in names], bool)
            ids, sizes = self._ids([c for c, g in zip(names, good.tolist(), strict=True) if g])
            size = np.full(len(names), -1, np.int64)
            size[good] = sizes
            place[new] = len(self.names) + np.arange(len(names))
            held = np.maximum(size, 0)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(held) - held])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
            self.names = pa.concat_arrays([self.names, fresh])
        return place

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[str] = []
        n = 0
        for t in texts:
            group.append(t)
            n += len(t)
            if n >= self.GROUP:
                out += self._group(group)
                group, n = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[str]) -> list[bytes]:
        """Chunks are cut, numbered and looked up by Arrow, and their ids put together by numpy."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = [any(s in t for s in self.special) for t in texts]
        parts = pc.split_pattern(pa.array(["" if w else t.replace("\n", " \n") for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        heads = parts.values.take(pa.array(bounds[:-1])).to_pylist()
        first = self._batch(["" if h and not safe(h) else h for h in heads])
        which = self._places(coded.dictionary)[np.delete(coded.indices.to_numpy(), bounds[:-1])]  # without the heads
        bounds = bounds - np.arange(len(bounds))
        n = np.maximum(self.size[which], 0)
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[which] - (ends - n), n)].tobytes()
        ends = np.concatenate([[0], ends])[bounds] * 4
        bad = np.concatenate([[0], np.cumsum(self.size[which] < 0)])[bounds].tolist()
        out = []
        for k, (t, head, a, b) in enumerate(zip(texts, heads, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if whole[k] or bad[k] != bad[k + 1] or head and not safe(head):  # a chunk beside other white space, or a special string
                out += self._batch([t])
            else:
                out.append(first[k] + ids[a:b])
        return out


_made: dict = {}


def once(kind: type, path: str):
    """One encoder of a kind a worker process and file."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]
