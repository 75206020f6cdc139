"""Encoding and decoding by a BPE of words, with ranks held in one array.

A text is cut at spaces and line feeds, where no piece and no normal form goes across; what lies between repeats, so each
task makes the ids of a chunk once.  A chunk goes through the file's own normaliser and pre-tokenizer (one of
ASCII letters only where they are not known to leave it one word), and each word that they give is merged here: an array holds the boundaries of its parts and, beside each, the rank of the merge of the part
there with the next one.  The least rank is found by a scan, its boundary deleted, and the two ranks beside it made anew.
A scan a merge suits short words; a long one (``SHORT``) keeps the same array under a heap.  New words of one length are
merged together: a row each of two tables, tokens at the boundaries and ranks beside them, which lose a column a merge.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .pieces import load_tokenizer, once, tokenizer_path

#: Parts up to which a word is merged by scans.
SHORT = 64
#: Chunks and words that a task keeps, characters of the longest chunk that is kept, and bytes of the texts that are encoded at once.
CHUNKS, WORDS, KEPT, GROUP = 100_000, 60_000, 64, 2_000_000
#: Code points of the letters that stand for bytes are below this.
LETTERS = 1 << 10
_NONE = 1 << 60
#: Rules under which a chunk of ASCII letters is one word: its own letters, or their lower case.
_NORMAL = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class TokenNames:
    """The tokens of a tokenizers file by id; all that decoding needs."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        ids = made["model"]["vocab"] | {t["content"]: t["id"] for t in made["added_tokens"]}
        self.names: list[str | None] = [None] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.names[i] = token

    def decode(self, ids):
        """Texts of an Arrow array of lists of ids, none and special ones included: the tokens in a row, by spaces (the file has no
        decoder), as the library does.  Numbers that are no id are left out."""
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = ids.flatten().to_numpy(zero_copy_only=False)
        good = (flat >= 0) & (flat < len(self.names))
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))])
        bounds = np.concatenate([[0], np.cumsum(good)])[bounds]
        tokens = pa.array(self.names).take(pa.array(flat[good]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens), " ")


class WordBpe(TokenNames):
    """A tokenizers file of kind BPE without dropout, byte fallback and continuing prefix."""

    def __init__(self, path: str, limit: int = CHUNKS):
        import json

        import regex

        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE of words: {model['type']} {odd}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self._tables(pairs)
        self.tok = load_tokenizer(path)
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = regex.compile("|".join([r"\s", *map(regex.escape, self.special)]))
        rules = [(r or {}).get(k, [r] if r else []) for r, k in ((made["normalizer"], "normalizers"), (made["pre_tokenizer"], "pretokenizers"))]
        #: Whether the file's rules leave a chunk of ASCII letters one word, and lower its case.
        self.letters_stay = all(r in _NORMAL for r in rules[0]) and rules[1] == [_SPLIT, _BYTES] and not any(t.isalpha() for t in self.special)
        self.lower = {"type": "Lowercase"} in rules[0]
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self._forget()

    def _tables(self, pairs: list[tuple[str, str]]) -> None:
        """What ``_together`` looks up: ids of letters inside and at the end of a word by code point (-1: none), the pairs of ids
        in order with their ranks, and the id that each rank makes.  No pairs if a part of one is no token."""
        get = self.vocab.get
        self.letters = np.array([[get(chr(c), -1) for c in range(LETTERS)], [get(chr(c) + self.suffix, -1) for c in range(LETTERS)]], np.int64)
        ids = np.array([(get(a, -1), get(b, -1), get(a + b, -1)) for a, b in pairs], np.int64).reshape(-1, 3)
        whole = len(ids) > 0 and len(self.ranks) == len(pairs) and bool((ids >= 0).all())
        self.many = len(self.names)
        order = np.argsort(ids[:, 0] * self.many + ids[:, 1], kind="stable")
        self.pairs, self.rank_of, self.makes = (ids[:, 0] * self.many + ids[:, 1])[order] if whole else None, order.astype(np.int64), ids[:, 2]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.many + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank_of[at], _NONE)

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of one length as 32-bit integers; words with a letter that is no token are left out."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
        inside = np.minimum(points, LETTERS - 1)
        parts = np.concatenate([self.letters[0][inside[:, :-1]], self.letters[1][inside[:, -1:]]], axis=1)
        of = np.flatnonzero((parts >= 0).all(1) & (points < LETTERS).all(1))
        parts, made = parts[of], {}
        rank = self._rank(parts[:, :-1], parts[:, 1:])
        while len(of):
            width, row = parts.shape[1], np.arange(len(of))
            at = rank.argmin(1) if width > 1 else np.zeros(len(of), np.int64)
            least = rank[row, at] if width > 1 else np.full(len(of), _NONE)
            done = least == _NONE
            if done.any():
                data = parts[done].astype(np.int32).tobytes()
                made.update((words[k], data[4 * width * i : 4 * width * (i + 1)]) for i, k in enumerate(of[done].tolist()))
                of, parts, rank, at, least = of[~done], parts[~done], rank[~done], at[~done], least[~done]
                row = np.arange(len(of))
            if not len(of):
                break
            parts[row, at] = self.makes[least]
            column = np.arange(width - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= at[:, None]), 1)
            for some, left in ((at < width - 2, at), (at > 0, at - 1)):
                r, c = row[some], left[some]
                rank[r, c] = self._rank(parts[r, c], parts[r, c + 1])
        return made

    def _learn(self, words) -> None:
        """Keeps the ids of all of these short words."""
        most = min(KEPT, SHORT)
        short = {w for w in words if 0 < len(w) <= most}
        if len(self.words) >= WORDS:
            self.words.clear()
        if self.pairs is None:
            return
        by: dict[int, list[str]] = {}
        for w in short.difference(self.words):
            by.setdefault(len(w), []).append(w)
        for same in by.values():
            self.words.update(self._together(same))

    def _forget(self) -> None:
        """Known chunks, and where their ids stand in ``flat``."""
        self.known: dict[str, int] = {}
        self.at, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def word(self, letters: str) -> list[int]:
        """Ids of a word, given as its byte letters."""
        units = [*letters]
        units[-1] += self.suffix
        if len(units) > SHORT:
            return self._long(units)
        word, get = letters + self.suffix, self.ranks.get
        starts = [*range(len(letters)), len(word)]  # boundaries: part i is word[starts[i] : starts[i + 1]]
        rank = [get(pair, _NONE) for pair in zip(units, units[1:], strict=False)]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)
            del starts[i + 1], rank[i]
            end = starts[i + 1]
            part = word[starts[i] : end]
            if i < len(rank):
                rank[i] = get((part, word[end : starts[i + 2]]), _NONE)
            if i:
                rank[i - 1] = get((word[starts[i - 1] : starts[i]], part), _NONE)
        return [self.vocab[word[a:b]] for a, b in zip(starts, starts[1:], strict=False)]

    def _long(self, units: list[str]) -> list[int]:
        """The same merges in the same order, the least rank kept by a heap."""
        n, ranks = len(units), self.ranks
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = [ranks.get(pair, _NONE) for pair in zip(units, units[1:], strict=False)] + [_NONE]
        heap = [(r, i) for i, r in enumerate(rank) if r != _NONE]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if rank[i] != r:  # made anew since
                continue
            j = after[i]
            units[i] += units[j]
            rank[j], units[j] = _NONE, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    rank[k] = ranks.get((units[k], units[after[k]]), _NONE) if after[k] < n else _NONE
                    if rank[k] != _NONE:
                        heappush(heap, (rank[k], k))
        return [self.vocab[u] for u in units if u]

    def _packed(self, letters: str) -> bytes:
        """Ids of a word as 32-bit integers; those of short words are kept."""
        got = self.words.get(letters)
        if got is None:
            got = array("i", self.word(letters)).tobytes()
            if len(letters) <= KEPT:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[letters] = got
        return got

    def _pieces(self, text: str) -> tuple[str, list]:
        """(normal form, words with their bounds in it)."""
        normal = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return normal, self.tok.pre_tokenizer.pre_tokenize_str(normal) if self.tok.pre_tokenizer else [(normal, (0, len(normal)))]

    def chunk(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers; the special strings in it are tokens of their own."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                out += [self._packed(letters) for letters, _ in self._pieces(part)[1] if letters]
        return b"".join(out)

    def _many(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk: those without white space and special strings go through the file's rules as one text, by spaces."""
        odd = self._odd(chunks)
        some = [c for i, c in enumerate(chunks) if i not in odd] if odd else chunks
        normal, words = self._pieces(" ".join(some))
        ends = np.append(np.flatnonzero(np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32) == 32), len(normal))
        if len(ends) != len(some):
            return [self.chunk(c) for c in chunks]
        letters = [w for w, _ in words]
        bounds = np.searchsorted(np.fromiter((at[0] for _, at in words), np.int64, len(words)), np.append(0, ends + 1)).tolist()
        made = self._whole(letters)
        joined = [made[a] if b - a == 1 else b"".join(made[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        if not odd:
            return joined
        rest = iter(joined)
        return [self.chunk(c) if i in odd else next(rest) for i, c in enumerate(chunks)]

    def _whole(self, words: list[str]) -> list[bytes]:
        """Ids of each word; short ones are learned together."""
        self._learn(words)
        made = [*map(self.words.get, words)]
        return [self._packed(w) if m is None else m for w, m in zip(words, made, strict=True)] if None in made else made

    def _odd(self, chunks: list[str]) -> set[int]:
        """Which chunks are empty or have white space or special strings; all are searched as one text, by a character that is in neither."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        found = [m.start() for m in self.odd.finditer("\0".join(chunks))]
        return {*np.flatnonzero(sizes == 0).tolist(), *np.searchsorted(np.cumsum(sizes + 1), np.array(found, np.int64), side="right").tolist()}

    def _places(self, chunks: list[str]) -> np.ndarray:
        """The place of each of these different chunks among the known ones; new ones are learned."""
        if len(self.known) > self.limit:
            self._forget()
        new = [c for c in chunks if c not in self.known]
        whole = [self.letters_stay and c.isascii() and c.isalpha() for c in new]
        alone, rest = [*compress(new, whole)], [c for c, w in zip(new, whole, strict=True) if not w]
        new = alone + rest
        made = [m for at in range(0, len(alone), 20_000) for m in self._whole([c.lower() for c in alone[at : at + 20_000]] if self.lower else alone[at : at + 20_000])]
        made += [m for at in range(0, len(rest), 20_000) for m in self._many(rest[at : at + 20_000])]
        if new:
            self.known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            size = np.array([len(m) // 4 for m in made], np.int64)
            self.at, self.size = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size]), np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), np.int32)])
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has); ``texts`` is an Arrow array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = parts.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False)
        short = pc.less_equal(pc.utf8_length(coded.dictionary), KEPT).to_numpy(zero_copy_only=False)
        place = np.full(len(chunks), -1, np.int64)
        place[short] = self._places(chunks[short].tolist())
        at, size, flat = self.at[place], self.size[place], self.flat
        for k in np.flatnonzero(place < 0).tolist():  # long ones are made and forgotten
            ids = np.frombuffer(self.chunk(chunks[k]), np.int32)
            at[k], size[k] = len(flat), len(ids)
            flat = np.concatenate([flat, ids])
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - (ends - n), n)]
        return ids, np.diff(np.concatenate([[0], ends])[parts.offsets.to_numpy()])


def _groups(sizes, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Runs of rows whose ``sizes`` (an Arrow array) add up to about ``most``."""
    upto = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(upto):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most)))
        yield start, stop
        start = stop


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of each text, as the tokenizers library gives them without added special tokens, truncation and
    padding; special strings inside a text are their tokens.

    A null text counts as empty, which has no ids.  Rows are independent: nulls and repeats in doc_id are kept, an empty
    table stays empty, other columns are not read.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = once(WordBpe, path)
        for batch in batches:
            for start, stop in _groups(pc.binary_length(batch.column(1))):
                part = batch.slice(start, stop - start)
                ids, n = coder.encode(part.column(1))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ids: str = "ids", name: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Adds ``name``: the text of each row's ids, special ones included.  Null ids give null, none an empty text."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    kept = rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        import pyarrow.compute as pc

        coder = once(TokenNames, path)
        for batch in batches:
            for start, stop in _groups(pc.list_value_length(batch.column(len(kept)))):
                part = batch.slice(start, stop - start)
                lists = part.column(len(kept))
                text = coder.decode(lists)
                if lists.null_count:
                    text = pc.if_else(lists.is_valid(), text, None)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], names=[*[f"c{i}" for i in range(len(kept))], "text"])

    wide = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(ids).cast("array<int>").alias("ids"))
    schema = wide.schema
    made = wide.mapInArrow(run, type(schema)([*schema.fields[:-1]]).add("text", "string"))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("text").alias(name))


def op13_word_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts that they decode to, as digests."""
    made = decode(encode(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
