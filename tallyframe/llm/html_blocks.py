"""HTML pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np

#: Elements that end a block of text where they start and end; fixed by the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not text of the page; formulas, and what stands in for scripts and objects, are read like other text.
RAW = "script style template iframe svg annotation annotation-xml textarea select title audio video canvas"
#: A start tag of the first closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open one of these is not closed by a start tag outside of it.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # a foreign element that closes itself; a slash at the end of an unquoted value does not close it
    r"|<(?:svg|math)(?=[\s/])(?:\"[^\"]*\"|'[^']*'|=\s*+(?:[^\s>\"'][^\s>]*+)?+|[^>\"'=/]|/(?!>))*+/>"
    rf"|<(?P<raw>{'|'.join(RAW.split())})(?![\w:-])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][\w:-]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


PATH_DIM, WORD_DIM, PLAIN_DIM = 160, 256, 8
DIM = PATH_DIM + WORD_DIM + PLAIN_DIM
_known: dict[str, tuple[int, float]] = {}


def _bucket(key: str, dim: int) -> tuple[int, float]:
    got = _known.get(key)
    if got is None:
        if len(_known) > 200_000:
            _known.clear()
        h = zlib.crc32(key.encode())
        got = _known[key] = (h % dim, 1.0 if h & (1 << 20) else -1.0)
    return got


class Element:
    """An open element: its tag, the words of its class, id, role and itemprop, and what it is in."""

    __slots__ = ("tag", "words", "parent", "depth")

    def __init__(self, tag: str, words: str, parent: Element | None):
        self.tag, self.words, self.parent, self.depth = tag, words, parent, parent.depth + 1 if parent else 1


@dataclass
class Block:
    text: str
    inside: Element | None  # the innermost open element
    hashed: np.ndarray  # the hashed tags and words of all open elements, each once
    linked: int  # characters of the text inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Tag and words of each open element, outermost first."""
        out, e = [], self.inside
        while e is not None:
            out.append(f"{e.tag} {e.words}".strip())
            e = e.parent
        return tuple(out[::-1])


def _words(attrs: str) -> str:
    found = []
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").replace("-", " ").replace("_", " ")
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        found += _NAME.findall(value)
    return " ".join(found)


class _Stack:
    """The open elements.  Every step takes time in proportion to what it opens or closes, however deep the page is."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.at: dict[str, list[int]] = {}  # tag -> places in the stack
        self.blocks: list[int] = []  # places of the elements that end a block of text
        self.known: dict[str, int] = {}  # tag or word -> how many open elements have it
        self.hashed = np.zeros(PATH_DIM, np.int16)
        self.shared: np.ndarray | None = None  # a copy of it, good until the next change

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _count(self, e: Element, step: int) -> None:
        for key in (e.tag, *e.words.split()):
            n = self.known.get(key, 0)
            if n + step:
                self.known[key] = n + step
            else:
                del self.known[key]
            if not n or not n + step:
                j, s = _bucket("p" + key, PATH_DIM)
                self.hashed[j] += int(s) * step
                self.shared = None

    def push(self, tag: str, words: str) -> None:
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(Element(tag, words, self.open[-1] if self.open else None))
        self._count(self.open[-1], 1)

    def pop_to(self, place: int) -> None:
        while len(self.open) > place:
            e = self.open.pop()
            self.at[e.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            self._count(e, -1)

    def path(self) -> np.ndarray:
        if self.shared is None:
            self.shared = self.hashed.copy()
        return self.shared


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order; broken markup is read as far as it goes, never refused."""
    page = page or ""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, stack.open[-1] if stack.open else None, stack.path(), min(linked, len(text))))
            parts.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if stack.at.get("a"):
                linked += len(s)

    def close(place: int) -> None:
        if stack.blocks and stack.blocks[-1] >= place:
            flush()
        stack.pop_to(place)

    # a tag needs its bracket: behind the last one only a comment can start
    at, end = 0, page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, end):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if at == end and (m[0].startswith("<!--") and not m[0].endswith("-->") or m["raw"] and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I)):
                at = len(page)  # never closed
            continue
        if m["end"] or m["end2"]:
            place = stack.last((name,))
            if name in BLOCKS and place < 0:
                flush()
            if place >= 0 and (name in BLOCKS or not stack.blocks or stack.blocks[-1] < place):
                close(place)
            continue
        if name == "br":
            text(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            closes = CLOSES.get(name, set()) | ({"p"} if name != "option" else set())
            bound = stack.blocks[-1] if closes == {"p"} and stack.blocks else stack.last(SCOPE.get(name, ()))
            while (place := stack.last(closes)) >= max(bound, 0):
                close(place)
                if stack.open and stack.open[-1].tag not in closes:
                    break
        attrs = m["attrs"] or m["attrs2"] or ""
        stack.push(name, _words(attrs) if attrs else "")
    tail = page[at:]
    text(tail[: tail.index("<!--")] if "<!--" in tail else tail)
    flush()
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """One row a block: hashed tag path, hashed words, and plain measures (length, links, place, punctuation)."""
    x = np.zeros((len(found), DIM), np.float32)
    for i, b in enumerate(found):
        x[i, :PATH_DIM] = b.hashed
        near = b.inside
        for tag in {near.tag, near.parent.tag} if near and near.parent else {near.tag} if near else ():
            j, s = _bucket("p^" + tag, PATH_DIM)
            x[i, j] += s
        words = b.text.lower().split(" ")
        step = 1 / np.sqrt(len(words))
        for w in words:
            j, s = _bucket("w" + w.strip(".,;:!?()"), WORD_DIM)
            x[i, PATH_DIM + j] += s * step
        n = len(b.text)
        x[i, -PLAIN_DIM:] = (np.log1p(n) / 4, b.linked / n, len(words) / n * 4, b.text[-1] in ".!?…\"”", i / len(found), 1.0 if i == 0 else 0.0, 1.0 if i == len(found) - 1 else 0.0, (near.depth if near else 0) / 10)
    return x
