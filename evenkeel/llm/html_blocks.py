"""HTML main text by a recurrent block labeller.

A page is read into its leaf sequence: runs of text between block boundaries, each with the path of elements it is in.
A block is described by hashed vectors of its tag path (names, classes, ids, roles), hashed vectors of its words, and
a few shares (links, length, place in the page). A bidirectional LSTM in numpy reads the whole sequence of vectors, so
that every block is labelled in the context of the document; blocks labelled as content are the main text.

What is never text of a page (scripts, styles, templates, the head, controls of forms) is not read at all. The weights
are trained by ``html_training`` on pages that it makes up, with boilerplate of many kinds.

Defined cases: null and empty pages have an empty text; pages without any element are one block; unclosed and stray
tags are read as browsers do for block and inline elements. An element that is not read ends with what is around it, and
is read over if the page has no end tag for it; only a script, a style sheet, a comment or a quoted value without an end
reaches to the end of the page, as in browsers. Repeated rows are kept; empty tables give empty results; input columns
other than those named are not carried along.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from importlib import resources
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG_SIZE, WORD_SIZE, SHARES = 64, 32, 10
INPUT = TAG_SIZE + WORD_SIZE + SHARES
WEIGHTS = Path(__file__).with_name("html_weights.npz")
#: Pages whose blocks are labelled at a time, and blocks read per step; long pages go in smaller batches.
PAGES, STEPS = 64, 1 << 14

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " map math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never read: up to their end tag whatever stands between, or as far as their element goes. None of them breaks a line.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNREAD = frozenset("head template svg annotation annotation-xml object audio video canvas select datalist option optgroup".split())
#: A head holds these only; anything else begins the body.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: An element that is opened closes open ones of these names, as browsers do.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",),
}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A button is text where words are, else a control.
AMONG_WORDS = frozenset(("p", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "caption", *HEADINGS))
#: End tags of elements inside don't reach beyond these.
SCOPE = frozenset("td th caption table template object".split())
P_SCOPE = frozenset("td th li div article section main body button".split()) | UNREAD
TABLE = frozenset("table thead tbody tfoot tr td th caption template object html body".split())
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAMES = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+|©")
ENDS, PAUSES, CAPITALS, DIGITS = re.compile(r"[.!?]"), re.compile(r"[,;:]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


@dataclass
class Reader:
    """Leaf blocks of a page, from one pass over its tags."""

    stack: list[tuple[str, str]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    unread: int = 0
    blocks: list[Block] = field(default_factory=list)

    def cut(self) -> None:
        """The end of a block, unless what is open is not read anyway."""
        if self.parts and not self.unread:
            self._emit(len(self.stack))

    def _emit(self, depth: int) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(tuple(d for _, d in self.stack[:depth] if d), text, self.linked))
        self.parts, self.linked = [], 0

    def add(self, text: str) -> None:
        if text and self.unread and self.stack[-1][0] == "head" and not text.isspace():
            self._drop(len(self.stack) - 1)  # words begin the body
        if text and not self.unread:
            text = unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len(text)

    def _drop(self, at: int) -> None:
        if self.unread:
            hidden = [i for i, (_, d) in enumerate(self.stack) if not d]
            if at < hidden[0] and self.parts:  # a block ends that has something unread in it
                self._emit(hidden[0])
            self.unread -= sum(i >= at for i in hidden)
        del self.stack[at:]

    def _pop(self, names: tuple[str, ...], stop: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in names:
                self._drop(i)
                return
            if name in stop:
                return

    def skip(self, name: str) -> None:
        """An element that isn't read, and doesn't end the block that it is in."""
        if name in CLOSES:
            self._pop(CLOSES[name], frozenset(("select", "datalist")))
        self.stack.append((name, ""))
        self.unread += 1

    def open(self, name: str, attributes: str) -> None:
        if self.unread and self.stack[-1][0] == "head" and name not in IN_HEAD:
            self._drop(len(self.stack) - 1)
        if name in ("br", "wbr"):
            self.parts.append(" " if name == "br" and not self.unread else "")
            return
        if name == "button" and not (self.stack and self.stack[-1][0] in AMONG_WORDS):
            self.cut()
            self.skip(name)
            return
        if name in INLINE or name == "button":
            if name == "a":
                self.links = 1
            return
        if name in VOID and name != "hr":
            return
        self.cut()
        if name in CLOSE_P:
            while self.unread and self.stack[-1][0] in ("option", "optgroup"):
                self._drop(len(self.stack) - 1)
            self._pop(("p",), P_SCOPE)
        if name == "hr":
            return
        if name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._drop(len(self.stack) - 1)
        if name in CLOSES and name != "p":
            self._pop(CLOSES[name], frozenset(("ul", "ol", "dl", "table")))
        self.links = 0
        self.stack.append((name, described(name, attributes)))

    def close(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.links = 0
            return
        if name == "br":
            self.parts.append("" if self.unread else " ")
        if name in VOID:
            return
        names = HEADINGS if name in HEADINGS else (name,)
        if any(n in names for n, _ in self.stack):
            if name not in UNREAD:
                self.cut()
            self._pop(names, frozenset() if name in TABLE else SCOPE)
        elif name == "p":
            self.cut()


@lru_cache(maxsize=4096)
def described(name: str, attributes: str) -> str:
    """An element and the words of its class, id and role."""
    found = []
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if key.lower() == "style":
                value = "hidden" if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else ""
            elif key.lower() == "hidden":
                value = "hidden"
            found += NAMES.findall(value)
    return " ".join([name, *found[:12]])


def blocks(html: str) -> list[Block]:
    reader, at, last = Reader(), 0, {}
    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        reader.add(html[at : m.start()])
        at = m.end()
        if not m[2] or html[at - 1] != ">":
            continue
        name = m[2].lower()
        if m[1]:
            reader.close(name)
        elif name in RAW:  # its end is the next end tag of that name, whatever stands between
            end = _end_tag(name).search(html, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(html)
        elif name in UNREAD or name == "button":
            if name not in last:
                last[name] = max((e.start() for e in _end_tag(name).finditer(html)), default=-1)
            ends = last[name] > at or name in ("head", "option", "optgroup")
            if name == "button" and ends:
                reader.open(name, m[3])
            elif ends and not m[3].endswith("/"):
                reader.skip(name)
        else:
            reader.open(name, m[3])
    reader.add(html[at:])
    reader.cut()
    return reader.blocks


@lru_cache(maxsize=64)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I)


@lru_cache(maxsize=1 << 16)
def _place(kind: str, word: str, size: int) -> tuple[int, int]:
    code = zlib.crc32(f"{kind}:{word}".encode())
    return code % size, 1 if code >> 20 & 1 else -1


@lru_cache(maxsize=1 << 18)
def _word_place(word: str) -> int:
    at, sign = _place("word", word, WORD_SIZE)
    return at if sign > 0 else at + WORD_SIZE


@lru_cache(maxsize=1 << 13)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(TAG_SIZE, np.float32)
    for depth, element in enumerate(reversed(path)):
        weight = 1.0 if depth == 0 else 0.7
        for i, word in enumerate(element.split()):
            at, sign = _place("tag" if i == 0 else "name", word, TAG_SIZE)
            out[at] += sign * weight
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """The description of each block."""
    out = np.zeros((len(page), INPUT), np.float32)
    for i, b in enumerate(page):
        row = out[i]
        row[:TAG_SIZE] = _path_vector(b.path)
        text = b.text
        places = list(map(_word_place, WORD.findall(text.lower())))
        n, size = max(1, text.count(" ") + 1), max(1, len(text))
        if places:
            counts = np.minimum(np.bincount(places, minlength=2 * WORD_SIZE), 1 + len(places) / 8)  # one word doesn't make a block
            row[TAG_SIZE : TAG_SIZE + WORD_SIZE] = (counts[:WORD_SIZE] - counts[WORD_SIZE:]) / len(places) ** 0.5
        row[TAG_SIZE + WORD_SIZE :] = (
            min(1.0, b.linked / size),
            np.log1p(size) / 8,
            np.log1p(n) / 6,
            min(1.0, len(ENDS.findall(text)) / n),
            min(1.0, len(PAUSES.findall(text)) / n),
            min(2.0, len(CAPITALS.findall(text)) / n),
            min(2.0, len(DIGITS.findall(text)) / n),
            i / max(1, len(page) - 1),
            1.0 if size < 25 else 0.0,
            1.0 if text[-1:] in ".!?" else 0.0,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, alive: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hidden states ``(pages, steps, hidden)`` of a batch; where a page is over, its state stays as it was."""
    pages, steps, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
    out = np.zeros((pages, steps, size), np.float32)
    inputs = x @ w + b
    for t in range(steps):
        gates = inputs[:, t] + h @ u
        i, f, o = (_sigmoid(gates[:, k * size : (k + 1) * size]) for k in range(3))
        new_c = f * c + i * np.tanh(gates[:, 3 * size :])
        new_h = o * np.tanh(new_c)
        on = alive[:, t, None]
        c, h = np.where(on, new_c, c), np.where(on, new_h, h)
        out[:, t] = h
    return out


class Labeller:
    """The trained network."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    def _batch(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        steps = int(lengths.max())
        x = np.zeros((len(pages), steps, INPUT), np.float32)
        back = np.zeros_like(x)
        for i, p in enumerate(pages):
            x[i, : len(p)], back[i, : len(p)] = p, p[::-1]
        alive = np.arange(steps) < lengths[:, None]
        ahead = lstm(x, alive, self.w["wf"], self.w["uf"], self.w["bf"])
        behind = lstm(back, alive, self.w["wb"], self.w["ub"], self.w["bb"])
        out = []
        for i, n in enumerate(lengths):
            both = np.concatenate([ahead[i, :n], behind[i, :n][::-1]], axis=1)
            out.append(_sigmoid(both @ self.w["v"] + x[i, :n] @ self.w["skip"] + self.w["c"])[:, 0])
        return out

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """How likely each block is content."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < PAGES and (end - start + 1) * len(pages[order[end]]) <= STEPS:
                end += 1
            chosen = order[start:end]
            for i, p in zip(chosen, self._batch([pages[i] for i in chosen]), strict=True):
                out[i] = p
            start = end
        return out


@lru_cache(maxsize=1)
def labeller() -> Labeller:
    data = resources.files("evenkeel.llm").joinpath(WEIGHTS.name).read_bytes()  # also from a zipped package
    with np.load(io.BytesIO(data)) as held:
        return Labeller(dict(held))


def main_texts(pages: list[str], cut: float = 0.5) -> list[str]:
    read = [blocks(p) for p in pages]
    found = labeller().probabilities([vectors(b) for b in read])
    return ["\n\n".join(b.text for b, p in zip(page, ps, strict=True) if p >= cut) for page, ps in zip(read, found, strict=True)]


def extract(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keys``, ``text`` and ``n_chars`` of every page."""
    source = df.select(*keys, F.coalesce(F.col(html_col), F.lit("")).alias("html_to_read"))
    schema = T.StructType([*(source.schema[k] for k in keys), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4 * PAGES):
                some = batch.slice(i, 4 * PAGES)
                texts = main_texts(some.column(len(keys)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(keys))), pa.array(texts, pa.string())], names=[*keys, "text"])

    return source.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
