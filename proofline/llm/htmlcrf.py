"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks, runs of text between block-level tags, each with its chain of open ancestors. A block's
features are its ancestors' tags, the words of their class, id and role attributes, the nearest sectioning ancestor, and
figures of its text (words, link share, punctuation, place in the page). The model has a weight per feature and label
(main text or not) and per pair of neighbouring labels; it is trained by gradient ascent on the conditional likelihood of
labelled pages (:mod:`.labelled_pages`) and decoded by Viterbi. Training takes a few hundred small pages on the driver;
extraction is a map over the pages, without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search
section select summary table tbody td textarea tfoot th thead title tr ul""".split())
#: Elements whose content is never text of the page. All but a head and its title stand within a line: the block around them goes on.
RAW_TAGS = {"script", "style", "template", "noscript", "iframe", "svg", "object", "canvas", "math", "head", "title"}
#: Those whose content is not markup: without an end tag they reach to the end of the page.
TEXT_ONLY_TAGS = {"script", "style", "title"}
#: What may stand in a head; anything else ends it.
HEAD_TAGS = {"head", "html", "meta", "link", "base", "basefont", "bgsound", "noframes", "script", "style", "title", "noscript", "template"}
VOID_TAGS = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
SECTIONS = {"article", "main", "nav", "aside", "header", "footer", "form", "section", "figure", "dialog", "menu"}
#: An opening tag of the key closes an open element of the values that has nothing else above it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?/][^>]*+>|[^<]++|<(?![a-zA-Z/!?])", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """One leaf block: its ancestors as (tag, attribute words), its text, and how much of it is in links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def attribute_words(attributes: str) -> tuple[str, ...]:
    words: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        words += _WORD.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower())
    return tuple(dict.fromkeys(words))


def _text_end(page: str, at: int, tag: str) -> int:
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _head_end(page: str, at: int, endless: set[str]) -> int:
    """Where a head whose start tag ends at ``at`` ends: after its end tag, or before the first thing of the body."""
    while at < len(page) and (m := _TOKEN.match(page, at)):
        if m[2] is None:
            if not m[0].startswith("<") and m[0].strip() or m[0] == "<":
                return at
            at = m.end()
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "head":
                return m.end()
            if tag in ("body", "html"):
                return at
            at = m.end()
        elif tag not in HEAD_TAGS:
            return at
        elif tag in TEXT_ONLY_TAGS:
            at = _text_end(page, m.end(), tag)
        elif tag in RAW_TAGS and tag != "head":
            at = _element_end(page, m.end(), tag, {"head"}, endless)
        else:
            at = m.end()
    return at


def _element_end(page: str, at: int, tag: str, around: set[str], endless: set[str]) -> int:
    """Where the element whose start tag ends at ``at`` ends: after its end tag, or before that of an element around it.

    Without either, the start tag stands alone, and so do later ones of that name (``endless``).
    """
    begin, foreign = at, tag in ("svg", "math")
    inner: dict[str, int] = {}
    while tag not in endless and at < len(page) and (m := _TOKEN.match(page, at)):
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if inner.get(name):
                inner[name] -= 1
            elif name == tag:
                return at
            elif name in around:
                return m.start()
        elif name in TEXT_ONLY_TAGS and not foreign:
            at = _text_end(page, at, name)
        elif name not in VOID_TAGS and not (foreign and m[3].endswith("/")) and (name != tag or name not in ("iframe", "noscript")):
            inner[name] = inner.get(name, 0) + 1
    endless.add(tag)
    return begin


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order; white space inside is one blank, character references are decoded."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    endless: set[str] = set()
    linked, in_link, at, size = 0, 0, 0, len(page)

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(tuple(stack), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    while at < size:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        token = m[0]
        if m[2] is None:
            if token[0] != "<" or token == "<":
                text = html.unescape(token)
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW_TAGS and not closing:
            if tag in TEXT_ONLY_TAGS:
                at = _text_end(page, at, tag)
            elif tag == "head":
                at = _head_end(page, at, endless)
            elif not (tag in ("svg", "math") and m[3].endswith("/")):
                at = _element_end(page, at, tag, {name for name, _ in stack} | {"body", "html"}, endless)
            if tag in ("head", "title"):
                close()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            close()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                while stack and stack[-1][0] in CLOSES.get(tag, ()):
                    stack.pop()
                if tag not in VOID_TAGS:
                    stack.append((tag, attribute_words(m[3])))
        else:
            parts.append("")
    close()
    return blocks


def path_features(path: tuple) -> list[str]:
    tags = [tag for tag, _ in path]
    near = next((t for t in reversed(tags) if t in SECTIONS), "none")
    inside = "article" if "article" in tags else "main" if "main" in tags else "page"
    out = {f"tag:{t}" for t in tags} | {f"near:{near}", f"near:{near}|{inside}", f"in:{inside}", f"parent:{tags[-1] if tags else 'none'}"}
    out |= {f"parent:{tags[-1] if tags else 'none'}|{near}"}
    for _, words in path:
        out |= {f"word:{w}" for w in words}
    return sorted(out)


def text_features(block: Block, i: int, n: int) -> list[str]:
    words = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    last = block.text[-1]
    return ["bias", f"words:{min(6, int(math.log2(words)))}", f"link:{0 if share == 0 else 1 if share < 0.5 else 2}",
            f"end:{'stop' if last in '.!?…。' else 'other'}", f"mark:{any(c in block.text for c in '©|»·')}",
            f"place:{'first' if i == 0 else 'last' if i == n - 1 else 'inner'}"]


def page_features(blocks: list[Block], memo: dict) -> list[list[str]]:
    """Features by block. Where no ancestor on the page is a section or has a name, the blocks tell so: nothing marks an article there."""
    out = []
    bare = not any(words or tag in SECTIONS for path in {b.path for b in blocks} for tag, words in path)
    for i, block in enumerate(blocks):
        if block.path not in memo:
            if len(memo) > 50_000:
                memo.clear()
            memo[block.path] = path_features(block.path)
        text = text_features(block, i, len(blocks))
        out.append(memo[block.path] + text + ([f"bare|{x}" for x in text[:3]] if bare else []))
    return out


class Crf:
    """Two labels: 0 other, 1 main text."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 2))
        self.moves = np.zeros((2, 2))

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> None:
        """Stochastic gradient ascent with per-weight steps (Adagrad)."""
        for features, _ in pages:
            for names in features:
                for name in names:
                    self.index.setdefault(name, len(self.index))
        self.weights = np.zeros((len(self.index), 2))
        seen, seen_moves = np.full_like(self.weights, 1e-2), np.full_like(self.moves, 1e-2)
        coded = [([np.array([self.index[x] for x in names]) for names in features], np.array(labels)) for features, labels in pages if labels]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for p in rng.permutation(len(coded)):
                features, labels = coded[p]
                n = len(labels)
                emit = np.stack([self.weights[f].sum(axis=0) for f in features])
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = emit[0]
                for i in range(1, n):
                    forward[i] = emit[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.moves, axis=0)
                for i in range(n - 2, -1, -1):
                    backward[i] = np.logaddexp.reduce(self.moves + emit[i + 1] + backward[i + 1], axis=1)
                total = np.logaddexp.reduce(forward[-1])
                error = -np.exp(forward + backward - total)
                error[np.arange(n), labels] += 1.0
                if n > 1:
                    pair = forward[:-1, :, None] + self.moves + (emit + backward)[1:, None, :] - total
                    step = -np.exp(pair).sum(axis=0)
                    np.add.at(step, (labels[:-1], labels[1:]), 1.0)
                    seen_moves += step * step
                    self.moves += rate * step / np.sqrt(seen_moves)
                flat = np.concatenate(features)
                gradient = np.repeat(error, [len(f) for f in features], axis=0)
                rows, where = np.unique(flat, return_inverse=True)
                step = np.zeros((len(rows), 2))
                np.add.at(step, where, gradient)
                step -= decay * self.weights[rows]
                seen[rows] += step * step
                self.weights[rows] += rate * step / np.sqrt(seen[rows])

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi: the most likely labels."""
        if not features:
            return []
        index = self.index
        gain = (self.weights[:, 1] - self.weights[:, 0]).tolist() if not hasattr(self, "_gain") else self._gain
        self._gain = gain
        (a, b), (c, d) = self.moves.tolist()
        back, zero, one = [], 0.0, 0.0
        for i, names in enumerate(features):
            e = sum(gain[index[x]] for x in names if x in index)
            if i == 0:
                zero, one = 0.0, e
                continue
            from_zero, from_one = (0 if zero + a >= one + c else 1), (0 if zero + b >= one + d else 1)
            back.append((from_zero, from_one))
            zero, one = max(zero + a, one + c), max(zero + b, one + d) + e
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def trained(pages: list[tuple[str, list[int]]] | None = None) -> Crf:
    """A model for (html, label per leaf block) pages; by default the labelled pages of this package."""
    if pages is None:
        from .labelled_pages import labelled_pages

        pages = labelled_pages()
    memo: dict = {}
    crf = Crf()
    crf.train([(page_features(leaf_blocks(page), memo), labels) for page, labels in pages])
    return crf


def main_text(crf: Crf, page: str, memo: dict) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, crf.decode(page_features(blocks, memo))) if label)


def extract(pages: DataFrame, crf: Crf, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text (main blocks joined by line ends), n_chars (code points), one row per row of ``pages``.

    A null or empty page, and one without main text, has an empty text. Null ids and urls stay null; repeated rows are
    treated one by one; other columns are not read.
    """
    model = pages.sparkSession.sparkContext.broadcast(crf)
    schema = f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            texts = [main_text(model.value, x.as_py() or "", memo) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).alias("html")).mapInArrow(run, schema)
