"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read once into leaf blocks, the runs of text between borders of block elements.
Each has binary features of its ancestors (tags, words of class, id and role) and of its text
(length, share of links, punctuation).  The field gives each sequence of labels (main text or
not) a probability; its weights are learned from labelled pages by maximum likelihood, and
the best sequence is found by Viterbi.  Pages are rows, so there is no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import small_batches
from factorweave.llm.labelled_pages import labelled_pages
from factorweave.llm.words import pieces

#: Elements that end a run of text (fixed values of HTML).
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object canvas audio video head".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())  # no tags are read in these
#: An element ends, without an end tag, where one of these begins.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
_SECTIONS = frozenset("article aside dialog footer form header main nav section".split())
_NO_END = frozenset(_ENDED_BY) | {"p"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_CLOSE_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _tokens(attributes: str) -> list[str]:
    """Features of class, id and role words, and of an element that isn't shown."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            out += [f"c={w}" for w in _WORD.findall(_CAMEL.sub(" ", value).lower())]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
    return out


@dataclass
class Block:
    """A leaf block: its text, with single spaces, and its features."""

    text: str
    features: frozenset[str]


class _Page:
    """Open elements and the run of text being read."""

    def __init__(self, known: frozenset[str] | None):
        self.known, self.blocks = known, []
        self.open: list[tuple[str, frozenset[str], frozenset[str]]] = []  # tag, features of it and all above, of the nearest named one
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = self.letters = 0
        self.link = False

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.text.append(text)
        n = len(text) - text.count(" ")
        self.letters += n
        self.linked += n if self.link else 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                tag, above, near = self.open[-1] if self.open else ("", frozenset(), frozenset())
                own = frozenset(_text_features(text, tag, self.linked / max(self.letters, 1), "a=article" in above or "a=main" in above))
                self.blocks.append(Block(text, above | near | (own if self.known is None else own & self.known)))
            self.text.clear()
        self.linked = self.letters = 0

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        self.link = False
        if self.open and (self.open[-1][0] == "p" or tag in _ENDED_BY.get(self.open[-1][0], ())):
            self.pop()
        elif self.open and tag in ("li", "tr", "dt", "dd", "td", "th") and len(self.open) > 1 and tag in _ENDED_BY.get(self.open[-2][0], ()) and self.open[-1][0] in _NO_END:
            self.pop()
            self.pop()
        if tag == "hr":
            return
        _, above, near = self.open[-1] if self.open else ("", frozenset(), frozenset())
        words = _tokens(attributes) if attributes else []
        own = {f"a={tag}", *words}
        if words or tag in _SECTIONS:
            near = {f"near:{x}" for x in (own if tag in _SECTIONS else words)}
            near = frozenset(near if self.known is None else near & self.known)
        own = own if self.known is None else own & self.known
        self.open.append((tag, above if own <= above else above | own, near))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        self.flush()
        self.link = False
        if self.count.get(tag):
            while self.pop() != tag:
                pass


def blocks_of(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; with `known`, only features in it are kept.

    Linear in the page: every place is read once, and an element holds one set of features
    that grows only with what `known` has.  Unclosed and wrongly nested elements are closed
    as browsers do it: by an ancestor's end, or by what can't stand inside them.
    """
    page, at, n, p = page or "", 0, len(page or ""), _Page(known)
    skip: list[str] = []  # open elements that aren't read
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at and not skip:
            p.add(page[at:i])
        if i >= n:
            break
        if page.startswith("<!--", i):
            m = _COMMENT_END.search(page, i + 2)
            at = m.end() if m else n
            continue
        closing = page.startswith("/", i + 1)
        m = _NAME.match(page, i + 1 + closing)
        if not m:
            if closing or page.startswith(("<!", "<?"), i):  # not a tag, and not text
                at = page.find(">", i + 1) + 1 or n
            else:
                if not skip:
                    p.add("<")
                at = i + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:  # the page ends inside a tag
            break
        tag, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        if skip:
            if closing and tag in skip:
                while skip.pop() != tag:
                    pass
            elif not closing and tag in SKIPPED and tag not in _RAW and not attributes.endswith("/"):
                skip.append(tag)
            elif tag == "body" and not closing and skip == ["head"]:  # a head that wasn't closed
                skip.clear()
                p.start(tag, attributes)
            elif not closing and tag in _RAW:
                found = _CLOSE_RAW[tag].search(page, at)
                at = found.start() if found else n
            continue
        if tag in _RAW and not closing:
            found = _CLOSE_RAW[tag].search(page, at)
            at = (_tag_end(page, found.end()) + 1 or n) if found else n
        elif tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                skip.append(tag)
        elif tag in BLOCKS:
            p.end(tag) if closing else p.start(tag, attributes)
        elif tag == "ins" and (p.count.get(tag) if closing else attributes):  # advert slots
            p.end(tag) if closing else p.start(tag, attributes)
        elif tag == "br":
            p.text.append(" ")
        elif tag == "a":
            p.link = not closing
    p.flush()
    return p.blocks


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag; one inside a quoted value doesn't."""
    while True:
        m = _QUOTE_OR_END.search(page, at)
        if not m or m[0] == ">":
            return m.start() if m else -1
        if page[: m.start()][-1:] == "=" or page[m.start() - 8 : m.start()].rstrip().endswith("="):
            close = page.find(m[0], m.end())
            if close < 0:
                return -1
            at = close + 1
        else:
            at = m.end()


def _bucket(x: float, edges: Iterable[float]) -> int:
    return sum(x >= e for e in edges)


def _text_features(text: str, tag: str, linked: float, within: bool) -> list[str]:
    words = text.count(" ") + 1
    size, links = _bucket(words, (4, 10, 25, 60)), _bucket(linked, (0.01, 0.3, 0.8))
    out = [f"t={tag}", f"w={size}", f"l={links}", f"t={tag}/w={size}", f"w={size}/l={links}", f"in={within}/t={tag}", f"k={_bucket(text.count(',') / words, (0.01, 0.1))}"]
    if text[-1] in ".!?…。:;\"'”»)":
        out.append("ends")
    if "©" in text:
        out.append("copyright")
    if "|" in text or "·" in text or "›" in text or "»" in text:
        out.append("bars")
    return out


@dataclass
class Model:
    """weights[f]: what a feature adds to the score of main text; start and step: label scores, main text last."""

    weights: dict[str, float]
    start: np.ndarray
    step: np.ndarray

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels, by Viterbi."""
        if not blocks:
            return []
        w, ((s00, s01), (s10, s11)) = self.weights, self.step.tolist()
        other, main = self.start.tolist()
        back = []
        for i, b in enumerate(blocks):
            if i:
                kept0, kept1 = other + s00 >= main + s10, other + s01 > main + s11
                other, main = (other + s00 if kept0 else main + s10), (other + s01 if kept1 else main + s11)
                back.append((kept0, kept1))
            main += sum(w.get(f, 0.0) for f in b.features)
        label = main > other
        out = [label]
        for kept in reversed(back):
            label = not kept[label]
            out.append(label)
        return out[::-1]


class _Chains:
    """Labelled pages of about one length as padded arrays, and the likelihood of their labels with its gradient."""

    def __init__(self, pages: list[tuple[list[Block], list[bool]]], place: dict[str, int]):
        n, t = len(pages), max(len(b) for b, _ in pages)
        flat = [(i * t + j, place[f]) for i, (blocks, _) in enumerate(pages) for j, b in enumerate(blocks) for f in sorted(b.features)]
        self.shape = (n, t)
        self.cell, self.feature = (np.array(x) for x in zip(*flat, strict=True))
        self.real = np.arange(t) < np.array([len(b) for b, _ in pages])[:, None]
        self.label = np.zeros((n, t), int)
        for i, (_, labels) in enumerate(pages):
            self.label[i, : len(labels)] = labels

    def loss(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Minus the log likelihood, and its gradient, by forward and backward sums."""
        n, t = self.shape
        k = len(x) - 6
        w, start, step = x[:k], x[k : k + 2], x[k + 2 :].reshape(2, 2)
        score = np.zeros((n, t, 2))
        score[:, :, 1] = np.bincount(self.cell, w[self.feature], n * t).reshape(n, t)
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = start + score[:, 0]
        for j in range(1, t):
            now = np.logaddexp(forward[:, j - 1, 0, None] + step[0], forward[:, j - 1, 1, None] + step[1]) + score[:, j]
            forward[:, j] = np.where(self.real[:, j, None], now, forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            after = backward[:, j + 1] + score[:, j + 1]
            now = np.logaddexp(step[:, 0] + after[:, 0, None], step[:, 1] + after[:, 1, None])
            backward[:, j] = np.where(self.real[:, j + 1, None], now, backward[:, j])
        log_z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(forward + backward - log_z[:, None, None]) * self.real[:, :, None]
        pair = self.real[:, 1:]
        both = np.exp(forward[:, :-1, :, None] + step + (score + backward)[:, 1:, None, :] - log_z[:, None, None, None]) * pair[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (self.label[:, :-1][pair], self.label[:, 1:][pair]), 1)
        first = np.bincount(self.label[:, 0], minlength=2)
        path = (score[:, :, 1] * self.label * self.real).sum() + start[self.label[:, 0]].sum() + (seen * step).sum()
        off = ((p[:, :, 1] - self.label) * self.real).ravel()
        return log_z.sum() - path, np.concatenate([np.bincount(self.feature, off[self.cell], k), p[:, 0].sum(0) - first, (both.sum((0, 1)) - seen).ravel()])


def _downhill(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """The least point of a convex f (value, gradient), by limited-memory quasi-Newton steps."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, parts = -g, []
        for s, y in reversed(past):
            parts.append(a := (s @ d) / (s @ y))
            d = d - a * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(parts), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0 if past else 1 / max(np.abs(g).sum(), 1e-12)
        for _ in range(20):
            new_value, new_g = f(x + step * d)
            if new_value <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (y := new_g - g) @ d > 0:
            past = [*past[1 - memory :], (step * d, y)]
        x, done = x + step * d, value - new_value < 1e-7
        value, g = new_value, new_g
        if done:
            break
    return x


def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = 120, decay: float = 3e-6, together: int = 100) -> Model:
    """The weights of greatest (penalised) likelihood."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
    names = sorted({f for blocks, _ in pages for b in blocks for f in b.features})
    place = {f: i for i, f in enumerate(names)}
    chains = [_Chains(pages[a : a + together], place) for a in range(0, len(pages), together)]
    total = sum(len(b) for b, _ in pages)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = [c.loss(x) for c in chains]
        return sum(p[0] for p in parts) / total + decay * (x @ x) / 2, sum(p[1] for p in parts) / total + decay * x

    x = _downhill(loss, np.zeros(len(names) + 6), rounds)
    k = len(names)
    return Model(dict(zip(names, x[:k].tolist(), strict=True)), x[k : k + 2], x[k + 2 :].reshape(2, 2))


def aligned(blocks: list[Block], text: str) -> list[bool]:
    """Which blocks are main text, given that text: its longest common subsequence with the blocks."""
    wanted = text.split("\n\n") if text else []
    n, m = len(blocks), len(wanted)
    best = np.zeros((n + 1, m + 1), int)
    same = [[b.text == w for w in wanted] for b in blocks]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if same[i][j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [False] * n, 0, 0
    while i < n and j < m:
        if same[i][j]:
            out[i] = True
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def train(labelled: DataFrame, html_col: str = "html", text_col: str = "text", most_pages: int = 1200, most_chars: int = 200_000) -> Model:
    """A model from at most `most_pages` labelled pages (their html and main text) of at most `most_chars` each.

    These are the ones of least html, so the model doesn't depend on how rows are dealt.  Text
    is labelled block by block, as in the results of extract().
    """
    rows = labelled.select(F.col(f"`{html_col}`").alias("html"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(F.length("html") <= most_chars)
    got = rows.orderBy("html", "text").limit(most_pages).collect()  # the bounded sample
    pages = [(b := blocks_of(r["html"]), aligned(b, r["text"])) for r in got]
    if not any(b for b, _ in pages):
        raise ValueError("there is no labelled page with text")
    return fit(pages)


_EXTRACTED = "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"
_EXTRACTED_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), *[(c, pa.int64()) for c in ("n_chars", "n_blocks", "n_main")]])


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main): the main text of every page, its blocks joined by an empty line.

    Character references are decoded and white space within a block becomes one space.  Null,
    empty and textless html gives an empty text.  Repeated rows give a row each; null ids
    and urls stay null; other columns are ignored.  Nothing is cut off or dropped.
    """
    small_batches(pages.sparkSession)
    known = frozenset(model.weights)

    def rows(batches):
        for batch in batches:
            for part in pieces(batch, "html"):
                texts, counts = [], []
                for page in part.column(2).to_pylist():
                    blocks = blocks_of(page, known)
                    main = [b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep]
                    texts.append("\n\n".join(main))
                    counts.append((len(texts[-1]), len(blocks), len(main)))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]], schema=_EXTRACTED_ARROW)

    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return own.mapInArrow(rows, _EXTRACTED)


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    model = train(labelled_pages(spark))
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).select("page_id", "url", "text", "n_chars")


QUERIES = {"op11_html_extraction": op11_html_extraction}
ORACLE_SQL: dict[str, str] = {}
