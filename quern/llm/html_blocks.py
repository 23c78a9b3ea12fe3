"""Main text of web pages: a recurrent block labeller over each page's sequence of leaf blocks."""

from __future__ import annotations

import bisect
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = re.compile(r"\s+")
_TOKENS = re.compile(r"[a-z]+")
#: A decimal character reference beyond all code points.
_TOO_LARGE = re.compile(r"&#0*[1-9]\d{7,};?")
#: Elements that start and end a block, and that have no end tag.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: code, controls, and what stands in for media. Of those without an end tag the content stays.
SILENT = frozenset("script style noscript template title textarea select option button iframe svg canvas audio video".split())
#: Start tags that end open elements of the named kinds, and all inside, up to the innermost element of the other names; every block's start ends an open paragraph so.
_SCOPES = frozenset("ul ol dl table div article section body td th main aside nav header footer form blockquote button select object svg".split())
_ROWS = frozenset({"table"})
_CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), _SCOPES), "dt": (frozenset({"dt", "dd"}), _SCOPES), "dd": (frozenset({"dt", "dd"}), _SCOPES),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "tr": (frozenset({"tr"}), _ROWS),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr"}), _ROWS), "thead": (frozenset({"thead", "tbody", "tfoot", "tr"}), _ROWS), "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr"}), _ROWS),
    "option": (frozenset({"option"}), frozenset({"select"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
_PARAGRAPH = (frozenset({"p"}), _SCOPES)


class Element:
    """An open element by its names (its tag, then words of its class, id and role), with the one around it: paths share what they have in common."""

    __slots__ = ("names", "around", "depth", "known", "label", "buckets")

    def __init__(self, names: str, around: Element | None = None) -> None:
        self.names, self.around = names, around
        #: The known names of the element and all around it, as bits, what the innermost telling one says (1 main, 0 other), and the buckets of its own other names.
        self.known, self.label, self.buckets = _telling(names)
        self.depth = 1
        if around is not None:
            self.depth += around.depth
            self.known |= around.known
            if self.label is None:
                self.label = around.label


def nested(*names: str, inside: Element | None = None) -> Element | None:
    """The innermost of elements, outermost first."""
    for n in names:
        inside = Element(n, inside)
    return inside


@dataclass
class Block:
    text: str
    path: Element | None  # the innermost open element
    linked: float  # share of characters inside links


@dataclass
class Silence:
    """An open element of SILENT: its content goes once its end tag comes."""

    around: Silence | None
    ended: bool = False
    known: bool | None = None

    def holds(self) -> bool:
        """Whether it or one around it was ended; asked once the page is read, and kept for all on the way."""
        asked, at = [], self
        while at is not None and at.known is None and not at.ended:
            asked.append(at)
            at = at.around
        answer = at is not None and (at.ended or bool(at.known))
        for s in asked:
            s.known = answer
        return answer


class _Leaves(HTMLParser):
    """Splits a page into leaf blocks: runs of text that no block element's start or end interrupts. A tag costs a look at the places of few names, however many are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Element, Silence | None]] = []
        self.places: dict[str, list[int]] = {}
        self.runs: list[tuple[list[tuple[str, Silence | None, bool]], Element | None]] = []
        self.parts: list[tuple[str, Silence | None, bool]] = []
        self.path: Element | None = None
        self.begun = 0
        self.silence: Silence | None = None

    def flush(self) -> None:
        if self.begun:
            self.runs.append((self.parts, self.path))
        self.parts, self.begun = [], 0

    def blocks(self) -> Iterator[Block]:
        for parts, path in self.runs:
            stay = [(data, linked) for data, silence, linked in parts if silence is None or not silence.holds()]
            text = _SPACES.sub(" ", "".join(data for data, _ in stay)).strip()
            if text:
                yield Block(text, path, min(1.0, sum(len(data.strip()) for data, linked in stay if linked) / len(text)))

    def last(self, tags: frozenset[str]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def pop(self, at: int) -> None:
        for tag, _, silence in reversed(self.open[at:]):
            self.places[tag].pop()
            if silence is not None:
                self.silence = silence.around
        del self.open[at:]

    def close_open(self, ends: frozenset[str], scope: frozenset[str]) -> None:
        """End the outermost open element of ``ends`` that stands inside the innermost one of ``scope`` (or is it), and all in it."""
        there = [at for t in ends if (at := self.places.get(t))]
        if not there:
            return
        inside = self.last(scope - ends)
        found = [at[k] for at in there if (k := bisect.bisect_right(at, inside)) < len(at)]
        if found:
            for _, _, silence in self.open[min(found) :]:
                if silence is not None and self.open[min(found)][0] == "option":
                    silence.ended = True
            self.pop(min(found))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close_open(*_PARAGRAPH)
        elif tag == "br":
            self.parts.append((" ", self.silence, False))
        if tag in _CLOSES:
            self.close_open(*_CLOSES[tag])
        if tag in VOID:
            return
        named = " ".join(v.lower() for k, v in attrs if k in ("class", "id", "role", "aria-label", "itemprop") and v)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs)
        silence = None
        if tag in SILENT:
            silence = self.silence = Silence(self.silence)
        self.places.setdefault(tag, []).append(len(self.open))
        names = " ".join([tag, *(["hidden"] if hidden else []), *_TOKENS.findall(named)])
        self.open.append((tag, Element(names, self.open[-1][1] if self.open else None), silence))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if at := self.places.get(tag):
            if self.open[at[-1]][2] is not None:
                self.open[at[-1]][2].ended = True
            self.pop(at[-1])

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section of unknown name is a comment up to the next '>', and the page goes on."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        # A block's path is that of its first text, of its first outside of silent elements if there is any.
        state = 1 if self.silence is not None else 2
        if self.begun < state and not data.isspace():
            self.path, self.begun = self.open[-1][1] if self.open else None, state
        self.parts.append((data, self.silence, bool(self.places.get("a"))))


def leaf_blocks(html: str | None) -> list[Block]:
    """The page's text blocks in order, to its end; white space runs inside a block are one space.

    The content of a SILENT element goes if its end tag stands before that of an element around it; where it is missing, the
    content stays, but for ``script`` and ``style``, which last until their end tag or the page's. Fallback text inside ``object`` and formulas are text.
    """
    leaves = _Leaves()
    leaves.feed(_TOO_LARGE.sub("\ufffd", html or ""))
    leaves.close()
    if leaves.open and leaves.open[-1][0] in ("script", "style"):
        leaves.open[-1][2].ended = True
    leaves.flush()
    return list(leaves.blocks())


#: Names of elements, classes and ids that teach the labeller; the label of a training block is that of the
#: innermost of its elements that has one.
MAIN_NAMES = frozenset("article main content post entry story body articlebody text".split())
OTHER_NAMES = frozenset(
    "nav menu header footer aside sidebar side ad ads advert advertisement sponsor sponsored banner promo cookie cookies consent notice alert popup modal form login signup newsletter subscribe "
    "search comment comments reply replies discussion disqus social share sharing related recommended breadcrumb breadcrumbs pagination pager toolbar widget copyright legal hidden navigation contentinfo complementary".split()
)
PATH_DIM, WORD_DIM, PLAIN_DIM = 96, 32, 10
#: Elements around a block whose other names count.
INNERMOST = 24


@lru_cache(1 << 18)
def _bucket(token: str, dim: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % dim


_NAMED = {t: i for i, t in enumerate(sorted(MAIN_NAMES | OTHER_NAMES | {"h1", "h2", "p", "li", "a", "td", "pre", "blockquote"}))}


@lru_cache(1 << 16)
def _telling(element: str) -> tuple[int, int | None, tuple[int, ...]]:
    """An element's known names as bits, 1 main or 0 other if it has a telling name, boilerplate names first, and the places of its other names."""
    names = element.split()
    tokens = set(names)
    label = 0 if tokens & OTHER_NAMES else 1 if tokens & (MAIN_NAMES - {"body", "text"}) or "body" in tokens - {names[0]} else None
    return sum(1 << _NAMED[t] for t in tokens if t in _NAMED), label, tuple(len(_NAMED) + _bucket(t, PATH_DIM - len(_NAMED)) for t in names if t not in _NAMED)


@lru_cache(1 << 16)
def _places(bits: int) -> list[int]:
    return [k for k in range(len(_NAMED)) if bits >> k & 1]


def block_vectors(blocks: list[Block], first: int = 0, among: int | None = None) -> np.ndarray:
    """Tag-path, hashed-word and plain features of blocks, which are those from ``first`` on of the ``among`` blocks of a page. All of a block's text counts."""
    among = len(blocks) if among is None else among
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + PLAIN_DIM), np.float32)
    rows, places, values, plain = [], [], [], []
    for i, b in enumerate(blocks):
        element, depth = b.path, 0
        if element is not None:
            known = _places(element.known)
            rows += [i] * len(known)
            places += known
            values += [1.0] * len(known)
        while element is not None and depth < INNERMOST:
            for place in element.buckets:
                rows.append(i)
                places.append(place)
                values.append(0.3 / (1 + depth))
            element, depth = element.around, depth + 1
        words = b.text.lower().split()
        counts = np.bincount([_bucket(w, WORD_DIM) for w in words], minlength=WORD_DIM)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = counts / max(1.0, float(np.sqrt(counts @ counts)))
        n, at = len(b.text), (first + i + 0.5) / among
        plain.append(
            (min(np.log1p(len(words)) / 5, 2), b.linked, at, (at - 0.5) ** 2 * 4, b.text[-1] in ".!?…。", sum(b.text.count(c) for c in ",;.") / (n + 1) * 10,
             sum(map(str.isupper, b.text)) / n, len(words) <= 3, any(c in b.text for c in "©|·»"), min(b.path.depth if b.path else 0, INNERMOST) / 10)
        )
    if blocks:
        out[rows, places] = values
        out[:, PATH_DIM + WORD_DIM :] = plain
    return out


def marked(block: Block) -> int | None:
    """1 main, 0 other, by the innermost element with a telling name; boilerplate names win within one element."""
    return block.path.label if block.path else None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BlockLabeller:
    """A bidirectional LSTM and a logistic output, in numpy. Weights by direction: input, recurrent, bias."""

    hidden: int = 16
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, dim: int, rng: np.random.Generator) -> None:
        h = self.hidden
        for way in "fb":
            self.weights[f"x{way}"] = rng.normal(0, 0.2, (dim, 4 * h))
            self.weights[f"h{way}"] = rng.normal(0, 0.2, (h, 4 * h))
            self.weights[f"c{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)
        self.weights["o"], self.weights["d"] = rng.normal(0, 0.2, 2 * h), np.zeros(1)

    def run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, hidden), time in reading order of ``way``. Padding keeps the state."""
        h, w = self.hidden, self.weights
        steps, pages = x.shape[:2]
        state, cell = np.zeros((pages, h)), np.zeros((pages, h))
        inputs, out, tape = x @ w[f"x{way}"] + w[f"c{way}"], np.zeros((steps, pages, h)), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + state @ w[f"h{way}"]
            gates, fresh = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            new = f * cell + i * fresh
            squashed = np.tanh(new)
            m = mask[t][:, None]
            tape.append((t, state, cell, i, f, o, fresh, squashed, m))
            state, cell = np.where(m, o * squashed, state), np.where(m, new, cell)
            out[t] = state
        return out, tape

    def probabilities(self, pages: list[list[Block]], span: int = 8192) -> list[np.ndarray]:
        """Of each page's blocks to be main text. Features of ``span`` steps at a time, so a page of any length needs little beside its blocks."""
        h, w = self.hidden, {k: v.astype(np.float32) for k, v in self.weights.items()}
        lengths = np.array([len(p) for p in pages])
        steps, shortest = int(lengths.max()), int(lengths.min())
        odds = np.full((steps, len(pages)), w["d"][0], np.float32)
        whole = [block_vectors(p) for p in pages] if steps <= span else None
        twice = -np.repeat(np.array([1, 1, 1, 2], np.float32), h)  # tanh(x) is 2 sigmoid(2 x) - 1, so all gates are one sigmoid, of the opposite
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            state = cell = np.zeros((len(pages), h), np.float32)
            w_in, w_on, bias = w[f"x{way}"] * twice, w[f"h{way}"] * twice, w[f"c{way}"] * twice
            starts = range(0, steps, span)
            for lo in starts if way == "f" else reversed(starts):
                hi = min(lo + span, steps)
                x = np.zeros((hi - lo, len(pages), 4 * h), np.float32)
                for k, page in enumerate(pages):
                    own = whole[k] if whole else block_vectors(page[lo:hi], lo, len(page))
                    x[: len(own), k] = own @ w_in + bias
                states = np.empty((hi - lo, len(pages), h), np.float32)
                for t in range(hi - lo) if way == "f" else range(hi - lo - 1, -1, -1):
                    gates = state @ w_on
                    gates += x[t]
                    np.exp(np.minimum(gates, 60, out=gates), out=gates)
                    gates += 1
                    np.reciprocal(gates, out=gates)
                    new = gates[:, h : 2 * h] * cell + gates[:, :h] * (2 * gates[:, 3 * h :] - 1)
                    out = gates[:, 2 * h : 3 * h] * np.tanh(new)
                    if lo + t >= shortest:  # pages that have ended keep their state
                        there = (lo + t < lengths)[:, None]
                        out, new = np.where(there, out, state), np.where(there, new, cell)
                    state, cell = out, new
                    states[t] = state
                odds[lo:hi] += states @ w["o"][part]
        return [_sigmoid(odds[:n, k]) for k, n in enumerate(lengths)]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over real blocks, back through time."""
        h, w = self.hidden, self.weights
        (forth, tape_f), (back, tape_b) = self.run(x, mask, "f"), self.run(x, mask, "b")
        both = np.concatenate([forth, back], axis=2)
        off = (_sigmoid(both @ w["o"] + w["d"]) - y) * mask / max(1, mask.sum())
        g = {"o": np.einsum("tp,tph->h", off, both), "d": np.array([off.sum()])}
        for way, tape, part in (("f", tape_f, slice(0, h)), ("b", tape_b, slice(h, 2 * h))):
            above = off[:, :, None] * w["o"][part]
            dz, dh = np.zeros((*x.shape[:2], 4 * h)), np.zeros(w[f"h{way}"].shape)
            d_state, d_cell = np.zeros(above.shape[1:]), np.zeros(above.shape[1:])
            for t, state, cell, i, f, o, fresh, squashed, m in reversed(tape):
                ds = d_state + above[t]
                dc = d_cell + np.where(m, ds * o * (1 - squashed**2), 0)
                z = np.hstack([dc * fresh * i * (1 - i), dc * cell * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - fresh**2)]) * m
                dz[t] = z
                dh += state.T @ z
                d_state = np.where(m, z @ w[f"h{way}"].T, ds)
                d_cell = np.where(m, dc * f, d_cell)
            g[f"x{way}"], g[f"h{way}"], g[f"c{way}"] = np.einsum("tpd,tpz->dz", x, dz), dh, dz.sum((0, 1))
        return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, feature) and the mask of real blocks."""
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


#: Containers of training variants, as (tag, words of its class or id).
_MAIN_PATHS = ("article", "main", "div content", "div post", "div entry content", "section article body", "div article text", "div story", "div main content", "div")
_OTHER_PATHS = (
    "nav", "header", "footer", "aside", "form", "div ad", "div ads", "div advert", "div sidebar", "div menu", "div cookie", "div cookie notice", "div notice", "div comments", "section comments",
    "div banner", "div promo", "div related", "div share", "div social", "ul menu", "div newsletter", "div breadcrumbs", "div footer", "div header", "div nav", "div consent", "div alert", "div comment", "ol comment list", "div sponsored", "div modal",
)
_MAIN_LEAVES = (("p",), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("blockquote",), ("pre",), ("table", "tbody", "tr", "td"), ("h2",), ("h3",), ("div",), ("section", "p"), ("div", "p"), ("figure", "figcaption"), ("dl", "dd"))
_LONG_OTHER = tuple(p for p in _OTHER_PATHS if set(p.split()) & {"comments", "comment", "aside", "sidebar", "related", "cookie", "notice", "advert", "promo", "sponsored", "form"})


def training_pages(pages: list[str | None], rng: np.random.Generator, variants: int = 3) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled block sequences. A page's own telling names give its labels; variants put its main and other blocks
    into other containers, with comments, side boxes, notices and forms of other pages' sentences around and inside."""
    out, mains, others = [], [], []
    own = [(blocks, [marked(b) for b in blocks]) for blocks in map(leaf_blocks, pages) if blocks]
    for blocks, labels in own:
        mains += [b for b, k in zip(blocks, labels, strict=True) if k == 1]
        others += [b for b, k in zip(blocks, labels, strict=True) if k == 0]
        if any(k == 1 for k in labels):
            out.append((blocks, np.array([k or 0 for k in labels], float)))

    def other(long: bool, inside: tuple[str, ...] = ()) -> list[Block]:
        kinds = _LONG_OTHER if long else _OTHER_PATHS
        path = nested("html", "body", *inside, kinds[rng.integers(len(kinds))])
        source = mains if long and mains else others or mains
        picked = [source[rng.integers(len(source))] for _ in range(rng.integers(1, 5))]
        leaf = [[], ["p"], ["ul", "li"], ["div"]][rng.integers(4)]
        return [Block(b.text, nested(*leaf, inside=path), b.linked if not long else 0.0) for b in picked]

    if mains:
        for blocks, labels in own * variants:
            body = [b for b, k in zip(blocks, labels, strict=True) if k == 1]
            if not body:
                continue
            container = (["div wrapper"] if rng.random() < 0.4 else []) + [_MAIN_PATHS[rng.integers(len(_MAIN_PATHS))]]
            made: list[tuple[Block, int]] = []
            for _ in range(rng.integers(1, 4)):
                made += [(b, 0) for b in other(rng.random() < 0.2)]
            for b in body:
                tag = b.path.names.split()[0] if b.path else "p"
                own_leaf = "p" if tag in ("article", "main", "div", "section") else tag
                leaf = [own_leaf] if rng.random() < 0.6 else list(_MAIN_LEAVES[rng.integers(len(_MAIN_LEAVES))])
                made.append((Block(b.text, nested("html", "body", *container, *leaf), b.linked), 1))
                if rng.random() < 0.25:  # a heading or a list of short items, inside the article
                    short = list(_MAIN_LEAVES[rng.integers(len(_MAIN_LEAVES))])
                    for _ in range(rng.integers(1, 5) if short[-1] in ("li", "td", "dd") else 1):
                        words = mains[rng.integers(len(mains))].text.split()
                        begin = rng.integers(len(words))
                        cut = " ".join(words[begin : begin + rng.integers(2, 12)])
                        made.append((Block(cut, nested("html", "body", *container, *short), 0.0), 1))
                if rng.random() < 0.12:
                    made += [(o, 0) for o in other(rng.random() < 0.5, tuple(container))]
            for _ in range(rng.integers(1, 5)):
                made += [(b, 0) for b in other(rng.random() < 0.5)]
            out.append(([b for b, _ in made], np.array([k for _, k in made], float)))
    return out


def fit(pages: list[str | None], *, rounds: int = 10, seed: int = 17) -> BlockLabeller | None:
    """Train on pages' own markup; None if no page has any telling name."""
    rng = np.random.default_rng(seed)
    made = training_pages(pages, rng)
    if not made:
        return None
    made.sort(key=lambda m: len(m[0]))
    sets = []
    for at in range(0, len(made), 32):
        x, mask = _padded([block_vectors(b) for b, _ in made[at : at + 32]])
        y = np.zeros(mask.shape)
        for k, (_, labels) in enumerate(made[at : at + 32]):
            y[: len(labels), k] = labels
        sets.append((x, mask, y))
    model = BlockLabeller()
    model.start(sets[0][0].shape[2], rng)
    m, v, step = {k: np.zeros_like(w) for k, w in model.weights.items()}, {k: np.zeros_like(w) for k, w in model.weights.items()}, 0
    for _ in range(rounds):
        for k in rng.permutation(len(sets)):
            step += 1
            for name, g in model.gradients(*sets[k]).items():  # Adam
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                model.weights[name] -= 0.02 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return model


def label_pages(model: BlockLabeller | None, pages: list[list[Block]], threshold: float = 0.5) -> list[np.ndarray]:
    """A truth value for each block. Pages of like length run together; without a model (no page taught any) every block is main, so nothing is lost."""
    out = [np.ones(len(p), bool) for p in pages]
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k])) if model is not None else []
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and upto - at < 256 and len(pages[order[upto]]) * (upto - at + 1) <= 20_000:
            upto += 1
        group = order[at:upto]
        for k, p in zip(group, model.probabilities([pages[k] for k in group]), strict=True):
            out[k] = p >= threshold
        at = upto
    return out


def train(pages: DataFrame, *, max_pages: int = 200, seed: int = 17) -> BlockLabeller | None:
    """Fit on at most ``max_pages`` pages, the least by a seeded hash of the id, in one task; only the weights come to the driver.

    Null pages and ids teach nothing. None if no page of the sample has a telling name.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_id").cast("string")).cast("binary"))
    known = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
    picked = known.select("page_id", draw.alias("draw")).orderBy("draw", "page_id").limit(max_pages).distinct()
    # max_pages ids bound this side; the rows that they find are cut to max_pages again, since ids may repeat.
    sample = known.select("page_id", "html").join(F.broadcast(picked), "page_id")
    sample = sample.orderBy("draw", "page_id", F.xxhash64("html")).limit(max_pages).select("page_id", "html")

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"page_id": [], "html": []})]).sort_values(["page_id", "html"], kind="stable")
        yield pd.DataFrame({"model": [pickle.dumps(fit(list(rows["html"]), seed=seed))]})

    row = sample.repartition(1).mapInPandas(fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], seed=seed)  # Spark skips the task of an empty sample


def extract_main_text(pages: DataFrame, model: BlockLabeller | None) -> DataFrame:
    """All columns of ``pages`` with ``text`` and ``n_chars``, replacing columns of those names.

    ``text`` joins the blocks that the model labels as main, in page order, by new lines; null, empty and
    contentless pages give an empty string. Whole pages are read whatever their length and faults, and whole blocks judged. A text follows
    from the page alone, so repeated rows and rows of null id have equal ones. One pass, no shuffle; an empty table gives no rows.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        blocks = [leaf_blocks(h) for h in htmls]
        return pd.Series(["\n".join(b.text for b, k in zip(own, main, strict=True) if k) for own, main in zip(blocks, label_pages(held.value, blocks), strict=True)], dtype=object)

    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    found = pages.withColumn("__text", extract(F.col("html"))).select(*rest, F.col("__text").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
