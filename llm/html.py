"""Main text of web pages: a bidirectional LSTM labels the blocks of a page in their order."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow, one_thread
from llm.layouts import restyled

#: Pages about that the labeller learns from, chosen by hash; layouts made from them, in turn.
FIT_PAGES, LAYOUTS = 1_200, 3_600
HIDDEN, PATH_DIM, WORD_DIM = 20, 20, 8
PATH_SLOTS, WORD_SLOTS = 4_096, 8_192
EPOCHS, LANES, RATE = 5, 48, 0.01

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<!?/?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)(.*)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand inside a line of text; all others begin and end blocks.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_UNSEEN = frozenset(("head", "title"))
_MAIN = ("<article", "<main")
_OTHER = ("<nav", "<aside", "<footer", "<header", "<form", "<button", "<select", "<textarea", ".ad", ".ads", ".comments", ".comment", ".sidebar", ".cookie", ".menu")


class Place:
    """An open tag with those around it: a block's path is its place's marks and all above.

    Blocks share places, so that a page's paths take no more room than its tags.
    """

    __slots__ = ("above", "name", "marks", "depth", "count", "last", "block", "unseen", "linked", "main", "other")

    def __init__(self, above: Place | None, name: str, marks: list[str]):
        self.above, self.name, self.marks = above, name, marks
        self.depth, self.count = (above.depth + 1, above.count + len(marks)) if above else (0, len(marks))
        self.last = [*above.last, *marks][-8:] if above else marks[-8:]
        #: The nearest place, itself included, that is no tag of running text.
        self.block = above.block if above and name in _INLINE else self
        self.unseen = name in _UNSEEN or bool(above and above.unseen)
        self.linked = name == "a" or bool(above and above.linked)
        self.main = bool(above and above.main) or any(m in _MAIN for m in marks)
        self.other = bool(above and above.other) or any(m in _OTHER for m in marks)

    @property
    def path(self) -> list[str]:
        chain, at = [], self
        while at:
            chain.append(at.marks)
            at = at.above
        return [m for marks in reversed(chain) for m in marks]


@dataclass
class Block:
    """A run of text between block tags, the place it stands at (or its path's marks), and how much of it is in links."""

    text: str
    place: Place | list[str]
    linked: int = 0

    def __post_init__(self):
        if isinstance(self.place, list):
            self.place = Place(None, "", self.place)

    @property
    def path(self) -> list[str]:
        return self.place.path


def _marks(tag: str, rest: str) -> list[str]:
    """A tag's name and the parts of its class, id, role and similar names, the whole of each."""
    out = [f"<{tag}"]
    for _, value in _NAMED.findall(rest):
        for part in _PARTS.findall(value):
            low = part.lower()
            out += [f".{low}", *(f"~{low[:k]}" for k in (3, 4) if len(low) > k)]
    return out


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order, character references decoded, white space made one space.

    Comments, scripts, styles and the head carry no text. Tags left open end with their
    parent, a paragraph with the next block; what the page's end cuts off is closed there.
    Time and room grow with the page's length, however many tags are left open.
    """
    out: list[Block] = []
    root = at = Place(None, "", [])
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text and not at.unseen:
            out.append(Block(text, at, linked))
        pieces.clear()
        linked = 0

    def leave(last: Place):
        """End open tags up to and with ``last``."""
        nonlocal at
        while at is not last.above:
            opened[at.name] -= 1
            at = at.above

    for m in _PIECE.finditer(page or ""):
        piece = m[0]
        if piece[0] != "<" or len(piece) == 1:
            pieces.append(piece)
            if at.linked:
                linked += len(piece)
            continue
        tag = _TAG.match(piece)
        if m[1] or not tag:
            continue
        closing, name, rest = tag[1], tag[2].lower(), tag[3]
        if name not in _INLINE:
            flush()
        elif name in ("br", "img", "wbr"):
            pieces.append(" ")
        if closing:
            if opened[name]:
                last = at
                while last.name != name:
                    last = last.above
                leave(last)
        else:
            if name not in _INLINE and at.block is not root and (at.block.name == "p" or at.block.name in _CLOSES.get(name, ())):
                leave(at.block)
            if name not in _VOID and not rest.endswith("/>"):
                at = Place(at, name, _marks(name, rest))
                opened[name] += 1
    flush()
    return out


def _slot(mark: str, slots: int) -> int:
    return zlib.crc32(mark.encode("utf-8", "replace")) % slots


N_NUMBERS = 12


def numbers(found: list[Block]) -> np.ndarray:
    """Length, links, punctuation and place of each block."""
    out = np.zeros((len(found), N_NUMBERS), np.float32)
    for k, b in enumerate(found):
        n, t = len(b.text), b.text
        ends = t[-1] in ".!?…\"”"
        out[k] = [np.log1p(n) / 6, min(1.0, b.linked / n), (t.count(",") + t.count(".")) / n * 20, float(ends), float(t.count(" ") < 4), float("©" in t or "®" in t),
                  sum(map(t.count, "0123456789")) / n, k / max(1, len(found) - 1), 1 / (1 + k), 1 / (len(found) - k), min(b.place.count / 20, 50), float("|" in t or "»" in t or "›" in t)]
    return out


def _bags(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots one after the other, the row of each, and one over the length of its list."""
    lengths = np.array([len(x) for x in lists])
    return np.fromiter((i for x in lists for i in x), np.int64, int(lengths.sum())), np.repeat(np.arange(len(lists)), lengths), (1 / np.repeat(np.maximum(lengths, 1), lengths)).astype(np.float32)


@dataclass
class Paths:
    """The places of blocks as a forest: slots of each place's own marks, its parent, and its depth."""

    slots: np.ndarray
    owner: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    #: The place of each block, and one over the marks of its path.
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, found: list[Block]) -> Paths:
        number: dict[int, int] = {}
        order: list[Place] = []
        for b in found:
            chain, at = [], b.place
            while at and id(at) not in number:
                number[id(at)] = -1
                chain.append(at)
                at = at.above
            for at in reversed(chain):
                number[id(at)] = len(order)
                order.append(at)
        lengths = np.array([len(p.marks) for p in order], np.int64)
        slots = np.fromiter((_slot(m, PATH_SLOTS) for p in order for m in p.marks), np.int64, int(lengths.sum()))
        return cls(slots, np.repeat(np.arange(len(order)), lengths), np.array([number[id(p.above)] if p.above else -1 for p in order], np.int64),
                   np.array([p.depth for p in order], np.int64), np.array([number[id(b.place)] for b in found], np.int64),
                   np.array([1 / max(1, b.place.count) for b in found], np.float32))

    @classmethod
    def joined(cls, parts: list[Paths]) -> Paths:
        shift = np.cumsum([0, *(len(p.parent) for p in parts)])
        whole = lambda name, moved: np.concatenate([getattr(p, name) + (s if moved else 0) for p, s in zip(parts, shift)])
        parent = np.concatenate([np.where(p.parent < 0, -1, p.parent + s) for p, s in zip(parts, shift)])
        return cls(whole("slots", False), whole("owner", True), parent, whole("depth", False), whole("place", True), whole("weight", False))

    def levels(self) -> list[np.ndarray]:
        """Places of each depth from 1 on."""
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))[1:]

    def means(self, table: np.ndarray) -> np.ndarray:
        """The mean of each block's path marks: sums run down from a place to those within it."""
        sums = np.zeros((len(self.parent), table.shape[1]), np.float32)
        np.add.at(sums, self.owner, table[self.slots])
        for level in self.levels():
            sums[level] += sums[self.parent[level]]
        return sums[self.place] * self.weight[:, None]

    def add_gradient(self, grad: np.ndarray, into: np.ndarray) -> None:
        """Add to a table's gradient what the blocks' means got: sums run up."""
        sums = np.zeros((len(self.parent), into.shape[1]), np.float32)
        np.add.at(sums, self.place, into * self.weight[:, None])
        for level in reversed(self.levels()):
            np.add.at(sums, self.parent[level], sums[level])
        np.add.at(grad, self.slots, sums[self.owner])


class Labeller:
    """Embeddings of hashed path marks and words, one LSTM in each direction, one logit per block."""

    def __init__(self, seed: int = 2):
        rng, h = np.random.default_rng(seed), HIDDEN
        d = PATH_DIM * 2 + WORD_DIM + N_NUMBERS
        make = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"path": make(PATH_SLOTS, PATH_DIM), "last": make(PATH_SLOTS, PATH_DIM), "word": make(WORD_SLOTS, WORD_DIM)}
        for side in "fb":
            self.p |= {f"x{side}": make(d, 4 * h), f"h{side}": make(h, 4 * h), f"c{side}": np.zeros(4 * h, np.float32)}
            self.p[f"c{side}"][h : 2 * h] = 1
        self.p |= {"o": make(2 * h), "ob": np.zeros(1, np.float32), "skip": make(d)}

    def inputs(self, found: list[Block]):
        paths = Paths.of(found)
        lasts = _bags([[_slot(m, PATH_SLOTS) for m in b.place.last] for b in found])
        words = _bags([[_slot(w, WORD_SLOTS) for w in b.text.lower().split()] for b in found])
        return paths, lasts, words, numbers(found)

    def embed(self, bags) -> np.ndarray:
        paths, lasts, words, plain = bags
        out = [self._pool(name, bag, len(plain)) for name, bag in (("last", lasts), ("word", words))]
        return np.concatenate((paths.means(self.p["path"]), *out, plain), axis=1)

    def _pool(self, name: str, bag, n: int) -> np.ndarray:
        slots, row, weight = bag
        values = self.p[name][slots] * weight[:, None]
        out = np.zeros((n, values.shape[1]), np.float32)
        if len(slots):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def forward(self, x: np.ndarray, place: np.ndarray, keep: bool = False):
        """Logits of blocks whose rows ``place`` (time x lanes, -1 for none) deals out to lanes."""
        time, lanes = place.shape
        h, memory, sides = HIDDEN, {}, []
        on = place >= 0
        for side in "fb":
            gates_in = (x @ self.p[f"x{side}"] + self.p[f"c{side}"])
            state, cell = np.zeros((lanes, h), np.float32), np.zeros((lanes, h), np.float32)
            out, kept = np.zeros((time, lanes, h), np.float32), []
            for t in range(time) if side == "f" else range(time - 1, -1, -1):
                live = on[t][:, None]
                g = gates_in[np.maximum(place[t], 0)] + state @ self.p[f"h{side}"]
                s = 1 / (1 + np.exp(-g[:, : 3 * h]))
                i, f, o, n = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(g[:, 3 * h :])
                new = f * cell + i * n
                squashed = np.tanh(new)
                if keep:
                    kept.append((t, state, cell, i, f, o, n, squashed))
                state, cell = np.where(live, o * squashed, state), np.where(live, new, cell)
                out[t] = state
            sides.append(out[on])
            memory[side] = kept
        rows = place[on]
        both = np.concatenate(sides, axis=1)
        logits = np.zeros(len(x), np.float32)
        logits[rows] = both @ self.p["o"] + self.p["ob"] + x[rows] @ self.p["skip"]
        return (logits, both, rows, memory) if keep else logits

    def gradient(self, bags, place: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        x = self.embed(bags)
        logits, both, rows, memory = self.forward(x, place, keep=True)
        p = 1 / (1 + np.exp(-logits))
        d = (p - labels) / max(1, len(labels))
        loss = float(-(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)).mean())
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"][:], grad["ob"][:], grad["skip"][:] = both.T @ d[rows], d.sum(), x.T @ d
        dx, h, on = d[:, None] * self.p["skip"], HIDDEN, place >= 0
        dboth = np.zeros((*place.shape, 2 * h), np.float32)
        dboth[on] = d[rows][:, None] * self.p["o"]
        for k, side in enumerate("fb"):
            dstate, dcell = np.zeros((place.shape[1], h), np.float32), np.zeros((place.shape[1], h), np.float32)
            for t, state, cell, i, f, o, n, squashed in reversed(memory[side]):
                live = on[t][:, None]
                ds = np.where(live, dstate + dboth[t, :, k * h : (k + 1) * h], 0)
                dc = np.where(live, dcell + ds * o * (1 - squashed**2), 0)
                g = np.concatenate((dc * n * i * (1 - i), dc * cell * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - n**2)), axis=1)
                grad[f"h{side}"] += state.T @ g
                dstate, dcell = np.where(live, g @ self.p[f"h{side}"].T, dstate), np.where(live, dc * f, dcell)
                own = place[t][on[t]]
                grad[f"x{side}"] += x[own].T @ g[on[t]]
                grad[f"c{side}"] += g[on[t]].sum(0)
                dx[own] += g[on[t]] @ self.p[f"x{side}"].T
        at = self.p["path"].shape[1]
        bags[0].add_gradient(grad["path"], dx[:, :at])
        for name, bag in zip(("last", "word"), bags[1:3]):
            slots, row, weight = bag
            width = self.p[name].shape[1]
            order = np.argsort(slots, kind="stable")
            if len(order):
                first = np.flatnonzero(np.r_[True, np.diff(slots[order]) > 0])
                grad[name][slots[order][first]] = np.add.reduceat((dx[:, at : at + width][row] * weight[:, None])[order], first, axis=0)
            at += width
        return grad, loss

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block to be main text; long pages go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        for start in range(0, len(order), 64):
            some = order[start : start + 64]
            x = self.embed(self.inputs([b for i in some for b in pages[i]]))
            cuts = np.cumsum([0, *(len(pages[i]) for i in some)])
            p = 1 / (1 + np.exp(-self.forward(x, _places(cuts))))
            for k, i in enumerate(some):
                out[i] = p[cuts[k] : cuts[k + 1]]
        return out


def _places(cuts: np.ndarray) -> np.ndarray:
    """Rows of consecutive sequences as time x lanes, -1 after each one's end."""
    lengths = np.diff(cuts)
    t = np.arange(lengths.max(initial=0))[:, None]
    return np.where(t < lengths[None, :], cuts[:-1][None, :] + t, -1)


def train(examples: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 4) -> Labeller:
    """A labeller from pages whose blocks are labelled, by backpropagation through time and Adam."""
    net, rng = Labeller(), np.random.default_rng(seed)
    examples = [e for e in examples if e[0]]
    bags = [net.inputs(e[0]) for e in examples]
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        order = np.concatenate([sorted(order[s : s + 8 * LANES], key=lambda i: len(examples[i][0])) for s in range(0, len(order), 8 * LANES)]) if len(order) else order
        for start in range(0, len(order), LANES):
            some = [int(i) for i in order[start : start + LANES]]
            cuts = np.cumsum([0, *(len(examples[i][0]) for i in some)])
            joined = (Paths.joined([bags[i][0] for i in some]), *(
                (np.concatenate([bags[i][b][0] for i in some]), np.concatenate([bags[i][b][1] + c for i, c in zip(some, cuts)]), np.concatenate([bags[i][b][2] for i in some]))
                for b in (1, 2)))
            plain = np.concatenate([bags[i][3] for i in some])
            labels = np.concatenate([np.array(examples[i][1], np.float32) for i in some])
            grad, _ = net.gradient((*joined, plain), _places(cuts), labels)
            step += 1
            rate = RATE * (1 - 0.8 * epoch / max(1, epochs - 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def taught(found: list[Block]) -> list[int] | None:
    """Labels of a page by tags that say what they hold; None where no tag says where its article is."""
    if not any(b.place.main for b in found):
        return None
    return [int(b.place.main and not b.place.other) for b in found]


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = FIT_PAGES, layouts: int = LAYOUTS, seed: int = 9) -> Labeller:
    """A labeller from about ``rows`` pages, chosen by a hash of the key.

    Pages whose tags say where the article is teach as they are, and lend their texts to
    ``layouts`` made layouts, under other tags, names and orders, with notices,
    sidebars, forms, adverts and comments. The driver gets the chosen pages' texts.
    """
    step = max(1, -(-pages.count() // rows))
    chosen = pages.where(F.col(html).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).select(html).limit(2 * rows).toPandas()[html].tolist()
    rng = np.random.default_rng(seed)
    examples, texts, rest = [], [], ["Home", "News", "About us"]
    for page in chosen:
        found = blocks(page)
        labels = taught(found)
        if labels is not None:
            examples.append((found, labels))
            texts.append([b.text for b, y in zip(found, labels) if y])
            rest += [b.text for b, y in zip(found, labels) if not y]
    texts = [t for t in texts if t] or [["A heading of some length", "Words make a line, and lines make a paragraph of this page. More of them follow here."] * 3] * 20
    # Other parts borrow lines of articles too, so that wording alone gives nothing away.
    rest += [line for own in texts for line in own[:3]]
    for k in range(layouts):
        page, wanted = restyled(rng, texts[k % len(texts)], rest)
        found = blocks(page)
        # Made texts carry a mark at their end that tells what they are.
        labels = [int(b.text.endswith(wanted)) for b in found]
        for b in found:
            b.text = b.text.replace(wanted, "").strip() or "."
        examples.append((found, labels))
    return train(examples)


def main_text(net: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, y in zip(own, p) if y >= 0.5) for own, p in zip(found, net.probabilities(found))]


def extract(pages: DataFrame, net: Labeller, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (key, text, n_chars): each whole page's main text, its blocks joined by line ends.

    Null, empty and text-free pages give an empty text. Broken markup is read as far as it
    goes. Repeated rows and null keys come out as they came in; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one_thread()
        texts = main_text(net, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "text", "n_chars"])

    return map_arrow(pages.select(key, F.col(html).cast("string").alias("#html")), run,
                     f"`{key}` {pages.schema[key].dataType.simpleString()}, text string, n_chars long", rows=256)
