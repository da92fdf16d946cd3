"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: the text between block-level tags, each with the tags, classes
and ids above it. A bidirectional LSTM in numpy reads, block by block, the hashed path, the hashed words and a
few counts, and labels each block with the whole page in view; the blocks labelled main text are joined.

There are no labelled pages, so the network learns from pages whose markup says what is main text (an
article or main element, apart from containers that say they are something else), and from
copies of them changed as other sites would be: more menus, notices, forms and comments put in, and
the telling elements replaced by plain ones with telling or no class names.
"""

from __future__ import annotations

import html as entities
import json
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velomart.llm.common import bounded_sample, slices
from velomart.llm.words import by_size

# HTML's block-level elements, those without content, and those whose content is not markup.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|svg|math|iframe|object|audio|video|canvas|xmp|noembed|noframes"
#: An open element of these ends when another of its group opens beside it.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

MARKUP = (
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<empty>svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
)
ATTRIBUTE = r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""

PATH_DIM, WORD_DIM, COUNT_DIM = 384, 64, 8
HIDDEN = 16


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int = 0


class Cutter:
    """Cuts pages into leaf blocks; tolerant of unclosed and stray tags."""

    def __init__(self):
        self.markup = re.compile(MARKUP, re.S | re.I)
        self.attribute = re.compile(ATTRIBUTE, re.I)
        self.names: dict[tuple[str, str], tuple[str, ...]] = {}

    def _name(self, tag: str, rest: str) -> tuple[str, ...]:
        """The tag and the words of its class, id and role."""
        key = (tag, rest)
        if key not in self.names:
            words = [tag]
            for name, value in self.attribute.findall(rest) if rest else ():
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))
                    words += [f".{w}" for w in parts]
                elif name == "hidden" or value.replace(" ", "") in ("true", "display:none"):
                    words.append(".hidden")
            if len(self.names) > 100_000:
                self.names.clear()
            self.names[key] = tuple(words)
        return self.names[key]

    def blocks(self, page: str) -> list[Block]:
        """Leaf blocks in page order. White space, ends of lines included, is one space; empty blocks are left out."""
        found: list[Block] = []
        stack: list[tuple[str, tuple[str, ...]]] = []
        parts: list[str] = []
        state = [0, 0]  # depth of links, characters in them

        def flush() -> None:
            if parts:
                raw = "".join(parts)
                text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
                if text:
                    found.append(Block(tuple(w for _, words in stack for w in words), text, state[1]))
                parts.clear()
            state[1] = 0

        at = 0
        for m in self.markup.finditer(page):
            if m.start() > at:
                piece = page[at : m.start()]
                parts.append(piece)
                if state[0]:
                    state[1] += len(piece)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"] or m["empty"]:
                    parts.append(" ")
                continue
            tag = tag.lower()
            if tag == "a":
                state[0] = 0 if m["end"] else 1
            elif tag == "br":
                parts.append(" ")
            if tag not in BLOCK and not (tag not in VOID and "-" in tag):
                continue
            flush()
            if m["end"]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        del stack[depth:]
                        break
                state[0] = 0
            elif tag not in VOID:
                if stack and (stack[-1][0] == "p" or stack[-1][0] in SIBLINGS.get(tag, ())):
                    stack.pop()
                stack.append((tag, self._name(tag, m["rest"])))
        if at < len(page):
            parts.append(page[at:])
        flush()
        return found


# Words in class names and ids, and elements, that say what a container holds.
NOISE_TAGS = frozenset("nav header footer aside form button select option label dialog menu head title fieldset legend".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget related recommended "
    "share sharing social comment comments reply replies discussion disqus respond newsletter subscribe signup login search pagination pager "
    "tags copyright legal hidden toolbar form contentinfo complementary dialog".split()
)
MAIN_TAGS = ("article", "main")
MAIN_WORDS = ("article", "content", "main", "post", "entry", "story", "body")


def marked(block: Block) -> bool:
    """Whether the markup itself says that a block is main text.

    A form inside the main element is noise; one around it is how some sites wrap whole pages.
    """
    inside = [k for k, w in enumerate(block.path) if w in MAIN_TAGS or w == ".article"]
    return bool(inside) and not any(
        w[1:] in NOISE_WORDS if w[0] == "." else w in NOISE_TAGS and (w != "form" or k > inside[0]) for k, w in enumerate(block.path)
    )


def varied(blocks: list[tuple[Block, bool]], texts: list[str], rng: random.Random) -> list[tuple[Block, bool]]:
    """The page as another site might have it: further noise put in, telling elements exchanged."""
    out = list(blocks)
    for _ in range(rng.randint(2, 7)):
        word = rng.choice(sorted(NOISE_WORDS))
        tag = rng.choice(sorted(NOISE_TAGS - {"head", "title"}))
        container = rng.choice([(tag,), (tag, f".{word}"), ("div", f".{word}"), ("section", f".{word}"), ("ul", f".{word}"), ("div", f".{word}", f".{rng.choice(['box', 'wrapper', 'area', 'bar', 'list', 'container'])}")])
        at = rng.randint(0, len(out)) if rng.random() < 0.5 else rng.choice([k for k, (_, y) in enumerate(out) if y] or [0])
        inner = out[at - 1][0].path if at and rng.random() < 0.7 else ("html", "body")
        within = tuple(w for w in inner if w not in ("p", "h1", "li", "a"))
        items = [
            (Block((*within, *container, *rng.choice([(), ("p",), ("ul", "li"), ("div",), ("li",), ("div", "p")])), text, rng.choice([0, 0, len(text)])), False)
            for text in rng.choices(texts, k=rng.randint(1, 5))
        ]
        out[at:at] = items
    if rng.random() < 0.5:
        old = {"article": rng.choice([("main",), ("div", f".{rng.choice(MAIN_WORDS)}"), ("section", f".{rng.choice(MAIN_WORDS)}"), ("div",), ("article",)])}
        for tag in ("nav", "header", "footer", "aside"):
            old[tag] = rng.choice([("div", f".{tag}"), (tag,), (tag,), ("div", ".menu" if tag == "nav" else f".{tag}")])
        exchange = lambda path: tuple(w for part in path for w in old.get(part, (part,)))
        out = [(Block(exchange(b.path), b.text, b.link_chars), y) for b, y in out]
    inside, left = ("p",), 0
    for k, (b, y) in enumerate(out):
        if y and b.path and b.path[-1] == "p":
            if not left and rng.random() < 0.25:
                inside = rng.choice([("h2",), ("h3",), ("ul", "li"), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("div", "p"), ("section", "p"), ("pre",), ("table", "tr", "td"), ("table", "tfoot", "tr", "td"), ("table", "caption"), ("figure", "p"), ("figure", "figcaption"), ("figure", "figcaption")])
                left = rng.randint(1, 4)
            if left:
                left -= 1
                text = b.text if rng.random() < 0.5 else " ".join(b.text.split()[: rng.randint(1, 8)])
                out[k] = (Block((*b.path[:-1], *inside), text, b.link_chars), y)
    if rng.random() < 0.1:  # nothing but the article, as in print views
        out = [(b, y) for b, y in out if y] or out
    if rng.random() < 0.3:  # one form around the whole page
        wrap = lambda path: (*path[:2], "form", *path[2:]) if path[:2] == ("html", "body") else ("form", *path)
        out = [(Block(wrap(b.path), b.text, b.link_chars), y) for b, y in out]
    return out


class Features:
    """Blocks of pages as rows of numbers: path parts and words hashed, and counts."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            row = np.zeros(PATH_DIM, np.float32)
            for part in {*path, f"leaf {path[-1]}" if path else "none"}:
                row[zlib.crc32(part.encode()) % PATH_DIM] += 1
            self.paths[path] = row
        return self.paths[path]

    def rows(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        if len(self.words) > 500_000:
            self.words.clear()
        hashed, owner, counts = [], [], np.zeros((n, COUNT_DIM), np.float32)
        get = self.words.get
        for k, b in enumerate(blocks):
            words = b.text.split()
            for w in words:
                h = get(w)
                if h is None:
                    h = self.words[w] = zlib.crc32(w.encode()) % WORD_DIM
                hashed.append(h)
            owner.append(len(words))
            size = len(b.text)
            counts[k] = (
                np.log1p(size) / 5, np.log1p(len(words)) / 4, min(1, b.link_chars / size), size < 25,
                b.text[-1] in ".!?", b.text[:1].isupper(), "©" in b.text, 1,
            )
        bag = np.bincount(np.repeat(np.arange(n), owner) * WORD_DIM + np.array(hashed, np.int64), minlength=n * WORD_DIM).reshape(n, WORD_DIM)
        bag = bag / np.maximum(1, np.array(owner))[:, None]
        return np.concatenate([np.stack([self.path(b.path) for b in blocks]), bag, counts], axis=1, dtype=np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """One LSTM per direction over the rows of a page, and a logistic output on both states."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> Labeller:
        rng = np.random.default_rng(seed)
        dim = PATH_DIM + WORD_DIM + COUNT_DIM
        w = {}
        for d in "fb":
            w[f"{d}x"] = rng.normal(0, 0.1, (dim, 4 * HIDDEN))
            w[f"{d}h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"{d}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["o"] = rng.normal(0, 0.2, 2 * HIDDEN)
        w["oc"] = np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, d: str, z: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States along time (first axis) for inputs ``z``; rows that are not ``live`` carry the state on."""
        steps, batch, _ = z.shape
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((steps, batch, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = z[t] + h @ self.weights[f"{d}h"]
            act = _sigmoid(gates[:, : 3 * HIDDEN])
            i, f, o = act[:, :HIDDEN], act[:, HIDDEN : 2 * HIDDEN], act[:, 2 * HIDDEN :]
            g = np.tanh(gates[:, 3 * HIDDEN :])
            on = live[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, on))
            c = np.where(on, new, c)
            h = np.where(on, o * tanh, h)
            out[t] = h
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text for each row of each page."""
        if not pages:
            return []
        flat = np.concatenate(pages)
        lengths = np.array([len(p) for p in pages])
        first = np.cumsum(lengths) - lengths
        z = {d: flat @ self.weights[f"{d}x"] + self.weights[f"{d}c"] for d in "fb"}
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):  # pages of like length together
            longest = max(8, 2 * lengths[order[at]])
            group = order[at : at + 256]
            group = group[lengths[group] <= longest]
            at += len(group)
            steps = int(lengths[group].max())
            live = np.arange(steps)[:, None] < lengths[group][None, :]
            index = np.where(live, first[group][None, :] + np.arange(steps)[:, None], 0)
            states = np.concatenate([self._run(d, z[d][index], live, None) for d in "fb"], axis=2)
            p = _sigmoid(states @ self.weights["o"] + self.weights["oc"])
            for k, page in enumerate(group):
                out[page] = p[: lengths[page], k]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 14, batch: int = 32, rate: float = 0.02, seed: int = 0) -> Labeller:
        """Adam on the mean log loss per block, gradients by back-propagation through time."""
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                group = order[at : at + batch]
                grads = self._gradients([pages[k] for k in group], [labels[k] for k in group])
                step += 1
                pace = rate * (1 - 0.9 * epoch / epochs)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1) + 1e-5 * self.weights[k]
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.weights[k] -= (pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        steps = int(lengths.max())
        x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        y = np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], y[: len(p), k] = p, labels[k]
        live = np.arange(steps)[:, None] < lengths[None, :]
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(d, x @ self.weights[f"{d}x"] + self.weights[f"{d}c"], live, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid(states @ self.weights["o"] + self.weights["oc"])
        error = np.where(live, p - y, 0) / live.sum()
        grads = {"o": np.einsum("tb,tbh->h", error, states), "oc": error.sum(keepdims=True).reshape(1)}
        back = error[:, :, None] * self.weights["o"]
        for d, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            dz = np.zeros((steps, len(pages), 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((len(pages), HIDDEN), np.float32)
            gh = np.zeros_like(self.weights[f"{d}h"])
            for t, h, c, i, f, o, g, tanh, on in reversed(kept[d]):
                dh = dh + part[t]
                into = np.where(on, dh, 0)
                cell = np.where(on, dc, 0) + into * o * (1 - tanh * tanh)
                dz[t] = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), into * tanh * o * (1 - o), cell * i * (1 - g * g)], axis=1)
                gh += h.T @ dz[t]
                dh = np.where(on, 0, dh) + dz[t] @ self.weights[f"{d}h"].T
                dc = np.where(on, cell * f, dc)
            grads[f"{d}x"] = np.einsum("tbd,tbk->dk", x, dz, optimize=True)
            grads[f"{d}h"], grads[f"{d}c"] = gh, dz.sum((0, 1))
        return grads


#: Pages that the labeller learns from at most, and blocks in a row of each.
SAMPLE_PAGES, SAMPLE_BLOCKS = 240, 48
#: Characters of html that are worked on at a time; a single page may have more.
CHARS = 2_000_000


def train(pages: DataFrame, seed: int = 0) -> Labeller:
    """Learn from a bounded sample of about ``SAMPLE_PAGES`` pages, chosen by a hash of their ids.

    Pages are cut into blocks in tasks; of a page of more than ``SAMPLE_BLOCKS`` a stretch at a hashed place is learnt.
    """
    rows = bounded_sample(pages.where("html IS NOT NULL").select("page_id", "html"), "page_id", SAMPLE_PAGES)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            found = [[(b.path, b.text, b.link_chars, y) for b, y in stretch(cutter, page)] for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(x) for x in found], pa.string())], ["blocks"])

    found = rows.select("html").mapInArrow(stretches, "blocks string").orderBy("blocks").limit(SAMPLE_PAGES).collect()
    return learnt_from([[(Block(tuple(path), text, link), y) for path, text, link, y in json.loads(r.blocks)] for r in found], seed)


def stretch(cutter: Cutter, page: str) -> list[tuple]:
    """Blocks of a page in a row, each with whether its markup says that it is main text."""
    whole = [(b, marked(b)) for b in cutter.blocks(page)]
    start = zlib.crc32(page.encode()) % max(1, len(whole) - SAMPLE_BLOCKS + 1)
    return whole[start : start + SAMPLE_BLOCKS]


def fitted(sample: list[str], seed: int = 0) -> Labeller:
    """A labeller from pages with telling markup; without any, from the built-in outline alone."""
    cutter = Cutter()
    return learnt_from([stretch(cutter, page) for page in sample], seed)


def learnt_from(sample: list[list[tuple]], seed: int = 0) -> Labeller:
    features, rng = Features(), random.Random(seed)
    whole = [w for w in sample if any(y for _, y in w)] or [stretch(Cutter(), OUTLINE)]
    texts = [b.text for w in whole for b, _ in w]
    copies = max(120, 2 * len(whole))
    learnt = [*whole, *(varied(whole[k % len(whole)], texts, rng) for k in range(copies))]
    learnt = [w[(at := rng.randrange(max(1, len(w) - 2 * SAMPLE_BLOCKS + 1))) : at + 2 * SAMPLE_BLOCKS] for w in learnt if w]
    return Labeller.fresh(seed).fit(
        [features.rows([b for b, _ in w]) for w in learnt], [np.array([y for _, y in w], np.float32) for w in learnt], seed=seed
    )


OUTLINE = "<body><nav><ul><li><a>Home</a></ul></nav><article><h1>Title</h1><p>Text.</p><p>More text.</p></article><footer>End</footer>"


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text, blocks): the main text of every page, and each kept block's place among all blocks.

    Null or empty html: empty text. Rows with one page_id are pages of their own; further columns are left out.
    """
    weights = pages.sparkSession.sparkContext.broadcast(labeller.weights)
    kind = pages.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, features, model = Cutter(), Features(), Labeller(weights.value)
        for whole in slices(batches, 256):
            for part in by_size(whole.column("html").to_pylist(), CHARS):
                batch = whole.slice(part.start, part.stop - part.start)
                cut = [cutter.blocks(page or "") for page in batch.column("html").to_pylist()]
                full = [k for k, blocks in enumerate(cut) if blocks]
                rows = features.rows([b for blocks in cut for b in blocks]) if full else np.zeros((0, 1))
                ends = np.cumsum([len(cut[k]) for k in full])
                scores = model.scores(np.split(rows, ends[:-1])) if full else []
                kept: list[list[int]] = [[] for _ in cut]
                for k, p in zip(full, scores, strict=True):
                    kept[k] = np.flatnonzero(p >= 0.5).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("url"),
                        pa.array(["\n".join(blocks[k].text for k in keep) for blocks, keep in zip(cut, kept, strict=True)], pa.string()),
                        pa.array(kept, pa.list_(pa.int32())),
                    ],
                    ["page_id", "url", "text", "blocks"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(texts, f"page_id {kind}, url string, text string, blocks array<int>")
