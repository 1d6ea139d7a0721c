"""The main text of web pages by a recurrent block labeller.

A page is the sequence of its blocks. A bidirectional LSTM, in numpy, reads for
each block its hashed tag path, its hashed words and a few measures, and labels
it main text or not, with the whole page as context. It is trained on a bounded
sample of the pages themselves: the semantic elements of their markup give the
labels, and the same texts are laid out again under many other layouts, with
menus, notices, adverts, forms, sidebars and reader comments whose places are
known.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.llm.html_blocks import Block, blocks

SAMPLE = 200  # pages the labeller learns from
LAYOUTS = 1200  # pages laid out anew from their texts
PATH, WORDS, MEASURES = 192, 64, 10
HIDDEN = 24
EPOCHS = 6
BATCH = 32
LONGEST = 80  # blocks of a training page
INFER = 128  # pages labelled together
CELLS = 32_768  # blocks of such pages, padded to the longest: about 80 MB
RATE = 0.01

MAIN, OTHER = "\ue000", "\ue001"  # private characters that mark a laid-out block's label


_DIGIT = re.compile(r"\d")


def _slot(word: str, n: int) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=4).digest(), "little") % n


@lru_cache(maxsize=100_000)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Slots of a path's parts and of neighbouring tags."""
    tags = [p for p in path if p[0] != "."]
    joined = [f"{a}>{b}" for a, b in zip(tags, tags[1:])][-3:]
    return np.unique([_slot(p, PATH) for p in (*path, *joined, "last " + (tags[-1] if tags else ""))])


def features(page: list[Block], at: int = 0, blocks: int | None = None) -> np.ndarray:
    """One row a block; a slice of a page says where it begins and how many blocks the page has."""
    n = len(page)
    blocks = n if blocks is None else blocks
    out = np.zeros((n, PATH + WORDS + MEASURES), np.float32)
    texts = [b.text for b in page]
    hashes, first = textkit.word_hashes(*textkit.flat(pa.array(texts, pa.string())))
    row = np.repeat(np.arange(n), np.diff(first))
    slot = (hashes >> np.uint64(58)).astype(np.int64)
    sign = np.where((hashes >> np.uint64(57)) & np.uint64(1), 1.0, -1.0)
    words = np.bincount(row * WORDS + slot, weights=sign, minlength=n * WORDS).reshape(n, WORDS)
    size = np.maximum(np.diff(first), 1)[:, None]
    out[:, PATH : PATH + WORDS] = words / np.sqrt(size)
    for i, b in enumerate(page):
        out[i, _path_slots(b.path)] = 1
    length = np.array([len(t) for t in texts], float)
    out[:, PATH + WORDS :] = np.stack(
        [
            np.log1p(length) / 7,
            np.log1p(size[:, 0]) / 6,
            np.array([b.linked for b in page]) / length,
            length / size[:, 0] / 10,
            np.array([t[-1] in ".!?…。:;\"”»" for t in texts], float),
            np.array([t.count(". ") + t.count(", ") for t in texts]) / length * 20,
            np.array([len(_DIGIT.findall(t)) for t in texts]) / length,
            np.arange(at, at + n) / blocks,
            1 - np.arange(at, at + n) / blocks,
            np.full(n, np.log1p(blocks) / 6),
        ],
        axis=1,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of the two directions and of the output."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        d, h = PATH + WORDS + MEASURES, HIDDEN
        w = {}
        for side in "fb":
            w[side + "x"] = rng.normal(0, 0.1, (d, 4 * h))
            w[side + "h"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            w[side + "o"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # open gates
        w["y"], w["c"], w["skip"] = rng.normal(0, 0.1, 2 * h), np.zeros(1), np.zeros(d)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _direction(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None, carry: list | None = None) -> np.ndarray:
        """States over time; x is (time, pages, features), and mask says which blocks exist.

        ``carry`` holds state and cell from one slice of a page to the next.
        """
        w, h = self.weights, HIDDEN
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        inputs = x @ w[side + "x"] + w[side + "o"]
        state = cell = np.zeros((x.shape[1], h), np.float32)
        if carry:
            state, cell = carry
        out = np.zeros((*x.shape[:2], h), np.float32)
        for t in steps:
            gates = inputs[t] + state @ w[side + "h"]
            i, f, o = (_sigmoid(gates[:, k * h : (k + 1) * h]) for k in range(3))
            g = np.tanh(gates[:, 3 * h :])
            m = mask[t][:, None]
            after = f * cell + i * g
            tanh = np.tanh(after)
            if keep is not None:
                keep.append((t, i, f, o, g, cell, tanh, state, m))
            cell = np.where(m, after, cell)
            state = np.where(m, o * tanh, state)
            out[t] = state
        if carry is not None:
            carry[:] = state, cell
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        sides = []
        for side in "fb":
            trace = [] if keep is not None else None
            sides.append(self._direction(side, x, mask, trace))
            if keep is not None:
                keep[side] = trace
        both = np.concatenate(sides, axis=2)
        if keep is not None:
            keep["both"] = both
        w = self.weights
        return both @ w["y"] + x @ w["skip"] + w["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the blocks, through time."""
        keep: dict = {}
        p = _sigmoid(self.scores(x, mask, keep))
        error = (np.where(mask, p - labels, 0) / mask.sum()).astype(np.float32)
        w, h = self.weights, HIDDEN
        out = {
            "y": np.einsum("tn,tnh->h", error, keep["both"]),
            "c": np.array([error.sum()], np.float32),
            "skip": np.einsum("tn,tnd->d", error, x),
        }
        for at, side in enumerate("fb"):
            d_both = error[:, :, None] * w["y"][at * h : (at + 1) * h]
            d_state = d_cell = np.zeros((x.shape[1], h), np.float32)
            d_gates = np.zeros((*x.shape[:2], 4 * h), np.float32)
            d_hidden = np.zeros_like(w[side + "h"])
            for t, i, f, o, g, cell, tanh, before, m in reversed(keep[side]):
                d_out = d_both[t] + d_state
                d_after = (d_out * o * (1 - tanh**2) + d_cell) * m
                d = np.concatenate(
                    [
                        d_after * g * i * (1 - i),
                        d_after * cell * f * (1 - f),
                        d_out * m * tanh * o * (1 - o),
                        d_after * i * (1 - g**2),
                    ],
                    axis=1,
                )
                d_gates[t] = d
                d_hidden += before.T @ d
                d_state = d @ w[side + "h"].T + np.where(m, 0, d_out)
                d_cell = d_after * f + np.where(m, 0, d_cell)
            out[side + "x"] = np.einsum("tnd,tng->dg", x, d_gates, optimize=True)
            out[side + "h"] = d_hidden
            out[side + "o"] = d_gates.sum(axis=(0, 1))
        return out

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length go together.

        A group is bounded by its cells once padded to its longest page; a page
        beyond that bound goes alone, in slices.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            if len(pages[order[-1]]) > CELLS:
                i = order.pop()
                out[i] = self.long_scores(pages[i]) > 0
                continue
            some = order[-max(1, min(INFER, CELLS // len(pages[order[-1]]))) :]
            del order[-len(some) :]
            x, mask = _stacked([features(pages[i]) for i in some])
            found = self.scores(x, mask) > 0
            for n, i in enumerate(some):
                out[i] = found[: len(pages[i]), n]
        return out

    def long_scores(self, page: list[Block], size: int | None = None) -> np.ndarray:
        """The scores of one page, of which a slice of blocks is held at a time in each direction."""
        size = size or CELLS
        w, h, n = self.weights, HIDDEN, len(page)
        out = np.full(n, w["c"][0], np.float32)
        starts = range(0, n, size)
        for at, side in enumerate("fb"):
            carry: list = []
            for lo in starts if side == "f" else reversed(starts):
                some = page[lo : lo + size]
                x = features(some, lo, n)[:, None]
                states = self._direction(side, x, np.ones((len(some), 1), bool), None, carry)
                out[lo : lo + size] += states[:, 0] @ w["y"][at * h : (at + 1) * h]
                if side == "f":
                    out[lo : lo + size] += x[:, 0] @ w["skip"]
        return out

    def extract(self, pages: list[str | None]) -> list[str]:
        """The main text of each page: its main blocks, one a line."""
        parsed = [blocks(p) for p in pages]
        return [
            "\n".join(b.text for b, main in zip(page, found, strict=True) if main)
            for page, found in zip(parsed, self.label(parsed), strict=True)
        ]


def _stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages side by side: (time, pages, features) and which blocks exist."""
    longest = max(map(len, rows))
    x = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(rows)), bool)
    for i, r in enumerate(rows):
        x[: len(r), i] = r
        mask[: len(r), i] = True
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> Labeller:
    """A labeller of (features, labels) by Adam over batches of pages of like length."""
    rng = np.random.default_rng(seed)
    model = Labeller.fresh(rng)
    mean = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            x, mask = _stacked([pages[i][0] for i in batches[b]])
            labels = np.zeros(mask.shape, np.float32)
            for n, i in enumerate(batches[b]):
                labels[: len(pages[i][1]), n] = pages[i][1]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, g in model.gradients(x, mask, labels).items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                fixed = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                model.weights[k] -= (rate * fixed).astype(np.float32)
    return model


# What surrounds articles, for laid-out pages.

_MAIN_NAMES = (
    "article content post entry story main body text post-content entry-content article-body story-body "
    "post-body main-content page-content articleBody markdown prose blog-post news-text"
).split()
_OTHER_NAMES = {
    "nav": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header": "header masthead top-bar site-header banner branding page-header topbar".split(),
    "footer": "footer site-footer bottom colophon copyright legal page-footer".split(),
    "aside": "sidebar aside side widget rail secondary related recommended popular trending most-read read-more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbygoogle promotion".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay privacy-banner cookie-bar paywall".split(),
    "form": "form login signup subscribe newsletter search search-form contact signin".split(),
    "comments": "comments comment responses discussion replies disqus comment-list comment-body reader-comments".split(),
    "share": "share social sharing follow-us byline meta tags author-box post-meta tag-list".split(),
}
_PHRASES = {
    "nav": "Home|About|Contact|News|Products|Login|Sign in|Next|Previous|Archive|Sitemap|Search|Blog|FAQ|Help|Kontakt|Startseite|Accueil|Inicio".split("|"),
    "header": "Welcome|The Daily|My Site|Skip to content|Menu|Search|Subscribe|Log in".split("|"),
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Powered by|Copyright|Impressum|Mentions légales|Aviso legal|· Contact us".split("|"),
    "aside": "Related articles|Most read|You may also like|Popular posts|Recent posts|More from this author|Trending now|Tags".split("|"),
    "ad": "Advertisement|Sponsored|Buy now and save 50%|Click here|Limited offer|Anzeige|Publicité|Publicidad|Shop now".split("|"),
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies|By continuing you agree to our policy.|Manage preferences|Got it|Please enable JavaScript".split("|"),
    "form": "Your email|Subscribe to our newsletter|Sign up|Password|Enter your name|Send|Leave a reply|Your comment|Search".split("|"),
    "comments": "Comments|3 comments|Reply|Great article!|Thanks for sharing this.|I disagree with this.|says:|Log in to reply|Posted by|2 hours ago|Like".split("|"),
    "share": "Share on Facebook|Tweet|Email|Print|By|Published on|5 min read|Updated|Follow us|Tags:|Read more".split("|"),
}


class _Layout:
    """One page laid out from given texts."""

    def __init__(self, rng: np.random.Generator, texts: list[str]):
        self.rng, self.texts = rng, texts

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def some(self, low: int, high: int) -> str:
        """A few words of a text of the sample, of any place."""
        words = self.pick(self.texts).split()
        n = int(self.rng.integers(low, high + 1))
        at = int(self.rng.integers(max(1, len(words) - n + 1)))
        return references.escape(" ".join(words[at : at + n]), quote=False)

    def attrs(self, kind: str | None, p: float = 0.8) -> str:
        if kind is None or not self.chance(p):
            return f' class="{self.pick(["row", "col", "container", "wrap", "inner", "box", "block", "x1"])}"' if self.chance(0.3) else ""
        names = _MAIN_NAMES if kind == "main" else _OTHER_NAMES[kind]
        value = self.pick(names)
        if self.chance(0.3):
            value += " " + self.pick(["row", "col-8", "container", "wrap", "clearfix", "active", "block", "m-4"])
        return f' {self.pick(["class", "class", "id"])}="{value}"'

    def box(self, tag: str, kind: str | None, inner: str, p: float = 0.8) -> str:
        return f"<{tag}{self.attrs(kind, p)}>{inner}</{tag}>"

    def other(self, kind: str) -> str:
        """A region that is no main text."""
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        tag = own[kind] if kind in own and self.chance(0.6) else self.pick(["div", "div", "section", "aside"])
        named = 0.4 if tag == own.get(kind) else 1.0
        phrase = lambda: self.pick(_PHRASES[kind])
        mark = lambda s: OTHER + s
        n = int(self.rng.integers(1, 8))
        short = lambda: phrase() if self.chance(0.5) else self.some(1, 4)
        if kind in ("nav", "aside", "share") and self.chance(0.8):
            items = "".join(f'<li><a href="/{i}">{mark(short())}</a></li>' for i in range(n))
            inner = (f"<h3>{mark(phrase())}</h3>" if self.chance(0.3) else "") + f"<ul>{items}</ul>"
        elif kind == "comments":
            inner = f"<h3>{mark(phrase())}</h3>" if self.chance(0.7) else ""
            for _ in range(n):
                who = f"<{self.pick(['b', 'span', 'div', 'cite'])}>{mark(self.some(1, 2))}</div>"
                said = "".join(f"<p>{mark(self.some(4, 60))}</p>" for _ in range(1 + self.chance(0.3)))
                inner += self.box(self.pick(["li", "div", "article"]), "comments" if self.chance(0.6) else None, who + said)
        elif kind == "form":
            inner = f"<p>{mark(phrase())}</p><label>{mark(phrase())}</label><input name=q><button>{phrase()}</button>"
        elif kind == "aside" and self.chance(0.5):
            inner = "".join(f"<h4>{mark(self.some(3, 8))}</h4><p>{mark(self.some(5, 25))}</p>" for _ in range(n))
        else:
            inner = "".join(
                f"<{t}>{mark(phrase() + ' ' + self.some(0, 20) if self.chance(0.5) else self.some(3, 25))}</{t}>"
                if (t := self.pick(["p", "div", "span", ""])) else mark(self.some(2, 15))
                for _ in range(1 + n // 4)
            )
        return self.box(tag, kind, inner, named)

    def article(self) -> str:
        mark = lambda s: MAIN + s
        parts = [f"<h1>{mark(self.some(3, 12))}</h1>"] if self.chance(0.85) else []
        if self.chance(0.3):
            parts.append(self.other("share"))
        for _ in range(int(self.rng.integers(1, 12))):
            kind, text = self.rng.random(), mark(self.some(8, 120))
            if kind < 0.68:
                parts.append(f"<p>{text}</p>" if self.chance(0.8) else f"<p>{text}")
            elif kind < 0.74:
                parts.append(f"<p><b>{mark(self.some(3, 15))}<br><p>{text}</p>")
            elif kind < 0.8:
                parts.append(f"<h{self.pick('23')}>{mark(self.some(2, 8))}</h2><p>{text}</p>")
            elif kind < 0.85:
                parts.append("<ul>" + "".join(f"<li>{mark(self.some(2, 20))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.89:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.92:
                cells = "".join(f"<td>{mark(self.some(1, 3))}</td>" for _ in range(3))
                parts.append(f"<table><tr>{cells}</tr><tr>{cells}</tr></table>")
            elif kind < 0.94:
                parts.append(f"<figure><img src=x><figcaption>{mark(self.some(3, 15))}</figcaption></figure>")
            elif kind < 0.97:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append(f'<p>{mark(self.some(5, 30))} <a href="/x">{self.some(1, 4)}</a> {self.some(3, 30)}</p>')
            if self.chance(0.08):
                parts.append(self.other(self.pick(["ad", "ad", "share", "form", "aside", "notice"])))
        inner = "".join(parts)
        style = self.rng.random()
        if style < 0.4:
            inner = f"<article{self.attrs('main', 0.3)}>{inner}</article>"
        elif style < 0.55:
            inner = f"<main{self.attrs('main', 0.3)}>{inner}</main>"
        elif style < 0.95:
            inner = self.box(self.pick(["div", "div", "section", "td"]), "main", inner, 0.85)
        return self.box("div", None, inner) if self.chance(0.3) else inner

    def page(self) -> str:
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.3), ("form", 0.15), ("aside", 0.2)) if self.chance(p)]
        after = [k for k, p in (("share", 0.25), ("comments", 0.4), ("aside", 0.4), ("form", 0.2), ("ad", 0.2), ("nav", 0.1), ("footer", 0.75), ("notice", 0.1)) if self.chance(p)]
        middle = self.article()
        inside = [k for k in after if k in ("share", "comments") and self.chance(0.3)]
        if inside:  # before the container ends
            cut = middle.rfind("</")
            middle = middle[:cut] + "".join(map(self.other, inside)) + middle[cut:] if cut > 0 else middle
        after = [k for k in after if k not in inside]
        body = "".join(map(self.other, before)) + middle + "".join(map(self.other, after))
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"


def _labelled(page: list[Block]) -> tuple[list[Block], np.ndarray]:
    """Blocks of a laid-out page without marks, and their labels."""
    labels = np.array([b.text.startswith(MAIN) for b in page], np.float32)
    for b in page:
        b.text = b.text.replace(MAIN, "").replace(OTHER, "").strip() or "x"
    return page, labels


_SIGNS = {"nav", "footer", "header", "aside", "form", ".ad", ".ads", ".comments", ".sidebar", ".menu"}


def _silver(page: list[Block]) -> np.ndarray | None:
    """Labels from semantic elements, where a page has an article or main element."""
    if not any({"article", "main"} & set(b.path) for b in page):
        return None
    return np.array([bool({"article", "main"} & set(b.path)) and not _SIGNS & set(b.path) for b in page], np.float32)


def learn(pages: DataFrame, html: str = "html", seed: int = 5) -> Labeller:
    """A labeller of the ``SAMPLE`` pages with the least hashes of their html.

    Only their hashes are ranked; the texts of the sample come to the driver.
    Without any page the layouts are filled with the phrases of their frames.
    """
    rows = pages.select(F.col(html).cast("string").alias("html")).where("html is not null")
    rows = rows.withColumn("h", F.xxhash64("html"))
    least = rows.select("h").distinct().orderBy("h").limit(SAMPLE)
    sample = rows.join(F.broadcast(least), "h").dropDuplicates(["h"]).orderBy("h")
    return train([r.html for r in sample.collect()], seed)


def train(sample: list[str], seed: int = 5) -> Labeller:
    """A labeller from the html of sample pages, by their own markup and by layouts of their texts."""
    rng = np.random.default_rng(seed)
    parsed = [blocks(p)[:LONGEST] for p in sample]
    silver = [(features(p), y) for p in parsed if p and (y := _silver(p)) is not None]
    texts = [b.text for p in parsed for b in p if len(b.text) > 40]
    texts = texts or [p for phrases in _PHRASES.values() for p in phrases]
    laid = []
    for _ in range(LAYOUTS):
        page = blocks(_Layout(rng, texts).page())[:LONGEST]
        if page:
            page, labels = _labelled(page)
            laid.append((features(page), labels))
    return fit(silver + laid, seed)


def extract(pages: DataFrame, model: Labeller, page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    text is empty where html is null or holds no main text; n_chars are its code
    points. Rows are independent: repeated rows and null ids give their rows.
    Other columns are not read. No rows give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in textkit.groups(batch, "html"):
                texts = known.extract(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
