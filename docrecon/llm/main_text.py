"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks, and each block is main text or not. Its features are its ancestors' tags, the
words of their class, id and role, and measures of its text; weights on neighbouring labels make runs of main text. The
field is trained by gradient ascent on the conditional likelihood of labelled pages, and pages are decoded by Viterbi.

Labelled pages come from layouts (labelled_pages): a fixed number of pages with known main text, of many arrangements
of menus, headers, notices, adverts, side columns, forms, comments and footers around an article. They were written with
pages like those of the given tables in view (marks after words, upper case, one-line comments), so pages of other styles
are the better test. Own labelled pages can be given instead. The model is a few hundred numbers; pages never meet, so there is no shuffle.
"""

import re
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.llm.html_blocks import KNOWN_NAMES, TAGS, Block, leaf_blocks
from docrecon.llm.storage import map_batches

GOOD_END = re.compile(r"[.!?…:;\"'”’)\]]$")


def features(block: Block) -> list[str]:
    text, words = block.text, block.text.split()
    n = len(words)
    made = [f"tag:{t}" for t in block.tags] + [f"name:{w}" for w in block.names]
    made.append(f"leaf:{block.leaf}")
    made.append(f"words:{min(7, int(np.log2(n + 1)))}")
    made.append(f"linked:{min(4, int(block.linked * 4))}")
    made += ["end"] * bool(GOOD_END.search(text)) + ["mark:©"] * ("©" in text or "(c)" in text.lower()) + ["mark:|"] * (text.count("|") + text.count("»") + text.count("·") > 1)
    if not block.tags & {"article", "main"} and not block.names:
        made.append("bare")
    return made


@lru_cache(1)
def feature_numbers() -> dict[str, int]:
    names = [f"tag:{t}" for t in TAGS] + [f"name:{w}" for w in KNOWN_NAMES] + [f"leaf:{t}" for t in [*TAGS, "none"]]
    names += [f"words:{i}" for i in range(8)] + [f"linked:{i}" for i in range(5)] + ["end", "mark:©", "mark:|", "bare"]
    return {n: i for i, n in enumerate(names)}


@dataclass(frozen=True)
class MainTextModel:
    """weights: of a block's features for its being main text. chain[a, b]: of label b after a. start: of main text first."""

    weights: np.ndarray
    chain: np.ndarray
    start: float

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The labels of the highest total, by Viterbi; ties go to what is not main text."""
        numbers, w = feature_numbers(), self.weights
        best, back = (0.0, 0.0), []
        for i, block in enumerate(blocks):
            own = sum(w[numbers[f]] for f in features(block))
            if i == 0:
                best = (0.0, self.start + own)
                continue
            (a, b), c = best, self.chain
            off, on = (a + c[0, 0], b + c[1, 0]), (a + c[0, 1], b + c[1, 1])
            back.append((bool(off[1] > off[0]), bool(on[1] > on[0])))
            best = (max(off), max(on) + own)
        label = bool(best[1] > best[0])
        labels = [label]
        for came in reversed(back):
            label = came[label]
            labels.append(label)
        return labels[::-1] if blocks else []


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, rate: float = 0.1, ridge: float = 0.002) -> MainTextModel:
    """Adam on the penalized conditional log-likelihood; all pages in step, shorter ones masked. No pages: no main text."""
    numbers = feature_numbers()
    pages = [(b, y) for b, y in pages if b]
    if not pages:
        return MainTextModel(np.zeros(len(numbers)), np.zeros((2, 2)), -1.0)
    n, t = len(pages), max(len(b) for b, _ in pages)
    flat_page, flat_time, flat_feature = [], [], []
    gold, there = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (blocks, labels) in enumerate(pages):
        there[i, : len(blocks)] = True
        gold[i, : len(blocks)] = labels
        for j, block in enumerate(blocks):
            for f in features(block):
                flat_page.append(i)
                flat_time.append(j)
                flat_feature.append(numbers[f])
    cell = np.array(flat_page) * t + np.array(flat_time)
    kind = np.array(flat_feature)
    theta = np.zeros(len(numbers) + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    moves = np.zeros((2, 2))
    for i in range(n):
        y = gold[i, there[i]]
        np.add.at(moves, (y[:-1], y[1:]), 1)
    target = np.concatenate([np.bincount(kind, gold.reshape(-1)[cell], len(numbers)), moves.ravel(), [gold[:, 0].sum()]])
    for step in range(1, rounds + 1):
        own = np.bincount(cell, theta[kind], n * t).reshape(n, t)
        chain, start = theta[-5:-1].reshape(2, 2), theta[-1]
        emit = np.stack([np.zeros((n, t)), own], axis=2)
        emit[:, 0, 1] += start
        ahead = np.zeros((n, t, 2))
        ahead[:, 0] = emit[:, 0]
        for j in range(1, t):
            new = np.logaddexp.reduce(ahead[:, j - 1, :, None] + chain, axis=1) + emit[:, j]
            ahead[:, j] = np.where(there[:, j, None], new, ahead[:, j - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        after = np.zeros((n, t, 2))
        for j in range(t - 2, -1, -1):
            new = np.logaddexp.reduce(chain + (emit[:, j + 1] + after[:, j + 1])[:, None, :], axis=2)
            after[:, j] = np.where(there[:, j + 1, None], new, 0)
        chance = np.exp(ahead + after - total[:, None, None])[..., 1] * there
        pair = np.exp(ahead[:, :-1, :, None] + chain + (emit[:, 1:] + after[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        expected = np.concatenate([np.bincount(kind, chance.reshape(-1)[cell], len(numbers)), pair.sum(axis=(0, 1)).ravel(), [chance[:, 0].sum()]])
        slope = (target - expected) / n - ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return MainTextModel(theta[: len(numbers)], theta[-5:-1].reshape(2, 2).copy(), float(theta[-1]))


class _Layout:
    """Pages of random words in one of many arrangements; blocks of main text carry a mark that is read off again."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, *of):
        return of[int(self.r.integers(len(of)))]

    def may(self, p: float, make) -> str:
        return make() if self.r.random() < p else ""

    def words(self, low: int, high: int) -> str:
        parts = "an be ch de er fe ga he in jo ka le mo nu or pa qui re sch ti un vo wa zé ü".split()
        return " ".join("".join(self.one(*parts) for _ in range(int(self.r.integers(1, 4)))) for _ in range(int(self.r.integers(low, high))))

    def sentence(self, low: int = 4, high: int = 30) -> str:
        style = self.r.random()
        text = self.words(low, high)
        if style < 0.06:
            return text.upper() + "!!"
        if style < 0.12:
            return text.replace(" ", self.one("### ", "*** ", "&amp;&amp; ", " | "))
        return text.capitalize() + ("." if style < 0.93 else "")

    def div(self, names: tuple[str, ...], inner: str, tag: str = "div") -> str:
        return f'<{tag} {self.one("class", "class", "id")}="{self.one(*names)}">{inner}</{tag}>'

    def links(self, low: int, high: int) -> str:
        kind = self.r.random()
        items = [f'<a href="/x">{self.words(1, 4)}</a>' for _ in range(int(self.r.integers(low, high)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind < 0.7 else self.one(" | ", " ", " · ").join(items)

    def menu(self) -> str:
        inner = self.links(2, 9)
        return self.one(f"<nav>{inner}</nav>", self.div(("menu", "navbar", "main-nav", "navigation", "breadcrumbs"), inner), inner)

    def header(self) -> str:
        inner = self.one(f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 9)}</p>", f'<a href="/">{self.words(1, 3)}</a>')
        return self.one(f"<header>{inner}{self.may(0.5, self.menu)}</header>", self.div(("header", "site-header", "masthead", "top-bar"), inner))

    def advert(self) -> str:
        text = self.sentence(2, 25)
        return self.div(("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"), self.one(text, f"<p>{text}</p>", f'<a href="/y">{text}</a>'), self.one("div", "div", "aside", "section"))

    def notice(self) -> str:
        text = self.sentence(6, 30)
        return self.div(("cookie-notice", "notice", "consent", "alert", "cookies", "gdpr-banner", "popup"), self.one(text, f"<p>{text}</p><button>{self.words(1, 3)}</button>"))

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.one(self.links(2, 8), "".join(f"<p>{self.sentence()}</p>" for _ in range(int(self.r.integers(1, 4)))))
        return self.one(f"<aside>{inner}</aside>", self.div(("sidebar", "side", "widget", "right-rail", "related", "popular", "recommended"), inner))

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input type=text><button>{self.words(1, 3)}</button>" + self.may(0.4, lambda: f"<p>{self.sentence()}</p>")
        return self.one(f"<form>{inner}</form>", self.div(("newsletter", "subscribe", "search", "login"), f"<form>{inner}</form>"))

    def comments(self) -> str:
        rows = [f"{self.may(0.6, lambda: f'<b>{self.words(1, 3)}</b>')}<p>{self.sentence()} {self.sentence()}</p>" for _ in range(int(self.r.integers(1, 6)))]
        inner = self.one("".join(self.div(("comment", "reply", "comment-body"), x) for x in rows), "<ol>" + "".join(f"<li>{x}</li>" for x in rows) + "</ol>")
        return self.div(("comments", "comment-list", "discussion", "user-comments"), self.may(0.6, lambda: f"<h2>{self.words(1, 3)}</h2>") + inner, self.one("div", "section", "section", "aside"))

    def footer(self) -> str:
        text = self.one("&copy; ", "", "(c) 2020 ") + self.sentence(3, 14)
        return self.one(f"<footer>{text}</footer>", f"<footer><p>{text}</p>{self.links(1, 6)}</footer>", self.div(("footer", "site-footer", "bottom", "copyright"), text))

    def main(self, tag: str, low: int = 4, high: int = 60) -> str:
        return f"<{tag}>{self.MARK}{self.sentence(low, high)}{self.may(0.5, self.sentence)}" + self.one(f"</{tag}>", f"</{tag}>", f"</{tag}>", "" if tag in ("p", "li") else f"</{tag}>")

    def article(self) -> str:
        rows = [self.main("h1", 1, 10)] if self.r.random() < 0.8 else []
        for _ in range(int(self.r.integers(1, 14))):
            kind = self.r.random()
            if kind < 0.72:
                rows.append(self.main("p", 2))
            elif kind < 0.8:
                rows.append(self.main(self.one("h2", "h3"), 1, 8))
            elif kind < 0.86:
                rows.append("<ul>" + "".join(self.main("li", 1, 16) for _ in range(int(self.r.integers(2, 5)))) + "</ul>")
            elif kind < 0.9:
                rows.append(f"<blockquote>{self.MARK}{self.sentence()}</blockquote>")
            elif kind < 0.92:
                rows.append("<table><tr>" + "".join(f"<td>{self.MARK}{self.words(1, 6)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.94:
                rows.append(f"<div>{self.MARK}{self.sentence()}</div>")
            else:
                rows.append(self.one(self.advert, self.side, self.form, lambda: self.div(("share", "social", "tags", "related"), self.links(2, 6)))())
        inner = "".join(rows)
        named = ("content", "article-body", "post", "entry-content", "main-content", "story", "post-content", "text")
        return self.one(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", self.div(named, inner), self.div(named, inner), f"<main><article>{inner}{self.may(0.3, self.comments)}</article></main>", f"<div>{inner}</div>", f"<section>{inner}</section>")

    def page(self) -> str:
        before = self.may(0.6, self.header) + self.may(0.8, self.menu) + self.may(0.4, self.notice) + self.may(0.5, self.advert)
        after = self.may(0.4, self.comments) + self.may(0.4, self.side) + self.may(0.3, self.advert) + self.may(0.3, self.form) + self.may(0.85, self.footer) + self.may(0.15, self.notice)
        middle = self.may(0.25, self.side) + self.article()
        wrap = self.div(("wrapper", "container", "page"), middle) if self.r.random() < 0.3 else middle
        return f"<html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{before}{wrap}{after}</body></html>"


def labelled_pages(n: int = 800, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """n pages of the layouts above, as blocks and whether each is main text."""
    layout, mark = _Layout(seed), _Layout.MARK
    made = [leaf_blocks(layout.page()) for _ in range(n)]
    return [([replace(b, text=b.text.replace(mark, "").strip()) for b in blocks], [mark in b.text for b in blocks]) for blocks in made]


@lru_cache(1)
def default_model() -> MainTextModel:
    return train(labelled_pages())


def page_text(html: str | None, model: MainTextModel) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, main in zip(blocks, model.decode(blocks), strict=True) if main)


def main_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", model: MainTextModel | None = None) -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points). Null and empty pages, and pages without main text,
    have an empty text. A page of any length and depth is read whole, in time in proportion to it. Repeated rows give repeated results, an empty table none; other columns are not read."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [page_text(x, sent.value) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_column, url, "text", "n_chars"])

    chosen = pages.select(F.col(id_column).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    kind = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return map_batches(chosen, run, f"`{id_column}` {kind['_id']}, `{url}` {kind['_url']}, text string, n_chars long")
