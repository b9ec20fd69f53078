"""Main text of pages: blocks classified by a decision tree.

The tree is trained on the blocks of the labelled pages that ``PageMaker`` draws, with a
small depth and a least number of blocks per leaf; pages of another seed measure it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gapspark.llm.html_blocks import NAMES, blocks_of, features

#: Words of the texts in the labelled pages, and the lengths of their blocks.
FILLER = "about after again before between common different early every figure given house later letter little".split()
SHORT, LONGER = (1, 2, 3, 5, 8), (10, 14, 20, 30, 45, 60, 90)
MOST_DEPTH, LEAST_LEAF = 6, 6


class PageMaker:
    """Labelled pages of the usual makes, drawn by a seeded generator: with or without
    menus, headers, footers, notices, headlines and comments, of one or many paragraphs,
    the article in an element of its own, in a named one or in none. Blocks whose text
    starts with "+" are main text."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def words(self, sizes) -> str:
        return " ".join(self.draw.choice(FILLER) for _ in range(self.draw.choice(sizes)))

    def link(self, sizes=SHORT) -> str:
        return f"<a href='/x'>{self.words(sizes)}</a>"

    def links(self, low: int, high: int) -> str:
        return "".join(f"<li>{self.link()}</li>" for _ in range(self.draw.randint(low, high)))

    def menu(self) -> str:
        name = self.draw.choice(["<nav><ul>{}</ul></nav>", "<div class='menu'><ul>{}</ul></div>", "<div id='nav'>{}</div>", "<ul>{}</ul>"])
        return name.format(self.links(2, 7))

    def furniture(self, sizes) -> str:
        name = self.draw.choice(["cookie-notice", "ad", "sidebar", "newsletter", "related", "share", "promo", "footer"])
        body = self.draw.choice([self.words(sizes), self.link(sizes), f"<p>{self.words(sizes)}</p><p>{self.link()}</p>"])
        return self.draw.choice([f"<div class='{name}'>{body}</div>", f"<aside>{body}</aside>", f"<div id='{name}'>{body}</div>"])

    def comments(self) -> str:
        said = "".join(f"<p>{self.words(SHORT + LONGER)}</p>" for _ in range(self.draw.randint(1, 5)))
        return self.draw.choice(["<div class='comments'>{}</div>", "<section id='comments'>{}</section>"]).format(said)

    def block(self) -> str:
        kind = self.draw.random()
        if kind < 0.55:
            return f"<p>+ {self.words(LONGER)}</p>"
        if kind < 0.75:
            return f"<p>+ {self.words(SHORT)}</p>"
        if kind < 0.83:
            return f"<p>+ {self.words(LONGER)} {self.link()} {self.words(SHORT)}</p>"
        if kind < 0.88:
            return f"<p>+ {self.link(SHORT + LONGER)}</p>"
        if kind < 0.94:
            return "<ul>" + "".join(f"<li>+ {self.words(SHORT + LONGER)}</li>" for _ in range(self.draw.randint(1, 4))) + "</ul>"
        return f"<{self.draw.choice(['h2', 'h3', 'blockquote'])}>+ {self.words(SHORT)}</{self.draw.choice(['h2', 'h3'])}>"

    def article(self, bare: bool) -> str:
        parts = [f"<h1>+ {self.words(SHORT)}</h1>"] if self.draw.random() < 0.6 else []
        if bare:
            # without an element that names it, the article is what is long
            parts += [f"<p>+ {self.words(LONGER[1:])}</p>" for _ in range(self.draw.randint(1, 6))]
            return "".join(parts)
        for _ in range(self.draw.choice([1, 1, 2, 3, 5, 8])):
            parts.append(self.block())
            if self.draw.random() < 0.12:
                parts.append(self.furniture(SHORT + LONGER))
        if self.draw.random() < 0.15:
            parts.append(self.comments())
        return "".join(parts)

    def plain(self) -> str:
        """A page that is its text and nothing else, however short."""
        frame = self.draw.choice(["<p>{}</p>", "{}<br>", "<div>{}</div>"])
        return "".join(frame.format(f"+ {self.words(SHORT + LONGER)}") for _ in range(self.draw.randint(1, 4)))

    def page(self) -> str:
        """A page of any make."""
        if self.draw.random() < 0.12:
            return self.plain()
        kind = self.draw.choice(["<article>{}</article>"] * 3 + ["<main>{}</main>", "<div id='content'>{}</div>", "<div class='post'>{}</div>", "{}", "<div>{}</div>"])
        bare = kind in ("{}", "<div>{}</div>")
        parts = [self.menu()] if self.draw.random() < 0.5 else []
        if self.draw.random() < 0.25:
            parts.insert(0, f"<header><div>{self.words(SHORT)}</div><p>{self.words(SHORT + LONGER)}</p></header>")
        if not bare and self.draw.random() < 0.3:
            parts.append(self.furniture(SHORT + LONGER))
        parts.append(kind.format(self.article(bare)))
        if not bare and self.draw.random() < 0.3:
            # outside of the article, whatever its length
            parts.append(self.draw.choice(["<div>{}</div>", "<p>{}</p>"]).format(self.words(SHORT + LONGER)))
        if self.draw.random() < 0.3:
            parts.append(self.draw.choice([self.comments(), self.furniture(SHORT + LONGER)]))
        if self.draw.random() < 0.5:
            body = self.draw.choice([self.words(SHORT + LONGER), self.link(), f"{self.words(SHORT)} {self.link()}"])
            parts.append(self.draw.choice(["<footer>{}</footer>", "<div id='footer'>{}</div>", "<div class='site-footer'><p>{}</p></div>"]).format(body))
        return f"<body>{''.join(parts)}</body>"


def labelled_pages(seed: int = 1, count: int = 120) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(count)]


def labelled_table(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in pages:
        found = blocks_of(page)
        labels += [b.text.startswith("+") for b in found]
        for b in found:
            if b.text.startswith("+"):
                b.words -= 1
        rows += features(found)
    return np.array(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int = LEAST_LEAF):
    """A tree as nested tuples: a share of positive rows, or (feature, cut, at most, above).
    No leaf holds fewer than ``least`` rows."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = impurity(y) - impurity(y[left]) - impurity(y[~left])
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, float(cut), left)
    if best is None or best[0] <= 1e-9:
        return share
    _, f, cut, left = best
    return f, cut, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


@lru_cache(maxsize=1)
def tree():
    x, y = labelled_table(labelled_pages())
    return grow(x, y, MOST_DEPTH)


def judge(node, row: list[float]) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(html: str, node=None) -> str:
    """The blocks the tree takes for main text, in page order, two line ends between."""
    found = blocks_of(html)
    node = tree() if node is None else node
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if judge(node, row) >= 0.5)


def describe(node=None, pad: str = "") -> str:
    node = tree() if node is None else node
    if not isinstance(node, tuple):
        return f"{pad}{node:.2f}\n"
    f, cut, low, high = node
    return f"{pad}{NAMES[f]} <= {cut:g}\n{describe(low, pad + '  ')}{pad}else\n{describe(high, pad + '  ')}"


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row: the ``keep`` columns, text, n_chars (code points).

    Null and empty pages, and pages without main text, give the empty text. Whole pages
    are read, row by row, without a shuffle; repeated rows stay; an empty table gives no
    row; columns outside ``keep`` are not read.
    """
    kept = df.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("__html"))
    schema = StructType([*kept.schema.fields[:-1], StructField("text", StringType())])
    node = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [re.sub("[\ud800-\udfff]", "�", main_text(h, node)) for h in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
