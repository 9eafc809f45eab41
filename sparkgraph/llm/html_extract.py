"""Main-text extraction: boosted trees over DOM nodes and hierarchical decoding.

Every element that may hold blocks gets the log-odds of being part of the
article (or a wrapper around it) from gradient-boosted trees over its tag, its
attribute words, its subtree's text and link density, depth, place and
siblings. The most likely labelling of the whole tree in which nothing is kept
inside a dropped element is found bottom up; the blocks of kept elements are
the text.

The trees are fitted to pages that a fixed generator writes in many layouts, with
the article known. Fitted ones for the default parameters are kept beside this
module; ``python -m sparkgraph.llm.html_extract`` makes that file anew.
"""

from __future__ import annotations

import functools
import json
import random
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgraph.llm import boosting
from sparkgraph.llm.dom import Block, Node, read
from sparkgraph.llm.shared import flat_schema, small_batches
from sparkgraph.llm.textvec import rows_by_bytes

# Words in attributes, by what they tell.
WORDS = {
    "article": "article content main body post entry story text prose blog page news detail reading".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc toolbar links skip".split(),
    "header": "header head masthead top topbar banner logo brand hero".split(),
    "footer": "footer foot bottom copyright legal colophon credits".split(),
    "side": "side sidebar aside rail widget widgets related recommended popular trending teaser more".split(),
    "notice": "cookie cookies notice consent gdpr alert warning popup modal overlay privacy toast message paywall".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner commercial outbrain taboola".split(),
    "form": "form search login signup subscribe subscription newsletter register contact input".split(),
    "comment": "comment comments commentlist reply replies discussion disqus respond reaction reactions feedback reviews".split(),
    "share": "share sharing social tags meta byline author follow tools buttons rating".split(),
}
TAGS = {
    "article": 1, "main": 2, "section": 3, "div": 4, "p": 5, "h1": 6, "h2": 7, "h3": 8, "h4": 8, "h5": 8, "h6": 8, "ul": 9, "ol": 9,
    "li": 10, "nav": 11, "header": 12, "footer": 13, "aside": 14, "form": 15, "table": 16, "tr": 16, "td": 16, "th": 16, "tbody": 16,
    "blockquote": 17, "pre": 18, "figure": 19, "figcaption": 20, "button": 21, "dl": 22, "dt": 22, "dd": 22, "body": 23, "fieldset": 15,
    "menu": 11, "dialog": 24, "address": 25, "details": 26, "summary": 26,
}
_KINDS = {word: i for i, words in reversed(list(enumerate(WORDS.values()))) for word in words}
_OUTSIDE = frozenset((11, 12, 13, 14, 15, 24))
N_TAGS = max(TAGS.values()) + 1


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row of features for each node of a page, in the order of ``nodes`` (parents first)."""
    n = len(nodes)
    place = {id(node): i for i, node in enumerate(nodes)}
    kinds = np.zeros((n, len(WORDS)))
    tag = np.zeros(n, np.int64)
    parent = np.zeros(n, np.int64)
    own = np.zeros((n, 6))  # characters, linked characters, blocks, tags, sentence ends, words
    around = np.zeros((n, 5))  # depth, index, siblings, siblings of the same tag, children
    for i, node in enumerate(nodes):
        tag[i] = TAGS.get(node.tag, 0)
        for name in node.names:
            k = _KINDS.get(name)
            if k is not None:
                kinds[i, k] = 1
        chars = linked = ends = words = 0
        for block in node.blocks:
            text = block.text
            chars += len(text)
            linked += block.linked
            ends += text.count(". ") + text.endswith((".", "?", "!"))
            words += text.count(" ") + 1
        own[i] = chars, linked, len(node.blocks), node.n_tags, ends, words
        up = node.parent
        if up is not None:
            parent[i] = place[id(up)]
        around[i, 0], around[i, 4] = node.depth, len(node.children)
        children = node.children
        if children:
            same: dict[str, int] = {}
            for c in children:
                same[c.tag] = same.get(c.tag, 0) + 1
            for j, c in enumerate(children):
                around[place[id(c)], 1:4] = j, len(children), same[c.tag]
    tree = own.copy()
    paragraphs = (tag == 5).astype(float)
    size = np.ones(n)
    for i in range(n - 1, 0, -1):
        up = parent[i]
        tree[up] += tree[i]
        paragraphs[up] += paragraphs[i]
        size[up] += size[i]
    above = np.zeros((n, len(WORDS)))
    outside, within = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        up = parent[i]
        above[i] = np.maximum(above[up], kinds[up])
        outside[i] = outside[up] or tag[up] in _OUTSIDE
        within[i] = within[up] or tag[up] in (1, 2)
    before = np.concatenate(([0], np.cumsum(own[:, 0])[:-1]))
    total = max(tree[0, 0], 1.0)
    sums, count = np.zeros(n), np.zeros(n)
    np.add.at(sums, parent[1:], tree[1:, 0])
    np.add.at(count, parent[1:], 1)
    siblings = np.where(count[parent] > 0, sums[parent] / np.maximum(count[parent], 1), 0)
    has_article = float(((tag == 1) | (tag == 2)).any())
    return np.column_stack(
        [
            tag[:, None] == np.arange(N_TAGS),
            tag[parent],
            kinds,
            above,
            outside,
            within,
            np.broadcast_to(has_article, n),
            np.log1p(tree[:, 0]),
            tree[:, 1] / np.maximum(tree[:, 0], 1),
            tree[:, 0] / tree[:, 3],
            tree[:, 0] / np.maximum(tree[:, 2], 1),
            tree[:, 4] / np.maximum(tree[:, 5], 1),
            np.log1p(own[:, 0]),
            own[:, 1] / np.maximum(own[:, 0], 1),
            tree[:, 0] / total,
            tree[:, 0] / np.maximum(siblings, 1),
            np.log1p(paragraphs),
            np.log1p(size),
            around,
            around[:, 1] / np.maximum(around[:, 2], 1),
            around[:, 3] / np.maximum(around[:, 2], 1),
            before / total,
            tree[parent][:, 1] / np.maximum(tree[parent][:, 0], 1),
            np.log1p(tree[parent][:, 0]),
        ]
    ).astype(np.float32)


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The most likely labels of all nodes under which every kept node's parent is kept; the root is."""
    place = {id(node): i for i, node in enumerate(nodes)}
    keep = -np.logaddexp(0, -margin)
    drop = -np.logaddexp(0, margin)
    keep, drop = keep.tolist(), drop.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[place[id(nodes[i].parent)]] and keep[i] > drop[i]
    return out


class _Writer:
    """Writes pages in random layouts; ``data-y`` marks the article (m) and what is not part of it (b)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice("abcdefghiklmnoprstuvwzéüñ") for _ in range(self.r.randint(1, 9))) for _ in range(800)]

    def text(self, low: int, high: int) -> str:
        r, n, out = self.r, self.r.randint(low, high), []
        while n > 0:
            size = min(n, r.randint(2, 14))
            out.append(" ".join(r.choice(self.words) for _ in range(size)).capitalize() + r.choice([".", ".", ".", "?", ""]))
            n -= size
        return " ".join(out)

    def name(self, kind: str, chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        word = r.choice(WORDS[kind])
        value = r.choice([word, f"{word}-{r.choice(self.words)}", f"site-{word}", f"{word} {r.choice(self.words)}", f"{word}-wrapper"])
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def links(self, low: int, high: int) -> str:
        items = "".join(f'<li><a href="/{i}">{self.text(1, 3)}</a></li>' for i in range(self.r.randint(low, high)))
        return f"<ul>{items}</ul>" if self.r.random() < 0.8 else items.replace("<li>", " ").replace("</li>", " | ")

    def outside(self, kind: str) -> str:
        """An element of the given kind that is no part of the article."""
        r = self.r
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "advert": "aside", "notice": "section"}.get(kind, "section")
        semantic = kind in ("menu", "header", "footer", "side", "form") and r.random() < 0.55
        tag = tag if semantic else r.choice(["div", "div", "div", "section", "aside" if kind in ("advert", "side", "notice") else "div"])
        name = self.name(kind, 0.5 if semantic else 1.0)
        if kind == "menu":
            inner = self.links(2, 9)
        elif kind == "header":
            inner = r.choice([f"<h1>{self.text(1, 4)}</h1>", f"<div>{self.text(1, 4)}</div>", f"<p>{self.text(2, 10)}</p>", self.text(1, 8)]) + r.choice(["", self.links(2, 6)])
        elif kind == "footer":
            inner = r.choice(["", self.links(1, 5)]) + r.choice([f"&copy; {self.text(2, 20)}", f"<p>&copy; 2024 {self.text(2, 20)}</p>", f"<p>{self.text(3, 25)}</p>"])
        elif kind == "side":
            inner = f"<h3>{self.text(1, 4)}</h3>" * r.randint(0, 1) + r.choice([self.links(2, 8), f"<p>{self.text(5, 40)}</p>", "".join(f"<div><h4>{self.text(2, 6)}</h4><p>{self.text(4, 20)}</p></div>" for _ in range(3))])
        elif kind == "notice":
            inner = r.choice([self.text(3, 30), f"<p>{self.text(3, 30)}</p>"]) + r.choice(["", "<button>Ok</button>", f'<a href="/x">{self.text(1, 2)}</a>'])
        elif kind == "advert":
            inner = r.choice([self.text(2, 40), f"<p>{self.text(2, 40)}</p>", f'<a href="/x">{self.text(2, 8)}</a>', f"{self.text(3, 9)}\n{self.text(2, 8)}"])
        elif kind == "form":
            inner = f"<label>{self.text(1, 4)}</label><input type=text>" * r.randint(1, 3) + r.choice(["", f"<p>{self.text(2, 15)}</p>"]) + f"<button>{self.text(1, 2)}</button>"
        elif kind == "comment":
            one = r.choice(['<div class="comment"><b>{a}</b><p>{t}</p></div>', "<li><p>{t}</p></li>", '<div class="comment">{t}</div>', "<p>{a}: {t}</p>", "<article><h4>{a}</h4><p>{t}</p></article>"])
            items = "".join(one.format(a=self.text(1, 2), t=self.text(3, 45)) for _ in range(r.randint(1, 7)))
            inner = f"<h3>{self.text(1, 3)}</h3>" * r.randint(0, 1) + (f"<ol>{items}</ol>" if one.startswith("<li") else items)
        else:
            inner = r.choice([self.links(1, 4), self.text(1, 10), f"<p>{self.text(1, 10)}</p>"])
        return f'<{tag}{name} data-y="b">{inner}</{tag}>'

    def paragraph(self) -> str:
        r = self.r
        text = self.text(2, r.choice([12, 60, 160]))
        if r.random() < 0.25:
            text += f' <a href="/y">{self.text(1, 4)}</a> {self.text(1, 12)}'
        shape = r.random()
        if shape < 0.74:
            return f"<p>{text}</p>"
        if shape < 0.82:
            return f"<p><b>{text}<br>"
        if shape < 0.86:
            return f"<h2>{self.text(1, 8)}</h2><p>{text}</p>"
        if shape < 0.90:
            return r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{self.item()}</li>" for _ in range(r.randint(1, 6))))
        if shape < 0.93:
            return f"<blockquote>{r.choice(['{}', '<p>{}</p>']).format(text)}</blockquote>"
        if shape < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.text(1, 5)}</td><td>{self.text(1, 5)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if shape < 0.97:
            return f"<div>{text}</div>"
        return f"<pre>{text}</pre>" if r.random() < 0.5 else f"<figure><img src=x><figcaption>{self.text(2, 12)}</figcaption></figure>"

    def item(self) -> str:
        """A point of a list in an article, often a link."""
        link = f'<a href="/z">{self.text(1, 8)}</a>'
        return self.r.choice([self.text(2, 25), link, link, f"{link} {self.text(1, 15)}", f"<p>{self.text(2, 20)}</p>", f"<p>{link}</p>"])

    def references(self) -> str:
        """What a writer puts into or under an article: a list of links without a name, with or without a heading."""
        r = self.r
        items = "".join(f'<li><a href="/{i}">{self.text(1, 9)}</a></li>' for i in range(r.randint(1, 7)))
        made = r.choice(["<ul>{}</ul>", "<ul>{}</ul>", "<ol>{}</ol>"]).format(items)
        return r.choice(["", "", f"<h2>{self.text(1, 4)}</h2>", f"<h3>{self.text(1, 4)}</h3>", f"<p>{self.text(1, 8)}</p>"]) + made

    def article(self) -> str:
        r = self.r
        n = r.choice([0, 1, 1, 2, 3, 5, 8, 14, 25])
        parts = [self.paragraph() for _ in range(n)]
        for kind, chance in (("advert", 0.2), ("share", 0.15), ("notice", 0.08), ("side", 0.08), ("form", 0.05)):
            if r.random() < chance:
                parts.insert(r.randint(0, len(parts)), self.outside(kind))
        if parts and r.random() < 0.3:
            parts.insert(r.choice([len(parts), r.randint(0, len(parts))]), self.references())
        if r.random() < 0.1:
            parts.append(self.outside("comment"))
        title = f"<h1>{self.text(1, 12)}</h1>" if r.random() < 0.85 or not parts else ""
        if title and r.random() < 0.07:
            title = f"<header>{title}</header>"
        body = "".join(parts)
        if r.random() < 0.2:
            body = f"<div{self.name('article')}>{body}</div>"
        kind = r.random()
        if kind < 0.45:
            return f'<article{self.name("article", 0.3)} data-y="m">{title}{body}</article>'
        if kind < 0.6:
            return f'<main{self.name("article", 0.3)} data-y="m">{title}{body}</main>'
        if kind < 0.9:
            return f'<div{self.name("article", 1.0)} data-y="m">{title}{body}</div>'
        return f'<{(t := r.choice(["div", "section"]))} data-y="m">{title}{body}</{t}>'

    def page(self) -> str:
        r = self.r
        before = [k for k, c in (("notice", 0.2), ("header", 0.5), ("menu", 0.8), ("advert", 0.4), ("form", 0.15), ("side", 0.15)) if r.random() < c]
        after = [k for k, c in (("share", 0.15), ("comment", 0.35), ("side", 0.3), ("advert", 0.2), ("form", 0.12), ("footer", 0.8), ("notice", 0.1)) if r.random() < c]
        r.shuffle(before)
        main = self.article()
        wrap = r.random()
        side = [k for k in before + after if k == "side"]
        if wrap < 0.25:
            main = f'<div{self.name("article", 0.4)}>{main}{"".join(self.outside(k) for k in side)}</div>'
        elif wrap < 0.4:
            main = f"<main>{main}{''.join(self.outside(k) for k in after if k == 'comment')}</main>"
        body = "".join(map(self.outside, before)) + main + "".join(map(self.outside, after))
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.text(1, 8)}</title></head><body>{body}</body></html>"


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for the marked article, its elements and what wraps it."""
    out, place = np.zeros(len(nodes)), {id(node): i for i, node in enumerate(nodes)}
    for i, node in enumerate(nodes):
        if node.label:
            out[i] = node.label == "m"
        elif node.parent is not None and i and _marked(node):
            out[i] = out[place[id(node.parent)]]
        if node.label == "m":
            up = node.parent
            while up is not None:
                out[place[id(up)]] = 1
                up = up.parent
    return out


def _marked(node: Node) -> bool:
    up = node.parent
    while up is not None:
        if up.label:
            return True
        up = up.parent
    return False


#: What the kept trees were fitted to: pages and seed of the generator.
PAGES, SEED = 2500, 11
STORED = Path(__file__).with_name("html_trees.json")


def fit_trees(n_pages: int, seed: int) -> boosting.Trees:
    """Trees fitted to ``n_pages`` written pages."""
    writer, x, y = _Writer(seed), [], []
    for _ in range(n_pages):
        nodes, _ = read(writer.page())
        x.append(node_features(nodes)[1:])
        y.append(labels(nodes)[1:])
    return boosting.fit(np.concatenate(x), np.concatenate(y))


def keep_trees(trees: boosting.Trees, path: Path = STORED) -> None:
    """Write trees with their parameters, a tree a line."""
    rows = [
        [f.tolist(), [None if c == np.inf else float(c) for c in cuts], np.round(v, 9).tolist()]
        for f, cuts, v in zip(trees.feature, trees.cut, trees.value, strict=True)
    ]
    text = ",\n".join(json.dumps(row) for row in rows)
    path.write_text(f'{{"pages": {PAGES}, "seed": {SEED}, "base": {trees.base!r}, "trees": [\n{text}\n]}}\n')


def kept_trees(path: Path = STORED) -> boosting.Trees:
    stored = json.loads(path.read_text())
    if (stored["pages"], stored["seed"]) != (PAGES, SEED):
        raise ValueError(f"{path.name} was made with other parameters; run python -m sparkgraph.llm.html_extract")
    feature, cut, value = zip(*stored["trees"], strict=True)
    cuts = [[np.inf if c is None else c for c in row] for row in cut]
    return boosting.Trees(stored["base"], np.array(feature, np.int64), np.array(cuts, float), np.array(value, float))


@functools.lru_cache(maxsize=2)
def fitted(n_pages: int = PAGES, seed: int = SEED) -> boosting.Trees:
    """The kept trees, or for other parameters than theirs newly fitted ones."""
    return kept_trees() if (n_pages, seed) == (PAGES, SEED) else fit_trees(n_pages, seed)


def _joined(nodes: list[Node], blocks: list[Block], margin: np.ndarray) -> str:
    kept = decode(nodes, margin)
    alive = {id(node) for node, keep in zip(nodes, kept, strict=True) if keep}
    return "\n".join(block.text for block in blocks if id(block.node) in alive)


def main_texts(pages: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page."""
    read_pages = [read(page) for page in pages]
    made = [node_features(nodes) for nodes, _ in read_pages]
    margin = trees.margin(np.concatenate(made)) if made else np.empty(0)
    ends = np.cumsum([0, *map(len, made)])
    return [_joined(nodes, blocks, margin[a:b]) for (nodes, blocks), a, b in zip(read_pages, ends[:-1], ends[1:], strict=True)]


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", trees: boosting.Trees | None = None) -> DataFrame:
    """``pages`` with the main text of each row in ``out_col``.

    Character references are decoded, white space in a block becomes one
    space, blocks are trimmed and joined by one line feed in page order. Null
    and empty pages, and pages without an article, have the empty text. Broken
    markup is read as far as it goes; a column of the name ``out_col`` is
    replaced.
    """
    small_batches(pages.sparkSession)
    names = [f"__c{i}" for i in range(len(pages.columns))]
    given = pages.toDF(*names)
    schema = T.StructType([*given.schema.fields, *flat_schema("__text string").fields])
    at, arrow = pages.columns.index(html_col), to_arrow_schema(schema)
    shared = pages.sparkSession.sparkContext.broadcast(trees or fitted())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for rows, _, _ in rows_by_bytes(batch, names[at], 1 << 20):
                texts = main_texts([p or "" for p in rows.column(at).to_pylist()], own)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], schema=arrow)

    kept = [F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True) if c != out_col]
    return given.mapInArrow(run, schema).select(*kept, F.col("__text").alias(out_col))


if __name__ == "__main__":
    keep_trees(fit_trees(PAGES, SEED))
