"""Main text of web pages by a tree-structured graphical model.

The nodes of a page's tree are content or not.  A node's own potential comes
from its tag, its names and its text; a potential on every edge says how often
a child is like its parent.  Sum-product messages up the tree and down again
give each node's marginal, and the text of the nodes that are more likely
content than not is the page's main text.  Potentials are trained on labelled
pages.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import parallel
from ranklake.llm.dom import Node, read

# Words in class, id and role names, by what they stand for.
GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination pages toc tabs toolbar skip skiplink",
    "head": "header masthead topbar logo branding hero banner site",
    "foot": "footer foot copyright colophon legal imprint contentinfo",
    "side": "sidebar aside side widget widgets rail complementary related recommended recommendations popular trending more teaser promos",
    "ask": "newsletter subscribe subscription signup login search form share sharing social follow poll survey contact",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert warning message disclaimer privacy",
    "advert": "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promotion commercial outbrain taboola",
    "reader": "comment comments commentlist reply replies respond discussion disqus reviews feedback thread guestbook",
    "text": "content article post entry story main body text blog news paragraph lead intro",
}
GROUP_OF = {w: g for g, words in GROUPS.items() for w in words.split()}
MARKS = frozenset("article aside footer form header main nav".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_groups(names: str) -> tuple[str, ...]:
    return tuple(sorted({GROUP_OF[w] for w in (x.lower() for x in WORDS.findall(names)) if w in GROUP_OF}))


def level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


@dataclass
class Page:
    """Nodes of a page that hold text somewhere below, with features."""

    parents: list[int]
    features: list[tuple[str, ...]]
    texts: list[str]
    labels: list[int | None]


def understand(nodes: list[Node]) -> Page:
    n = len(nodes)
    texts = [" ".join("".join(x.text).split()) if x.text else "" for x in nodes]
    size, linked, count = [len(t) for t in texts], [x.linked for x in nodes], [1] * n
    for i in range(n - 1, 0, -1):  # children come after parents
        p = nodes[i].parent
        size[p] += size[i]
        linked[p] += linked[i]
        count[p] += count[i]
    keep = [i for i in range(n) if size[i]]
    new = {i: k for k, i in enumerate(keep)}
    kids = [0] * n
    for i in keep:
        if nodes[i].parent >= 0:
            kids[nodes[i].parent] += 1
    features, inside = [], {-1: ()}  # inside: what the nearest node with a telling tag or name says
    for i in keep:
        x = nodes[i]
        groups = name_groups(x.names)
        own = tuple("in " + g for g in groups) + (("in " + x.tag,) if x.tag in MARKS else ())
        inside[i] = own or inside[x.parent]
        f = ["tag " + x.tag, "size %d" % level(size[i], (25, 80, 250, 1000)),
             "links %d" % level(linked[i] / max(1, size[i]), (0.05, 0.3, 0.6, 0.9))]
        f += ["name " + g for g in groups]
        f += inside[x.parent]
        f.append("leaf" if kids[i] == 0 else "parts %d" % level(kids[i], (2, 5, 12)))
        if texts[i]:
            f.append("stop" if texts[i][-1] in ".!?…" else "open")
        features.append(tuple(f))
    return Page([new.get(nodes[i].parent, -1) for i in keep], features, [texts[i] for i in keep], [nodes[i].label for i in keep])


@dataclass
class Model:
    """``weights`` of features (log odds of content), ``bias``, and the log
    potentials of an edge, ``edge`` [parent][child]."""

    weights: dict[str, float]
    bias: float
    edge: list[list[float]]
    _own: dict = field(default_factory=dict, repr=False)

    def own(self, features: tuple[str, ...]) -> float:
        got = self._own.get(features)
        if got is None:
            got = self.bias + sum(self.weights.get(f, 0.0) for f in features)
            if len(self._own) < 100_000:
                self._own[features] = got
        return got

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node: messages from the leaves to the root, then
        back.  A message is the log ratio of its two entries."""
        n = len(page.parents)
        (e00, e01), (e10, e11) = self.edge
        a00, a01, a10, a11 = math.exp(e00), math.exp(e01), math.exp(e10), math.exp(e11)
        up = [self.own(f) for f in page.features]  # own potential and the children's messages
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            r = math.exp(max(-60.0, min(60.0, up[i])))
            sent[i] = math.log((a10 + a11 * r) / (a00 + a01 * r))
            up[page.parents[i]] += sent[i]
        belief = up[:]
        for i in range(1, n):
            r = math.exp(max(-60.0, min(60.0, belief[page.parents[i]] - sent[i])))
            belief[i] = up[i] + math.log((a01 + a11 * r) / (a00 + a10 * r))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, b)))) for b in belief]

    def extract(self, html: str | None) -> str:
        page = understand(read(html))
        chance = self.marginals(page) if page.parents else []
        return "\n".join(t for t, c in zip(page.texts, chance, strict=True) if t and c >= 0.5)


def train(pages: list[str], rounds: int = 600, rate: float = 0.3, keep: float = 2e-5) -> Model:
    """Potentials of the nodes and of the edge that make the labels of the
    pages most likely, by gradient ascent: expected counts come from the same
    messages that score a page, over all pages' trees at once, depth by depth.
    A node without a label is content if all text below it is: what holds the
    whole page is not, so the things around an article say nothing against it."""
    features, labels, parents, depths = [], [], [], []
    for html in pages:
        page = understand(read(html, "y"))
        first = len(features)
        whole = [not t or x == 1 for t, x in zip(page.texts, page.labels, strict=True)]
        for i in range(len(page.parents) - 1, 0, -1):
            whole[page.parents[i]] &= whole[i]
        for i, p in enumerate(page.parents):
            features.append(page.features[i])
            labels.append(whole[i] if page.labels[i] is None else page.labels[i])
            parents.append(first + p if p >= 0 else -1)
            depths.append(depths[first + p] + 1 if p >= 0 else 0)
    vocabulary = sorted({f for fs in features for f in fs})
    number = {f: k for k, f in enumerate(vocabulary)}
    x = np.zeros((len(features), len(vocabulary) + 1))
    x[:, -1] = 1
    for k, fs in enumerate(features):
        x[k, [number[f] for f in fs]] = 1
    y, up_to, depth = np.array(labels, float), np.array(parents), np.array(depths)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(up_to >= 0)
    true = np.array([[((y[up_to[child]] == a) & (y[child] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, edge = np.zeros(x.shape[1]), np.zeros((2, 2))
    past_w, past_e = np.full(len(w), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        t = np.exp(edge)
        up, sent = x @ w, np.zeros(len(y))
        for own in reversed(levels):
            r = np.exp(np.clip(up[own], -60, 60))
            sent[own] = np.log((t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r))
            np.add.at(up, up_to[own], sent[own])
        belief, rest = up.copy(), np.zeros(len(y))
        for own in levels:
            rest[own] = np.clip(belief[up_to[own]] - sent[own], -60, 60)
            r = np.exp(rest[own])
            belief[own] = up[own] + np.log((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r))
        a, b = rest[child], np.clip(up[child], -60, 60)
        joint = np.exp(np.stack([np.zeros(len(child)), b, a, a + b]) + edge.reshape(4, 1))
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        gw = x.T @ (1 / (1 + np.exp(-np.clip(belief, -60, 60))) - y) / len(y) + keep * w
        ge = (joint - true) / len(y) + keep * edge
        past_w += gw * gw
        past_e += ge * ge
        w -= rate * gw / np.sqrt(past_w)
        edge -= rate * ge / np.sqrt(past_e)
    return Model({f: float(w[k]) for f, k in number.items()}, float(w[-1]), edge.tolist())


def labelled_pages(seed: int = 11) -> list[str]:
    """The labelled pages that come with the operator: common layouts with
    filler text.  ``y`` marks content (1) and the rest (0)."""
    rng = random.Random(seed)
    syllables = "ta ri lo men sa ver du ki no pel as en or ti ma".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def text(a: int, b: int) -> str:
        return ". ".join(words(1, 14).capitalize() for _ in range(rng.randint(a, b))) + "."

    def part(t: str) -> str:
        """Rarer parts of an article."""
        rows = "".join(f"<tr><t{c}>{words(1, 2)}</t{c}><td>{rng.randint(1, 999)}</td><td>{words(1, 4)}</td></tr>" for c in rng.choices("hd", k=rng.randint(1, 4)))
        head = rng.choice(["h3", "h4"])
        return rng.choice([
            f"<div>{t}</div>", f"<div><div>{t}</div><div>{text(1, 2)}</div></div>", f"<p><a href='/x'>{rng.choice([t, words(2, 6)])}</a></p>",
            f"<table>{rows}</table>", f"<table><caption>{words(2, 5)}</caption><tbody>{rows}</tbody></table>",
            f"<figure><img src='x'><figcaption>{short()}</figcaption></figure>", f"<{head}>{words(1, 6)}</{head}><p>{t}</p>", f"<pre>{t}</pre>",
            f"<dl><dt>{words(1, 3)}</dt><dd>{t}</dd></dl>", f"<section><{head}>{words(1, 4)}</{head}><p>{t}</p></section>",
            f"<section id='{words(1, 1)}'><h2>{words(1, 4)}</h2><p>{t}</p></section>", f"<ol><li>{words(1, 4)}</li><li>{words(1, 4)}</li></ol>"])

    def paras(a: int, b: int) -> str:
        made = []
        for _ in range(rng.randint(a, b)):
            t = text(1, 6) if rng.random() < 0.8 else words(1, 4)
            if rng.random() < 0.2:
                t = f"{t} <a href='#'>{words(1, 3)}</a> {text(1, 2)}"
            if rng.random() < 0.35:
                made.append(part(t))
                continue
            made.append(rng.choice([f"<p>{t}</p>", f"<p>{t}</p>", f"<p><b>{t}<br>", f"<h2>{words(1, 6)}</h2><p>{t}</p>",
                                    f"<blockquote>{t}</blockquote>", f"<ul><li>{words(2, 9)}</li><li>{text(1, 2)}</li></ul>", f"<p>{t}<br>{words(1, 5)}"]))
        return "".join(made)

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(rng.randint(a, b))) + "</ul>"

    def short() -> str:
        return rng.choice([words(1, 8), text(1, 3)])

    def extras() -> list[str]:
        """What stands around an article; all of it is no content."""
        return [
            f"<nav y=0>{links(2, 9)}</nav>", f"<div class='{rng.choice(['menu', 'navbar', 'breadcrumb'])}' y=0>{links(1, 6)}</div>",
            f"<header y=0><h1>{words(1, 3)}</h1><p>{short()}</p></header>", f"<div id='{rng.choice(['header', 'masthead', 'site-header'])}' y=0>{short()}</div>",
            f"<div class='{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'promo-box', 'advertisement'])}' y=0>{short()}</div>",
            f"<div class='ad' y=0><p>{short()}</p></div>",
            f"<aside y=0><h3>{words(1, 3)}</h3>{links(2, 5)}</aside>", f"<aside y=0><p>{text(1, 4)}</p></aside>",
            f"<div class='{rng.choice(['sidebar', 'widget', 'related-posts', 'right-rail'])}' y=0><h3>{words(1, 3)}</h3><p>{text(1, 4)}</p></div>",
            f"<div class='{rng.choice(['cookie-notice', 'cookie-banner', 'consent', 'gdpr', 'notice'])}' y=0><p>{text(1, 4)}</p><button>{words(1, 2)}</button></div>",
            f"<form y=0><p>{short()}</p><label>{words(1, 3)}</label><input><button>{words(1, 1)}</button></form>",
            f"<div class='{rng.choice(['newsletter', 'share', 'login', 'search'])}' y=0>{short()}</div>",
            f"<footer y=0>&copy; {words(1, 3)} &middot; {short()}</footer>", f"<footer y=0><p>{short()}</p>{links(1, 4)}</footer>",
            f"<div id='footer' y=0><p>{short()}</p></div>",
            f"<section class='comments' y=0><h2>{words(1, 2)}</h2><div class='comment'><p>{text(1, 5)}</p></div><div class='comment'><p>{text(1, 3)}</p></div></section>",
            f"<div id='comments' y=0><ol class='commentlist'><li>{text(1, 4)}</li><li><p>{text(1, 6)}</p></li></ol></div>",
            f"<ul class='replies' y=0><li class='reply'><p>{text(1, 4)}</p></li></ul>",
        ]

    def article() -> str:
        size = rng.choice([0, 1, 3, 9])
        body = f"<h1>{short()}</h1>" * (not size or rng.random() < 0.6) + (paras(1, size) if size else f"<p><b>{short()}<br>")
        inner = rng.choice(extras()[4:12]) if rng.random() < 0.25 else ""
        if rng.random() < 0.08:  # no element of its own
            return "".join(f"<p y=1>{text(1, 4)}</p>" for _ in range(rng.randint(1, 6)))
        name = rng.choice(["content", "post", "entry-content", "main", "story", "article-body"])
        return rng.choice([f"<article y=1>{body}{inner}</article>", f"<article y=1>{body}</article>", f"<main y=1>{body}{inner}</main>",
                           f"<main y=1><article>{body}</article></main>", f"<div class='{name}' y=1>{body}</div>",
                           f"<div id='{name}' y=1><div>{body}</div></div>", f"<section class='{name}' y=1>{body}{inner}</section>", f"<div y=1>{body}</div>"])
    pages = []
    for k in range(400):
        around = extras()
        rng.shuffle(around)
        before, after = around[:rng.randint(0, 3)], around[3:3 + rng.randint(0, 4)]
        whole = "".join(before) + (article() if k % 24 else "") + "".join(after)
        if rng.random() < 0.3:
            whole = f"<div class='{rng.choice(['wrapper', 'container', 'page', ''])}'>{whole}</div>"
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{whole}</body></html>")
    return pages


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url,
    html): the main text's blocks, one a line, white space within a block one
    space.  A null or empty page, and one without content, has the empty text;
    repeated rows are treated alike; further columns are ignored."""
    model = model or train(labelled_pages())
    weights, bias, edge = model.weights, model.bias, model.edge

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = Model(weights, bias, edge)
        for b in batches:
            yield pd.Series([run.extract(h) for h in b], dtype=object)
    out = parallel(pages.select("page_id", "url", "html")).withColumn("text", main_text("html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
