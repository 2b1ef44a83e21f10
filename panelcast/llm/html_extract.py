"""Main text of web pages: gradient-boosted trees over DOM features, decoded along the tree.

Training labels come from the pages themselves.  Pages that mark their article (``article``, ``main``)
say which elements belong to it; of a bounded sample of such pages, other layouts are made as well: the
article in plain containers, with reader comments, side columns, notices and forms filled with the
page's own words.  Boosted regression trees on the logistic loss then give every element a probability
of being main text.

Decoding takes the best consistent choice for the whole tree: a subtree is all main text, all
boilerplate, or mixed, and only children of a mixed element choose again, so no element is taken out of
a rejected one or left out of an accepted one without its parent being mixed, at a cost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.dom import Tree, block_text, features, parse
from panelcast.llm.workers import tidy


@dataclass(frozen=True)
class ExtractConfig:
    """``sample`` bounds the pages the trees are fitted on."""

    sample: int = 240
    trees: int = 40
    depth: int = 4
    bins: int = 32
    rate: float = 0.25
    least: int = 20
    mixed_cost: float = 1.0
    pages: int = 64


#: Elements that never belong to the article, wherever they stand.
_APART = {"nav", "aside", "footer", "form", "button", "dialog", "menu"}
_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_P = re.compile(r"<p\b[^>]*>(.*?)(?=<p\b|</p|</article|</main|\Z)", re.S | re.I)
_WORDS = re.compile(r"<[^>]*>")


def _plain(page: str) -> list[str]:
    """Sentences of the page's own paragraphs, to fill other boxes with."""
    texts = (_WORDS.sub(" ", m[1]) for m in _P.finditer(page))
    return [s.strip() for t in texts for s in t.split(".") if 20 < len(s.strip()) < 300] or ["More to read here soon"]


#: Containers an article may stand in, and boxes around it; {} is filled with the page's own words.
_CONTAINERS = (
    '<div class="post-content">{}</div>', '<div id="content"><div class="entry">{}</div></div>', '<section class="story-body">{}</section>',
    '<main role="main"><div>{}</div></main>', '<div class="wrap"><div class="row"><div class="col">{}</div></div></div>', '<article class="article">{}</article>',
)
_BEFORE = (
    '<header class="site-header"><a href="/">{}</a><p>{}</p></header>', '<div class="cookie-notice"><p>{}.</p><button>OK</button></div>', '<div class="breadcrumbs"><a href="/a">{}</a> <a href="/b">{}</a></div>',
    '<div class="menu"><ul><li><a href="/1">{}</a></li><li><a href="/2">{}</a></li></ul></div>', '<div class="banner ad"><p>{}. {}.</p></div>', '<div role="alert">{}.</div>',
)
_AFTER = (
    '<section class="comments" id="comments"><h3>{}</h3><div class="comment"><p>{}. {}.</p></div><div class="comment"><p>{}.</p></div></section>',
    '<ol class="comment-list"><li class="comment"><p>{}.</p></li><li class="comment"><p>{}. {}.</p></li></ol>',
    '<aside class="sidebar"><h4>{}</h4><p>{}. {}.</p><ul><li><a href="/x">{}</a></li></ul></aside>', '<div class="sidebar widget"><p>{}.</p><p>{}.</p></div>',
    '<form class="newsletter"><label>{}</label><input name="mail"><p>{}.</p></form>', '<div class="related"><h4>{}</h4><a href="/r">{}</a><a href="/s">{}</a></div>',
    '<div class="footer"><p>{}. {}.</p></div>', '<div class="share social"><a href="/t">{}</a></div>', '<div class="newsletter subscribe"><p>{}.</p></div>',
    '<div class="replies"><div class="reply"><p>{}. {}. {}.</p></div></div>', '<div class="promo sponsored"><p>{}. {}.</p></div>',
)
_MARK = "data-own-text"


def _fill(box: str, words: list[str], rng: np.random.Generator) -> str:
    return re.sub(r"\{\}", lambda _: words[int(rng.integers(len(words)))], box)


def _layouts(page: str, seed: int) -> Iterator[str]:
    """The page with its article marked, and variants of its layout; nothing for a page without an article."""
    m = _ARTICLE.search(page)
    if not m:
        return
    rng, words, inner = np.random.default_rng(seed), _plain(page), m[2]
    yield page[: m.start()] + f"<{m[1]} {_MARK}=1>{inner}</{m[1]}>" + page[m.end() :]
    for _ in range(3):
        holder = _CONTAINERS[int(rng.integers(len(_CONTAINERS)))]
        body = re.sub(r"^<(\w+)", rf"<\1 {_MARK}=1", holder).format(inner)
        inside = rng.random() < 0.3  # some boxes stand in the middle of the article's container
        boxes = [_fill(_AFTER[int(i)], words, rng) for i in rng.integers(len(_AFTER), size=int(rng.integers(1, 4)))]
        before = [_fill(_BEFORE[int(i)], words, rng) for i in rng.integers(len(_BEFORE), size=int(rng.integers(0, 3)))]
        marked = [re.sub(r"^<(\w+)", r"<\1 data-other=1", b) for b in before + boxes]
        if inside:
            cut = body.rfind("</")
            body = body[:cut] + marked.pop() + body[cut:]
        keep_head = rng.random() < 0.7
        head, tail = (page[: m.start()], page[m.end() :]) if keep_head else ("<html><body>", "</body></html>")
        k = min(len(before), len(marked))
        yield head + "".join(marked[:k]) + body + "".join(marked[k:]) + tail


def _labelled(tree: Tree) -> np.ndarray:
    """Whether each element belongs to the marked article."""
    out = np.zeros(len(tree.tag), bool)
    for i in range(1, len(tree.tag)):
        if _MARK in tree.attrs[i]:
            out[i] = True
        elif "data-other" in tree.attrs[i] or tree.tag[i] in _APART:
            out[i] = False
        else:
            out[i] = out[tree.parent[i]]
    return out


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays (trees x nodes): feature, threshold, value; children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node]))
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, config: ExtractConfig) -> Boosted:
    """Newton boosting on the logistic loss, splits by histograms of quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, config.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    nodes = 2 ** (config.depth + 1) - 1
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(x), base)
    trees = []
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes, np.float32), np.zeros(nodes)
        node = np.zeros(len(x), np.int64)
        for i in range(nodes):
            rows = np.flatnonzero(node == i)
            if not len(rows):
                continue
            gain, at = 0.0, None
            gs, hs = g[rows].sum(), h[rows].sum()
            value[i] = config.rate * gs / (hs + 1.0)
            if 2 * i + 2 < nodes and len(rows) >= 2 * config.least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    won = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    won[(nl < config.least) | (len(rows) - nl < config.least)] = 0
                    k = int(won.argmax())
                    if won[k] > gain + 1e-9:
                        gain, at = float(won[k]), (j, k)
            if at:
                j, k = at
                feature[i], threshold[i], value[i] = j, edges[j][k], 0.0
                node[rows] = 2 * i + 1 + (binned[rows, j] > k)
        score += value[node]
        trees.append((feature, threshold, value))
    return Boosted(np.array([t[0] for t in trees]), np.array([t[1] for t in trees]), np.array([t[2] for t in trees]), base)


def fit(pages: DataFrame, config: ExtractConfig = ExtractConfig()) -> Boosted | None:
    """Trees from a bounded sample of the pages (page_id, html) that mark an article; None without one."""
    marked = pages.select("page_id", "html").where("html IS NOT NULL").where(F.col("html").rlike("(?i)<(article|main)\\b"))
    count = marked.count()
    if not count:
        return None
    at = F.shiftrightunsigned(F.xxhash64("page_id", "html"), 11) / F.lit(float(1 << 53))
    drawn = marked.withColumn("_at", at).where(F.col("_at") < min(1.0, config.sample / count))

    def run(batches):
        for batch in batches:
            for page, place in zip(batch.column("html").to_pylist(), batch.column("_at").to_pylist(), strict=True):
                xs, ys = [], []
                for layout in _layouts(page, int(place * 2**53)):
                    tree = parse(layout)
                    x, held = features(tree)
                    keep = (held > 0) & (np.arange(len(held)) > 0)
                    xs.append(x[keep])
                    ys.append(_labelled(tree)[keep])
                if xs:
                    out = [pa.array([place]), pa.array([np.concatenate(xs).tobytes()], pa.binary()), pa.array([np.concatenate(ys).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, ["_at", "x", "y"])

    rows = sorted(drawn.mapInArrow(tidy(run), "_at double, x binary, y binary").collect(), key=lambda r: (r["_at"], bytes(r["x"])))
    if not rows:
        return None
    y = np.concatenate([np.frombuffer(bytes(r["y"]), bool) for r in rows])
    x = np.concatenate([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).reshape(len(y), -1)
    return boost(x, y.astype(float), config)


def decode(tree: Tree, odds: np.ndarray, held: np.ndarray, config: ExtractConfig) -> np.ndarray:
    """For each element whether its own text is main text: the best consistent labelling of the tree."""
    n = len(tree.tag)
    odds = np.clip(odds, -12, 12)
    yes, no = -np.log1p(np.exp(-odds)), -np.log1p(np.exp(odds))
    yes[held <= 0] = no[held <= 0] = 0.0
    yes[0] = no[0] = 0.0
    parent = tree.parent
    all_in, all_out = yes.tolist(), no.tolist()
    mixed = np.maximum(yes, no).tolist()
    best = [0.0] * n
    state = [0] * n
    cost = config.mixed_cost
    for i in range(n - 1, -1, -1):
        m = mixed[i] - cost
        top = max(all_in[i], all_out[i], m)
        best[i] = top
        state[i] = 1 if top == all_in[i] else 0 if top == all_out[i] else 2
        if i:
            p = parent[i]
            all_in[p] += all_in[i]
            all_out[p] += all_out[i]
            mixed[p] += top
    out = np.zeros(n, bool)
    final = [0] * n
    for i in range(n):
        above = final[parent[i]] if i else 2
        final[i] = state[i] if above == 2 else above
        out[i] = final[i] == 1 or (final[i] == 2 and odds[i] > 0)
    return out


def extract(pages: DataFrame, model: Boosted | None, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """All columns of ``pages`` but html, and ``text``: the main text of the whole html.

    Null or empty html, pages without text and a missing model give an empty text.  Other columns, nulls in
    them and repeated rows pass through; a column named ``text`` is refused.  Deep nesting, unclosed tags and
    pages cut off anywhere are read as far as they go.
    """
    if "text" in {c.lower() for c in pages.columns}:
        raise ValueError("the input already has a column text")
    held_model = pages.sparkSession.sparkContext.broadcast(model)  # trees of a fixed number and depth

    def texts(group: list[str | None]) -> list[str]:
        trees = [parse(p or "") for p in group]
        parts = [features(t) for t in trees]
        odds = held_model.value.score(np.concatenate([x for x, _ in parts]))
        out, a = [], 0
        for tree, (x, held) in zip(trees, parts, strict=True):
            own = decode(tree, odds[a : a + len(x)], held, config)
            a += len(x)
            out.append(block_text([p for p in tree.pieces if own[p[0]]]))
        return out

    def run(batches):
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, config.pages):
                group = batch.column("html").slice(a, config.pages).to_pylist()
                out += texts(group) if held_model.value is not None else [""] * len(group)
            rest = batch.drop_columns(["html"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string())], [*rest.schema.names, "text"])

    schema = pages.drop("html").withColumn("text", F.lit("")).schema
    return pages.mapInArrow(tidy(run), schema)
