"""A small tolerant HTML tree: elements, their text blocks, and numeric features of each element."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not page text: up to the closing tag or the end of the page, or only if they are closed.
RAW = frozenset("script style textarea title iframe xmp".split())
HIDDEN = frozenset("noscript template svg math select".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
#: An opening tag ends these open elements, up to the nearest of the second group.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Attribute tokens by meaning; a feature each.
TOKEN_GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs toolbar skip".split(),
    "head": "header masthead banner topbar logo branding".split(),
    "foot": "footer copyright legal colophon bottom".split(),
    "side": "sidebar aside rail widget related recommended popular trending secondary".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay disclaimer paywall warning".split(),
    "form": "form newsletter subscribe subscription signup login search contact input".split(),
    "comment": "comment comments reply replies respond discussion disqus thread reader feedback".split(),
    "share": "share sharing social follow twitter facebook tags meta byline".split(),
    "body": "article content main post entry story text body blog page".split(),
}
_GROUP = {t: i for i, ts in enumerate(TOKEN_GROUPS.values()) for t in ts}
TAG_GROUPS = (
    ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("div",), ("section",), ("article", "main"), ("nav", "menu"), ("header",), ("footer", "address"), ("aside",),
    ("ul", "ol", "dl", "dir"), ("li", "dt", "dd"), ("a",), ("form", "fieldset", "button", "label", "legend", "dialog"), ("table", "tbody", "thead", "tr", "td", "th"),
    ("blockquote", "pre", "figure", "figcaption"), ("span", "b", "i", "em", "strong", "u", "small", "code", "font"),
)
_TAG_GROUP = {t: i for i, ts in enumerate(TAG_GROUPS) for t in ts}


@dataclass
class Tree:
    """Elements in page order (0 is the root) and pieces of text: (element, block number, text)."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attrs: list[str] = field(default_factory=lambda: [""])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """The tree of a whole page; unclosed, misplaced and cut-off tags are tolerated, raw elements carry no text."""
    tree, stack, opened, block, at, n = Tree(), [0], {}, 0, 0, len(page)
    tags, parents, pieces, unclosed = tree.tag, tree.parent, tree.pieces, set()

    def pop_to(depth: int) -> None:
        nonlocal block
        while len(stack) > depth:
            t = tags[stack.pop()]
            opened[t] -= 1
            if t in BLOCK:
                block += 1

    def end(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if not any(opened.get(x) for x in names):
            return
        for d in range(len(stack) - 1, 0, -1):
            t = tags[stack[d]]
            if t in scope:
                return
            if t in names:
                pop_to(d)
                return

    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            pieces.append((stack[-1], block, text))
        if not m:
            break
        at, name = m.end(), m[2]
        if name is None:
            continue
        if not m[4]:  # the page ends inside a tag
            break
        name = name.lower()
        if m[1]:
            if name == "br":
                pieces.append((stack[-1], block, " "))
            elif name == "p" and not opened.get("p"):
                block += 1
            elif opened.get(name):
                for d in range(len(stack) - 1, 0, -1):
                    if tags[stack[d]] == name:
                        pop_to(d)
                        break
            continue
        if name in RAW or name in HIDDEN:
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if close is None:
                unclosed.add(name)  # nor is any later one
            at = close.end() if close else n if name in RAW else at
            continue
        if name in _CLOSES_P:
            end(("p",), ("table", "td", "th", "button"))
        if name in _ENDS:
            end(*_ENDS[name])
        if name in ("html", "body", "head") and opened.get(name):
            continue
        if name in BLOCK:
            block += 1
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append((stack[-1], block, " "))
            continue
        tags.append(name)
        parents.append(stack[-1])
        tree.attrs.append(m[3])
        stack.append(len(tags) - 1)
        opened[name] = opened.get(name, 0) + 1
    return tree


def tokens(attrs: str) -> list[int]:
    """Token groups of the class, id and role of an element."""
    if not attrs or "=" not in attrs:
        return []
    found = []
    for m in _ATTR.finditer(attrs):
        for t in _TOKEN.findall(m[2] or m[3] or m[4] or ""):
            g = _GROUP.get(t.lower())
            if g is not None:
                found.append(g)
    return found


N_GROUPS, N_TAGS = len(TOKEN_GROUPS), len(TAG_GROUPS)
_POINTS = re.compile(r"[.,;:!?]")
_DIGITS = re.compile(r"\d")


def _bits(masks: list[int], width: int) -> np.ndarray:
    return (np.array(masks, np.int64)[:, None] >> np.arange(width)) & 1


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Features of every element (elements x FEATURES) and the characters of text below each."""
    n, parent = len(tree.tag), tree.parent
    own = np.zeros((n, 7))  # chars, chars in links, elements, blocks, punctuation, digits, words
    depth, children, size = [0] * n, [0] * n, [1] * n
    link, group, above, tag, tags_above = [False] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        children[p] += 1
        link[i] = link[p] or tree.tag[i] == "a"
        above[i] = above[p] | group[p]
        tags_above[i] = tags_above[p] | tag[p]
        for g in tokens(tree.attrs[i]):
            group[i] |= 1 << g
        t = _TAG_GROUP.get(tree.tag[i])
        if t is not None:
            tag[i] = 1 << t
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    last = -1
    for e, b, text in tree.pieces:
        c = len(text.strip())
        if not c:
            continue
        row = own[e]
        row[0] += c
        row[4] += len(_POINTS.findall(text))
        row[5] += len(_DIGITS.findall(text))
        row[6] += text.count(" ") + 1
        if b != last:
            row[3] += 1
            last = b
    own[:, 1] = np.where(link, own[:, 0], 0)
    own[:, 2] = 1
    # elements stand in page order, so a subtree is a range of them
    run = np.concatenate((np.zeros((1, 7)), np.cumsum(own, axis=0)))
    sums = run[np.arange(n) + np.array(size)] - run[:-1]
    up, kids = np.maximum(np.array(parent), 0), np.array(children, float)
    total, c, ahead = max(sums[0, 0], 1.0), np.maximum(sums[:, 0], 1), run[:-1, 0]
    beside = np.maximum(sums[up, 0] - own[up, 0] - sums[:, 0], 0) / np.maximum(kids[up] - 1, 1)
    base = [
        np.array(depth), np.log1p(sums[:, 0]), np.log1p(own[:, 0]), sums[:, 1] / c, sums[:, 2] / c, np.log1p(sums[:, 3]), sums[:, 4] / c, sums[:, 5] / c,
        sums[:, 6] / np.maximum(sums[:, 3], 1), kids, ahead / total, (ahead + sums[:, 0] / 2) / total, np.log1p(beside), kids[up], np.log1p(np.full(n, total)),
        sums[:, 0] / total, own[:, 0] / c, sums[:, 0] / np.maximum(sums[up, 0], 1), np.log1p(sums[:, 2]),
    ]
    masks = [_bits(group, N_GROUPS), _bits(above, N_GROUPS), _bits(tag, N_TAGS), _bits(tags_above, N_TAGS)]
    return np.concatenate([np.stack(base, axis=1), *masks], axis=1).astype(np.float32), sums[:, 0]


def block_text(pieces: list[tuple[int, int, str]]) -> str:
    """Pieces joined by block: references decoded, white space to one space, trimmed; blocks joined by a line feed."""
    out, current, held = [], None, []
    for _, b, text in [*pieces, (0, -1, "")]:
        if b != current:
            line = " ".join(html.unescape("".join(held)).split())
            if line:
                out.append(line)
            current, held = b, []
        held.append(text)
    return "\n".join(out)
