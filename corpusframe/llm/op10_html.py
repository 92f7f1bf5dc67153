"""Main text of web pages by gradient-boosted trees over DOM-node features, decoded down the tree.

Every block of a page (a node that holds text of its own) gets features of itself and of its ancestors: text and link
density of the subtree, words of its and their attributes, depth, place among siblings. Boosted trees give each node
the log odds of being main text. Decoding goes from the root down and keeps the cheaper of two readings per subtree:
all of it is boilerplate, or its children are read on their own, so that no block is kept below a discarded ancestor.

No page says which of its nodes are main text. The trees are therefore fitted (by Spark's own learner) on pages laid
out anew: texts of a bounded sample of the given pages, placed in layouts made by rule, where each place is known.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import bounded

#: Pages, by hash of the id, whose texts fill the layouts, and pages laid out from them.
SAMPLE_PAGES = 256
LAYOUTS = 400
TREES, DEPTH = 16, 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page, or no markup.
RAW = frozenset("script style noscript template textarea title".split())
#: Nodes of their own that stand inside a run of text and do not end it.
EMBEDDED = frozenset("svg object canvas iframe select datalist".split())
#: Entries to choose from; what stands directly in them is no text of the page, what is opened in them may be.
CHOICES = frozenset("option optgroup".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()) | frozenset(
    # Formulas.
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtext munder munderover none semantics annotation annotation-xml".split()
)
#: Line breaks, rows and cells of formulas.
SPACED = frozenset("br mtr mlabeledtr mtd".split())
#: A new one of these ends an open one that stands directly above.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
#: Blocks that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Reading stops looking for what an end tag closes at these.
SCOPE = frozenset("html body article main section div aside header footer nav table td th form".split())

TOKEN_GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc sitemap links".split(),
    "head": "header masthead banner logo topbar hero".split(),
    "foot": "footer foot copyright colophon legal".split(),
    "side": "sidebar side aside widget rail related recommended popular trending more".split(),
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted commercial".split(),
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe signup paywall".split(),
    "comment": "comment comments commentlist reply replies discussion disqus respond review reviews".split(),
    "social": "share social sharing follow tweet facebook".split(),
    "form": "form search login input".split(),
    "main": "article main content post entry story body text prose read".split(),
}
_GROUP_OF = {word: i for i, words in enumerate(TOKEN_GROUPS.values()) for word in words}
_TAG_GROUPS = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "dialog": 5, "form": 8, "fieldset": 8, "button": 8, "article": 9, "main": 9}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/\"'>]+)")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple = ()
    hidden: bool = False
    #: Runs of text and inline content directly inside, as block texts in page order with the order number.
    blocks: list = field(default_factory=list)


def _attributes(raw: str) -> tuple[tuple, bool]:
    tokens, hidden = [], False
    for name, value, bare in _ATTRIBUTE.findall(raw):
        name = (name or bare).lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in value):
            hidden = True
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()) is not None
        elif name in ("class", "id", "role"):
            tokens += _SPLIT.split(_CAMEL.sub(" ", entities.unescape(value)).lower())
    return tuple(t for t in tokens if t), hidden


def parse(page: str) -> list[Node]:
    """The nodes of a page, parents before children; unclosed and misplaced tags are mended as browsers do, roughly."""
    nodes = [Node("", -1, 0)]
    stack = [0]
    run: list[str] = []
    linked: list[int] = [0]  # characters of the run inside links
    links = 0
    order = 0
    at = 0
    # Around an embedded node: the run, its characters inside links, its order number and whether a link is open.
    around: dict[int, tuple] = {}
    begun = None  # order number of a run that an embedded node has interrupted

    def flush():
        nonlocal order, begun
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text and nodes[stack[-1]].tag not in CHOICES:
            nodes[stack[-1]].blocks.append((order if begun is None else begun, text, linked[0]))
            order += begun is None
        run.clear()
        linked[0], begun = 0, None

    def leave():
        nonlocal links, begun
        flush()
        if (outer := around.pop(stack.pop(), None)) is not None:
            run[:], linked[0], begun, links = outer

    def add(text):
        if text:
            run.append(text)
            if links:
                linked[0] += len(text.strip())

    while True:
        found = _MARKUP.search(page, at)
        add(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        end, tag = (found.group(1) or "").lower(), (found.group(2) or "").lower()
        if not end and not tag:
            continue
        if end in INLINE or tag in INLINE:
            if "a" in (end, tag):
                links = 1 if tag else 0
            continue
        if tag in SPACED or end in SPACED:
            add(" ")
            continue
        if tag in RAW:
            # Up to its own end tag nothing is markup.
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not found.group(0).endswith("/>"):
                at = close.end() if close else len(page)
            continue
        if tag in EMBEDDED:
            if begun is None and "".join(run).strip():
                begun, order = order, order + 1
            outer = (run[:], linked[0], begun, links)
            run.clear()
            linked[0] = links = 0
            begun = None
            tokens, hidden = _attributes(found.group(3) or "")
            nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, tokens, hidden))
            stack.append(len(nodes) - 1)
            around[stack[-1]] = outer
            if found.group(0).endswith("/>"):
                leave()
            continue
        if end not in EMBEDDED:
            flush()
        if end:
            for back in range(len(stack) - 1, 0, -1):
                if nodes[stack[back]].tag == end:
                    while len(stack) > back:
                        leave()
                    break
                if nodes[stack[back]].tag in SCOPE and end not in SCOPE:
                    break
            continue
        links = 0
        if tag in VOID:
            continue
        top = nodes[stack[-1]].tag
        if (top == "p" and tag in ENDS_P) or top in CLOSES.get(tag, ()):
            leave()
            if tag in ("tr", "optgroup") and nodes[stack[-1]].tag == tag:
                leave()
        tokens, hidden = _attributes(found.group(3) or "")
        parent = stack[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens, hidden))
        if not found.group(0).endswith("/>"):
            stack.append(len(nodes) - 1)
    while len(stack) > 1:
        leave()
    flush()
    return nodes


_ENDS = (".", "!", "?", "…", ":", '"', "”", "»")
_SPEAKS = re.compile(r"©|\(c\)|cookie|subscribe|sign in|log in|newsletter|all rights reserved|advertis|sponsor", re.I)
FEATURES = [
    "chars", "words", "link_share", "sentence_ends", "block_mean", "blocks", "children", "page_share", "depth", "place", "siblings",
    "like_siblings", "heading", "paragraph", "listed", "cell", "phrases", "hidden", "parent_chars", "parent_link_share", "near_nav",
    *(f"own_{g}" for g in TOKEN_GROUPS), *(f"above_{g}" for g in TOKEN_GROUPS), *(f"inside_{g}" for g in TOKEN_GROUPS),
]


#: Blocks up to this length are looked through for a page's set phrases; longer ones are no notices.
PHRASE_BLOCK = 300
_HEADINGS, _PARAGRAPHS, _LISTED, _CELLS = ({t: 1 for t in tags.split()} for tags in ("h1 h2 h3 h4 h5 h6", "p blockquote pre", "li dt dd ul ol dl", "td th tr table"))


def features(pages: list[list[Node]]) -> np.ndarray:
    """(nodes of all pages, page after page) x FEATURES."""
    starts = np.cumsum([0] + [len(nodes) for nodes in pages])
    n, groups = int(starts[-1]), len(TOKEN_GROUPS)
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not n:
        return out
    nodes = [node for page in pages for node in page]
    base = np.repeat(starts[:-1], np.diff(starts))
    parent = np.array([node.parent for node in nodes]) + base
    root = np.array([node.parent < 0 for node in nodes])
    parent[root] = np.flatnonzero(root)
    depth = np.array([node.depth for node in nodes])
    kinds: dict = {}
    kind = np.array([kinds.setdefault(node.tag, len(kinds)) for node in nodes])
    own = np.zeros((n, groups), np.float32)
    sums = np.zeros((n, 6))  # characters, words, characters in links, sentence ends, blocks, blocks with set phrases
    hidden = np.zeros(n, np.float32)
    for i, node in enumerate(nodes):
        if node.tag in _TAG_GROUPS:
            own[i, _TAG_GROUPS[node.tag]] = 1
        for token in node.tokens:
            if token in _GROUP_OF:
                own[i, _GROUP_OF[token]] = 1
        if node.hidden:
            hidden[i] = 1
        for _, text, link in node.blocks:
            size = len(text)
            sums[i] += (size, text.count(" ") + 1, min(link, size), text.endswith(_ENDS), 1, size <= PHRASE_BLOCK and _SPEAKS.search(text) is not None)
    above, inside = np.zeros_like(own), np.zeros_like(own)
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
    for at in levels:
        above[at] = np.maximum(above[parent[at]], own[parent[at]])
        hidden[at] = np.maximum(hidden[at], hidden[parent[at]])
    for at in reversed(levels):
        np.add.at(sums, parent[at], sums[at])
        np.maximum.at(inside, parent[at], np.maximum(inside[at], own[at]))
    # Siblings stand together in page order when nodes are sorted by parent; a root is its own only sibling.
    family = np.where(root, n + np.arange(n), parent)
    order = np.argsort(family, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(family[order]) != 0])
    count = np.diff(np.r_[first, n])
    place, siblings = np.zeros(n), np.zeros(n)
    place[order] = np.arange(n) - np.repeat(first, count)
    siblings[order] = np.repeat(count, count)
    _, same, alike = np.unique(family * len(kinds) + kind, return_inverse=True, return_counts=True)
    menu = own[order, 0] > 0
    beside = menu.copy()
    together = np.diff(family[order]) == 0
    beside[1:] |= menu[:-1] & together
    beside[:-1] |= menu[1:] & together
    near = np.zeros(n)
    near[order] = beside
    children = np.zeros(n)
    np.add.at(children, parent[~root], 1)
    chars, words, linked, ends, blocks, phrases = sums.T
    some, held = np.maximum(blocks, 1), np.maximum(chars, 1)
    tagged = [np.array([names.get(node.tag, 0) for node in nodes]) for names in (_HEADINGS, _PARAGRAPHS, _LISTED, _CELLS)]
    for k, column in enumerate((
        np.log1p(chars), np.log1p(words), linked / held, ends / some, np.log1p(chars / some), np.log1p(blocks), np.log1p(children), chars / held[base], depth,
        place / siblings, np.log1p(siblings), alike[same] / siblings, *tagged, phrases / some, hidden, np.log1p(chars[parent]), (linked / held)[parent], near,
    )):
        out[:, k] = column
    out[:, 21 : 21 + groups], out[:, 21 + groups : 21 + 2 * groups], out[:, 21 + 2 * groups :] = own, above, inside
    return out


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays: feature (-1: leaf), threshold (left if at most), left, right, value (of a leaf, weighted)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                f = self.feature[t][node]
                inner = f >= 0
                goes = rows[every, np.maximum(f, 0)] <= self.threshold[t][node]
                node = np.where(inner, np.where(goes, self.left[t][node], self.right[t][node]), node)
            total += self.value[t][node]
        # The learner's margin is half the log odds.
        return 2 * total


def _arrays(model) -> Boosted:
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list = []

        def walk(node):
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, weight * node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        trees.append([np.array(c) for c in zip(*rows)])
    return Boosted(*([t[i] for t in trees] for i in range(5)))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes' own text is main text.

    A subtree is boilerplate as a whole, or its root is open: then its own text counts and each child is read for
    itself. What weighs is a node's log odds times its own text; nodes without text of their own weigh a little, so
    that an ancestor's verdict speaks for short texts below it.
    """
    weight = np.array([min(sum(len(t) for _, t, _ in node.blocks), 400) + 8.0 for node in nodes]) * np.clip(odds, -6, 6)
    best = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        # Closed costs the whole subtree's gain; open gains its own weight and what its children gain.
        gain = weight[i] + best[i]
        best[i] = max(0.0, gain)
        if nodes[i].parent >= 0:
            best[nodes[i].parent] += best[i]
    opened = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        opened[i] = best[i] > 0 and (node.parent < 0 or opened[node.parent])
    return opened


def main_text(page: str, model: Boosted) -> str:
    nodes = parse(page)
    return text_of(nodes, decode(nodes, model.log_odds(features([nodes]))))


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    return "\n".join(text for _, text in sorted((order, text) for i in np.flatnonzero(kept) for order, text, _ in nodes[i].blocks))


# --- pages whose places are known -----------------------------------------------------------------------------------

_PLACES = {
    "menu": [("nav", ""), ("div", "navbar"), ("ul", "menu"), ("div", "breadcrumbs"), ("div", "pagination"), ("div", "site-nav")],
    "head": [("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header")],
    "foot": [("footer", ""), ("div", "footer"), ("div", "page-footer"), ("footer", "site-footer")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "related-posts"), ("div", "widget"), ("aside", "sidebar")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored"), ("section", "promo"), ("div", "ad-banner")],
    "notice": [("div", "cookie-notice"), ("div", "consent"), ("div", "newsletter"), ("div", "notice"), ("section", "subscribe"), ("dialog", ""), ("div", "alert")],
    "comment": [("section", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "comment"), ("div", "discussion")],
    "social": [("div", "share"), ("div", "social-links")],
    "form": [("form", ""), ("form", "search-form"), ("div", "login")],
}
_MAINS = [("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("article", "post"), ("section", "article-body"), ("div", "story"), ("div", ""), ("section", "")]


def _layout(rng: random.Random, texts: list[str]) -> str:
    """A page laid out by rule from given texts; a node's mark (data-kept) says whether it is main text."""

    def piece(short=False):
        words = rng.choice(texts).split() or ["text"]
        size = rng.randint(1, 8) if short else rng.randint(6, 120)
        start = rng.randrange(len(words))
        text = entities.escape(" ".join(words[start : start + size]))
        return text if short or rng.random() < 0.3 else text.rstrip(".,") + "."

    def tag(name, inner, kept, classes=""):
        attrs = (f' class="{classes}"' if classes and rng.random() < 0.8 else f' id="{classes}"' if classes else "")
        return f'<{name}{attrs} data-kept="{int(kept)}">{inner}</{name}>'

    def links(k):
        return "".join(tag("li", f'<a href="/x">{piece(True)}</a>', False) for _ in range(k))

    def boilerplate(kind):
        name, classes = rng.choice(_PLACES[kind])
        if kind in ("menu", "social"):
            inner = links(rng.randint(2, 9)) if name == "ul" else tag("ul", links(rng.randint(2, 9)), False) if rng.random() < 0.8 else " ".join(f'<a href="/y">{piece(True)}</a>' for _ in range(4))
        elif kind == "comment":
            inner = "".join(tag("li" if name == "ol" else "div", tag("p", piece(), False) if rng.random() < 0.7 else piece(), False, rng.choice(["", "comment", "reply"])) for _ in range(rng.randint(1, 6)))
            inner = (tag("h3", "Comments", False) if rng.random() < 0.4 else "") + inner
        elif kind == "form":
            inner = tag("label", piece(True), False) + '<input name="q">' + tag("button", piece(True), False) + (tag("p", piece(True), False) if rng.random() < 0.3 else "")
        elif kind == "foot":
            inner = rng.choice([f"&copy; {piece(True)}", f"&copy; {piece(True)} &middot; {piece()}", tag("p", piece(), False) + tag("ul", links(3), False), tag("p", piece(True), False)])
        elif kind == "head":
            inner = rng.choice([tag("a", piece(True), False), tag("div", piece(True), False, "logo"), tag("nav", tag("ul", links(4), False), False), tag("p", piece(True), False)])
        else:
            inner = rng.choice([piece(), piece(True), tag("p", piece(), False), tag("h4", piece(True), False) + tag("ul", links(rng.randint(2, 6)), False), tag("p", piece(), False) + tag("p", piece(), False)])
        return tag(name, inner, False, classes)

    def block():
        k = rng.random()
        if k < 0.68:
            text = piece()
            if rng.random() < 0.25:
                text = f'{text} <a href="/in">{piece(True)}</a> {piece(True)}'
            return f'<p data-kept="1">{text}' + ("</p>" if rng.random() < 0.9 else "")
        if k < 0.78:
            return tag(rng.choice(["h2", "h3"]), piece(True), True)
        if k < 0.87:
            return tag(rng.choice(["ul", "ol"]), "".join(tag("li", piece(rng.random() < 0.5), True) for _ in range(rng.randint(2, 6))), True)
        if k < 0.92:
            return tag("blockquote", piece(), True)
        if k < 0.96:
            return tag("table", "".join(tag("tr", tag("td", piece(True), True) + tag("td", piece(True), True), True) for _ in range(3)), True)
        return tag("pre", piece(), True)

    kinds = list(_PLACES)
    body = [tag("h1", piece(True), True)] if rng.random() < 0.85 else []
    body += [block() for _ in range(rng.choice([1, 2, 3, 4, 6, 10, 25]))]
    if rng.random() < 0.2:
        body = [f'<p data-kept="1"><b>{piece()}<br>'] + body
    for kind in rng.sample(kinds, rng.choice([0, 0, 1, 1, 2])):
        body.insert(rng.randint(0, len(body)), boilerplate(kind))
    if rng.random() < 0.3:
        body.append(boilerplate("comment"))
    name, classes = rng.choice(_MAINS)
    main = tag(name, "".join(body), True, classes)
    before = [boilerplate(k) for k in ("head", "menu", "notice", "ad") if rng.random() < 0.6]
    after = [boilerplate(k) for k in ("side", "ad", "comment", "form", "social", "notice", "foot") if rng.random() < 0.5]
    rng.shuffle(before)
    inside = "".join([*before, main, *after])
    for _ in range(rng.choice([0, 0, 1, 2])):
        inside = tag("div", inside, True, rng.choice(["", "wrapper", "container", "page", "row"]))
    return f"<html><head><title>t</title></head><body data-kept=\"1\">{inside}</body></html>"


_KEPT = re.compile(r'data-kept="([01])"')


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of a page laid out here; wrappers and empty nodes teach nothing."""
    marks: list[int] = []
    plain = []
    # The mark is read off a class of its own, then taken away before features see it.
    nodes = parse(_KEPT.sub(lambda m: f'role="kept{"yes" if m[1] == "1" else "no"}"', page))
    for node in nodes:
        mark = 1 if "keptyes" in node.tokens else 0 if "keptno" in node.tokens else -1
        node.tokens = tuple(t for t in node.tokens if not t.startswith("kept"))
        marks.append(mark)
        plain.append(node)
    rows = features([plain])
    labels = np.array(marks)
    texts = np.expm1(rows[:, 0]) > 0
    # An open node stays open for what is kept below it, whatever else is there.
    return rows[(labels >= 0) & texts], labels[(labels >= 0) & texts]


def fit(spark: SparkSession, texts: list[str], seed: int = 10) -> Boosted:
    rng = random.Random(seed)
    pairs = [_labelled(_layout(rng, texts or ["some words of text"])) for _ in range(LAYOUTS)]
    rows = [(Vectors.dense(x.tolist()), float(y)) for xs, ys in pairs for x, y in zip(xs, ys)]
    table = spark.createDataFrame(rows, ["features", "label"]).coalesce(1).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, minInstancesPerNode=4, seed=seed).fit(table)
    table.unpersist()
    return _arrays(model)


def sample_texts(pages: DataFrame) -> list[str]:
    """At most 8 texts, of 2 000 characters at most, of each of SAMPLE_PAGES pages by hash of the id: filling for the layouts."""
    picked = pages.select("page_id").where("page_id IS NOT NULL").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).distinct()
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).join(F.broadcast(picked), "page_id", "left_semi")

    def texts(batches):
        for batch in bounded(batches, "html"):
            found = []
            for page in batch.column(1).to_pylist():
                blocks = sorted((b for node in parse(page or "") for b in node.blocks), key=lambda b: -len(b[1]))[:8]
                found.append([b[1][:2000] for b in blocks])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["page_id", "texts"])

    rows = chosen.mapInArrow(texts, "page_id long, texts array<string>").collect()
    return [t for r in sorted(rows, key=lambda r: (r.page_id, r.texts))[: 2 * SAMPLE_PAGES] for t in r.texts]


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every page.

    Null and empty html, and pages without main text, give the empty text; null ids and urls stay null; repeated
    rows are extracted each; an empty table gives an empty one. A page is read whole, however long.
    """
    spark = pages.sparkSession
    model = model or fit(spark, sample_texts(pages))
    shared = spark.sparkContext.broadcast(model)  # TREES trees of at most 2^DEPTH leaves
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def work(batches):
        for batch in bounded(batches, "html", 1 << 20):
            parsed = [parse(page or "") for page in batch.column(2).to_pylist()]
            odds = shared.value.log_odds(features(parsed))
            ends = np.cumsum([len(nodes) for nodes in parsed])
            out = [text_of(nodes, decode(nodes, odds[end - len(nodes) : end])) for nodes, end in zip(parsed, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    got = rows.mapInArrow(work, "page_id long, url string, text string")
    return got.withColumn("n_chars", F.char_length("text").cast("long"))
