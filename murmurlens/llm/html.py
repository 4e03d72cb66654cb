"""Main-text extraction with gradient-boosted trees over DOM nodes.

A page becomes a tree of elements with their own runs of text. Every element is described by its
place and content (depth, siblings, share of the page's text, link and tag density of its subtree)
and by what its tag, class, id and role say. Boosted regression trees give the log-odds that an
element belongs to the main text. Decoding goes from the root down: the best set of subtrees is
chosen by dynamic programming, where an element under a kept one stays unless it is cut out with
its whole subtree, so an answer for a descendant never contradicts the one for its ancestors. A page of
which nothing would be kept keeps the text that no tag, attribute or lot of links marks as boilerplate.

The trees are fitted on a bounded sample of pages (``sample``, by a hash of the page id) that have
an article element. Each sampled page is used as it is and in variants to which boilerplate of the
kinds in ``BOILERPLATE`` is added and whose article may be renamed, taken out of its element or put
in a table cell, so that no single tag or class is relied on. Extraction reads every page whole.

Text rules: scripts, styles, comments, the document head and elements of ``NO_TEXT`` give none (of
these the inner elements don't count either, and they end with their parent); character references are
decoded; white space inside a block becomes one space; blocks are joined in page order by an empty
line. A line break element counts as white space.

Defined results: a null or empty page and one without any main text give an empty string; text
outside any element belongs to the page's root; a tag that is never closed by ``>`` ends the page; unclosed and stray tags are tolerated; repeated
rows give repeated rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlens.llm.common import column, slices, thinned

# Names of HTML elements and words of their attributes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
NO_TEXT = frozenset("noscript template svg iframe object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture progress q rb rp rt rtc "
    "ruby s samp slot small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "p": frozenset("p address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
SCOPES = frozenset("ul ol dl table".split())
TAG_GROUPS = {
    "content": "article main".split(),
    "boiler": "nav header footer aside form button menu dialog fieldset".split(),
    "text": "p blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split(),
    "list": "ul ol li dl dt dd".split(),
    "table": "table tr td th tbody thead".split(),
    "box": "div section body html center".split(),
    "link": ["a"],
}
WORD_GROUPS = {
    "content": "article articlebody body content entry hentry main post postbody prose story text".split(),
    "menu": "breadcrumb breadcrumbs menu menubar nav navbar navigation navigations pager pagination tabs toc toolbar topbar".split(),
    "side": "aside banner complementary footer header masthead rail sidebar widget".split(),
    "advert": "ad ads advert advertisement adverts promo promoted promotion sponsor sponsored".split(),
    "notice": "alert consent cookie cookies gdpr message modal newsletter notice notification overlay popup privacy signup subscribe subscription".split(),
    "talk": "comment comments commentlist discussion disqus reply replies respond responses".split(),
    "share": "contentinfo legal copyright login meta more popular recommended related search share sharing social tags trending".split(),
}
BOILERPLATE = [
    ("nav", ""), ("div", 'class="menu"'), ("ul", 'class="navigation"'), ("div", 'id="navbar" role="navigation"'), ("header", ""),
    ("div", 'class="header"'), ("div", 'id="masthead"'), ("footer", ""), ("div", 'class="footer"'), ("aside", ""), ("div", 'class="sidebar"'),
    ("div", 'id="rail-widget"'), ("div", 'class="ad"'), ("div", 'class="advert banner"'), ("section", 'class="promo"'), ("div", 'class="sponsored"'),
    ("div", 'class="cookie-notice"'), ("div", 'id="consent" role="dialog"'), ("div", 'class="newsletter signup"'), ("form", ""), ("form", 'class="search"'),
    ("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="commentlist"'), ("div", 'class="comment"'), ("div", 'class="related"'),
    ("section", 'class="share social"'), ("div", 'class="breadcrumb"'), ("aside", 'class="popular"'), ("div", 'class="alert notice"'),
]
ARTICLES = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main"'), ("section", 'class="post"'), ("div", 'class="entry-content"'), ("div", 'class="article-body"'), ("div", "")]

SAMPLE, VARIANTS, BARE = 120, 3, 4
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.2, 32, 8
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
# A quote opens a value only behind an equals sign; one that is never closed is a plain character.
ATTRIBUTES = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VALUE_END = re.compile(r"=\s*[^\s\"']*/$")  # the slash belongs to a value without quotes
MARK = "data-is-main-text="
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
TAG_OF = {tag: i for i, tags in enumerate(TAG_GROUPS.values()) for tag in tags}
WORD_OF = {word: i for i, words in enumerate(WORD_GROUPS.values()) for word in words}
FEATURES = 22 + 2 * len(TAG_GROUPS) + 2 * len(WORD_GROUPS)


def tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, "/" of a closing tag, tag, attributes)`` of tags, and of comments and declarations
    with an empty tag. ``send`` a place to go on from there. Every character is read a bounded number of
    times: what is never closed is looked for once, and ends the page."""
    place, last = 0, html.rfind(">")
    while True:
        start = html.find("<", place)
        if start < 0 or start > last:
            return
        name = NAME.match(html, start + 1)
        if name:
            found = ATTRIBUTES.match(html, name.end())
            if not found:
                yield start, len(html), "", "", ""
                return
            token = start, found.end(), name[1], name[2].lower(), found[1]
        elif html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            token = start, end + 3 if end >= 0 else len(html), "", "", ""
        elif html.startswith(("<!", "<?", "</"), start):
            token = start, html.index(">", start) + 1, "", "", ""
        else:
            place = start + 1
            continue
        moved = yield token
        place = token[1] if moved is None else moved


class Page:
    """Elements in document order: tag, parent, attribute words, and runs of text with their owner."""

    def __init__(self, html: str):
        self.tags, self.parents, self.words, self.hidden, self.marks = ["#root"], [-1], [0], [False], [""]
        self.runs: list[tuple[int, str]] = []
        self._read(html)

    def _text(self, owner: int, raw: str) -> None:
        if raw and not raw.isspace():
            self.runs.append((owner, entities.unescape(raw)))
        elif raw:
            self.runs.append((owner, " "))

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        bits, hidden = 0, False
        for match in ATTRIBUTE.finditer(attributes):
            value = (match[2] or match[3] or match[4] or "").lower()
            name = match[1].lower()
            if name in ("class", "id", "role"):
                for word in WORD.findall(value):
                    if word in WORD_OF:
                        bits |= 1 << WORD_OF[word]
            else:
                hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(HIDDEN.search(value))
        self.tags.append(tag)
        self.parents.append(parent)
        self.words.append(bits)
        self.hidden.append(hidden)
        self.marks.append(attributes[attributes.index(MARK) + len(MARK)] if MARK in attributes else "")
        return len(self.tags) - 1

    def _read(self, html: str) -> None:
        stack, place = [0], 0
        self.open: dict[str, int] = {}  # open elements by tag
        self.closers: list[int] = []  # places in the stack of those that another tag may close
        silent = depth = 0  # the outermost open element of NO_TEXT, and its place in the stack
        found, moved = tokens(html), None
        while True:
            try:
                token = found.send(moved)
            except StopIteration:
                token = None
            if silent and (not token or len(stack) <= depth or stack[depth] != silent):
                for values in (self.tags, self.parents, self.words, self.hidden, self.marks):
                    del values[silent + 1 :]
            if silent and (len(stack) <= depth or stack[depth] != silent):
                silent = 0
            if not silent:
                self._text(stack[-1], html[place : token[0] if token else len(html)])
            if not token:
                return
            _, place, closing, tag, attributes = token
            moved = place
            if not tag:
                continue
            if closing:
                self._close(stack, tag)
                continue
            while self.closers:
                inner = self.tags[stack[self.closers[-1]]]
                if tag not in CLOSED_BY[inner] or not self._close(stack, inner, tag):
                    break
            node = self._open(tag, attributes, stack[-1])
            closed = attributes.endswith("/") and not VALUE_END.search(attributes[-200:])
            if tag == "br" and not silent:
                self.runs.append((stack[-1], " "))
            if tag in RAW and not (silent and closed):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, place)
                place = moved = end.end() if end else len(html)
            elif tag not in VOID and not closed:
                if tag in NO_TEXT and not silent:
                    silent, depth = node, len(stack)
                if tag in CLOSED_BY:
                    self.closers.append(len(stack))
                self.open[tag] = self.open.get(tag, 0) + 1
                stack.append(node)

    def _close(self, stack: list[int], tag: str, because: str = "") -> bool:
        """Leave the innermost open ``tag``. An opening tag closes nothing beyond a list or table
        that lies in between; a closing tag without a partner is ignored."""
        if not self.open.get(tag):
            return False
        for i in range(len(stack) - 1, 0, -1):
            here = self.tags[stack[i]]
            if here == tag:
                for left in stack[i:]:
                    self.open[self.tags[left]] -= 1
                del stack[i:]
                while self.closers and self.closers[-1] >= i:
                    self.closers.pop()
                return True
            if because and (here in SCOPES or here not in INLINE):
                return False
        return False


def describe(page: Page) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Feature rows of all elements, their children, and the characters of their own text."""
    n, parent_of = len(page.tags), page.parents
    words, stops, runs, own = [0] * n, [0] * n, [0] * n, [0] * n
    for owner, text in page.runs:
        size = len(text.strip())
        if size:
            own[owner] += size
            words[owner] += text.count(" ") + 1
            stops[owner] += text.count(". ") + text.count(", ") + (text.rstrip()[-1:] in ".!?")
            runs[owner] += 1
    children: list[list[int]] = [[] for _ in range(n)]
    depths, sizes, marks = [0] * n, [1] * n, [0] * n
    groups = [TAG_OF.get(tag, -1) for tag in page.tags]
    for i in range(1, n):
        p = parent_of[i]
        children[p].append(i)
        depths[i] = depths[p] + 1
        marks[i] = marks[p] | page.words[i] << 8 | (1 << groups[i] if groups[i] >= 0 else 0)
    for i in range(n - 1, 0, -1):
        sizes[parent_of[i]] += sizes[i]
    parents, depth, own = np.array(parent_of), np.array(depths, float), np.array(own, float)
    first = np.arange(n)
    last, tags = first + sizes, np.array(sizes, float)
    group = np.array(groups)

    def below(values) -> np.ndarray:
        """Sums over subtrees, which are runs of elements in document order."""
        summed = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        return summed[last] - summed[first]

    total, all_words, all_stops, all_runs = below(own), below(words), below(stops), below(runs)
    is_link = group == TAG_OF["a"]
    links = below(np.where(is_link, total, 0.0))
    anchors, blocks, items = below(is_link), below(group == TAG_OF["p"]), below([tag == "li" for tag in page.tags])
    whole = max(total[0], 1.0)
    place, siblings, like = [0.0] * n, [1] * n, [0] * n
    for kids in children:
        if kids:
            many, counts = len(kids), {}
            for k in kids:
                counts[page.tags[k]] = counts.get(page.tags[k], 0) + 1
            for j, k in enumerate(kids):
                place[k], siblings[k], like[k] = j / max(1, many - 1), many, counts[page.tags[k]]
    up = np.maximum(parents, 0)
    bits = np.array(page.words)[:, None] >> np.arange(len(WORD_GROUPS)) & 1
    tag_marks = (group[:, None] == np.arange(len(TAG_GROUPS))).astype(float)
    above = np.array(marks)[:, None]
    above_tags, above_words = above >> np.arange(len(TAG_GROUPS)) & 1, above >> np.arange(8, 8 + len(WORD_GROUPS)) & 1
    word_marks = bits
    density = total / tags
    columns = [
        depth, place, siblings, like, np.log1p(own), np.log1p(total), total / whole, links / np.maximum(total, 1), np.log1p(tags),
        density, density[up], total / np.maximum(total[up], 1), all_words / np.maximum(all_runs, 1), all_stops / np.maximum(all_words, 1),
        anchors / np.maximum(all_words, 1), np.log1p(blocks), blocks[up] / np.maximum(tags[up], 1), items / tags,
        total / np.maximum(all_words, 1), np.log1p(total[up]), links[up] / np.maximum(total[up], 1), np.array(page.hidden, float),
    ]
    return np.column_stack([*columns, tag_marks, word_marks, above_tags, above_words]), children, own


class Trees:
    """Gradient-boosted regression trees on binned features with logistic loss."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate, self.start, self.grown = trees, depth, rate, 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            nodes = self._grow(binned, edges, weight * (y - p), weight * p * (1 - p) + 1e-9)
            self.grown.append(nodes)
            raw += self._walk(nodes, x)
        return self

    def _grow(self, binned, edges, gradient, curvature):
        """A tree as rows (feature, threshold, left, right, value); leaves have feature -1."""
        nodes, waiting = [], [(np.arange(len(gradient)), 0)]
        while waiting:
            rows, level = waiting.pop(0)
            g, h = gradient[rows].sum(), curvature[rows].sum()
            nodes.append([-1, 0.0, 0, 0, self.rate * g / (h + 1)])
            best = (1e-3, None, None)
            for f in range(binned.shape[1]) if level < self.depth and len(rows) >= 2 * LEAST else ():
                if not len(edges[f]):
                    continue
                bins = binned[rows, f]
                size = len(edges[f]) + 1
                left_g, left_h = np.cumsum(np.bincount(bins, gradient[rows], size))[:-1], np.cumsum(np.bincount(bins, curvature[rows], size))[:-1]
                count = np.cumsum(np.bincount(bins, minlength=size))[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g * g / (h + 1)
                gain[(count < LEAST) | (len(rows) - count < LEAST)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] is not None:
                _, f, k = best
                left = binned[rows, f] <= k
                at = len(nodes) + len(waiting)
                nodes[-1][:4] = [f, float(edges[f][k]), at, at + 1]
                waiting += [(rows[left], level + 1), (rows[~left], level + 1)]
        return tuple(np.array(column) for column in zip(*nodes))

    def _walk(self, nodes, x):
        feature, threshold, left, right, value = nodes
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._walk(nodes, x) for nodes in self.grown), np.zeros(len(x)))

    def numbers(self) -> tuple:
        return self.depth, self.start, self.grown


def raw_scores(model: tuple, x: np.ndarray) -> np.ndarray:
    trees = Trees(depth=model[0])
    trees.start, trees.grown = model[1], model[2]
    return trees.raw(x)


NEVER = 1e6


def decode_tree(score: np.ndarray, own: np.ndarray, children: list[list[int]]) -> np.ndarray:
    """Which elements are main text: the assignment with the largest sum of ``score`` (log-odds,
    weighted by own text) in which main text forms whole subtrees with whole subtrees cut out: on
    every path the answer changes from no to yes and from yes to no at most once."""
    n = len(score)
    value = score * np.log1p(own) + 0.05 * score
    outside, inside = np.zeros(n), np.zeros(n)  # best sum below when the element is not (yet) in, or is in
    for i in range(n - 1, -1, -1):
        inside[i] = value[i] + sum(max(inside[k], 0.0) for k in children[i])
        outside[i] = sum(max(inside[k], outside[k]) for k in children[i])
    kept, waiting = np.zeros(n, bool), [(0, bool(inside[0] > outside[0]))]
    while waiting:
        i, yes = waiting.pop()
        kept[i] = yes
        for k in children[i]:
            if yes and inside[k] > 0:
                waiting.append((k, True))
            elif not yes:
                waiting.append((k, bool(inside[k] > outside[k])))
    return kept


BOILER_TAGS = frozenset(TAG_GROUPS["boiler"] + ["label", "option", "figcaption"])
BOILER_WORDS = sum(1 << i for i, name in enumerate(WORD_GROUPS) if name != "content")


def unmarked(page: Page, own: np.ndarray) -> np.ndarray:
    """Elements that nothing on their path calls boilerplate: no such tag, attribute word or hidden
    element, and no block that is mostly links."""
    n = len(page.tags)
    text, links = own.copy(), np.where(np.array(page.tags) == "a", own, 0.0)
    for i in range(n - 1, 0, -1):
        text[page.parents[i]] += text[i]
        links[page.parents[i]] += text[i] if page.tags[i] == "a" else links[i]
    kept = np.ones(n, bool)
    for i in range(1, n):
        named = page.tags[i] in BOILER_TAGS or page.words[i] & BOILER_WORDS or page.hidden[i]
        listed = page.tags[i] not in INLINE and text[i] > 0 and links[i] > 0.5 * text[i]
        kept[i] = kept[page.parents[i]] and not named and not listed
    return kept


def menu_cells(page: Page, children: list[list[int]], own: np.ndarray) -> list[int]:
    """Cells of layout tables that hold links alone, next to a cell with paragraphs or headings, and all
    that is in them."""
    n = len(page.tags)
    if "td" not in page.tags:
        return []
    text, links, blocks = own.copy(), np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        links[p] += text[i] if page.tags[i] == "a" else links[i]
        text[p] += text[i]
        blocks[p] |= blocks[i] or page.tags[i] in ("p", "h1", "h2", "article")
    inside = np.zeros(n, bool)
    for i in range(1, n):
        alone = page.tags[i] == "td" and text[i] > 0 and links[i] == text[i]
        inside[i] = inside[page.parents[i]] or alone and any(blocks[k] for k in children[page.parents[i]] if k != i)
    return np.flatnonzero(inside).tolist()


def main_text(page: Page, kept: np.ndarray) -> str:
    """The kept text, block by block."""
    blocks, current, last = [], [], -1
    block_of = [0] * len(page.tags)
    for i in range(1, len(page.tags)):
        block_of[i] = block_of[page.parents[i]] if page.tags[i] in INLINE else i
    for owner, text in page.runs:
        if not kept[owner]:
            continue
        if block_of[owner] != last and current:
            blocks.append("".join(current))
            current = []
        last = block_of[owner]
        current.append(text)
    if current:
        blocks.append("".join(current))
    return "\n\n".join(block for block in (SPACES.sub(" ", block).strip() for block in blocks) if block)


SIMPLE = re.compile(r"<p>([^<{}]*)</p>")
OPENING = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)")
SHAPES = ["<ul><li>{0}</li><li>{0}</li><li>{0}</li></ul>", "<blockquote>{0}</blockquote>", "<h2>{0}</h2>", "<div>{0}</div>", "<pre>{0}</pre>", "<table><tr><td>{0}</td><td>{0}</td></tr></table>", "<figure><img src=x><figcaption>{0}</figcaption></figure>", "<ol><li><p>{0}</p></li></ol>"]
ARTICLE = re.compile(r"<article\b([^>]*)>(.*)</article\s*>", re.S | re.I)
BODY = re.compile(r"<body\b[^>]*>", re.I)
SKELETON = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A title of a page</h1>" + "<p>Some words of a story, told in a few sentences. They go on.</p>" * 6 + "</article><footer>All rights</footer></body></html>"


def _phrases(html: str) -> list[str]:
    return [text for text in (SPACES.sub(" ", x).strip() for x in re.split(r"<[^>]*>", html)) if len(text) > 3]


def _boilerplate(phrases: list[str], random: np.random.Generator) -> str:
    tag, attributes = BOILERPLATE[random.integers(len(BOILERPLATE))]

    def words(low, high):
        found = phrases[random.integers(len(phrases))].split(" ")
        return " ".join(found[: random.integers(low, high + 1)])

    kind, n = random.integers(5), int(random.integers(1, 7))
    inner = {
        0: "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(n)),
        1: words(3, 40),
        2: "".join(f"<p>{words(5, 60)}</p>" for _ in range(n)),
        3: f"<h3>{words(1, 6)}</h3>" + "".join(f"<div>{words(2, 30)} <a href='#'>{words(1, 3)}</a></div>" for _ in range(n)),
        4: f"<label>{words(1, 4)}</label><input type='text'><button>{words(1, 2)}</button><p>{words(4, 25)}</p>",
    }[int(kind)]
    inner = f"<ul>{inner}</ul>" if kind == 0 and tag not in ("ul", "ol") else inner
    return f'<{tag} {attributes} {MARK}0>{inner}</{tag}>'


def _links(phrases: list[str], random: np.random.Generator) -> str:
    """A bare row of links, as in the cell of a layout table."""
    names = [phrases[random.integers(len(phrases))].split(" ")[: random.integers(1, 4)] for _ in range(random.integers(1, 8))]
    return [" ", " | ", "<br>"][random.integers(3)].join(f'<a href="/{i}">{" ".join(name)}</a>' for i, name in enumerate(names))


def variants(html: str, random: np.random.Generator, many: int = VARIANTS) -> list[str]:
    """The page with its article marked, and ``many`` versions with boilerplate added around and
    inside the article; in half of them the article gets another tag and class. Then ``BARE`` more: the
    article's blocks among those of the page, the blocks as the whole page, and a layout by a table."""
    found = ARTICLE.search(html)
    if not found:
        return []
    phrases = _phrases(found[2]) or ["a few words"]
    out = [html[: found.start()] + f"<article {found[1]} {MARK}1>{found[2]}</article>" + html[found.end() :]]
    for turn in range(many + BARE):
        # Blocks among those of the page, blocks as the whole page with and without a body, or in a table.
        bare = turn - many
        tag, attributes = ARTICLES[random.integers(len(ARTICLES))] if random.random() < 0.5 else ("article", found[1])
        inner = OPENING.sub(rf"<\1 {MARK}1", found[2]) if bare in (0, 1, 2) else found[2]
        cuts = [m.end() for m in re.finditer(r"</(?:p|h1|h2|ul|blockquote)>", inner)]
        for _ in range(random.integers(0, 3) if bare not in (1, 2) or random.random() < 0.3 else 0):
            at = cuts[random.integers(len(cuts))] if cuts and random.random() < 0.5 else len(inner)
            inner = inner[:at] + _boilerplate(phrases, random) + inner[at:]
            cuts = [c for c in cuts if c <= at]
        around = ["".join(_boilerplate(phrases, random) for _ in range(random.integers(0, 4))) for _ in range(2)]
        if bare not in (0, 1, 2):
            inner = SIMPLE.sub(lambda m: m[0] if random.random() < 0.8 else SHAPES[random.integers(len(SHAPES))].format(m[1]), inner)
        whole = f"<{tag} {attributes} {MARK}1>{inner}</{tag}>"
        if bare in (0, 1, 2):
            whole = inner
        elif bare == 3:
            side = [f"<td {MARK}0>{_links(phrases, random) if random.random() < 0.5 else _boilerplate(phrases, random)}</td>" for _ in range(2)]
            whole = f"<table><tr>{side[0]}<td {MARK}1>{inner}</td>{side[1] if random.random() < 0.5 else ''}</tr></table>"
        page = html[: found.start()] + around[0] + whole + around[1] + html[found.end() :]
        if bare in (1, 2) or bare == 3 and random.random() < 0.5:
            page = whole if bare == 2 else f"<html><body>{whole}</body></html>"
        start = BODY.search(page)
        if start and random.random() < 0.3:
            page = page[: start.end()] + '<div class="wrapper">' + page[start.end() :]
        out.append(page)
    return out


def fit(pages: list[str], seed: int = 5) -> tuple:
    """The trees' numbers, from pages with an article element (others give nothing to learn)."""
    random = np.random.default_rng(seed)
    marked = [v for page in pages for v in variants(page, random)]
    if not marked:
        marked = [v for _ in range(40) for v in variants(SKELETON, random)]
    rows, labels, weights = [], [], []
    for html in marked:
        page = Page(html)
        x, _, own = describe(page)
        label = np.zeros(len(own))
        for i in range(1, len(own)):
            label[i] = float(page.marks[i]) if page.marks[i] in ("0", "1") else label[page.parents[i]]
        rows.append(x)
        labels.append(label)
        weights.append(0.2 + np.log1p(own))
    return Trees().fit(np.concatenate(rows), np.concatenate(labels), np.concatenate(weights)).numbers()


def train(pages: DataFrame, sample: int = SAMPLE) -> tuple:
    """Fit on at most ``sample`` of the pages with an article element."""
    known = pages.filter(F.col("html").rlike(r"(?i)<article\b") & F.col("html").rlike(r"(?i)</article\s*>"))
    known = known.select("html", F.xxhash64(F.col("page_id").cast("string")).alias("by"))
    some = thinned(known, "by", sample, known.count())
    rows = some.orderBy(F.pmod("by", F.lit(1 << 40)), "html").limit(sample).collect()
    return fit([row[0] for row in rows])


def extract_texts(model: tuple, htmls: list[str]) -> list[str]:
    pages = [Page(html) for html in htmls]
    found = [describe(page) for page in pages]
    scores = raw_scores(model, np.concatenate([x for x, _, _ in found]))
    cuts = np.cumsum([0] + [len(x) for x, _, _ in found])
    out = []
    for page, (_, children, own), a, b in zip(pages, found, cuts, cuts[1:]):
        score = scores[a:b]
        score[menu_cells(page, children, own)] = -NEVER
        text = main_text(page, decode_tree(score, own, children))
        # Where the trees see no main text at all, as on pages unlike all they know, text without any mark stays.
        out.append(text or main_text(page, unmarked(page, own)))
    return out


def extract(pages: DataFrame, model: tuple) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", most=1 << 20):
            texts = extract_texts(shared.value, column(batch, "html").to_pylist())
            sizes = pa.array([len(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    known = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return known.mapInArrow(run, "page_id long, url string, text string, n_chars long")
