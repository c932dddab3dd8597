"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into text blocks at block-level tags. A block's features are its
word count and link density, those of its neighbours, and what encloses it. The
tree is trained here, on the blocks of ``LABELLED_PAGES``, when the job starts.
Word counts alone can't tell an advert from a short paragraph, nor a reader's
comment from a long one; that is what the marks of enclosing elements are for.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.common import small_batches, text_of

# Elements whose content is never text, elements that end a block, and the marks of enclosing boilerplate.
DROPPED = "script style noscript template iframe svg canvas object head title select option textarea audio video".split()
INLINE = "a abbr acronym b bdi bdo big button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover mstyle mspace semantics annotation".split()
BOILER_TAGS = "nav header footer aside form menu dialog".split()
BOILER_WORDS = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comments-list consent cookie cookies copyright disclaimer disqus footer header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget"
).split()
# First parts of class names that tell the state of a page, not what an element is.
STATES = "has no not is with without show hide can js".split()
BOILER_ROLES = "navigation banner contentinfo complementary search alert dialog form menu menubar".split()
CONTENT_TAGS = "article main".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACES = re.compile(r"\s+")
_BOILER_WORDS = frozenset(BOILER_WORDS)
_DROPPED, _INLINE, _BOILER_TAGS, _CONTENT, _HEADINGS, _VOID = map(frozenset, (DROPPED, INLINE, BOILER_TAGS, CONTENT_TAGS, HEADINGS, VOID))

FEATURES = ("words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "boiler", "content", "heading", "listed", "page_has_content")


def _words(sign: str, n: int) -> str:
    return sign + " ".join(["word"] * n)


def _main(tag: str, *sizes: int) -> str:
    """Blocks of main text of so many words."""
    return "".join(f"<{tag}>{_words('+', n)}</{tag}>" for n in sizes)


def _other(tag: str, *sizes: int) -> str:
    """Blocks of anything else, without links."""
    return "".join(f"<{tag}>{_words('-', n)}</{tag}>" for n in sizes)


def _links(tag: str, *sizes: int) -> str:
    """Blocks of anything else that are links."""
    return "".join(f"<{tag}><a href=x>{_words('-', n)}</a></{tag}>" for n in sizes)


def _mixed(tag: str, sign: str, plain: int, linked: int) -> str:
    return f"<{tag}>{_words(sign, plain)} <a href=x>{_words('', linked)}</a></{tag}>"


#: The labelled table: pages of the usual kinds, each block marked by its first character, + for main text and - for the rest.
#: What counts are the features of the blocks, so all words are the same.
LABELLED_PAGES = [
    # a news article: menu, advert, article with short and long paragraphs, footer
    "<nav><ul>" + _links("li", 1, 1, 2, 1, 1) + "</ul></nav><div class=ad>" + _words("-", 7) + "</div><article>" + _main("h1", 9) + _main("p", 48, 3, 80, 1, 22) + "</article><footer>" + _words("-", 11) + "</footer>",
    "<header>" + _other("p", 3) + "</header><nav>" + _links("p", 1, 1, 1) + "</nav><article>" + _main("h1", 5) + _main("p", 1, 2, 140) + "</article><div class=banner>" + _other("p", 26) + "</div><footer>" + _links("p", 2, 2) + _other("p", 4) + "</footer>",
    # an article with a byline, a share bar, a list, a quotation, links at its end and readers' comments
    "<nav>" + _links("div", 1, 2, 1) + "</nav><article><header>" + _other("p", 4) + "</header>" + _main("h1", 7) + "<div class=share>" + _links("span", 1, 1) + "</div>" + _main("p", 60, 35) + "<ul>" + _main("li", 4, 9, 2, 6) + "</ul>" + _main("blockquote", 25) + _mixed("p", "+", 40, 4) + _main("h2", 3) + _main("p", 70)
    + "<ul>" + _links("li", 5, 6, 4) + "</ul></article><div class=comments>" + _other("h3", 2) + _other("p", 30, 12, 55) + "</div><footer>" + _other("p", 9) + "</footer>",
    # a page in a main element, with notice, sidebar, form and footer
    "<div class=cookie-notice>" + _other("p", 22) + "</div><header>" + _links("div", 2) + "</header><main>" + _main("h1", 4) + _main("p", 33, 90, 12) + _main("h2", 2) + _main("p", 6, 58) + "</main><aside>" + _other("h4", 2) + _other("p", 28) + _links("p", 3, 5) + "</aside><form>" + _other("p", 5, 1) + "</form><footer>" + _mixed("p", "-", 5, 2) + "</footer>",
    # documentation: bread crumbs, headings with little under them, lists, table, pages before and after
    "<div class=breadcrumb>" + _links("span", 1, 1, 2) + "</div><main>" + _main("h1", 2) + _main("p", 15) + _main("h2", 3) + "<ul>" + _main("li", 3, 5, 8, 1) + "</ul>" + _main("h2", 1) + _main("p", 21, 7) + "<table><tr>" + _main("td", 1, 2, 1) + "</tr></table>" + _mixed("p", "+", 12, 3) + "</main><div class=pagination>" + _links("p", 1, 2) + "</div><footer>" + _other("p", 6) + "</footer>",
    # a short note, and one whose article holds a single word
    "<nav>" + _links("p", 1, 1) + "</nav><article>" + _main("p", 14) + "</article><div class=newsletter>" + _other("p", 16, 3) + "</div>",
    "<div class=ad>" + _other("p", 12) + "</div><article>" + _main("h1", 1) + _main("p", 1) + "</article><footer>" + _other("p", 2) + "</footer>",
    # articles with nothing after them, or only links
    "<nav>" + _links("li", 2, 1) + "</nav><article>" + _main("h1", 6) + _main("p", 30, 2, 100, 66, 5) + "</article>",
    "<article>" + _main("h1", 3) + _main("p", 12, 90, 1) + "</article>" + _links("p", 2, 1, 3),
    "<header>" + _other("p", 5, 2) + "</header><main>" + _main("p", 4, 15, 200, 64, 1) + "</main>",
    "<div class=ad>" + _other("p", 8) + "</div><article>" + _main("h2", 4) + _main("p", 17, 65, 20) + _mixed("p", "+", 30, 9) + _main("p", 2) + "</article><footer>" + _links("p", 1, 1, 1) + "</footer>",
    *["<nav>" + _links("p", 1, 2) + "</nav><article>" + _main("h1", n) + _main("p", 40 - n, n, 2 * n) + "</article>" for n in (2, 6, 12, 30)],
    *["<nav>" + _links("p", 2) + "</nav><article>" + _main("p", n) + "</article><footer>" + _links("p", 1, 2) + "</footer>" for n in (1, 14, 45)],
    *[_links("p", 2, 2) + _main("h1", 5) + _main("p", 50, 70) + _other("p", n) for n in (3, 6, 9)],
    # without marks: a menu of links, heading, paragraphs, links, a line of copyright
    "<div>" + _links("p", 1, 2, 1, 1) + "</div>" + _main("h1", 6) + _main("p", 45, 80, 7, 62, 110) + _main("h2", 4) + _main("p", 38, 51) + "<div>" + _links("p", 3, 4, 2) + "</div>" + _other("p", 5),
    # without marks, in a table: links in one cell, text in the next
    "<table><tr><td>" + _links("p", 2, 2, 1) + "</td><td>" + _main("p", 30, 66) + _mixed("p", "+", 44, 5) + "</td></tr></table>" + _links("p", 2, 1) + _mixed("p", "-", 2, 3),
    # without marks: text with some links in it, teasers between links
    _links("p", 1, 1, 3) + _other("p", 2) + _links("p", 4) + _main("h1", 9) + _main("p", 72) + _mixed("p", "+", 50, 6) + _mixed("p", "+", 35, 4) + _main("p", 27) + _other("h3", 2) + _links("p", 7, 9, 6) + _mixed("p", "-", 6, 5) + _links("p", 1, 1),
    # without marks: paragraphs of middle length, one after the other
    "<div>" + _links("p", 1, 1, 1) + "</div>" + _main("h1", 5) + _main("p", 25, 18, 31, 22, 40, 16, 29, 24) + _links("p", 2, 3) + _other("p", 6),
    _other("p", 4) + _links("p", 1, 2) + _main("h2", 6) + _main("p", 28, 35, 19, 12, 33) + _mixed("p", "+", 24, 2) + _main("p", 21) + _links("p", 4, 3, 5) + _other("p", 8),
    # without marks: nothing but lists of links
    "<ul>" + _links("li", 1, 2, 4, 6, 3, 8) + "</ul>" + _other("h2", 1) + "<ul>" + _links("li", 5, 7, 6) + "</ul>" + _mixed("p", "-", 4, 4) + _other("h2", 2) + _links("p", 9, 30),
    # without marks: the text runs to the page's end, after a menu, a teaser or nothing
    _links("p", 1, 2, 1) + _main("h1", 5) + _main("p", 45, 70, 60),
    "<div>" + _links("p", 2, 1) + _other("p", 3) + "</div>" + _main("h1", 7) + _main("p", 33, 58, 90, 41),
    _main("h1", 4) + _main("p", 66, 25, 52),
    _links("li", 1, 1, 1, 1) + _main("p", 75, 62),
    _links("p", 1, 2) + _main("h2", 3) + _main("p", 27, 49) + _mixed("p", "+", 48, 3),
    _links("p", 3) + _main("h1", 6) + _main("p", 58, 36) + _other("p", 4),
    # text beside the article that no mark tells of
    "<article>" + _main("h1", 8) + _main("p", 20, 64) + "</article><div>" + _other("p", 3, 18) + _links("p", 4, 5) + "</div><div>" + _other("p", 45) + "</div>",
    # a long advert, a form and comments without an article
    "<div class=advert>" + _other("p", 60) + "</div>" + _main("h1", 5) + _main("p", 85, 40, 95) + "<form>" + _other("label", 3) + _other("p", 14) + "</form><div id=comments>" + _other("p", 70, 24) + "</div><div class=related>" + _links("p", 6, 7) + "</div>",
]


def fit_tree(table: list[list[float]], depth: int = 8, least: int = 2) -> list[tuple[int, float, int, int, int]]:
    """CART by Gini impurity, leaves of ``least`` rows or more. Nodes are (feature or -1, threshold, left, right, class); ties go to the lower feature and threshold."""
    data = np.asarray(table, dtype=float)
    nodes: list[tuple[int, float, int, int, int]] = []

    def gini(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p) * len(y)

    def grow(rows: np.ndarray, level: int) -> int:
        me, y = len(nodes), rows[:, -1]
        nodes.append((-1, 0.0, 0, 0, int(y.mean() >= 0.5)))
        if level == depth or y.min() == y.max():
            return me
        best = (gini(y) - 1e-9, -1, 0.0)
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] <= cut
                if min(left.sum(), len(left) - left.sum()) < least:
                    continue
                if (cost := gini(y[left]) + gini(y[~left])) < best[0] - 1e-12:
                    best = (cost, f, float(cut))
        if best[1] < 0:
            return me
        left = rows[:, best[1]] <= best[2]
        a, b = grow(rows[left], level + 1), grow(rows[~left], level + 1)
        nodes[me] = (best[1], best[2], a, b, nodes[me][4])
        return me

    grow(data, 0)
    return nodes


def classify(nodes: list[tuple[int, float, int, int, int]], rows: list[list[float]]) -> list[bool]:
    out = []
    for row in rows:
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][2] if row[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
        out.append(bool(nodes[at][4]))
    return out


def _marked(word: str, whole: bool) -> bool:
    """Whether a class or id marks boilerplate, as it is or, if not ``whole``, by one of its parts."""
    if word in _BOILER_WORDS:
        return True
    parts = re.split(r"[-_]+", word)
    return not whole and parts[0] not in STATES and any(p in _BOILER_WORDS for p in parts)


def _boiler(tag: str, attributes: str) -> bool:
    """Whether an element itself is marked as boilerplate."""
    if tag in _BOILER_TAGS:
        return True
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            # the page as a whole is no boilerplate; an article is only if its class says so in one word
            if tag not in ("html", "body") and any(_marked(word, tag in _CONTENT) for word in value.split()):
                return True
        elif name == "role" and value in BOILER_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def blocks_of(source: str) -> tuple[list[str], list[list[float]]]:
    """Texts and features of the page's blocks, in page order. Unclosed and stray tags are taken as browsers do, roughly."""
    texts: list[str] = []
    marks: list[tuple[int, int, int, int, int, int]] = []  # words, linked words, boiler, content, heading, listed
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool]] = []
    depth = {"boiler": 0, "content": 0, "heading": 0, "listed": 0, "a": 0}
    seen_content = False

    def flush() -> None:
        if parts:
            text = SPACES.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                n = text.count(" ") + 1
                links = min(n, len(html_lib.unescape("".join(linked)).split())) if linked else 0
                texts.append(text)
                marks.append((n, links, int(depth["boiler"] > 0), int(depth["content"] > 0), int(depth["heading"] > 0), int(depth["listed"] > 0)))
            parts.clear()
            linked.clear()

    def enter(tag: str, boiler: bool, by: int) -> None:
        depth["boiler"] += by * boiler
        depth["content"] += by * (tag in _CONTENT)
        depth["heading"] += by * (tag in _HEADINGS)
        depth["listed"] += by * (tag == "li")

    at, end = 0, len(source)
    while at < end:
        found = TOKEN.search(source, at)
        stop = found.start() if found else end
        if stop > at:
            parts.append(source[at:stop])
            if depth["a"]:
                linked.append(source[at:stop] + " ")
        if not found:
            break
        at = found.end()
        name = found.group(2) or found.group(5)
        if not name:  # comment, declaration
            if found.group(0).startswith("<![CDATA["):
                parts.append(html_lib.escape(found.group(0)[9:].removesuffix("]]>")))
            continue
        tag, closing = name.lower(), bool(found.group(1) or found.group(4))
        attributes = found.group(3) or ""
        if tag in _DROPPED:
            if not closing and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if tag in ("head", "title") and close is None:
                    continue
                if tag != "head":
                    at = close.end() if close else end
                elif close:
                    at = close.end()
            if tag not in ("title", "head", "script", "style", "noscript", "template"):
                parts.append(" ")
            elif tag not in ("script", "style"):
                flush()
            continue
        if tag in _INLINE:
            if tag == "a":
                depth["a"] = 0 if closing else 1
            continue
        if tag == "br":  # a line break stands inside a block
            parts.append(" ")
            continue
        flush()
        if tag in _VOID:
            continue
        if tag == "a":
            depth["a"] = 0
        if closing:
            if any(t == tag for t, _ in stack):
                while True:
                    t, boiler = stack.pop()
                    enter(t, boiler, -1)
                    if t == tag:
                        break
        elif not attributes.rstrip().endswith("/"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag in _HEADINGS:  # these end an open one of their kind
                while stack and (stack[-1][0] == tag or stack[-1][0] == "p" and tag != "li"):
                    enter(*stack.pop(), -1)
            boiler = _boiler(tag, attributes)
            stack.append((tag, boiler))
            enter(tag, boiler, 1)
            seen_content = seen_content or tag in _CONTENT
    flush()
    rows: list[list[float]] = []
    for i, (n, links, boiler, content, heading, listed) in enumerate(marks):
        before = marks[i - 1] if i else (0, 0)
        after = marks[i + 1] if i + 1 < len(marks) else (0, 0)
        rows.append([n, links / n, before[0], before[1] / max(1, before[0]), after[0], after[1] / max(1, after[0]), boiler, content, heading, listed, int(seen_content)])
    return texts, rows


def labelled_rows(pages: list[str]) -> list[list[float]]:
    """A row per block of labelled pages: its features, then 1 for main text."""
    out = []
    for page in pages:
        texts, rows = blocks_of(page)
        out += [[*row, float(text[0] == "+")] for text, row in zip(texts, rows, strict=True)]
    return out


def main_text(source: str, nodes: list[tuple[int, float, int, int, int]]) -> str:
    texts, rows = blocks_of(source)
    return "\n".join(t for t, keep in zip(texts, classify(nodes, rows), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. A null or empty html gives an empty text; pages of any length are
    read whole; repeated rows are read one by one and other columns change nothing; an empty table gives an empty result.
    Where two splits of the tree are as good, the one of the first feature and least threshold is taken."""
    small_batches(pages.sparkSession)
    nodes = fit_tree(labelled_rows(LABELLED_PAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, nodes) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
