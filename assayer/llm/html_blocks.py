"""Main text of web pages: flat text blocks, classified by a decision tree over density and place."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.arrowio import arrow_type, map_slices, texts_of

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN_ATTRIBUTE = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template", "svg", "select", "canvas",
       "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "img"}
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
MAIN_TAGS = {"article", "main"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form",
              "alertdialog"}
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|"
    r"footer|header|masthead|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"comments?\w*|disqus|respond|reply|replies|discussion|feedback|related|recommend\w*|share|sharing|social|follow|toolbar|"
    r"pagination|pager|tags|search\w*|form|copyright|legal|skip)(?=$|[\s_-])", re.I)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|post|post-?body|post-?content|entry|entry-?content|story\w*|content|main\w*|body-?text)(?=$|[\s_-])",
                        re.I)
#: Readers' words: what is under them stays aside whatever stands there.
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?\w*|disqus|respond|reply|replies|discussion|feedback)(?=$|[\s_-])", re.I)
#: Classes of an article that is no main text.
TEASER_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|teaser|widget\w*|sidebar\w*)(?=$|[\s_-])", re.I)
#: A part of a name that says what the page has or lacks, not what the element is.
LAYOUT = re.compile(r"^(?:has|no|with|without)[_-]|^side-(?!bar|nav|menu|content|panel|column)", re.I)
MAIN_NOUN = re.compile(r"(?:^|[_-])(?:article|story|entry|post)s?$|^(?:article|story|entry|post)[_-]?(?:body|content|text)$", re.I)
#: How firmly a mark holds: of a wrapper that an article may stand in, of a tag or role that holds none, of comments and hidden parts.
WEAK, FIRM, HARD = 1, 2, 3
P_CLOSERS = {"p", "div", "ul", "ol", "li", "table", "section", "article", "header", "footer", "nav", "aside", "form", "h1", "h2",
             "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "main", "dl", "fieldset", "figure", "address", "details"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    side: bool
    main: bool
    item: bool


def _attributes(raw: str) -> str:
    """Class, id and role of a tag in one line, with ``hidden`` marked."""
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return ""
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}
    style = named.get("style", "").replace(" ", "").lower()
    gone = HIDDEN_ATTRIBUTE.search(ATTRIBUTE.sub(" ", raw)) or "hidden" in named or "display:none" in style or named.get(
        "aria-hidden", "").lower() == "true"
    return " ".join([named.get("class", ""), named.get("id", ""), "\x00" + named.get("role", "").lower(), "\x01" if gone else ""])


def _named(names: str) -> int | None:
    """What class and id say: 0 main text, ``WEAK`` aside, ``HARD`` comments, None nothing.

    Names with ``has-``, ``no-`` and the like speak of the layout and do not count. Where some names speak for the text and some
    against it, one that names an article by its last part decides for the text.
    """
    kept = [x for x in names.split() if not LAYOUT.match(x)]
    if not kept:
        return None
    line = " ".join(kept)
    if COMMENT_WORDS.search(line):
        return HARD
    if SIDE_WORDS.search(line):
        return 0 if any(MAIN_NOUN.search(x) for x in kept) and not TEASER_WORDS.search(line) else WEAK
    return 0 if MAIN_WORDS.search(line) else None


def blocks(page: str) -> list[Block]:
    """Text between block tags, in page order, with where it stands.

    ``side``: under a navigation, header, footer, form or similar tag, role, class or id, or hidden. An article or main tag
    takes away the mark of a form or of a class or id that it lies in, as those often wrap the whole page; that of comments,
    of hidden parts and of tags such as nav and footer stays. ``main``: under an article or main tag. Scripts, styles and comments give no text; an
    unclosed one runs to the end of the page, an unfinished tag there is dropped.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, firmness of the side mark, main
    side, main = 0, False
    held: list[str] = []
    held_linked: list[str] = []
    anchors = 0
    at, n = 0, len(page)

    def flush():
        if held:
            words = html.unescape("".join(held)).split()
            if words:
                item = any(t in ("li", "td", "th", "dt", "option") for t, _, _ in stack)
                linked = len(html.unescape(" ".join(held_linked)).split())
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), side > 0, main, item))
            held.clear()
            held_linked.clear()

    def text(piece: str):
        if piece:
            held.append(piece)
            if anchors:
                held_linked.append(piece)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        found = TOKEN.match(page, lt)
        if found is None:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] in "/!?"):
                close = page.find(">", lt)
                if close < 0:
                    break
                at = close + 1
            else:
                text("<")
                at = lt + 1
            continue
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), found[1] == "/"
        if closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag == "br":
                flush()
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    side, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                    break
                if stack[i][0] in ("td", "th", "table") and tag in INLINE:
                    break
            continue
        if tag in RAW and not (found[3] or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in P_CLOSERS:
            # an open paragraph ends here, with what is open inside it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    side, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                    anchors = 0
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag == "a":
            anchors += 1
        names = _attributes(found[3] or "")
        role = names.partition("\x00")[2].strip("\x01 ")
        names_only = names.partition("\x00")[0]
        kind = _named(names_only)
        if "\x01" in names or kind == HARD:
            side = HARD
        elif tag in MAIN_TAGS or role in ("main", "article"):
            # a comment or teaser is often an article of its own: it stays aside
            main, side = True, FIRM if TEASER_WORDS.search(names_only) else side if side >= FIRM else 0
        elif role in SIDE_ROLES:
            side = max(side, FIRM)
        elif tag in ("form", "fieldset"):
            # in the article it is a form, around it often the page
            side = max(side, FIRM if main else WEAK)
        elif tag in SIDE_TAGS:
            # a header inside the article holds its title
            side = side if tag == "header" and main else max(side, FIRM)
        elif tag == "noscript":
            side = side if main else max(side, WEAK)
        elif tag not in ("html", "body"):
            if kind == WEAK:
                side = max(side, FIRM if main else WEAK)
            elif kind == 0 and tag not in INLINE:
                main = main or not side
        stack.append((tag, side, main))
    flush()
    return out


FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "side", "main", "item"]


def features(found: list[Block]) -> np.ndarray:
    """Word count and link density of each block and of its neighbours, and its place."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(found):
        out[i, 0], out[i, 1] = b.words, b.linked / b.words
        out[i, 6:] = b.side, b.main, b.item
    out[1:, 2:4] = out[:-1, 0:2]
    out[:-1, 4:6] = out[1:, 0:2]
    return out


# Labelled blocks, one row each, in the order of FEATURES and then 1 for main text. Own hand-made table.
TABLE = [
    # navigation and lists of links
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 1, 0),
    (3, 1.0, 2, 1.0, 40, 0.0, 1, 0, 1, 0), (2, 1.0, 3, 1.0, 4, 1.0, 0, 0, 1, 0), (5, 1.0, 4, 1.0, 6, 0.9, 0, 0, 1, 0),
    (8, 0.9, 7, 1.0, 9, 1.0, 0, 0, 0, 0), (12, 0.8, 10, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 60, 0.0, 1, 1.0, 0, 0, 0, 0),
    (6, 1.0, 80, 0.0, 5, 1.0, 0, 0, 1, 0), (15, 0.7, 9, 0.8, 3, 1.0, 0, 0, 0, 0),
    # headers, adverts, notices, sidebars, forms
    (6, 0.0, 1, 1.0, 11, 0.0, 1, 0, 0, 0), (14, 0.0, 1, 1.0, 11, 0.0, 1, 0, 0, 0), (25, 0.1, 3, 1.0, 60, 0.0, 1, 0, 0, 0),
    (60, 0.0, 50, 0.0, 55, 0.0, 1, 0, 0, 0), (90, 0.0, 5, 0.2, 3, 1.0, 1, 0, 0, 0), (40, 0.3, 2, 1.0, 8, 0.0, 1, 0, 0, 0),
    (30, 0.0, 70, 0.0, 80, 0.0, 1, 1, 0, 0), (8, 0.0, 90, 0.0, 45, 0.0, 1, 1, 0, 0), (120, 0.0, 60, 0.0, 12, 0.0, 1, 1, 0, 0),
    (45, 0.0, 4, 0.5, 30, 0.0, 1, 1, 1, 0), (2, 0.0, 3, 0.0, 2, 0.0, 1, 0, 0, 0), (3, 0.0, 2, 0.0, 15, 0.0, 1, 1, 0, 0),
    (200, 0.0, 150, 0.0, 9, 0.0, 1, 0, 0, 0), (1, 0.0, 1, 0.0, 1, 0.0, 1, 1, 1, 0),
    # footers and short texts outside of any article
    (12, 0.0, 50, 0.0, 0, 0.0, 1, 0, 0, 0), (9, 0.2, 4, 1.0, 0, 0.0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (5, 0.0, 6, 0.9, 2, 1.0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (7, 0.4, 5, 0.6, 4, 0.8, 0, 0, 0, 0),
    (10, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 2, 0.5, 4, 0.6, 0, 0, 0, 0),
    (3, 0.67, 0, 0.0, 3, 0.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 30, 0.0, 0, 0, 0, 0), (5, 1.0, 0, 0.0, 45, 0.0, 0, 0, 0, 0),
    (4, 0.8, 3, 0.7, 50, 0.0, 0, 0, 0, 0), (7, 0.7, 60, 0.0, 40, 0.0, 0, 0, 0, 0), (2, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0),
    (5, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 0), (6, 0.9, 30, 0.0, 35, 0.0, 0, 0, 0, 0),
    (40, 0.8, 3, 1.0, 30, 0.9, 0, 0, 0, 0), (60, 0.9, 50, 0.0, 4, 1.0, 0, 0, 0, 0), (25, 0.7, 60, 0.0, 20, 0.6, 0, 0, 1, 0),
    (90, 1.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0), (18, 0.9, 80, 0.0, 25, 0.9, 0, 0, 0, 0), (30, 0.6, 20, 0.7, 60, 0.0, 0, 0, 0, 0),
    # the article by its tag, long and short blocks
    (11, 0.0, 12, 0.0, 13, 0.0, 0, 1, 0, 1), (10, 0.0, 6, 0.0, 40, 0.0, 0, 1, 0, 1), (1, 0.0, 40, 0.0, 30, 0.0, 0, 1, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1), (3, 0.0, 12, 0.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 60, 0.0, 14, 0.0, 0, 1, 0, 1),
    (30, 0.1, 20, 0.0, 25, 0.0, 0, 1, 0, 1), (80, 0.0, 5, 0.0, 90, 0.1, 0, 1, 0, 1), (200, 0.0, 3, 1.0, 12, 0.0, 0, 1, 0, 1),
    (7, 0.0, 9, 0.0, 8, 0.0, 0, 1, 1, 1), (4, 0.0, 50, 0.0, 5, 0.0, 0, 1, 1, 1), (18, 0.3, 40, 0.0, 6, 0.0, 0, 1, 1, 1),
    (12, 1.0, 70, 0.0, 60, 0.0, 0, 1, 0, 1), (2, 1.0, 40, 0.0, 45, 0.0, 0, 1, 0, 1), (6, 0.5, 30, 0.0, 20, 0.0, 0, 1, 0, 1),
    (600, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (9, 0.0, 1, 1.0, 2, 0.0, 0, 1, 0, 1), (2, 0.0, 9, 0.0, 11, 0.0, 0, 1, 0, 1),
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 1, 0, 1), (9, 1.0, 8, 1.0, 2, 0.0, 0, 1, 1, 1), (22, 0.0, 11, 0.0, 14, 0.2, 0, 1, 1, 1),
    # running text on pages without an article tag
    (60, 0.0, 10, 0.0, 70, 0.0, 0, 0, 0, 1), (45, 0.1, 60, 0.0, 50, 0.0, 0, 0, 0, 1), (90, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
    (20, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1), (12, 0.0, 45, 0.0, 38, 0.0, 0, 0, 0, 1), (6, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1),
    (9, 0.0, 2, 1.0, 55, 0.0, 0, 0, 0, 1), (30, 0.0, 4, 1.0, 35, 0.0, 0, 0, 0, 1), (25, 0.0, 30, 0.0, 4, 1.0, 0, 0, 0, 1),
    (150, 0.05, 40, 0.0, 12, 0.0, 0, 0, 0, 1), (35, 0.2, 70, 0.0, 20, 0.0, 0, 0, 0, 1), (16, 0.0, 3, 1.0, 25, 0.0, 0, 0, 1, 1),
    (28, 0.0, 18, 0.0, 17, 0.0, 0, 0, 1, 1),
]


@dataclass
class Tree:
    """A binary tree in arrays: ``x[column] <= cut`` goes to ``low``, else to ``high``; leaves hold the answer."""

    column: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    answer: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while len(x) and (self.column[node] >= 0).any():
            inner = self.column[node] >= 0
            small = x[np.arange(len(x)), np.maximum(self.column[node], 0)] <= self.cut[node]
            node = np.where(inner, np.where(small, self.low[node], self.high[node]), node)
        return self.answer[node]


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 2) -> Tree:
    """Splits by the lowest Gini impurity, the first column and cut on ties, until leaves are pure or small."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, bool(2 * y[rows].sum() >= len(rows))])
        if not left or len(rows) < 2 * leaf or y[rows].min() == y[rows].max():
            return me
        best = None
        for c in range(x.shape[1]):
            values = np.unique(x[rows, c])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[rows, c] <= cut
                if leaf <= low.sum() <= len(rows) - leaf:
                    cost = sum(len(p) * (q := y[rows][p].mean()) * (1 - q) for p in (np.flatnonzero(low), np.flatnonzero(~low)))
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, c, cut, low)
        if best is not None:
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = grow(rows[best[3]], left - 1)
            nodes[me][3] = grow(rows[~best[3]], left - 1)
        return me

    grow(np.arange(len(y)), depth)
    return Tree(*[np.array(c) for c in zip(*nodes)])


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    """The tree of ``TABLE``."""
    table = np.array(TABLE, float)
    return fit_tree(table[:, :-1], table[:, -1].astype(int))


def main_text(page: str, tree: Tree | None = None) -> str:
    """The blocks that the tree calls main text, joined by a space; empty for an empty page."""
    found = blocks(page)
    if not found:
        return ""
    verdict = (tree or default_tree()).predict(features(found))
    return " ".join(b.text for b, keep in zip(found, verdict) if keep)


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(id, url, text) of every whole page; null html is an empty page with an empty text.

    Broken markup, unclosed tags and cut-off pages give the text as far as it goes. Ids and urls may be null or
    repeat; an empty table gives an empty result; other columns are left out.
    """
    tree = tree or default_tree()
    out = pa.schema([("id", arrow_type(pages, id_col)), ("url", arrow_type(pages, url_col)), ("text", pa.string())])

    def run(batch):
        return batch.column("id"), batch.column("url"), [main_text(h, tree) for h in texts_of(batch, "html")]

    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return map_slices(narrow, "html", run, f"id {kinds[0]}, url {kinds[1]}, text string", out).toDF(id_col, url_col, "text")
