"""Main text of web pages: flat text blocks, judged by a decision tree over word counts and link densities of a block and its neighbours.

A page is read once, tag by tag. Block-level tags part it into text blocks; a block has words and the share of them inside links. A tree
grown from LABELLED, a small table of labelled blocks, tells content from the rest by these and by the words and link shares of the blocks
before and after: a line of links between paragraphs is text, one among other lines of links is a menu; a short line before a paragraph is a
heading, one after the last is not. What word counts can't tell apart (a short paragraph and a short advert) rests on three marks:

* role: an element that HTML gives another role (nav, aside, footer, form, ...), or, outside articles, the wording of a notice on cookies or rights;
* name: a container whose name says so;
* place: 0 outside articles, 1 there in an element for running text (p, h1, ...), 2 in an article, 3 in an article between paragraphs of it.
  A short p is a verse or a last remark unless it stands among links; links between an article's paragraphs are a list of the text, those after
  the last one a menu.

A name is believed only of a container that holds a part of the page: one around its heading, its main element or the longest of its
articles is a wrapper, whatever it is called; on a page without any of them, one that holds most of its words.

Cases: null html counts as empty and has an empty text; tags left open end with their parent, or with the page; a tag or comment cut off
by the end of the page is markup; scripts, styles and other elements that are never shown have no text; a line break is a space within its
block; character references are decoded after the tags are read, so `&lt;p&gt;` is text; equal pages have equal texts, one row out for each
row in; equal splits of the tree go to the first feature and the lowest threshold; pages of any length are read whole; an input's own
columns are kept whatever their names, but for text and n_chars.
"""

from __future__ import annotations

import html
import re
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row, with_row

#: A tag, a comment or another declaration; or a start of one that the page's end cuts off.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|\"[^\"]*\"|'[^']*'")
STYLES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")

# fixed values: elements by their roles in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template svg canvas head title iframe object select option button textarea math datalist dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SILENT = frozenset("script style noscript template link meta".split())
MARKED = frozenset("nav aside footer form menu".split())
#: Words of class, id and role names of containers that hold no article text.
SIGNS = frozenset(
    "ad ads adv advert advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget footer masthead comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay login search pagination pager toolbar "
    "copyright legal disclaimer contentinfo complementary skip".split()
)
#: Words that say so outside articles only: a paper has a section of this name.
HEADS = frozenset("header banner head topbar top discussion discussions feedback thread".split())
#: Elements for running text, headings of parts left out: a menu has one as well.
RUNNING = frozenset("p blockquote pre dd h1 main article".split())
NOTICE = re.compile(r"\bcookies?\b.*\b(?:accept|agree|consent|privacy|website|site|browser|browsing)\b|\b(?:accept|agree|consent|privacy|website|site)\b.*\bcookies?\b|^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.IGNORECASE)
#: Longer blocks are no notices.
NOTICE_WORDS = 80
#: Words of a paragraph that may stand before and after links of an article's text.
PARAGRAPH = 10

#: A container with more of the page's words than this is a wrapper.
WRAPPER = 0.8

# fixed values: what the signs of the table stand for: words and link shares of a block, and of its neighbours
WORDS = {"short": (1, 4, 9), "some": (18, 24), "many": (40, 120)}
SHARES = {"text": (0.0, 0.2, 0.4), "links": (0.6, 0.8, 1.0)}
BESIDE = {"none": ((0, 0.0),), "short": ((2, 0.0), (5, 0.0), (9, 0.1)), "links": ((2, 1.0), (6, 0.8), (14, 0.9)), "text": ((25, 0.0), (60, 0.1), (120, 0.0))}

#: Labelled blocks: role, name and place (marks, see above), words, kind by links, the block before, the one after; content or not.
#: A star is any: such a block is labelled the same whatever the others are.
LABELLED = """
1 * * * * * * 0
0 1 * * * * * 0
0 0 3 * * * * 1
0 0 2 * text * * 1
0 0 2 * links links * 0
0 0 2 * links * links 0
0 0 2 * links text text 1
0 0 2 * links text short 1
0 0 2 * links short text 1
0 0 2 * links text none 1
0 0 2 * links none text 1
0 0 2 * links short short 0
0 0 2 * links short none 0
0 0 2 * links none short 0
0 0 2 * links none none 0
0 0 0 * links text text 1
0 0 0 * links links * 0
0 0 0 * links * links 0
0 0 0 * links none * 0
0 0 0 * links * none 0
0 0 0 * links short * 0
0 0 0 * links * short 0
0 0 1 * links text text 1
0 0 1 * links links * 0
0 0 1 * links * links 0
0 0 1 * links none * 0
0 0 1 * links * none 0
0 0 1 * links short * 0
0 0 1 * links * short 0
0 0 0 many text * * 1
0 0 0 some text text * 1
0 0 0 some text short * 1
0 0 0 some text none * 1
0 0 0 some text links text 1
0 0 0 some text links short 1
0 0 0 some text links none 1
0 0 0 some text links links 0
0 0 0 short text * text 1
0 0 0 short text * short 0
0 0 0 short text * links 0
0 0 0 short text * none 0
0 0 1 many text * * 1
0 0 1 some text * * 1
0 0 1 short text text * 1
0 0 1 short text short * 1
0 0 1 short text none text 1
0 0 1 short text none short 1
0 0 1 short text none none 1
0 0 1 short text none links 0
0 0 1 short text links text 1
0 0 1 short text links short 1
0 0 1 short text links none 0
0 0 1 short text links links 0
"""


def labelled() -> np.ndarray:
    """The table in numbers, a row for each combination that a line stands for: features, content."""
    any_of = lambda table, sign: [x for k, xs in table.items() for x in xs if sign in (k, "*")]
    flags, places = {"0": (0,), "1": (1,)}, {x: (int(x),) for x in "0123"}
    out = []
    for line in LABELLED.split("\n"):
        if line:
            *marks, words, share, before, after, content = line.split()
            choices = [any_of(t, m) for t, m in zip((flags, flags, places), marks, strict=True)] + [any_of(WORDS, words), any_of(SHARES, share), any_of(BESIDE, before), any_of(BESIDE, after)]
            out += [(*row[:5], *row[5], *row[6], int(content)) for row in product(*choices)]
    return np.array(out, float)


def grow(rows: np.ndarray, label: np.ndarray, depth: int = 12):
    """A tree of (feature, threshold, at most, above), with leaves 0 and 1, that splits where Gini impurity falls most."""
    if depth == 0 or label.min() == label.max():
        return int(2 * label.sum() > len(label))
    best = (1e9, 0, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            cost = sum(2 * s.sum() * (1 - s.mean()) for s in (label[low], label[~low]))
            best = min(best, (round(float(cost), 9), f, float(cut)))
    if best[0] > 1e8:
        return int(2 * label.sum() > len(label))
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, grow(rows[low], label[low], depth - 1), grow(rows[~low], label[~low], depth - 1)


@cache
def trained():
    table = labelled()
    return grow(table[:, :-1], table[:, -1])


def judged(tree, features) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


def _signed(attributes: str, inside_article: bool) -> bool:
    for groups in NAMES.findall(attributes):
        names = {p.lower() for p in PIECES.findall("".join(groups))}
        if names & SIGNS or (not inside_article and names & HEADS):
            return True
    return False


def _unseen(attributes: str) -> bool:
    """Whether an attribute hides the element; words in the values of others don't."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and STYLES.search(html.unescape(value))):
            return True
    return False


class Block:
    """A text block: its text, words, words in links, whether an element's role holds it, its article (or None), the named containers around,
    and whether it is in an element for running text."""

    __slots__ = ("text", "words", "linked", "role", "article", "named", "running")

    def __init__(self, text: str, linked: int, role: bool, article: int | None, named: tuple[int, ...], running: bool):
        self.text, self.words, self.role, self.article, self.named, self.running = text, text.count(" ") + 1, role, article, named, running
        self.linked = min(self.words, linked)

    @property
    def links(self) -> bool:
        return 2 * self.linked > self.words

    @property
    def notice(self) -> bool:
        return self.article is None and self.words <= NOTICE_WORDS and NOTICE.search(self.text) is not None


#: An open element: name, dropped, role, article it is in, named containers around and at it, running text.
Open = tuple[str, bool, bool, "int | None", tuple[int, ...], bool]
OUTSIDE: Open = ("", False, False, None, (), False)


def blocks(page: str) -> tuple[list[Block], set[int], dict[int, tuple[int, ...]]]:
    """The blocks with text in page order, the containers that hold the heading or the main element, and those around each article."""
    out, parts, state = [], [], {"linked": 0, "named": 0}
    wrappers: set[int] = set()
    around: dict[int, tuple[int, ...]] = {}
    stack: list[Open] = []
    links = 0

    def flush(top: Open) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, state["linked"], *top[2:]))
            parts.clear()
        state["linked"] = 0

    def add(piece: str) -> None:
        if piece and not (stack and stack[-1][1]):
            parts.append(piece)
            if links:
                state["linked"] += len(piece.split())

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":  # a space, not the end of a block
            add(" ")
            continue
        top = stack[-1] if stack else OUTSIDE
        if name not in INLINE and name not in SILENT:
            flush(top)
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
            continue
        if name in VOID or attributes.endswith("/") and name in DROPPED:
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # these end an open one of their kind
            for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[k][0] == name:
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    top = stack[-1] if stack else OUTSIDE
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
        if name in ("h1", "main"):
            wrappers.update(top[4])
        article, role, named = top[3], top[2] or name in MARKED, top[4]
        signed = bool(attributes) and name not in ("html", "body") and _signed(attributes, article is not None)
        if name in ("article", "main"):
            article = len(around) if article is None else article
            if not signed:  # a named article is no candidate for the longest
                around.setdefault(article, named)
            else:
                around.setdefault(article, None)
        role = role or (name == "header" and article is None)
        if signed:
            named, state["named"] = (*named, state["named"]), state["named"] + 1
        dropped = top[1] or name in DROPPED or (bool(attributes) and _unseen(attributes))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
        stack.append((name, dropped, role, article, named, top[5] if name in INLINE else name in RUNNING))
        links += name == "a"
    flush(stack[-1] if stack else OUTSIDE)
    return out, wrappers, {k: v for k, v in around.items() if v is not None}


def features(page: str) -> tuple[list[str], list[tuple]]:
    """Texts of the blocks and what the tree judges them by."""
    found, wrappers, around = blocks(page)
    article, container, total = dict.fromkeys(around, 0), {}, 0
    for b in found:
        if not b.role:
            free = b.words - b.linked
            total += free
            if b.article in article:
                article[b.article] += free
            for c in b.named:
                container[c] = container.get(c, 0) + free
    if article:
        wrappers |= set(around[max(article, key=article.get)])
    elif not wrappers:
        wrappers = {c for c, w in container.items() if w > WRAPPER * total}
    ends: dict[int, tuple[int, int]] = {}  # of each article: its first and last paragraph
    for i, b in enumerate(found):
        if b.article is not None and b.words >= PARAGRAPH and not b.links and not b.role and all(c in wrappers for c in b.named):
            ends[b.article] = (ends.get(b.article, (i,))[0], i)

    def place(i: int, b: Block) -> int:
        if b.article is None:
            return int(b.running)
        first, last = ends.get(b.article, (i, i))
        return 3 if first < i < last else 2

    size = [(0, 0.0), *[(b.words, b.linked / b.words) for b in found], (0, 0.0)]
    of = [(b.role or b.notice, any(c not in wrappers for c in b.named), place(i, b), *size[i + 1], *size[i], *size[i + 2]) for i, b in enumerate(found)]
    return [b.text for b in found], of


def main_text(page: str, tree) -> str:
    return " ".join(text for text, of in zip(*features(page), strict=True) if judged(tree, of))


def _extract(tree):
    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", tree) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    return run


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars; columns of these names are replaced."""
    rows = pages.select(whole_row(pages, column, "text", "n_chars").alias("row"), F.col(column).cast("string").alias("html"))
    return rows.mapInArrow(_extract(trained()), with_row(rows, "text string, n_chars bigint")).select("row.*", "text", "n_chars")
