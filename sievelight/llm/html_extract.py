"""Main-text extraction by tree scoring.

A page is parsed into a tree with HTML's implied ends (a block start closes an open paragraph).
Regions that are never article text (menus, page headers and footers, sidebars, notices, adverts,
forms, reader comments, scripts and styles) are cut by tag, role or class name.  A class or id that says what an element has or
does (`with-sidebar`, `has-comments`) names no region; an element that bears an article's name as well is not cut by
another name; and a region that holds most of the page's text, few of it links, is not cut by its name alone, unless
that is one of reader comments.  If names would cut all text, they cut nothing.  Every remaining
paragraph passes points for its length and commas to its parent, and half of them to its
grandparent; a container's points are discounted by its link density.  If the best container lies
within an article or main element, all of the nearest one is kept, whatever its blocks' points; else its siblings are,
but for those that are mostly links.  Siblings of an article or main element are kept if their points come near, or if they
are text paragraphs themselves.  The kept subtrees are written as one line per block.

Edge cases: null, empty and text-free pages give an empty text; unclosed and stray tags are accepted;
parsing and scoring take linear time and no recursion, whatever the depth; repeated rows are
extracted one by one; columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import bounded_batches, pieces

# Element and name lists.
RAW = frozenset("script style noscript template textarea iframe svg title select xmp noembed noframes".split())
CUT_TAGS = frozenset("nav footer aside form menu dialog button input label fieldset head header".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
CUT_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar aside comment comments commentlist respond disqus nav navbar navigation menu"
    " breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe share sharing social related widget login signup pagination".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist respond disqus".split())
STATES = frozenset("with without has have no not is are show shows hide hides can js".split())
GOOD_NAMES = frozenset("article body content entry main page post story text blog hentry".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# A start of the key closes open elements of the value, up to the nearest listed scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div article section body html td th".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
#: A sibling of an article is kept with this share of the best container's points, any other below this share of link text.
SIBLING_SHARE, LINK_SHARE = 0.2, 0.5
#: A region named otherwise is kept from this share of the page's text, up to this share of link text.
MOST_TEXT, FEW_LINKS = 0.6, 0.3


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "bonus", "chars", "link_chars", "points", "block")

    def __init__(self, tag, parent, cut="", bonus=0.0):
        self.tag, self.parent, self.cut, self.bonus = tag, parent, cut, bonus
        self.children, self.chars, self.link_chars, self.points = [], 0, 0, 0.0
        self.block = tag in BLOCKS


def _judge(tag: str, attributes: str, inside_article: bool) -> tuple[str, float]:
    """(what cuts the element: `tag` for its tag or role, `comment` or `name` for its names, nothing; points its names are worth)."""
    if tag in CUT_TAGS and not (tag == "header" and inside_article):
        return "tag", 0.0
    bonus, names = 25.0 if tag in ("article", "main") else 0.0, []
    for m in NAMED.finditer(attributes) if attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in CUT_ROLES:
                return "tag", 0.0
            bonus += 25.0 * (value in ("main", "article"))
        else:
            names += value.split()
    good, bad = False, set()
    for name in names:
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if not parts or len(parts) > 1 and parts[0] in STATES:
            continue
        good |= len(parts) == 1 and parts[0] in GOOD_NAMES
        bad.update(x for x in parts if x in CUT_NAMES)
        bonus += 10.0 * any(x in GOOD_NAMES for x in parts)
    if bad and not good and tag not in ("html", "body", "article", "main"):
        return "comment" if bad & COMMENT_NAMES else "name", 0.0
    return "", bonus


class _Open:
    """The stack of open elements; the nearest one of a tag, and the nearest block, are known without a search."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.articles = [root], {}, [], 0

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.block:
            self.blocks.append(len(self.stack))
        self.articles += node.tag in ("article", "main")
        self.stack.append(node)

    def nearest(self, tags) -> int:
        """Depth of the nearest open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, depth: int) -> None:
        """Close the element at a depth and all within it."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.block:
                self.blocks.pop()
            self.articles -= node.tag in ("article", "main")


def parse(page: str) -> list[Node]:
    """Nodes in page order; the first is the root.  Text children are strings, still encoded."""
    root = Node("#root", None)
    nodes, open_ = [root], _Open(root)
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at) if at <= last else -1
        top = open_.stack[-1].children
        if lt < 0:
            top.append(page[at:])
            break
        if lt > at:
            top.append(page[at:lt])
        if page[lt + 1 : lt + 2] in ("!", "?"):
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 4) if comment else page.find(">", lt)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        m = TAG.match(page, lt) or PLAIN_TAG.match(page, lt)
        if m is None:
            top.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            depth = open_.nearest((tag,))
            if depth:
                open_.close(depth)
            elif tag in ("br", "p"):
                top.append(" ")
            continue
        if tag in BLOCKS and open_.blocks and open_.stack[open_.blocks[-1]].tag == "p":
            open_.close(open_.blocks[-1])
        if tag in ENDS:
            depth = open_.nearest(ENDS[tag])
            if depth and depth >= open_.nearest(SCOPES - {"td", "th"} if tag in ("td", "th", "tr") else SCOPES):
                open_.close(depth)
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                close = -1 if end is None else page.find(">", end.start())
                at = n if close < 0 else close + 1
            continue
        top = open_.stack[-1]
        if tag in VOID:
            top.children.append(" " if tag != "hr" else Node("hr", top))
            continue
        cut, bonus = _judge(tag, m[3], open_.articles > 0)
        node = Node(tag, top, cut, bonus)
        top.children.append(node)
        nodes.append(node)
        if not m[3].endswith("/"):
            open_.push(node)
    return nodes


def spare(nodes: list[Node]) -> None:
    """Lift the cut of names from regions that hold most of the page's text."""
    size: dict[int, list[int]] = {}
    for node in reversed(nodes):
        own = size.setdefault(id(node), [0, 0])
        own[0] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            own[1] = own[0]
        if node.parent is not None and node.cut not in ("tag", "comment"):
            up = size.setdefault(id(node.parent), [0, 0])
            up[0] += own[0]
            up[1] += own[1]
    total = size[id(nodes[0])][0]
    for node in nodes:
        chars, links = size[id(node)]
        if node.cut == "name" and chars > MOST_TEXT * total and links < FEW_LINKS * chars:
            node.cut = ""


def score(nodes: list[Node]) -> None:
    """Fill chars, link_chars and points, children before parents."""
    commas: dict[int, int] = {}
    for node in reversed(nodes):  # descendants come after their ancestors
        own = [c for c in node.children if isinstance(c, str)]
        for text in own:
            size = len(text.strip())
            node.chars += size
            commas[id(node)] = commas.get(id(node), 0) + text.count(",")
        if node.tag == "a":
            node.link_chars = node.chars
        parent = node.parent
        if parent is not None and not node.cut:
            parent.chars += node.chars
            parent.link_chars += node.link_chars
            if not node.block:
                commas[id(parent)] = commas.get(id(parent), 0) + commas.get(id(node), 0)
    dead = set()
    for node in nodes:
        if node.cut or (node.parent is not None and id(node.parent) in dead):
            dead.add(id(node))
            continue
        if node.parent is not None and node.chars and (node.tag in ("p", "pre", "td", "blockquote", "li", "dd") or node.block and any(isinstance(c, str) and c.strip() for c in node.children)):
            points = (1.0 + commas.get(id(node), 0) + min(node.chars / 100.0, 3.0)) * (1.0 - node.link_chars / node.chars)
            up = node.parent
            while up is not None and not up.block and up.parent is not None:
                up = up.parent
            up.points += points
            if up.parent is not None:
                up.parent.points += points / 2
    for node in nodes:
        if node.points or node.bonus:
            node.points = (node.points + node.bonus * (node.chars > 0)) * (1.0 - node.link_chars / max(1, node.chars))


def _lines(tops: list[Node]) -> list[str]:
    """Text of subtrees, one entry per block."""
    out: list[str] = []
    buffer: list[str] = []

    def flush():
        text = "".join(buffer)
        text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
        buffer.clear()
        if text:
            out.append(text)

    stack: list = [(t, 0) for t in reversed(tops)]
    while stack:
        item, state = stack.pop()
        if isinstance(item, str):
            buffer.append(item)
            continue
        if state:
            flush()
            continue
        if item.cut:
            if item.block:
                flush()
            continue
        if item.block:
            flush()
            stack.append((item, 1))
        stack.extend((c, 0) for c in reversed(item.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article text of one page, blocks joined by line feeds."""
    if not page:
        return ""
    nodes = parse(page)
    spare(nodes)
    text = _written(nodes)
    if not text and any(x.cut == "name" for x in nodes):
        for node in nodes:
            node.cut = "" if node.cut == "name" else node.cut
            node.chars, node.link_chars, node.points = 0, 0, 0.0
        text = _written(nodes)
    return text


def _written(nodes: list[Node]) -> str:
    score(nodes)
    dead, best = set(), None
    for node in nodes:
        if node.cut or (node.parent is not None and id(node.parent) in dead):
            dead.add(id(node))
        elif node.points > 0 and (best is None or node.points > best.points):
            best = node
    if best is None:
        return "\n".join(_lines([nodes[0]]))
    if best.parent is None:
        return "\n".join(_lines([best]))
    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    top = whole or best
    tops = []
    for child in top.parent.children:
        if child is top:
            tops.append(child)
        elif isinstance(child, str):
            if whole is None:
                tops.append(child)
        elif not child.cut:
            if whole is None:
                wanted = child.link_chars < LINK_SHARE * max(1, child.chars)
            else:
                near = child.points >= SIBLING_SHARE * best.points
                wanted = near or child.tag == "p" and child.chars > 80 and child.link_chars < 0.25 * child.chars
            if wanted:
                tops.append(child)
    return "\n".join(_lines(tops))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [narrow.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch in pieces(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded_batches(narrow).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
