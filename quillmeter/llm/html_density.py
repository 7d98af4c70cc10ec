"""Main-text extraction by composite text density over the DOM.

For each node: characters and tags in its subtree, and those inside links. The composite density weighs characters
per tag down where links prevail. A block's density sum adds its child blocks' densities; the block of the largest sum
holds the main text. The sparsest block on its path to the body is the threshold: blocks beside that path which are
denser and hold text of their own (headings, paragraphs, or several blocks with a sum that compares) belong to it too.

Tags say what is never text (menus, forms, scripts, asides). Names in class, id or role are weaker: a few that leave no
doubt (adverts, comments, cookie notices, sidebars) cut a block; all others only help to choose among blocks, and cut
inside the chosen one where its density says the same.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmeter.llm._store import small_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
SKIP = RAW | set("head nav header footer aside form button select option datalist fieldset label dialog menu canvas audio video map".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of these ends an open p.
ENDS_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "head", "html", "body", "legend"}
#: A start tag ends an open tag of the set, if no tag of the second set is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Whole names in class, id or role that leave no doubt.
CERTAIN = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot ad-banner banner-ad sponsored comment comments comment-list commentlist comments-area disqus disqus_thread "
    "cookie-notice cookie-banner cookie-consent site-header site-footer page-header page-footer contentinfo navigation navbar nav breadcrumb breadcrumbs "
    "sidebar sidebars sidenav complementary pagination pager share-buttons social-share skip-link".split()
)
#: Whole names that mostly mark what isn't the article, but are words of headings too: text with a heading of its own, or a
#: dense paragraph, stays under such a name.
LIKELY = set("cookie cookies consent gdpr notice notices masthead newsletter subscribe respond sponsor sponsors".split())
#: Words in names that often mark what is not the article.
DOUBTFUL = CERTAIN | LIKELY | set(
    "banner banners commentary footer foot footnav header menu menus navi aside share sharing social related recommended recommendations promo promos promotion promoted popup modal overlay subscription signup "
    "login widget widgets skip toolbar topbar discussion replies reactions search alert disclaimer".split()
)
#: Blocks that hold text, and those that hold blocks.
TEXT = set("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl pre blockquote table figure address details".split())
HEADINGS = set("h1 h2 h3 hgroup".split())
#: The share of the chosen block's sum that other blocks of text need to stay with it, and that a block with the heading
#: needs to be chosen instead of what is around it; how much larger a doubtful block's sum must be to be chosen.
KIN, HEADED, OUTWEIGHS = 0.25, 0.1, 4.0
#: Shares of the threshold that text beside the path needs, and below which a block of a doubtful name is cut.
LOOSE, THIN = 0.5, 0.25
#: A comment, a declaration, or the beginning of a tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)", re.S)
#: In a tag: its end, or the quote that begins a value.
_VALUE = re.compile(r"""=\s*+(["'])|>""")
_OPEN = re.compile(r"<[/A-Za-z!?]")
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_ARTICLE = {"article", "post", "entry", "story"}
_WRAPPER = {"has", "no", "with", "without", "layout"}
#: Tags whose content is markup or other text up to their end tag.
_VERBATIM = RAW - {"svg", "math", "object", "template", "noscript"}


class Node:
    __slots__ = ("tag", "kids", "parent", "depth", "skip", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "texts", "headed", "holds_h1")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, named: int = 0):
        self.tag, self.parent, self.skip, self.named, self.kids = tag, parent, skip, named, []
        self.depth, self.holds_h1 = parent.depth + 1 if parent else 0, False
        self.clear()

    def clear(self) -> None:
        self.chars = self.link_chars = self.link_tags = self.texts = 0
        self.tags, self.density, self.total, self.headed = 1, 0.0, 0.0, self.tag in HEADINGS


def _marks(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether a tag is hidden, and how sure its names are that it isn't the article: 0, 1 (doubtful), 2 (likely) or 4
    (certain)."""
    hidden, named = False, 0
    if attrs and tag not in ("body", "html", "article", "main"):
        for name, a, b, c in _MARK.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif name in ("class", "id", "role") and tag not in HEADINGS:
                for token in value.split():
                    parts = set(_WORD.findall(token))
                    if token in CERTAIN or token in LIKELY:
                        named = max(named, 4 if token in CERTAIN else 2)
                    # article-header is a part of the article, and has-sidebar wraps it.
                    elif parts & DOUBTFUL and not _ARTICLE >= parts - DOUBTFUL > set() and not parts & _WRAPPER:
                        named = max(named, 1)
    return hidden, named


class _Ends:
    """Where tags end: at the first > outside of quoted values, which begin after a = and may be of any length.

    Where a value's quote is never closed, the next > ends the tag, and from there on quotes are closed or not by the last
    place of each that was looked for once, so that all tags together take one walk over the page.
    """

    def __init__(self, text: str):
        self.text, self.last, self.open_from = text, {q: text.rfind(q) for q in ("'", '"')}, len(text)

    def find(self, pos: int) -> int:
        """The place of the > that ends a tag whose attributes begin at pos, -1 without any."""
        at = pos
        while at < self.open_from and (m := _VALUE.search(self.text, at)):
            if not m[1]:
                return m.start()
            if m.end() > self.last[m[1]]:
                at = m.end()  # an open quote is a part of the value
                continue
            at = self.text.find(m[1], m.end()) + 1
        self.open_from = min(self.open_from, pos)  # quotes are out of step: no later tag is read past them either
        return self.text.find(">", pos)


class _Stack:
    """The open tags, with the places of each tag name and of blocks, so that no step walks the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        for kind in (node.tag, *(("",) if node.tag in BLOCK else ())):
            self.places[kind].append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The place of the last open tag of these names, 0 without one; the empty name stands for all blocks."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, upto: int) -> None:
        while len(self.nodes) > upto:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.places[""].pop()


def parse(text: str) -> Node:
    """The DOM of a page, tolerant of missing and stray end tags; children are nodes and strings in page order. Takes
    time in proportion to the page, however deep it is nested. The root's named has the bits of all names in it."""
    root = Node("html", None)
    stack, pos, n, final, ends_at = _Stack(root), 0, len(text), text.rfind(">"), _Ends(text)
    while pos < n:
        m = _TAG.search(text, pos) if pos <= final or text.startswith("<!--", pos) else None
        at = stack.nodes[-1]
        if m is None:
            cut = _OPEN.search(text, pos)  # a tag that the page's end leaves open
            at.kids.append(text[pos : cut.start() if cut else n])
            break
        if m.start() > pos:
            at.kids.append(text[pos : m.start()])
        pos, tag = m.end(), m[2]
        if tag is None:
            continue
        end = ends_at.find(pos)
        attrs, pos, tag = text[pos:end], end + 1, tag.lower()
        if m[1]:
            place = stack.last(tag)
            # An inline end tag closes nothing outside its table cell.
            if place and (tag in BLOCK or place > stack.last("td", "th", "table")):
                stack.close(place)
            continue
        if tag == "html":
            continue
        if tag in ENDS_P and (place := stack.last("p")) and place >= stack.last(""):
            stack.close(place)
        if tag in ENDS:
            ends, stops = ENDS[tag]
            while (place := stack.last(*ends)) and place > stack.last(*(stops - ends)):
                stack.close(place)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        if tag == "body" and (place := stack.last("head")):
            stack.close(place)
        at = stack.nodes[-1]
        hidden, named = _marks(tag, attrs)
        own_header = tag == "header" and stack.last("article") > 0
        node = Node(tag, at, at.skip or hidden or tag in SKIP and not own_header, named)
        at.kids.append(node)
        root.named |= named
        while tag == "h1" and at is not None and not at.holds_h1:
            at.holds_h1, at = True, at.parent
        if tag in VOID:
            continue
        if tag in _VERBATIM:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, pos)
            node.kids.append(text[pos : end.start() if end else n])
            pos = end.end() if end else n
            continue
        if not attrs.endswith("/") or tag not in ("svg", "math"):
            stack.push(node)
    return root


def _cut(x: Node, sure: int) -> bool:
    """Whether a block's names are at least so sure; one that holds a page's heading wraps the article instead."""
    return x.named >= sure and not x.holds_h1


def measure(top: Node, sure: int = 3, ratio: float | None = None) -> tuple[list[Node], float]:
    """Sets counts, densities and sums of every node, bottom up without recursion. Returns the nodes in page order, without
    those that are cut, and the body's share of characters in links, if it isn't given."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        node.clear()
        order.append(node)
        todo += reversed([k for k in node.kids if isinstance(k, Node) and not k.skip and not _cut(k, sure)])
    for node in reversed(order):
        node.chars += sum(len(_SPACE.sub("", k)) for k in node.kids if not isinstance(k, Node))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        if node.tag in BLOCK and node.chars and not node.texts:
            node.texts = 1
        if node is not top:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.texts += node.texts
            up.headed |= node.headed and node.chars > 0
    if ratio is None:
        body = _body(order)
        ratio = body.link_chars / max(1, body.chars)
    for x in reversed(order):
        if x.chars:
            x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, ratio)
        if x is not top:  # inline tags hand on what is in them
            x.parent.total += x.density if x.tag in BLOCK else x.total
    return order, ratio


def _body(order: list[Node]) -> Node:
    return next((x for x in order if x.tag == "body"), order[0])


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters per tag, by a logarithm that falls with the share of links; ratio is the body's share of characters in
    links."""
    plain, links = max(chars - link_chars, 1), max(link_chars, 1)
    base = math.log(chars / plain * links + ratio * chars + math.e)
    return chars / tags * math.log(max(chars / links * tags / max(link_tags, 1), 1.0) + 1e-9, base)


def _kids(x: Node, order: set[int]) -> list[Node]:
    """The measured blocks right below a node, through inline tags, that hold text."""
    out, todo = [], [k for k in x.kids if isinstance(k, Node)]
    while todo:
        k = todo.pop()
        if id(k) in order and k.chars:
            if k.tag in BLOCK:
                out.append(k)
            else:
                todo += [y for y in k.kids if isinstance(y, Node)]
    return out


def choose(order: list[Node]) -> tuple[Node, float]:
    """(the block of the largest density sum, the smallest density on its path to the body).

    Where all that stands around one block are bare boxes, and it alone holds the heading, that block is chosen instead:
    in a very short article a single box of text may outweigh it.
    """
    known, body = set(map(id, order)), _body(order)
    best = max((x for x in order if x.chars and (x.tag in BLOCK or x is body)), key=lambda x: (x.total, x.depth), default=body)
    while True:
        below = _kids(best, known)
        inner = [k for k in below if k.tag not in TEXT and k.headed and k.total >= HEADED * best.total]
        if len(inner) != 1 or any(k is not inner[0] and (k.tag in TEXT or k.headed) for k in below):
            break
        best = inner[0]
    return best, min(x.density for x in _path(best, body))


def _path(x: Node, body: Node) -> list[Node]:
    out = [x]
    while x is not body and x.parent is not None:
        x = x.parent
        out.append(x)
    return out


def kin(order: list[Node], top: Node, threshold: float) -> list[Node]:
    """The chosen block and the blocks beside its path to the body that belong to it, in page order."""
    known, place = set(map(id, order)), {id(x): i for i, x in enumerate(order)}
    path = _path(top, _body(order))
    on_path, out = set(map(id, path)), [top]
    for up in path[1:]:
        if up.tag in BLOCK or up is path[-1]:
            for k in _kids(up, known):
                if k.tag in HEADINGS or k.tag == top.tag == "article":
                    own = 2 * k.link_chars < k.chars
                elif k.tag in TEXT:
                    own = k.density >= LOOSE * threshold
                else:
                    own = k.texts >= 2 and k.density >= threshold and k.total >= KIN * top.total
                if own and id(k) not in on_path:
                    out.append(k)
    return sorted(out, key=lambda x: place[id(x)])


def extract(page: str | None) -> str:
    """The main text; blocks joined by two line feeds, white space inside a block as one space. Null and no text: empty."""
    if not page:
        return ""
    root = parse(page)
    order, ratio = measure(root, 1)
    top, threshold = choose(order)
    if root.named & 1:
        total = top.total
        order, ratio = measure(root, 2)
        top, threshold = choose(order)
        if top.total <= OUTWEIGHS * total:
            order, ratio = measure(root, 1)
            top, threshold = choose(order)
    if root.named and not root.chars:  # all that there is has such a name
        order, ratio = measure(root)
        top, threshold = choose(order)
        return "\n\n".join(filter(None, map(render, kin(order, top, threshold))))
    known = set(map(id, order))
    parts = kin(order, top, threshold)
    todo = list(parts)
    while todo:
        x = todo.pop()
        if id(x) not in known and not x.skip:
            if _cut(x, 4):
                x.skip = True
            else:  # a doubtful name stays unless its density says so too, a likely one goes unless its text is an article's
                measure(x, 2, ratio)
                x.skip = 2 * x.link_chars >= x.chars or x.density < THIN * threshold
                if _cut(x, 2) and not x.headed and not (x.tag in TEXT and x.density >= LOOSE * threshold):
                    x.skip = True
            continue
        if top.tag in ("body", "html") and x is not top and x.tag in BLOCK and x.link_tags >= 3 and x.link_chars >= 0.8 * x.chars and x.density < threshold:
            x.skip = True  # a list of links beside loose paragraphs is a menu
        todo += [k for k in x.kids if isinstance(k, Node) and not k.skip]
    return "\n\n".join(filter(None, map(render, parts)))


def render(top: Node) -> str:
    """The text below a node in page order."""
    blocks, line = [], []

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            blocks.append(text)

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif not isinstance(x, Node):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.skip:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.kids)
    end()
    return "\n\n".join(blocks)


@F.pandas_udf(StringType())
def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(extract, na_action=None).astype(object)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html and with text and n_chars (code points); one row for each, nothing shuffled.

    Null and empty pages and pages without body text have an empty text; repeated rows get the same text each. A column
    named text or n_chars is replaced.
    """
    small_batches(pages.sparkSession)
    out = pages.withColumn("text", main_text(F.col(column)))
    return out.withColumn("n_chars", F.length("text").cast("long")).drop(column)
