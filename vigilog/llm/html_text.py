"""Main text of web pages by composite text density.

Each page is read into a tree of block elements (inline tags only count as tags, missing
end tags are closed as browsers do). Scripts, menus, hidden parts and the like are no part of
the tree; forms and blocks whose class, id or role says that they are notices, adverts, comments
and so on (every word of a name, not just one of them) neither, unless they
hold the article element or (where none is marked) most of the text, as wrappers of a page
do. For every node the density is characters per tag,
adjusted by how much of it is link text; a node's sum is that of its children's densities.
The node with the largest sum is the article, or the ``article`` or ``main`` element that
it lies in. Next to the path from it to the body, a subtree that is not mostly links belongs to
the article too if its density reaches the least density on that path, if it is mostly a heading, or
if it stands beside the best node as a part of the same kind or of running text; so do the path's
own runs of text that are not mostly links, unless the article is marked by such an element.

Pages are read once from front to back in linear time. Quotes count after an equals sign only. A tag
that the page never closes ends at the next ``>``, and so do all tags after it; without one, the
rest of the page is that tag. ``br`` and ``hr`` end a block, as they end a line; left-out controls in
a line of text, such as buttons, do not.

Defined results: null, empty and tag-only pages have an empty text. Text is never cut.
Repeated rows have equal texts; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilog.llm.batches import bounded_batches, column

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# The rest of a tag, without ever going back.
REST = re.compile(r"""((?>[^=>]+|=\s*+(?:"[^"]*"|'[^']*')|=)*+)>""")
NAMED = re.compile(r"""(class|id|role|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<![\w-])(hidden)(?![\w-])""", re.I)
RAW = {"script", "style", "textarea", "title", "template", "iframe", "svg", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
LEFT_OUT = set("head nav footer aside button select dialog menu audio video canvas map datalist".split())
CONTROLS = set("button select audio video canvas map datalist".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RUNNING = HEADINGS | set("p section blockquote ul ol dl pre table figure".split())
NOISE = set(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
    sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist reply replies
    respond disqus widget search complementary contentinfo dialog""".split()
)
# Words that say nothing about a block beside one of the above.
PLAIN = set(
    """list box wrap wrapper container block area section item items bar button buttons link links slot unit form inner outer top bottom left right
    title text body content post posts page site global main primary secondary icon icons media message panel region row col column group""".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
PARTS = re.compile(r"[A-Za-z]+")


class Run(str):
    """A run of text and how many of its characters are in links."""

    links = 0


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "head_chars", "density", "total", "doubt")

    def __init__(self, tag: str, parent: Node | None, doubt: bool = False):
        self.tag, self.parent, self.children, self.doubt = tag, parent, [], doubt
        self.chars = self.tags = self.link_chars = self.link_tags = self.head_chars = 0
        self.density = self.total = 0.0


def _names_noise(value: str, words_of_noise: set[str]) -> bool:
    """Whether one of the names in a class, id or role is of such words and plain ones alone."""
    for name in value.split():
        words = set(PARTS.findall(name))
        if words & words_of_noise and words <= words_of_noise | PLAIN:
            return True
    return False


def _noise(tag: str, attributes: str, in_article: bool) -> str:
    """``out`` for what is no part of the page's text, ``doubt`` for blocks that are left out unless
    they hold the article."""
    if tag in LEFT_OUT or (tag in ("header", "noscript") and not in_article):
        return "out"
    doubt = "doubt" if tag == "form" else ""
    if not attributes or tag in {"html", "body", "main"}:
        return doubt
    for name, value, hidden in NAMED.findall(attributes):
        if hidden:
            return "out"
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return "out"
        elif name == "aria-hidden":
            if value == "true":
                return "out"
        elif tag not in INLINE:
            if _names_noise(value, {"comment", "comments", "reply"} if tag == "article" else NOISE) or (not in_article and _names_noise(value, {"header"})):
                doubt = "doubt"
    return doubt


def _settled(root: Node) -> None:
    """Takes out the doubtful blocks, except those that hold an article or main element that is
    in no other article or, on pages without such an element, most of the body's characters
    outside links."""
    nodes = [root]
    for node in nodes:
        nodes += [c for c in node.children if isinstance(c, Node)]
    plain = {id(n): n.chars - n.link_chars for n in nodes}
    nested, marked = set(), set()  # nodes in an article; nodes that hold one
    for node in nodes[1:]:
        if id(node.parent) in nested or node.parent.tag == "article":
            nested.add(id(node))
    for node in reversed(nodes[1:]):
        up = node.parent
        plain[id(up)] += plain[id(node)]
        if id(node) in marked or node.tag in ("article", "main") and not node.doubt and id(node) not in nested:
            marked.add(id(up))

    def stays(child) -> bool:
        held = not isinstance(child, Node) or not child.doubt or id(child) in marked
        return held or id(root) not in marked and plain[id(child)] * 2 > plain[id(root)]

    for node in nodes:
        node.children = [c for c in node.children if stays(c)]


def tree(page: str) -> Node:
    """The body's blocks; children are nodes or runs of text."""
    root = node = Node("body", None)
    at = links = 0
    article = 0  # open article and main elements
    end = len(page)
    skip: list[str] = []  # open elements of a part that is left out
    text: list[str] = []
    link_pieces: list[str] = []
    doubtful = False

    def flush():
        nonlocal text, link_pieces
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                linked = min(len(whole), len(" ".join(html.unescape("".join(link_pieces)).split())))
                run = Run(whole)
                run.links = linked
                node.children.append(run)
                node.chars += len(whole)
                node.link_chars += linked
            text, link_pieces = [], []

    def close(to: Node):
        nonlocal node, article
        flush()
        while node is not to:
            article -= node.tag in ("article", "main")
            node = node.parent

    def open_(tags, stop):
        seek = node
        while seek is not root and seek.tag not in tags:
            if seek.tag in stop:
                return None
            seek = seek.parent
        return None if seek is root else seek

    quoted = True  # until a tag is met that the page does not close
    while at < end:
        begin = page.find("<", at)
        piece = page[at:begin] if begin >= 0 else page[at:]
        found = TAG.match(page, begin) if begin >= 0 else None
        if begin >= 0 and not found and not page.startswith(("<!", "<?"), begin):
            piece += "<"
        if piece and not skip:
            text.append(piece)
            if links:
                link_pieces.append(piece)
        if begin < 0:
            break
        if not found:
            if page.startswith("<!--", begin):
                stop = page.find("-->", begin + 2)
                at = stop + 3 if stop >= 0 else end
            elif page.startswith(("<!", "<?"), begin):
                at = page.find(">", begin) + 1 or end
            else:
                at = begin + 1
            continue
        rest = REST.match(page, found.end()) if quoted else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            quoted = False
            stop = page.find(">", found.end())
            attributes, at = page[found.end() : stop] if stop >= 0 else "", stop + 1 or end
        tag = found[2].lower()
        closing = bool(found[1])
        if not closing and tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", stop.end()) + 1 or end) if stop else end
            continue
        if skip:
            if closing:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                elif tag in ("body", "html"):
                    skip = []
            elif tag not in VOID:
                if tag in CLOSES and skip[-1] in CLOSES[tag] or tag == "p" and skip[-1] == "p" and len(skip) > 1:
                    skip.pop()
                skip.append(tag)
            continue
        if tag in CONTROLS:
            if not closing:
                skip = [tag]
            continue
        if tag in INLINE:
            if closing:
                links -= tag == "a" and links > 0
            elif _noise(tag, attributes, article > 0):
                skip = [tag]
            else:
                node.tags += 1
                if tag == "a":
                    links = 1
                    node.link_tags += 1
            continue
        if tag in VOID:
            node.tags += 1
            if tag in ("br", "hr"):
                flush()
            continue
        if closing:
            flush()
            if tag not in ("body", "html") and (seek := open_({tag}, ())):
                close(seek.parent)
            links = 0
            continue
        if tag in ("html", "body"):
            continue
        flush()
        links = 0
        if seek := open_({"p"}, {"td", "th", "li", "blockquote", "article", "main", "section", "div"}):
            close(seek.parent)
        if tag in CLOSES and (seek := open_(CLOSES[tag], SCOPE[tag])):
            close(seek.parent)
        doubt = _noise(tag, attributes, article > 0)
        if doubt == "out":
            skip = [tag]
            continue
        doubtful |= doubt == "doubt"
        child = Node(tag, node, doubt == "doubt")
        node.children.append(child)
        article += tag in ("article", "main")
        node = child
    flush()
    if doubtful:
        _settled(root)
    return root


def _measure(root: Node) -> list[Node]:
    """All nodes, parents first, with counts of their whole subtrees, densities and sums."""
    nodes = [root]
    for node in nodes:
        nodes += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(nodes):
        if node.tag in HEADINGS:
            node.head_chars = node.chars
        if node is root:
            break
        up = node.parent
        up.head_chars += node.head_chars
        up.chars += node.chars
        up.tags += node.tags + 1
        up.link_chars += node.link_chars
        up.link_tags += node.link_tags
    for node in nodes:
        if node.chars:
            tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + root.link_chars / max(root.chars, 1) * node.chars + math.e)
            node.density = node.chars / tags * math.log(max(node.chars / links * tags / link_tags, 1) + 1) / math.log(base + 1)
    for node in nodes:
        node.total = sum(c.density if isinstance(c, Node) else len(c) for c in node.children)
    return nodes


def _blocks(node: Node, out: list[str]) -> None:
    stack = [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, Node):
            stack.append(iter(child.children))
        else:
            out.append(child)


def main_text(page: str | None) -> str:
    """The blocks of the article in page order, joined by line feeds."""
    nodes = _measure(tree(page or ""))
    best = max(nodes, key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for place, node in enumerate(path):
        if node.tag in ("article", "main"):
            path = path[place:]
            break
    whole, beside = path[0], path[0].parent
    loose = whole.tag not in ("article", "main")
    edge = min(n.density for n in path)
    inside = {id(n) for n in path[1:]}
    out: list[str] = []
    stack = [iter([path[-1]])]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif not isinstance(child, Node):
            if loose and child.links * 2 <= len(child):
                out.append(child)
        elif child is whole:
            _blocks(child, out)
        elif id(child) in inside:
            stack.append(iter(child.children))
        elif child.link_chars * 2 <= child.chars and (child.density >= edge or child.head_chars * 2 > child.chars or (child.parent is beside and (child.tag == best.tag or child.tag in RUNNING))):
            _blocks(child, out)
    return "\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(column(pages, id_column).alias("page_id"), column(pages, url_column).cast("string").alias("url"), F.coalesce(column(pages, html_column).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
