"""Main text of web pages by composite text density.

Every node of the page tree gets its characters per tag, adjusted by how much
of them sits in links.  The subtree with the largest sum of its children's
densities holds the article; the least density on the path from the body to
the densest node tells text apart from page furniture inside it, and further
parts of the article beside that path from the rest of the page.  Elements that
the page itself names as articles only widen that choice.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rainloom.llm import common

# Fixed values of the HTML standard: elements without content, elements whose content is no markup, elements that
# stand on a line of their own, elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"br", "body", "caption", "dd", "dt", "legend", "html", "option", "optgroup", "tbody", "td", "tfoot", "th",
                  "thead", "tr", "li"} | {"dl", "ul", "ol"}
#: An opening tag ends the nearest open element of these, up to the given container.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}
#: Elements that are never part of an article.
FURNITURE = frozenset(
    "nav footer aside script style noscript iframe button select textarea input template head menu dialog svg math "
    "object embed canvas audio video map search title".split())
#: Elements that a page names as its main text.
NAMED = frozenset(["article", "main"])
#: Words in class, id or role that mark furniture; they must stand as a whole part of the name.  What an element has,
#: or lacks, is no mark of itself.
MARKS = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])(?<!\bwithout[_-])(?:ads?|adverts?|advertisements?|banners?|sponsor(?:ed|s)?|promos?|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"sidebars?|side|footers?|headers?|masthead|cookies?|consent|notices?|popups?|modal|overlay|newsletter|subscribe|signup|"
    r"social|share|sharing|related|recommended|comments?|disqus|replies|widgets?|toolbar|pagination|pager|search|login|"
    r"copyright|disclaimer|alert|gdpr|contentinfo|complementary)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:\s+|/|[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|[\"'=])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Marks of a text of its own kind, which may be longer than the article beside it.
_OWN_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|cookies?|consent|notices?|popups?|modal|overlay|newsletter|comments?|disqus|replies|"
    r"copyright|disclaimer|alert|gdpr)(?:$|[\s_-])", re.I)
#: Names of an article that is a reader's.
_REMARK = re.compile(r"(?:^|\s)(?:comments?|reply|replies)(?:$|\s)", re.I)
#: Share of the page's text outside links from which on a class or id does not mark furniture; the same for _OWN_TEXT and forms.
MOST, NEARLY_ALL = 0.5, 0.9
#: Elements deeper than this are read as children of the element at this depth.
DEEPEST = 256


class Node:
    __slots__ = ("tag", "children", "left_out", "parent", "chars", "tags", "link_chars", "link_tags", "density", "sum", "marked")

    def __init__(self, tag: str, parent: Node | None, left_out: bool = False, marked: float = 0.0):
        self.tag, self.parent, self.left_out, self.marked, self.children = tag, parent, left_out, marked, []


def _left_out(tag: str, attributes: str) -> tuple[bool, float]:
    """Whether the element is furniture, and, if only its class or id or being a form says so, the share of the text that overrules it."""
    if tag in FURNITURE:
        return True, 0.0
    marked = NEARLY_ALL if tag == "form" else 0.0
    if tag in ("html", "body", "main") or not attributes:
        return marked > 0, marked
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if tag == "article":
            if name == "class" and _REMARK.search(value):
                marked = NEARLY_ALL
        elif name in ("class", "id", "role") and MARKS.search(value):
            if name == "role":
                return True, 0.0
            marked = max(marked, NEARLY_ALL if _OWN_TEXT.search(value) else MOST)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, 0.0
    return marked > 0, marked


def _decoded(text: str) -> str:
    """Character references resolved; texts with none, or with ampersands only, need no search."""
    marks = text.count("&")
    if not marks:
        return text
    return text.replace("&amp;", "&") if marks == text.count("&amp;") else html.unescape(text)


def parse(page: str) -> Node:
    """Tree of a page; unclosed and stray tags are mended as browsers do.  Children are nodes and texts in page order."""
    root = here = Node("html", None)
    depth, at = 0, 0
    for m in _TOKEN.finditer(page):
        s = m.start()
        if s < at:
            continue
        if s > at:
            here.children.append(_decoded(page[at:s]))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                here.children.append(Node("br", here))
                continue
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                while here is not up:
                    here, depth = here.parent, depth - 1
                here, depth = here.parent, depth - 1
            continue
        if tag in ("html", "body") and not here.parent:
            if tag == "body":
                here = _open(here, tag, m.group(3))
                depth += 1
            continue
        if tag in ENDS_P or tag in IMPLIED_END:
            targets, stops = IMPLIED_END.get(tag, ({"p"}, {"article", "section", "div", "body", "main", "td", "th", "li", "button",
                                                           "blockquote", "aside", "header", "footer", "nav", "table"}))
            up = here
            while up is not None and up.tag not in targets and up.tag not in stops:
                up = up.parent
            if up is not None and up.tag in targets and up.parent is not None:
                while here is not up:
                    here, depth = here.parent, depth - 1
                here, depth = here.parent, depth - 1
        own = _open(here, tag, m.group(3))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            own.left_out = True
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m.group(3).endswith("/") and tag not in BLOCK) and depth < DEEPEST:
            here, depth = own, depth + 1
    if at < len(page):
        here.children.append(_decoded(page[at:]))
    return root


def _open(parent: Node, tag: str, attributes: str) -> Node:
    own = Node(tag, parent, *_left_out(tag, attributes))
    if tag == "header" and not _inside(parent, "article"):
        own.left_out, own.marked = True, 0.0
    parent.children.append(own)
    return own


def _inside(node: Node | None, tag: str) -> bool:
    while node is not None and node.tag != tag:
        node = node.parent
    return node is not None


def overrule(root: Node) -> None:
    """Elements that hold most of the page's text outside links are no furniture, whatever their class or id."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and (not c.left_out or c.marked)]
    marked = [n for n in order if n.marked]
    if not marked:
        return
    for node in reversed(order):
        node.chars = 0 if node.tag == "a" else sum(
            sum(map(len, c.split())) if isinstance(c, str) else c.chars if not c.left_out or c.marked else 0 for c in node.children)
    for node in marked:
        node.left_out = node.chars <= node.marked * root.chars


def measure(root: Node) -> list[Node]:
    """Counts of every node that is not left out, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.left_out]
    order.reverse()
    for node in order:
        node.chars = sum(sum(map(len, c.split())) for c in node.children if isinstance(c, str))
        node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, Node) and not c.left_out:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.sum = sum(c.density for c in node.children if isinstance(c, Node) and not c.left_out)
    return order


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_link_share: float) -> float:
    """Characters per tag times a logarithm that falls with the share of link characters and link tags."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * links + body_link_share * chars + math.e)  # above 1
    return chars / tags * math.log(max(chars / links * tags / link_tags, 1.0) + 1e-9) / math.log(base)


def text_density(node: Node) -> float:
    """Characters per tag, both outside links.  Unlike the composite density it is the same for a part of a text as for all of it."""
    return (node.chars - node.link_chars) / max(node.tags - node.link_tags, 1)


def main_node(order: list[Node], root: Node) -> tuple[Node, float]:
    """The body, or the root, with nothing but the main text left on the way to its densest part, and the least density on that way.

    The subtree with the largest density sum counts (ties: more characters, then the first one closed); inside an element
    that the page names as an article that element counts, whole, so the least density is 0.  Around such elements the
    longest of them counts, if they hold most of the text outside links.
    """
    best = max(order, key=lambda n: (n.sum + (n.density if not n.tags else 0.0), n.chars))
    up, threshold = best, best.density
    while up is not None and up.tag not in ("body", "html"):
        threshold = min(threshold, up.density)
        up = up.parent
    up = best
    while up is not None and up.tag not in NAMED:
        up = up.parent
    inside = named(best) if up is None else []
    if sum(n.chars - n.link_chars for n in inside) > MOST * (best.chars - best.link_chars):
        up = max(inside, key=lambda n: n.chars)
    if up is not None:
        return widen(up), 0.0
    while best.parent is not None and best.tag not in ("body", "html") and best.tag in ("p", "b", "i", "em", "strong", "span"):
        best = best.parent
    return widen(best), threshold


def mostly_links(node: Node) -> bool:
    return node.link_chars * 2 > node.chars


def named(node: Node | str) -> list[Node]:
    """Outermost named elements at or below ``node`` that have text and are not mostly links, in page order."""
    found, stack = [], [node]
    while stack:
        own = stack.pop()
        if isinstance(own, str) or own.left_out:
            continue
        if own.tag not in NAMED:
            stack += reversed(own.children)
        elif own.chars and not mostly_links(own):
            found.append(own)
    return found


def widen(best: Node) -> Node:
    """The body, or the root without one, above ``best``; of what lies beside the path down to it only parts of the text stay.

    Inside an article those are all but blocks that are mostly links; inside ``main`` also all but blocks below half the
    least text density on the path.  Beyond a named element only other named ones stay.  Without one, elements, and texts
    without one, stay that reach the least text density on the path, with what stands between two of them (blocks that are
    mostly links never do), and so do named elements.
    """
    path = [best]
    while path[-1].parent is not None and path[-1].tag not in ("body", "html"):
        path.append(path[-1].parent)
    article = max((i for i, n in enumerate(path) if n.tag == "article"), default=-1)
    outermost = max((i for i, n in enumerate(path) if n.tag in NAMED), default=-1)
    least = min(map(text_density, path))

    def size(text: str) -> int:
        return sum(map(len, text.split()))

    for i in range(1, len(path)):
        below, up = path[i - 1], path[i]
        if i <= outermost:
            up.children = [c for c in up.children if c is below or isinstance(c, str) or c.left_out or c.tag not in BLOCK or (
                not mostly_links(c) and (i <= article or c.tag in NAMED or text_density(c) * 2 >= least))]
        elif outermost >= 0:
            up.children = [n for c in up.children for n in ([c] if c is below else named(c))]
        else:
            reach = [c is below or (size(c) >= max(least, 1) if isinstance(c, str) else
                                    not c.left_out and c.chars > 0 and not mostly_links(c) and text_density(c) >= least)
                     for c in up.children]
            first, last = reach.index(True), len(reach) - reach[::-1].index(True)
            up.children = [n for k, c in enumerate(up.children) for n in ([c] if first <= k < last and (
                reach[k] or isinstance(c, str) or c.tag not in BLOCK or c.left_out or not mostly_links(c)) else named(c))]
    return path[-1]


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without subtrees that are mostly links below the threshold."""
    out, line = [], []
    stack: list = [iter(node.children)]
    ends = [False]

    def close() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                close()
        elif isinstance(child, str):
            line.append(child)
        elif child.left_out:
            if child.tag in BLOCK:
                close()
        elif child.tag in ("ul", "ol", "div", "section", "table", "dl") and child.density < threshold \
                and child.link_chars * 2 > child.chars:
            close()
        else:
            own = child.tag in BLOCK
            if own:
                close()
            stack.append(iter(child.children))
            ends.append(own)
    close()
    return out


def main_text(page: str) -> str:
    """The article's text: white space of a block as one space, blocks joined by one space; empty if there is none."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    overrule(root)
    order = measure(root)
    node, threshold = main_node(order, root)
    return " ".join(blocks(node, threshold))


def extract(pages: DataFrame, page: str = "html", out: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of every row and the main text of its whole page; a null page counts as empty."""
    from pyspark.sql.types import StringType, StructField, StructType

    rows = pages.select(*keep, common.text_or_empty(page).alias("__page"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, out])

    schema = StructType([rows.schema[c] for c in keep] + [StructField(out, StringType())])
    return common.in_slices(rows, work, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    texts = extract(common.read(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
