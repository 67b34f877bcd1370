"""Main text of web pages by composite text density.

Each block of the DOM, and each run of loose text between blocks, has its characters,
tags, link characters and link tags.  Its composite density is characters per tag,
adjusted by how much of it is links; a block's density sum adds the densities of what it
holds.  The block with the largest sum holds the article's longest part; the blocks around
it, as long as most of their text is prose, are the article, with all that they hold but
menus.  The least density on the path from the body is the threshold that parts elsewhere
must reach to be text as well.  Names only take out: elements that say what they are (nav, aside, footer, forms, adverts,
notices, comments) have no part in the choice.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import markup
from .spark_tools import ship

_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_SPACE = re.compile(r"\s+")

# Element names of the HTML standard by their role here.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = frozenset("nav aside footer form button menu dialog fieldset label head".split())
#: What an element's start closes if it is open, up to the element's own container.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th", "body": "head"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
CONTAINER = frozenset("ul ol dl table menu select body html article section div main td th".split())
#: Parts of class, id and role names that mark what is not the article.
NOISE_NAMES = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations widget widgets pagination pager search skip complementary contentinfo".split())
KEEP = frozenset("html body main article".split())
ARTICLE_NOISE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())


#: Blocks of text, which are read with the part beside them.
TEXT_BLOCKS = frozenset("p blockquote pre ul ol dl table figure figcaption details h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    __slots__ = ("tag", "parent", "items", "noise", "chars", "tags", "link_chars", "link_tags", "text", "links", "density", "total", "heading", "header", "blocky", "scope")

    def __init__(self, tag: str, parent: Node | None, noise: bool) -> None:
        self.tag, self.parent, self.noise = tag, parent, noise
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        #: Characters, and those in links, without what is left out by name.
        self.text = self.links = 0
        self.density = self.total = 0.0
        self.heading = self.header = False
        self.blocky = tag in BLOCK
        #: Open elements by name since the innermost container.
        self.scope: dict[str, int] = {} if parent is None or tag in CONTAINER else parent.scope


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in NOISE:
        return True
    if tag in KEEP - {"article"} or not attributes:
        return False
    names = ARTICLE_NOISE if tag == "article" else NOISE_NAMES
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name != "itemprop":
            if any(w.lower() in names for w in _NAME.findall(value)):
                return True
    return False


def parse(text: str) -> Node:
    """A tree from tags as browsers read them, near enough: implied ends, void and raw elements, stray end tags.

    Open elements are counted by container, so that what can't be closed is not looked for.
    """
    root = node = Node("html", None, False)
    found = list(markup.tokens(text))
    ends = markup.own_ends(text, found, RAW)
    opened: dict[str, int] = {}

    def leave(to: Node) -> Node:
        """Close all open elements inside of `to`."""
        x = node
        while x is not to:
            x.parent.scope[x.tag] -= 1
            opened[x.tag] -= 1
            x = x.parent
        return to

    k = -1
    while (k := k + 1) < len(found):
        t = found[k]
        tag = t.name
        if t.kind == markup.TEXT:
            if not tag:
                node.items.append(text[t.begin : t.end])
            continue
        if t.kind == markup.CDATA:
            node.items.append(entities.escape(text[t.begin : t.end], quote=False))
            continue
        if t.kind == markup.END:
            x = None
            if opened.get(tag) if tag in BLOCK else node.scope.get(tag):
                x = node
                while x is not None and x.tag != tag:
                    x = x.parent
            if x is not None and x.parent is not None:
                node = leave(x.parent)
            elif tag == "br":
                node.items.append(Node("br", node, False))
            continue
        if tag in RAW:
            node.items.append(Node(tag, node, True))
            # without an end tag of its own it has no content, but for text that only an end tag ends
            k = ends.get(k, k)
            continue
        if tag == "html":
            continue
        scope = node.scope
        if tag in BLOCK and (scope.get("p") or tag in HEADINGS and scope.get(tag)):
            x = node
            while x.tag not in CONTAINER:  # a block ends an open paragraph
                if x.tag == "p" or x.tag == tag and tag in HEADINGS:
                    node = leave(x.parent)
                    break
                x = x.parent
        if closes := CLOSES.get(tag):
            x, to = node, None
            while x.parent is not None and (any(x.scope.get(c) for c in closes) or x.tag in closes) and (x.tag not in CONTAINER or x.tag in closes):
                if x.tag in closes:
                    to = x.parent
                x = x.parent
            if to is not None:
                node = leave(to)
        attributes = text[t.begin : t.end]
        child = Node(tag, node, _is_noise(tag, attributes))
        child.header = tag not in KEEP and "eader" in attributes and any("header" in _NAME.findall((a or b or c).lower()) for _, a, b, c in _ATTR.findall(attributes))
        node.items.append(child)
        if tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK - VOID:
            node.scope[tag] = node.scope.get(tag, 0) + 1
            opened[tag] = opened.get(tag, 0) + 1
            node = child
    return root


def _in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(c for c in reversed(x.items) if not isinstance(c, str))
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, root: Node) -> float:
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(tags, 1), link_chars, link_tags
    base = math.log(c / max(c - lc, 1) * lc + root.link_chars / max(root.chars, 1) * c + math.e)
    return c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / math.log(max(base, 1.5))


def _run(items: list, root: Node, skipped: set[int]) -> Node:
    """Loose text and inline elements between two blocks, as a node of its own."""
    run = Node("", root, False)
    run.items = items
    for c in items:
        if isinstance(c, str):
            run.chars += len(c) if not c.isspace() else 0
        elif id(c) not in skipped:
            run.chars += c.chars
            run.tags += c.tags + 1
            run.link_chars += c.link_chars
            run.link_tags += c.link_tags + (c.tag == "a")
    run.density = _density(run.chars, run.tags, run.link_chars, run.link_tags, root)
    return run


def parts(x: Node, root: Node, skipped: set[int]) -> list[Node]:
    """What a block holds, in page order: blocks, inline elements that hold blocks, and runs of loose text."""
    out: list[Node] = []
    loose: list = []
    for c in [*x.items, None]:
        if c is not None and (isinstance(c, str) or not c.blocky):
            loose.append(c)
            continue
        if loose:
            run = _run(loose, root, skipped)
            if run.chars:
                out.append(run)
            loose = []
        if c is not None and id(c) not in skipped:
            out.append(c)
    return out


def measure(root: Node) -> tuple[list[Node], set[int]]:
    """Densities and density sums of all nodes, in page order, and the nodes that are left out by name with all they hold."""
    nodes = _in_order(root)
    for x in reversed(nodes):
        if x.tag in RAW:
            continue
        for c in x.items:
            if isinstance(c, str):
                x.chars += len(c) if not c.isspace() else 0
            else:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
                x.heading |= c.heading or c.tag in ("h1", "h2", "h3")
                x.blocky |= c.blocky
        if x.tag == "a":
            x.link_chars = x.chars
    skipped: set[int] = set()
    for x in nodes:
        if x.parent is not None and id(x.parent) in skipped or x.noise or _header(x) or x.tag in RAW:
            skipped.add(id(x))
        x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, root)
    for x in reversed(nodes):
        if id(x) not in skipped:
            x.text = sum((len(c) if not c.isspace() else 0) if isinstance(c, str) else c.text for c in x.items)
            x.links = x.text if x.tag == "a" else sum(c.links for c in x.items if not isinstance(c, str))
    for x in nodes:
        if x.blocky and id(x) not in skipped:
            x.total = sum(c.density for c in parts(x, root, skipped))
    return nodes, skipped


def _header(x: Node) -> bool:
    """Whether a header is the page's or another part's, and not the article's."""
    if x.tag != "header" and not x.header:
        return False
    y = x.parent
    while y is not None and y.tag not in ("article", "main"):
        y = y.parent
    return y is None or not x.heading


def main_text(text: str | None) -> str:
    """The article's blocks, joined by line breaks; empty if there is none."""
    if not text:
        return ""
    root = parse(text)
    nodes, skipped = measure(root)
    # without a body element the root is the body
    body = next((c for c in root.items if not isinstance(c, str) and c.tag == "body" and id(c) not in skipped), root)
    # of equal sums the outermost block
    best = max((x for x in nodes if x.blocky and id(x) not in skipped and (x is not root or x is body)), key=lambda x: x.total, default=body)
    path, threshold, x = set(), math.inf, best
    while x is not None:
        path.add(id(x))
        if x.density and (x is not root or x is body):
            threshold = min(threshold, x.density)
        x = x.parent
    top = _around(best, body, skipped)
    # tiny parts may all stay below the threshold
    kept = _dense(root, top, body, path, threshold, skipped) or [top]
    return "\n".join(line for x in kept for line in blocks(x, skipped))


def _listed(x: Node, skipped: set[int]) -> bool:
    """Whether what is linked in a block stands in lists or tables, as sources do and teasers don't."""
    stack = [x]
    while stack:
        y = stack.pop()
        if y.tag in LISTS or id(y) in skipped or not y.links:
            continue
        if y.tag == "a" or not y.blocky:
            return False
        stack.extend(c for c in y.items if not isinstance(c, str))
    return True


def _around(best: Node, body: Node, skipped: set[int]) -> Node:
    """The outermost block around the best one, below the body, up to which text is mostly prose: the article with its short sections.

    What is mostly links there goes (it is added to `skipped`) if it comes before any text,
    as menus do, or isn't a list.
    """
    top = best
    while top is not body and top.parent is not None and top.parent is not body and top.parent.parent is not None:
        up = top.parent
        if 2 * up.links > up.text:
            break
        begun = False
        for c in up.items:
            if isinstance(c, str) or id(c) in skipped or not c.text:
                continue
            if c is top or c.links <= 0.3 * c.text:
                begun = True
            elif c.blocky and not (begun and _listed(c, skipped)):
                skipped.add(id(c))
        top = up
    return top


def _plain(x: Node) -> bool:
    return x.link_chars <= 0.3 * x.chars


def _dense(root: Node, best: Node, body: Node, path: set[int], threshold: float, skipped: set[int]) -> list[Node]:
    """What is text, in page order: the best block, other largest parts that reach the threshold, headings in front of them, and blocks of text beside the best one.

    Where the best block is the body itself, its parts are judged one by one.
    """
    out: list[Node] = []
    ahead: list[Node] = []  # headings since the last text
    beside = best if best is body else best.parent if best.parent is not body else None

    def take(x: Node) -> None:
        out.extend(ahead)
        ahead.clear()
        out.append(x)

    stack = [root]
    while stack:
        x = stack.pop()
        on_path = id(x) in path
        if x is best and best is not body or not on_path and x.density and x.density >= threshold:
            take(x)
        elif x.parent is beside and not on_path and (x.tag in TEXT_BLOCKS or not x.tag) and _plain(x):
            take(x)
        elif x.tag in HEADINGS and x.parent is not None and id(x.parent) in path and _plain(x):
            ahead.append(x)
        elif x.tag and x.blocky:
            within = parts(x, root, skipped)
            for c in within:
                if not c.tag:
                    c.parent = x
            stack.extend(reversed(within))
    return out


def blocks(top: Node, skipped: set[int]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if line:
            out.append(line)

    stack: list[Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif id(x) in skipped:
            if x.tag in BLOCK:
                close()
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in BLOCK:
            close()
            stack.append(None)
            stack.extend(reversed(x.items))
        else:
            stack.extend(reversed(x.items))
    close()
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in K.slices(batches, "html"):
        texts = [main_text(t) for t in x.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([x.column("page_id"), x.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars in code points.

    Character references are decoded, white space inside a block is one space, blocks are
    joined in page order by one line break.  A null page counts as an empty one; broken
    and cut-off markup is read as far as it goes; repeated rows give repeated rows.
    """
    ship(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
