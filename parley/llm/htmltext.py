"""Main text of web pages by consensus host paths.

1. Each page is parsed by a tolerant scanner into text blocks below containers. Its
   main container is found by descending from the body while one child holds most
   of the prose; ``article`` and ``main`` end the descent.
2. The container's path, generalised to tags and classes without digits, is the
   page's vote, weighted by the logarithm of its prose. Spark sums votes by host and
   path and takes each host's best path.
3. Each page is read again with its host's path: the blocks inside every container
   on that path. A page that lacks the path, or has under half of its prose there,
   keeps its own container.

What is no article. Elements that are so by tag (menus, footers, sidebars, buttons,
scripts, styles, ``noscript``), role or a hiding attribute never give text. Words of
a class or id are evidence, weighed against the prose: a name made up of such words
alone (``cookie-notice``, ``comment-list``) drops its element unless that holds an
``article`` or ``main`` with half of the page's prose; a name with another word in
it (``social-science``), or beside a name such as ``content``, and ``form`` and
``header`` drop theirs only if it holds under half of the prose. Negated names
(``no-sidebar``, ``has-share``) say nothing. Headings in an article's own header are
kept. Character references are decoded, white space inside a block becomes one
space, and blocks are joined by one space in page order.

The scanner takes time in proportion to the page, whatever its markup: every open
element is passed once when it is closed, and quotes hide ``>`` only behind ``=``.

Defined results: null, empty or text-free html gives the empty text; a page without
a host votes for and uses its own container alone; a tag that never ends stops at the
next ``<``; scripts, styles and comments that never end reach to the end of the page;
repeated rows give a row each; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parley.llm.store import Staged, small

#: Hosts up to which winning paths are broadcast (some 100 bytes each); beyond, pages are joined by host.
BROADCAST_ROWS = 300_000
#: Share of a container's prose that a child must hold for the descent to go on.
MOST = 0.7
#: Share of a page's prose from which evidence by class no longer counts.
HALF = 0.5

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)((?:[^=<>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)([^<>]*+)>?")
_OTHER = re.compile(r"<[!?/][^>]*+>?")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_PART = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements read over whole; of these, the second set reaches to the end of the page if it is never closed.
RAW = frozenset("script style noscript template svg iframe textarea select title object canvas audio video head".split())
ENDLESS = frozenset("script style noscript iframe textarea title".split())
BLOCKS = frozenset("html body div main article section header footer nav aside form fieldset table thead tbody tfoot tr td th caption ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr details summary dialog menu center".split())
CONTAINERS = frozenset("html body div main article section table tbody tr td center".split())
NEVER = frozenset("nav footer aside button dialog menu".split())
PERHAPS = frozenset("form header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes open elements of the values inside their scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
CLOSABLE = frozenset("p li dt dd tr td th".split())
SCOPES = frozenset("ul ol dl table body html div article section td".split())
#: Words of class, id or role that mark what is no article.
BOILER = frozenset(
    "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs header masthead topbar footer bottombar contentinfo colophon sidebar sidenav aside complementary rail widget widgets "
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "share sharing social related recommended recommendations comment comments respond replies reply disqus discussion feedback form login search searchbox pagination pager toolbar copyright legal disclaimer skip hidden".split()
)
#: Words that say nothing beside those.
PLAIN = frozenset("list item items box wrap wrapper container area section block site page top bottom left right inner outer bar link links icon icons button buttons text body content global main primary secondary group module region panel column col row title post posts article articles the of to".split())
#: Words of a name that mark the article.
GOOD = frozenset("content article post entry main story text body".split())
#: Words that turn a name around.
NEGATED = frozenset("no not non without has have with hide".split())
#: Roles that are decisive alone.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())


class Node:
    """A container, or an element whose name is evidence against it."""

    __slots__ = ("tag", "label", "key", "parent", "up", "mark", "off", "prose", "total", "core", "children", "chosen")

    def __init__(self, tag: str, label: str, parent: Node | None, up: Node | None, mark: int):
        self.tag, self.label, self.parent, self.up, self.mark = tag, label, parent, up, mark
        self.key = xxh64_intdigest(label, parent.key if parent else 0) if label else (parent.key if parent else 0)
        self.off = self.chosen = False
        self.prose = self.total = self.core = 0
        self.children: list[Node] = []

    def path(self) -> str:
        out, at = [], self
        while at is not None and at.label:
            out.append(at.label)
            at = at.parent
        return ">".join(reversed(out))


class Open:
    """An open element: where its text goes, and whether it has any."""

    __slots__ = ("tag", "node", "home", "off", "heads", "inside", "scope", "counts")

    def __init__(self, tag: str, node: Node, home: Node, off: bool, heads: bool, inside: bool, scope: Open | None):
        self.tag, self.node, self.home, self.off, self.heads, self.inside = tag, node, home, off, heads, inside
        self.scope = scope or self
        self.counts: dict[str, int] | None = {} if scope is None else None


def key_of(path: str) -> int:
    key = 0
    for label in path.split(">"):
        key = xxh64_intdigest(label, key)
    return key


def _weigh(name: str) -> int:
    """2 for a name of boiler-plate words alone, 1 for one with other words, 0 for none."""
    parts = _PART.findall(_CAPITAL.sub("-", name).lower())
    if not any(p in BOILER for p in parts) or any(p in NEGATED for p in parts):
        return 0
    return 2 if all(p in BOILER or p in PLAIN for p in parts) else 1


def _attributes(raw: str) -> tuple[list[str], int, bool]:
    """Class names, the evidence against the element (0 to 2), and whether it is hidden or of such a role."""
    names, mark, good, off = [], 0, False, False
    for m in _ATTRIBUTE.finditer(raw):
        key = m[1].lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for name in value.split():
                seen = _weigh(name)
                mark = max(mark, seen)
                good = good or (not seen and any(p in GOOD for p in _PART.findall(name.lower())))
            names = value.lower().split() if key == "class" else names
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", "")):
            off = True
        elif key == "role":
            off = off or any(r in ROLES for r in value.lower().split())
    return names, (1 if mark and good else mark), off


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Text blocks in page order as (innermost node, text), and all nodes, parents first; nodes that are no article are off."""
    root = Node("", "", None, None, 0)
    top = Open("", root, root, False, False, False, None)
    nodes, stack, blocks = [root], [top], []
    open_tags: Counter = Counter()
    absent: set[str] = set()
    pieces: list[str] = []
    linked, links = 0, 0  # characters inside links, open links

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text and not stack[-1].off:
                node = stack[-1].node
                blocks.append((node, text))
                node.prose += max(0, len(text) - linked)
        linked = 0

    def close(down_to: int) -> None:
        """Closes the open elements from this place of the stack on."""
        if any(stack[i].tag in BLOCKS for i in range(down_to, len(stack))):
            flush()
        for gone in stack[down_to:]:
            open_tags[gone.tag] -= 1
        for i in range(len(stack) - 1, down_to - 1, -1):
            gone = stack[i]
            if gone.tag in CLOSABLE:
                stack[i - 1].scope.counts[gone.tag] -= 1
        del stack[down_to:]

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at and not stack[-1].off:
            pieces.append(page[at:start])
            if links:
                linked += start - at
        if start == size:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if m is None:
            m = _OTHER.match(page, start)
            if m is None:
                if not stack[-1].off:
                    pieces.append("<")
                at = start + 1
            else:
                at = m.end()
            continue
        at, tag, raw = m.end(), m[2].lower(), m[3]
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if open_tags[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW and not raw.endswith("/"):
            found = None
            if tag not in absent:
                found = re.compile(f"</{re.escape(tag)}" + ("|<body" if tag == "head" else ""), re.I | re.A).search(page, at)
            if found is None:
                absent.add(tag)
                if tag in ENDLESS:
                    break
                continue
            if tag == "head":
                at = found.start()
                continue
            end = page.find(">", found.end())
            at = end + 1 if end >= 0 else size
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        up = stack[-1]
        if tag in BLOCKS:
            flush()
            links = 0
            for closed in (("p",), CLOSES.get(tag, ())):
                for one in closed:
                    scope = stack[-1].scope
                    if scope.tag == one and scope is not stack[0] or scope.counts.get(one, 0) > 0:
                        i = len(stack) - 1
                        while stack[i].tag != one and stack[i] is not scope:
                            i -= 1
                        if stack[i].tag == one:
                            close(i)
            up = stack[-1]
        if tag in VOID or raw.endswith("/"):
            continue
        if tag == "a":
            links += 1
        names, mark, off = _attributes(raw) if raw else ((), 0, False)
        if tag in ("html", "body"):
            mark, off = 0, False
        elif tag in ("article", "main"):
            mark = 2 if mark == 2 else 0
        heads = up.heads and tag not in HEADINGS
        if tag == "header" and up.inside:
            heads = True
        elif tag in PERHAPS:
            mark = max(mark, 1)
        hidden = up.off and not (up.heads and tag in HEADINGS)
        off = hidden or off or tag in NEVER or heads
        node, home = up.node, up.home
        if tag in CONTAINERS or (mark and tag in BLOCKS):
            label = (tag + "".join(sorted({"." + _DIGITS.sub("", n).replace(">", "") for n in names}))) if tag in CONTAINERS else ""
            node = Node(tag, label, home, up.node, mark)
            nodes.append(node)
            if label:
                home.children.append(node)
                home = node
        elif mark == 2:
            off = True
        new = Open(tag, node, home, off, heads, up.inside or tag in ("article", "main"), None if tag in SCOPES else up.scope)
        if tag in CLOSABLE:
            up.scope.counts[tag] = up.scope.counts.get(tag, 0) + 1
        open_tags[tag] += 1
        stack.append(new)
    flush()
    _judge(nodes)
    return [(n, t) for n, t in blocks if not n.off], nodes


def _roll_up(nodes: list[Node]) -> None:
    for n in nodes:
        n.total = 0 if n.off else n.prose
    for n in reversed(nodes[1:]):  # children come after their parents
        n.up.total += n.total


def _judge(nodes: list[Node]) -> None:
    """Switches nodes off by their evidence and the share of the prose that they hold."""
    _roll_up(nodes)
    for n in reversed(nodes[1:]):
        if n.tag in ("article", "main") and not n.mark:
            n.core = max(n.core, n.total)
        n.up.core = max(n.up.core, n.core)
    for n in nodes[1:]:
        n.off = n.up.off or (n.mark == 2 and not n.core)
    _roll_up(nodes)  # what is surely none no longer counts
    half = HALF * nodes[0].total
    for n in nodes[1:]:
        n.off = n.off or n.up.off or (n.mark == 1 and n.total < half) or (n.mark == 2 and n.core < half)
    _roll_up(nodes)


def main_container(nodes: list[Node]) -> tuple[Node, int]:
    """The container to take, and the prose below it."""
    at = nodes[0]
    while at.children and at.tag not in ("article", "main"):
        best = max(at.children, key=lambda n: (n.total, n.tag in ("article", "main")))
        if best.total == 0 or best.total < MOST * at.total:
            break
        at = best
    return at, at.total


def vote(page: str | None) -> tuple[str, float] | None:
    """The path a page votes for and the vote's weight."""
    _, nodes = parse(page or "")
    best, prose = main_container(nodes)
    return (best.path(), math.log1p(prose)) if prose else None


def _below(blocks: list[tuple[Node, str]], nodes: list[Node], chosen) -> list[str]:
    """The texts of the blocks inside any node that ``chosen`` accepts."""
    for n in nodes:
        n.chosen = chosen(n) or (n.up is not None and n.up.chosen)
    return [t for n, t in blocks if n.chosen]


def extract(page: str | None, path: str | None = None) -> str:
    """The page's main text by the given container path, or by its own container."""
    blocks, nodes = parse(page or "")
    own, prose = main_container(nodes)
    if not prose:
        return ""
    key = key_of(path) if path else None
    text = _below(blocks, nodes, lambda n: n.key == key and bool(n.label)) if path else []
    if not text or 2 * sum(map(len, text)) < prose:
        text = _below(blocks, nodes, lambda n: n is own)
    return " ".join(text)


def host_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Rows (host, path): each host's path of most votes, ties to the path that sorts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(h, *v) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (v := vote(p))]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["host", "path", "weight"])

    hosts = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).where(F.col("host").isNotNull())
    votes = hosts.mapInArrow(run, "host string, path string, weight double").groupBy("host", "path").agg(F.round(F.sum("weight"), 6).alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def host_of(url: str):
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def main_text(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, path (of the host's consensus, null if none)."""
    paths = Staged(spark, host_paths(pages, html, url), "paths").df
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    joined = own.join(small(paths, paths.count(), BROADCAST_ROWS), "host", "left").select("page_id", "url", "html", "path")
    schema = joined.drop("html").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(text, pa.string())], names=["page_id", "url", "path", "text"])

    return joined.mapInArrow(run, schema)
