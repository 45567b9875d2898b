"""HTML extraction by wrapper induction.

Every host has a frame: the tree of one of its pages, that of least hash.
All pages of the host are aligned with it by simple tree matching (the most
nodes that an order-preserving top-down mapping pairs), so that a text of a
page falls into a slot of the frame; texts that no node of the frame is paired
with have the way of elements from the root as their slot. A text is template,
constant, where a ``share`` of the pages that have the slot, and two at least,
hold it there; what varies in a slot is content. Odd pages and other layouts
lack the slot, so they have no vote on it. Pages count by article: pages whose
longest other texts are the same count once, and a text whose pages have one
of those in common for the greater part belongs to copies of one article and
is no template. In extraction template text is left out, and the main text is
taken from the slots that vary, without elements whose tag or class says that
they are menus, headers, footers, sidebars, notices, adverts, forms or
comments, which vary too.

Within an element that is marked up as the article, template text counts only
if ``sure`` articles agree on it, so that articles of near copies keep their
common paragraphs.

Supports are counted by Spark on hashes of slots and texts (each page sends
one short row a text), a hot host's over all tasks. Frames and wrappers go to
the tasks as one table while they are below ``most`` bytes; beyond that pages
are joined with them by host, a hot host being dealt over ``salts`` keys.

Tree matching weighs pairs of shapes of subtrees, each pair once for all pages
of a task, and pairs two long lists of children row by row in numpy, with the
memory of some hundred rows. Reading is linear, and no step recurses, so depth
has no limit.

Elements that are marked as something else are exempt only where no article
and no main element lies outside of such elements: then those that hold one
are layout. A form that holds all of a body's text is layout too. How much
text an element holds decides nothing.

Defined cases: null or empty html gives an empty text; broken markup is read as
far as it goes (a tag that is not closed ends at the next one); very long and
very deep pages are read whole; a null url has the host ''; a host with one
distinct page has no template; null or repeated page_ids and equal rows are
extracted each; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, table, written
from .urls import parts

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("head title nav footer aside form button select textarea option iframe svg template menu datalist".split())
# Outside of an article these hold notices and the like.
OUTER_OUT = frozenset("header dialog noscript label".split())
CLOSES = {"li": ("li",), "p": ("p",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
STOPS = frozenset("ul ol table dl div section article main aside nav form blockquote body".split())
# Words in a class, id or role that mark what is not main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies reply share sharing social related recommended widget popup modal overlay login search searchbox pagination pager complementary contentinfo".split())
# Parts that say what an element has or lacks, not what it is; tags whose ids are slugs, and ids that aren't.
HAVING = frozenset("has with no not non without".split())
SLUGS = frozenset("section h1 h2 h3 h4 h5 h6".split())
NO_SLUGS = frozenset("comments disqus sidebar footer".split())
OUTER_MARKS = MARKS | {"header", "topbar", "site-header"}
READERS = frozenset("comment comments disqus replies reply".split())
MAIN_MARKS = frozenset("main content article post entry story maincontent post-content article-body entry-content".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|[\"'][^<>]*+(?:>|(?=<)|\Z)|(?=<)|\Z)|<[!?][^<>]*+(?:>|(?=<)|\Z)|(?:[^<]++|<(?!/?[a-zA-Z]|[!?]))++",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b", re.I)
PIECE = re.compile(r"[^\s_]+")
TEXT = "#"


class Node:
    """An element (tag, key, children, marks) or, with tag '#', a run of text."""

    __slots__ = ("tag", "key", "children", "text", "marks", "shape", "size", "number")

    def __init__(self, tag: str, key: str, text: str | None = None, marks: frozenset = frozenset()):
        self.tag, self.key, self.text, self.marks = tag, key, text, marks
        self.children: list[Node] = []
        self.shape, self.size, self.number = 0, 1, 0


def _marks(tag: str, attributes: str) -> tuple[str, frozenset]:
    """Class as written, and the words of class, id and role."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return "", frozenset()
    found, key = set(), ""
    for name, value, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            found.add("advert")
        elif name in ("class", "id", "role"):
            if name == "class":
                key = value
            for word in PIECE.findall(value):
                if name == "id" and tag in SLUGS:
                    found.update(NO_SLUGS & {word})
                    continue
                split = word.split("-")
                found.add(word)
                if not HAVING & set(split):
                    found.update(split)
    return key, frozenset(found)


def parse(html: str) -> Node:
    """The page's tree; elements that are left open end with their parent."""
    root = Node("html", "html")
    stack = [root]
    depth: Counter = Counter()  # of each open element's tag

    def close(k: int) -> None:
        depth.subtract(n.tag for n in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(html):
        tag = m[3]
        if tag is None:
            piece = m[0]
            if not m[1] and not piece.startswith(("<!", "<?")):
                stack[-1].children.append(Node(TEXT, TEXT, piece))
            continue
        tag = tag.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1) if depth[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in STOPS and stack[k].tag in STOPS:
                    break
            continue
        ends = CLOSES.get(tag) or (("p",) if tag in BLOCK else ())
        for k in range(len(stack) - 1, 0, -1) if any(depth[e] > 0 for e in ends) else ():
            if stack[k].tag in ends:
                close(k)
                break
            if stack[k].tag in STOPS:
                break
        if tag in ("html", "body") and depth[tag] > 0:
            continue
        key, marks = _marks(tag, m[4])
        node = Node(tag, tag + "." + key if key else tag, None, marks)
        stack[-1].children.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
            depth[tag] += 1
    return root


def shape(node: Node) -> None:
    """Hash and number of nodes of every subtree's structure."""
    walk = [node]
    for n in walk:
        walk.extend(n.children)
    for n in reversed(walk):
        n.size = 1 + sum(c.size for c in n.children)
        n.shape = hash((n.key, *(c.shape for c in n.children)))


def _trim(one: list[Node], two: list[Node]) -> tuple[int, int]:
    """Lengths of the beginnings and ends of equal structure, which match each other in a best mapping."""
    a, b, n = 0, 0, min(len(one), len(two))
    while a < n and one[a].shape == two[a].shape:
        a += 1
    while b < n - a and one[-1 - b].shape == two[-1 - b].shape:
        b += 1
    return a, b


SMALL, ROWS, KNOWN = 256, 256, 1 << 20


class Matcher:
    """Simple tree matching of trees whose nodes have shapes.

    Weights are kept by pairs of shapes, so that trees of one host share them,
    and lists of children that repeat few shapes cost few comparisons.
    """

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def _ready(self, one: list[Node], two: list[Node]) -> list[tuple[Node, Node]]:
        """Pairs of the lists' shapes whose weight is not known yet; those of unequal elements weigh nothing."""
        left, right = {n.shape: n for n in one}, {n.shape: n for n in two}
        return [(x, y) for x in left.values() for y in right.values() if x.key == y.key and (x.shape, y.shape) not in self.known]

    def weight(self, a: Node, b: Node) -> int:
        """The most nodes that a mapping with a on b pairs."""
        if len(self.known) > KNOWN:
            self.known.clear()
        work = [(a, b)]
        while work:
            a, b = work[-1]
            key = a.shape, b.shape
            if key in self.known:
                work.pop()
                continue
            if a.key != b.key or a.shape == b.shape:
                self.known[key] = a.size if a.shape == b.shape else 0
                continue
            begin, end = _trim(a.children, b.children)
            one, two = a.children[begin : len(a.children) - end], b.children[begin : len(b.children) - end]
            missing = self._ready(one, two)
            if missing:
                work.extend(missing)
                continue
            same = sum(x.size for x in a.children) - sum(x.size for x in one)
            self.known[key] = 1 + same + self._best(one, two)
        return self.known[a.shape, b.shape]

    def _weights(self, one: list[Node], two: list[Node]) -> tuple[np.ndarray, list[int]]:
        """A row of weights against ``two`` for each shape of ``one``, and the row of each of ``one``."""
        shapes = list(dict.fromkeys(x.shape for x in one))
        at = {s: k for k, s in enumerate(shapes)}
        theirs = list(dict.fromkeys(y.shape for y in two))
        where = {s: k for k, s in enumerate(theirs)}
        small = np.array([[self.known.get((s, t), 0) for t in theirs] for s in shapes], np.int64).reshape(len(shapes), len(theirs))
        return small[:, [where[y.shape] for y in two]], [at[x.shape] for x in one]

    def _best(self, one: list[Node], two: list[Node]) -> int:
        """The greatest weight of an order-preserving pairing of two lists."""
        if not one or not two:
            return 0
        if len(one) * len(two) <= SMALL:
            return self._table(one, two)[-1][-1]
        weights, of = self._weights(one, two)
        row = np.zeros(len(two) + 1, np.int64)
        for k in of:
            row = _next(row, weights[k])
        return int(row[-1])

    def _table(self, one: list[Node], two: list[Node]) -> list[list[int]]:
        best = [[0] * (len(two) + 1)]
        for x in one:
            last, row = best[-1], [0]
            for j, y in enumerate(two):
                both = last[j] + self.known.get((x.shape, y.shape), 0)
                row.append(max(row[j], last[j + 1], both))
            best.append(row)
        return best

    def _pairs(self, one: list[Node], two: list[Node]) -> Iterator[tuple[int, int]]:
        """A pairing of the greatest weight, from the end; of a long table every ROWS-th row is kept, and the rows between are made again."""
        i, j = len(one), len(two)
        if i * j <= SMALL:
            block, first = self._table(one, two), 0
        else:
            weights, of = self._weights(one, two)
            row, kept = np.zeros(j + 1, np.int64), []
            for k, w in enumerate(of):
                if k % ROWS == 0:
                    kept.append(row)
                row = _next(row, weights[w])
            block, first = None, i
        while i and j:
            if i <= first or block is None:
                first = (i - 1) // ROWS * ROWS
                block = [kept[first // ROWS]]
                for w in of[first:i]:
                    block.append(_next(block[-1], weights[w]))
            here = block[i - first]
            if here[j] == block[i - first - 1][j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield i, j

    def align(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """Pairs of text nodes under a best mapping of two trees with equal roots."""
        self.weight(a, b)
        work = [(a, b)]
        while work:
            a, b = work.pop()
            if a.tag == TEXT:
                yield a, b
            elif a.shape == b.shape:
                work.extend(zip(a.children, b.children, strict=True))
            else:
                begin, end = _trim(a.children, b.children)
                work.extend(zip(a.children[:begin], b.children[:begin], strict=True))
                work.extend(zip(a.children[len(a.children) - end :], b.children[len(b.children) - end :], strict=True))
                one, two = a.children[begin : len(a.children) - end], b.children[begin : len(b.children) - end]
                for x, y in self._ready(one, two):
                    self.weight(x, y)
                work.extend((one[i], two[j]) for i, j in self._pairs(one, two))


def _next(last: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of the table of best pairings."""
    row = last.copy()
    np.maximum(row[1:], last[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row, out=row)


def skeleton(root: Node) -> str:
    """A tree's elements and places of text, in order, each with its number of children."""
    keys, counts, work = [], [], [root]
    while work:
        node = work.pop()
        keys.append(node.key)
        counts.append(len(node.children))
        work.extend(reversed(node.children))
    return json.dumps([keys, counts], separators=(",", ":"))


def frame(skeleton_: str) -> Node:
    """The tree of a skeleton; its nodes are numbered."""
    root, open_ = None, []
    for k, (key, count) in enumerate(zip(*json.loads(skeleton_), strict=True)):
        node = Node(TEXT if key == TEXT else "", key)
        node.number = k
        while open_ and not open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].children.append(node)
            open_[-1][1] -= 1
        root = root or node
        open_.append([node, count])
    shape(root)
    return root


def slots(root: Node, of: Node | None, matcher: Matcher | None = None) -> dict[int, int]:
    """By text node (id): the number of the frame's node that it is paired with."""
    if of is None:
        return {}
    shape(root)
    return {id(b): a.number for a, b in (matcher or Matcher()).align(of, root)}


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def places(root: Node, of: Node | None, matcher: Matcher | None = None) -> Iterator[tuple[Node, str, int]]:
    """Every text node outside of what is never main text, its text and the hash of its slot."""
    paired = slots(root, of, matcher)
    ways: dict[tuple[int, str], int] = {}
    work = [(root, 0)]
    while work:
        node, way = work.pop()
        if node.tag == TEXT:
            text = _clean(node.text)
            if text:
                yield node, text, _digest(f"slot {paired[id(node)]}") if id(node) in paired else way
        elif node.tag not in LEFT_OUT or node.tag == "form":
            step = way, node.key
            if step not in ways:
                ways[step] = _digest(f"{way} {node.key}")
            work.extend((c, ways[step]) for c in node.children)


def votes(html: str, of: Node | None, matcher: Matcher | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """place, text and the page's three longest texts besides, all as hashes; text 0 stands for the place itself."""
    found = [(text, way) for _, text, way in places(parse(html), of, matcher)]
    longest = [(t, _digest(t)) for t in sorted({t for t, _ in found}, key=lambda t: (-len(t), t))[:4]]
    for text, way in sorted(set(found)):
        yield way, _digest(text), *([h for t, h in longest if t != text] + [0, 0, 0])[:3]
    for way in sorted({way for _, way in found}):
        yield way, 0, *([h for _, h in longest] + [0, 0, 0])[:3]


def _apart(node: Node) -> bool:
    """Is the element something else than main text, if it is no layout?"""
    return node.tag in LEFT_OUT or bool(node.marks & MARKS and node.tag not in ("body", "html"))


def _framing(root: Node) -> set[int]:
    """Elements marked as something else, and forms, that are the page's layout.

    A form is, if it stands in the body and no other text does, but for what is
    apart. An element is, if it holds an article or main element, not among
    readers' comments, and no such element lies outside of marked elements; the
    header of a page that has neither is, if it holds its heading and all else is apart.
    """
    layout: set[int] = set()
    parents: dict[int, Node] = {}
    walk = [root]
    for n in walk:
        if n.tag not in LEFT_OUT or n.tag == "form":
            walk.extend(n.children)
            parents.update((id(c), n) for c in n.children)
    full: set[int] = set()  # elements with text
    for n in reversed(walk):
        if n.tag == TEXT:
            if n.text.strip():
                full.add(id(n))
        elif any(id(c) in full for c in n.children):
            full.add(id(n))
    for n in walk:
        if n.tag == "form" and parents[id(n)].tag in ("body", "html"):
            if not any(c is not n and id(c) in full and not _apart(c) and c.tag not in OUTER_OUT for c in parents[id(n)].children):
                layout.add(id(n))

    under: dict[int, tuple[bool, bool]] = {id(root): (False, False)}  # what is apart; readers' comments
    plain = False  # does a text stand outside of all that is apart?
    for n in walk:
        apart, readers = under[id(n)]
        plain |= n.tag == TEXT and id(n) in full and not apart
        if id(n) not in layout and n.tag != TEXT:
            apart |= _apart(n) or n.tag in OUTER_OUT or bool(n.marks & OUTER_MARKS and n.tag not in ("body", "html"))
            readers |= bool(n.marks & READERS)
        under.update((id(c), (apart, readers)) for c in n.children)
    inner = [n for n in walk if n.tag != TEXT and id(n) in full and not _apart(n)]
    mains = [n for n in inner if n.tag in ("main", "article") or _is_main(n)]
    if any(not under[id(n)][0] for n in mains):
        return layout
    ours = [n for n in mains if not under[id(n)][1]]
    if not ours and not plain:
        ours = [n for n in inner if n.tag == "h1" and not under[id(n)][1]]
    seen: set[int] = set()
    for n in ours:
        while id(n) in parents and id(n) not in seen:
            seen.add(id(n))
            n = parents[id(n)]
            layout.add(id(n))
    return layout


def _is_main(node: Node) -> bool:
    return node.tag == "main" or bool(node.marks & MAIN_MARKS and node.tag in ("div", "section", "td"))


def _blocks(root: Node, template: dict[int, int], sure: int, inside: bool, frames: set[int]) -> list[str]:
    """Texts of the blocks under a node, without template text and what is marked as something else."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _clean("".join(run))
        run.clear()
        if text:
            out.append(text)

    work: list[Node | None] = [root]
    while work:
        node = work.pop()
        if node is None:
            end()
        elif node.tag == TEXT:
            fixed = template.get(id(node), 0)
            if not fixed or (inside and fixed < sure):
                run.append(node.text)
        elif node is root or id(node) in frames or not (node.tag in LEFT_OUT or (node.tag in OUTER_OUT and not inside) or node.marks & (MARKS if inside else OUTER_MARKS)):
            if node.tag in BLOCK:
                end()
                work.append(None)
            elif node.tag == "br":
                run.append(" ")
            work.extend(reversed(node.children))
    end()
    return out


def _candidates(root: Node, frames: set[int]) -> tuple[list[Node], list[Node], list[Node]]:
    """Elements that may hold the article: by tag article, by main or its class, and bodies; none within what is left out or within another of its kind."""
    articles, mains, bodies = [], [], []
    work = [(root, False, False)]
    while work:
        node, in_article, in_main = work.pop()
        if id(node) not in frames and _apart(node):
            continue
        if node.tag == "article":
            if not in_article:
                articles.append(node)
            in_article = True
        elif _is_main(node):
            if not in_main:
                mains.append(node)
            in_main = True
        elif node.tag == "body":
            bodies.append(node)
        work.extend((c, in_article, in_main) for c in reversed(node.children))
    return articles, mains, bodies


def extract(html: str, wrapper: dict[tuple[int, int], int] | None, sure: int = 6, of: Node | None = None, matcher: Matcher | None = None) -> str:
    """Main text of a page; a wrapper gives the number of articles by slot of the frame and text."""
    root = parse(html)
    template: dict[int, int] = {}
    if wrapper:
        template = {id(node): n for node, text, way in places(root, of, matcher) if (n := wrapper.get((way, _digest(text)), 0))}
    frames = _framing(root)
    articles, mains, bodies = _candidates(root, frames)
    for nodes in (articles, mains):
        found = [_blocks(n, template, sure, True, frames) for n in nodes]
        if any(found):
            return "\n\n".join(block for blocks in found for block in blocks)
    return "\n\n".join(_blocks(bodies[0] if len(bodies) == 1 else root, template, sure, False, frames))


EXTRACTED = "page_id {kind}, url string, text string, n_chars long"


def frames(pages: DataFrame) -> DataFrame:
    """host and skeleton of its page of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, tuple[bytes, str]] = {}
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                text = html.as_py()
                order = blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
                if text and (host not in least or order < least[host][0]):
                    least[host] = order, text
        rows = [(host, order, skeleton(parse(text))) for host, (order, text) in least.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.string(), pa.binary(), pa.string()), strict=True)], ["host", "order", "frame"])

    given = pages.where("html is not null").select("host", "html")
    return given.mapInArrow(run, "host string, order binary, frame string").groupBy("host").agg(F.min_by("frame", "order").alias("frame"))


class Loaded:
    """What has been read of frames and wrappers, by host; forgotten when there are too many."""

    def __init__(self, read: Callable, most: int = 1000):
        self.read, self.most, self.held = read, most, {}

    def get(self, host: str, text: str | None):
        if text is None:
            return None
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[host] = self.read(text)
        return self.held[host]


def _given(pages: DataFrame, told: DataFrame, column: str, most: int, salts: int) -> tuple[DataFrame, Callable]:
    """Pages, and how a batch of them gets ``column`` of its hosts: from one table for all tasks if it is small, else from a join."""
    if (told.agg(F.sum(F.octet_length(column))).first()[0] or 0) <= most:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r[column] for r in told.toLocalIterator()})
        return pages, lambda batch: [shared.value.get(h) for h in batch.column("host").to_pylist()]
    salt = F.pmod(F.xxhash64("html", "page_id"), F.lit(salts))
    spread = told.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return pages.withColumn("salt", salt).join(spread, ["host", "salt"], "left").drop("salt"), lambda batch: batch.column(column).to_pylist()


def wrappers(pages: DataFrame, framed: Callable, share: float = 0.7) -> DataFrame:
    """host and wrapper (JSON of slot, text and number of articles) of every host that has a template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, matcher = Loaded(frame), Matcher()
        for batch in batches:
            given = zip(batch.column("host").to_pylist(), batch.column("html"), framed(batch), strict=True)
            rows = [(host, *vote) for host, html, of in given if html.is_valid for vote in votes(html.as_py(), trees.get(host, of), matcher)]
            host, place, text, *longest = zip(*rows, strict=True) if rows else [()] * 6
            # Articles are told apart well enough by 32 bits.
            short = [pa.array([(x & 0xFFFFFFFF) - (1 << 31) for x in c], pa.int32()) for c in longest]
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(place, pa.int64()), pa.array(text, pa.int64()), *short], ["host", "place", "text", "a", "b", "c"])

    cast = pages.mapInArrow(run, "host string, place long, text long, a int, b int, c int")
    cast = written(cast.distinct(), "votes")
    counts = cast.groupBy("host", "place", "text").agg(F.count("*").alias("n")).where("n > 1")
    whole = counts.where("text = 0").select("host", "place", F.col("n").alias("all"))
    often = counts.where("text <> 0").join(whole, ["host", "place"]).where(F.col("n") >= share * F.col("all")).select("host", "place", "text", "n")
    # By each of the three longest texts: pages that have it in common, and how many there are.
    rest = cast.join(often, ["host", "place", "text"]).select("host", "place", "text", "n", F.posexplode(F.array("a", "b", "c")).alias("rank", "other"))
    groups = rest.groupBy("host", "place", "text", "n", "rank", "other").agg(F.count("*").alias("size"))
    ranks = groups.groupBy("host", "place", "text", "n", "rank").agg(F.count("*").alias("articles"), F.max("size").alias("largest")).where("2 * largest <= n")
    kept = ranks.groupBy("host", "place", "text").agg(F.max("articles").alias("articles"))
    # A host's template is no longer than its pages.
    told = kept.groupBy("host").agg(F.sort_array(F.collect_list(F.array("place", "text", "articles"))).alias("wrapper"))
    return told.select("host", F.to_json("wrapper").alias("wrapper"))


def load(wrapper: str) -> dict[tuple[int, int], int]:
    return {(place, text): n for place, text, n in json.loads(wrapper)}


def main_text(pages: DataFrame, share: float = 0.7, sure: int = 6, most: int = 32 << 20, salts: int = 32) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    hosted = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", parts(F.col("url"))[0])
    hosted, framed = _given(hosted, cut(frames(hosted)), "frame", most, salts)
    hosted, wrapped = _given(hosted, cut(wrappers(hosted, framed, share)), "wrapper", most, salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, loaded, matcher = Loaded(frame), Loaded(load), Matcher()
        for batch in batches:
            given = zip(batch.column("host").to_pylist(), batch.column("html"), framed(batch), wrapped(batch), strict=True)
            texts = [extract(html.as_py() or "", loaded.get(host, wrapper), sure, trees.get(host, of) if wrapper else None, matcher) for host, html, of, wrapper in given]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return hosted.mapInArrow(run, EXTRACTED.format(kind=kind))


def op9_pages(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
