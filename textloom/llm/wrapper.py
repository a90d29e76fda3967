"""HTML extraction by wrapper induction.

Pages of one host are made from one template or a few. Every page of the table is parsed into a DOM tree; its template
is known by the containers that it has in the upper ``TEMPLATE_DEPTH`` levels. One page of each template with
``TEMPLATE_PAGES`` distinct pages or more represents it; pages of rarer templates go with the host's most frequent one.
Every distinct page is aligned with its representative by simple tree matching (``alignment``), and each aligned text of
the representative counts the pages that have the same text there. What ``CONSTANT_SHARE`` of the pages have is constant:
the representative's tree with its constant nodes is the wrapper, all other texts are varying slots. For extraction a page
is aligned with its wrapper again; texts on constant nodes that say the same are template, everything else is content.
Copies of a page count once, pages without text not at all. A block is template when all its texts are.

Elements of raw content that close themselves end there; ones that are never closed, and menus, headers and the like that
are not, end at the next block. A form or menu that holds an article, a main or a varying ``h1`` is no chrome, nor a form
with most of the varying text of a page without these, nor a header with a varying heading inside an article.

On a page, all slots become blocks in page order; the smallest region with all of them adds nothing, so none is formed.
Template texts, and parts that elements, roles or attributes name as menus, headers, footers, asides, forms, scripts or
hidden, are left out. A class or id that names such a part is only believed where the texts agree: not of a node with
a varying ``h1``, an ``article`` or ``main``, nor, on a page without these, of one with more than ``MOST`` of its varying
text (a named comment thread excepted). Inside ``article`` or ``main`` pages may share a sentence, so there a text is
constant only if ``INNER_SHARE`` of ``INNER_PAGES`` pages and more have it.

Matching is exact for any width and depth: subtrees of equal shape match whole, scores of pairs of shapes are kept, rows
of the table are vectors, and large tables are halved (Hirschberg) so that memory is linear. Of equally large maps of a
node's children, one with most equal subtrees is taken. Parsing is linear too.

The html of a page is only moved to meet its wrapper when the wrappers' measured size is over ``BROADCAST_BYTES`` (a busy
host's pages are then split by adaptive skew joins); else wrappers are broadcast. Votes are counted in partial aggregates.

Defined results: null or empty html gives an empty text; broken html is read as far as it goes; a page about
which no other tells takes its article or main if that holds most of its text; null urls form one host (the empty name);
repeated rows are extracted each; an empty table gives an empty result; other columns pass through, and input columns
named like added ones are replaced.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.url_filter import host_of
from textloom.session import ensure_checkpoint_dir

#: Share of the distinct pages that have a constant text, and pages (of a host, of one template) that can tell.
CONSTANT_SHARE = 0.8
HOST_PAGES, TEMPLATE_PAGES = 2, 3
TEMPLATE_DEPTH = 5
#: The same inside article and main.
INNER_SHARE, INNER_PAGES = 0.9, 5
#: Share of a page's varying text that no node named as chrome by its class or id alone holds.
MOST = 0.5
BROADCAST_BYTES = 32 << 20

#: Fixed values of HTML: elements without content, with raw content, and those that end a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas audio video textarea title xmp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul caption".split()
)
PARAGRAPH = {"p"}
NOT_PARAGRAPH = BLOCK - PARAGRAPH
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}
LISTS = set("ul ol menu dl table body html".split())
CLOSES |= {"th": {"td", "th"}, "option": {"option"}}
COMMENT_WORDS = set("comment comments respond reply replies discussion disqus".split())
#: Elements, roles and words in class or id that are no main text.
CHROME_TAGS = set("footer aside button select option label input menu dialog head".split()) | RAW
#: Elements that are no main text unless they hold it, and all that end at the next block where they are never closed.
SOFT_TAGS = set("nav header form".split())
OPEN_TAGS = (CHROME_TAGS | SOFT_TAGS) - RAW - {"head"}
LISTED = LISTS | set("nav form header footer aside".split())
FOREIGN = {"svg", "math"}
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login comment comments "
    "respond reply replies discussion disqus share sharing social related recommended pagination pager toolbar skip "
    "copyright legal search hidden".split()
)

#: A tag whose attributes' quotes are paired, and one by its first ``>`` only.
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WHITE = re.compile(r"[ \t\n\r\f\v]+")


@dataclass(slots=True, eq=False)
class Node:
    """An element (``tag``) or, with ``tag`` ``#text``, a text."""

    tag: str
    label: str = ""
    chrome: bool = False
    #: A menu, header or form by its element, which text that it holds may overrule; of a root, whether it has any.
    soft: bool = False
    #: What a class or id says: "chrome", "comments" or nothing.
    named: str = ""
    text: str = ""
    children: list[Node] = field(default_factory=list)
    #: Hashes of the keys of the subtree, and of its keys and texts, and its size (``shaped``).
    shape: int = 0
    content: int = 0
    size: int = 1

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.label}" if self.label else self.tag


def parse(page: str | None) -> Node:
    """A DOM tree of a page; forgiving about what is not closed."""
    root = Node("#root")
    stack, at, page = [root], 0, page or ""
    opened: Counter[str] = Counter()  # tags on the stack, so that an end tag without a start is told at any depth
    quoted = True  # a quote that is never closed ends the pairing for the rest of the page
    begin, last = 0, page.rfind(">")
    raw = _RawEnds(page)

    def add(end: int) -> None:
        if end > begin:
            stack[-1].children.append(Node("#text", text=entities.unescape(page[begin:end])))

    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", at)
            close = page.find("-->" if comment else ">", at + 2)
            if close < 0 and not comment:
                break
            add(at)
            begin = at = close + (3 if comment else 1) if close >= 0 else len(page)
            continue
        token = None
        if at < last and (after == "/" or (after.isascii() and after.isalpha())):
            token = _QUOTED.match(page, at) if quoted else None
            if not token:
                token = _PLAIN.match(page, at)
                quoted = quoted and not token
        if not token:
            at += 1
            if at > last:
                break
            continue
        add(at)
        begin = at = token.end()
        tag = token[2].lower()
        if token[1]:
            _close(stack, opened, tag)
            continue
        closed = token[3].rstrip().endswith("/")
        if tag in BLOCK and opened.get("head"):
            _close_siblings(stack, opened, {"head"}, {"body"})
        if tag in CLOSES:
            _close_siblings(stack, opened, CLOSES[tag], LISTS)
        elif tag in BLOCK:
            _close_siblings(stack, opened, PARAGRAPH, NOT_PARAGRAPH)
        node = _element(tag, token[3])
        stack[-1].children.append(node)
        root.soft = root.soft or node.soft
        if tag in RAW:
            begin = at = raw.after(tag, at, closed)
        elif tag not in VOID and not closed:
            stack.append(node)
            opened[tag] += 1
    add(len(page))
    _cut_at(stack, opened, 1, own=False)
    return root


_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)


class _RawEnds:
    """Where elements with raw content end; each kind's tags are searched once along the page."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.known: dict[str, tuple[int, int]] = {}

    def _next(self, pattern: str, at: int) -> tuple[int, int]:
        """Start and end of the next place of a pattern; the end of the page twice if there is none."""
        found = self.known.get(pattern, (-1, -1))
        if found[0] < at:
            match = _compiled(pattern).search(self.page, at)
            self.known[pattern] = found = match.span() if match else (len(self.page),) * 2
        return found

    def after(self, tag: str, at: int, closed: bool) -> int:
        """Where an element whose start tag ends at ``at`` ends.

        One that closes itself (``/>``) has no content if it is foreign or no end tag of its own follows; one that is never
        closed ends at the next block.
        """
        if closed and tag in FOREIGN:
            return at
        start, end = self._next(rf"</{re.escape(tag)}\s*>", at)
        if closed and (start == len(self.page) or self._next(rf"<{re.escape(tag)}(?=[\s/>])", at)[0] < start):
            return at
        return end if start < len(self.page) else self._next(_NEXT_BLOCK.pattern, at)[0]


@lru_cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


def _cut_at(stack: list[Node], opened: Counter[str], depth: int, own: bool = True) -> None:
    """Close what is open from ``depth`` on; all but the first (``own``) have no end tag.

    A menu, header or the like without one ends at its first block that is no list; it and what follows become a plain
    block.
    """
    for node in stack[depth:]:
        opened[node.tag] -= 1
    for node in stack[depth + own :]:
        if node.tag in OPEN_TAGS:
            cut = next((i for i, c in enumerate(node.children) if c.tag in BLOCK and c.tag not in LISTED), len(node.children))
            if cut < len(node.children):
                part = replace(node, children=node.children[:cut])
                node.tag, node.chrome, node.soft, node.named = "div", False, False, ""
                node.children[:cut] = [part]
    del stack[depth:]


def _close(stack: list[Node], opened: Counter[str], tag: str) -> None:
    if not opened.get(tag):
        return
    if stack[-1].tag == tag:
        opened[tag] -= 1
        stack.pop()
        return
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            _cut_at(stack, opened, depth)
            return
        if stack[depth].tag in BLOCK and tag not in BLOCK:
            return


def _close_siblings(stack: list[Node], opened: Counter[str], tags: set[str], stop: set[str]) -> None:
    for tag in tags:
        if opened.get(tag):
            break
    else:
        return
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in stop:
            return
        if stack[depth].tag in tags:
            _cut_at(stack, opened, depth)
            return


def _element(tag: str, attributes: str) -> Node:
    label, chrome, named = _told(tag, attributes) if len(attributes) <= TOLD_CHARS else _told.__wrapped__(tag, attributes)
    return Node(tag, label, chrome, tag in SOFT_TAGS, named)


#: Start tags that a task remembers, and the most characters of their attributes.
TOLD, TOLD_CHARS = 1 << 14, 256


@lru_cache(TOLD)
def _told(tag: str, attributes: str) -> tuple[str, bool, str]:
    """What a start tag says: its label, whether it is chrome, and what a class or id names it; pages repeat their tags."""
    label, chrome, named = "", tag in CHROME_TAGS, ""
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, value in _NAME.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                chrome |= value in CHROME_ROLES
            elif name == "hidden" or name == "aria-hidden":
                chrome |= value in ("", "true", "hidden")
            else:
                if name == "class":
                    label = value.split()[0] if value.split() else ""
                if tag not in ("html", "body", "article", "main"):
                    words = set(re.split(r"[^a-z]+", value))
                    if words & CHROME_WORDS:
                        named = "comments" if named == "comments" or words & COMMENT_WORDS else "chrome"
    return label, chrome, named


def _white(text: str) -> str:
    return " ".join(text.split())


def shaped(root: Node) -> Node:
    """The tree with ``shape``, ``content`` and ``size`` of every subtree."""
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in reversed(order):
        node.shape = hash((node.tag, node.label, *[c.shape for c in node.children]))
        node.content = hash((node.shape, node.text, *[c.content for c in node.children]))
        node.size = 1 + sum(c.size for c in node.children)
    return root


#: Cells of a table of two lists of children that is kept as a whole; scores of pairs of shapes that are kept.
CELLS, SCORES = 1 << 20, 1 << 17
_scores: dict[tuple[int, int], int] = {}


def _ends(left: list[int], right: list[int]) -> tuple[int, int]:
    """How many children at the front and at the back have equal hashes; these match in a largest map."""
    most = min(len(left), len(right))
    head = 0
    while head < most and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < most - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    return head, tail


def _known(a: Node, b: Node) -> int | None:
    if a.tag != b.tag or a.label != b.label:
        return 0
    return a.size if a.shape == b.shape else _scores.get((a.shape, b.shape))


class _Table:
    """Scores of two lists of children by their distinct shapes; ``texts``: of largest maps, one with most equal texts."""

    def __init__(self, left: list[Node], right: list[Node], texts: bool = False) -> None:
        self.left, self.right = left, right
        self.unit = min(len(left), len(right)) + 1 if texts else 1
        self.contents = np.array([n.content for n in right]) if texts else None
        kinds = {n.shape: n for n in right}
        number = {shape: i for i, shape in enumerate(kinds)}
        self.kinds, self.at = list(kinds.values()), np.array([number[n.shape] for n in right])
        self.rows: dict[int, np.ndarray] = {}

    def missing(self) -> list[tuple[Node, Node]]:
        """Pairs whose score is not known yet."""
        return [(x, y) for x in {n.shape: n for n in self.left}.values() for y in self.kinds if _known(x, y) is None]

    def row(self, i: int) -> np.ndarray:
        shape = self.left[i].shape
        if shape not in self.rows:
            self.rows[shape] = self.unit * np.array([_known(self.left[i], y) for y in self.kinds])[self.at]
        row = self.rows[shape]
        return row if self.contents is None else row + (self.contents == self.left[i].content)

    def best(self, rows: range, lo: int, hi: int, back: bool = False, keep: bool = False) -> np.ndarray:
        """Best scores of the children ``rows`` with each front (``back``: each rear) of ``lo:hi``; ``keep``: after each row."""
        now, kept = np.zeros(hi - lo + 1, dtype=np.int64), []
        for i in rows:
            score = self.row(i)[lo:hi]
            step = now.copy()
            np.maximum(step[1:], now[:-1] + (score[::-1] if back else score), out=step[1:])
            now = np.maximum.accumulate(step)
            if keep:
                kept.append(now)
        return np.array([np.zeros(hi - lo + 1, dtype=np.int64), *kept]) if keep else now

    def pairs(self) -> list[tuple[Node, Node]]:
        """Matched children of a largest map; large tables are halved."""
        found, parts = [], [(0, len(self.left), 0, len(self.right))]
        while parts:
            top, bottom, lo, hi = parts.pop()
            if top == bottom or lo == hi:
                continue
            if (bottom - top) * (hi - lo) > CELLS and bottom - top > 1:
                middle = (top + bottom) // 2
                front = self.best(range(top, middle), lo, hi)
                rear = self.best(range(bottom - 1, middle - 1, -1), lo, hi, back=True)[::-1]
                cut = lo + int((front + rear).argmax())
                parts += [(top, middle, lo, cut), (middle, bottom, cut, hi)]
                continue
            size = self.best(range(top, bottom), lo, hi, keep=True)
            i, j = bottom - top, hi - lo
            while i and j:
                if size[i][j] == size[i - 1][j]:
                    i -= 1
                elif size[i][j] == size[i][j - 1]:
                    j -= 1
                else:
                    found.append((self.left[top + i - 1], self.right[lo + j - 1]))
                    i, j = i - 1, j - 1
        return found


def similarity(a: Node, b: Node) -> int:
    """Simple tree matching: the size of the largest order-preserving map between two shaped trees with equal roots."""
    waiting = [(a, b)]
    while waiting:
        x, y = waiting[-1]
        if _known(x, y) is not None:
            waiting.pop()
            continue
        head, tail = _ends([c.shape for c in x.children], [c.shape for c in y.children])
        left, right = x.children[head : len(x.children) - tail], y.children[head : len(y.children) - tail]
        ends = [*x.children[:head], *x.children[len(x.children) - tail :]]
        total = 1 + sum(n.size for n in ends)
        if left and right:
            table = _Table(left, right)
            if missing := table.missing():
                waiting += missing
                continue
            total += int(table.best(range(len(left)), 0, len(right))[-1])
        _scores[x.shape, y.shape] = total
        waiting.pop()
    return _known(a, b)


def alignment(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of nodes of a largest map between two shaped trees."""
    if len(_scores) > SCORES:
        _scores.clear()
    if not similarity(a, b):
        return []
    pairs = [(a, b)]
    for x, y in pairs:
        if x.shape == y.shape:
            head, tail = len(x.children), 0
        else:
            head, tail = _ends([c.content for c in x.children], [c.content for c in y.children])
        n, m = len(x.children) - tail, len(y.children) - tail
        pairs += zip(x.children[:head], y.children[:head], strict=True)
        pairs += zip(x.children[n:], y.children[m:], strict=True)
        if head < n and head < m:
            table = _Table(x.children[head:n], y.children[head:m], True)
            for p, q in table.missing():
                similarity(p, q)
            pairs += table.pairs()
    return pairs


def _crc(key: str, above: int) -> int:
    return zlib.crc32(f"/{key}".encode(), above)


def _paths(node: Node) -> Iterator[tuple[Node, int, int, bool]]:
    """Nodes in page order with the hash of their path, their depth and whether they are inside article or main."""
    stack = [(node, 0, 0, False)]
    while stack:
        node, path, depth, inner = stack.pop()
        path, inner = _crc(node.key, path), inner or node.tag in ("article", "main")
        yield node, path, depth, inner
        stack.extend((child, path, depth + 1, inner) for child in reversed(node.children))


#: Elements that build a template, not the text in it.
CONTAINERS = set("article aside body center details dialog div fieldset footer form header html main nav section table".split())


def template_of(root: Node) -> int:
    """The template of a page; -1 for a page without text."""
    shape, text = set(), False
    for node, path, depth, inner in _paths(root):
        if node.tag == "#text":
            text = text or bool(node.text.strip())
        elif node.tag in CONTAINERS and depth <= TEMPLATE_DEPTH and (not inner or node.tag in ("article", "main")):
            shape.add(path)
    return zlib.crc32(",".join(map(str, sorted(shape))).encode()) if text else -1


@dataclass
class Wrapper:
    """A representative page, its texts in page order, and which of them are constant."""

    root: Node
    texts: list[Node]
    inner: list[bool]
    constant: set[int] = field(default_factory=set)

    @classmethod
    def of(cls, page: str | None) -> Wrapper:
        root = shaped(parse(page))
        told = [(node, inner) for node, _, _, inner in _paths(root) if node.tag == "#text"]
        return cls(root, [t[0] for t in told], [t[1] for t in told])

    def same(self, page: Node) -> dict[int, int]:
        """Of the page's texts (by ``id``) that say what their aligned text says: the number of that one."""
        number = {id(node): i for i, node in enumerate(self.texts)}
        found = {}
        for x, y in alignment(self.root, shaped(page)):
            if x.tag == "#text" and (x.text == y.text or _white(x.text) == _white(y.text)):
                found[id(y)] = number[id(x)]
        return found

    def learn(self, pages: int, votes: list[tuple[int, int]]) -> Wrapper:
        """Constant texts by the pages that have the same text there."""
        for number, n in votes:
            share = n >= INNER_SHARE * pages and pages >= INNER_PAGES if self.inner[number] else n >= CONSTANT_SHARE * pages
            if share:
                self.constant.add(id(self.texts[number]))
        return self


class _Weights:
    """Nodes outside of chrome, parents first: the varying text in each, and how many articles, mains and varying ``h1``."""

    def __init__(self, root: Node, varies: dict[int, bool]) -> None:
        self.nodes, self.parent = [root], [-1]
        for i, node in enumerate(self.nodes):
            if not node.chrome and node.children:
                self.nodes.extend(node.children)
                self.parent.extend([i] * len(node.children))
        self.mass, self.heads = [0] * len(self.nodes), [0] * len(self.nodes)
        for i in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[i]
            if node.chrome:
                continue
            if node.tag == "#text":
                if varies[id(node)]:
                    self.mass[i] = len(_white(node.text))
            elif node.tag in ("article", "main") or (node.tag == "h1" and self.mass[i]):
                self.heads[i] += 1
            if i:
                self.mass[self.parent[i]] += self.mass[i]
                self.heads[self.parent[i]] += self.heads[i]

    def below(self, tags: tuple[str, ...], varying: bool = False) -> list[bool]:
        """Which nodes are or hold an element of these tags, with varying text."""
        found = [n.tag in tags and (not varying or m > 0) for n, m in zip(self.nodes, self.mass, strict=True)]
        for i in range(len(found) - 1, 0, -1):
            if found[i]:
                found[self.parent[i]] = True
        return found

    def soft_chrome(self) -> set[int]:
        """Menus, headers and forms that are left out; what is in them counts no more.

        Text overrules the element: a menu or form with an article, a main or a varying ``h1``; a form with most of the
        varying text of a page that has none of these; a header inside an article or main that has a varying heading (of
        three levels).
        """
        inner, gone = [False] * len(self.nodes), [False] * len(self.nodes)
        articles = headings = None
        found: set[int] = set()
        for i, node in enumerate(self.nodes):
            above = self.parent[i]
            if i:
                inner[i], gone[i] = inner[above] or self.nodes[above].tag in ("article", "main"), gone[above]
            if not node.soft or not i or gone[i]:
                continue
            if node.tag == "header":
                articles = articles or self.below(("article", "main"))
                headings = headings or self.below(("h1", "h2", "h3"), varying=True)
                kept = articles[i] or (inner[i] and headings[i])
            else:
                most = node.tag == "form" and not self.heads[0] and self.mass[i] > MOST * self.mass[0]
                kept = self.heads[i] > 0 or most
            if not kept:
                gone[i] = True
                found.add(i)
        if found:
            less, fewer = [0] * len(self.nodes), [0] * len(self.nodes)
            for i in range(len(self.nodes) - 1, 0, -1):
                if i in found:
                    less[i], fewer[i] = self.mass[i], self.heads[i]
                less[self.parent[i]] += less[i]
                fewer[self.parent[i]] += fewer[i]
            self.mass = [m - x if not g else 0 for m, x, g in zip(self.mass, less, gone, strict=True)]
            self.heads = [h - x if not g else 0 for h, x, g in zip(self.heads, fewer, gone, strict=True)]
        return found


def _cut(root: Node, varies: dict[int, bool]) -> tuple[set[int], Node]:
    """Nodes (by ``id``) that are left out with all they hold; the article or main with most of the varying text, or the root."""
    found = _Weights(root, varies)
    chrome = found.soft_chrome() if root.soft else set()
    mass, heads = found.mass, found.heads
    left_out, top = set(), root
    for i, node in enumerate(found.nodes):
        if node.chrome or i in chrome:
            left_out.add(id(node))
        elif node.named and not heads[i]:
            # a page with a heading or article elsewhere may have an advert that is longer than its text
            if node.named == "comments" or heads[0] or mass[i] <= MOST * mass[0]:
                left_out.add(id(node))
        if node.tag in ("article", "main") and mass[i] > MOST * mass[0]:
            top = node
    return left_out, top


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page, by the wrapper of its template."""
    root = parse(page)
    nodes = [root]
    for node in nodes:
        nodes.extend(node.children)
    same = {id(node): False for node in nodes if node.tag == "#text"}
    if wrapper and wrapper.constant:
        same |= {at: id(wrapper.texts[number]) in wrapper.constant for at, number in wrapper.same(root).items()}
    constant = any(same.values())
    left_out, top = _cut(root, {k: not v for k, v in same.items()})
    blocks: list[str] = []
    run: list[tuple[str, bool]] = []

    def flush() -> None:
        # a block is template only if all its texts are: constant words in a varying sentence belong to the sentence
        if not all(template for text, template in run if text.strip()):
            blocks.append(_WHITE.sub(" ", "".join(text for text, _ in run)).strip(" "))
        run.clear()

    # each entry is a node, or None where a block ends
    stack: list[Node | None] = [top if not constant else root]
    while stack:
        node = stack.pop()
        if node is None or id(node) in left_out:
            flush()
        elif node.tag == "#text":
            run.append((node.text, same[id(node)]))
        elif node.tag == "br":
            run.append((" ", True))
        else:
            if node.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(node.children))
    flush()
    return "\n\n".join(blocks)


_MADE = 256  # wrappers that a task keeps made


def wrappers(hosted: DataFrame, page: str = "html") -> tuple[DataFrame, DataFrame]:
    """Which pages go with which representative, and the wrappers.

    The first: ``host, page, rep`` (hashes) for each distinct page of ``hosted`` (``host`` and the html). The second:
    ``host, rep, wrapper_html, pages, votes`` for each representative.
    """
    digest = F.xxhash64(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template_of(parse(p)) for p in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "template"])

    told = hosted.select("host", digest.alias("page"), page).mapInArrow(run, "host string, page long, template long")
    told = told.filter("template >= 0").distinct().checkpoint()
    kinds = told.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("rep")).checkpoint()
    hosts = kinds.groupBy("host").agg(F.max_by("rep", F.struct("n", "template")).alias("main"), F.sum("n").alias("all")).checkpoint()
    of = kinds.join(hosts, "host").filter(F.col("all") >= HOST_PAGES)
    of = of.select("host", "template", F.when(F.col("n") >= TEMPLATE_PAGES, F.col("rep")).otherwise(F.col("main")).alias("rep")).checkpoint()
    pages = told.join(of, ["host", "template"]).select("host", "page", "rep").checkpoint()
    reps = of.select("host", "rep").distinct()
    made = hosted.select("host", digest.alias("rep"), F.col(page).alias("wrapper_html")).join(_shared(reps, 16), ["host", "rep"])
    made = made.dropDuplicates(["host", "rep"]).checkpoint()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {}
        for batch in batches:
            same = []
            for own, other in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if other not in known:
                    if len(known) >= _MADE:
                        known.clear()
                    known[other] = Wrapper.of(other)
                same.append(sorted(known[other].same(parse(own)).values()))
            arrays = [*(batch.column(k) for k in range(3)), pa.array(same, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "rep", "page", "same"])

    met = _met(hosted.select("host", digest.alias("page"), F.col(page).alias("html")), pages, made)
    votes = met.select("host", "rep", "page", "html", "wrapper_html").mapInArrow(vote, "host string, rep long, page long, same array<int>")
    # copies of a page count once
    votes = votes.groupBy("host", "rep", "page").agg(F.first("same").alias("same"))
    votes = votes.select("host", "rep", F.explode("same").alias("node")).groupBy("host", "rep", "node").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("host", "rep").agg(F.count(F.lit(1)).alias("pages")).checkpoint()
    votes = votes.join(sizes, ["host", "rep"]).filter(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    votes = votes.groupBy("host", "rep", "pages").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("votes"))
    return pages, made.join(votes, ["host", "rep"]).checkpoint()


def _shared(table: DataFrame, width: int) -> DataFrame:
    """A table for a join: broadcast if its measured size allows."""
    return F.broadcast(table) if table.count() * width <= BROADCAST_BYTES else table


def _met(hosted: DataFrame, pages: DataFrame, made: DataFrame, how: str = "inner") -> DataFrame:
    """Pages (``host, page``) with their wrapper's columns; small tables go to all tasks."""
    size = made.agg(F.sum(F.length("host") + F.length("wrapper_html") + 64)).first()[0] or 0
    told = hosted.join(_shared(pages.withColumnRenamed("host", "__h").withColumnRenamed("page", "__p"), 64),
                       (F.col("host") == F.col("__h")) & (F.col("page") == F.col("__p")), how)
    told = told.drop("__h", "__p")
    made = made.withColumnRenamed("host", "__h").withColumnRenamed("rep", "__r")
    met = told.join(F.broadcast(made) if size <= BROADCAST_BYTES else made, (F.col("host") == F.col("__h")) & (F.col("rep") == F.col("__r")), how)
    return met.drop("__h", "__r")


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` without the html, with ``host, text, n_chars``."""
    ensure_checkpoint_dir(pages.sparkSession)
    own = pages.drop(*({"host", "text", "n_chars"} - {key, url, page}))
    kept = [c for c in own.columns if c != page]
    row = "row"
    plain = own.select(F.struct(*kept).alias(row), F.coalesce(F.col(page), F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    told, made = wrappers(plain.select("host", "html"))
    joined = _met(plain.withColumn("page", F.xxhash64("html")), told, made, "left")
    joined = joined.select(row, "host", "html", "wrapper_html", "pages", "votes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper | None] = {None: None}
        for batch in batches:
            texts = []
            for html, rep, n, votes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if rep not in known:
                    if len(known) >= _MADE:
                        known = {None: None}
                    known[rep] = Wrapper.of(rep).learn(n, [(v["node"], v["n"]) for v in votes])
                texts.append(extract(html, known[rep]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[row, "host", "text", "n_chars"],
            )

    schema = joined.select(row, "host", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    found = joined.mapInArrow(run, schema)
    return found.select(*[F.col(row)[c].alias(c) for c in kept], *[c for c in ("host", "text", "n_chars") if c not in kept])


def op9_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
