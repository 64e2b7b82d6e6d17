"""Main text of web pages by wrapper induction.

Induce (``induce``), from all pages of every host:

1. Each page is parsed into a DOM tree; the set of its container paths outside
   article and main is its layout.  Pages are counted by host and layout, equal
   pages of a host as one.
2. A host's layouts with ``LAYOUT_SHARE`` of its pages and ``CONSTANT_PAGES`` at
   least, or else its most frequent one, have one page each (smallest hash of
   ``page_id`` and ``url``) as skeleton.
3. Every page is aligned by simple tree matching with the skeleton whose
   container paths are nearest to its own, and what the skeleton's nodes hold
   is counted: pages, text mass, and pages by digest of the text.

Nodes that align in ``TEMPLATE_SHARE`` of the pages form the template.  A
template node whose text is the same in ``CONSTANT_SHARE`` of them is
boilerplate; where the texts vary is a slot.  The content root is the template
node that holds most of the varying text outside regions that are never content
(``nav``, ``footer``, ``form``, hidden nodes, ...).  A class or id that names such a
region (``sidebar``, ``comments``, ...) is weak evidence only (``close_named``):
it never closes what holds the largest article or main element or ``MOST`` of
the varying text, alone or with its equal siblings.

Extract (``extract``): every page is parsed whole and aligned with the nearest
template of its host; the text below the node matched with the content root is the main
text, without constant template text and never-content regions.  A host whose
pages do not align, or a page that does not match, falls back to its own tree
(article, main or body).

Templates are one row per host.  They are joined by broadcast while they
are smaller than ``BROADCAST_BYTES`` in all, and beyond that by a salted
shuffle; either way a host with a third of all pages is spread.

Blocks are joined by two line feeds; white space in a block becomes one space;
character references are decoded.  Nothing else is dropped or cut.

Siblings are aligned in runs: neighbours with equal keys (list items, rows) form
a run, and of two runs that align, the items align in their order.  Runs that
are equal from the front and from the back align first; what is left between
them is aligned by dynamic programming, in pieces of ``PIECE`` runs.  So a list
of any length costs time in proportion.  No step recurses: pages may nest as
deep as they like.

Edge cases: null or empty html gives the empty text; a null url is a host of
its own; broken markup closes what it left open; repeated rows are extracted
one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import chunks, materialise

#: Share of a host's pages from which a layout has a skeleton of its own.
LAYOUT_SHARE = 0.01
#: Shares of the pages that a template node, and a constant text, must be in,
#: and the fewest pages from which a text counts as constant.
TEMPLATE_SHARE, CONSTANT_SHARE, CONSTANT_PAGES = 0.6, 0.9, 5
BROADCAST_BYTES = 32 << 20
SALT = 64
#: Runs of siblings that one dynamic programme aligns; kinds of start tags a task remembers.
PIECE, KNOWN = 256, 20_000

#: Share of the varying text that keeps a node open in spite of its name, and
#: beside an article or main element without such names.
MOST, MOST_BESIDE = 0.5, 0.8

#: Tags that are never content, and names that hint at it (fixed values).
NEVER = set("head title nav footer aside form script style noscript template button select option svg iframe object canvas textarea label dialog menu".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"} | {"nav", "footer", "aside", "form", "menu"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
NEVER_TOKENS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription paywall menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar related recommended "
    "recommendations share sharing social comment comments commentlist respond reply replies disqus widget widgets pagination pager login search signup".split()
)
NEVER_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "alert", "dialog", "menu", "menubar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAVES = HEADINGS | {"p", "li", "pre", "blockquote", "td", "dd", "dt"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """``never`` holds by tag, role or hiding; ``named``: by class or id only;
    ``within``: in an article or main element, or one itself."""

    __slots__ = ("tag", "key", "never", "named", "within", "children", "parent")

    def __init__(self, tag: str, key: str, never: bool, parent: "Node | None", named: bool = False, within: bool = False):
        self.tag, self.key, self.never, self.named, self.within, self.parent, self.children = tag, key, never, named, within, parent, []


def _attributes(source: str) -> dict[str, str]:
    return {m.group(1).lower(): entities.unescape((m.group(2) or "").strip("\"'")) for m in _ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _kind(tag: str, source: str) -> tuple[str, bool, bool]:
    """(key, never, named) of a start tag."""
    a = _attributes(source)
    names = f"{a.get('class', '')} {a.get('id', '')}"
    never = tag in NEVER or a.get("role", "").lower() in NEVER_ROLES or "hidden" in a or a.get("aria-hidden") == "true"
    never = never or "display:none" in a.get("style", "").replace(" ", "").lower()
    named = tag not in ("html", "body") and any(t.lower() in NEVER_TOKENS for t in _NAME.findall(names))
    key = f"{tag}.{' '.join(sorted(a['class'].split()))}" if "class" in a and tag not in ("html", "body") else tag
    return key, never, named


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def parse(source: str, known: dict | None = None) -> Node:
    """The page's tree; text is kept as strings among the children.  ``known``
    keeps what start tags mean, for all pages of a task."""
    known = {} if known is None else known
    root = Node("#page", "#page", False, None)
    path: list[Node] = [root]  # the open elements
    opened: dict[str, list[int]] = defaultdict(list)  # their places in the path, by tag
    done = 0

    def close(depth: int) -> None:
        while len(path) > depth:
            opened[path.pop().tag].pop()

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    for m in iter(_scanner(source).next_token, None):
        if m.start() > done:
            path[-1].children.append(source[done : m.start()])
        done = m.end()
        slash, tag, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag, rest = tag.lower(), rest or ""
        if slash:
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag in CLOSES_P and opened.get("p"):
            close(opened["p"][-1])
        if tag in SAME_LEVEL:
            scope = last(SCOPES[tag])
            found = [places for t in SAME_LEVEL[tag] if (places := opened.get(t)) and places[-1] > scope]
            if found:
                # a row closes all cells and rows up to its table, others only the nearest of their kind
                close(min(p[bisect_right(p, scope)] for p in found) if tag == "tr" else max(p[-1] for p in found))
        if (kind := known.get((tag, rest))) is None:
            kind = _kind(tag, rest)
            if len(rest) < 256:
                if len(known) >= KNOWN:
                    known.clear()
                known[tag, rest] = kind
        key, never, named = kind
        at = path[-1]
        node = Node(tag, key, never or tag == "header" and not at.within, at, named, at.within or tag in ("article", "main"))
        at.children.append(node)
        if tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        opened[tag].append(len(path))
        path.append(node)
    if done < len(source):
        path[-1].children.append(source[done:])
    return root


class _scanner:
    """Tokens of a page; the text of script-like elements is skipped."""

    def __init__(self, source: str):
        self.source, self.at, self.until = source, 0, None

    def next_token(self):
        if self.until is not None:
            m = re.compile(rf"</{self.until}(?=[\s/>])", re.I).search(self.source, self.at)
            self.at, self.until = (m.start() if m else len(self.source)), None
        m = _TOKEN.search(self.source, self.at)
        if m is None:
            return None
        self.at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if tag in RAW and not (m.group(1) or m.group(4)):
            self.until = re.escape(tag)
        return m


def own_text(node: Node) -> str:
    return " ".join(entities.unescape(" ".join(c for c in node.children if isinstance(c, str))).split())


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


def _runs(children: list) -> list[list]:
    """Neighbours with equal keys, together."""
    out: list[list] = []
    for c in children:
        if out and out[-1][0].key == c.key:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def _aligned_runs(a: list[list], b: list[list]):
    """Pairs of runs that align, with the matches of their items; asks for the
    match of two nodes by yielding them."""

    def items(x: list, y: list):
        found = []
        for p, q in zip(x, y, strict=False):
            found.append((yield p, q))
        return sum(w for w, _ in found), found

    front = 0
    while front < min(len(a), len(b)) and a[front][0].key == b[front][0].key:
        front += 1
    back = 0
    while back < min(len(a), len(b)) - front and a[-1 - back][0].key == b[-1 - back][0].key:
        back += 1
    out = []
    for x, y in zip(a[:front], b[:front], strict=True):
        out.append((yield from items(x, y)))
    a_mid, b_mid = a[front : len(a) - back], b[front : len(b) - back]
    pieces = -(-max(len(a_mid), len(b_mid)) // PIECE) if a_mid and b_mid else 0
    for k in range(pieces):
        left, right = (m[len(m) * k // pieces : len(m) * (k + 1) // pieces] for m in (a_mid, b_mid))
        rows, inner = [[0] * (len(right) + 1)], {}
        for i, x in enumerate(left):
            row = [0]
            for j, y in enumerate(right):
                best = max(rows[i][j + 1], row[j])
                if x[0].key == y[0].key:
                    inner[i, j] = yield from items(x, y)
                    best = max(best, rows[i][j] + inner[i, j][0])
                row.append(best)
            rows.append(row)
        chosen, i, j = [], len(left), len(right)
        while i and j:
            if (i - 1, j - 1) in inner and rows[i][j] == rows[i - 1][j - 1] + inner[i - 1, j - 1][0]:
                chosen.append(inner[i - 1, j - 1])
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        out += reversed(chosen)
    for x, y in zip(a[len(a) - back :], b[len(b) - back :], strict=True):
        out.append((yield from items(x, y)))
    return out


def simple_tree_matching(a, b, kids_a, kids_b) -> tuple[int, list]:
    """The number of node pairs that align two ordered trees top-down, and the
    pairs in page order; nodes align when their keys (tag and class) are equal."""
    if a.key != b.key:
        return 0, []

    def match(x, y):
        found = yield from _aligned_runs(_runs(kids_a(x)), _runs(kids_b(y)))
        return 1 + sum(w for w, _ in found), (x, y, found)

    # the calls wait on a stack of their own, which may be as deep as the pages
    stack, value = [match(a, b)], None
    while stack:
        try:
            asked = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(match(*asked))
            value = None
    size, tree = value
    pairs, todo = [], [tree]
    while todo:
        x, y, found = todo.pop()
        pairs.append((x, y))
        todo += [t for _, items in reversed(found) for _, t in reversed(items)]
    return size, pairs


def container_paths(page: Node) -> frozenset[int]:
    """Hashes of the key paths of block elements outside leaves, article, main
    and regions that are never content."""
    out, stack = set(), [(page, 0)]
    while stack:
        x, above = stack.pop()
        for c in elements(x):
            if c.never or c.tag in LEAVES or c.tag not in BLOCKS | {"article", "main"}:
                continue
            content = c.tag in ("article", "main")
            path = zlib.crc32(f"/{c.tag if content else c.key}".encode(), above)
            out.add(path)
            if not content:
                stack.append((c, path))
    return frozenset(out)


def layout(paths: frozenset[int]) -> int:
    return int.from_bytes(hashlib.blake2b(",".join(map(str, sorted(paths))).encode(), digest_size=8).digest(), "big", signed=True)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Slot:
    """A template node: how many pages have it, the digest of its text while
    constant, and the varying text mass below it."""

    __slots__ = ("key", "tag", "never", "named", "children", "number", "pages", "text", "mass", "root")

    def __init__(self, key: str, tag: str, never: bool, named: bool):
        self.key, self.tag, self.never, self.named = key, tag, never, named
        self.children, self.number, self.pages, self.text, self.mass, self.root = [], 0, 0.0, None, 0.0, False


class Skeleton:
    """The nodes of a layout's page as slots, numbered in page order."""

    def __init__(self, packed: dict):
        self.paths, self.slots = frozenset(packed["p"]), []
        for number, (key, never, named, parent) in enumerate(packed["s"]):
            slot = Slot(key, key.split(".", 1)[0], never, named)
            slot.number = number
            self.slots.append(slot)
            if parent is not None:
                self.slots[parent].children.append(slot)
        self.top = self.slots[0]


def _in_order(top, kids) -> list[tuple[object, int | None]]:
    """(node, number of its parent) of a tree in page order."""
    out, stack = [], [(top, None)]
    while stack:
        x, parent = stack.pop()
        out.append((x, parent))
        stack += [(c, len(out) - 1) for c in reversed(kids(x))]
    return out


def _outline(page: Node) -> list:
    # a paragraph's own elements are content, never template
    return [[x.key, x.never, x.named, parent] for x, parent in _in_order(page, lambda x: [] if x.tag in LEAVES else elements(x))]


def skeleton(source: str) -> str:
    page = parse(source)
    return json.dumps({"p": sorted(container_paths(page)), "s": _outline(page)})


def nearest(page: Node, layouts: list):
    """The layout that shares most container paths with the page."""
    if len(layouts) == 1:
        return layouts[0]
    paths = container_paths(page)
    return max(layouts, key=lambda x: len(paths & x.paths) / max(1, len(paths | x.paths)))


def text_of(node: Node) -> str:
    """What may be constant: a leaf's whole text, another node's own text."""
    return _inside(node) if node.tag in LEAVES else own_text(node)


def _masses(page: Node, skip: set[int] = frozenset()) -> dict[int, int]:
    """Text mass by node id; nodes that are never content, and the own text of
    nodes in ``skip``, have none."""
    out: dict[int, int] = {}
    stack = [(page, False)]
    while stack:
        x, done = stack.pop()
        if x.never:
            out[id(x)] = 0
        elif done:
            own = 0 if id(x) in skip else sum(len(c) for c in x.children if isinstance(c, str))
            out[id(x)] = own + sum(out[id(c)] for c in elements(x))
        else:
            stack.append((x, True))
            stack += [(c, False) for c in elements(x)]
    return out


def _inside(node: Node) -> str:
    """All text below ``node``."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def close_named(top, kids, mass, decided: dict[int, bool] | None = None) -> None:
    """Make the named nodes ``never`` that are no content.  Open stay the largest
    article or main element and what is around it, and nodes that hold most of
    the text, alone or with their siblings of the same key.  ``decided`` by node
    id comes first."""
    path, best, clean = [], (0, None, True), 0
    stack = [(top, (), True)]
    while stack:
        x, above, plain = stack.pop()
        if x.never:
            continue
        above, plain = (x, above), plain and not x.named
        if x.tag in ("article", "main") and mass(x):
            clean = max(clean, mass(x)) if plain else clean
            if mass(x) > best[0]:
                best, path = (mass(x), x, plain), above
        stack += [(c, above, plain) for c in reversed(kids(x))]
    around = set()
    while path:
        around.add(id(path[0]))
        path = path[1]
    total = mass(top)
    limit = MOST_BESIDE if clean >= (1 - MOST_BESIDE) * total else MOST
    stack = [top]
    while stack:
        x = stack.pop()
        pooled: dict[str, int] = {}
        for c in kids(x):
            if c.named and not c.never:
                pooled[c.key] = pooled.get(c.key, 0) + mass(c)
        for c in kids(x):
            if c.named and not c.never:
                small = id(c) not in around and not (total and pooled[c.key] >= limit * total)
                c.never = (decided or {}).get(id(c), small)
            if not c.never:
                stack.append(c)


def _kids(slot: Slot) -> list[Slot]:
    return slot.children


def measure(top: Slot, page: Node) -> list[tuple[int, int, int, int | None]]:
    """(slot number, text mass, mass below that aligns with nothing, digest of a
    text that may be constant) of the slots that a page has."""
    pairs = simple_tree_matching(top, page, _kids, elements)[1]
    mass, aligned, out = _masses(page), {id(node) for _, node in pairs}, []
    for slot, node in pairs:
        text, closed = text_of(node), id(node) not in mass or node.never
        loose = 0 if closed or node.tag in LEAVES else sum(mass[id(c)] for c in elements(node) if id(c) not in aligned)
        free = text and not node.within
        out.append((slot.number, 0 if closed else len(text), loose, digest(text) if free else None))
    return out


def learn(skeletons: list[str], counted: list[dict]) -> str:
    """The templates of a host as JSON, from its skeletons and what all its
    pages have in their slots."""
    out = []
    for number, packed in enumerate(skeletons):
        found = Skeleton(json.loads(packed))
        facts = {c["slot"]: c for c in counted if c["layout"] == number}
        if 0 not in facts or facts[0]["pages"] < 1.5:
            continue
        n = facts[0]["pages"]
        for slot in reversed(found.slots):  # children first
            c = facts.get(slot.number)
            if c is not None:
                slot.pages = c["pages"]
                if (c["same"] or 0) >= max(CONSTANT_PAGES, CONSTANT_SHARE * n) - 1e-6:
                    slot.text = c["text"]
                slot.mass = c["loose"] + (0 if slot.text is not None else c["own"])
            slot.mass = 0 if slot.never else slot.mass + sum(x.mass for x in slot.children)
        out.append({"p": sorted(found.paths), "s": _template(found.top, n)})
    return json.dumps(out)


def _template(template: Slot, n: float) -> list:
    stack = [template]
    while stack:
        x = stack.pop()
        x.children = [c for c in x.children if c.pages >= TEMPLATE_SHARE * n - 1e-6]
        stack += x.children
    close_named(template, _kids, lambda x: x.mass)
    open_slots = [x for x, _ in _in_order(template, lambda x: [c for c in x.children if not c.never])]
    everywhere = [x for x in open_slots if x.tag in ("article", "main") and not x.never]
    at = max(everywhere, key=lambda x: x.mass, default=None)
    if at is None or at.mass < 0.5 * template.mass:
        at = template
        while (best := max((c for c in at.children if not c.never and c.tag not in LEAVES), key=lambda x: x.mass, default=None)) is not None and best.mass >= 0.8 * at.mass > 0:
            at = best
    at.root = True
    return [[x.key, x.text, x.root, x.never, parent] for x, parent in _in_order(template, _kids)]


class Template:
    __slots__ = ("key", "text", "root", "never", "children")

    def __init__(self, key: str, text: int | None, root: bool, never: bool):
        self.key, self.text, self.root, self.never, self.children = key, text, root, never, []


class Layout:
    """A host's template for pages of nearly these container paths."""

    def __init__(self, packed: dict):
        self.paths, nodes = frozenset(packed["p"]), []
        for *fields, parent in packed["s"]:
            nodes.append(Template(*fields))
            if parent is not None:
                nodes[parent].children.append(nodes[-1])
        self.top = nodes[0]


def blocks(node: Node, constant: set[int]) -> list[str]:
    """The text blocks below ``node`` in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x is node or not x.never:
            if x.tag == "br":
                line.append(" ")
                continue
            children = x.children
            if id(x) in constant:
                children = [] if x.tag in LEAVES else elements(x)
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(children))
    flush()
    return out


def _own_root(page: Node, mass: dict[int, int]) -> Node:
    """Without a template: the article or main element with most text, else the page."""
    found, stack = [], [page]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main"):
            found.append(x)
        stack += [c for c in elements(x) if not c.never]
    return max(found, key=lambda x: mass[id(x)], default=page)


def main_text(source: str, layouts: list[Layout], known: dict | None = None) -> str:
    if not source:
        return ""
    page = parse(source, known)
    root, constant, decided = None, set(), {}
    if layouts:
        for slot, node in simple_tree_matching(nearest(page, layouts).top, page, _kids, elements)[1]:
            if slot.root:
                root = node
            if slot.text is not None and slot.text == digest(text_of(node)):
                constant.add(id(node))
            if node.named:
                decided[id(node)] = slot.never
    mass = _masses(page, constant)
    if root is None or root is page:
        root = _own_root(page, mass)
        for x in _up(root):
            decided.pop(id(x), None)
    close_named(page, elements, lambda x: mass.get(id(x), 0), decided)
    return "\n\n".join(blocks(root, constant))


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("text"), _host(F.col("url")).alias("host")
    ).withColumns({"h": F.xxhash64("page_id", "url"), "page": F.xxhash64("text")})


def _beside(rows: DataFrame, side: DataFrame, on: str, size: str) -> DataFrame:
    """``rows`` left-joined with a table of at most one row per key."""
    bound = side.agg(F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()[0]
    if bound <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), on, "left")
    spread = side.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(spread, [on, "s"], "left").drop("s")


def _signed(rows: DataFrame) -> DataFrame:
    """Host, layout and hashes of every page."""

    def run(batches):
        tags: dict = {}
        for part, texts in chunks(batches):
            found = [layout(container_paths(parse(t.decode("utf-8", "replace"), tags))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(found, pa.int64()), *(part.column(c) for c in ("h", "page_id", "page"))], names=["host", "layout", "h", "page_id", "page"])

    return rows.where("text != ''").mapInArrow(run, "host string, layout long, h long, page_id long, page long")


def _skeletons(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(host, skeletons) of the hosts that have at least two different pages."""
    layouts = distinct.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "page_id", "page")).alias("first"))
    hosts = layouts.groupBy("host").agg(F.sum("n").alias("total"), F.max(F.struct("n", "first")).alias("top")).where("total > 1")
    enough = F.col("n") >= F.greatest(F.lit(float(CONSTANT_PAGES)), LAYOUT_SHARE * F.col("total"))
    kept = layouts.join(hosts, "host").where(enough | (F.struct("n", "first") == F.col("top")))
    kept = materialise(kept.select("host", "n", "first.h", "first.page_id", "first.page"), "layouts")
    few = 128 * kept.count() <= BROADCAST_BYTES  # beyond that both sides are shuffled
    wanted = kept.select("host", "h", "page", F.coalesce("page_id", F.lit(0)).alias("i"), "n")
    chosen = rows.withColumn("i", F.coalesce("page_id", F.lit(0))).join(F.broadcast(wanted) if few else wanted, ["host", "h", "page", "i"])

    def run(batches):
        for part, texts in chunks(batches):
            found = [skeleton(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("n"), part.column("h"), pa.array(found, pa.string())], names=["host", "n", "h", "skeleton"])

    outlines = chosen.select("host", "n", "h", "text").mapInArrow(run, "host string, n long, h long, skeleton string").distinct()
    # 1 / LAYOUT_SHARE skeletons of a host at most; the most frequent layout first
    ordered = F.sort_array(F.collect_list(F.struct(-F.col("n"), "h", "skeleton")))
    return outlines.groupBy("host").agg(F.transform(ordered, lambda x: x["skeleton"]).alias("skeletons"))


def induce(pages: DataFrame) -> DataFrame:
    """(host, template) of every host of ``pages`` (page_id, url, html) that has
    at least two different pages."""
    rows = _keyed(pages)
    signed = materialise(_signed(rows), "page-layouts")
    # equal pages of a host count as one, so that copies make nothing constant
    distinct = materialise(signed.groupBy("host", "page").agg(F.min("layout").alias("layout"), F.min("h").alias("h"), F.min_by("page_id", "h").alias("page_id"), F.count(F.lit(1)).alias("copies")), "pages")
    skeletons = materialise(_skeletons(rows, distinct), "skeletons")
    copies = distinct.where("copies > 1").select(F.xxhash64("host", "page").alias("copy"), "copies").dropDuplicates(["copy"])
    joined = _beside(rows.where("text != ''").withColumn("copy", F.xxhash64("host", "page")), copies, "copy", "24")
    packed = skeletons.select("host", F.to_json("skeletons").alias("skeletons"))
    joined = _beside(joined.select("page_id", "url", "text", "host", "copies"), packed, "host", "octet_length(skeletons) + octet_length(host)").where("skeletons is not null")

    def count(batches):
        known: dict[str, list[Skeleton]] = {}
        tags: dict = {}
        for part, texts in chunks(batches):
            sums: dict[tuple, list[float]] = {}
            for host, copies, packed, raw in zip(part.column("host").to_pylist(), part.column("copies").to_pylist(), part.column("skeletons").to_pylist(), texts, strict=True):
                if packed not in known:
                    if len(known) > 1024:
                        known.clear()
                    known[packed] = [Skeleton(json.loads(x)) for x in json.loads(packed)]
                page = parse(raw.decode("utf-8", "replace"), tags)
                found = nearest(page, known[packed])
                at, weight = known[packed].index(found), 1 / (copies or 1)
                for slot, own, loose, text in measure(found.top, page):
                    s = sums.setdefault((host, at, slot, text), [0.0, 0.0, 0.0])
                    s[0], s[1], s[2] = s[0] + weight, s[1] + weight * own, s[2] + weight * loose
            columns = [*zip(*sums)] or [()] * 4
            values = [*zip(*sums.values())] or [()] * 3
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns + values, types, strict=True)], names=["host", "layout", "slot", "text", "pages", "own", "loose"])

    slots = joined.mapInArrow(count, "host string, layout int, slot int, text long, pages double, own double, loose double")
    total = [F.sum(c).alias(c) for c in ("pages", "own", "loose")]
    by_text = slots.groupBy("host", "layout", "slot", "text").agg(*total)
    said = F.when(F.col("text").isNotNull(), F.struct(F.col("pages").alias("same"), "text"))
    by_slot = by_text.groupBy("host", "layout", "slot").agg(*total, F.max(said).alias("most"))
    facts = by_slot.groupBy("host").agg(F.collect_list(F.struct("layout", "slot", "pages", "own", "loose", "most.same", "most.text")).alias("counted"))

    def run(batches):
        for b in batches:
            found = [learn(s, c) for s, c in zip(b.column("skeletons").to_pylist(), b.column("counted").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(found, pa.string())], names=["host", "template"])

    return skeletons.join(facts, "host").mapInArrow(run, "host string, template string")


def extract(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    joined = _beside(_keyed(pages).drop("h", "page"), templates, "host", "octet_length(template) + octet_length(host)")

    def run(batches):
        known: dict[str, list[Layout]] = {}
        tags: dict = {}
        for part, texts in chunks(batches):
            out = []
            for packed, raw in zip(part.column("template").to_pylist(), texts, strict=True):
                if packed not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[packed] = [Layout(x) for x in json.loads(packed or "[]")]
                out.append(main_text(raw.decode("utf-8", "replace"), known[packed], tags))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
