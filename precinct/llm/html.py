"""Main text of web pages by wrapper induction.

The pages of a host are aligned with one reference page of that host by simple tree matching.
Over all its pages this tells, for every node of the reference, how much text its slot carries
and how often that text is the same: nodes that stay constant are the host's template, and the
container that holds the varying text is its content. Each page is then aligned once more and
gives the text under its content container, without the constant text of template nodes and without
what its tags and names say is no article text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.text import in_worker, steps
from precinct.runtime import cut, send_to_workers, small

# A node is template when its text is the same on this share of the host's pages, TEMPLATE_PAGES at least.
CONSTANT = 0.5
TEMPLATE_PAGES = 3

# An article or main is the content if it has this share of the host's varying text; of other
# containers it is the deepest one with all of it. A node whose names say that it is no article
# text is content all the same if it holds more than MOST of that text and the host has no article.
CONTENT = 0.8
MOST = 0.5

# In an article such a node stays from this share of the article's text outside links on.
SHARE = 0.2

# Reference trees that a Python worker keeps.
KEPT_TREES = 500

send_to_workers(__name__)

# Fixed names of HTML.
RAW = "script style noscript template textarea iframe svg math object select title head button"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
CONTAINER = set("article main section div td body center".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
LISTS = {"ul", "ol", "dl", "table", "menu"}

# What is no article text: by tag, by role, and by a part of a class or id.
OUT_TAGS = set("nav aside dialog menu fieldset".split())
EDGE_TAGS = {"header", "footer"}
OUT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
OUT_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments"
    " commentlist consent cookie cookies copyright disclaimer disqus gdpr login masthead menu modal nav navbar navigation"
    " newsletter notice notices notification pager pagination popup popover promo promotion recommended related replies reply"
    " respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
EDGE_NAMES = {"header", "footer"}
# What readers write stays out of an article, however long.
READER_NAMES = set("comment comments commentlist disqus replies reply respond".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Tree:
    """A tolerant DOM as flat lists; `items` of a node are child numbers and text strings in order."""

    def __init__(self, page: str):
        self.tag, self.sign, self.out, self.items, self.parent = ["html"], ["html"], [False], [[]], [-1]
        self.named = [False]  # out by its names alone, or a form, which may wrap a whole page
        self.readers = [False]  # named after what readers write
        stack, at = [0], 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.items[stack[-1]].append(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"] and m["raw"].lower() not in ("title", "head"):
                    continue
                if m["raw"] and m["raw"].lower() == "head" and "<body" in m[0].lower():
                    at = m.start() + m[0].lower().index("<body")  # a head that is never closed
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(stack, tag)
            elif tag not in ("html", "body") or (tag == "body" and "body" not in self.tag):
                self._open(stack, tag, m["attrs"])
        if at < len(page):
            self.items[stack[-1]].append(page[at:])

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._pop(stack, {"p"}, BLOCK - {"p"})
        if tag in CLOSED_BY:
            self._pop(stack, CLOSED_BY[tag], LISTS)
        node = len(self.tag)
        words: list[str] = []
        role = sign = ""
        hidden = False
        if attrs:
            for name, *values in _NAMES.findall(attrs):
                name, value = name.lower(), "".join(values).lower()
                if name in ("class", "id"):
                    words += re.split(r"[^a-z0-9]+", value)
                    sign += f" {name}={re.sub(r'[0-9]+', '', value)}"
                elif name == "role":
                    role = value
                else:
                    hidden |= name == "hidden" or (value == "true" if name == "aria-hidden" else "display:none" in value.replace(" ", ""))
        inside = any(self.tag[n] in ("article", "main") for n in stack)
        out = tag in OUT_TAGS or (not inside and tag in EDGE_TAGS) or hidden or role in OUT_ROLES
        named = not inside and not EDGE_NAMES.isdisjoint(words)
        named |= tag == "form" or (tag not in ("body", "html", "article", "main") and not OUT_NAMES.isdisjoint(words))
        named = not out and named
        self.readers.append(named and not READER_NAMES.isdisjoint(words))
        self.tag.append(tag)
        self.sign.append(tag + sign)
        self.out.append(out or named)
        self.named.append(named)
        self.items.append([])
        self.parent.append(stack[-1])
        self.items[stack[-1]].append(node)
        if tag not in VOID:
            stack.append(node)

    def _pop(self, stack: list[int], tags: set[str], barrier: set[str]) -> None:
        """Close the innermost open element of `tags`, unless one of `barrier` is open inside it."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in tags:
                del stack[k:]
                return
            if tag in barrier:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return

    def children(self, node: int) -> list[int]:
        return [x for x in self.items[node] if isinstance(x, int)]

    def own_text(self, node: int) -> str:
        """The text of a node's block: its own strings and those of inline children."""
        parts: list[str] = []
        todo = self.items[node][::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif self.tag[x] not in BLOCK and not self.out[x]:
                todo += self.items[x][::-1]
        return " ".join("".join(parts).split())

    def prose(self, node: int) -> int:
        """Characters of a block's own text outside links."""
        total, todo = 0, self.items[node][::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                total += len("".join(x.split()))
            elif self.tag[x] not in BLOCK and not self.out[x] and self.tag[x] != "a":
                todo += self.items[x][::-1]
        return total

    def text(self, root: int, template: set[int]) -> str:
        """The blocks under `root`, one per line, without left-out nodes and the template nodes' own text."""
        blocks: list[str] = []
        parts: list[str] = []

        def flush() -> None:
            block = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if block:
                blocks.append(block)

        # what is to come, and whether it is a template node's own text
        todo: list = [(root, False)]
        while todo:
            x, constant = todo.pop()
            if isinstance(x, str):
                if not constant:
                    parts.append(x)
            elif x is None:
                flush()
            elif x != root and self.out[x]:
                if self.tag[x] in BLOCK:
                    flush()
            else:
                if self.tag[x] in BLOCK:
                    flush()
                    todo.append((None, False))
                    constant = x in template
                elif self.tag[x] in ("br", "wbr"):
                    parts.append(" " if self.tag[x] == "br" else "")
                todo += [(y, constant) for y in self.items[x][::-1]]
        flush()
        return "\n".join(blocks)


def _runs(tree: Tree, node: int) -> list[tuple[str, list[int]]]:
    out: list[tuple[str, list[int]]] = []
    for child in tree.children(node):
        if out and out[-1][0] == tree.sign[child]:
            out[-1][1].append(child)
        else:
            out.append((tree.sign[child], [child]))
    return out


def align(tree: Tree, reference: Tree) -> dict[int, int]:
    """Node of `reference` for each node of `tree` that simple tree matching pairs with it.

    Children are paired in order and only under paired parents, so that as many nodes as possible
    find a partner of the same tag and names. Siblings of one kind in a row are one unit of the
    matching, and pair first to first.
    """
    pairs, todo = {0: 0}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        left, right = _runs(tree, a), _runs(reference, b)
        if len(left) == len(right) and all(x[0] == y[0] for x, y in zip(left, right, strict=True)):
            matched = list(zip(left, right, strict=True))
        else:
            best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
            for i in range(len(left) - 1, -1, -1):
                row, below = best[i], best[i + 1]
                for j in range(len(right) - 1, -1, -1):
                    same = min(len(left[i][1]), len(right[j][1])) + below[j + 1] if left[i][0] == right[j][0] else 0
                    row[j] = max(same, below[j], row[j + 1])
            matched, i, j = [], 0, 0
            while i < len(left) and j < len(right):
                if left[i][0] == right[j][0] and best[i][j] == min(len(left[i][1]), len(right[j][1])) + best[i + 1][j + 1]:
                    matched.append((left[i], right[j]))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i + 1][j]:
                    i += 1
                else:
                    j += 1
        for (_, xs), (_, ys) in matched:
            for x, y in zip(xs, ys, strict=False):
                pairs[x] = y
                todo.append((x, y))
    return pairs


def _observed(tree: Tree, reference: Tree, counts: dict) -> None:
    """Add one page to its host's counts: (pages, equal) of each node's text, and (other, equal) characters as its mass."""
    pairs = align(tree, reference)
    blocks = [(twin, tree.own_text(node), reference.own_text(twin)) for node, twin in pairs.items() if tree.tag[node] in BLOCK and not tree.out[node]]
    blocks = [(twin, own, other) for twin, own, other in blocks if own]
    # a page that says mostly what the reference says is a copy of it and tells nothing about the slots
    if 2 * sum(len(own) for _, own, other in blocks if own == other) <= sum(len(own) for _, own, _ in blocks):
        for twin, own, other in blocks:
            row = counts.setdefault(twin, [0, 0])
            row[0] += 1
            row[1] += own == other
    kept = _wrapping(tree)
    skipped: list[bool] = []
    for node in range(len(tree.tag)):
        up = tree.parent[node]
        # what names leave out is decided for the host, but for nodes that only this page has
        own_names = tree.named[node] and node not in pairs and node not in kept
        skipped.append((node > 0 and skipped[up]) or own_names or (tree.out[node] and not tree.named[node]))
        if tree.tag[node] in BLOCK and not skipped[node] and (own := tree.own_text(node)):
            twin = node
            while twin not in pairs:
                twin = tree.parent[twin]
            same = node in pairs and own == reference.own_text(pairs[node])
            counts.setdefault((pairs[twin], "mass"), [0, 0])[same] += len(own)


def _summed(tree: Tree, own: dict[int, int]) -> Counter:
    """Text under each node from that of each node; parents come before their children."""
    mass = Counter(own)
    for node in range(len(tree.tag) - 1, 0, -1):
        mass[tree.parent[node]] += mass[node]
    return mass


def _article(tree: Tree) -> bool:
    return any(tag in ("article", "main") for tag in tree.tag)


def _in_articles(tree: Tree) -> set[int]:
    """Nodes out by name that hold a fair share of their article's prose: a body under an unlucky class."""
    inside, firm = [-1], [False]
    for node in range(1, len(tree.tag)):
        above = tree.parent[node]
        inside.append(node if tree.tag[node] in ("article", "main") and inside[above] < 0 else inside[above])
        # a named node inside another one goes with it, unless the outer one stays
        firm.append(firm[above] or tree.readers[node] or (tree.out[node] and not tree.named[node]))
    mass = _summed(tree, {n: tree.prose(n) for n, tag in enumerate(tree.tag) if tag in BLOCK and inside[n] >= 0 and not firm[n]})
    return {n for n, named in enumerate(tree.named) if named and not firm[n] and inside[n] >= 0 and mass[n] >= max(1, SHARE * mass[inside[n]])}


def _wrapping(tree: Tree) -> set[int]:
    """Nodes out by name that are content: a fair share of an article, or most of a page without one."""
    if not any(tree.named):
        return set()
    if _article(tree):
        return _in_articles(tree)
    firm = [False]
    for node in range(1, len(tree.tag)):
        firm.append(firm[tree.parent[node]] or (tree.out[node] and not tree.named[node]))
    mass = _summed(tree, {n: len(tree.own_text(n)) for n, tag in enumerate(tree.tag) if tag in BLOCK and not firm[n]})
    return {n for n, named in enumerate(tree.named) if named and mass[n] > MOST * mass[0]}


def wrapper(reference: Tree, counts: dict) -> tuple[int, set[int], set[int]]:
    """(content container, template nodes, nodes out by name that are content) of a host, as nodes of its reference page."""
    template = {
        k for k, (pages, equal) in ((k, v) for k, v in counts.items() if not isinstance(k, tuple))
        if equal >= TEMPLATE_PAGES and equal > CONSTANT * pages
    }
    varying = {k[0]: other + (0 if k[0] in template else same) for k, (other, same) in counts.items() if isinstance(k, tuple)}
    kept: set[int] = set()
    if any(reference.named) and not _article(reference):
        mass = _summed(reference, varying)
        kept = {n for n, named in enumerate(reference.named) if named and mass[n] > MOST * mass[0]}
    left = [False]
    for node in range(1, len(reference.tag)):
        left.append(left[reference.parent[node]] or (reference.named[node] and node not in kept))
    mass = _summed(reference, {n: m for n, m in varying.items() if not left[n]})
    whole = mass[0]
    containers = [n for n, tag in enumerate(reference.tag) if whole and tag in CONTAINER]
    articles = [n for n in containers if reference.tag[n] in ("article", "main") and mass[n] >= CONTENT * whole]

    def depth(node: int) -> int:
        return 0 if node <= 0 else 1 + depth(reference.parent[node])

    return max(articles or [n for n in containers if mass[n] == whole], key=lambda n: (depth(n), -n), default=-1), template, kept


def extract(page: str | None, reference: Tree | None, root: int, template: set[int], kept: set[int]) -> str:
    """The main text of a page under its host's wrapper."""
    tree = Tree(page or "")
    pairs = align(tree, reference) if reference else {}
    own = next((node for node, twin in pairs.items() if twin == root), None)
    article = _article(tree)
    for node in _wrapping(tree):
        if article or own is None or node not in pairs:
            tree.out[node] = False
    for node, twin in pairs.items():
        if twin in kept and tree.named[node]:
            tree.out[node] = False
    if own is None:  # the page has no such container: its own article, or all of it
        own = next((n for n, t in enumerate(tree.tag) if t in ("article", "main")), None)
    if own is None:
        own = next((n for n, t in enumerate(tree.tag) if t == "body"), 0)
    # of a template slot only the constant text goes, where this page has it
    return tree.text(own, {node for node, twin in pairs.items() if twin in template and tree.own_text(node) == reference.own_text(twin)})


def host_of(url: str):
    """SQL for the host of a URL column; null and odd URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _reference(key: str, page: str) -> Tree:
    trees = in_worker(("html",), dict)
    if len(trees) > KEPT_TREES:
        trees.clear()
    if key not in trees:
        trees[key] = Tree(page)
    return trees[key]


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The reference of a host is its page with the smallest (page_id, html). A null html is empty
    and gives an empty text; pages without a host in their url share one. Repeated rows stay, and
    other columns are ignored. All pages of a host count for its wrapper.
    """
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of("url").alias("host"),
    )
    # the page of a host that stands for it, found without moving any html but that page's
    chosen = cut(pages.where("html <> ''").groupBy("host").agg(F.min(F.struct(F.coalesce("page_id", F.lit(0)).alias("id"), F.sha1("html").alias("digest"))).alias("first")))
    n = chosen.count()
    chosen = chosen.select("host", "first.id", "first.digest")
    firsts = pages.join(small(chosen, n), "host").where((F.coalesce("page_id", F.lit(0)) == F.col("id")) & (F.sha1("html") == F.col("digest")))
    firsts = cut(firsts.select("host", F.col("html").alias("reference"), "digest").dropDuplicates(["host"]))
    sent = firsts if _bytes(firsts) > (16 << 20) else F.broadcast(firsts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in steps(batches, "html"):
            for host, page, first, digest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                _observed(Tree(page), _reference(digest, first), counts.setdefault(host, {}))
            if len(counts) > 1000:
                yield _rows(counts)
                counts = {}
        yield _rows(counts)

    seen = pages.join(sent, "host").select("host", "html", "reference", "digest")
    counts = seen.mapInArrow(learn, "host string, node int, mass boolean, pages bigint, equal bigint")
    counts = counts.groupBy("host", "node", "mass").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal"))
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("node", "mass", "pages", "equal")).alias("counts"))
    known = cut(firsts.join(counts, "host", "left"))
    known = known if _bytes(known) > (16 << 20) else F.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = in_worker(("wrappers",), dict)
        for batch in steps(batches, "html"):
            texts = []
            if len(wrappers) > KEPT_TREES:
                wrappers.clear()
            for page, first, digest, counts in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if first is None:
                    texts.append(extract(page, None, -1, set(), set()))
                    continue
                tree = _reference(digest, first)
                key = (digest, len(counts or ()), sum(c["pages"] for c in counts or ()), sum(c["equal"] for c in counts or ()))
                if key not in wrappers:
                    wrappers[key] = wrapper(tree, {(c["node"], "mass") if c["mass"] else c["node"]: (c["pages"], c["equal"]) for c in counts or ()})
                texts.append(extract(page, tree, *wrappers[key]))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    whole = pages.join(known, "host", "left").select("page_id", "url", "html", "reference", "digest", "counts")
    return whole.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def _rows(counts: dict) -> pa.RecordBatch:
    rows = [
        (host, k[0] if isinstance(k, tuple) else k, isinstance(k, tuple), *v) for host, of in counts.items() for k, v in of.items()
    ]
    types = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, ["host", "node", "mass", "pages", "equal"])


def _bytes(table: DataFrame) -> int:
    """The size of a table of reference pages, to see whether it may be sent to all tasks."""
    text = [F.octet_length("reference")] + ([F.size("counts") * 32] if "counts" in table.columns else [])
    return table.agg(F.coalesce(F.sum(sum(F.coalesce(t, F.lit(0)) for t in text)), F.lit(0)).alias("n")).first().n
