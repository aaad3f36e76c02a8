"""The main text of web pages, by wrapper induction over the pages of a host.

Each page becomes a tree of its structural elements; equal neighbours (paragraphs, list items) count as
one repeated node. Every page of a host is aligned with the host's reference page, one of the most frequent
outline, by simple tree matching. A node that is aligned in at least `least_pages` different pages of the host and has the reference's text in at
least `constant` of them belongs to the template; other nodes are slots, which hold content. Pages with
equal texts count once, so that mirrors of one page don't turn its article into template.

The article is all of the page's outermost `article` (else `main`) elements in turn, or, without one, the slot that holds most of the text, down to where
the text parts. Inside it, template nodes and what an element's name, role, class or id marks as a menu,
header, footer, sidebar, notice, advert, form or readers' comments are left out, and all else is kept. Of an article's own header the headings stay.
Parts of a class name, words that articles use as well (`DOUBTFUL`) and hidden elements mark what stands outside of an article; inside `article`
and `main` a class name of such words alone, or the template, must say so:
blocks in page order, white space inside each as one space. A line break is white space; a table row is a block.

Per host, only the reference's outline and its template nodes are kept, of hosts that have any. They are sent to
all executors while they are at most `most_bytes` together, and joined by host beyond.

Edge cases: null, empty or broken html gives whatever text it has, maybe none; a null url is a host of its
own; unclosed elements end where HTML lets them, or with the page; repeated rows get the same text; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import util

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
NO_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
LEFT_OUT = frozenset("head header script style noscript template iframe nav aside footer form button select option textarea input svg canvas object embed audio video menu dialog title link meta noembed noframes xmp".split())
SILENT = frozenset("script style noscript template link meta title input".split())  # stand inside a block without parting it
DEEPEST = 200  # in outlines, elements below this depth count as part of what holds them; texts come from the whole tree
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist respond disqus replies sidebar aside widget widgets menu
    menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended recommendations pagination pager
    login search searchbox toolbar skip""".split()
)
DOUBTFUL = frozenset("skip search login alert social share sharing related recommended respond replies promo promotion banner widget widgets".split())
NEUTRAL = frozenset("list box block section area container wrapper wrap inner form thread bar slot unit item items top bottom left right".split())
WHOLE_MARKS = frozenset("header site-header page-header top-header siteheader pageheader".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


class Node:
    __slots__ = ("attributes", "items", "out", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.items = tag, attributes, []  # items: nodes, and texts as they stand in the page
        self.out = left_out(tag, attributes)


SURE, OUTSIDE = 2, 1  # left out wherever it stands, or outside of articles


@lru_cache(maxsize=20_000)
def left_out(tag: str, attributes: str) -> int:
    """Whether name, role, class or id mark an element as no part of an article: `SURE`, `OUTSIDE` or 0."""
    if tag in LEFT_OUT:
        return SURE
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    low = attributes.lower()
    found = {m[1]: m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(low)}
    if found.get("role") in ROLES:
        return SURE
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    parts = [set(filter(None, re.split(r"[-_:0-9]+", x))) for x in names]
    if not WHOLE_MARKS.isdisjoint(names) or any(p <= MARKS | NEUTRAL and p & MARKS - DOUBTFUL for p in parts):
        return SURE
    if found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub("", low)) or "display:none" in found.get("style", "").replace(" ", ""):
        return OUTSIDE
    return OUTSIDE if any(p & MARKS for p in parts) else 0


def parse(page: str) -> Node:
    root = Node("#")
    stack = [root]
    opened: Counter[str] = Counter()  # names on the stack

    def cut(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag in INLINE:
                    break
            continue
        if tag in NO_P:
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag not in INLINE or stack[i].tag in ("td", "th"):
                    break
        elif tag in ENDS:
            own, limits = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in own.split()) else ():
                if stack[i].tag in limits:
                    break
                if stack[i].tag in own.split():
                    cut(i)
                    if tag != "tr":
                        break
        node = Node(tag, m[3].strip())
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag in VOID or (tag in INLINE and m[3].endswith("/")):
            continue
        else:
            stack.append(node)
            opened[tag] += 1
    return root


def outline(node: Node) -> tuple[tuple, list[list[Node]]]:
    """(outline, members of each of its nodes in preorder): an outline is (name, outlines of children), equal neighbours as one."""

    def build(nodes: list[Node], depth: int = 1) -> tuple[tuple, list[list[Node]]]:
        groups: list[tuple[tuple, list[Node]]] = []
        for x in (c for x in nodes for c in structural(x)) if depth < DEEPEST else ():
            own = shape(x, depth + 1)
            if groups and groups[-1][0] == own:
                groups[-1][1].append(x)
            else:
                groups.append((own, [x]))
        kids, members = [], [nodes]
        for _, same in groups:
            kid, below = build(same, depth + 1)
            kids.append(kid)
            members += below
        return (name(nodes[0]), tuple(kids)), members

    shapes: dict[int, tuple] = {}

    def shape(x: Node, depth: int) -> tuple:
        found = shapes.get(id(x))
        if found is None:
            kids: list[tuple] = []
            for c in structural(x) if depth < DEEPEST else ():
                own = shape(c, depth + 1)
                if not kids or kids[-1] != own:
                    kids.append(own)
            found = shapes[id(x)] = (name(x), tuple(kids))
        return found

    return build([node])


def structural(x: Node) -> list[Node]:
    out: list[Node] = []
    todo = x.items[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and c.tag not in ("script", "style", "br", "meta", "link", "title"):
            if c.tag in INLINE:
                todo += c.items[::-1]
            else:
                out.append(c)
    return out


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.items) if isinstance(c, Node)]
    return out


def name(x: Node) -> str:
    m = re.search(r"""\bclass\s*=\s*["']?([^"'>]*)""", x.attributes) if x.attributes else None
    return f"{x.tag}.{'.'.join(sorted(m[1].lower().split()))}" if m else x.tag


@lru_cache(maxsize=1024)
def align(a: tuple, b: tuple) -> tuple[int, tuple[tuple[int, int], ...]]:
    """(matched nodes, pairs of their places in preorder) of simple tree matching (Yang, 1991)."""
    if a[0] != b[0]:
        return 0, ()
    if a == b:
        n = count(a)
        return n, tuple((i, i) for i in range(n))
    x, y = a[1], b[1]
    ax, by = places(x), places(y)
    total, pairs = 1, [(0, 0)]
    for i, j in matching(x, y):
        n, below = align(x[i], y[j])
        total += n
        pairs += [(ax[i] + s, by[j] + t) for s, t in below]
    return total, tuple(pairs)


CELLS = 1 << 20  # of a table of siblings that is kept whole


def matching(x: tuple, y: tuple) -> list[tuple[int, int]]:
    """The places of siblings that are matched, in order, so that most nodes are.

    Equal heads and tails match each other, which loses nothing. Of what is left a table is kept row by row; a large one is
    halved where its best path crosses the middle row (Hirschberg, 1975), so that memory grows with the siblings alone.
    """
    head, n, m = 0, len(x), len(y)
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    while n > head and m > head and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    kinds: dict[tuple, int] = {}
    left = np.array([kinds.setdefault(k, len(kinds)) for k in x[head:n]], dtype=np.int64)
    right = np.array([kinds.setdefault(k, len(kinds)) for k in y[head:m]], dtype=np.int64)
    shapes = list(kinds)
    columns, at = np.unique(right, return_inverse=True)
    weights: dict[int, np.ndarray] = {k: np.array([align(shapes[k], shapes[q])[0] for q in columns.tolist()], dtype=np.int64) for k in set(left.tolist())}

    def rows(i0: int, i1: int, cols: np.ndarray, step: int):
        """The table's rows in turn, over siblings i0 to i1 and these columns, from the front or from behind."""
        best = np.zeros(len(cols) + 1, dtype=np.int64)
        for i in range(i0, i1) if step > 0 else range(i1 - 1, i0 - 1, -1):
            w = weights[int(left[i])][cols]
            now = best.copy()
            np.maximum(best[1:], best[:-1] + w, out=now[1:])
            best = np.maximum.accumulate(now)
            yield best

    def solve(i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
        if i1 == i0 or j1 == j0:
            return []
        cols = at[j0:j1]
        if i1 - i0 == 1 or (i1 - i0) * (j1 - j0) <= CELLS:
            table = np.vstack([np.zeros((1, len(cols) + 1), dtype=np.int64), *rows(i0, i1, cols, 1)])
            out, i, j = [], i1 - i0, j1 - j0
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i0 + i, j0 + j))
            return out[::-1]
        middle = (i0 + i1) // 2
        *_, above = rows(i0, middle, cols, 1)
        *_, below = rows(middle, i1, cols[::-1], -1)
        cut = j0 + int(np.argmax(above + below[::-1]))
        return solve(i0, middle, j0, cut) + solve(middle, i1, cut, j1)

    inner = [(head + i, head + j) for i, j in solve(0, n - head, 0, m - head)]
    return [(i, i) for i in range(head)] + inner + [(n + i, m + i) for i in range(len(x) - n)]


@lru_cache(maxsize=65_536)
def count(a: tuple) -> int:
    return 1 + sum(map(count, a[1]))


def places(kids: tuple) -> list[int]:
    out, at = [], 1
    for k in kids:
        out.append(at)
        at += count(k)
    return out


def digests_of(members: list[list[Node]]) -> list[int]:
    """A digest of the text below each node of an outline, from those of its structural elements, each read once."""
    own: dict[int, int] = {}
    for x in reversed([y for m in members[0] for y in preorder(m)]):
        if x.tag in INLINE:
            continue
        parts: list[str] = []
        todo = x.items[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append(" ")
            elif c.tag in INLINE:
                todo += c.items[::-1]
            elif c.tag not in ("script", "style", "meta", "link", "title"):
                parts.append(f" <{own[id(c)]}> ")
        own[id(x)] = hash_text(" ".join("".join(parts).split()))
    return [own[id(m[0])] if len(m) == 1 else hash_text(",".join(str(own[id(x)]) for x in m)) for m in members]


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def blocks(root: Node, skip: set[int]) -> list[str]:
    """The texts of blocks in order."""
    article = root.tag in ("article", "main")
    least = SURE if article else OUTSIDE
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [root]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.tag in ("br", "wbr"):
            run.append(" " if c.tag == "br" else "")
        elif article and c.tag == "header" and id(c) not in skip:
            flush()
            todo += [None, *[x for h in reversed(preorder(c)) if h.tag in HEADINGS and not h.out and id(h) not in skip for x in (h, None)]]
        elif c is not root and (c.out >= least or id(c) in skip):
            if c.tag not in INLINE and c.tag not in SILENT:
                flush()
        elif c.tag in INLINE:
            if c.tag in ("td", "th"):
                run.append(" ")
            todo += c.items[::-1]
        else:
            flush()
            todo += [None, *c.items[::-1]]
    flush()
    return out


def sizes(root: Node, skip: set[int]) -> dict[int, int]:
    """The characters of text in each element, without what is left out."""
    found: dict[int, int] = {}
    for x in reversed(preorder(root)):
        found[id(x)] = sum(len(c) if isinstance(c, str) else 0 if c.out or id(c) in skip else found[id(c)] for c in x.items)
    return found


def articles(root: Node, skip: set[int]) -> list[Node]:
    """The elements to take the text from, in page order."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        if x.tag == "article":
            found["article"].append(x)
            continue
        if x.tag == "main" or "main" in x.attributes and re.search(r"""role\s*=\s*["']?main""", x.attributes):
            if not inside:
                found["main"].append(x)
            inside = True
        todo += [(c, inside) for c in reversed(x.items) if isinstance(c, Node) and not c.out and id(c) not in skip]
    size = sizes(root, skip)
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind]
    at = root
    while True:
        total = size[id(at)]
        kids = [c for c in structural(at) if not c.out and id(c) not in skip and c.tag not in ("p", "ul", "ol", "table", "blockquote", "pre") and c.items]
        largest = max(kids, key=lambda c: size[id(c)], default=None)
        bare = any(isinstance(c, str) and c.strip() for c in at.items)  # text of its own: it is no mere container
        if largest is None or not total or bare or size[id(largest)] < 0.6 * total:
            return [at]
        at = largest


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, page_id, outline as text, digests array<long>, whole long) of each page."""

    def run(batches):
        for pdf in batches:
            rows = []
            for host, page_id, page in zip(pdf["host"], pdf["page_id"].astype("Int64"), pdf["html"]):
                tree, members = outline(parse(page if isinstance(page, str) else ""))
                texts = digests_of(members)
                rows.append((host, page_id, written(tree), texts, texts[0]))
            yield pd.DataFrame(rows, columns=["host", "page_id", "outline", "digests", "whole"]).astype({"page_id": "Int64"})

    return pages.select("host", "page_id", "html").mapInPandas(run, "host string, page_id long, outline string, digests array<long>, whole long")


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def written(tree: tuple, depth: int = 0) -> str:
    """An outline as text: each node's depth and name, in preorder."""
    return " ".join([f"{depth}:{tree[0]}", *(written(k, depth + 1) for k in tree[1])])


@lru_cache(maxsize=4096)
def read_outline(text: str) -> tuple:
    stack: list[tuple[str, list]] = []
    for item in text.split(" "):
        depth, _, name_ = item.partition(":")
        close(stack, int(depth))
        stack.append((name_, []))
    return close(stack, 0)


def close(stack: list[tuple[str, list]], depth: int) -> tuple:
    """Ends the nodes at this depth and below; the last of them, whole."""
    done: tuple = ()
    while len(stack) > depth:
        name_, kids = stack.pop()
        done = (name_, tuple(kids))
        if stack:
            stack[-1][1].append(done)
    return done


def templates(pages: DataFrame, constant: float = 0.8, least_pages: int = 5) -> DataFrame:
    """(host, outline, nodes array<int>) of each host: its reference's outline, and which of its nodes are template."""
    each = util.stash(skeletons(pages).groupBy("host", "whole").agg(F.min(F.struct("page_id", "outline", "digests")).alias("page")))
    outlines = each.groupBy("host", F.col("page.outline").alias("outline")).agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page")).where("contains(outline, ' ')")  # more than a root
    refs = outlines.groupBy("host").agg(F.max_by("page", F.struct("n", -F.coalesce("page.page_id", F.lit(-1)), "outline")).alias("ref"))
    refs = util.stash(refs.select("host", F.col("ref.outline").alias("ref"), F.col("ref.digests").alias("ref_digests")))

    def compare(batches):
        for pdf in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for r in pdf.itertuples(index=False):
                _, pairs = align(read_outline(r.ref), read_outline(r.outline))
                for i, j in pairs:
                    at = seen.setdefault((r.host, i), [0, 0])
                    at[0] += 1
                    at[1] += r.ref_digests[i] == r.digests[j]
            yield pd.DataFrame([(h, i, n, s) for (h, i), (n, s) in seen.items()], columns=["host", "node", "n", "same"])

    rows = each.select("host", "page.outline", "page.digests").join(refs.hint("rebalance"), "host")
    found = rows.mapInPandas(compare, "host string, node int, n long, same long").groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    nodes = found.where((F.col("n") >= least_pages) & (F.col("same") >= constant * F.col("n"))).groupBy("host").agg(F.collect_set("node").alias("nodes"))
    return refs.join(nodes, "host", "left").select("host", F.col("ref").alias("outline"), "ref_digests", F.coalesce("nodes", F.array().cast("array<int>")).alias("nodes"))


def extract(page: str, outline_: str | None, digests, nodes) -> str:
    """The article of a page whose host has this reference outline, digests and template nodes."""
    root = parse(page)
    skip: set[int] = set()
    if outline_ is not None and len(nodes):
        tree, members = outline(root)
        constant, own = set(nodes), digests_of(members)
        for i, j in align(read_outline(outline_), tree)[1]:
            if i in constant and all(x.tag not in ("#", "html", "body", "article", "main") for x in members[j]) and own[j] == digests[i]:
                skip.update(map(id, members[j]))
    return "\n".join(line for x in articles(root, skip) for line in blocks(x, skip))


def main_text(pages: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, url, text) of each page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    known = util.stash(templates(hosted).where(F.size("nodes") > 0))  # other hosts have no template to leave out
    schema = "page_id long, url string, text string"

    def run(batches, of=None):
        for pdf in batches:
            if of is None:
                rows = zip(pdf["outline"], pdf["ref_digests"], pdf["nodes"])
            else:
                rows = (of.get(h, (None, (), ())) for h in pdf["host"])
            texts = [extract(page if isinstance(page, str) else "", *r) for page, r in zip(pdf["html"], rows)]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts})

    size = F.sum(F.length("host") + F.length("outline") + 8 * F.size("ref_digests"))
    if (known.agg(size).first()[0] or 0) <= most_bytes:
        of = {r["host"]: (r["outline"], tuple(r["ref_digests"]), tuple(r["nodes"])) for r in known.toLocalIterator()}
        return hosted.mapInPandas(lambda batches: run(batches, of), schema)
    joined = hosted.join(known.hint("rebalance"), "host", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<int>")))
    return joined.mapInPandas(run, schema)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(util.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
