"""Main text of HTML pages by wrapper induction.

Pages become small trees of block elements: runs of siblings with one signature fold
into a repeat node, so a page of a thousand paragraphs is a tree of a dozen nodes.
Pages of a host are laid in chains of hash order (salted, so a host with many pages has
many) and each is aligned with its successor by simple tree matching, so the work
is one alignment a page however large the host is.  A text block that a matched node
has on both sides votes for template; pairs of pages that share most of their text are
copies and don't vote.  What varies is a slot.  Slots are told apart by what they hold
over all pages of the host: those of linked words are lists of links, and the smallest
container that has nearly all unlinked words of the host is where its articles stand.
Kinds of elements and class names are priors only: they leave words out of that sum,
and below the container they mark navigation, adverts, forms and comments; on the
container itself or above it they mean nothing.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from debitage.iterate import materialise
from debitage.llm.wordhash import slices

#: A tag to its end; quotes hide a ">", but one that isn't closed soon doesn't.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

# Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("html body main article section div center form table tbody tr td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": frozenset("p"), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
LEAVES = frozenset("p li dt dd td th option".split())
# The priors. Class, id and role values count as whole names, or as two words of which the other is one too or a word of PARTS.
NO_ARTICLE = frozenset("nav header footer aside form button select option menu head dialog fieldset label legend".split())
ARTICLE = frozenset("article main".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup share sharing social related recommended widget pagination pager login toolbar complementary contentinfo search".split()
)
#: Parts of a longer name that tell of what others wrote, and how such a part may end.
OTHERS = frozenset("comment comments commenter commentlist commentarea commentbox reply replies disqus advert adverts advertisement advertisements sponsored".split())
OTHERS_END = ("comments", "replies")
PARTS = frozenset("area bar block body box button buttons container content form global inner item items left link links list main menu nav page panel right section site text thread top widget wrap wrapper".split())

#: Votes for template that make a block template, as pairs of pages and as a share of them.
VOTES = 2
CONSTANT = 0.95
#: Two pages that share so much of their text are copies of one article.
COPY = 0.5
#: Share of the host's unlinked words that its container has; of those words, or of the host's pages, that a marked article has to be it; share of linked words in a list of links.
MASS, MARKED, LINKED = 0.7, 0.5, 0.6
#: Part of a host's pages that a slot must be on to count for its wrapper: a page of n slots has at most n / RARE for its host.
RARE = 0.02
#: Levels of a tree; children of a node beyond which equal signatures fold even if apart and are matched by signature.
DEEP, WIDE = 60, 16
#: Pairs of nodes that an alignment of two pages tries before it matches children by signature.
PRODUCT = 50_000
#: Pages of one chain, about; wrappers that are broadcast at most, else they are joined.
CHAIN = 500
BROADCAST = 100_000


class Node:
    """An open element: its path, the depths of the last elements above or at it that the priors exclude, whether it is in a marked article."""

    __slots__ = ("tag", "signature", "path", "depth", "bad", "soft", "marked", "children", "parent", "part", "holds", "number")

    def __init__(self, tag: str, names: list[str], parent: Node | None, number: int = 0):
        self.tag, self.children, self.parent, self.part, self.holds, self.number = tag, [], parent, False, False, number
        self.signature = ".".join([tag, *[n for n in map(str.lower, names) if not any(c.isdigit() for c in n)][:2]]).replace("/", "_")
        if parent is None:
            self.path, self.depth, self.bad, self.soft, self.marked = "", 0, 0, 0, ""
            return
        self.depth = min(parent.depth + 1, DEEP)
        self.path = (f"{parent.path}/{self.signature}" if parent.path else self.signature) if self.depth < DEEP else parent.path
        self.bad, self.soft, self.marked = parent.bad, parent.soft, parent.marked
        if tag == "header" and self.marked:
            self.soft = self.depth  # the article's own: its headings stay
        elif tag in NO_ARTICLE or (tag not in ("html", "body", *ARTICLE) and any(map(excluded, names))):
            self.bad = self.depth
        elif tag not in ("html", "body", *ARTICLE) and any(map(others, names)):
            self.bad, self.part = self.depth, True
        if tag in ARTICLE:
            self.marked = self.path


def excluded(name: str) -> bool:
    """Whether a class, id or role name tells that an element is no article."""
    name = name.lower()
    if name in NO_ARTICLE_NAMES:
        return True
    parts = re.split(r"[-_]+", name)
    return len(parts) == 2 and any(a in NO_ARTICLE_NAMES and (b in PARTS or b in NO_ARTICLE_NAMES) for a, b in (parts, parts[::-1]))


def others(name: str) -> bool:
    """Whether a name has a part that tells of readers' comments or adverts; such an element may still hold the whole page."""
    parts = [p.lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name)]
    return any(p in OTHERS or p.endswith(OTHERS_END) for p in parts)


def _names(attributes: str) -> list[str]:
    return [w for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()] if "=" in attributes else []


@dataclass(slots=True)
class Block:
    """A run of text: the path of its element, the depths that priors exclude, its words and how many are linked."""

    text: str
    path: str
    tag: str
    depth: int
    bad: int
    soft: int
    marked: str
    words: int
    links: int
    node: Node
    article: int


def blocks(page: str | None) -> tuple[list[Block], Node]:
    """The text blocks of a page in order, and its tree; each step costs what it reads, whatever the page."""
    page = page or ""
    root = Node("#root", [], None)
    stack, found, run, linked = [root], [], [], []
    open_at: dict[str, list[int]] = {}
    link, number, parts = False, 0, False
    inside_article: list[int] = []

    def article_of(node: Node) -> int:
        """The number of the innermost marked element around a block."""
        return inside_article[-1] if inside_article else 0

    def flush() -> None:
        nonlocal run, linked
        if not run:
            return
        raw = "".join(run)
        words = (html.unescape(raw) if "&" in raw else raw).split()
        if words:
            node = stack[-1]
            inside = len("".join(linked).split()) if linked else 0
            node.children.append(len(found))
            found.append(Block(" ".join(words), node.path, node.tag, node.depth, node.bad, node.soft, node.marked, len(words), min(inside, len(words)), node, article_of(node)))
        run, linked = [], []

    def pop(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            open_at[node.tag].pop()
            if node.tag in ARTICLE:
                inside_article.pop()

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            text = page[at:] if lt < 0 else page[at:lt]
            run.append(text)
            if link:
                linked.append(text)
            if lt < 0:
                break
        at = lt
        nxt = page[at + 1 : at + 2]
        if nxt in ("!", "?"):
            close = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
            at = end if close < 0 else close + (3 if page.startswith("<!--", at) else 1)
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/"):
            run.append("&lt;")
            at += 1
            continue
        m = TAG.match(page, at) or LOOSE.match(page, at)
        if m is None:
            if nxt == "/" or page.find(">", at) >= 0:  # no tag: an end tag without a name, say
                close = page.find(">", at)
                at = end if close < 0 else close + 1
                continue
            break  # a tag that never ends
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                where = open_at.get(tag)
                if where:
                    pop(where[-1])
                link = False
            elif tag == "a":
                link = False
            continue
        if tag in RAW:
            close = _raw_end(page, tag, at)
            at = end if close < 0 else close
            run.append(" ")
            continue
        if tag == "br":
            run.append(" ")
            linked.append(" ")
            continue
        if tag not in BLOCK:
            if tag == "a":
                link = True
            continue
        flush()
        closes = CLOSES.get(tag, ("p",) if tag not in VOID else ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes:
                pop(k)
                break
            if stack[k].tag not in LEAVES:
                break
        if tag not in VOID:
            number += 1
            node = Node(tag, _names(m[3]), stack[-1], number)
            parts |= node.part
            if tag in ARTICLE:
                inside_article.append(number)
            if tag in ("h1", "main"):
                for n in reversed(stack):
                    if n.holds:
                        break
                    n.holds = True
            if node.depth < DEEP:  # what lies deeper keeps its kind, but hangs from the node at that depth
                stack[-1].children.append(node)
            else:
                node.children = stack[-1].children
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
    flush()
    if parts:
        _reconsider(found)
    return found, root


def _reconsider(found: list[Block]) -> None:
    """An element named by a part of its name only, which holds the page's headline, is no list of comments: what lies above it decides."""
    deepest: dict[int, int] = {}
    for b in found:
        way, node = [], b.node
        while node is not None and node.number not in deepest:
            way.append(node)
            node = node.parent
        bad = deepest[node.number] if node is not None else 0
        for n in reversed(way):
            above = n.parent.bad if n.parent is not None else 0
            if n.bad != above and not (n.part and n.holds):
                bad = n.bad
            deepest[n.number] = bad
        b.bad = bad


def _raw_end(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of a raw element, -1 without one."""
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
    return m.end() if m else -1


Folded = list  # [signature, hashes of its own text blocks, children]


class _Folding:
    """A node while its siblings fold into it; children are found by signature once two have met."""

    __slots__ = ("signature", "hashes", "children", "index")

    def __init__(self, signature: str, hashes: list[int], children: list[_Folding]):
        self.signature, self.hashes, self.children, self.index = signature, hashes, children, None

    def take(self, other: _Folding) -> None:
        waiting = [(self, other)]
        while waiting:
            into, own = waiting.pop()
            into.hashes.extend(own.hashes)
            if not own.children:
                continue
            if into.index is None:
                kids, into.children, into.index = into.children, [], {}
                waiting += into._gather(kids)
            waiting += into._gather(own.children)

    def _gather(self, kids: list[_Folding]) -> list:
        """Take in children; returned are the pairs that fold."""
        met = []
        for k in kids:
            had = self.index.get(k.signature)
            if had is None:
                self.index[k.signature] = k
                self.children.append(k)
            else:
                met.append((had, k))
        return met


def fold(root: Node, texts: list[Block]) -> Folded:
    """The tree as [signature, hashes of text blocks, children], runs of one signature folded."""
    own = [zlib.crc32(t.text.encode()) for t in texts]
    done: dict[int, _Folding] = {}
    order, waiting = [], [root]
    while waiting:  # no recursion: parents before children, folded backwards
        node = waiting.pop()
        order.append(node)
        waiting += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        out: list[_Folding] = []
        for c in node.children:
            if isinstance(c, int):
                continue
            k = done.pop(id(c))
            if out and k.signature == out[-1].signature:
                out[-1].take(k)
            else:
                out.append(k)
        folding = _Folding(node.signature, [own[c] for c in node.children if isinstance(c, int)], [] if len(out) > WIDE else out)
        if len(out) > WIDE:
            folding.take(_Folding("", [], out))
        done[id(node)] = folding

    def plain(f: _Folding) -> Folded:
        return [f.signature, f.hashes, [plain(k) for k in f.children]]

    return plain(done[id(root)])


def _by_signature(kids: list[Folded]) -> list[Folded]:
    """Children of one node with those of equal signature folded to one, with all their text and the children of the first."""
    out: dict[str, Folded] = {}
    for k in kids:
        had = out.get(k[0])
        out[k[0]] = k if had is None else [k[0], had[1] + k[1], had[2] or k[2]]
    return list(out.values())


def _shape(node: Folded, known: dict[int, str]) -> str:
    """The digest of a node's signatures, its own and all below it."""
    if id(node) not in known:
        known[id(node)] = hashlib.md5("".join([node[0], "(", *(_shape(k, known) for k in node[2]), ")"]).encode()).hexdigest()
    return known[id(node)]


def align(a: Folded, b: Folded) -> tuple[int, list[tuple[str, list, list]]]:
    """Simple tree matching: the size of the largest top-down ordered match, and the matched nodes with text.

    A node is (path, hashes in a, hashes in b).  Trees of one shape match node by node.
    Children of a node of over WIDE of them, and all once PRODUCT pairs of nodes have been
    tried, are matched by signature instead: they are folded to one each.
    """
    shapes: dict[int, str] = {}
    _shape(a, shapes), _shape(b, shapes)
    return _align(a, b, shapes, [PRODUCT])


def _align(a: Folded, b: Folded, shapes: dict[int, str], left: list[int]) -> tuple[int, list[tuple[str, list, list]]]:
    if a[0] != b[0]:
        return 0, []
    left[0] -= 1
    mine = [("", a[1], b[1])] if a[1] or b[1] else []
    n, m = len(a[2]), len(b[2])
    if not n or not m:
        return 1, mine
    named = lambda x, found: [(f"{x[0]}/{p}" if p else x[0], s, t) for p, s, t in found]
    if id(a) in shapes and shapes[id(a)] == shapes.get(id(b)):
        both = [(x, _align(x, y, shapes, left)) for x, y in zip(a[2], b[2], strict=True)]
        return 1 + sum(r[0] for _, r in both), mine + [hit for x, r in both for hit in named(x, r[1])]
    if max(n, m) > WIDE or left[0] <= 0:
        one, two = (_by_signature(x[2]) for x in (a, b))
        by = {y[0]: y for y in two}
        chosen = [(x, _align(x, by[x[0]], shapes, left)) for x in one if x[0] in by]
        return 1 + sum(r[0] for _, r in chosen), mine + [hit for x, r in chosen for hit in named(x, r[1])]
    pair = [[_align(x, y, shapes, left) for y in b[2]] for x in a[2]]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + pair[i - 1][j - 1][0])
    leaves, i, j = [], n, m
    while i and j:
        if pair[i - 1][j - 1][0] and best[i][j] == best[i - 1][j - 1] + pair[i - 1][j - 1][0]:
            leaves += named(a[2][i - 1], pair[i - 1][j - 1][1])
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[n][m], mine + leaves


def slots(found: list[Block]) -> dict[str, list]:
    """path -> [words, linked words, words that no prior excludes, marked article, whether the page has but one of that article]."""
    out: dict[str, list] = {}
    of: dict[str, set[int]] = {}
    for b in found:
        of.setdefault(b.marked, set()).add(b.article)
    for b in found:
        s = out.setdefault(b.path, [0, 0, 0, b.marked, int(len(of[b.marked]) == 1)])
        s[0] += b.words
        s[1] += b.links
        s[2] += 0 if b.bad else b.words - b.links
    return out


def choose(held: dict[str, list], pages: int = 1) -> tuple[str, set[str]]:
    """The container's path and the paths of lists of links, from what slots hold on so many pages.

    A marked article that stands alone on half of the pages is the container, however
    much stands outside it (an ``article`` before a ``main``); else the element with most words.
    """
    dense = {p for p, s in held.items() if s[1] >= LINKED * s[0] > 0}
    mass = {p: s[2] for p, s in held.items() if s[2] and p not in dense}
    mass = mass or {p: s[0] - s[1] for p, s in held.items() if p not in dense} or {p: s[0] for p, s in held.items()}
    total = sum(mass.values())
    of: dict[str, int] = {}
    marked: dict[str, int] = {}
    alone: dict[str, int] = {}
    for p, w in mass.items():
        parts = p.split("/")
        for k in range(len(parts) + 1):
            if k == 0 or parts[k - 1].split(".")[0] in CONTAINER:
                of["/".join(parts[:k])] = of.get("/".join(parts[:k]), 0) + w
        if mark := held[p][3]:
            marked[mark] = marked.get(mark, 0) + w
            alone[mark] = max(alone.get(mark, 0), held[p][4])
    weight = lambda p: (marked[p], p.count("/"))
    sure = [p for p in marked if alone[p] >= MARKED * pages]
    articles = [p for p in sure if p.rpartition("/")[2].split(".")[0] == "article"]
    if sure:
        return max(articles or sure, key=weight), dense
    best = max(marked, key=weight, default=None)
    if best is not None and marked[best] >= MARKED * total:
        return best, dense
    heavy = [p for p, w in of.items() if w >= MASS * total]
    return max(heavy, key=lambda p: (p.count("/") if p else -1), default=""), dense


def under(path: str, container: str) -> bool:
    return not container or path == container or path.startswith(container + "/")


def main_text(page: str | None, wrapper: tuple[str, set, set] | None = None) -> str:
    """The article of a page: the blocks in the container that are neither template nor links nor excluded by a prior below it.

    wrapper: the host's container, lists of links and template blocks (path, crc32 of the text); a
    page without that container, and one without a wrapper, goes by what it holds itself.
    """
    found, _ = blocks(page)
    if not found:
        return ""

    def kept(container: str, dense: set[str], template: set) -> list[Block]:
        depth = container.count("/") + 1 if container else 0
        out, last = [], -1
        beside = container.rpartition("/")[0]
        for k, b in enumerate(found):
            if b.bad > depth or b.path in dense and b.tag not in HEADING or (b.path, zlib.crc32(b.text.encode())) in template:
                continue
            if b.soft > depth and b.tag not in HEADING:
                continue
            if under(b.path, container):
                out.append((k, b))
                last = k if last < 0 else last
        # the headline may stand before the container, in the same element
        head = [b for b in found[: max(last, 0)] if b.tag in ("h1", "h2") and container and b.path.rpartition("/")[0] == beside and not b.bad]
        return head + [b for _, b in out]

    out: list[Block] = []
    if wrapper is not None:
        out = kept(*wrapper)
        if not any(b.tag not in HEADING for b in out):
            out = []
    if not out:
        out = kept(*choose(slots(found)), wrapper[2] if wrapper else set())
    return "\n\n".join(b.text for b in out)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("path", pa.string()), ("words", pa.int64()), ("links", pa.int64()), ("plain", pa.int64()), ("marked", pa.string()), ("alone", pa.int64())]))
    for b in slices(batches, "html"):
        trees, held = [], []
        for t in b.column(2):
            found, root = blocks(t.as_py())
            trees.append(json.dumps(fold(root, found), separators=(",", ":"), ensure_ascii=False))
            held.append([{"path": p, "words": s[0], "links": s[1], "plain": s[2], "marked": s[3], "alone": s[4]} for p, s in slots(found).items()])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(trees, pa.string()), pa.array(held, kind)], ["host", "place", "tree", "slots"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, text of blocks that both pages of a pair have; text null once for each matched path."""
    for b in batches:
        host, path, text = [], [], []
        for h, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x == y:
                continue  # copies tell nothing
            matched = [(p, set(s), set(t)) for p, s, t in align(json.loads(x), json.loads(y))[1]]
            shared = sum(len(s & t) for _, s, t in matched)
            if shared > 2 and shared > COPY * sum(min(len(s), len(t)) for _, s, t in matched):
                # nearly all blocks agree; a page of few slots is judged by the rest of its host
                continue
            for p, s, t in matched:
                for v in (None, *(s & t)):
                    host.append(h)
                    path.append(p)
                    text.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(text, pa.int64())], ["host", "path", "text"])


def host_of(url) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def _chosen(g: pd.DataFrame) -> pd.DataFrame:
    held = {p: list(x) for p, *x in zip(g["path"], g["words"], g["links"], g["plain"], g["marked"], g["alone"], strict=True)}
    container, dense = choose(held, int(g["pages"].iloc[0]))
    return pd.DataFrame({"host": [g["host"].iloc[0]], "container": [container], "dense": [sorted(dense)]})


def induce(pages: DataFrame) -> DataFrame:
    """host, container, dense (paths), template (path and crc32 of texts): the wrapper of each host of two pages or more."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("place"), F.col("html").cast("string")).where("host <> ''")
    trees = materialise(rows.mapInArrow(_trees, "host string, place long, tree string, slots array<struct<path:string,words:long,links:long,plain:long,marked:string,alone:long>>"))
    sizes = materialise(trees.groupBy("host").agg(F.count("*").alias("pages")).where("pages > 1"))
    # hosts of more than one chain: of N pages at most N / CHAIN hosts, handed to every task while they are few
    big = sizes.select("host", (F.floor(F.col("pages") / CHAIN) + 1).alias("chains")).where("chains > 1")
    few = big.limit(BROADCAST + 1).collect()
    if len(few) <= BROADCAST:
        big = F.broadcast(pages.sparkSession.createDataFrame(few, "host string, chains long"))
    dealt = trees.join(big, "host", "left").withColumn("chain", F.pmod(F.xxhash64("place"), F.coalesce("chains", F.lit(1))))
    chain = Window.partitionBy("host", "chain").orderBy("place", "tree")
    pairs = dealt.select("host", "tree", F.lead("tree").over(chain).alias("next")).where("next is not null")
    votes = pairs.mapInArrow(_votes, "host string, path string, text long").groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    votes = materialise(votes.where((F.col("n") >= VOTES) | F.col("text").isNull()))
    asked = votes.where("text is null").select("host", "path", F.col("n").alias("asked"))
    constant = votes.where("text is not null").join(asked, ["host", "path"]).where(F.col("n") >= CONSTANT * F.col("asked"))
    template = constant.groupBy("host").agg(F.collect_list(F.struct("path", "text")).alias("template"))
    held = trees.select("host", F.explode("slots").alias("s")).select("host", "s.*").groupBy("host", "path").agg(F.count("*").alias("on"), *(F.sum(c).alias(c) for c in ("words", "links", "plain", "alone")), F.max("marked").alias("marked"))
    held = held.join(sizes, "host").where(F.col("on") >= RARE * F.col("pages"))
    chosen = held.groupBy("host").applyInPandas(_chosen, "host string, container string, dense array<string>")
    return chosen.join(template, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Character references are decoded, white space inside a block is one space, blocks
    are joined by two newlines.  Null, empty and text-free pages have an empty text;
    pages without a host and those that are alone on theirs go by what they hold
    themselves; repeated rows and null page_ids keep their rows; an empty table gives an
    empty one; further columns are ignored.
    """
    wrappers = materialise(induce(pages))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    few = wrappers.limit(BROADCAST + 1).collect()

    def wrapper_of(r) -> tuple[str, set, set]:
        return r["container"], set(r["dense"]), {(x["path"], x["text"]) for x in r["template"] or ()}

    by_host = {}
    if len(few) <= BROADCAST:
        by_host = {r["host"]: wrapper_of(r) for r in few}
    else:  # too many to hand to every task: each host's own travels with its pages
        rows = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "host", F.when(F.col("container").isNotNull(), F.struct("container", "dense", "template")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hosts = b.column(3).to_pylist()
            own = b.column(4).to_pylist() if b.num_columns > 4 else [None] * b.num_rows
            texts = [main_text(t.as_py(), wrapper_of(w) if w else by_host.get(h)) for t, h, w in zip(b.column(2), hosts, own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
