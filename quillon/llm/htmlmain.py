"""Main text of web pages, with site templates removed.

Every element subtree of a page is hashed; Spark counts, for each host, on how many different pages a
subtree recurs; pages are different if their texts are, so copied articles count once.  Blocks on
``MANY`` different pages of a host, or on most, are that site's template and are deleted; inline
elements, cells and items can belong to any sentence or table and must be on most.  What is left is
read from the page's article (or main, or body) without the elements that are never main text.

Defined cases: null html counts as empty and gives an empty text; a null or relative url belongs to a
host of its own, "", like every other; hosts with fewer than ``MIN_PAGES`` different pages have no
template; unclosed and stray tags are tolerated; repeated rows are one page; other columns are ignored.
Plain blocks (without class, id or role) of an article may be the text of near copies: they are
template only if at least half of the different pages they are on also differ in the least hash of the
five-word shingles of what stands around them.  Plain inline elements, cells and items of an article
stay.  An empty table gives no rows; a block on exactly ``MANY`` pages is template; a page of any
length, depth or brokenness takes time in proportion to its length, and is held whole by one task.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import neardup
from quillon.llm.common import cut, map_batches, slices

#: A subtree is template if it stands on this share of a host's different pages, and the host has so many.
TEMPLATE_SHARE, MIN_PAGES = 0.6, 8
#: A block is also template if it stands on so many different pages of a host.
MANY = 20
#: Template hashes that may be held by every task; above it, pages and templates are joined by host.
MAX_BROADCAST_HASHES, PLACES = 200_000, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
NEVER = frozenset("head nav header footer aside form script style noscript template iframe svg math canvas object button select textarea input label fieldset dialog menu title audio video".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that are parts of a list or table.
ITEMS = frozenset("li dt dd tr td th tbody thead tfoot caption summary".split())
#: Words in a class or id, and roles, that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus "
    "footer gdpr header hidden menu modal nav navbar navigation newsletter notice notices notification overlay paywall popup promo promotion promoted recommended "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar note".split())
#: An opening tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIER = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: A whole tag whose quotes are all closed; nothing is tried twice.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=(?!\s*+["'])|["'])*+)>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_IN_TAG = re.compile(r"""[^>"'=]*""")
_BLANKS = re.compile(r"\s*")
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))


class Node:
    """An element: ``attrs`` is the source between its name and the end of its tag, ``hash`` that of the whole subtree."""

    __slots__ = ("tag", "attrs", "start", "end", "children", "hash")

    def __init__(self, tag: str, attrs: str, start: int) -> None:
        self.tag, self.attrs, self.start, self.end, self.children, self.hash = tag, attrs, start, start, [], 0

    def seal(self, end: int, hashed: bool) -> None:
        """The subtree is complete: its hash is made of its tag, its strings and its children's hashes."""
        self.end = end
        if not hashed:
            return
        h = hashlib.blake2b(f"{self.tag}\0{self.attrs}".encode("utf-8", "surrogatepass"), digest_size=8)
        for c in self.children:
            h.update(b"\1" + c.hash.to_bytes(8, "little", signed=True) if isinstance(c, Node) else b"\2" + c.encode("utf-8", "surrogatepass"))
        self.hash = int.from_bytes(h.digest(), "little", signed=True)


class Tags:
    """The tags of a page in one pass: (start, end, closing, name, attributes); text lies between them.

    A quote opens a value only after an equals sign; a quote that is never closed is a character like
    others, and so is a tag's beginning if no tag ends after it.  What is found missing once is not
    looked for again, so the time is linear in the page.
    """

    def __init__(self, html: str) -> None:
        self.html, self.lacks = html, set()

    def _find(self, what: str, at: int) -> int:
        if what in self.lacks:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.lacks.add(what)
        return k

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at ``at``."""
        html, n = self.html, len(self.html)
        while True:
            at = _IN_TAG.match(html, at).end()
            if at >= n:
                return -1
            c = html[at]
            if c == ">":
                return at
            at += 1
            if c == "=":
                at = _BLANKS.match(html, at).end()
                if at < n and html[at] in "\"'":
                    close = self._find(html[at], at + 1)
                    at = close + 1 if close >= 0 else at + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The first tag from ``at`` on; comments and declarations have no name."""
        html, n = self.html, len(self.html)
        while (at := html.find("<", at)) >= 0:
            if not self.lacks and (m := _TAG.match(html, at)):
                return at, m.end(), m[1] == "/", m[2].lower(), m[3]
            after = html[at + 1 : at + 2]
            if after in ("!", "?") and after:
                comment = html.startswith("<!--", at)
                end = self._find("-->" if comment else ">", at + (4 if comment else 1))
                return at, n if end < 0 else end + (3 if comment else 1), False, "", ""
            name = _NAME.match(html, at + 1 + (after == "/"))
            if name and ">" not in self.lacks:
                end = self._end(name.end())
                if end >= 0:
                    return at, end + 1, after == "/", name[0].lower(), html[name.end() : end]
                self.lacks.add(">")
            at += 1
        return None


def parse(html: str, hashed: bool = True) -> Node:
    """The page as a tree of elements and strings, ``hashed`` or not; comments and declarations are left out.

    Where the open elements of each name are is kept beside the stack, so that a closing tag costs
    no more than the elements it closes.
    """
    root = Node("", "", 0)
    stack, barriers, open_at, tags, at, n = [root], [0], {}, Tags(html), 0, len(html)

    def close(depth: int, end: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.seal(end, hashed)
            open_at[node.tag].pop()
            if barriers[-1] == len(stack):
                barriers.pop()

    while at < n:
        found = tags.next(at)
        if found is None:
            stack[-1].children.append(html[at:])
            break
        start, end, closing, tag, attrs = found
        if start > at:
            stack[-1].children.append(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if open_at.get(tag):
                close((depth := open_at[tag][-1]) + 1, start)
                close(depth, at)
            continue
        ends = ("p",) if tag in CLOSES_P else CLOSES.get(tag, ())
        deepest = max((open_at[t][-1] for t in ends if open_at.get(t)), default=0)
        if deepest and deepest >= barriers[-1]:
            close(deepest, start)
        node = Node(tag, attrs, start)
        stack[-1].children.append(node)
        if tag in VOID or attrs.endswith("/"):
            node.seal(at, hashed)
        elif tag in RAW:
            stop = _raw_end(html, tag, at, tags.lacks)
            node.children.append(html[at : stop[0]])
            at = stop[1]
            node.seal(at, hashed)
        else:
            open_at.setdefault(tag, []).append(len(stack))
            if tag in BARRIER:
                barriers.append(len(stack))
            stack.append(node)
    close(1, n)
    root.seal(n, hashed)
    return root


_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _raw_end(html: str, tag: str, at: int, lacks: set[str]) -> tuple[int, int]:
    """Bounds of the closing tag of an element whose content is not markup; the page's end if there is none."""
    stop = None if f"</{tag}" in lacks else _RAW_END[tag].search(html, at)
    if stop is None:
        lacks.add(f"</{tag}")
        return len(html), len(html)
    return stop.start(), stop.end()


def attributes(node: Node) -> dict[str, str]:
    """The attributes that are looked at; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(node.attrs) if node.attrs else ():
        if (name := m[1].lower()) in _READ:
            out.setdefault(name, (m[2] or "").strip("\"'"))
    return out


def unwanted(node: Node) -> bool:
    """Whether the element is never main text, by its name, class, id, role or being hidden."""
    if node.tag in NEVER:
        return True
    if not node.attrs or node.tag in ("html", "body"):
        return False
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    return any(part.lower() in MARKS for key in ("class", "id") for part in _PARTS.split(a.get(key, "")) if part)


def digest(text: str) -> int:
    """Signed 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def subtree_hash(node: Node, plain: bool = False) -> int:
    """Digest of the subtree; plain blocks of a marked article have digests of their own."""
    return node.hash ^ 0x5D7A3E1C9B24F068 if plain else node.hash


def whole_block(node: Node) -> bool:
    return node.tag in BLOCKS and node.tag not in ITEMS


FRAME = ("html", "body", "article", "main")


def marked(node: Node) -> bool:
    return bool({"class", "id", "role"} & attributes(node).keys()) if node.attrs else False


def elements(root: Node):
    """(element, plain) that can be template: all but the page's frame, void elements and plain parts of an article's blocks."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        for child in node.children:
            if isinstance(child, Node):
                plain = inside and not marked(child)
                if child.tag not in FRAME and child.end > child.start and child.tag not in VOID and (not plain or whole_block(child)):
                    yield child, plain
                todo.append((child, (inside or child.tag in ("article", "main")) and (child.tag in FRAME or plain)))


#: The host of an absolute url; the same pattern serves Spark and Python.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str | None) -> str:
    m = re.match(HOST, url or "")
    return m[1].lower() if m else ""


def _roots(root: Node) -> list[Node]:
    """The outermost wanted articles, else mains, else the body, else the whole page; those inside unwanted elements only if there are no others."""
    for inside in (False, True):
        for name in ("article", "main", "body"):
            found: list[Node] = []
            todo = [root]
            while todo:
                node = todo.pop()
                bad = unwanted(node)
                if node.tag == name and not bad:
                    found.append(node)
                elif inside or not bad:
                    todo += [c for c in reversed(node.children) if isinstance(c, Node)]
            if found:
                return found
    return [root]


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text, joined by one newline."""
    return "\n".join(text for _, text in blocks_of(parse(html, bool(template)), template)) if html else ""


def blocks_of(tree: Node, template: frozenset[int] = frozenset()) -> list[tuple[int, str]]:
    """The blocks of main text, each with a place in the page inside its element."""
    blocks: list[tuple[int, str]] = []
    now: list[str] = []

    def flush(at: int) -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            blocks.append((at, text))
        now.clear()

    for root in _roots(tree):
        inside = root.tag in ("article", "main")
        # what is left to do, last first: a string, the end of a block, or an element in its surroundings
        todo: list = [(c, root.start, inside, True) for c in reversed(root.children)]
        while todo:
            child, at, inside, plain = todo.pop()
            if isinstance(child, str):
                now.append(child)
                continue
            if child is None:
                flush(at)
                continue
            block = child.tag in BLOCKS
            still = plain and not marked(child)
            if template and child.tag not in FRAME and subtree_hash(child, inside and still) in template:
                if block:
                    flush(at)
                continue
            if unwanted(child):
                now.append(" ")
                continue
            if child.tag == "br":
                now.append(" ")
            if block:
                flush(at)
                todo.append((None, child.start, False, False))
            frame = child.tag in ("article", "main")
            place = child.start if block else at
            todo += [(c, place, inside or frame, still or frame) for c in reversed(child.children)]
        flush(root.start)
    return blocks


def rest_leasts(blocks: list[tuple[int, str]], leasts: list[int], nodes: list[Node]) -> list[int]:
    """For each element the least shingle hash of the page's blocks outside it."""
    top = (1 << 63) - 1
    order = sorted(range(len(blocks)), key=lambda k: blocks[k][0])
    at, low = [blocks[k][0] for k in order], [leasts[k] for k in order]
    before, after = list(accumulate(low, min, initial=top)), list(accumulate(reversed(low), min, initial=top))[::-1]
    return [min(before[bisect_left(at, x.start)], after[bisect_left(at, x.end)]) for x in nodes]


def template_hashes(pages: DataFrame, share: float = TEMPLATE_SHARE, min_pages: int = MIN_PAGES, many: int = MANY) -> DataFrame:
    """(host, hashes): the subtrees that stand on at least ``share`` of the host's different pages, or blocks on ``many``.

    A different page is a text (``body``); ``least`` is the least hash of the shingles of the text
    around the subtree.  A null hash stands for the page.
    """

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch, "html"):
                found: set[tuple] = set()
                trees = [parse(h or "") for h in part.column("html").to_pylist()]
                pages_blocks = [blocks_of(t) for t in trees]
                sets = neardup.shingle_sets([t.encode("utf-8", "surrogatepass") for blocks in pages_blocks for _, t in blocks])
                leasts = iter([int(x[0]) if len(x) else 0 for x in sets])
                for url, tree, blocks in zip(part.column("url").to_pylist(), trees, pages_blocks, strict=True):
                    host, body, own = host_of(url), digest("\n".join(t for _, t in blocks)), [next(leasts) for _ in blocks]
                    found.add((host, None, body, 0, False, False))
                    each = list(elements(tree))
                    rest = rest_leasts(blocks, own, [x for x, _ in each])
                    found.update((host, subtree_hash(x, plain), body, least, plain, whole_block(x)) for (x, plain), least in zip(each, rest, strict=True))
                yield dict(zip(("host", "hash", "body", "least", "plain", "block"), map(list, zip(*found, strict=True)), strict=True))

        return one

    seen = map_batches(pages.select("url", "html"), make, "host string, hash bigint, body bigint, least bigint, plain boolean, block boolean")
    # one row for each subtree and different page, so that no task gets all pages of a host
    each = seen.groupBy("host", "hash", "body").agg(F.min("least").alias("least"), F.max("plain").alias("plain"), F.max("block").alias("block"))
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("pages"), F.countDistinct("least").alias("apart"), F.max("plain").alias("plain"), F.max("block").alias("block"))
    # subtrees found once are most of them and never template; the null hash counts a host's pages
    counts = cut(counts.filter((F.col("pages") > 1) | F.col("hash").isNull()))
    hosts = counts.filter("hash is null").select("host", F.col("pages").alias("all_pages")).filter(F.col("all_pages") >= min_pages)
    enough = (F.col("pages") >= F.col("all_pages") * share) | (F.col("block") & (F.col("pages") >= many))
    often = counts.filter("hash is not null").join(hosts, "host").filter(enough).filter(~F.col("plain") | (2 * F.col("apart") >= F.col("pages")))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    kinds = dict(pages.dtypes)
    templates = cut(template_hashes(pages, share, min_pages))
    held = templates.agg(F.sum(F.size("hashes") + F.length("host") / 8 + 1)).head()[0] or 0
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    if held <= MAX_BROADCAST_HASHES:
        rows = rows.join(F.broadcast(templates), "host", "left")
    else:  # a host may hold a third of all pages, so its pages are dealt to several places
        dealt = rows.withColumn("place", F.pmod(F.xxhash64("html"), F.lit(PLACES)).cast("int"))
        rows = dealt.join(templates.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))), ["host", "place"], "left")

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            for part in slices(batch, "html"):
                columns = (part.column(c).to_pylist() for c in ("html", "hashes"))
                texts = [main_text(h, frozenset(t or ())) for h, t in zip(*columns, strict=True)]
                yield {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return one

    return map_batches(rows.select("page_id", "url", "html", "hashes"), make, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
