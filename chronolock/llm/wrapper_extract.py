"""Main text of web pages by union-free regular-expression inference.

The pages of a host are token streams (tags and text slots).  Streams are aligned one after another
with the wrapper so far: a mismatch becomes an optional group, adjacent equal groups become a
repeated one, and text becomes a slot.  Tasks align what they read, and Spark merges their wrappers
by host.  Each wrapper names the container of the article; its text is read from every page.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolock.llm.common import require, settle

# Fixed values of HTML: elements without content, raw elements, blocks, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Never part of an article, by element, and by a word of class, id or role.
APART = frozenset("head title nav header footer aside form button select textarea input dialog menu noscript template iframe object svg canvas audio video script style".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu menubar navigation navbar nav navlinks topbar masthead breadcrumb breadcrumbs pagination pager footer header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments reply replies respond disqus complementary contentinfo widget".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"\s+")
#: Levels of elements in wrappers; what is nested deeper is aligned as if it stood at this level.
DEPTH = 120
#: Pairs of elements up to which two lists are aligned with the most in common; longer ones in order.
PAIRS = 1 << 18
#: Hosts that a task holds wrappers for before it hands them on.
HOSTS = 2000
#: Hosts up to which the places of articles are broadcast; beyond, they are joined by host.
BROADCAST_HOSTS = 50_000


def _told(marks: list[str]) -> bool:
    """Whether a class, id or role consists of words that are never part of an article (``cookie-notice``
    does, ``related-work`` doesn't)."""
    return any(all(w in WORDS for w in re.findall("[a-z]+", mark)) and re.search("[a-z]", mark) for m in marks for mark in m.lower().split())


class Node:
    """An element: its label (name and first class, id or role), children, and text between them."""

    __slots__ = ("label", "name", "apart", "children", "parent", "depth", "inside")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        marks = [next(g for g in m.groups()[1:] if g is not None) for m in _MARKS.finditer(attributes)] if "=" in attributes else []
        self.name = name
        self.label = name + ("." + re.sub(r"\d+", "", marks[0].split()[0].lower()) if marks and marks[0].split() else "")
        above = parent is not None and parent.inside
        self.inside = above or name in ("article", "main")
        self.apart = (name in APART and not (name == "header" and above)) or (name not in ("html", "body", "article", "main") and _told(marks))
        self.children: list[Node | str] = []
        self.parent = parent
        self.depth = 0 if parent is None else parent.depth + 1


def parse(page: str) -> Node:
    """The tree of a page, of any depth; text is kept with its references decoded, comments and scripts go."""
    root = node = Node("#root", "", None)
    open_: dict[str, int] = {}  # elements of each name from the root to the node: what is not open is not looked for
    at = 0

    def leave(last: Node) -> Node:
        """The parent of ``last``, with all below it closed."""
        x = node
        while True:
            open_[x.name] -= 1
            if x is last:
                return last.parent or root
            x = x.parent

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        if page.startswith("</", m.start()):
            if open_.get(name):
                up = node
                while up.name != name:
                    up = up.parent
                node = leave(up)
            continue
        if name in BLOCKS or name in CLOSES:
            shut, hold = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS else set()), HOLDS.get(name, set()) | {"#root"}
            up = node if any(open_.get(x) for x in shut) else None
            while up is not None and up.name not in hold and up.name not in shut:
                up = None if name not in CLOSES and up.name in BLOCKS else up.parent
            if up is not None and up.name in shut:
                node = leave(up)
        new = Node(name, m[3] or m[5] or "", node)
        node.children.append(new)
        if name not in VOID:
            node = new
            open_[name] = open_.get(name, 0) + 1
    if at < len(page):
        node.children.append(html.unescape(page[at:]))
    return root


# A wrapper element is [label, optional, repeated, characters, elements, text]; a text slot has label "#",
# and a checksum of its text as long as all pages have the same there, else None.


def _fold(items: list, within: bool) -> list:
    """Adjacent equal groups of up to 3 elements as one repeated group."""
    out: list = []
    for x in items:
        out.append(x)
        for k in (1, 2, 3):
            if len(out) >= 2 * k and all(a[0] == b[0] for a, b in zip(out[-2 * k : -k], out[-k:])):
                for a, b in zip(out[-2 * k : -k], out[-k:]):
                    m = merge(a, b, within)
                    m[2] = True
                    a[:] = m
                del out[-k:]
                break
    return out


def _shallow(node: Node) -> Iterator[Node | str]:
    """Children; at level ``DEPTH`` all that is below, in order."""
    if node.depth < DEPTH - 1:
        yield from node.children
        return
    todo = list(reversed(node.children)) if node.depth == DEPTH - 1 else []
    while todo:
        x = todo.pop()
        yield x
        if isinstance(x, Node):
            todo.extend(reversed(x.children))


def stream(node: Node) -> list:
    """An element's folded token stream."""
    items = []
    for c in _shallow(node):
        if isinstance(c, str):
            if plain := _BLANK.sub("", c):
                items.append(["#", False, False, len(plain), [], zlib.crc32(plain.encode("utf-8", "surrogatepass"))])
        else:
            items.append(stream(c))
    return [node.label, False, False, 0, _fold(items, True), None]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of elements of one label that both lists have in order: the most there are, or, of long
    lists, the next one each time."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head][0] == b[head][0]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail][0] == b[m - 1 - tail][0]:
        tail += 1
    found = [(i, i) for i in range(head)]
    n, m = n - tail, m - tail
    if (n - head) * (m - head) > PAIRS:
        where: dict[str, list[int]] = {}
        for j in range(head, m):
            where.setdefault(b[j][0], []).append(j)
        j = head
        for i in range(head, n):
            places = where.get(a[i][0], [])
            k = bisect_left(places, j)
            if k < len(places):
                found.append((i, places[k]))
                j = places[k] + 1
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, head - 1, -1):
            for j in range(m - 1, head - 1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
        i = j = head
        while i < n and j < m:
            if a[i][0] == b[j][0]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return found + [(n + k, m + k) for k in range(tail)]


def align(a: list, b: list, within: bool) -> list:
    """Two lists of elements as one: what both have, in order, and the rest as optional groups."""
    out, i, j = [], 0, 0
    for x, y in [*_common(a, b), (len(a), len(b))]:
        out += [[e[0], True, *e[2:]] for e in a[i:x]] + [[e[0], True, *e[2:]] for e in b[j:y]]
        if x < len(a):
            out.append(merge(a[x], b[y], within))
        i, j = x + 1, y + 1
    return _fold(out, within)


def merge(a: list, b: list, within: bool = False) -> list:
    """Two elements of one label as one: of two pages, texts that differ make a slot; ``within`` a page
    they follow each other."""
    text = zlib.crc32(b"%d %d" % (a[5] or 0, b[5] or 0)) if within and a[0] == "#" else a[5] if a[5] == b[5] else None
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], align(a[4], b[4], within) if a[4] != b[4] else [merge(x, y, within) for x, y in zip(a[4], b[4])], text]


def shape(x: list) -> str:
    return f"{x[0]}{'?' if x[1] else ''}{'+' if x[2] else ''}" + (f"({' '.join(map(shape, x[4]))})" if x[4] else "")


def _add(a: list, b: list) -> None:
    """Add the characters of ``b`` to ``a``, which has the same shape."""
    a[3] += b[3]
    a[5] = a[5] if a[5] == b[5] else None
    for x, y in zip(a[4], b[4]):
        _add(x, y)


def _apart(label: str) -> bool:
    name, _, mark = label.partition(".")
    return name in APART or (name not in ("html", "body", "article", "main") and _told([mark]))


def mass(x: list, slots: bool) -> int:
    """Characters of an element; with ``slots`` only of texts that differ between pages."""
    return 0 if x[0] != "#" and _apart(x[0]) else (0 if slots and x[5] is not None else x[3]) + sum(mass(c, slots) for c in x[4])


def article_path(wrapper: list) -> list[str]:
    """The labels from the root to the container of the article: the article or main element with
    most text, else the deepest element that holds three quarters of the text in slots: what all pages of
    a host have alike (menus, notices) is template, whatever its names.  Where nothing differs, of a
    host of one page, it is that element or, without one, the whole body: nothing tells which of its parts
    is the article."""
    slots = mass(wrapper, True) > 0
    found: list[tuple[int, list[str]]] = []

    def visit(x: list, path: list[str]) -> None:
        for c in x[4]:
            if c[0] != "#" and not _apart(c[0]):
                own = [*path, c[0]]
                if c[0].partition(".")[0] in ("article", "main"):
                    found.append((mass(c, slots), own))
                visit(c, own)

    visit(wrapper, [])
    if found:
        most = max(n for n, _ in found)
        inner = [p for n, p in found if n >= 0.75 * most and p[-1].startswith("article")] or [p for n, p in found if n == most]
        return min(inner, key=len)
    path, node = [], wrapper
    while slots:
        total = mass(node, slots)
        kids = [(mass(c, slots), c) for c in node[4] if c[0] != "#"]
        n, best = max(kids, key=lambda k: k[0], default=(0, None))
        if best is None or not total or n < 0.75 * total or best[2] or best[0].partition(".")[0] in ("p", "li", "tr", "td", "span", "b", "i", "a"):
            break
        path, node = [*path, best[0]], best
    return path


def text_of(tree: Node, path: list[str]) -> str:
    """The blocks of the elements at ``path`` (of the body, if the page has none), one a line."""
    level: list[Node] = [tree]
    for label in path:
        level = [c for n in level for c in n.children if isinstance(c, Node) and c.label == label]
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := _BLANK.sub(" ", "".join(held)).strip():
            blocks.append(text)
        held.clear()

    todo: list[Node | str | None] = list(reversed(level or [tree]))
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif x.apart:
            held.append(" ") if x.name not in BLOCKS else close()
        elif x.name == "br":
            held.append(" ")
        else:
            block = x.name in BLOCKS or x.name == "#root"
            if block:
                close()
                todo.append(None)
            todo.extend(reversed(x.children))
    close()
    return "\n".join(blocks)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[str, list]] = {}

    def flush() -> pa.RecordBatch:
        rows = []
        for host, shapes in held.items():
            whole: list | None = None
            for _, x in sorted(shapes.items()):
                whole = x if whole is None else merge(whole, x)
            rows.append((host, json.dumps(whole)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["host", "wrapper"])

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = stream(parse(page))
            own = held.setdefault(host, {})
            key = shape(x)
            if key in own:
                _add(own[key], x)
            else:
                own[key] = x
            if len(own) > 64:
                whole = None
                for _, y in sorted(own.items()):
                    whole = y if whole is None else merge(whole, y)
                held[host] = {shape(whole): whole}
        if len(held) > HOSTS:
            yield flush()
    if held:
        yield flush()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for w in sorted(set(pdf["wrapper"])):
        x = json.loads(w)
        whole = x if whole is None else merge(whole, x)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(whole)]})


def _hosted(pages: DataFrame) -> DataFrame:
    require(pages, ("page_id", "url", "html"), "pages")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON): the wrapper of all pages of each host, merged in two steps so that no
    task gets more than a few wrappers from each task of the first."""
    parts = _hosted(pages).select("host", "html").mapInArrow(_infer, "host string, wrapper string")
    some = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(16))).groupBy("host", "salt").applyInPandas(_merged, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(_merged, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    The text is that of the article's container in the host's wrapper, without parts that are no
    article (:data:`APART`, :data:`WORDS`); of the whole body where a page lacks the container.  Null
    or empty html gives an empty text; pages without a host in their url share a wrapper; repeated
    rows repeat their result; an empty table gives none.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(article_path(json.loads(w))) for w in b.column(1).to_pylist()], pa.string())], ["of_host", "path"])

    places = settle(wrappers(pages).mapInArrow(paths, "of_host string, path string"), "wrappers")
    few = places.count() <= BROADCAST_HOSTS
    rows = _hosted(pages)
    rows = rows.join(F.broadcast(places) if few else places, rows["host"] == F.col("of_host"), "left").select("page_id", "url", "html", "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of(parse(h), json.loads(p or "[]")) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
