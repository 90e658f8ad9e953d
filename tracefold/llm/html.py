"""Main-text extraction by consensus host paths.

Every page is parsed into containers, each known by its generalised tag-class
path (digits in class names read as ``#``).  The page votes for the lowest
container that holds all of its text that is neither boilerplate nor link text
(an ``article`` or ``main`` around that comes first).  Votes are summed by host
and path in Spark, and the pages are extracted again with their host's winning
path; a page with any such text outside that path uses its own vote.

Tags, roles and names mark containers as boilerplate with all they hold.  On a
page whose ``article`` or ``main`` is not marked the marks stand.  Elsewhere a
mark is taken back if its container holds the page's ``main`` or only
``article``, or more text than is left unmarked, as layout classes, page-wide
forms and unclosed elements do.

Only (host, path) counts are shuffled by host, with map-side sums, so a host
with a third of all pages costs one row per map task.  The winners, a row per
host, are joined to the pages by Spark's choice of join.

Every element may be marked: containers with all they hold, paragraphs and
headings up to the next block, elements inside a line by fewer words and without
breaking the line.  Inside an article a header and its names are no marks.

Defined cases: null html is an empty page with text ``""``; null url is the
host ``""``; pages without markup are one block; very long or deep pages are
read in time and memory by their size, and paths deeper than DEEPEST are known
by a hash; repeated rows are kept; an empty table gives no rows; other columns
are ignored, whatever their names.  White space is what
Unicode calls so; ``<br>`` is white space inside its block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*+>|<[!?/][^<>]*+>",
    re.S,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")

#: fixed values: HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CONTAINERS = frozenset("html body div article main section center table tbody tr td th ul ol dl li aside nav header footer form fieldset dialog menu search details figure blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr dt dd thead tfoot caption figcaption address summary hgroup legend option select optgroup".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog search script style textarea title noscript template iframe svg canvas object button select option head map audio video".split())
#: fixed values: words of class and id names, and roles, that mark boilerplate
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead topbar comment comments disqus replies respond cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended "
    "widget toolbar pagination pager skip login".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: a class name with one of these words is boilerplate only if its last word says so
KEEPS = frozenset("body content article post entry main story".split())
#: fixed values: words that do not mark a paragraph or heading, and those that alone mark an element inside a line
HEADINGS = frozenset("header masthead topbar banner banners".split())
INLINE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent popup modal newsletter subscribe signup share sharing skip".split())
ANCESTRY = frozenset(("html", "body", "article", "main"))
#: marks that are taken back: readily, for more text than is unmarked, for the only text, never
LOOSE, FIRM, HIDDEN, FINAL = 1, 2, 3, 4
SECTIONS = frozenset("nav aside footer header search".split())


@dataclass(eq=False, slots=True)
class Node:
    """A container or a marked element: its parent, path, own mark, and whether it or something above it is boilerplate."""

    parent: Node | None
    tag: str
    path: str
    mark: int
    bad: bool
    article: bool
    depth: int = 0
    inline: bool = False
    in_paragraph: bool = False


#: a path that is deeper or longer is known by its hash, so that deep pages take memory by their size
DEEPEST, LONGEST = 64, 2048


def _path(top: Node, step: str) -> str:
    whole = f"{top.path}/{step}"
    if top.depth < DEEPEST and len(whole) <= LONGEST:
        return whole
    return "#" + hashlib.blake2b(whole.encode(), digest_size=12).hexdigest()


def _is_article(tag: str, attributes: dict[str, str]) -> bool:
    return tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"


def _named(attributes: dict[str, str], marks: frozenset[str]) -> bool:
    """Whether a class or id name marks boilerplate.

    A name that says nothing but the mark always does; one that also has a word
    of KEEPS does by its last word; where another name is a word of KEEPS alone,
    only the first kind does.
    """
    names = [WORDS.findall(n) for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()]
    keep = any(n and all(w in KEEPS for w in n) for n in names)
    for n in names:
        if not any(w in marks for w in n):
            continue
        if all(w in marks for w in n) or not keep and (n[-1] in marks or not any(w in KEEPS for w in n)) or any(w in KEEPS for w in n) and n[-1] in marks:
            return True
    return False


def _boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """The mark of an element, 0 for none."""
    if tag in SECTIONS and (tag != "header" or not in_article):
        return FIRM
    if tag in BOILERPLATE and tag not in ("form", "header"):
        return FINAL
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return HIDDEN
    if tag == "form" or attributes.get("role", "").lower() in ROLES:
        return LOOSE
    if tag in ANCESTRY or _is_article(tag, attributes):
        return 0
    if tag not in BLOCKS:
        marks = INLINE
    elif tag not in CONTAINERS or in_article:
        marks = MARKS - HEADINGS
    else:
        marks = MARKS
    return LOOSE if _named(attributes, marks) else 0


def _marked_above(node: Node, known: dict[int, Node | None]) -> Node | None:
    """The nearest marked element at or above a node; each node is passed once."""
    passed, n = [], node
    while n is not None and not n.mark and id(n) not in known:
        passed.append(n)
        n = n.parent
    found = n if n is None or n.mark else known[id(n)]
    for p in passed:
        known[id(p)] = found
    return found


def _unmark(blocks: list[tuple[Node, str, int]]) -> None:
    """Take back the marks of containers that hold the main text; see above."""
    while not any(node.article and not node.bad and len(t) > link for node, t, link in blocks):
        free, held, known, articles = 0, {}, {}, {}
        for node, t, link in blocks:
            score, n = len(t) - link, _marked_above(node, known)
            if n is None:
                free += score
            elif score:
                of = held.setdefault(id(n), [0, n, {}])
                of[0] += score
                inner = _outermost_article(node, n, articles)
                if inner is not None:
                    of[2][id(inner)] = inner
        every = {i for _, _, inner in held.values() for i in inner}
        found = []
        for score, n, inner in held.values():
            named = n.mark == LOOSE and len(every) == 1 and inner or n.mark in (LOOSE, FIRM) and any(i.tag != "article" for i in inner.values())
            if named or n.mark in (LOOSE, FIRM) and score > free or n.mark == HIDDEN and not free:
                found.append((bool(named), score, n))
        if not found:
            return
        max(found, key=lambda x: x[:2])[2].mark = 0
        known = {}
        for node, _, _ in blocks:
            node.bad = _marked_above(node, known) is not None


def _outermost_article(node: Node, mark: Node, known: dict[int, Node | None]) -> Node | None:
    """The outermost article between a node and the marked element above it; none if the mark itself is inside one."""
    if mark.article:
        return None if mark.parent is not None and mark.parent.article else mark
    passed, n = [], node
    while n is not mark and n.article and id(n) not in known:
        passed.append(n)
        n = n.parent
    top = known[id(n)] if id(n) in known else (passed[-1] if passed else None)
    for p in passed:
        known[id(p)] = top
    return top


def parse(page: str) -> list[tuple[Node, str, int]]:
    """Blocks of text in page order: their container, text, and how much of it is link text.

    Containers are on a stack; so are marked elements inside a line, whose text
    is left out without breaking the block.  A marked paragraph or heading is a
    node of its own until the next block begins.
    """
    root = Node(None, "", "", 0, False, False)
    stack: list[Node] = [root]
    paths: dict[str, str] = {}
    opened: dict[str, int] = {}  # tags on the stack
    blocks: list[tuple[Node, str, int]] = []
    text: list[str] = []
    links, hidden, link_chars = 0, 0, 0  # open <a>, marked elements inside a line
    paragraph = False  # whether a block that is no container is open
    here: Node | None = None  # the marked paragraph or heading that is open
    at = 0

    def flush() -> None:
        nonlocal link_chars
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                blocks.append((here or stack[-1], t, min(link_chars, len(t))))
            text.clear()
        link_chars = 0

    def put(piece: str) -> None:
        nonlocal link_chars
        if piece and not hidden:
            text.append(piece)
            if links:
                link_chars += len(piece.strip())

    def push(node: Node) -> None:
        nonlocal hidden
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1
        hidden += node.inline

    def pop() -> None:
        nonlocal hidden
        node = stack.pop()
        opened[node.tag] -= 1
        hidden -= node.inline

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        token = m.group()
        named = NAME.match(token)
        if named is None:
            continue
        tag, closing = named.group(1).lower(), token[1] == "/"
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            while stack[-1].inline and stack[-1].in_paragraph:
                pop()
            flush()
            links, here = 0, None
            paragraph = not closing and tag not in CONTAINERS and tag not in VOID
        if closing:
            if opened.get(tag) and (tag in CONTAINERS or tag in BOILERPLATE or any(n.inline for n in stack[-1:])):
                inline = stack[-1].inline and stack[-1].tag == tag
                if not inline:
                    flush()
                while stack[-1].tag != tag:
                    pop()
                pop()
            if tag == "a" and links:
                links -= 1
            continue
        if tag == "br":
            put(" ")
        elif tag == "a":
            links += 1
        if tag in VOID:
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(token)}
        if "hidden" in token and re.search(r"\shidden(?=[\s>/=])", token):
            attributes["hidden"] = ""
        if tag == "li" and stack[-1].tag == "li":
            pop()
        top = stack[-1]
        mark = _boilerplate(tag, attributes, top.article)
        if tag in CONTAINERS or tag in BOILERPLATE:
            flush()
            article = top.article or _is_article(tag, attributes)
            classes = ".".join(sorted(DIGITS.sub("#", attributes.get("class", "")).replace("/", "|").split()))
            path = _path(top, f"{tag}.{classes}" if classes else tag)
            if not token.endswith("/>") or tag in CONTAINERS:
                push(Node(top, tag, paths.setdefault(path, path), mark, top.bad or mark > 0, article, top.depth + 1))
        elif mark and tag in BLOCKS:
            here = Node(top, tag, top.path, mark, True, top.article, top.depth + 1)
        elif mark and not token.endswith("/>"):
            push(Node(top, tag, top.path, mark, True, top.article, top.depth + 1, True, paragraph))
        elif top.inline and tag == top.tag and not token.endswith("/>"):
            push(Node(top, tag, top.path, 0, True, top.article, top.depth + 1, True, top.in_paragraph))
    flush()
    _unmark(blocks)
    return blocks


def vote(blocks: list[tuple[Node, str, int]]) -> tuple[str, int]:
    """The path of the lowest container that holds all the main text, and the score of that text.

    The container only moves up, and what is known to lie below it is not
    climbed again, so each node is passed once.
    """
    total, pick = 0, None
    above: set[int] = set()  # what is above pick
    below: set[int] = set()  # pick, and what is known to lie below it
    for node, t, link in blocks:
        score = 0 if node.bad else len(t) - link
        total += score
        if not score:
            continue
        if pick is None:
            pick = node
            below.add(id(node))
            n = node.parent
            while n is not None:
                above.add(id(n))
                n = n.parent
            continue
        n = node
        while id(n) not in below and id(n) not in above:
            below.add(id(n))
            n = n.parent
        if id(n) in above:
            while pick is not n:
                pick = pick.parent
                above.discard(id(pick))
                below.add(id(pick))
    if pick is None:
        return "", 0
    while pick.tag in ("li", "td", "th", "tr", "tbody", "blockquote", "figure") and pick.parent is not None:
        pick = pick.parent
    outer: dict[str, Node] = {}
    node = pick
    while node is not None:
        outer[node.tag] = node
        node = node.parent
    return outer.get("article", outer.get("main", pick)).path, total


def extract(blocks: list[tuple[Node, str, int]], path: str | None) -> str:
    """The blocks under ``path`` that are not boilerplate; under the page's own vote if that path does not hold all the main text."""
    own, score = vote(blocks)

    def under(p: str) -> list[tuple[Node, str, int]]:
        out, known = [], {}
        for node, t, link in blocks:
            if node.bad:
                continue
            passed, n = [], node
            while n is not None and n.path != p and id(n) not in known:
                passed.append(n)
                n = n.parent
            inside = n is not None and known.get(id(n), True)
            for x in passed:
                known[id(x)] = inside
            if inside:
                out.append((node, t, link))
        return out

    got = under(path) if path else []
    if sum(len(t) - link for _, t, link in got) < score or not got:
        got = under(own)
    return "\n\n".join(t for _, t, _ in got)


def host_column() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most pages of a host vote for; ties by text held, then by path."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path, score = vote(parse(page.as_py() or ""))
                if path:
                    s = sums.setdefault((host, path), [0, 0])
                    s[0] += 1
                    s[1] += score
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1] for k in keys], pa.int64())],
                ["host", "path", "votes", "score"],
            )

    cast = pages.select(host_column().alias("host"), "html").mapInArrow(votes, "host string, path string, votes bigint, score bigint")
    sums = cast.groupBy("host", "path").agg(F.sum("votes").alias("v"), F.sum("score").alias("s"))
    return sums.groupBy("host").agg(F.max(F.struct("v", "s", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path: every page with its main text."""
    winners = materialize(host_paths(pages), "host-paths")

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(parse(page.as_py() or ""), path) for page, path in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), sizes, b.column(3)], ["page_id", "url", "text", "n_chars", "path"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_column().alias("host"))
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(text_of, "page_id bigint, url string, text string, n_chars bigint, path string")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
