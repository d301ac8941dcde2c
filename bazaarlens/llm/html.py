"""Main text of web pages by consensus of a host's pages on the path of the main container."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, small_enough, stage, text_batches

__all__ = ["parse_page", "page_text", "page_votes", "host_paths", "extract_pages"]

# HTML's element kinds, and the names by which sites mark what is not the article.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINER = {"html", "body", "main", "article", "section", "div", "td", "th", "tr", "table", "tbody", "thead", "tfoot", "center", "blockquote", "figure",
             "figcaption", "ul", "ol", "dl", "li", "dd", "dt", "details", "fieldset"}
BLOCK = CONTAINER | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "br", "address", "summary", "caption", "legend", "option"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head"}
ASIDE_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
               "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
               "signup", "login", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "rail", "aside", "widget", "footer",
               "header", "masthead", "comment", "comments", "commentlist", "respond", "replies", "disqus", "share", "sharing", "social", "related",
               "recommended", "pagination", "pager", "toolbar", "form", "search", "responses", "reply", "discussion", "talkback", "complementary",
               "contentinfo"}
ARTICLE_NAMES = {"article", "post", "story", "entry", "content", "main", "text", "body", "page"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEADING_NAMES = {"header", "masthead", "banner"}       # on a heading they only say that it is one
HOLDING = {"pre", "address", "summary", "caption"}     # no containers, but they may hold blocks

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z", re.I | re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
BESIDE = re.compile(r"(?:^|(?<=[-_\s]))(?:with|has|no)[-_]\S*")      # tells of a neighbour, not of the element itself
REAL = 25        # characters outside links from which a block beside a container is real text
REST = 0.1       # share of a container's text that must stand beside it for body to be taken
PLACES = 0.1     # share of a host's pages from which a path wins beside the first
PLAIN, MARKED, MIXED, HARD = range(4)     # what tag and names say: nothing, aside by name, by name but of the article too, aside by tag


class _Element:
    __slots__ = ("tag", "step", "on", "parent", "mark", "aside", "sign", "score", "start", "end", "leaf", "near", "text", "free", "rest")

    def __init__(self, tag: str, step: str, parent: _Element | None, mark: int, start: int, leaf: bool = False, on: str | None = None):
        self.tag, self.step, self.parent, self.mark, self.start, self.end, self.leaf = tag, step, parent, mark, start, -1, leaf
        self.on = on      # its path, if that is or leads to a winning one
        self.aside, self.score = False, 0.0
        self.sign = tag in ("article", "main") and mark == PLAIN
        self.text = self.free = self.rest = 0     # characters outside links: below it, below it outside marked elements, beside it
        self.near = self if mark != PLAIN or parent is None else parent.near

    @property
    def path(self) -> str:
        steps, e = [], self
        while e is not None:
            steps.append(e.step)
            e = e.parent
        return "".join(reversed(steps))


def _names(attrs: str, but: set[str] = frozenset()) -> tuple[str, int, bool]:
    """The generalised class of a start tag (digits as #, classes in order), how its names, ``but`` for some, mark it, and
    whether they are names of articles."""
    kind, aside, article = "", False, False
    if "=" in attrs:
        for name, a, b, c in NAMES.findall(attrs):
            value = a or b or c
            if name.lower() == "class":
                kind = ".".join(sorted(DIGITS.sub("#", value.lower()).split()))
            words = set(re.split(r"[^a-z]+", BESIDE.sub(" ", HUMPS.sub("-", value).lower()))) - but
            aside |= not ASIDE_NAMES.isdisjoint(words)
            article |= not ARTICLE_NAMES.isdisjoint(words)
    return kind, (MIXED if article else MARKED) if aside else PLAIN, article


def _settle(elements: list[_Element], blocks: list[tuple[str, int, bool, _Element]]) -> list[tuple[str, int, bool]]:
    """Decide which marked elements are asides, score the others and return the blocks that stand in no aside.

    A name is no verdict. An element with names of both kinds is the article's if it holds more text than stands beside it,
    one with aside names alone if all but a tenth of the text is in it and with it an h1, an article, main or a container
    of an article's name. Text beside it is all that no other aside or marked element holds. Elements on winning paths
    are never asides by name.
    """
    for _, value, h1, top in blocks:
        top.text += value
        top.near.free += value
        top.sign |= h1
    for e in reversed(elements):
        if e.parent is not None and e.mark != HARD:
            e.parent.text += e.text
            e.parent.sign |= e.sign
    for e in elements:
        if e.parent is None:
            continue
        outer = e.parent.near
        e.rest = e.parent.rest + outer.free if e.parent is outer else e.parent.rest
        if e.parent.aside or e.mark == HARD:
            e.aside = True
        elif e.mark == MIXED:
            e.aside = e.text <= e.rest and e.on is None
        elif e.mark == MARKED:
            e.aside = not ((e.sign or e.tag in ("article", "main")) and e.rest < REST * e.text) and e.on is None
    left, places = [], [0]
    for text, value, h1, top in blocks:
        if not top.aside:
            left.append((text, value, h1))
            top.score += value
            if top.parent is not None:
                top.parent.score += value / 2
        places.append(len(left))
    for e in elements:
        e.start, e.end = places[e.start], places[e.end]
        if e.tag in ("article", "main"):
            e.score *= 1.5
    return left


def parse_page(page: str, paths: list[str] | None = None) -> tuple[list[_Element], list[tuple[str, int, bool]]]:
    """The containers of a page, scored, and its text blocks outside asides as (text, length without links, whether an h1).

    A block's length without links goes to its container and half of it to the container around that, as in the known
    readability measures; article and main count half as much again. Elements on ``paths`` or above them are no asides by name.
    """
    kept = {path[:n] for path in paths or () for n in [*(m.start() for m in re.finditer(">", path)), len(path)]}
    root = _Element("", "", None, PLAIN, 0, on="")
    elements, stack, blocks = [root], [root], []
    buffer: list[str] = []
    linked = 0
    in_link = False
    block = ""     # the tag that the running block stands in

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            top = stack[-1]
            if text and top.near.mark != HARD:
                blocks.append((text, max(0, len(text) - 2 * linked), block == "h1", top))
            buffer.clear()
        linked = 0

    def leave(k: int) -> None:
        for e in stack[k:]:
            e.end = len(blocks)
        del stack[k:]

    last = 0
    for m in TOKEN.finditer(page):
        if m.start() > last:
            piece = page[last:m.start()]
            buffer.append(piece)
            linked += len(piece) if in_link else 0
        last = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
        if tag not in BLOCK and tag not in ASIDE:
            top = stack[-1]
            within = top.tag == tag   # an inline element that its names mark as aside
            if m["end"]:
                if within:
                    flush()
                    stack.pop().end = len(blocks)
            elif tag not in VOID and (within or ("=" in m["attrs"] and tag != "a" and _names(m["attrs"])[1])):
                flush()
                stack.append(_Element(tag, f">{tag}", top, MARKED, len(blocks)))
                elements.append(stack[-1])
            continue
        flush()
        if tag != "br":
            block = "" if m["end"] else tag
            # a paragraph or heading that its names mark as aside reaches to the next block, others to their end tags
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].leaf and (stack[k].tag not in HOLDING or (m["end"] and stack[k].tag == tag)):
                    leave(k)
                    break
                if stack[k].tag in CONTAINER or stack[k].tag in ASIDE:
                    break
        if tag not in CONTAINER and tag not in ASIDE:
            if not m["end"] and tag not in VOID and "=" in m["attrs"] and _names(m["attrs"], HEADING_NAMES if tag in HEADINGS else set())[1]:
                top = stack[-1]
                stack.append(_Element(tag, f">{tag}", top, MARKED, len(blocks), True))
                elements.append(stack[-1])
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    leave(k)
                    break
            continue
        kind, mark, article = _names(m["attrs"])
        top = stack[-1]
        if tag in ASIDE or top.near.mark == HARD:
            mark = HARD
        elif tag in ("html", "body", "main"):     # the outermost containers hold the article whatever they are called
            mark = PLAIN
        step = f">{tag}" + f".{kind}" * bool(kind)
        on = None if top.on is None or top.on + step not in kept else top.on + step
        stack.append(_Element(tag, step, top, mark, len(blocks), on=on))
        stack[-1].sign |= article and mark == PLAIN and tag != "body"
        elements.append(stack[-1])
    buffer.append(page[last:])
    flush()
    leave(0)
    return elements, _settle(elements, blocks)


def _best(elements: list[_Element], blocks: list[tuple[str, int, bool]]) -> _Element | None:
    """The best-scored container, or what holds the whole article around it: the nearest article or main, and further up
    each parent of which blocks beside it are an h1 or real text; for body and above, only where an h1 or a tenth of the text is there.
    Where all text is in links, the first article or main with any."""
    best = max((e for e in elements if not e.aside), key=lambda e: (e.score, -e.start), default=None)
    if best is None or best.score <= 0:
        return next((e for e in elements if e.tag in ("article", "main") and not e.aside and e.end > e.start), None)
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    best = next((e for e in above if e.tag in ("article", "main")), best)
    for parent in above[above.index(best) + 1:]:
        beside = blocks[parent.start:best.start] + blocks[best.end:parent.end]
        own = sum(value for _, value, _ in blocks[best.start:best.end])
        enough = REST * own if parent.tag in ("", "html", "body") else 0
        real = sum(value for _, value, _ in beside if value >= REAL)
        if any(h1 and value for _, value, h1 in beside) or (real and real >= enough):
            best = parent
    return best


def page_text(page: str, paths: list[str] | None) -> str:
    """The blocks of the page's elements on the first winning path that gives text; else those of its own main container."""
    elements, blocks = parse_page(page, paths)
    for path in paths or ():
        chosen = {n for e in elements if e.on == path and not e.aside for n in range(e.start, e.end)}
        if chosen:
            return "\n".join(block[0] for n, block in enumerate(blocks) if n in chosen)
    best = _best(elements, blocks)
    return "" if best is None else "\n".join(text for text, _, _ in blocks[best.start:best.end])


def host_of(url: str) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def page_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the path of the main container of each page that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in parts(whole, "html")):
            hosts, paths = [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                best = _best(*parse_page(page or ""))
                if best is not None:
                    hosts.append(host)
                    paths.append(best.path)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])

    return text_batches(pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))).mapInArrow(run, "host string, path string")


def host_paths(votes: DataFrame, share: float = PLACES) -> DataFrame:
    """host, paths: the winning paths, most votes first: the first one and all others with ``share`` of the host's votes."""
    counted = votes.groupBy("host", "path").count()
    w = Window.partitionBy("host")
    ranked = counted.withColumns({"all": F.sum("count").over(w), "place": F.row_number().over(w.orderBy(F.desc("count"), "path"))})
    won = ranked.where((F.col("place") == 1) | (F.col("count") >= share * F.col("all")))
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 50_000) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Each page votes for the path (tags with classes, digits generalised) of its best-scored container or what holds the whole
    article around it; a host's winning paths are then applied to all its pages. A page without an element on them is cut by
    its own. Names of menus, adverts, comments and the like count against an element, unless most of the page's unlinked text is in
    it (see ``_settle``) or the host's winning path leads through it. White space in a block becomes one space; blocks are joined by a
    line break in page order.

    Null or empty html gives an empty text. Pages without a url form one host. Repeated rows come out alike. Other columns
    are not carried, so their names cannot clash. An empty table gives an empty result.
    """
    winners = stage(host_paths(page_votes(pages, url_col, html_col)))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    chosen = rows.join(F.broadcast(winners) if small_enough(winners, broadcast_rows) else winners, "host", "left")
    kept = [f for f in chosen.schema.fields if f.name in ("page_id", "url")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in parts(whole, "html")):
            texts = [page_text(page or "", paths) for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return text_batches(chosen.select("page_id", "url", "html", "paths")).mapInArrow(run, schema)
