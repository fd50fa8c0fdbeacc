"""Main text of web pages by consensus host paths.

Pass 1 scores each page's containers: every container with text of its own votes on its generalised path (tags
with classes, digits folded), with the text of its blocks that is prose for it and linked text against it. Spark counts
on how many different pages of a host each block of a path is found; text that recurs on ``RECURS`` of the path's
pages, and three at least, votes against it. Copies count as one page: pages are told apart by their three longest blocks.
Paths on three pages or more win or lose by these votes, and the path with most prose wins in any case.

Pass 2 extracts again, on hosts of ``ENOUGH`` different pages or more. The nearest path around a block that won or lost
decides; a block below neither is foreign, but on pages that have less than half of their text on winning paths,
which are of another layout and lose nothing but what is below losing paths. Other hosts' pages stand alone.

Left out before any vote are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden
parts and reader comments, told by tag, role or words of class and id; headings in an article's own header stay.
A part whose class sounds like boilerplate, but not like an advert, stays where the host's most prose is in it; on a page that stands alone,
where most of the page's text is. Text outside ``article`` and ``main`` is left out where these hold most of a page's text.
No share of the rest is given up. Blocks are cut at block tags and line breaks, in page order, white space in them turned into one space.

Defined results: null or empty html gives the empty text; pages cut anywhere are read up to there; a null
url is of a host without name; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches

#: Rules of up to this many paths go to every task (8 bytes a path and some 100 a host); more are joined by shuffle.
BROADCAST_PATHS = 200_000

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noframes noembed textarea title svg math xmp select object audio video canvas".split())
_DROP = frozenset("head nav aside footer form button menu dialog".split())
_CONTAINER = frozenset("html body div section article main td th center table tbody tr header blockquote ul ol dl li dd figure details fieldset".split())
_NAMED = frozenset("html body div section article main td center".split())
_BLOCK = _CONTAINER | _DROP | frozenset("p h1 h2 h3 h4 h5 h6 dt pre address figcaption caption thead tfoot hr br summary hgroup legend option".split())
_INLINE_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
_STOP = frozenset("table ul ol dl article section div main body html td th".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
_COMMENT = frozenset("comment comments disqus respond replies commentlist".split())
_BOILER = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended recommendations sidebar widget widgets breadcrumb breadcrumbs pagination pager menu nav navbar "
    "navigation footer header masthead topbar toolbar login signup signin paywall banner alert skip copyright toc tags teaser".split()
)
#: Of these, words that name advertising or a notice whatever the part's size.
_NEVER = frozenset("ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe".split())
_GOOD = frozenset("article post entry story content main articlebody body text".split())
_KEEP_CLASS = frozenset("html body main".split())


#: Different pages from which on a host's votes count, and pages of a path from which on it wins or loses.
ENOUGH, HELD = 5, 3
#: Share of a path's pages from which on a block that they have in common counts as boilerplate.
RECURS = 0.1


class Page:
    """Containers and text blocks of a page: parallel lists, containers in page order."""

    def __init__(self) -> None:
        self.parent, self.path, self.good = [-1], [""], [False]
        #: Whether a container is marked as the article or the main part by its tag.
        self.marked = [False]
        #: Of containers whose class sounds like boilerplate: the next such one around, and the class words.
        self.soft: dict[int, tuple[int, frozenset[str]]] = {}
        #: (container, text, link characters, index of the innermost such container around it or -1)
        self.blocks: list[tuple[int, str, int, int]] = []


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r") else {}


def parse(text: str) -> Page:
    page = Page()
    #: tag, container index, dropped, soft root, inside a link, an article's own header
    stack: list[tuple[str, int, bool, int, bool, bool]] = [("", 0, False, -1, False, False)]
    buffer: list[str] = []
    linked = 0
    pos, n = 0, len(text)

    def flush() -> None:
        nonlocal linked
        if buffer:
            words = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if words:
                page.blocks.append((stack[-1][1], words, min(linked, len(words)), stack[-1][3]))
        linked = 0

    def close(k: int) -> None:
        if any(x[0] in _BLOCK for x in stack[k:]):
            flush()
        del stack[k:]

    def add(piece: str) -> None:
        nonlocal linked
        tag, _, drop, _, link, own = stack[-1]
        if drop or (own and not any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup") for x in stack)):
            return
        buffer.append(piece)
        if link:
            linked += len(piece)

    while pos < n:
        m = _TAG.search(text, pos)
        if m is None:
            add(text[pos:])
            break
        if m.start() > pos:
            add(text[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if pos == n and not m[0].endswith(">"):
            break  # the page ends within a tag
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name not in _BLOCK and stack[k][0] in _BLOCK:
                    # An inline end tag doesn't close blocks; the element just ends.
                    for j in range(k - 1, 0, -1):
                        if stack[j][0] == name:
                            del stack[j]
                            if name == "a":
                                stack[j:] = [(*x[:4], False, x[5]) for x in stack[j:]]
                            break
                    break
            else:
                if name == "p" or name == "br":
                    flush()
            continue
        if name in _BLOCK:
            flush()
            if name not in ("br",):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _STOP:
                        break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _INLINE_ENDS.get(name, ()):
                    close(k)
                elif stack[k][0] in _STOP:
                    break
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, pos)
            pos = end.end() if end else n
            if not end and name in ("select", "object", "audio", "video", "canvas", "svg", "math"):
                pos = m.end()  # never closed: only the tag is left out
            continue
        if name in _VOID:
            continue
        tag, at, drop, soft, link, own = stack[-1]
        attributes = _attributes(m[3])
        classes = attributes.get("class", "")
        label = f"{classes} {attributes.get('id', '')}"
        words = {w.lower() for w in _WORDS.findall(label)} if label.strip() else frozenset()
        if name in _DROP or attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            drop = True
        elif name == "header":
            up = at
            while up > 0 and not page.good[up]:
                up = page.parent[up]
            if up > 0:
                own = True
            else:
                drop = True
        if words & _COMMENT and name not in ("html", "body", "main"):
            drop = True
        if name in _NAMED:
            page.parent.append(at)
            at = len(page.parent) - 1
            first = sorted(_DIGITS.sub("#", c.lower()) for c in classes.split())
            page.path.append(page.path[page.parent[at]] + ">" + ".".join([name, *first]))
            page.marked.append(name in ("article", "main") or attributes.get("itemprop") == "articleBody")
            page.good.append(page.marked[at] or (name in ("div", "section") and bool(words & _GOOD)))
        if words & _BOILER and name not in _KEEP_CLASS and name != "article" and not (name in ("h1", "h2", "h3") or own):
            if name in _NAMED:
                page.soft[at] = (soft, words & _BOILER)
                soft = at
            else:
                drop = True
        stack.append((name, at, drop, soft, link or name == "a", own))
        if name == "plaintext":
            add(entities.escape(text[pos:]))
            break
    flush()
    return page


def _below(page: Page, roots: set[int]) -> list[bool]:
    """For each container whether it is one of ``roots`` or below one."""
    inside = [False] * len(page.parent)
    for i in range(len(inside)):
        inside[i] = i in roots or (i > 0 and inside[page.parent[i]])
    return inside


def _path_ids(page: Page) -> list[int]:
    """Signed 64-bit hashes of the containers' generalised paths."""
    return [_signed(p) for p in page.path]


def _signed(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _soft_chain(page: Page, soft: int) -> Iterator[int]:
    while soft >= 0:
        yield soft
        soft = page.soft[soft][0]


def _prose(text: str, linked: int) -> int:
    return max(0, len(text) - linked - linked // 2)


Ballot = tuple[int, int | None, int | None, int, int]


def ballots(text: str | None) -> list[Ballot]:
    """What a page votes: (page, path, block, characters, characters of prose) for each of its blocks.

    ``page`` is a hash of its three longest blocks. A row without block stands for the path on the page, one
    without path and block for the page. Adverts and notices don't vote.
    """
    page = parse(text or "")
    ids = _path_ids(page)
    blocks = [b for b in page.blocks if not any(page.soft[s][1] & _NEVER for s in _soft_chain(page, b[3]))]
    if not blocks:
        return []
    key = _signed("\n".join(sorted((b[1] for b in blocks), key=lambda t: (-len(t), t))[:3]))
    rows: list[Ballot] = [(key, None, None, 0, 0)]
    rows += [(key, p, None, 0, 0) for p in {ids[b[0]] for b in blocks}]
    return rows + [(key, ids[at], _signed(t), len(t), _prose(t, link)) for at, t, link, _ in blocks]


class Rules:
    """What a host's pages decided: paths that won and lost, and the one with most prose."""

    def __init__(self, won: list[int], lost: list[int], most: int) -> None:
        self.won, self.lost, self.most = frozenset(won), frozenset(lost), most


def extract(text: str | None, rules: Rules | None = None) -> str:
    """The main text, by the host's ``rules`` or, without them, by the page alone."""
    page = parse(text or "")
    total = sum(len(b[1]) for b in page.blocks)
    marked = _below(page, {i for i, m in enumerate(page.marked) if m})
    ids = _path_ids(page) if rules else []
    if rules:
        main = {s for i, p in enumerate(ids) if p == rules.most for s in _above(page, i) if s in page.soft}
    else:
        held: dict[int, int] = {}
        for _, t, _, soft in page.blocks:
            for s in _soft_chain(page, soft):
                held[s] = held.get(s, 0) + len(t)
        article = any(marked[b[0]] for b in page.blocks if b[3] < 0)
        main = {s for s, size in held.items() if size > 0.6 * total and not article}
    main = {s for s in main if not page.soft[s][1] & _NEVER}
    blocks = [(at, t, link) for at, t, link, soft in page.blocks if all(s in main for s in _soft_chain(page, soft))]
    if rules:
        said: list[bool | None] = []
        for i, p in enumerate(ids):
            said.append(True if p in rules.won else False if p in rules.lost else said[page.parent[i]] if i else None)
        blocks = [b for b in blocks if said[b[0]] is not False]
        if 2 * sum(len(t) for at, t, _ in blocks if said[at]) > sum(len(t) for _, t, _ in blocks):
            blocks = [b for b in blocks if said[b[0]]]
    if 2 * sum(_prose(t, link) for at, t, link in blocks if marked[at]) > sum(_prose(t, link) for _, t, link in blocks):
        blocks = [b for b in blocks if marked[b[0]]]
    return "\n".join(t for _, t, _ in blocks)


def _above(page: Page, at: int) -> Iterator[int]:
    while at > 0:
        yield at
        at = page.parent[at]


def host_rules(pages: DataFrame) -> DataFrame:
    """(site, won, lost, most) of each host of ``pages`` (site, html) that has enough different pages.

    Votes are counted by block, then by path and number of pages, so that no group is larger than the different
    numbers that occur; only a host's paths on three pages or more meet in one row.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("site", "page", "path", "block", "chars", "prose")}
        for site, text in zip(batch.column("site").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for row in ballots(text):
                for k, v in zip(out, (site, *row), strict=True):
                    out[k].append(v)
        yield out

    votes = map_batches(pages, run, "site long, page long, path long, block long, chars long, prose long")
    once = votes.groupBy("site", "path", "block", "page").agg(F.max("chars").alias("chars"), F.max("prose").alias("prose"))
    block = once.groupBy("site", "path", "block").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("prose").alias("prose"))
    level = block.groupBy("site", "path", F.col("block").isNull().alias("mark"), "n").agg(F.sum("chars").alias("chars"), F.sum("prose").alias("prose"))
    path = level.groupBy("site", "path").agg(
        F.max(F.when(F.col("mark"), F.col("n"))).alias("pages"), F.sum("prose").alias("prose"), F.collect_list(F.struct("n", "chars", "prose")).alias("levels")
    )
    common = F.greatest(F.lit(float(HELD)), F.col("pages") * RECURS)
    # Prose that doesn't recur is for a path, all its other text against it.
    balance = F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + F.when(x["n"] >= common, -x["chars"]).otherwise(2 * x["prose"] - x["chars"]))
    path = path.select("site", "path", "pages", "prose", (balance > 0).alias("won"))
    enough = (F.col("pages") >= HELD) & F.col("path").isNotNull()
    site = path.groupBy("site").agg(
        F.max(F.when(F.col("path").isNull(), F.col("pages"))).alias("pages"),
        F.max_by("path", F.when(F.col("path").isNotNull(), F.struct("prose", "path"))).alias("most"),
        F.collect_list(F.when(enough & F.col("won"), F.col("path"))).alias("won"),
        F.collect_list(F.when(enough & ~F.col("won"), F.col("path"))).alias("lost"),
    )
    most = F.array("most")
    return site.where(F.col("pages") >= ENOUGH).select("site", F.array_union("won", most).alias("won"), F.array_except("lost", most).alias("lost"), "most")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host).alias("site"))
    rules = Scratch(pages.sparkSession, "hosts").write(host_rules(pages.select("site", "html")), "rules")
    if (rules.agg(F.sum(10 + F.size("won") + F.size("lost"))).first()[0] or 0) <= BROADCAST_PATHS:
        rules = F.broadcast(rules)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        columns = (batch.column(k).to_pylist() for k in ("html", "won", "lost", "most"))
        texts = [extract(t, None if won is None else Rules(won, lost, most)) for t, won, lost, most in zip(*columns, strict=True)]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.join(rules, "site", "left").select("page_id", "url", "html", "won", "lost", "most"), run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
