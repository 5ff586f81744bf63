"""Main text of web pages, with site templates removed.

Every page is parsed once, into blocks of text and the elements that hold them, with a hash of each element's subtree.
The hashes are counted in Spark by host and page, copies of a page as one: a subtree that recurs on many pages of its
host is part of the site's template, and its blocks are deleted. Four kinds of subtrees are counted:

* ``CONTAINER``: elements with some blocks. Outside an ``article`` or ``main`` element they are template from
  ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the host's pages on; inside, only from ``INNER_PAGES`` and ``INNER_SHARE`` on, as
  passages recur in articles too.
* ``SINGLE``: elements with one block, as a sentence or a paragraph that some pages share may well be their stories'. They
  are template from ``INNER_SHARE`` of the host's pages on (and as many pages as containers).
* ``NAMED``: elements whose class or id may mean furniture or not (``share``, ``notice``, ``related``, ...), by tag and names: they
  are furniture where ``LEAST_PAGES`` pages of the host or ``LEAST_HOSTS`` hosts have them, whatever they hold.
* ``FRAME``: on pages whose articles hold most of the text, the elements beside them, by their shape with all texts left
  out: they are the page's frame where most of the host's pages have them, otherwise a part of the story.

Nothing that holds most of its page's text (inside, of its page's text in articles) is a template.

What is never article text by its tag or role (menus, footers, ...), by names that mean nothing else (``sidebar``, ``cookie``,
``comments``, ...) or as a form goes without a count, as do pages' parts that are not shown. A class or id counts only if
it is made up of words for page furniture (and words like ``box`` or ``left``), and for nothing on an element that holds most of
the page's text in articles or, on a page without any, of its text; a form that holds that much, and parts of a page in it,
is the page.

Counts are summed before they are shuffled, and only template subtrees that hold text of no other kind are joined with
their pages, as that text goes anyway; so a host that holds a third of all pages makes no large group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from .scratch import Scratch

LEAST_PAGES, LEAST_SHARE = 3, 0.005
INNER_PAGES, INNER_SHARE = 10, 0.6
LEAST_HOSTS = 3
CONTAINER, SINGLE, NAMED, FRAME = range(4)

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Never shown as text.
NEVER = frozenset("head script style noscript template svg math iframe object embed canvas audio video map select datalist option button textarea".split())
#: Shown, but never article text.
FURNITURE = frozenset("nav footer aside menu dialog".split())
#: Never article text either, unless they hold the page.
FORMS = frozenset("form fieldset".split())
ROOTS = frozenset(("article", "main"))
#: What a form that holds the page has in it.
LANDMARKS = frozenset("article main nav header footer h1 p".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NOT_TEXT_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login "
    "popup modal overlay sidebar rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social comment comments disqus respond reply replies related "
    "recommended recommendations pagination pager search toolbar skip hidden copyright disclaimer".split()
)
#: Those of these words that also stand on articles' parts.
AMBIGUOUS_NAMES = frozenset("share sharing social notice notices alert promo promotion banner related recommended recommendations reply replies respond search skip hidden rail widget widgets signup subscribe subscription login modal overlay topbar toolbar menu".split())
#: Words that say nothing of an element's part in the page, where they stand beside one that does.
NEUTRAL_NAMES = frozenset("area bar block bottom box btn button buttons center column container content desktop first footer global group header holder inner item items last left link links list main mobile outer page panel post primary right row secondary section site slot small the top unit wrap wrapper".split())

_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def names_furniture(value: str) -> str | None:
    """What a class or id says: ``sure`` or ``maybe`` if one of its names is made up of words for page furniture and neutral ones or numbers, else None."""
    found = None
    for name in value.split():
        words = [w.lower() for w in _NAMES.findall(name)]
        if any(w in NOT_TEXT_NAMES for w in words) and all(w in NOT_TEXT_NAMES or w in NEUTRAL_NAMES or w.isdigit() for w in words):
            if any(w in NOT_TEXT_NAMES and w not in AMBIGUOUS_NAMES for w in words):
                return "sure"
            found = "maybe"
    return found


def _hash(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


class _Element:
    __slots__ = ("article", "chars", "first", "first_in", "furniture", "in_articles", "in_named", "inside", "landmarks", "last", "n_in", "named", "off", "outer", "parts", "shape", "shapes", "spared", "tag", "value", "vague")

    def __init__(self, tag: str, off: bool, inside: bool, furniture: bool = False, named: bool = False, outer: _Element | None = None, article: bool = False, vague: str | None = None) -> None:
        self.tag, self.off, self.inside, self.article = tag, off, inside, article
        self.furniture = furniture  # in an element that is never article text
        self.named, self.outer = named, outer  # has such a name; the next element around it that has one
        self.vague = vague  # the names, if they may mean something else
        self.spared = False
        self.parts: list[str] = [tag]
        self.shapes: list[int] = []  # of what it holds, one after the other, repetitions once
        self.chars = self.value = self.shape = self.first = self.first_in = self.last = self.n_in = self.landmarks = 0
        self.in_articles = self.in_named = 0  # characters in articles, and in those with such names


class PageParser(HTMLParser):
    """Blocks of a page (text, whether it stands in an article, whether it can't be article text), and the elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, _Element]] = []
        self.n_inside = 0
        #: Of each element with blocks, but inline ones: the element, its first and last block, and how many of them are inside.
        self.elements: list[tuple[_Element, int, int, int]] = []
        self.shut_named: list[_Element] = []
        self.stack = [_Element("", False, False)]
        self.open: Counter[str] = Counter()
        self.held: list[str] = []

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held = []
            if text:
                top = self.stack[-1]
                if not top.furniture:
                    top.chars += len(text)
                self.blocks.append((text, top))
                self.n_inside += top.inside
                top.parts.append(text)

    def shut(self, n: int) -> None:
        """Close elements until n are left."""
        while len(self.stack) > n:
            if self.stack[-1].tag not in INLINE:
                self.flush()
            e = self.stack.pop()
            self.open[e.tag] -= 1
            e.value = _hash(e.parts)
            above = self.stack[-1]
            above.landmarks += e.landmarks + (e.tag in LANDMARKS)
            if e.named:
                self.shut_named.append(e)
            if len(self.blocks) > e.first:
                e.last, e.n_in = len(self.blocks) - 1, self.n_inside - e.first_in
                if e.tag in INLINE:
                    above.shapes += e.shapes
                else:
                    self.elements.append((e, e.first, e.last, e.n_in))
                    e.shape = _hash([e.tag, *map(str, e.shapes)])
                    if above.shapes[-1:] != [e.shape]:
                        above.shapes.append(e.shape)
            above.chars += e.chars
            if e.article and not (e.off or e.furniture):
                e.in_articles, e.in_named = (e.in_articles, e.chars) if e.named else (e.chars, e.in_named)
            above.in_articles += e.in_articles
            above.in_named += e.in_named
            above.parts += e.parts if e.tag in INLINE else [f"\x1e{e.value}"]
            e.parts = []

    def _close(self, tags: frozenset[str] | set[str], stops: set[str]) -> None:
        """Close the innermost element of one of the tags, unless one of the stops comes first."""
        if any(self.open[t] for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in tags:
                    self.shut(i)
                    return
                if self.stack[i].tag in stops:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.held.append("\n")
            return
        stack = self.stack
        if tag not in INLINE:
            self.flush()
        if tag in CLOSES_P and self.open["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    self.shut(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SAME:
            self._close(SAME[tag], STOPS[tag])
        if tag in VOID:
            return
        top = stack[-1]
        off, article, in_body, named, vague = top.off or tag in NEVER, tag in ROOTS, False, tag in FORMS, None
        furniture = top.furniture or tag in FURNITURE or (tag == "header" and not top.inside)
        for name, value in attrs:
            if name == "hidden":
                off = True
            elif value and name == "role":
                furniture = furniture or value.lower() in NOT_TEXT_ROLES
                article = article or value.lower() in ROOTS
                named = named or value.lower() == "form"
            elif value and name == "itemprop":
                in_body = value == "articleBody"
            elif value and name in ("class", "id"):
                # a page, an article or a heading may be named for what it has beside it
                if tag not in ("html", "body", "main", "h1") and not (tag == "article" and name == "id"):
                    says = names_furniture(value)
                    named = named or says == "sure"
                    vague = f"{vague or tag} {value}" if says == "maybe" else vague
            elif value and ((name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value))):
                off = True
        e = _Element(tag, off, top.inside or article or in_body, furniture, named or vague is not None, top if top.named else top.outer, article, None if named else vague)
        e.first, e.first_in = len(self.blocks), self.n_inside
        stack.append(e)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # outside of XML the slash has no sense

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, {"body", "html", "article", "main"} if tag not in ("body", "html") else set())

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].off:
            self.held.append(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        at = super().parse_comment(i, report)
        return at if at >= 0 else len(self.rawdata)  # never closed, as a page is fed at once: it hides the rest

    def _spare(self) -> None:
        """Spare elements whose names say too much: those that hold most of the page's text in articles or, on a page without any, of its text.

        Articles with such names themselves count where the page has no other. Beside an article, an advert or comments
        may well be longer than it.
        """
        page = self.stack[0]
        share = "in_articles" if page.in_articles else "in_named" if page.in_named else "chars"
        for e in self.shut_named:
            e.spared = 2 * getattr(e, share) > getattr(page, share) and (e.tag not in FORMS or e.landmarks > 1)

    def result(self) -> tuple[list[tuple[str, bool, bool]], list[tuple[int, bool, int, int, bool, int]]]:
        """Blocks (text, inside an article, can't be article text) and subtrees (hash, inside, first and last block, whether it holds text that can be article text, kind), in page order.

        A subtree with blocks in and outside articles is there twice. Subtrees with most of the page's text, for text in
        articles most of that, are not there.
        """
        self.flush()
        self.shut(1)
        self._spare()
        out: dict[_Element, bool] = {}  # of elements with such names: whether they leave out what they hold

        def left_out(e: _Element | None) -> bool:
            chain = []
            while e is not None and e not in out:
                chain.append(e)
                e = e.outer
            known = out[e] if e is not None else False
            for e in reversed(chain):
                known = out[e] = known or not (e.spared or e.vague)
            return known

        blocks = [(text, e.inside, e.furniture or left_out(e if e.named else e.outer)) for text, e in self.blocks]
        before, inner = [0], 0
        for text, inside, other in blocks:
            before.append(before[-1] + len(text) * (not other))
            inner += len(text) * (inside and not other)
        most = {True: inner / 2, False: before[-1] / 2}
        subtrees = []

        def count(value: int, e: _Element, kind: int) -> None:
            chars = before[e.last + 1] - before[e.first]
            for inside, n in ((True, e.n_in), (False, e.last + 1 - e.first - e.n_in)):
                if n and (chars < most[inside] or not chars):
                    subtrees.append((value, inside, e.first, e.last, chars > 0, kind))

        framed, done = 0 < inner and 2 * inner >= before[-1], len(blocks)
        for e, first, last, _ in self.elements:
            if e.tag not in ROOTS:
                count(e.value, e, SINGLE if first == last else CONTAINER)
        if framed:  # the largest elements without a block of an article, last ones first, as they close after what they hold
            for e, first, last, n_in in reversed(self.elements):
                if not n_in and last < done:
                    count(e.shape, e, FRAME)
                    done = first
        for e in self.shut_named:
            if e.vague and not e.spared and len(self.blocks) > e.first and e.last >= e.first and e.tag not in INLINE:
                count(_hash(sorted({e.tag, *re.sub(r"[0-9]+", "", e.vague.lower()).split()})), e, NAMED)
        return blocks, subtrees


def parsed(html: str | None) -> tuple[list[tuple[str, bool, bool]], list[tuple[int, bool, int, int, bool, int]]]:
    """Blocks and subtrees of a page (see ``PageParser.result``); null and empty pages have none."""
    if not html:
        return [], []
    p = PageParser()
    p.feed(html)
    p.close()
    return p.result()


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty for null and relative URLs."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_BLOCKS = "array<struct<at: int, text: string, inside: boolean>>"
_SUBTREES = "array<struct<hash: long, inside: boolean, first: int, last: int, own: boolean, kind: int>>"


def blocks_of(html: Column) -> Column:
    """A struct of the blocks of an HTML column that can be article text, with their places, its subtrees, and a digest of all its texts.

    Copies of a page have the same digest, whatever their markup.
    """

    @F.pandas_udf(f"blocks {_BLOCKS}, subtrees {_SUBTREES}, content long")
    def pages(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [parsed(h) for h in part]
            blocks = [[{"at": i, "text": t, "inside": inside} for i, (t, inside, other) in enumerate(blocks) if not other] for blocks, _ in rows]
            subtrees = [[dict(zip(("hash", "inside", "first", "last", "own", "kind"), x, strict=True)) for x in subtrees] for _, subtrees in rows]
            content = [xxhash.xxh3_64_intdigest("\x1f".join(t for t, *_ in blocks)) - (1 << 63) for blocks, _ in rows]
            yield pd.DataFrame({"blocks": pd.Series(blocks, dtype=object), "subtrees": pd.Series(subtrees, dtype=object), "content": np.array(content, dtype=np.int64)})

    return pages(html)


def templates(pages: DataFrame) -> DataFrame:
    """Subtrees that are part of their host's template: host, hash, inside, kind.

    pages: a row per page with host, subtrees and content. Pages of a host with the same content count once.
    """
    what = F.array_distinct(F.transform("subtrees", lambda x: F.struct(x["hash"].alias("hash"), x["inside"].alias("inside"), x["kind"].alias("kind"))))
    held = pages.select("host", "content", F.explode(what).alias("e")).select("host", "content", "e.*")
    every = held.groupBy("host", "hash", "inside", "kind").agg(F.countDistinct("content").alias("n"))
    counts = every.filter((F.col("kind") != NAMED) & (F.col("n") >= LEAST_PAGES))
    sizes = pages.groupBy("host").agg(F.countDistinct("content").alias("n_pages"))
    share = F.when(F.col("inside") | F.col("kind").isin(SINGLE, FRAME), INNER_SHARE).otherwise(LEAST_SHARE)
    least = F.greatest(F.when(F.col("inside"), INNER_PAGES).otherwise(LEAST_PAGES).cast("double"), F.col("n_pages") * share)
    template = counts.join(sizes, "host").filter(F.col("n") >= least).select("host", "hash", "inside", "kind")
    # few: pages' names, with copies of them on other hosts
    named = every.filter(F.col("kind") == NAMED)
    hosts = named.groupBy("hash").agg(F.countDistinct("host").alias("n_hosts"))
    furniture = named.join(hosts, "hash").filter((F.col("n") >= LEAST_PAGES) | (F.col("n_hosts") >= LEAST_HOSTS))
    return template.unionByName(furniture.select("host", "hash", "inside", "kind"))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The table without its HTML, with ``text``, the main text of each page (empty if none). Rows are kept one to one.

    Other columns stay, of whatever names, but for one named text, which is replaced.
    """
    scratch = Scratch(pages.sparkSession, "html")
    quoted = lambda c: F.col(f"`{c}`")
    kept = [c for c in pages.columns if c not in (html, "text")]
    key = F.md5(F.encode(F.concat_ws("\n", *(F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (url, html))), "UTF-8"))
    row = F.struct(*(quoted(c) for c in kept)) if kept else F.lit(None)
    found = scratch.keep(pages.select(row.alias("row"), host_of(quoted(url)).alias("host"), key.alias("key"), blocks_of(quoted(html)).alias("page")).select("row", "host", "key", "page.*"), "blocks")
    flagged = scratch.keep(templates(found.select("host", "subtrees", "content")), "templates")
    each = found.select("key", "host", F.explode(F.filter("subtrees", lambda x: x["own"])).alias("e")).select("key", "host", "e.*")
    # written first, so that its size is known: few lists are broadcast, within Spark's threshold, and no text is shuffled
    lists = scratch.keep(each.join(flagged, ["host", "hash", "inside", "kind"]).groupBy("key").agg(F.collect_set(F.struct("inside", "first", "last")).alias("off")), "lists")
    scratch.drop(flagged)
    clean = F.expr("filter(blocks, b -> not exists(coalesce(off, array()), e -> e.inside = b.inside and e.first <= b.at and b.at <= e.last))")
    texts = found.join(lists, "key", "left").select("row", clean.alias("blocks"))
    return texts.select(*(F.col(f"row.`{c}`") for c in kept), F.array_join(F.transform("blocks", lambda b: b["text"]), " ").alias("text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``: page_id, url, text, n_chars."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
