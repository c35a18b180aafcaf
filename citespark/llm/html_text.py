"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of blocks. Words score positive, the tags between two
blocks negative; the contiguous run of blocks with the largest sum is the
content, found in one linear scan. The costs of the tags come from labelled
pages: pages that mark their article tell how often each tag stands outside of
one. In a scan the mark is a weight only: crossing its border costs what the tag
costs, inside it other tags and words of links weigh a tenth. Elements that HTML itself or a plain name marks as no part of
an article (menus, adverts, forms, scripts, reader comments and so on) are taken out before the scan. A compound name is a
cost that the words of its element must outweigh, learned like that of a tag.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import checkpoint, map_rows, text_udf

#: Labelled pages that the tag costs are learned from, at most.
SAMPLE_PAGES = 5_000
WORD_SCORE = 1.0
COST_OUTSIDE = 12.0
COST_INSIDE = 0.02
COST_UNKNOWN = 0.5
#: What tags and words of links inside a marked article weigh in a scan, against 1 outside.
MARK_SHARE = 0.1
#: Words that a name which never stands in an article costs its element, and those of an element that may be a whole page's text.
NAME_WORDS = 40.0
LARGE_WORDS = 120.0
KEEP, HINT, LARGE, RULE = range(4)

#: Elements by their role in HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg canvas xmp noembed noframes".split())
LEFT_OUT_TAGS = frozenset("nav aside footer form button select dialog menu head datalist audio video map".split())
ARTICLE_TAGS = frozenset("article main".split())
KEPT_TAGS = frozenset("html body article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus notice notices "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login social share sharing related "
    "recommended pagination pager widget toolbar skip".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
#: An article's own header holds its title; on an article itself only these names count.
CONTENT_NAMES = frozenset("article post entry content story main".split())
HEADER_NAMES = frozenset("header masthead".split())
NO_ARTICLE_NAMES = frozenset("ad ads advert sponsored promo comment comments reply replies related recommended".split())
#: Last parts of a name that say what an element holds or how it stands, not what it is.
BOX_NAMES = frozenset(
    "area articles bar block body bottom box button buttons column container content form group inner item items left links "
    "list message panel posts right section slot thread top unit wrap wrapper zone".split()
)
NEGATIONS = frozenset("with has no without".split())
STATES = frozenset("active closed disabled enabled hidden off on open required visible".split())

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
#: A page that may mark its article, for Spark's readers of patterns.
_MARK = r"(?i)<(?:article|main)[\s/>]"
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def standing(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """How surely no article includes an element, and the name that says so.

    RULE: HTML's own tags and roles, and names that are nothing but a role of a
    page ("sidebar", "ad"). LARGE: a name that ends in such a role ("site-header"),
    which stays if most of the page's text is in it. HINT: a name that only begins
    with one ("related-work", "nav-open"), or one beside a name of content; the words
    inside are held against its learned cost. Else KEEP.
    """
    if tag in KEPT_TAGS and not attributes:
        return KEEP, ""
    if tag in LEFT_OUT_TAGS or (tag == "header" and not in_article):
        return RULE, tag
    if not attributes or tag in ("html", "body"):
        return KEEP, ""
    names, content = [], False
    for match in _NAMES.finditer(attributes):
        value = (match[2] or match[3] or match[4] or "").lower()
        if match[1].lower() == "role":
            if value.strip() in LEFT_OUT_ROLES:
                return RULE, value.strip()
            content |= value.strip() in ("main", "article")
            continue
        names += value.split()
    listed = NO_ARTICLE_NAMES if tag in ARTICLE_TAGS else LEFT_OUT_NAMES
    worst, reason = KEEP, ""
    for name in names:
        parts = [p for p in re.split(r"[-_:]+", name) if p]
        if not parts or not NEGATIONS.isdisjoint(parts):
            continue
        first, last = parts[0], parts[-1]
        if last in HEADER_NAMES and (in_article or first in CONTENT_NAMES):
            continue
        if first not in listed and last not in listed:
            content |= last in CONTENT_NAMES or first in CONTENT_NAMES
            continue
        why = last if last in listed else first
        if last in STATES:
            level = HINT
        elif len(parts) == 1 or why in COMMENT_NAMES:
            level = RULE
        elif last in listed or last in BOX_NAMES:
            level = LARGE
        else:
            level = HINT
        if level > worst:
            worst, reason = level, why
    if content and worst > HINT and reason not in NO_ARTICLE_NAMES:
        worst = HINT
    return worst, reason


def tokens_of(html: str) -> list[tuple]:
    """(start, end, tag, closing, attributes) of tags outside raw text; other markup has no tag."""
    found, at = [], 0
    last = html.rfind(">") + 1  # behind it no tag ends, so none is looked for
    while match := _PART.search(html, at, last):
        start, at = match.span()
        tag = match[2] or match[5]
        if tag is None:
            if at == last and match[0].startswith(("<!--", "<![CDATA[")) and not match[0].endswith(("-->", "]]>")):
                at = len(html)  # never closed
            found.append((start, at, None, False, html[start:at]))
            continue
        tag, closing = tag.lower(), bool(match[1] or match[4])
        if not closing and tag in RAW_TAGS:
            at = raw_end(html, tag, at, last)
        found.append((start, at, tag, closing, match[3] or match[6] or ""))
    return found


def ends_of(tokens: list[tuple]) -> dict[int, int]:
    """For each element that is closed, the place of its end tag: one pass, a stack for each name."""
    waiting: dict[str, list[int]] = {}
    ends = {}
    for i, (_, _, tag, closing, attributes) in enumerate(tokens):
        if tag is None or tag in VOID_TAGS or tag in RAW_TAGS:
            continue
        if not closing:
            if not attributes.endswith("/"):
                waiting.setdefault(tag, []).append(i)
        elif waiting.get(tag):
            ends[waiting[tag].pop()] = i
    return ends


class Page:
    """Blocks of a page with the tags before each and whether an article holds it."""

    def __init__(self, html: str):
        self.blocks: list[str] = []  # empty where a named element begins or ends behind tags without text
        self.tags: list[list[tuple[str, float]]] = []  # tags since the block before, and what they weigh
        self.inside: list[bool] = []
        self.links: list[int] = []  # words in links
        self.named: list[tuple[int, int, int, str, tuple[str, float]]] = []  # first block, end, standing, name, tag; inner first
        self.outside_tags: Counter = Counter()  # of left-out elements and of what stands outside an article
        self.inside_tags: Counter = Counter()
        self.has_article = False
        self._read(html)

    def _read(self, html: str) -> None:
        parts: list[str] = []
        passed: list[tuple[str, float]] = []
        open_articles, at, i = 0, 0, 0
        in_link, link_words = False, 0
        tokens = tokens_of(html)
        ends = ends_of(tokens)
        open_names: dict[int, tuple] = {}  # by the place of the end tag

        def flush(border: bool = False) -> None:
            nonlocal link_words
            text = " ".join("".join(parts).split())
            parts.clear()
            if text or (border and passed):
                self.blocks.append(text)
                self.tags.append(passed.copy())
                self.inside.append(open_articles > 0)
                self.links.append(link_words)
                passed.clear()
            link_words = 0

        while i < len(tokens):
            start, end, tag, closing, attributes = tokens[i]
            if start > at:
                text = html[at:start]
                parts.append(unescape(text) if "&" in text else text)
                if in_link:
                    link_words += len(parts[-1].split())
            at = end
            place, i = i, i + 1
            if tag is None:
                if attributes.startswith("<![CDATA["):
                    parts.append(attributes[9:].removesuffix("]]>"))
                continue
            if tag == "a":
                in_link = not closing
            weight = MARK_SHARE if open_articles else 1.0
            if closing:
                if tag in BLOCK_TAGS:
                    flush()
                if place in open_names:
                    flush(border=True)
                    first, level, name, mark = open_names.pop(place)
                    self.named.append((first, len(self.blocks), level, name, mark))
                if tag in ARTICLE_TAGS and open_articles:
                    open_articles -= 1
                    passed.append((tag, MARK_SHARE if open_articles else 1.0))
                continue
            if tag in RAW_TAGS:
                continue
            counted = self.inside_tags if open_articles else self.outside_tags
            counted[tag] += 1
            level, name = standing(tag, attributes, open_articles > 0)
            close = ends.get(place)
            if level == RULE and close is not None:
                flush()
                for inner in tokens[i:close]:
                    if inner[2] and not inner[3]:
                        self.outside_tags[inner[2]] += 1
                at, i = tokens[close][1], close + 1
                passed.append((tag, weight))
                continue
            if level == RULE and tag not in BLOCK_TAGS | VOID_TAGS:
                flush()
                continue
            if tag in BLOCK_TAGS:
                flush()
            if level in (LARGE, HINT) and close is not None:
                counted["." + name] += 1
                flush(border=True)
                open_names[close] = (len(self.blocks), level, name, (tag, weight))
            passed.append((tag, weight))
            if tag in ARTICLE_TAGS:
                open_articles += 1
                self.has_article = True
        if at < len(html):
            text = html[at:]
            cut = re.search(r"<[a-zA-Z/!?]", text)  # a tag that the page breaks off in
            text = text[: cut.start()] if cut else text
            parts.append(unescape(text) if "&" in text else text)
        flush()

    def gains(self) -> list[float]:
        """What each block adds to a run: its words, less twice those of links, which lead away from the content."""
        out = []
        for block, inside, links in zip(self.blocks, self.inside, self.links):
            words = block.count(" ") + 1 if block else 0
            out.append(WORD_SCORE * (words - 2 * min(words, links) * (MARK_SHARE if inside else 1.0)))
        return out

    def side_elements(self, gains: list[float], costs: dict[str, float]) -> dict[int, tuple[int, tuple[str, float]]]:
        """(end, tag) by first block of the named elements whose words don't outweigh their names."""
        sums = [0.0, *accumulate(gains)]
        total = sum(g for g in gains if g > 0)
        out: dict[int, tuple[int, tuple[str, float]]] = {}
        for first, end, level, name, mark in self.named:
            words = sums[end] - sums[first]
            if level == LARGE:
                stays = words > LARGE_WORDS and 2 * words > total
            else:
                stays = words > NAME_WORDS * costs.get("." + name, COST_OUTSIDE) / COST_OUTSIDE
            if not stays and end > first:
                out[first] = max(out.get(first, (0, mark)), (end, mark))
        return out

    def text(self, costs: dict[str, float]) -> str:
        """The blocks of the best run, one per line."""
        gains = self.gains()
        side = self.side_elements(gains, costs)
        best, best_run, run, first = 0.0, (0, 0), 0.0, 0
        kept: list[str] = []
        carried: list[tuple[str, float]] = []  # side elements since the last block that stays
        i = 0
        while i < len(gains):
            if i in side:
                i, mark = side[i]
                carried.append(mark)
                continue
            cost = sum(costs.get(t, COST_UNKNOWN) * weight for t, weight in carried + self.tags[i])
            carried.clear()
            if run - cost > 0:
                run -= cost
            else:
                run, first = 0.0, len(kept)
            run += gains[i]
            kept.append(self.blocks[i])
            if run > best:
                best, best_run = run, (first, len(kept))
            i += 1
        return "\n".join(block for block in kept[slice(*best_run)] if block)


def raw_end(html: str, tag: str, at: int, last: int) -> int:
    """Where a raw-text element ends: behind its end tag, or at the end of the page."""
    match = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at, last)
    return match.end() if match else len(html)


def learn_costs(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Cost of each HTML tag and, after a dot, of names of elements: how surely it stands outside an article, from at most ``sample_pages`` labelled pages.

    Labelled pages are those that mark their article; they are chosen by a hash of
    the id. Without any, every tag has the cost of an unknown one.
    """
    marked = F.col(html).rlike(_MARK)
    chosen = pages.filter(F.col(page_id).isNotNull() & marked).select(F.col(page_id).alias("_page")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_page"), "_page").limit(sample_pages)
    sample = pages.select(F.col(page_id).alias("_page"), F.col(html).alias("_html")).filter(F.col("_html").rlike(_MARK)).join(F.broadcast(chosen), "_page")

    def make():
        def work(texts: list) -> list:
            inside, outside = Counter(), Counter()
            for text in texts:
                page = Page(text or "")
                if page.has_article:
                    inside.update(page.inside_tags)
                    outside.update(page.outside_tags)
            names = sorted(set(inside) | set(outside))
            return [names, [inside[t] for t in names], [outside[t] for t in names]]

        return work

    counts = map_rows(sample.select("_html"), "tag string, inside long, outside long", make)
    known = sorted(
        BLOCK_TAGS | VOID_TAGS | set("a abbr b cite code em i label mark q s small span strong sub sup time u".split())
        | {"." + name for name in LEFT_OUT_NAMES}
    )
    rows = checkpoint(counts.filter(F.col("tag").isin(known)).groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")))
    costs = {}
    for row in rows.collect():  # at most one row per known tag and name
        share = row["o"] / max(1, row["i"] + row["o"])
        costs[row["tag"]] = COST_INSIDE + (COST_OUTSIDE - COST_INSIDE) * share**2
    return costs


def main_text(costs: dict[str, float]) -> Callable:
    """A column with the main text of an HTML column; '' for NULL, empty and contentless pages."""

    def make():
        return lambda texts: [Page(t).text(costs) for t in texts]

    return text_udf("string", make)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``; one pass over a bounded sample learns the costs, one pass extracts, no page is shuffled.

    Character references are decoded, white space inside a block is one space,
    blocks stand in page order, one per line; a line break ends a block. A page
    cut off in the middle counts as ended there.
    """
    return pages.withColumn(out, main_text(learn_costs(pages, page_id, html))(F.col(html)))
