"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags, told apart by the path of elements that they stand in, and runs of text, told
apart by path and content. Pages of one host are made from one template, and a token of the template occurs as often as
the template says on each page. So tokens are grouped by their occurrence vector over the host's pages: tokens that
occur equally often on every page form an equivalence class. The vector isn't gathered: each page adds a hash of
(page, count) to a token's signature, which Spark sums in parts whatever the host's size; equal signatures and supports
mean equal vectors. Tags on at least two of the host's pages (or on its only one) and on LEAST_SHARE of them are the
template's; texts only if more than half of the pages have them beyond doubt (one over the root of the pages more than
half, so one to three pages never tell): texts on fewer pages are content that repeats. Only texts outside articles
depend on this, so an article gives the same text on a host of any number of pages.

On each page a class is valid if its tokens occur equally often there, in the class's order, and if each round of them
lies within one slot (the gap between two neighbouring tokens) of every larger valid class or encloses it. A class that
isn't valid on a page is divided into its tokens, which nest as HTML does. Valid classes nest into the page's template;
the text between its tokens fills slots.

The template says what a slot is for. An article or main element whose tag is the template's, or another with such a
name, makes the slots in it slots of the article. A name (class, id or role) that is a word for menus, sidebars,
notices, adverts, forms, comments and so on, alone or with words of layout only (related-posts, ad-box-2), speaks
against an element and all slots in it; related-work, search-engines and notice-period don't. In an article it doesn't
either where most of the text that varies between the host's pages stands in the element. That holds too for a box that
one page alone has, if its host has a template to tell the article from the rest. Headings have no say, nor the ids of
paragraphs and their like, whose class must be just such a word. What can't hold an article by its meaning in HTML
(nav, aside, footer, form, dialog, button, menu, head and hidden elements; header outside an article) is left out like
scripts and styles. What stands in the article stays, also if all pages of the host have it; outside, text tokens of the
template are dropped as the host's own words.

Names speak against an element, unless it is html or body, and against what it holds, but not against an article or
main element in it whose own names don't: of these, the ones with the fewest such elements around them are the article,
so layouts named has-sidebar lose none, and teasers in a section named related give way to the page's article. If all
have such elements around them, and the slots outside that nothing speaks against have more text, those are taken. On a
page without an article or any such slot, the slots with the fewest such names around them are kept.

Defined cases: null html is an empty page with empty text; a null url, or one without "://", belongs to the host "";
the tags of a host's only page are all its template's; a page without a template (main_text with none) is one slot and
keeps all text that HTML lets it; unclosed elements end with their parents or the page; very long pages are read whole,
one at a time. Repeated rows are pages of their own and get equal texts; a null page_id is kept. An empty table gives no
rows. Only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of a host's pages that a tag must be on to be the template's, and half of them for texts. A page's tags being some hundreds, a template has no more than that over LEAST_SHARE, whatever the host's size.
LEAST_SHARE, HALF = 0.01, 0.5
#: Sums that a partition holds before it hands them on.
HELD = 200_000
#: Templates of at most so many tokens in all are broadcast.
BROADCAST_TOKENS = 200_000

#: Elements whose content is not text, and those without an end tag: fixed values of HTML.
RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|canvas"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements within a block of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A start tag ends an open element of these kinds.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Elements that an implied end doesn't reach through.
WALLS = {"article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "ul"}
#: Elements, and words of class, id and role, that hold something other than the article.
OTHER_ELEMENTS = {"aside", "button", "dialog", "footer", "form", "head", "menu", "nav", "title"}
OTHER_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "reply", "respond", "search", "share", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Words that with one of OTHER_WORDS make a name that means the same.
LAYOUT_WORDS = {"area", "bar", "block", "body", "bottom", "box", "card", "col", "column", "container", "content", "entry", "footer", "form", "global", "group", "inline", "inner", "item", "items", "large", "left", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "small", "stories", "thread", "top", "unit", "wrap", "wrapper", "zone"}
#: Headings have no say; of the other elements, only a class that is one of the words alone.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT_ELEMENTS = {"blockquote", "caption", "dd", "dt", "figcaption", "figure", "li", "p", "pre", "summary", "td", "th"}
#: These speak against an element only outside the article.
HEADER_WORDS = {"header", "masthead"}
MAIN_WORDS = {"main", "article"}

_ATTRIBUTES = r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/]){_ATTRIBUTES}(?<=/)>|<({RAW})(?=[\s/>]|\Z){_ATTRIBUTES}(?:>|\Z).*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|([^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s/=>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_NUMBER = re.compile(r"\d+(?:x\d+)?")


class Node:
    """An element: its names (classes, id, role), the element around it, and its path, told by hash. Roles are filled in by judge(): hard: it or one around it can't hold the article; soft: so many have names that speak against them; main: it is in an article, in whose bounds the two count; outer: soft of what is around that. chars: of the text in it that isn't the template's."""

    __slots__ = ("tag", "parent", "path", "names", "hidden", "hard", "soft", "main", "outer", "root", "chars")

    def __init__(self, tag: str, parent: Node | None, path: int, names: tuple = ((), ()), hidden: bool = False):
        self.tag, self.parent, self.path, self.names, self.hidden = tag, parent, path, names, hidden
        self.hard, self.soft, self.main, self.outer = False, 0, False, 0
        self.root: Node | None = None  # the article
        self.chars = 0

    @property
    def other(self) -> bool:
        return self.hard or self.soft > 0


def opened(parent: Node, tag: str, attributes: str) -> Node:
    classes, others, hidden = [], [], False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "class":
                classes += value.split()
            elif name in ("id", "role"):
                others.append(value)
            elif name == "hidden":
                hidden = True
    path = xxhash.xxh64_intdigest(f"{parent.path}/{tag}.{' '.join([*classes, *others])}")
    return Node(tag, parent, path, (classes, others), hidden)


def means_other(name: str) -> bool:
    """Whether a name is one of OTHER_WORDS, alone or with numbers and words of layout."""
    parts = [w for w in _SPLIT.split(name) if w]
    return any(w in OTHER_WORDS for w in parts) and all(w in OTHER_WORDS or w in LAYOUT_WORDS or _NUMBER.fullmatch(w) for w in parts)


def judge(node: Node, in_template: bool, told: bool) -> None:
    """Fills in the roles of an element from those around it and its own names. in_template: its tag is the template's; told: the page has a template."""
    around = node.parent
    node.hard, node.soft, node.main, node.outer, node.root = around.hard or node.hidden or node.tag in OTHER_ELEMENTS, around.soft, around.main, around.outer, around.root
    names, spoken = [], False
    if told and node.tag not in HEADINGS and node.tag not in ("html", "body"):
        classes, others = node.names
        names = [c for c in classes if c in OTHER_WORDS] if node.tag in TEXT_ELEMENTS else [*classes, *others]
        most = around.root is not None and 2 * node.chars > around.root.chars
        spoken = not most and any(map(means_other, names))
    if in_template and node.tag in ("article", "main") and not (around.main or node.hard or spoken):
        node.soft, node.main, node.outer, node.root = 0, True, around.soft, node
        return
    words = {w for name in names for w in _SPLIT.split(name)}
    if in_template and not around.main and not around.other and not MAIN_WORDS.isdisjoint(words):
        node.main, node.root = True, node
    if not node.main:
        node.hard = node.hard or node.tag == "header"
        spoken = spoken or not HEADER_WORDS.isdisjoint(words)
    node.soft += spoken


def read(page: str) -> Iterator[tuple[int, str | None, Node]]:
    """(token, block of text or None, innermost element) in page order. Inline tags are no tokens; a block's text has its white space made single."""
    stack, parts = [Node("", None, 0)], []

    def block():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            where = stack[-1]
            yield xxhash.xxh64_intdigest(f"{where.path}#{text}"), text, where

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if m[5] is not None:
            parts.append(m[5])
        elif tag is None:
            if m[1] is not None:
                parts.append(" ")
        else:
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    parts.append(" ")
                continue
            yield from block()
            if m[2]:
                k = len(stack) - 1
                while k and stack[k].tag != tag:
                    k -= 1
                if k:
                    yield stack[k].path ^ 1, None, stack[k]
                    del stack[k:]
                continue
            if ends := ENDS.get(tag):
                k = len(stack) - 1
                while k and stack[k].tag not in WALLS:
                    if stack[k].tag in ends:
                        del stack[k:]
                    k -= 1
            node = opened(stack[-1], tag, m[4])
            yield node.path, None, node
            if tag not in VOID and not m[4].endswith("/"):
                stack.append(node)
    yield from block()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, support, one, two, place) sums: pages that have the token, both halves of hashes of (page, count), and mean places in the page. Token 0 is the page itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int, bool], list] = {}

        def out() -> pd.DataFrame:
            rows = [(h, signed(t), x, *v) for (h, t, x), v in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=["host", "token", "is_text", "support", "one", "two", "place"])

        for pdf in batches:
            for name, host, page in zip(pdf["page"], pdf["host"], pdf["html"]):
                counts: dict[tuple[int, bool], list] = {(0, False): [1, 0]}
                for at, (token, text, _) in enumerate(read(page or "")):
                    x = counts.setdefault((token, text is not None), [0, 0])
                    x[0] += 1
                    x[1] += at
                for (token, is_text), (n, at) in counts.items():
                    x = sums.setdefault((host, token, is_text), [0, 0, 0, 0.0])
                    h = xxhash.xxh64_intdigest(f"{name} {n}")
                    x[0] += 1
                    x[1] += h >> 32
                    x[2] += h & 0xFFFFFFFF
                    x[3] += at / n
            if len(sums) > HELD:
                yield out()
        yield out()

    named = pages.select(F.xxhash64("page_id", "url", "html").alias("page"), common.host_of(F.col("url")).alias("host"), "html")
    parts = named.mapInPandas(run, "host string, token long, is_text boolean, support long, one long, two long, place double")
    return parts.groupBy("host", "token", "is_text").agg(*[F.sum(c).alias(c) for c in ("support", "one", "two", "place")])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the classes, each token as (class, token) in the order of mean places; larger classes have smaller numbers."""
    found = common.materialise(occurrences(pages))
    hosts = found.filter("token = 0 AND NOT is_text").select("host", F.col("support").alias("pages"))
    share = F.col("support") / F.col("pages")
    kept = F.when(F.col("is_text"), share >= HALF + 1 / F.sqrt("pages")).otherwise((share >= LEAST_SHARE) & (F.col("support") >= F.least(F.col("pages"), F.lit(2))))
    often = common.lookup(found.filter("token <> 0"), hosts, "host").filter(kept)
    tokens = F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("support")).alias("place"), "token")))
    classes = often.groupBy("host", "support", "one", "two").agg(tokens.alias("tokens"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("a"), (-F.size("tokens")).alias("b"), F.transform("tokens", lambda t: t["token"]).alias("tokens"))))
    return classes.groupBy("host").agg(F.transform(ordered, lambda c: c["tokens"]).alias("template"))


def valid_places(tokens: list[int], classes) -> tuple[set[int], int]:
    """Places of tokens that belong to the page's template, and the number of classes that are valid as a whole. Classes: larger first."""
    places: dict[int, list[int]] = {}
    wanted = {t for c in classes for t in c}
    for at, token in enumerate(tokens):
        if token in wanted:
            places.setdefault(token, []).append(at)
    template: list[int] = []  # sorted places of the valid classes so far
    valid: list[tuple[list, list[int]]] = []  # rounds and sorted places of each
    kept, divided, n_valid = set(), set(), 0
    for members in classes:
        each = [places[t] for t in members if t in places]
        if not each:
            continue
        rounds = len(each[0])
        flat = [x[k] for k in range(rounds) for x in each] if all(len(x) == rounds for x in each) else [1, 0]
        spans = [flat[k : k + len(each)] for k in range(0, len(flat), len(each))]
        # Nesting: each round lies within one slot of the template so far, or else this class and each larger one nest one way or the other.
        if len(each) == len(members) and flat == sorted(flat) and (within(spans, template) or all(within(spans, at) or within(own, flat) for own, at in valid)):
            kept.update(flat)
            template = sorted(kept)
            valid.append((spans, flat))
            n_valid += 1
        else:
            divided.update(p for x in each for p in x)
    return kept | divided, n_valid


def within(spans: list[list[int]], places: list[int]) -> bool:
    """Whether each of the rounds lies between two neighbours of places."""
    return all(bisect(places, s[0]) == bisect(places, s[-1]) for s in spans)


def bisect(places: list[int], at: int) -> int:
    low, high = 0, len(places)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if places[mid] < at else (low, mid)
    return low


def main_text(page: str | None, classes=()) -> tuple[str, int, int]:
    """(text, slots that it was taken from, valid classes)."""
    items = list(read(page or ""))
    fixed, n_valid = valid_places([signed(t) for t, _, _ in items], classes) if len(classes) else (set(), 0)
    levels, blocks, slot, starts = set(), [], 0, {}
    for at, (_, text, where) in enumerate(items):
        slot += at in fixed
        if text is not None:
            blocks.append((slot, text, where, at in fixed))
            where.chars += 0 if at in fixed else len(text)
        elif where.parent is not None:
            starts.setdefault(id(where), (at, where))  # its end has the same element
    for _, where in reversed(starts.values()):
        where.parent.chars += where.chars
    for at, where in starts.values():
        judge(where, at in fixed, len(classes) > 0)
        if where.main and not where.other:
            levels.add(where.outer)
    chars = lambda found: sum(len(x[1]) for x in found)
    own = lambda found: [x for x in found if not x[3]]
    level = min(levels, default=0)
    article = [x for x in blocks if x[2].main and not x[2].other and x[2].outer == level]
    rest = own(x for x in blocks if not x[2].main and not x[2].other)
    # Names around it may speak against each article: then more text elsewhere is taken.
    out = article if levels and not (level and chars(rest) > chars(article)) else rest
    if not out and not levels and n_valid:
        left = [x for x in own(blocks) if not x[2].hard]
        least = min((x[2].soft for x in left), default=0)
        out = [x for x in left if x[2].soft == least]
    return "\n\n".join(x[1] for x in out), len({x[0] for x in out}), n_valid


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_slots, n_classes) of each row."""
    common.small_batches(pages.sparkSession)
    found = common.materialise(templates(pages))
    size = found.agg(F.sum(F.expr("aggregate(template, 0L, (n, c) -> n + size(c))"))).first()[0] or 0
    if size <= BROADCAST_TOKENS:
        found = F.broadcast(found)

    @F.pandas_udf("text string, n_chars long, n_slots int, n_classes int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for htmls, templates_ in batches:
            out = [main_text(page, [list(map(int, c)) for c in t] if t is not None else ()) for page, t in zip(htmls, templates_)]
            yield pd.DataFrame([(x[0], len(x[0]), *x[1:]) for x in out], columns=["text", "n_chars", "n_slots", "n_classes"])

    own = pages.select("page_id", "url", "html", common.host_of(F.col("url")).alias("host")).join(found, "host", "left")
    return own.select("page_id", "url", run("html", "template").alias("out")).select("page_id", "url", "out.*")


def op7_html_text(spark, sf_dir) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
