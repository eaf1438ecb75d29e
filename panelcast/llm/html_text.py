"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Scripts, styles and the like,
menus, headers, footers, sidebars, forms, and elements that a class, id or
role names as such, as an advert, a notice or reader comments, are not read.
If the page marks an article by tag or role, else a main part, else either by
a class or id, only that is read, unless it has less than half of the good text
of the next wider of these, or a named part of that of the page.

First pass: stop-word density, length and link density call a block good, bad,
near good or short. Second pass: short and near-good blocks take the label of
their nearest decided neighbours on both sides; if these differ, near-good
blocks and headings of good text become good, and other short ones take the
nearer's label, the one before on a tie. Inside an article or main part by tag
or role both passes run with the part's own stop-word density as the measure:
a block is good unless it has fewer stop words than chance allows at that
density, near good if only somewhat fewer or if a paragraph, item or cell holds
it, else bad; link-filled ones there are good next to good text, or between it
if nothing holds them. Inside a part by name only, the rules hold with half the
stop-word density, and all of it is kept if they find no good text in it.

Where no block of a part has a stop word (a language that the list doesn't
know), length and link density decide alone. Class and id names are evidence
only: if nothing is left of a page without the elements that they name, the
page is read again with them.

Null or empty html, and pages without text, give an empty text. Broken markup
is read as far as it goes, in time that follows the page's size: a tag that
doesn't end is text, a quote that isn't closed ends with its tag. Each row has its own result, repeated or null keys
too; same-named columns of the input are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, text_slices, with_columns

SHORT, LONG = 70, 200           # characters of a short and of a long block
STOP_LOW, STOP_HIGH = 0.30, 0.32
MOST_LINKS = 0.5                # share of a block's characters inside links
#: Standard deviations below a marked part's own stop-word density: somewhat fewer, and more than chance allows.
FEWER, FAR_FEWER = 2.0, 4.0

#: Common words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into
is it its more no not of on one or other our out she so some than that the their them then there these they this to up was
we were what when which who will with would you your
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa
se ses son sur un une vous
aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit
nach nicht noch nur oder sich sie sind so und von war was wie wir zu zum zur
al como con de del el ella en entre es esta este ha la las le lo los más me mi no para pero por que se si sin sobre su sus
también un una uno y ya
""".split())

BLOCK = frozenset("""address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary
table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text elements, whose content ends only at their own end tag.
RAW = frozenset("script style textarea noscript template iframe svg math xmp noembed noframes".split())
SKIP = frozenset("""head nav aside footer form button select option dialog menu audio video canvas object applet map
datalist title""".split())
#: Elements that close an open element of their own kind.
ALIKE = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
         "tr": ("tr",), "option": ("option",)}
BOILERPLATE = frozenset("""ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs
comment comments commentlist cookie cookies consent copyright disqus footer gdpr header masthead menu menus modal
leftnav nav navbar navigation rightnav sidenav sitenav subnav topnav newsletter notice notices pager pagination popup promo promoted promotion related replies
respond rss share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription tags
toolbar topbar widget widgets""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ARTICLE = {"article": 3, "main": 2}
#: Names of elements that hold the article where no element is one by its tag.
HOLDERS = frozenset("p li dd dt td th pre blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
NAMED_ARTICLE = frozenset("article content entry main post story".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_ABOUT = re.compile(r"\b(?:has|with|no|without|is|show|hide)[-_]?[a-zA-Z]*sidebar\w*|\b(?:has|with|no|without)[-_]\w+", re.I)


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    article: int  # 3: in an article by its tag, 2: in a main part, 1: in one by its name
    held: bool = False  # in a paragraph, item or cell
    label: str = ""

    @cached_property
    def stops(self) -> tuple[int, int]:
        """(stop words, words)."""
        return stop_words(self.text)


class Tags:
    """Tags, comments and declarations of a page, one after the other."""

    def __init__(self, page: str):
        self.page = page
        # behind these places no tag ends and no quote closes
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(begin, end, tag in lower case or "", whether it ends one, attributes)."""
        page = self.page
        while True:
            begin = page.find("<", at)
            if begin < 0 or begin > self.last[">"] and not page.startswith("<!--", begin):
                return None
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, len(page) if end < 0 else end + 3, "", False, ""
            if page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                if end >= 0:
                    return begin, end + 3, "", False, ""
            if page.startswith(("<!", "<?"), begin):
                return begin, page.find(">", begin) + 1, "", False, ""
            name = _NAME.match(page, begin)
            if name:
                end = self.tag_end(name.end())
                return begin, end + 1, name[1].lower(), page[begin + 1] == "/", page[name.end(): end]
            at = begin + 1

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, not one in a closed quote."""
        while True:
            found = _STOP.search(self.page, at)
            if not found:
                return len(self.page)
            if found[0] == ">":
                return found.start()
            # a quote that isn't closed is a character like others
            closed = found.start() < self.last[found[0]]
            at = self.page.find(found[0], found.end()) + 1 if closed else found.end()


def unwanted(tag: str, attributes: str, in_article: bool, by_name: bool = True) -> bool:
    """Whether an element is no part of the article."""
    if tag in SKIP or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if by_name and name in ("class", "id") and any(p.lower() in BOILERPLATE for p in _PART.split(_ABOUT.sub(" ", value))):
            return True
    return False


def article_level(tag: str, attributes: str) -> int:
    """3 for an article by its tag or role, 2 for a main part, 1 for either by its
    class or id, else 0."""
    if tag in ARTICLE:
        return ARTICLE[tag]
    named = _NAMED.findall(attributes) if attributes and tag not in ("body", "html") else ()
    role = max((ARTICLE.get(v.strip("\"'").lower(), 0) for n, v in named if n.lower() == "role"), default=0)
    return role or int(any(p.lower() in NAMED_ARTICLE for n, v in named if n.lower() in ("class", "id")
                   for p in _PART.split(v.strip("\"'"))))


def blocks(page: str, by_name: bool = True) -> list[Block]:
    """The readable blocks of a page, in order; ``by_name``: without elements
    that a class or id names as no part of an article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, unwanted, level of article
    parts: list[tuple[str, bool]] = []
    skipping = links = 0
    levels = [0, 0, 0, 0]  # open elements of each level
    heading = False
    opened: Counter[str] = Counter()  # open elements by tag
    tags = Tags(page)

    def close():
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(t for t, a in parts if a)).split()))
                out.append(Block(text, linked, heading, max(k for k in range(4) if levels[k] or not k),
                                 any(opened[t] for t in HOLDERS)))
            parts.clear()

    def pop():
        nonlocal skipping, links
        tag, bad, level = stack.pop()
        skipping -= bad
        levels[level] -= 1
        opened[tag] -= 1
        links -= tag == "a"

    at = 0
    while True:
        found = tags.next(at)
        begin, end, tag, ends, attributes = found or (len(page), len(page), "", False, "")
        if begin > at and not skipping:
            parts.append((page[at:begin], links > 0))
        if not found:
            break
        at = end
        if not tag:
            continue
        block = tag in BLOCK
        if block:
            close()
        if ends:
            if opened[tag]:
                # an inline end tag doesn't reach beyond its block
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        break
                    if not block and stack[k][0] in BLOCK:
                        k = -1
                        break
                if k >= 0:
                    while len(stack) > k:
                        pop()
            if block:
                heading = False
            continue
        if tag in RAW:
            if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in VOID:
            continue
        if tag in ALIKE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ALIKE[tag]:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in ("p",):
                    break
        elif block and any(t == "p" for t, _, _ in stack[-3:]):
            while stack[-1][0] != "p":
                pop()
            pop()
        bad = unwanted(tag, attributes, sum(levels[1:]) > 0, by_name)
        level = article_level(tag, attributes)
        if not attributes.endswith("/"):
            stack.append((tag, bad, level))
            opened[tag] += 1
            skipping += bad
            levels[level] += 1
            links += tag == "a"
        if block:
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return out


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    found = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in found), len(found)


def first_pass(block: Block, known: bool = True, own: float = 0.0) -> str:
    """good, bad, near, short, or link: filled by links inside an article;
    ``known``: whether stop words tell anything in this part; ``own``: the
    stop-word density of the marked parts together."""
    density = block.linked / len(block.text)
    if density > MOST_LINKS:
        return "link" if block.article > 1 else "bad"
    # scripts that no stop word is known of may say as much in fewer characters, of more bytes
    size = len(block.text) if known else len(block.text.encode())
    if size < SHORT:
        return "bad" if block.linked and not block.article else "short"
    if not known:
        return "good" if size > LONG else "near"
    count, words = block.stops
    if block.article > 1:
        fewer = (own * words - count) / max(own * (1 - own) * words, 1.0) ** 0.5
        if fewer < FEWER:
            return "good"
        return "near" if fewer < FAR_FEWER or block.held else "bad"
    stop = count / words
    part = 0.5 if block.article else 1.0  # a name is evidence, no verdict
    if stop >= STOP_HIGH * part:
        return "good" if len(block.text) > LONG else "near"
    return "near" if stop >= STOP_LOW * part else "bad"


def nearest(labels: list[str], decided: tuple[str, ...] = ("good", "bad")) -> tuple[list[int], list[int]]:
    """Places of the nearest decided label before and after each one, -1 if none."""
    sides = []
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        place, here = [-1] * len(labels), -1
        for k in order:
            place[k] = here
            here = k if labels[k] in decided else here
        sides.append(place)
    return sides[0], sides[1]


def second_pass(found: list[Block]) -> None:
    """Decide short and near blocks by their nearest decided neighbours, then
    link-filled ones of an article by all others'."""
    first = [b.label for b in found]
    before, after = nearest(first)
    for k, x in enumerate(first):
        if x not in ("short", "near"):
            continue
        a, b = before[k], after[k]
        sides = {first[j] for j in (a, b) if j >= 0}
        if not sides:
            found[k].label = "good"
        elif len(sides) == 1:
            found[k].label = "good" if x == "near" and found[k].heading else sides.pop()
        elif x == "near" or found[k].heading and first[b] == "good":
            found[k].label = "good"
        else:
            found[k].label = first[a] if k - a <= b - k else first[b]
    labels = [b.label for b in found]
    before, after = nearest(labels)
    for k, x in enumerate(labels):
        if x == "link":
            sides = [labels[j] if j >= 0 else "" for j in (before[k], after[k])]
            enough = 1 if found[k].held and "bad" not in sides else 2
            found[k].label = "good" if sides.count("good") >= enough else "bad"


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by one space."""
    if not page:
        return ""
    return chosen(blocks(page)) or chosen(blocks(page, by_name=False))


def chosen(found: list[Block]) -> str:
    """The text of the part of a page that is read."""
    for level in sorted({b.article for b in found}, reverse=True):
        # the next wider part only where this one lacks most of its good text
        inside = [b for b in found if b.article >= level]
        good = labelled(inside)
        wider = max((b.article for b in found if b.article < level), default=None)
        if wider is None or wider == 0 and level > 1:
            break
        around = labelled([b for b in found if b.article >= wider])
        if 2 * sum(len(b.text) for b in good) >= sum(len(b.text) for b in around):
            break
    else:
        good = []
    return " ".join(b.text for b in good)


def labelled(found: list[Block]) -> list[Block]:
    """The good blocks of a part by both passes."""
    known = any(b.stops[0] for b in found)
    marked = [b.stops for b in found if b.article > 1]
    own = sum(c for c, _ in marked) / max(sum(w for _, w in marked), 1)
    for b in found:
        b.label = first_pass(b, known, own)
    named = [b for b in found if b.article == 1]
    if named and len(named) == len(found) and not any(b.label in ("good", "near") for b in named):
        for b in named:
            b.label = "good" if b.linked <= MOST_LINKS * len(b.text) else "bad"
    second_pass(found)
    return [b for b in found if b.label == "good"]


def extract(df: DataFrame, page: str = "html", to: str = "text") -> DataFrame:
    """Add the main text of every whole page."""
    def run(batches):
        for batch in text_slices(batches, page):
            col = batch.column(batch.schema.get_field_index(page))
            yield with_columns(batch, {to: pa.array([main_text(x) for x in col.to_pylist()], pa.string())})

    return df.mapInArrow(run, extended(df, [T.StructField(to, T.StringType())]))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
