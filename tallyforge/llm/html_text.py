"""Main text of web pages by two-pass block rules.

Pass 1 decides blocks by link density, length and stop-word density; where a block stands (menus,
footers, ..., articles) shifts its limits. What the names of an element say counts only as long as the
running text of the page doesn't speak against it: an element around the article is its wrapper,
whatever its name. Short blocks and middling ones stay open. Pass 2 gives each
open block the label of its nearest decided neighbours: the nearer one decides, the one before on a
tie. Pages are scanned once from left to right, in time that is linear in their length.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Frequent function words of English, French, German and Spanish.
STOP = frozenset(
    "a about an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their they this to was we were which who will with you your "
    "au aux avec ce ces dans de des du elle en et est il je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der die ein eine einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind über um und von war wie wird zu zum zur "
    "al como con del el ella en es esta este la las lo los más me no o para pero por que se sin sobre son su sus un una y ya".split()
)
RAW = frozenset("script style noscript template svg iframe object canvas textarea select button title video audio".split())
NAME, TAG_END = re.compile(r"/?([a-zA-Z][\w:-]*)"), re.compile("[>\"']")
CLOSING = {x: re.compile(rf"</{x}(?![\w:-])[^>]*(?:>|\Z)", re.I) for x in RAW}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
GOOD_TAGS = frozenset(["article", "main"])
#: Parts of class names and ids. Of elements so named, the first hold what isn't the article, or so it seems; the second too, unless the name has an article's part as well;
#: the third only where nothing else in the name tells otherwise.
APART = frozenset("ad ads advert adverts advertisement sponsor sponsored comment comments commentlist respond cookie cookies consent gdpr newsletter subscribe subscription signup copyright breadcrumb breadcrumbs pagination pager".split())
FRAME = frozenset("banner promo promos sidebar widget widgets popup modal overlay nav navbar navigation navigator menu menus submenu footer header masthead toolbar notice notices".split())
VAGUE = frozenset("alert share sharing social related recommend recommended recommendation recommendations login search tags skip".split())
#: Other parts of names that say where an element stands or that it holds something.
PLAIN = frozenset("left right top bottom main inner outer wrap wrapper area box bar block container content section list item items link links button buttons icons icon form post posts articles body group col column site page global the my".split())
ARTICLE = frozenset("article entry post story main articlebody".split())
#: What turns the rest of a name into a remark about something else.
REMARK = frozenset("has no with without not hide hides hidden show shows".split())
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
COMMENT = re.compile(r"(?:^|[\s\"'=])comments?(?:-body|-list)?(?:$|[\s\"'])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
LONG, SHORT = 200, 70
#: Numbers of character references as int() takes them: no leading zeros, those beyond Unicode as one that is too.
ZEROS, TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,}")


class Block(NamedTuple):
    text: str
    place: int  # -1 where it is hidden, 1 inside the article, 0 where nothing tells
    linked: int  # characters inside links
    heading: bool
    apart: int  # number of the innermost element around it that seems to hold something else than the article, -1 if there is none
    article: int  # number of the innermost article element around it, -1 if there is none


class Apart(NamedTuple):
    """An element that seems to hold something else than the article."""

    above: int  # the next such element around it, -1 if there is none
    sure: bool  # by its kind it can't be the wrapper of the article


class State(NamedTuple):
    place: int
    apart: int
    article: int


def named(names: str) -> str:
    """What the names of an element say: sure or likely (it holds something else than the article), article, or nothing."""
    likely = vague = article = exact = False
    for name in names.lower().replace("side-bar", "sidebar").replace("article-body", "articlebody").split():
        parts = name.replace("-", "_").strip("_").split("_")
        if parts[0] in REMARK:
            continue
        if any(p in APART or p.startswith("advert") for p in parts):
            return "sure"
        likely |= any(p in FRAME for p in parts)
        vague |= any(p in VAGUE for p in parts) and (parts[-1] in VAGUE or all(p in VAGUE or p in PLAIN for p in parts))
        article |= any(p in ARTICLE for p in parts)
        exact |= name in ARTICLE
    return "likely" if likely or (vague and not exact) else "article" if article else ""


def role(tag: str, attrs: str) -> str:
    """hidden, sure, likely, article or nothing: what the tag, its names and its style say of an element."""
    if attrs and HIDDEN.search(attrs):
        return "hidden"
    names = named(" ".join("".join(m) for m in NAMES.findall(attrs))) if attrs and tag not in ("html", "body") else ""
    if tag in GOOD_TAGS:
        return "sure" if names == "sure" and COMMENT.search(attrs) else "article"
    if tag in BAD_TAGS:
        return "likely" if tag in ("header", "form", "fieldset") and names != "sure" else "sure"
    return "" if names == "article" and tag in INLINE else names


def pieces(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text, or tag, whether it closes, and attributes, one after the other. Comments, declarations and raw elements are left out.

    What isn't closed runs to the end; a tag of which no `>` follows is text. No part of the page is read more than a few times.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    ends = {q: page.rfind(q) for q in "\"'"}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", False, ""
            return
        if lt > at:
            yield page[at:lt], "", False, ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(page, lt + 1)
        if not m or lt > last:
            yield "<", "", False, ""
            at = lt + 1
            continue
        end = m.end()
        while quotes:
            found = TAG_END.search(page, end)
            if not found:
                quotes = False  # every > that is left stands in quotes that were never meant so
            elif found[0] == ">":
                end = found.start()
                break
            else:
                end = page.find(found[0], found.end()) + 1 if ends[found[0]] > found.start() else found.end()
        if not quotes:
            end = page.find(">", m.end())
        tag, closes, at = m[1].lower(), page[lt + 1] == "/", end + 1
        if tag in RAW:
            if not closes:
                found = CLOSING[tag].search(page, at)
                at = found.end() if found else n
            continue
        yield "", tag, closes, page[m.end() : end]


def blocks(page: str) -> tuple[list[Block], list[Apart]]:
    """Each block that has text, and the elements that seem to hold something else than the article."""
    out: list[Block] = []
    aparts: list[Apart] = []
    stack: list[tuple[str, State]] = []  # open elements other than plain inline ones
    opened: Counter[str] = Counter()
    parts: list[str] = []
    top = state = State(0, -1, -1)
    linked = in_link = n_articles = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&#" in text:
                text = TOO_LARGE.sub("&#1114112", ZEROS.sub("&#", text))
            if text := " ".join(html.unescape(text).split()):
                out.append(Block(text, state.place, linked, any(opened[h] for h in HEADINGS), state.apart, state.article))
        parts.clear()
        linked = 0

    def inside(tag: str, what: str, above: State) -> State:
        nonlocal n_articles
        if above.place < 0 or what == "hidden":
            return State(-1, above.apart, above.article)
        if what in ("sure", "likely") and not (tag == "header" and above.place > 0):
            aparts.append(Apart(above.apart, what == "sure"))
            return State(above.place, len(aparts) - 1, -1)
        if what == "article":
            n_articles += tag in GOOD_TAGS
            return State(1, above.apart, n_articles - 1 if tag in GOOD_TAGS else above.article)
        return above

    def close(tag: str) -> None:
        while True:
            x = stack.pop()[0]
            opened[x] -= 1
            if x == tag:
                return

    for text, tag, closes, attrs in pieces(page):
        if not tag:
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closes else 1
        elif tag in INLINE and not (attrs and not closes and tag not in VOID and state.place >= 0 and role(tag, attrs)):
            if closes and any(x == tag for x, _ in stack[-3:]):
                end()
                close(tag)
                state = stack[-1][1] if stack else top
        else:
            end()
            if closes:
                if opened[tag]:
                    close(tag)
            elif tag not in VOID and not attrs.endswith("/"):
                if tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                    close(tag)
                above = stack[-1][1] if stack else top
                stack.append((tag, inside(tag, role(tag, attrs), above) if above.place >= 0 else above))
                opened[tag] += 1
            state = stack[-1][1] if stack else top
    end()
    return out, aparts


def wrappers(found: list[Block], dense: list[int], aparts: list[Apart]) -> set[int]:
    """The elements that only seem to hold something else: they hold the article.

    dense: characters of each block that reads as running text, else 0. Such an element counts as a wrapper if an article element in it
    has more running text than stands free, or if next to no text stands free and it isn't of a sure kind; those that hold most come
    first, and what is in them and in no further such element is free from then on.
    """
    total, own, free, plain = [0] * len(aparts), [0] * len(aparts), 0, 0
    articles: dict[tuple[int, int], int] = {}
    own_plain = [0] * len(aparts)
    for b, n in zip(found, dense, strict=True):
        if b.place < 0:
            continue
        text = 0 if 2 * b.linked > len(b.text) or b.heading else len(b.text)
        if b.apart < 0:
            free, plain = free + n, plain + text
        else:
            own[b.apart] += n
            own_plain[b.apart] += text
            if b.article >= 0 and n:
                articles[b.apart, b.article] = articles.get((b.apart, b.article), 0) + n
    largest = [0] * len(aparts)
    for (x, _), n in articles.items():
        largest[x] = max(largest[x], n)
    below: dict[int, list[int]] = {}
    for x in range(len(aparts) - 1, -1, -1):  # those inside come after those around them
        total[x] += own[x]
        above = aparts[x].above
        below.setdefault(above, []).append(x)
        if above >= 0:
            total[above] += total[x]
            largest[above] = max(largest[above], largest[x])
    out: set[int] = set()
    by_total, by_article = [], []

    def offer(above: int) -> None:
        for x in below.get(above, ()):
            if largest[x]:
                heapq.heappush(by_article, (-largest[x], x))
            if total[x] and not aparts[x].sure:
                heapq.heappush(by_total, (-total[x], x))

    offer(-1)
    while True:
        while by_article and by_article[0][1] in out:
            heapq.heappop(by_article)
        while by_total and by_total[0][1] in out:
            heapq.heappop(by_total)
        if by_article and -by_article[0][0] > free:
            x = heapq.heappop(by_article)[1]
        elif by_total and not free and 10 * plain < -by_total[0][0]:
            x = heapq.heappop(by_total)[1]
        else:
            return out
        out.add(x)
        free, plain = free + own[x], plain + own_plain[x]
        offer(x)


def density(text: str) -> float:
    """The share of stop words."""
    words = text.lower().split()
    return sum(w in STOP or w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)


def decided(b: Block, stops: float) -> int:
    """Pass 1: 1 keep, -1 drop, 0 open. stops: the block's density, or a middling one where the page's language isn't known. A place of -1: hidden, or
    inside an element that holds something else than the article and isn't its wrapper."""
    n = len(b.text)
    if b.place < 0:
        return -1
    if b.linked > 0.5 * n:
        return 0 if b.place > 0 and b.heading else -1
    if b.place > 0:
        return 1 if n >= SHORT and stops >= 0.1 else 0
    if n < SHORT:
        return 0
    if stops >= 0.25:
        return 1 if n > LONG or stops >= 0.3 else 0
    return -1 if stops < 0.1 or b.linked > 0.2 * n else 0


def nearest(labels: list[int]) -> list[int]:
    """Pass 2: of each open label the nearest decided one, the one before on a tie; 0 if there is none."""
    left, label, far = [], 0, 1 << 30
    for x in labels:
        label, far = (x, 0) if x else (label, far + 1)
        left.append((label, far))
    out, label, far = list(labels), 0, 1 << 30
    for i in range(len(labels) - 1, -1, -1):
        label, far = (labels[i], 0) if labels[i] else (label, far + 1)
        before, d = left[i]
        out[i] = before if before and (d <= far or not label) else label
    return out


def main_text(page: str) -> tuple[str, int]:
    found, aparts = blocks(page)
    stops = [0.0 if b.place < 0 else density(b.text) for b in found]
    if any(b.apart >= 0 for b in found):
        reads = [x >= 0.1 and len(b.text) >= SHORT and 5 * b.linked <= len(b.text) for b, x in zip(found, stops, strict=True)]
        if not any(reads):  # no language of the list
            reads = [b.place >= 0 and len(b.text) >= LONG and 5 * b.linked <= len(b.text) for b in found]
        lifted = wrappers(found, [len(b.text) if r else 0 for b, r in zip(found, reads, strict=True)], aparts)
        kept = [True] * len(aparts)  # whether all such elements around it, itself included, are wrappers
        for x, a in enumerate(aparts):
            kept[x] = x in lifted and (a.above < 0 or kept[a.above])
        found = [b if b.apart < 0 or kept[b.apart] else b._replace(place=-1) for b in found]
    long = [x for b, x in zip(found, stops, strict=True) if b.place >= 0 and len(b.text) >= SHORT and 2 * b.linked <= len(b.text)]
    if long and max(long) < 0.1:  # no language of the list: density tells nothing here
        stops = [0.26] * len(found)
    first = [decided(b, x) for b, x in zip(found, stops, strict=True)]
    inside = sum(len(b.text) for b, x in zip(found, first, strict=True) if b.place > 0 and x >= 0)
    outside = sum(len(b.text) for b, x in zip(found, first, strict=True) if b.place == 0 and x > 0)
    if inside > outside:  # the article is marked: what stands beside it has to be long and dense
        first = [-1 if b.place == 0 and not (x > 0 and len(b.text) > LONG and d >= 0.3) else x for b, x, d in zip(found, first, stops, strict=True)]
    every = nearest(first)
    own = [i for i, b in enumerate(found) if b.place > 0]
    for i, x in zip(own, nearest([first[i] for i in own]), strict=True):
        every[i] = x or 1  # inside an article only its own blocks count as neighbours
    if not any(first):
        every = [1] * len(found)  # only open blocks: nothing speaks against them
    return "\n\n".join(b.text for b, x in zip(found, every, strict=True) if x > 0), len(found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of each row of pages(page_id, url, html), repeated rows included.

    Null and empty html, and pages without main text, give an empty text; markup that isn't closed is read to the end; other columns are
    dropped; an empty table gives no rows.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
