"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, table

#: Function words of the languages met; their share tells prose from labels.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so und von war was wie wir zu zum "
    "al como con del el ella ellos en era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin su sus un una y ya".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What stands inside these never is main text.
DROPPED_TAGS = frozenset("head nav footer aside form menu dialog select button template noscript iframe svg object canvas video audio textarea".split())
RAW_TAGS = frozenset(("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class, id or role names of page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumb\w*|byline|comments?|consent|cookies?|copyright|disclaimer|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|alert|pager|pagination|popup|promo\w*|related|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget|reply|replies|discussion|complementary|contentinfo|signup|login|search|tags|teaser)(?:$|[\s_-])",
    re.I,
)
#: Styles that take an element off the page.
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An attribute: its name and, if there is one, its value in quotes or without.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
#: Scripts that write no spaces between words, and the characters that only running text in them has plenty of.
SPACELESS = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
RUNNING = re.compile(r"[\u3041-\u3096\u0E30-\u0E3A\u0E40-\u0E4E\u102B-\u103E\u17B6-\u17D3。，、；！？的了是在和不有这也就都而与为以于]")
#: Page furniture of an article's own, such as its headline's header, may stand in these.
CONTENT_TAGS = frozenset(("article", "main"))
#: A tag with its attributes; where quotes don't close, up to the next bracket.
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>", re.S)
#: Names such as with-sidebar speak of the page around, not of the element.
LAYOUT = re.compile(r"(?<![\w])(?:with|without|has|no|show|hide)[-_][\w-]*", re.I)
#: Names of reader comments: an article inside these is a comment, too.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|discussion)(?:$|[\s_-])", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SPACE = re.compile(r"\s+")

SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW = 0.10
STOP_HIGH = 0.20
MAX_LINK_DENSITY = 0.4
#: Elements of this depth at most are asked whether they hold most of the page, so that time stays linear in deep nesting.
MAX_SIDES = 32


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    inside: bool
    side: tuple[int, ...] = ()


def tags_of(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """(text before, tag) of each tag in order, the last without one. Comments and declarations are left out, CDATA is text.

    Linear in the page: once a tag's quotes don't close, quotes count for nothing from there on; once no bracket is left, the rest is text.
    """
    at, n, tag, start = 0, len(page), TAG, 0
    text: list[str] = []
    while at < n:
        begin = page.find("<", max(at, start))
        if begin < 0:
            break
        if page.startswith("<!--", begin) or page.startswith("<![CDATA[", begin):
            data = page[begin + 2] == "["
            end = page.find("]]>" if data else "-->", begin + (9 if data else 4))
            text.append(page[at:begin])
            if data:
                text.append(entities.escape(page[begin + 9 : n if end < 0 else end]))
            at = start = n if end < 0 else end + 3
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            end = page.find(">", begin)
            text.append(page[at:begin])
            at = start = n if end < 0 else end + 1
            continue
        if not page[begin + 1 : begin + 3].lstrip("/")[:1].isalpha():
            start = begin + 1
            continue
        m = tag.match(page, begin)
        if m is None and tag is TAG:
            tag = LOOSE_TAG
            m = tag.match(page, begin)
        if m is None:
            if page.find(">", begin) < 0:
                break
            start = begin + 1
            continue
        text.append(page[at:begin])
        past = yield "".join(text), m
        text.clear()
        at = start = past if past is not None else m.end()
    text.append(page[at:])
    yield "".join(text), None


def blocks_of(page: str) -> list[Block]:
    """Blocks of text outside of scripts, forms and other page furniture, in page order.

    Tags that are never closed end with the element around them. `inside` tells blocks of an article or main
    element. An article inside an element that is furniture by its class only (a layout with a sidebar, say) counts, one inside reader comments doesn't.
    `side` tells the block elements around a block, up to the next article, that are furniture by their class only: overruled() decides on these.
    """
    found: list[Block] = []
    parts: list[str] = []
    links, headings, content = [0], 0, 0
    #: What is dropped now: by tag or comments (hard), by the class of an inline element (soft), perhaps by that of a block element (side); an article sets the last two aside.
    hard, soft, link, side, sides = 0, 0, 0, (), 0
    stack: list[tuple[str, int, int, tuple[int, ...]]] = []
    opened: dict[str, int] = {}

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Block(text, min(links[0], len(text)), headings > 0, content > 0, side))
            parts.clear()
        links[0] = 0

    tags = tags_of(page)
    past = None
    while True:
        try:
            raw, m = tags.send(past)
        except StopIteration:
            break
        past = None
        if raw and not hard and not soft:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                links[0] += len(text.strip())
        if m is None:
            break
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            flush()
        closes = 0
        if m[1]:
            if opened.get(tag):
                closes = 1
                while stack[-closes][0] != tag:
                    closes += 1
        # A paragraph or list item ends where the next one begins.
        elif tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag and tag not in VOID_TAGS:
            closes = 1
        for _ in range(closes):
            name, kind, soft, side = stack.pop()
            opened[name] -= 1
            hard -= kind == 2
            link -= name == "a"
            headings -= name in HEADINGS
            content -= name in CONTENT_TAGS
        if m[1] or tag in VOID_TAGS:
            continue
        attributes = m[3]
        if attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, m.end())
            past = end.end() if end else len(page)
            continue
        kind = 2 if tag in DROPPED_TAGS or (tag == "header" and not content) else furniture(attributes) if attributes and tag not in ("html", "body", "article", "main") else 0
        stack.append((tag, kind, soft, side))
        opened[tag] = opened.get(tag, 0) + 1
        hard += kind == 2
        if tag in CONTENT_TAGS:
            soft, side = 0, ()
        elif kind == 1 and tag in BLOCK_TAGS:
            sides += 1
            side = (*side, sides) if len(side) < MAX_SIDES else side
        else:
            soft += kind == 1
        link += tag == "a"
        headings += tag in HEADINGS
        content += tag in CONTENT_TAGS
    flush()
    return found


def furniture(attributes: str) -> int:
    """0: no furniture by its names, 1: by a class that an inner article or most of the page's text overrules, 2: hidden or reader comments."""
    own: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        own.setdefault(name.lower(), a or b or c)
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or HIDDEN_STYLE.search(own.get("style", "")):
        return 2
    names = [LAYOUT.sub(" ", own[n]) for n in ("class", "id", "role") if n in own]
    if any(COMMENT.search(x) for x in names):
        return 2
    return int(any(FURNITURE.search(x) for x in names))


def overruled(blocks: list[Block], labels: list[str]) -> set[int]:
    """The elements called furniture by their class that hold more than half of the page's good and near_good text: a page is not its own sidebar."""
    total, inside = 0, {}
    for b, label in zip(blocks, labels, strict=True):
        if label in ("good", "near_good"):
            total += len(b.text)
            for k in b.side:
                inside[k] = inside.get(k, 0) + len(b.text)
    return {k for k, n in inside.items() if 2 * n > total}


def first_pass(block: Block) -> str:
    """good, bad, near_good or short, by link density, length and stop-word density. An article's blocks need less of it."""
    text = block.text
    words = text.split(" ")
    dense = len(SPACELESS.findall(text)) if not text.isascii() else 0
    if block.link_chars > MAX_LINK_DENSITY * len(text):
        return "bad"
    stop = sum(w.strip(".,;:!?()\"'*#$%&|").lower() in STOP_WORDS for w in words) / len(words)
    if "©" in text and len(text) < LONG_CHARS:
        return "bad"
    high = STOP_LOW if block.inside else STOP_HIGH
    size = len(text)
    if 2 * dense > size:
        # A character is about a syllable here, and the share of characters that only running text has stands for that of stop words.
        size, stop = size + 2 * dense, 2 * len(RUNNING.findall(text)) / size
    if size < SHORT_CHARS:
        return "short"
    if stop >= high:
        return "good" if size > LONG_CHARS else "near_good"
    return "near_good" if stop >= STOP_LOW else "short" if block.inside else "bad"


def decided_neighbours(labels: list[str]) -> list[set[str]]:
    """For each block the labels of the nearest decided block before it and of the nearest one behind it."""
    near: list[set[str]] = [set() for _ in labels]
    for places in (range(len(labels)), reversed(range(len(labels)))):
        last = None
        for i in places:
            if last is not None:
                near[i].add(last)
            if labels[i] in ("good", "bad"):
                last = labels[i]
    return near


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbours.

    Where a page marks an article that holds more than lists of links, the article is a page of its own: its blocks look for
    neighbours in it only, and what lies outside goes. Between a good and a bad neighbour a near_good block is good, so is a heading
    and, in an article, any other; outside a short one is bad. Without any good block the near_good ones count as good, and
    a short block of an article without decided ones stays.
    """
    article = any(b.inside and x != "bad" for b, x in zip(blocks, labels, strict=True))
    out = [False] * len(blocks)
    at = [i for i, b in enumerate(blocks) if b.inside or not article]
    own = [labels[i] for i in at]
    if "good" not in own:
        own = ["good" if x == "near_good" else x for x in own]
    for i, label, near in zip(at, own, decided_neighbours(own), strict=True):
        if label in ("good", "bad"):
            out[i] = label == "good"
        elif len(near) == 2:
            out[i] = article or label == "near_good" or blocks[i].heading
        else:
            out[i] = "good" in near or (article and not near)
    return out


def extract(page: str | None) -> str:
    """The main text: kept blocks joined by line feeds, empty if there is none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    labels = [first_pass(b) for b in blocks]
    if any(b.side for b in blocks):
        counts = overruled(blocks, labels)
        fine = [all(k in counts for k in b.side) for b in blocks]
        blocks, labels = ([x for x, ok in zip(own, fine, strict=True) if ok] for own in (blocks, labels))
    keep = second_pass(blocks, labels)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars; the pages are not shuffled.

    Blocks inside navigation, headers, footers, sidebars, notices, adverts, forms, comments,
    scripts and styles are dropped by tag and by class, id or role name; an element that is furniture by such a name only, but holds more than
    half of the page's prose, is none. The first pass
    labels a block by stop-word density, length and link density; the second gives
    ambiguous short blocks the label of their nearest decided neighbours. Where a page marks its article and that holds
    more than links, both passes run over the article's blocks, which need less density to count as prose. Time is linear in the page.

    Nulls: a null page has an empty text; null ids and urls are kept. Repeated rows give
    repeated rows, an empty table an empty result. Broken markup never raises.
    """
    on_workers(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
