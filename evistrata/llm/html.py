"""Main-text extraction from web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  Menus, headers, notices, adverts, comments and
their like are bad by their tag, role or name, however long.  The first pass classifies all
other blocks by stop-word density, length and link density; short or middling ones stay
ambiguous.  In the second pass these inherit the label of their nearest decided neighbour, good
ones winning a tie.  An article is evidence: few stop words do not make a block in it bad, and
its ambiguous blocks look for neighbours inside it only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm.base import map_batches

#: An attribute: a quote counts only behind an equals sign, and only if it is closed.
ATTRIBUTE = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++))?+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[\s/]++|{ATTRIBUTE}|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
NAMED_VALUE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""", re.S)
TELLING = re.compile("class|id|role|hidden", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

# How HTML elements behave.
RAW = frozenset("script style textarea title noscript template svg math iframe object select option canvas xmp noembed noframes".split())
ENDLESS = frozenset("script style textarea title".split())  # without an end tag they hold the rest of the page
UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>]+/$")
OPTION_STOP = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button fieldset head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond share sharing "
    "shoutbox sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside a chrome name in a class or id without changing what it says.
NEUTRAL_NAMES = frozenset(
    "area articles bar block bottom box button buttons col column container global group icon icons inner item items left link links list main page "
    "posts primary right row secondary section site text top wrap wrapper".split()
)
#: A section with such an id holds what readers wrote; other ids of sections are anchors.
READER_NAMES = frozenset("comment comments disqus respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Open elements that a start tag ends, and those behind which it does not look for them.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
} | {name: (frozenset("thead tbody tfoot tr".split()), frozenset(["table"])) for name in ("thead", "tbody", "tfoot")}
PARAGRAPH = (frozenset(["p"]), None)  # behind anything but inline elements it is not looked for
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which "
    "will with would you "
    # German
    "als am auch auf aus bei bis das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind "
    "so über um und von vor war wie wird zu zum zur "
    # French
    "au aux avec ce ces cette comme dans de des du elle en est et il ils la le les leur mais ne nous on ont ou par pas plus pour qui que sa se ses son "
    "sont sur un une vous "
    # Spanish
    "al como con cuando de del desde donde el ella en entre era es esta este esto ha hay la las lo los más muy no o para pero por que se ser si sin "
    "sobre su sus también un una y ya".split()
)
GOOD, BAD, UNSURE = "good", "bad", "unsure"


@dataclass(frozen=True)
class Limits:
    """A block over ``link_density`` is chrome.  One of at least ``long_chars`` with a share of
    ``stop_words`` is text, and outside articles chrome with fewer than ``few_stop_words``; the
    rest is ambiguous.  In an article links alone are chrome from ``long_chars`` on."""

    link_density: float = 0.5
    long_chars: int = 70
    stop_words: float = 0.25
    few_stop_words: float = 0.08


@dataclass
class Block:
    """``article`` numbers the innermost article the block stands in, 0 outside."""

    text: str
    link_chars: int
    chrome: bool
    article: int


def _names_chrome(value: str, in_article: bool) -> bool:
    """Whether a class or id has a token that says chrome as a whole.

    Each part of such a token is a chrome name or a neutral word: ``cookie-notice`` and
    ``share-buttons`` are chrome, ``related-work`` and ``entry-header`` are not.  In an article
    a header is its own, as with the tag.
    """
    for token in value.split():
        parts = [part.lower() for part in NAME_PART.findall(token)]
        names = [part for part in parts if part in CHROME_NAMES and not (in_article and part == "header")]
        if names and all(part in CHROME_NAMES or part in NEUTRAL_NAMES for part in parts):
            return True
    return False


def _values(attributes: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in NAMED_VALUE.findall(attributes):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" and value[:1] == value[-1:] and len(value) > 1 else value)
    return found


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the tag, its role, state, class or id make an element chrome.

    Ids of headings, of articles and of an article's sections are anchors, unless a section's
    says that readers wrote it.
    """
    if tag in CHROME_TAGS:
        return not (in_article and tag == "header")
    if not attributes or not TELLING.search(attributes):
        return False
    values = _values(attributes)
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or values.get("role", "").lower() in CHROME_ROLES:
        return True
    if tag in ("html", "body"):
        return False
    if _names_chrome(values.get("class", ""), in_article):
        return True
    name = values.get("id", "")
    if tag in HEADINGS or tag in ARTICLE_TAGS:
        return False
    if in_article and tag == "section":
        parts = {part.lower() for part in NAME_PART.findall(name)}
        return bool(parts & READER_NAMES) and parts <= READER_NAMES | NEUTRAL_NAMES
    return _names_chrome(name, in_article)


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in ``/>``, and the slash is not part of an unquoted value."""
    return attributes.endswith("/") and not UNQUOTED_SLASH.search(attributes)


def _ends(html: str, name: str) -> dict[int, int]:
    """Where each element ``name`` that has an end tag starts, and where that end tag ends.

    An end tag belongs to the last open start tag; comments, scripts and styles are passed over.
    """
    tag = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1|\Z)|<(/?){re.escape(name)}(?=[\s/>]|\Z)([^>]*)(?:>|\Z)", re.S | re.I)
    opened, found = [], {}
    for match in tag.finditer(html):
        if match[2] is None:
            continue
        if match[2]:
            if opened:
                found[opened.pop()] = match.end()
        elif not _self_closed(match[3]):
            opened.append(match.start())
    return found


def _option_end(html: str, at: int) -> int:
    """Where an option ends whose tag ends at ``at``: at its end tag, or the next tag that it can't hold."""
    for match in OPTION_STOP.finditer(html, at):
        name = match[2].lower()
        if match[1] and name == "option":
            end = html.find(">", match.end())
            return end + 1 if end >= 0 else len(html)
        if name not in INLINE:
            return match.start()
    return len(html)


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order.

    Unclosed and crossed tags are tolerated: an end tag closes everything up to its start tag
    and is ignored if there is none; end tags that HTML lets authors leave out are implied, that
    of a paragraph by any block; a tag cut off by the end of the page is dropped.  An element
    that is skipped whole ends at its own end tag; without one only the tag is skipped, but for
    those in ``ENDLESS``.
    """
    ends: dict[str, dict[int, int]] = {}
    found: list[Block] = []
    open_tags: list[tuple[str, bool, int]] = []  # name, and chrome and article outside it
    opened: Counter = Counter()
    pieces: list[str] = []
    links = articles = article = 0
    chrome = False

    def close() -> None:
        nonlocal links
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                found.append(Block(text, links, chrome, article))
            pieces.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            pieces.append(raw)
            if opened["a"]:
                links += len(SPACE.sub(" ", unescape(raw)).strip())

    def end_to(place: int) -> None:
        """Close the open elements from ``place`` on."""
        nonlocal chrome, article
        while len(open_tags) > place:
            name, outer_chrome, outer_article = open_tags.pop()
            opened[name] -= 1
            if name not in INLINE:
                close()
            chrome, article = outer_chrome, outer_article

    def imply(names: frozenset, barriers: frozenset | None) -> None:
        """End the innermost open element of ``names`` in front of ``barriers`` (None: any block)."""
        if any(opened[name] for name in names):
            for place in range(len(open_tags) - 1, -1, -1):
                name = open_tags[place][0]
                if name in names:
                    return end_to(place)
                if name in barriers if barriers is not None else name not in INLINE:
                    return None
        return None

    at = 0
    while at < len(html):
        tag = html.find("<", at)
        if tag < 0:
            add(html[at:])
            break
        add(html[at:tag])
        token = TOKEN.match(html, tag)
        if not token:
            add("<")
            at = tag + 1
            continue
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name == "br" or name == "wbr":
            pieces.append(" " if name == "br" else "")
            continue
        if token[1]:
            if opened[name]:
                end_to(_last(open_tags, name))
            elif name not in INLINE:
                close()
            continue
        if name in ENDLESS:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "option":
            at = _option_end(html, at)
            continue
        if name in RAW:
            if not _self_closed(token[3]):
                if name not in ends:
                    ends[name] = _ends(html, name)
                at = ends[name].get(tag, at)
            continue
        if name not in INLINE:
            close()
            imply(*PARAGRAPH)
            if name in ENDS:
                imply(*ENDS[name])
        if name in VOID or _self_closed(token[3]) and name in INLINE:
            continue
        now = _is_chrome(name, token[3], bool(article))
        if name in INLINE:
            if now and not chrome:
                # its text is skipped; what stands around it is one block
                if name not in ends:
                    ends[name] = _ends(html, name)
                at = ends[name].get(tag, at)
                continue
            open_tags.append((name, chrome, article))
            opened[name] += 1
            continue
        open_tags.append((name, chrome, article))
        opened[name] += 1
        chrome = chrome or now
        if name in ARTICLE_TAGS:
            articles += 1
            article = articles
    close()
    return found


def _last(open_tags: list[tuple[str, bool, int]], name: str) -> int:
    """Where the innermost open ``name`` stands; all behind it is closed, so each entry is passed once."""
    place = len(open_tags) - 1
    while open_tags[place][0] != name:
        place -= 1
    return place


def _stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(word in STOP_WORDS for word in words) / len(words) if words else 0.0


def classify(block: Block, limits: Limits = Limits()) -> str:
    """First pass."""
    if block.chrome:
        return BAD
    if block.link_chars > limits.link_density * len(block.text) and not (block.article and block.link_chars < limits.long_chars):
        return BAD
    if len(block.text) < limits.long_chars:
        return UNSURE
    share = _stop_share(block.text)
    if share >= limits.stop_words:
        return GOOD
    return BAD if share < limits.few_stop_words and not block.article else UNSURE


def _nearest(labels: list[str], places: list[int]) -> dict[int, str]:
    """For each ambiguous one of ``places`` the label of the nearest decided one, good on a tie; none if none is decided."""
    found: dict[int, tuple[int, str]] = {}
    for order in (places, places[::-1]):
        distance, label = 0, ""
        for place in order:
            distance += 1
            if labels[place] != UNSURE:
                distance, label = 0, labels[place]
            elif label and (place not in found or distance < found[place][0] or distance == found[place][0] and label == GOOD):
                found[place] = (distance, label)
    return {place: label for place, (_, label) in found.items()}


def decide(page: list[Block], labels: list[str]) -> list[bool]:
    """Second pass: an ambiguous block takes the label of the nearest decided one.

    In an article that is a neighbour inside it which is text; link lists and chrome say nothing
    about the article around them, and without a neighbour the article itself decides.  Outside,
    chrome counts if the page has text at all; without any neighbour a block stays.
    """
    text_there = GOOD in labels
    inherited = _nearest(labels, [place for place, block in enumerate(page) if text_there or not block.chrome])
    inside: dict[int, list[int]] = {}
    for place, block in enumerate(page):
        if block.article:
            inherited.pop(place, None)
            if labels[place] != BAD:
                inside.setdefault(block.article, []).append(place)
    for places in inside.values():
        inherited |= _nearest(labels, places)
    return [label == GOOD or label == UNSURE and inherited.get(place, GOOD) == GOOD for place, label in enumerate(labels)]


def main_text(html: str, limits: Limits = Limits()) -> str:
    page = blocks(html)
    kept = decide(page, [classify(block, limits) for block in page])
    return "\n\n".join(block.text for block, keep in zip(page, kept) if keep)


def extract(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) per page.

    Null or empty html, and pages of chrome only, give an empty text.  Rows that repeat give a
    row each, nulls in other columns stay, very long pages are read as a whole in time that
    grows with their length, and an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def make():
        def work(batch):
            found = [main_text(html, limits) for html in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": list(map(len, found))}

        return work

    return map_batches(rows, make, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
