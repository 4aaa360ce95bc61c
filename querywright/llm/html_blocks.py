"""Operator 6, HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass judges every block by
its length, its share of stop words and its share of linked characters.  Where it
stands counts too: a block in an element or under a class word of menus, footers and
the like is bad; where marked article or main parts hold at least half of the running
text, a block in them needs less evidence and one outside more.  Paragraphs of middling
length are good if several in a row are long together.  What this leaves open, short
blocks above all, takes in the second pass the label of its nearest decided neighbours, those
under the same parent element if there are any.
"""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text is no text.
RAW = frozenset("script style template noscript textarea title svg iframe object canvas audio video select annotation annotation-xml".split())
#: Elements around an article rather than in it: their blocks are bad.
AROUND = frozenset("nav header footer aside form dialog menu button fieldset".split())
#: Elements that end a block where they begin or end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark what is not the article, unless it holds most of the text.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|sidebar|side-?bar"
    r"|footer|header|masthead|comments?|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|tags?|login|signup|search|skip|copyright|legal"
    r"|contentinfo|complementary|navigation|dialog)(?:$|[\s_-])",
    re.I,
)
#: What readers add below an article, which may be longer than it.
THREAD = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies|reply)(?:$|[\s_-])", re.I)
#: Words that tell of a layout's parts or their state, not of the element.
ABOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|not|with|without)[_-][\w-]*|[\w-]+[_-](?:open|closed|enabled|disabled)(?![\w-])", re.I)
#: Frequent function words of the languages most met; they need not be complete.
STOP = frozenset(
    "a an and are as at be been but by can did do for from had has have he her his i if in into is it its more no not of on one or our she so than that the their them there they this to was we were what when which who will with would you your"
    " au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous"
    " aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war was wenn wie wir wird zu zum zur über"
    " al como con cuando del desde donde el ella ellos entre era es esta este esto fue ha hay la las lo los muy más no nos para pero por porque que se ser si sin sobre su sus también tiene un una y ya".split()
)
#: Comments, CDATA, declarations and tags; a quote opens a value only after an equals sign.
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.28
MOST_LINKED = 0.33
#: How many blocks farther than the next one what a heading belongs to may begin.
APART = 8

GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: bool  # in a marked article or main part
    place: int = 0  # the element that holds it and its siblings
    around: bool = False  # in an element or under a class word of boilerplate
    label: str = OPEN
    under: tuple[int, ...] = ()  # the elements around it that a class word calls boilerplate

    @property
    def plain(self) -> bool:
        """Running text by its place and links."""
        return not self.around and self.linked <= MOST_LINKED * len(self.text)

    @functools.cached_property
    def stop(self) -> float | None:
        return stop_share(self.text)


def end_of_raw(page: str, name: str, at: int) -> int:
    """Where the closing tag of a raw element begins; the page's end if there is none."""
    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def telling(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is not shown, and the class words that call it boilerplate."""
    if not attributes or not TELLING.search(attributes):
        return False, ""
    said = ""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and UNSEEN.search(value)):
            return name not in ("html", "body"), ""
        if key in ("class", "id", "role") and name not in ("html", "body"):
            # Articles and main parts are often classed by their subjects; only readers' comments count there.
            words = THREAD if name in ("main", "article") else BOILER
            if words.search(value) and words.search(own := ABOUT.sub("", value)):
                said += " " + own
    return False, said


def shade(blocks: list[Block], shades: list[str]) -> None:
    """Mark as ``around`` the blocks that a class word hides.

    A class word does not hide an element that holds more than half of the page's text,
    or of its marked text, as wrappers do (of the page's, more than a short paragraph).  One named for readers' comments, which may
    be longer than the article, must hold all good text or all marked text.  Blocks
    that are bad by themselves don't count.
    """
    if not any(b.under for b in blocks):
        return
    known = covered(blocks)
    labels = [judge(b, known) for b in blocks]
    fair = [b for b, label in zip(blocks, labels, strict=True) if label != BAD]
    best = [b for b, label in zip(blocks, labels, strict=True) if label == GOOD] or fair
    marked = [b for b in fair if b.inside]
    threads = {k for k, said in enumerate(shades) if THREAD.search(said)}
    shown = set()
    for some, whole in ((fair, False), (marked, False), (best, True), (marked, True)):
        total, held = 0, [0] * len(shades)
        for b in some:
            total += len(b.text)
            for k in b.under:
                held[k] += len(b.text)
        # A short part of a page with marks is no wrapper.
        enough = LONG if some is fair and marked else 0
        shown |= {k for k, h in enumerate(held) if h > enough and (k in threads) == whole and (h == total if whole else 2 * h > total)}
    for b in blocks:
        b.around |= not shown.issuperset(b.under)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in page order, but for what is not shown."""
    out: list[Block] = []
    parts: list[tuple[tuple[int, ...], str, int]] = []  # shades, text, linked characters
    stack: list[tuple] = []  # name, is not shown, is around, is an article or main, is shaded, is a block element
    shades: list[str] = []
    under: tuple[int, ...] = ()
    # The tree of block elements: each one's parent, and whether it holds others.
    parent, branches, here = [0], [True], 0
    at = hidden = links = article = around = 0
    heading = False

    def end_block():
        nonlocal heading
        heading_was, heading = heading, False
        if not parts:
            return
        # What a shaded inline element holds is a block of its own.
        for shaded in dict.fromkeys([u for u, _, _ in parts]):
            text = " ".join("".join([t for u, t, _ in parts if u == shaded]).split())
            if text:
                out.append(Block(text, sum([n for u, _, n in parts if u == shaded]), heading_was, article > 0, here, around > 0, under=shaded))
        parts.clear()

    def leave(to: int):
        nonlocal hidden, links, article, around, under, here
        while len(stack) > to:
            name, unseen, aside, main, shaded, block = stack.pop()
            hidden -= unseen
            around -= aside
            article -= main
            links -= name == "a"
            under = under[:-1] if shaded else under
            here = parent[here] if block else here

    def say(raw: str):
        if raw and not hidden:
            text = entities.unescape(raw)
            parts.append((under, text, len(text.strip()) if links else 0))

    while True:
        tag = TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            if tag[0].startswith("<![CDATA["):
                say(entities.escape(tag[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = tag[2].lower()
        if name in BLOCKS:
            end_block()
        elif name == "br":
            parts.append((under, " ", 0))
        if tag[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
                # An inline end tag doesn't reach past the block it stands in.
                if stack[k][0] in BLOCKS and name not in BLOCKS:
                    break
            continue
        if name in RAW:
            at = at if tag[0].endswith("/>") else end_of_raw(page, name, at)
            continue
        if name in VOID or tag[0].endswith("/>"):
            continue
        block = name in BLOCKS
        if block:
            # A block ends the paragraph that is open, and with it the inline elements left open in it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            if len(name) == 2 and name[0] == "h" and name[1].isdigit():
                heading = True
            branches[here] = True
            parent.append(here)
            branches.append(False)
            here = len(parent) - 1
        (unseen, said), aside, main = telling(name, tag[3]), name in AROUND, name in ("article", "main")
        stack.append((name, unseen, aside, main, bool(said), block))
        if said:
            under += (len(shades),)
            shades.append(said)
        hidden += unseen
        around += aside
        article += main
        links += name == "a"
    end_block()
    # A block stands beside those that share its element's parent; text right in a larger element beside its children.
    for b in out:
        b.place = b.place if branches[b.place] else parent[b.place]
    shade(out, shades)
    return out


def stop_share(text: str) -> float | None:
    """The share of stop words; None for a text without words."""
    words = LETTERS.findall(text.lower())
    return sum([w in STOP for w in words]) / len(words) if words else None


def covered(blocks: list[Block]) -> bool:
    """Whether the stop list knows a page's language: half of its running text has a fair share of them."""
    total = known = 0
    for b in blocks:
        n = len(b.text)
        if n >= SHORT and b.plain and (stop := b.stop) is not None:
            total += n
            known += n if stop >= STOP_LOW else 0
    return 2 * known >= total


def judge(block: Block, known: bool = True, marked: bool = False) -> str:
    """First pass: good, bad, or open for a block that its own text and place cannot settle.

    On a page whose language the stop list does not know, length and links decide.
    ``marked`` says that marked parts hold most of the page's text: then a block in them
    is good with less evidence and never bad for want of stop words, and one outside is
    at best open.
    """
    n = len(block.text)
    if not block.plain:
        return BAD
    if block.heading:
        return OPEN
    outside = marked and not block.inside
    stop = block.stop if n >= SHORT else None
    if stop is None:
        return BAD if outside else OPEN
    if outside:
        return OPEN if n > LONG and (not known or stop >= STOP_HIGH) else BAD
    if not known or stop >= STOP_LOW:
        return GOOD if n > LONG or (marked and stop >= STOP_HIGH) else OPEN
    return BAD if stop < STOP_LOW / 3 and not marked else OPEN


def judge_runs(blocks: list[Block], known: bool) -> None:
    """Open paragraphs in a row under one parent are good if they are long together and none lacks stop words."""
    run: list[Block] = []

    def end_run():
        if sum(len(b.text) for b in run) > LONG:
            for b in run:
                b.label = GOOD
        run.clear()

    for b in blocks:
        fair = b.label == OPEN and not b.heading and len(b.text) >= SHORT and b.stop is not None and (not known or b.stop >= STOP_LOW)
        if run and (not fair or b.place != run[-1].place):
            end_run()
        if fair:
            run.append(b)
    end_run()


def settle(blocks: list[Block]) -> None:
    """Second pass: open blocks take the label of their nearest decided neighbours.

    Neighbours are the next decided blocks before and after it under the same parent
    element; where that has none, those of the page.  Of unlike neighbours the nearer
    one counts, then the one that stands in a marked part if the block does, then the
    good one.  A heading belongs to what follows it: the next decided block of the page,
    or that under its parent if this is at most ``APART`` blocks farther.  Without
    decided neighbours a block is good.
    """

    def sides(order: range) -> dict[int, tuple[int | None, int | None]]:
        """For each open block its next decided neighbours on the side that ``order`` comes from: under its parent, of the page."""
        out, last, by_place = {}, None, {}
        for k in order:
            b = blocks[k]
            if b.label != OPEN:
                last = by_place[b.place] = k
            else:
                out[k] = by_place.get(b.place), last
        return out

    left, right = sides(range(len(blocks))), sides(range(len(blocks) - 1, -1, -1))
    told = {}
    for k, (same, any_) in left.items():
        b, (same_after, after) = blocks[k], right[k]
        if b.heading and after is not None:
            near = [same_after if same_after is not None and same_after - after <= APART else after]
        else:
            near = [j for j in (same, same_after) if j is not None] or [j for j in (any_, after) if j is not None]
        least = min((abs(k - j) for j in near), default=0)
        at = [j for j in near if abs(k - j) == least]
        labels = {blocks[j].label for j in at}
        if len(labels) > 1:
            labels = {blocks[j].label for j in at if blocks[j].inside == b.inside} or labels
        told[k] = labels.pop() if len(labels) == 1 else GOOD
    for k, label in told.items():
        blocks[k].label = label


def main_text(page: str | None) -> str:
    """The article of a whole page: its good blocks joined by line feeds; empty for none."""
    if not page:
        return ""
    blocks = blocks_of(page)
    known = covered(blocks)
    running = inside = 0
    for b in blocks:
        if b.plain:
            running += len(b.text)
            inside += len(b.text) if b.inside else 0
    marked = inside > 0 and 2 * inside >= running
    for b in blocks:
        b.label = judge(b, known, marked)
    judge_runs(blocks, known)
    if not any(b.label == GOOD for b in blocks):
        # Nothing is sure to be good: on a short page the paragraphs are, or else all that is open.
        rest = [b for b in blocks if b.label == OPEN]
        for b in [b for b in rest if not b.heading and len(b.text) >= SHORT] or rest:
            b.label = GOOD
    settle(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def _extract(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract_main_text(html: Column) -> Column:
    """The main text of each page: string, never null.

    Null and empty pages and pages without an article give the empty string; markup
    that is cut off or badly nested is read as far as it goes; equal pages give
    equal texts.
    """
    return F.pandas_udf(_extract, "string")(html)
