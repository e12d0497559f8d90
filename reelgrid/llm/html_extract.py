"""Main text of web pages by two passes over their blocks.

Markup is cut into blocks at block-level tags. Where structure says what a block is, that holds, whatever its length:
what stands in menus, headers of the page, footers, sidebars, forms, adverts, notices or comments (by element, role or
name) is boilerplate, and what else stands in an article or main element is main text. Elsewhere pass 1 decides blocks
by length, stop-word density and link density, and short ones stay open. Pass 2:
open blocks take the label of the nearest decided neighbours on both sides; where these differ, the nearer one's, or
on pages with an article, boilerplate.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.words import small_batches

# Frequent function words of the languages in view.
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its "
        "me more my no not of on one only or other our out she so some than that the their them then there these they this to up was we were what when "
        "which who will with would you your "
        "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für hat ich ihr im in ist ja "
        "kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
        "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me ne nous on ont ou où par pas plus pour qu que qui sa se "
        "ses son sont sur te tu un une vous y "
        "al como con cuando del desde donde e el ella ellos entre era es esta este fue ha hay la las lo los mi muy más ni o para pero por porque que se "
        "ser si sin sobre su sus también tan te tiene todo tu un una y ya"
    ).split()
)
# HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title select textarea button audio video map datalist".split())
AWAY = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription paywall signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar rail widget widgets related recommended recommendations trending popular share sharing social "
    "footer masthead comment comments commentlist disqus reply replies respond toc pagination pager tags skip alert toolbar".split()
)
WRAPPERS = frozenset("area bar block box container inner item items list outer section wrap wrapper".split())
REPLIES = frozenset("comment comments reply replies".split())
MAIN_NAMES = frozenset("article main content post entry story body text".split())

DEPTH = 512  # open elements; deeper ones are taken as if their tags were not there, as browsers do

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
_PARTS = re.compile(r"[-_0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？]")
_SPACE = re.compile(r"\s+")
_EDGES = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»„“”‘’‚…–—¿¡"


def _named(value: str, names: frozenset[str]) -> bool:
    """True if a class or id of value is one of the names as a whole, or made of them only: cookie-notice, comment-list, not no-comments."""
    return any(all(w in names or w in WRAPPERS for w in parts) and not WRAPPERS.issuperset(parts) for token in value.lower().split() if (parts := [w for w in _PARTS.split(token) if w]))


class _Element:
    __slots__ = ("away", "drop", "link", "main", "name", "named", "placed", "replies")

    def __init__(self, name: str, up: _Element | None, attributes: str) -> None:
        self.name = name
        values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        role = values.get("role", "").lower()
        opens = name in ("article", "main") or role in ("main", "article")
        self.main = bool(up and up.main) or opens
        # a header of the article is part of it, that of the page is not
        self.placed = bool(up and up.placed) or name in AWAY or role in AWAY_ROLES or (name == "header" and not self.main)
        # names of wrappers say nothing of an article that they contain, but what answers an article is none
        own = [values[k] for k in ("class", "id") if k in values] if name not in ("html", "body") else []
        self.replies = bool(up and up.replies) or any(_named(v, REPLIES) for v in own)
        inherited = bool(up and up.named) and not (opens and not up.main)
        self.named = inherited or self.replies or (not opens and any(_named(v, AWAY_NAMES) for v in own))
        hidden = bool(re.search(r"\bhidden\b", attributes.split("=")[0])) if attributes and "=" not in attributes else "hidden" in values or values.get("aria-hidden") == "true"
        self.away = self.placed or self.named
        self.drop = bool(up and up.drop) or name in DROPPED or hidden or "display:none" in values.get("style", "").replace(" ", "").lower()
        self.link = bool(up and up.link) or name == "a"


class Block:
    """A block's text and what pass 1 looks at."""

    __slots__ = ("away", "label", "linked", "main", "parts", "text", "title")

    def __init__(self, at: _Element) -> None:
        self.away, self.main, self.title = at.away, at.main, at.name in ("h1", "h2", "h3", "h4", "h5", "h6")
        self.parts: list[str] = []
        self.linked, self.text, self.label = 0, "", None


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag with attributes from `at` ends: at a > outside of quoted values, else at the end of the page. A quote
    counts after = only, and if it is closed; last: the last place of each quote."""
    while m := _STOP.search(page, at):
        at, c = m.end(), m.group()
        if c == ">":
            return at
        k = m.start() - 1
        while k >= 0 and page[k].isspace() and m.start() - k < 64:
            k -= 1
        if page[k] == "=" and last[c] > m.start():
            at = page.index(c, at) + 1
    return len(page)


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end): kind is "text", "open" or "close". Each character is looked at a bounded
    number of times, whatever is left open. A value sent in is the place to go on from."""
    at, end, last = 0, len(page), {q: page.rfind(q) for q in "\"'"}
    while at < end:
        lo = page.find("<", at)
        if lo != at:
            to = lo if lo >= 0 else end
            yield "text", page[at:to], "", to
            at = to
        elif page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            to = page.find(mark, at + 4)
            at = to + 3 if to >= 0 else end
        elif page.startswith(("<!", "<?"), at):
            to = page.find(">", at)
            at = to + 1 if to >= 0 else end
        elif m := _NAME.match(page, at + 1 + (closes := page.startswith("</", at))):
            to = _tag_end(page, m.end(), last)
            jump = yield "close" if closes else "open", m.group().lower(), page[m.end() : to].removesuffix(">"), to
            at = jump or to
        else:
            yield "text", "<", "", at + 1
            at += 1


# Elements whose end tag may be left out, and what their start closes.
_SHUTS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")} | {f"h{i}": ("p",) for i in range(1, 7)}


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with any text, in order. Unclosed and stray tags are taken as browsers do, as far as it matters."""
    stack = [_Element("#page", None, "")]
    out = [Block(stack[0])]
    open_: Counter[str] = Counter()

    def fresh() -> None:
        if out[-1].parts:
            out.append(Block(stack[-1]))
        else:
            out[-1] = Block(stack[-1])

    def close(depth: int) -> None:
        for x in stack[depth:]:
            open_[x.name] -= 1
        del stack[depth:]

    found, jump = tokens(page), None
    while True:
        try:
            kind, name, attributes, end = found.send(jump)
        except StopIteration:
            break
        jump = None
        if kind == "text":
            here = stack[-1]
            if not here.drop:
                out[-1].parts.append(name)
                if here.link:
                    out[-1].linked += len(name.strip())
        elif kind == "close":
            if open_[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            if name in BLOCKS:
                fresh()
        elif name == "br":
            out[-1].parts.append(" ")
        else:
            shut = [x for x in _SHUTS.get(name, ()) if open_[x]]
            for i in range(len(stack) - 1, 0, -1) if shut else ():
                if stack[i].name in shut:
                    close(i)
                    break
                if stack[i].name in BLOCKS:
                    break
            if name in _RAW_END:
                stop = _RAW_END[name].search(page, end)
                jump = stop.end() if stop else len(page)
            elif name not in VOID and not attributes.endswith("/") and len(stack) < DEPTH:
                stack.append(_Element(name, stack[-1], attributes))
                open_[name] += 1
            if name in BLOCKS or name in _RAW_END:
                fresh()
    for b in out:
        b.text = _SPACE.sub(" ", _html.unescape("".join(b.parts))).strip()
    return [b for b in out if b.text]


def classify(blocks: list[Block], short: int = 70, long: int = 200, low: float = 0.20, high: float = 0.30, linked: float = 0.33) -> None:
    """Sets each block's label: True for main text.

    Pass 1: what stands in menus and the like is boilerplate, what else stands in an article or main element is main
    text. Other blocks are boilerplate if more than `linked` of the characters are links; those shorter than `short`
    characters and titles stay open; the rest is main text if the share of stop words is `high`, or `low` for long ones,
    and boilerplate if it is below `low` and there is no sentence.
    """
    any_main = any(b.main and not b.away for b in blocks)
    for b in blocks:
        share = b.linked / max(1, len(b.text))
        words = [w.strip(_EDGES).lower() for w in b.text.split()]
        stop = sum(w in STOP_WORDS for w in words) / len(words)
        sentence = bool(_SENTENCE.search(b.text))
        if b.away or b.main:
            b.label = not b.away
        elif share > linked:
            b.label = False
        elif b.title or len(b.text) < short:
            b.label = None
        elif stop >= high or (stop >= low and len(b.text) >= long):
            b.label = True
        elif stop < low and not sentence:
            b.label = False
        else:
            b.label = True if len(b.text) >= long else None
    decided = [i for i, b in enumerate(blocks) if b.label is not None]
    labels = [b.label for b in blocks]
    k = 0
    for i, b in enumerate(blocks):
        if b.label is not None:
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        if before is None or after is None:
            near = after if before is None else before
            labels[i] = bool(near is not None and blocks[near].label) and (not any_main or (b.title and before is None))
        elif blocks[before].label == blocks[after].label:
            labels[i] = blocks[before].label
        elif b.title:
            labels[i] = blocks[after].label  # a title belongs to what follows
        elif any_main:
            labels[i] = False
        else:
            labels[i] = blocks[before if i - before <= after - i else after].label
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def main_text(page: str | None, between: str = "\n") -> str:
    """The main text of one page: its blocks in order with `between` in between; empty if there is none."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return between.join(b.text for b in blocks if b.label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html")
        texts = [main_text(pages[i].as_py(), "\n\n") for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text, empty if none), n_chars (its code points) of every page, from the whole html.

    null html is empty. Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by two line feeds. Broken pages are read once from front to end, however long. Rows pass one by one: repeated rows, null ids and urls stay as they are.
    Other columns are left aside. No shuffle.
    """
    src = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
