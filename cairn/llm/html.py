"""Main text of web pages by two passes over their blocks.

The first pass decides blocks by where they stand, link density, length and stop-word density; the
second gives short and middling blocks the label of the nearest decided blocks around them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_batch, table

#: Characters below which a block is short and above which a good one is long; link share of a menu; stop-word shares.
SHORT, LONG, LINKS, FEW_STOPS, MANY_STOPS = 70, 200, 0.33, 0.10, 0.20
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is it that for was on are as with be by at or from this an not have had which they were their
    der die das und in den von zu mit ist im ein eine des dem nicht auf für als auch es an werden aus er hat dass sie nach bei einer
    le la les de des du et un une en est que qui dans pour sur au par plus ce il elle avec se sont ne pas ou
    el los las y del se con para una por su al lo como más pero sus le ya o este""".split()
)
#: Elements without text of their own, elements that break blocks, elements around a page's text.
SILENT = frozenset("script style noscript template svg iframe object canvas math audio video".split())
AROUND = frozenset("head title nav footer aside form button select textarea menu dialog datalist".split())
BREAKS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 head header hr html li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name what isn't the page's own text.
NAMES = frozenset(
    """ad ads adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar
    sidebar breadcrumb breadcrumbs footer contentinfo complementary comment comments commentlist respond disqus cookie cookies consent gdpr
    notice notices popup modal overlay dialog alert share sharing social related recommended newsletter subscribe subscription login signup
    pagination pager masthead toolbar widget widgets copyright skip search hidden""".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none", re.I)


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    heading: bool
    region: int  # the article or main element that it stands in, 0 for none
    outside: bool  # in an element around the page's text
    named: tuple[int, ...] = ()  # the elements around it whose class, id or role is in NAMES
    label: str = ""


def _named(attributes: str) -> bool:
    return any(w in NAMES for m in NAMED.finditer(attributes) for w in "".join(x or "" for x in m.groups()).lower().split())


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Elements that are never closed end with the element around them."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # element, outside, region, named elements
    parts: list[str] = []
    linked, links, heading, regions = 0, 0, False, 0
    outside, region, named, names = False, 0, (), 0
    unclosed: set[str] = set()  # silent elements that no end follows
    held: Counter[str] = Counter()  # open elements by name, so that an end without a start costs nothing

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(linked, len(text)), heading, region, outside, named))
        parts, linked = [], 0

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                text = html.unescape(m[0])
                parts.append(text)
                if links:
                    linked += len(" ".join(text.split()))
            continue
        closing, attributes = m[1] or m[4], (m[3] or m[6] or "")
        if tag in SILENT and not closing:
            if not attributes.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:  # ends with the element around it
                    unclosed.add(tag)
                    flush()
                    outside = True
                    stack.append((tag, True, region, named))
                    held[tag] += 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            if not attributes or closing:
                continue
        if tag in BREAKS:
            flush()
            links = 0
            if closing:
                heading = False
        if tag in VOID:
            continue
        if closing:
            if held[tag]:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)  # all that is passed goes
                if any(x[0] in SILENT for x in stack[k:]):
                    flush()
                held.subtract(x[0] for x in stack[k:])
                del stack[k:]
        else:
            if tag in HEADINGS:
                heading = True
            elif tag in BREAKS:
                heading = False
            if tag in ("p", "li", "tr", "td", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                held[stack.pop()[0]] -= 1
            if tag in ("nav", "article", "main", "footer", "aside", "header", "body") and stack:  # paragraphs and inline marks don't hold these
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "li", "ul", "ol"):
                    held[stack.pop()[0]] -= 1
            outer = stack[-1] if stack else ("", False, 0, ())
            inner = outer[2]
            if tag in ("article", "main") or "articleBody" in attributes:
                regions += 1
                inner = regions
            away = outer[1] or tag in AROUND or (tag == "header" and not outer[2])
            own = outer[3]
            if attributes and tag not in ("body", "html", "article", "main", "a"):
                away = away or bool(HIDDEN.search(attributes))
                if _named(attributes):
                    names += 1
                    own = (*own, names)
            stack.append((tag, away, inner, own))
            held[tag] += 1
        _, outside, region, named = stack[-1] if stack else ("", False, 0, ())
    flush()
    return out


def _nearest(found: list[Block], first: list[str], step: int) -> list[int]:
    """Of each block the next one in a direction that is decided or of another region; a place beyond the ends if there is none."""
    out = [0] * len(found)
    for i in range(len(found))[:: -step]:
        j = i + step
        open_ = 0 <= j < len(found) and found[j].region == found[i].region and first[j] not in ("good", "bad")
        out[i] = out[j] if open_ else j
    return out


def decide(found: list[Block]) -> list[Block]:
    """Labels all blocks good or bad and returns the good ones.

    A name is a vote only: an element that holds half or more of the text which the other rules take for the page's own is no ad or menu."""
    text, held = 0, Counter()
    for b in found:
        words = [w.strip(".,;:!?()\"'«»¿¡").lower() for w in b.text.split()]
        stops = sum(w in STOP_WORDS for w in words) / len(words)
        n = len(b.text)
        if b.outside or b.linked > LINKS * n or (b.text[0] in "©" and not b.region):
            b.label = "bad"
        elif n < SHORT:
            b.label = "short"
        elif stops >= MANY_STOPS and n > LONG:
            b.label = "good"
        elif stops >= FEW_STOPS or b.region:
            b.label = "near"
        else:
            b.label = "bad"
        if b.label in ("good", "near"):
            text += n
            held.update(dict.fromkeys(b.named, n))
    for b in found:
        if any(2 * held[x] < text or not held[x] for x in b.named):
            b.outside, b.label = True, "bad"
    first = [b.label for b in found]
    # Blocks around the page's text part what they stand between only where that isn't an article of its own.
    nearest = [_nearest(found, first, -1), _nearest(found, first, 1)]
    for i, b in enumerate(found):
        if b.label not in ("short", "near"):
            continue
        side = []
        for j in (nearest[0][i], nearest[1][i]):
            inside = 0 <= j < len(found) and found[j].region == b.region and not (b.region and found[j].outside)
            side.append((abs(j - i), first[j]) if inside else (10**9, ""))
        (_, left), (_, right) = side
        if b.heading and right:
            b.label = right
        elif left == right:
            b.label = left or ("good" if b.region or b.label == "near" else "bad")
        elif not left or not right:
            b.label = "good" if b.region and first[i] == "near" else left or right
        elif side[0][0] != side[1][0]:
            b.label = min(side)[1]
        else:
            b.label = "good" if b.region or first[i] == "near" else "bad"
    if not any(b.label == "good" for b in found):  # nothing long enough to decide by: the middling blocks are the text
        for b, label in zip(found, first, strict=True):
            if label == "near" or (label == "short" and not b.linked and not b.outside):
                b.label = "good"
    return [b for b in found if b.label == "good"]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in decide(blocks(page or "")))


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            text = [main_text(x.as_py()) for x in part["html"]]
            yield arrow_batch(EXTRACTED, page_id=part["page_id"], url=part["url"], text=text, n_chars=[len(t) for t in text])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars; one row for each row. Null and empty html
    have the empty text; null ids and urls stay null. The work grows with a page's length, also where elements
    aren't closed or long lists stay undecided."""
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; see extract()."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html": op1_html}
SQL: dict[str, str] = {}
