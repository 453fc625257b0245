"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block. Menus, headers, footers, forms, notices,
adverts, comments and the like leave no line, and link text adds no length. Lengths are summed
over sliding windows of lines; where the sums surge above a share of the page's largest window
a text begins, where they dive to nothing it ends, and the lines between are kept. Lines in an
article or main element are text whatever their length; surge and dive decide on the others,
which need a larger share there.

Unwanted elements end where HTML ends them: at their own end tag, or, where that may be left out
(paragraphs, list items, table cells and rows, terms, options), at the next sibling or the end of
the parent. Those that stand within a line don't cut it. A header in an article is the article's.
Forms go, except where they hold more text than all the rest of the page.

Defined cases: null or empty pages give an empty text; pages may end anywhere and leave tags
open; repeated rows give equal texts; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces

WINDOW = 3
#: A surge needs this share of the page's largest window; beside an article or main element, the second one.
SURGE, SURGE_BESIDE = 0.05, 0.5
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z)""", re.S)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)""", re.I)
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTE = re.compile(r"""(?<![-\w])(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form script style noscript template iframe svg select button textarea menu dialog object canvas head title".split())
NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner sidebar nav navigation navbar menu breadcrumb breadcrumbs footer header masthead cookie cookies consent notice "
                  "popup modal newsletter subscribe social share sharing related recommended recommendations comment comments disqus reply replies widget login signup toolbar pagination pager copyright disclaimer".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
TEXT_ROOTS = frozenset(("article", "main"))
#: Elements that don't end the line they stand in.
IN_LINE = INLINE | frozenset("script style noscript template svg button select textarea iframe object canvas label".split())
#: Elements whose end tag may be left out, and the start tags that end them; any block ends a paragraph.
ENDED_BY = {"p": frozenset(), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")),
            "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "tr": frozenset(("tr", "tbody", "tfoot"))}
SPACES = re.compile(r"\s+")


def unwanted(tag: str, attributes: str, rooted: bool, forms: bool) -> bool:
    if tag in OUTSIDE and not (tag == "header" and rooted) and not (tag == "form" and forms):
        return True
    if not attributes or tag in ("html", "body", *TEXT_ROOTS):
        return False
    if HIDDEN.search(re.sub(r"""("[^"]*"|'[^']*')""", "", attributes)):
        return True
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "").lower()
        if name.lower() == "role":
            if value in ROLES:
                return True
        elif name.lower() == "aria-hidden":
            if value == "true":
                return True
        elif name.lower() == "style":
            if NOT_SHOWN.search(value):
                return True
        elif name.lower() in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if any(p in NAMES and (k == 0 or parts[k - 1] not in ("with", "has", "no")) for k, p in enumerate(parts)):
                    return True
    return False


def ends_open(skip: str, inner: int, closing: str, tag: str) -> bool:
    """Whether a tag ends the open element ``skip`` whose end tag was left out, with ``inner`` elements open in it."""
    if inner or skip not in ENDED_BY or tag == skip and closing:
        return False
    if closing:
        return tag not in IN_LINE and (skip == "p" or tag not in ENDED_BY or skip in ("td", "th") and tag == "tr")
    return tag not in IN_LINE if skip == "p" else tag in ENDED_BY[skip]


def lines(page: str, forms: bool = False) -> tuple[list[str], list[int], list[bool], int]:
    """The text blocks of a page outside unwanted elements, their lengths, whether they are in a text root, and the size of the forms left out."""
    out: list[str] = []
    sizes: list[int] = []
    rooted: list[bool] = []
    text: list[str] = []
    linked = 0
    skip, skip_depth, inner, roots, in_link, in_forms = "", 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        line = SPACES.sub(" ", html.unescape("".join(text))).strip()
        if line:
            out.append(line)
            sizes.append(max(0, len(line) - linked))
            rooted.append(roots > 0)
        text.clear()
        linked = 0

    page = re.sub(r"</?\Z", "", page)  # a page may end in the first signs of a tag
    place, end = 0, len(page)
    while place < end:
        found = TOKEN.search(page, place)
        piece = page[place:found.start()] if found else page[place:]
        if piece and not skip:
            text.append(piece)
            if in_link:
                linked += len(piece)
        elif piece and skip == "form":
            in_forms += len(piece.strip())
        if not found:
            break
        place = found.end()
        closing, tag, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        if skip and ends_open(skip, inner, closing, tag):
            skip = ""
        if skip:
            if tag not in IN_LINE and tag not in VOID and tag not in ENDED_BY and tag != skip:
                inner = max(0, inner + (-1 if closing else 1))
            if skip in ENDED_BY and inner:
                pass
            elif tag == skip and not (not closing and attributes.endswith("/")):
                skip_depth += -1 if closing else 1
                if not skip_depth:
                    skip = ""
        elif not closing and unwanted(tag, attributes, roots > 0, forms):
            if tag not in IN_LINE:
                flush()
            if tag not in VOID and not attributes.endswith("/"):
                skip, skip_depth, inner = tag, 1, 0
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag not in INLINE:
            flush()
            if tag in TEXT_ROOTS:
                roots = max(0, roots - 1) if closing else roots + 1
        if tag in RAW and not closing and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, place)
            place = close.end() if close else end
            if skip == tag:
                skip_depth -= 1
                skip = skip if skip_depth else ""
    flush()
    return out, sizes, rooted, in_forms


def windows(sizes: list[int]) -> list[int]:
    return [sum(sizes[i:i + WINDOW]) for i in range(len(sizes))]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, sizes, rooted, in_forms = lines(page)
    if in_forms > sum(sizes):
        with_forms = lines(page, forms=True)
        if sum(with_forms[1]) > 2 * sum(sizes):
            blocks, sizes, rooted, _ = with_forms
    largest = max(windows(sizes), default=0)
    # lines in a root add nothing to the windows beside it
    total = windows([0 if r else n for n, r in zip(sizes, rooted)])
    level = (SURGE_BESIDE if any(rooted) else SURGE) * largest
    kept: list[str] = []
    inside = False
    for block, n, sums, root in zip(blocks, sizes, total, rooted):
        # surge: the window is over the level and starts with text; dive: a whole window without text
        inside = sums > 0 and (inside or not root and n > 0 and sums >= level)
        if root or inside:
            kept.append(block)
    return "\n".join(kept)


def extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "html", 1 << 20):
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract_rows, "page_id long, url string, text string")
