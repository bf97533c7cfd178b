"""Main text of web pages by the distribution of text over lines.

Markup is stripped: a page becomes lines, one for each block-level element's own text. Scripts, styles, forms and the elements for menus,
headers, footers and asides are stripped with it. Elements that say by class, id or role that they are such a thing, a notice, an
advert or comments are doubted: what they say holds unless they hold more than half of the page's text that isn't in links (comments: more than
0.8), for then they are the layout around the article, as ``has-sidebar`` or ``widget`` often is, and what is in them is judged by
itself. Where a stripped element stood outside the article an empty line stays. Lines that are mostly links count as empty.

Text lengths are summed over windows of three lines. A surge is where the window's sum rises from nothing, a dive where
it falls to nothing again. Text between a surge and its dive is kept if some window in it reaches a share of the page's
highest, so that a lone line far from the body goes, and a short heading or last paragraph next to it stays.

<article> and <main> are a hint: text inside and text outside are never of one surge, and the side without the highest
window needs half of it. Inside, where the highest is there, lines of links are text as well.

Defined cases: a null page is empty, and an empty page has an empty text; elements left open end with the page or with the
element around them; pages of any length are read whole, in one pass; if the highest windows inside and outside an article are
equal, inside wins; repeated rows stay repeated; null ids and urls stay; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.llm.workers import tidy

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([a-zA-Z_:-]+)""")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"}
FOREIGN = {"svg", "math"}  # these may close themselves
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "head"}
BLOCK = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"side-?bar|nav\w*|menus?|breadcrumbs?|foot(?:er)?|site-header|page-header|masthead|topbar|comments?|disqus|repl(?:y|ies)|"
    r"shar(?:e|ing)|social|related|recommend\w*|newsletter|subscri\w+|sign-?up|login|widget|toolbar|pagination|copyright|legal)(?:$|[\s_-])",
    re.I,
)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies))(?:$|[\s_-])", re.I)
INLINE = set("a abbr b cite code em font i label mark s small span strong sub sup u".split())
WINDOW, SHARE, OTHER = 3, 0.05, 0.5
LAYOUT, ALL_REMARKS = 0.5, 0.8


def _doubted(name: str, attributes: str) -> float:
    """The share of the page's text from which on what the element says of itself isn't believed; 0: it says nothing."""
    if not attributes.strip() or name in MAIN or name in ("body", "html"):
        return 0.0
    for key, value, bare in ATTRIBUTE.findall(attributes):
        key, value = (key or bare).lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 1.0
        if key in ("class", "id") and NAMED.search(value) or key == "role" and value.lower() in ROLES:
            return ALL_REMARKS if REMARKS.search(value) else LAYOUT
    return 0.0


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters of it in links, in the article) of each line; ("", 0, False) where something was stripped."""
    lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
    shares: list[float] = []  # of the doubted elements, by number
    doubted: list[list] = []  # those that are open, the outer first: tag, how many of that tag are open since, number
    own: list[str] = []
    linked, in_link, depth, at = 0, 0, 0, 0

    def close() -> None:
        nonlocal own, linked
        if own and (text := " ".join(unescape("".join(own)).split())):
            lines.append((text, linked, depth > 0, tuple(d[2] for d in doubted)))
        own, linked = [], 0

    end, skip, nested = len(page), "", 0
    while at < end:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not skip:
            own.append(piece)
            linked += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, single = bool(m[1]), name in VOID or m[3].endswith("/")
        if name in RAW and not closing:  # a slash at the end says nothing here, unless no end tag follows
            stop = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at) if not single or name not in FOREIGN else None
            at = stop.end() if stop else at if single else end
            continue
        if skip:
            if name in MAIN and not closing and skip not in MAIN and depth == 0:
                skip = ""  # an element was left open: the article isn't part of it
            else:
                if name == skip and not single:
                    nested += -1 if closing else 1
                if closing and (name == skip and nested == 0 or name in ("body", "html") or depth and name in MAIN):
                    skip = ""
                if skip or name not in MAIN:
                    continue
        if doubted and not single:
            if closing and name in ("body", "html") or name in MAIN and depth == 0 and not closing:
                close()
                doubted = []  # what was left open ends; an article is no part of what stands around it
            elif closing and name in MAIN:
                close()
                doubted = [d for d in doubted if d[3] < depth]
            for i, d in enumerate(doubted):
                d[1] += (-1 if closing else 1) if d[0] == name else 0
                if not d[1]:
                    close()
                    doubted = doubted[:i]
                    break
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            own.append(" ")
        elif name in BLOCK:
            close()
            if name in MAIN:
                depth = max(0, depth + (-1 if closing else 1))
        if closing or single:
            continue
        share = _doubted(name, m[3])
        if name in ASIDE or share and name in INLINE:
            if name not in INLINE:
                close()
            skip, nested = name, 1
            if depth == 0 and name not in INLINE:
                lines.append(("", 0, False, ()))
        elif share:
            close()
            if depth == 0:
                lines.append(("", 0, False, ()))
            doubted.append([name, 1, len(shares), depth])
            shares.append(share)
    close()
    return _believed(lines, shares)


def _believed(lines: list[tuple[str, int, bool, tuple[int, ...]]], shares: list[float]) -> list[tuple[str, int, bool]]:
    """Without the lines of doubted elements, but for those that hold so much of the text that they can't be what they say."""
    held = [0] * len(shares)
    total = 0
    for text, linked, _, inside in lines:
        total += len(text) - linked
        for d in inside:
            held[d] += len(text) - linked
    gone = {d for d, share in enumerate(shares) if held[d] <= share * total}
    return [(text, linked, article) for text, linked, article, inside in lines if gone.isdisjoint(inside)]


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    sides = [inside for _, _, inside in lines]
    size = [0 if 2 * linked > len(text) else len(text) for text, linked, _ in lines]

    def windows() -> list[int]:
        return [sum(size[j] for j in range(i, min(i + WINDOW, len(size))) if sides[j] == sides[i]) if n else 0 for i, n in enumerate(size)]

    window = windows()
    within, without = (max((w for w, inside in zip(window, sides, strict=True) if inside == side), default=0) for side in (True, False))
    best = any(sides) and within >= without
    if best:
        size = [len(text) if inside else n for n, (text, _, inside) in zip(size, lines, strict=True)]
        window = windows()
    highest = max((w for w, inside in zip(window, sides, strict=True) if inside == best), default=0)
    kept: list[str] = []
    at = 0
    while at < len(size):
        if not size[at]:
            at += 1
            continue
        dive = at
        while dive < len(size) and size[dive] and sides[dive] == sides[at]:
            dive += 1
        if max(window[at:dive]) >= (SHARE if sides[at] == best else OTHER) * highest:
            kept += [lines[i][0] for i in range(at, dive)]
        at = dive
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
