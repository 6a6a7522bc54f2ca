"""Operator 12, HTML extraction: line-block distribution.

Markup is stripped to lines, one for each text block, in page order. Blocks begin and end at
block elements; inline elements and comments leave no trace, `br` counts as white space.
Lines of elements that are no running text (scripts, styles, menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) count no characters and stand for
blank lines, as do the borders of containers. Block i of the distribution is the sum of the
lengths of lines i to i + WINDOW - 1. A stretch surges where a block, after blank lines,
passes the threshold, and dives where the following blocks come to nothing; the text
between the two is kept, all of its lines with text.

Threshold: where the page marks its article (an `article` element or its role or property,
else `main`, else a container named for its content), lines outside count nothing and any
text surges. On other pages a block needs SURGE characters; if none has them, the
stretches with the highest block are kept, so short pages aren't lost.

On unmarked pages lines that are mostly links, as of menus, count nothing either.

The distribution of a batch of pages is computed at once, as arrays, with blank lines
between the pages.

Known by element, role or by a word of class or id; FIXED values below. An article's own
header keeps its headings. Names of the form
has-…, with-… and no-… say nothing about the element itself. A page of which nothing is
left is read again without the words of class and id.

Defined results: a null or empty page has no blocks. Pages may end anywhere; an unclosed
tag at the end is left out, unclosed elements end with their parents. Character references
are decoded once. Long pages are read whole in linear time. Repeated rows are each
returned, an empty table gives an empty result, other columns go through untouched.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import table

#: Lines summed in a block, and the characters with which a block of an unmarked page surges.
WINDOW, SURGE = 3, 86

# Element names of the HTML standard, and words that name parts of a page.
INLINE = frozenset(
    "a abbr acronym b basefont bdi bdo big blink cite code data del dfn em font i img input ins kbd label map mark meter nobr output picture progress q rb rp rt rtc ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
CONTAINER = frozenset("address article aside body center details dialog div dl fieldset footer form header main nav ol section table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
SKIPPED = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head header legend map math menu nav object optgroup option select svg video".split()) | RAW
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
SKIPPED_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus footer foot gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification notifications outbrain pager pagination paywall popup promo promoted promotion recommendations recommended related replies reply respond sharing share shares sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar trending widget".split()
)
CONTENT_NAMES = frozenset("article articlebody articlecontent articletext content entry entrycontent maincontent maintext postbody postcontent posttext story storybody".split())
STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "masthead", "navbar", "newsletter", "sidebar", "sponsor", "subscri")
WRITING = frozenset("commentary commentaries".split())
PREFIXES = frozenset("has with no without is show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"  # comments, to the end if unclosed
    r"|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|\Z)", re.I)
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I) for name in RAW}
CUT = re.compile("<[a-zA-Z/!?]")
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)}


def names_of(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each name in class and id."""
    return [[w.lower() for w in WORD.findall(n)] for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]


def skipped(name: str, attrs: dict[str, str], by_names: bool) -> bool:
    """Whether an element is no running text."""
    if name in SKIPPED or attrs.get("role", "").lower() in SKIPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if not by_names or name in HEADINGS or name in ("html", "body", "main"):
        return False
    return any(words and words[0] not in PREFIXES and any(out_of_text(w) for w in words) for words in names_of(attrs))


def out_of_text(word: str) -> bool:
    return word in SKIPPED_NAMES or (word.startswith(STEMS) and word not in WRITING)


def heads(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element is a header, by itself or by its name alone."""
    return name == "header" or (name in CONTAINER and name not in SKIPPED and {w for words in names_of(attrs) for w in words if out_of_text(w)} == {"header"})


def mark_of(name: str, attrs: dict[str, str]) -> int:
    """3 for an article, 2 for the main part, 1 for a container named for its content, else 0."""
    if name == "article" or attrs.get("role", "").lower() == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        return 3
    if name == "main" or attrs.get("role", "").lower() == "main":
        return 2
    return int(name in CONTAINER and any("".join(words) in CONTENT_NAMES for words in names_of(attrs)))


def lines_of(page: str, by_names: bool = True) -> list[tuple[str, int, bool]]:
    """The page's lines, blank ones included: (text, highest mark around it, whether most of it are links)."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, int, bool]] = []  # (element, skipped elements around it, mark around it, whether it is an article's own header)
    pending: list[str] = []
    out = mark = linked = 0

    def end_line(blanks: int = 0) -> None:
        nonlocal linked
        raw = "".join(pending)
        if text := " ".join(references.unescape(raw).split()):
            lines.append((text, mark, 2 * linked > len(raw)))
        pending.clear()
        linked = 0
        lines.extend([("", 0, False)] * blanks)

    opened: Counter[str] = Counter()
    last = page.rfind(">")
    whole = cut.start() if (cut := CUT.search(page, last + 1)) else len(page)  # a tag that the page's end cuts is none
    at = 0
    while at < whole:
        m = TOKEN.match(page, at, whole)
        at = m.end()
        if m["text"] is not None:
            if not out and not (stack and stack[-1][3]):
                pending.append(m["text"])
                linked += len(m["text"]) if opened["a"] else 0
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            depth = len(stack) - 1
            if not opened[name]:
                depth = -1
            elif name in INLINE:
                while depth >= 0 and stack[depth][0] != name and stack[depth][0] in INLINE:
                    depth -= 1  # an inline element closes nothing beyond its block
            else:
                while stack[depth][0] != name:
                    depth -= 1
            if depth < 0 or stack[depth][0] != name:
                if name not in INLINE and not out:
                    end_line()  # a stray end tag, as of a paragraph
                continue
            hid = out > stack[depth][1]
            if name not in INLINE or hid:
                end_line(WINDOW if hid and not stack[depth][1] else name in CONTAINER)
            _, out, mark, _ = stack[depth]
            opened.subtract(x[0] for x in stack[depth:])
            del stack[depth:]
            continue
        if name in RAW:  # its content is no markup
            ended = RAW_END[name].search(page, at, whole)
            at = ended.end() if ended else whole
        elif name == "br":
            if not out:
                pending.append(" ")
        elif name not in VOID:
            attrs = attributes(m["attrs"])
            hide = skipped(name, attrs, by_names)
            own_header = hide and mark == 3 and heads(name, attrs)
            hide = hide and not own_header
            if mark == 3 and stack and stack[-1][3] and name not in HEADINGS:
                hide, own_header = not (own_header or name == "div"), True  # of an article's own header only headings are text
            if name not in INLINE or hide:
                end_line(WINDOW if hide and not out else name in CONTAINER)
            stack.append((name, out, mark, own_header))
            opened[name] += 1
            out += hide
            mark = mark if out else max(mark, mark_of(name, attrs))
    end_line()
    return lines


def between(lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which lines stand between a surge and a dive, of lines with these lengths and the thresholds of their pages."""
    n = len(lengths)
    padded = np.concatenate((lengths, np.zeros(WINDOW - 1, np.int64)))
    blocks = sum(padded[i : i + n] for i in range(WINDOW))
    surging = (blocks >= least) & (lengths > 0)
    flips = np.flatnonzero(np.diff(np.concatenate(([0], blocks > 0, [0])))).tolist()
    keep = np.zeros(n, bool)
    for a, b in zip(flips[::2], flips[1::2]):  # blocks that don't come to nothing
        if (first := np.flatnonzero(surging[a:b])).size:
            keep[a + first[0] : b] = True
    return keep


def distribution(pages: list[list[tuple[str, int, bool]]]) -> list[list[str]]:
    """The lines of each page that its line-block distribution keeps."""
    lines, lengths, least = [], [], []
    for page in pages:
        top = max((mark for _, mark, _ in page), default=0)
        sizes = [len(text) if mark == top and (top or not linked) else 0 for text, mark, linked in page]
        most = max((sum(sizes[i : i + WINDOW]) for i in range(len(sizes))), default=0)
        lines += [text if mark == top else "" for text, mark, _ in page] + [""] * WINDOW
        lengths += sizes + [0] * WINDOW
        least += [1 if top else max(1, min(SURGE, most))] * (len(page) + WINDOW)
    keep = between(np.array(lengths, np.int64), np.array(least, np.int64)).tolist()
    out, at = [], 0
    for page in pages:
        out.append([x for x, k in zip(lines[at : at + len(page)], keep[at : at + len(page)]) if k and x])
        at += len(page) + WINDOW
    return out


def main_blocks(pages: pd.Series) -> pd.Series:
    """The main text of each page as a list of blocks."""
    texts = [p or "" for p in pages]
    found = distribution([lines_of(p) for p in texts])
    empty = [i for i, p in enumerate(texts) if p and not found[i]]
    for i, again in zip(empty, distribution([lines_of(texts[i], by_names=False) for i in empty])):
        found[i] = again
    return pd.Series(found)


def extract(pages: DataFrame, html: str = "html", blocks: str = "blocks") -> DataFrame:
    """The rows with the column `blocks`: the main text of each page, block by block."""
    return pages.withColumn(blocks, F.pandas_udf(main_blocks, "array<string>")(F.col(f"`{html}`")))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.array_join("blocks", " ")
    return pages.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


#: The pages of the tables mark their article and have no other part inside it, so that there SQL can cut it out.
_SPACES = "\\\\s\\\\x0B\\\\x1C-\\\\x1F\\\\x{85}\\\\x{A0}\\\\x{1680}\\\\x{2000}-\\\\x{200A}\\\\x{2028}\\\\x{2029}\\\\x{202F}\\\\x{205F}\\\\x{3000}".replace("\\\\", "\\")
ORACLE_SQL = f"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
stripped AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h[1-6]|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS body FROM articles),
decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS body FROM stripped),
spaced AS (SELECT page_id, url, trim(regexp_replace(body, '[{_SPACES}]+', ' ', 'g'), ' ') AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM spaced
"""
