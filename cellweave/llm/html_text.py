"""Main text of web pages by the distribution of text over line blocks.

1. A tokenizer walks the markup once. Elements that never hold article text (scripts, styles, menus, headers,
   footers, sidebars, forms, ...) and elements whose class, id or role names such a part (advert, notice, cookie
   banner, comments, ...) are left out with all they contain. Every block element starts a new line; a line knows
   its text, the share of it inside links, and whether it stands inside an article or main element.
2. Text lengths are summed over sliding windows of lines, link text not counted. A surge point is a line at which
   the window sum rises to the threshold and stays there; the dive point is where it falls back. The lines from
   surge to dive are kept. If the page marks an article (article, main, role=main, itemprop=articleBody), a line
   inside it that isn't link text weighs a window's share of the threshold more: a window of short paragraphs there
   is text, not menu. Lines outside it take part by their own length; windows don't cross the article's border.
3. Character references are decoded, white space inside a line becomes one space, lines are trimmed and joined in
   page order by one space.

A page is read in time linear in its length, whatever it holds.

Defined results: a null or empty page gives an empty text; unclosed elements end with their parent; a page without
any line above the threshold gives its longest window's lines, so short pages keep their text. Pages are taken
one by one, so repeated rows give equal rows. Nothing is cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import table, text_or_empty

# fixed values: element names of the HTML standard by their part in a page
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template head title nav header footer aside form button select textarea iframe object svg canvas dialog menu xmp noembed noframes audio video map datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# which open elements an opening tag ends
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
# elements at which an implied end stops
SCOPE = frozenset("article main section div ul ol dl table blockquote body html td th nav aside header footer form".split())
# words of a class, id or role that name a part that is not the article
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner sponsor sponsored promo promotion comment comments reply replies respond discussion disqus sidebar menu navbar nav navigation breadcrumb breadcrumbs "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login footer header masthead share sharing social related recommended widget widgets pagination pager toolbar skip toc search alert "
    "complementary contentinfo alertdialog dialog".split()
)
# possessive, and with a way on from every character: a tag is read once, and a quote that never ends is an ordinary character
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
# those of them that also count on an article element, where others are mere styling
ASIDES = frozenset("ad ads advert advertisement sponsored promo promotion comment comments reply replies respond related recommended widget".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")
SPACE = re.compile(r"\s+")
RAW_ENDS = {name: re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I) for name in RAW}
IN_SCOPE = "*"  # the group of the elements of SCOPE


def groups(name: str) -> tuple[str, ...]:
    return (name, IN_SCOPE) if name in SCOPE else (name,)



@dataclass(frozen=True)
class Params:
    window: int = 3
    #: a surge needs so many characters in a window
    threshold: int = 120
    #: a line of which this share is link text has no weight
    link_share: float = 0.8


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text.strip() else {}


def _is_part(found: dict[str, str], parts: frozenset[str]) -> bool:
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    names = {w for k in ("class", "id", "role") for w in NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found.get(k, "")).lower())}
    return not names.isdisjoint(parts)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, inside a marked article) of each line outside the left-out parts."""
    lines: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    linked = 0
    open_: list[tuple[str, bool, bool]] = []  # name, left out, marks an article
    places: dict[str, list[int]] = {}  # of the open elements, by name and by group
    out = links = marked = 0
    at = 0

    def innermost(names: Iterable[str]) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def end_line() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(buffer))).strip(" ")
        if text:
            lines.append((text, min(linked, len(text)), marked > 0))
        buffer.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal out, links, marked
        while len(open_) > k:
            name, left_out, marks = open_.pop()
            for group in groups(name):
                places[group].pop()
            if name in BLOCK and not out:
                end_line()
            out -= left_out
            links -= name == "a"
            marked -= marks

    while at < len(page):
        m = TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not out:
            buffer.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        if m[1] is not None and not out:
            buffer.append(html.escape(m[1], quote=False))
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            k = innermost([name])
            # an inline element isn't ended from within an article that it holds
            if k >= 0 and (name in BLOCK or k >= innermost(("article", "main", "body"))):
                close(k)
            continue
        if name in BLOCK and name != "br":
            k = innermost({"p", *ENDS.get(name, ())})
            # an element that is in scope itself ends its like
            if k >= 0 and k >= innermost([IN_SCOPE]):
                close(k)
        if name in BLOCK and not out:
            end_line()
        if name in VOID:
            continue
        found = _attributes(m[4])
        in_article_header = name == "header" and marked > 0
        left_out = (name in SKIP and not in_article_header) or (name not in ("html", "body") and _is_part(found, ASIDES if name in ("article", "main") else PARTS))
        marks = not left_out and (name in ("article", "main") or found.get("role", "").lower() == "main" or "articlebody" in found.get("itemprop", "").lower())
        if name in RAW:
            end = RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[4].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        for group in groups(name):
            places.setdefault(group, []).append(len(open_))
        open_.append((name, left_out, marks))
        out += left_out
        links += name == "a"
        marked += marks
    out = 0
    end_line()
    return lines


def window_sums(weights: np.ndarray, params: Params) -> np.ndarray:
    """The weight of each line and the next window - 1."""
    return np.convolve(weights, np.ones(params.window))[params.window - 1 :][: len(weights)]


def surge_and_dive(weights: np.ndarray, params: Params, least: float | None = None) -> np.ndarray:
    """Which lines lie between a surge and its dive of the window sums; least: the sum that is a surge."""
    n, w = len(weights), params.window
    sums = window_sums(weights, params)
    above = sums >= (min(params.threshold, sums.max()) if least is None else least)
    keep = np.zeros(n, bool)
    i = 0
    while i < n:
        if not above[i]:
            i += 1
            continue
        start = i
        while start < n - 1 and weights[start] == 0:
            start += 1  # the window looks ahead: text begins at its first line with text
        while i < n and above[i]:
            i += 1
        # dive: the last line with text that a window above the threshold reaches
        end = min(i - 1 + w - 1, n - 1)
        while end > start and weights[end] == 0:
            end -= 1
        keep[start : end + 1] = True
    return keep


def main_text(page: str, params: Params = Params()) -> str:
    lines = lines_of(page)
    if not lines:
        return ""
    weights = np.array([0 if linked >= params.link_share * len(text) else len(text) - linked for text, linked, _ in lines], float)
    if weights.max() <= 0:
        return ""
    marked = np.array([x[2] for x in lines])
    weights[marked & (weights > 0)] += params.threshold / params.window
    parts = np.split(weights, np.flatnonzero(marked[1:] != marked[:-1]) + 1)
    least = min(params.threshold, max(window_sums(x, params).max() for x in parts))
    keep = np.concatenate([surge_and_dive(x, params, least) for x in parts])
    return " ".join(text for (text, *_), k in zip(lines, keep) if k)


def extract(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, params) for p in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
