"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block-level element; a line inside a container that
holds no article text by its name (nav, header, footer, aside, form, a class or id that says
sidebar, advert, cookie notice, comments ...) is muted: it stays in the sequence of lines, with no
length. Line lengths are summed over a sliding window. The text surges where a window's sum rises
from nothing and dives where it falls back to nothing; what lies before the first surge, past the
last dive or between a dive and the next surge goes, everything else that is not muted is kept,
short lines and a link or two between paragraphs too. Lines that are mostly links have no length,
so that a window falls to nothing on lists of links (menus) and never on other text.
Where the densest window lies in an article or main, only lines of the page's articles are kept,
and lists of links in an article with any other text count as text; an article of nothing but
links is a teaser. Else the search takes the whole page. Reading a page takes time linear in its length, however
broken its markup is.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, text_pieces

WINDOW = 3
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
_RUN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is no text of the page.
_SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "button", "datalist", "title", "audio", "video", "map"}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
_BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
_CONTAINERS = {"div", "section", "article", "main", "body", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "blockquote", "figure", "details", "center", "html"} | _BOILER
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "caption", "pre", "address", "figcaption", "summary", "hr", "legend", "hgroup", "option", "td", "th", "search"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of a class, an id or a role that name containers without article text.
_BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation navigator newsletter notice notification pager pagination popup promo promoted promotion "
    "recommended related replies respond search share sharing sidebar sidemenu signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar tracking widget widgets "
    "complementary contentinfo dialog alert alertdialog".split()
)
_CLOSERS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _SILENT}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named_boiler(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the attributes say that it holds no article text; inside an article, a header holds its title."""
    for name, a, b, c in _NAMES.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
            if tag == "header" and inside:
                continue
            if any(w in _BOILER_WORDS and not (inside and w == "header") for w in _SPLIT.split(_CAMEL.sub(" ", value).lower())):
                return True
        if name in ("class", "id") and tag == "article" and re.search(r"\bcomment", value, re.I):
            return True
    return False


@dataclass
class Line:
    text: str
    length: int
    #: Whether its characters are mostly those of links.
    links: bool
    #: Number of the article or main around it, 0 outside.
    article: int


class _Lines:
    """The lines of a page as they are read."""

    def __init__(self):
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = self.articles = 0

    def flush(self, article: int) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, len(text), self.linked > 0.6 * len(text) and len(text) < 120, article))
        self.parts, self.linked = [], 0

    def muted(self) -> None:
        """A line without length, where the one before has some."""
        if self.lines and self.lines[-1].length:
            self.lines.append(Line("", 0, False, 0))


class _Markup:
    """Finds the tags of a page in linear time."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        #: quotes from which no tag end can be reached, and elements that are closed no more
        self.dead: set[int] = set()
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Where the tag that is open at `at` ends: the next > outside quotes, else the next >, else -1."""
        page, start, opened = self.page, at, []
        if at > self.last:
            return -1
        while True:
            at = _RUN.match(page, at).end()
            if at < len(page) and page[at] == ">":
                return at
            close = page.find(page[at], at + 1) if at < len(page) and at not in self.dead else -1
            opened.append(at)
            if close < 0:
                self.dead.update(opened)
                return page.find(">", start)
            at = close + 1

    def next(self, at: int) -> tuple[int, int, str, str, bool]:
        """(start, end, tag, attributes, closing) of the next markup from `at`; tag is empty for comments and the like, start the page's length for none."""
        page, size = self.page, len(self.page)
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= size:
                return size, size, "", "", False
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else size, "", "", False
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                return start, end + 3 if end >= 0 else size, "", "", False
            if page[start + 1] in "!?":
                end = page.find(">", start)
                return start, end + 1 if end >= 0 else size, "", "", False
            named = _TAG.match(page, start)
            if named:
                end = self.tag_end(named.end())
                if end >= 0:
                    return start, end + 1, named.group(1).lower(), page[named.end() : end], page[start + 1] == "/"
                if page.find("<", start + 1) < 0:  # an unfinished tag at the end of the page
                    return start, size, "", "", False
            at = start + 1

    def element_end(self, tag: str, at: int) -> int:
        """Where the element that starts before `at` is closed, or -1."""
        if tag not in self.unclosed:
            found = _CLOSERS[tag].search(self.page, at)
            if found:
                return found.end()
            self.unclosed.add(tag)
        return -1


def _to_lines(page: str) -> list[Line]:
    out, markup, size = _Lines(), _Markup(page), len(page)
    #: open containers: tag, whether it mutes its content, number of the article around
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    open_tags: Counter = Counter()
    at = links = 0
    while at < size:
        stop, end, tag, attributes, closing = markup.next(at)
        if stop > at:
            text = html.unescape(page[at:stop])
            if not stack[-1][1]:
                out.parts.append(text)
                if links:
                    out.linked += len(text.strip())
            elif not text.isspace():
                out.muted()
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = max(links - 1, 0)
            if tag in _BLOCKS:
                out.flush(stack[-1][2])
            if open_tags[tag]:
                while True:
                    gone = stack.pop()[0]
                    open_tags[gone] -= 1
                    if gone == tag:
                        break
                links = 0 if tag in _CONTAINERS else links
            continue
        if tag in _SILENT:
            if attributes.rstrip().endswith("/") and tag not in _RAW:
                continue
            end = markup.element_end(tag, at)
            at = end if end >= 0 else size if tag in _RAW else at
            continue
        if tag == "br":
            out.parts.append(" ")
            continue
        if tag in ("td", "th"):
            out.parts.append(" ")
        elif tag in _BLOCKS:
            out.flush(stack[-1][2])
            links = 0
        if tag == "a":
            links += 1
        _, mute, article = stack[-1]
        named = tag not in _VOID and attributes and _named_boiler(tag, attributes, bool(article))
        if tag in _CONTAINERS or named:
            if tag in ("article", "main") and not mute and not named and not article:
                out.articles += 1
                article = out.articles
            muted = mute
            # a header inside an article carries its title
            mute = bool(mute or named or tag in _BOILER and not (tag == "header" and article))
            if tag in ("body", "html"):
                mute = False
            if not muted and mute:
                out.flush(stack[-1][2])
            stack.append((tag, mute, article))
            open_tags[tag] += 1
    if not stack[-1][1]:
        out.flush(stack[-1][2])
    return out.lines


def window_sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    """For each line, the characters of the `window` lines around it."""
    total = [0, *itertools.accumulate(lengths)]
    n, half = len(lengths), window // 2
    return [total[min(i + half + 1, n)] - total[max(i - half, 0)] for i in range(n)]


def text_runs(lengths: list[int]) -> list[tuple[int, int]]:
    """From each surge, where the window rises from nothing, to the dive where it next falls back: first line with length and the line past the last."""
    sums, runs = window_sums(lengths), []
    for full, run in itertools.groupby(range(len(sums)), lambda i: sums[i] > 0):
        if full:
            # a window rises before its lines do, and falls after them
            inside = [i for i in run if lengths[i]]
            runs.append((inside[0], inside[-1] + 1))
    return runs


def surge_and_dive(lengths: list[int]) -> tuple[int, int]:
    """The first line whose window rises from nothing and the line past the last before it falls back; (0, 0) for none."""
    runs = text_runs(lengths)
    return (runs[0][0], runs[-1][1]) if runs else (0, 0)


def main_blocks(page: str) -> list[str]:
    """The blocks of the article, in page order."""
    lines = _to_lines(page)
    lengths = [0 if x.links and not x.article else x.length for x in lines]
    sums = window_sums(lengths)
    if any(sums) and lines[max(range(len(lines)), key=lambda i: (sums[i], lengths[i], -i))].article:
        # teasers, articles of nothing but links, have no length, as little as what lies outside the articles
        told = {x.article for x in lines if x.article and not x.links} or {x.article for x in lines}
        lengths = [x.length if x.article and x.article in told else 0 for x in lines]
        lines = [x if x.article else Line("", 0, False, 0) for x in lines]
    surge, dive = surge_and_dive(lengths)
    lines = lines[surge:dive]
    # where the window falls to nothing in between, there is a list of links
    return [x.text for first, last in text_runs(lengths[surge:dive]) for x in lines[first:last] if x.length]


def main_text(page: str) -> str:
    return "\n\n".join(main_blocks(page))


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.decode("utf-8", "replace")) for _, some in text_pieces(batch.column(2)) for x in some]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html, ...).

    A null or empty html, or one without text, gives an empty text. Broken markup is read as far
    as it goes: unclosed elements end with the page. White space within a block, <br> included,
    becomes one space; the cells of a table row are one block. Repeated rows give repeated rows,
    an empty table none; other columns are ignored. No shuffle; memory: a batch of pages.
    """
    return pick(pages, "page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
