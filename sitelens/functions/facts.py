"""Facts of a page, read from its HTML in one pass and in time linear in its length."""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import host_of_url, is_skipped_scheme, normalize_url

_FACTS = [
    ("titles", pa.list_(pa.string())), ("descriptions", pa.list_(pa.string())),
    ("canonicals", pa.list_(pa.struct([("href", pa.string()), ("source", pa.string())]))),
    ("robots_meta", pa.list_(pa.struct([("name", pa.string()), ("content", pa.string())]))),
    ("head_anomalies", pa.list_(pa.string())),
    ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))),
    ("links", pa.list_(pa.struct([("url", pa.string()), ("raw_href", pa.string()), ("text", pa.string()), ("folded", pa.string()), ("rel", pa.list_(pa.string())), ("internal", pa.bool_())]))),
    ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string()), ("width", pa.string()), ("height", pa.string()), ("loading", pa.string()), ("in_link", pa.bool_())]))),
    ("json_ld", pa.list_(pa.struct([("types", pa.list_(pa.string())), ("error", pa.string()), ("missing_context", pa.bool_()), ("missing_type", pa.bool_())]))),
    ("subresources", pa.list_(pa.string())), ("has_microdata", pa.bool_()), ("has_rdfa", pa.bool_()), ("lang", pa.string()), ("base", pa.string()),
    ("text_length", pa.int32()), ("render_signals", pa.list_(pa.string())), ("is_shell", pa.bool_()), ("title_folded", pa.string()), ("description_folded", pa.string()), ("title_source", pa.string()),
]
_ARROW = pa.struct(_FACTS)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Bytes of bodies and rows whose facts are in a worker at once.
PIECE_BYTES, PIECE_ROWS = 1_000_000, 1_000
# Elements that end a head, elements that count as content, ids that applications are
# mounted at, names of meta tags with directives for crawlers, and how little text a shell has.
BODY_ONLY = {
    "a", "article", "aside", "audio", "b", "blockquote", "br", "button", "canvas", "div", "dl", "em", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "i", "iframe", "img", "input", "label", "li", "main", "nav", "ol", "p", "picture", "pre", "section", "select", "span", "strong", "table", "textarea", "ul", "video",
}
CONTENT_ELEMENTS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "article", "section", "main", "img", "table", "blockquote"}
MOUNT_IDS = {"root", "app", "__next", "__nuxt", "___gatsby", "svelte", "react-root", "app-root", "application"}
ROBOTS_META = {"robots", "googlebot", "bingbot"}
LITTLE_TEXT = 150
_SUBRESOURCE = {"img": "src", "script": "src", "iframe": "src", "source": "src", "audio": "src", "video": "src", "embed": "src"}
_HEADING = re.compile(r"h[1-6]")


def clean(text: str) -> str:
    return " ".join(text.split())


def read_json_ld(raw: str) -> dict:
    """Types of the block's entities, or why it says nothing."""
    out = {"types": [], "error": None, "missing_context": False, "missing_type": False}
    if not raw.strip():
        return out | {"error": "empty"}
    try:
        data = json.loads(raw)
    except (ValueError, RecursionError) as e:
        return out | {"error": str(e)}
    roots = data if isinstance(data, list) else [data]
    entities = []
    for root in (x for x in roots if isinstance(x, dict)):
        out["missing_context"] |= "@context" not in root
        graph = root.get("@graph")
        if isinstance(graph, list):
            entities += [x for x in graph if isinstance(x, dict)]
        if not isinstance(graph, list) or "@type" in root:
            entities.append(root)
    if not entities:
        return out | {"error": "no objects", "missing_context": False}
    for entity in entities:
        kinds = entity.get("@type")
        out["missing_type"] |= "@type" not in entity
        out["types"] += [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str) and k not in out["types"]]
    return out


class _Reader(HTMLParser):
    """Keeps one list of what the page says, in order; each element of interest is a range of it.

    An entry is a text, None for an element, a tuple with an image's alt text, or a list with the
    parts of a title. Links and headings end at the next one, so that each text is in one of each
    at most and all texts can be read whole in linear time.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list]] = []
        self.count: Counter = Counter()
        self.said: list = []
        self.titles, self.descriptions, self.canonicals, self.robots_meta, self.anomalies = [], [], [], [], {}
        self.headings, self.anchors, self.images, self.blocks, self.resources = [], [], [], [], []
        self.microdata = self.rdfa = self.body_started = False
        self.lang = self.base = None
        self.seen_html = False
        self.text_length = self.scripts = self.content = 0
        self.external_script = False
        self.mounts, self.notices, self.body_children = [], [], []
        self.script: list[str] | None = None
        self.closing = False

    def inside(self, *tags: str) -> bool:
        return any(self.count[t] for t in tags)

    def _next(self, into: list) -> None:
        """The last link or heading ends here if it is open."""
        if into and into[-1][1] is None:
            into[-1][1] = len(self.said)

    def _mark(self, into: list, *more) -> list:
        """[start, end (set on closing), ...]: a range of what is said."""
        mark = [len(self.said), None, *more]
        into.append(mark)
        return mark

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1][0] == "title":  # markup in a title is text
            self.handle_data(self.get_starttag_text() or "")
            return
        a: dict[str, str] = {}
        for k, v in attrs:
            a[k] = v if v is not None else ""
        opaque, marks = self.inside("noscript", "template", "svg"), []
        rel = a.get("rel", "").lower().split()
        self.microdata |= "itemscope" in a
        self.rdfa |= "typeof" in a
        if tag == "html" and not self.seen_html:
            self.seen_html, self.lang = True, a.get("lang")
        elif tag == "base" and self.base is None:
            self.base = a.get("href", "")
        self._placed(tag, a, rel, opaque)
        if tag in _SUBRESOURCE and a.get(_SUBRESOURCE[tag]):
            self.resources.append(a[_SUBRESOURCE[tag]])
        elif tag == "link" and "stylesheet" in rel and a.get("href"):
            self.resources.append(a["href"])
        if tag == "meta" and a.get("name", "").strip().lower() == "description":
            self.descriptions.append(clean(a.get("content", "")))
        if tag == "img" and not self.inside("noscript"):
            self.images.append({c: a.get(c) for c in ("src", "alt", "width", "height", "loading")} | {"in_link": self.inside("a")})
        if tag in CONTENT_ELEMENTS and not opaque:
            self.content += 1
        if tag == "script":
            self.scripts += 1
            self.external_script |= bool(a.get("src")) or a.get("type", "").lower() == "module"
            self.script = [] if a.get("type", "").split(";")[0].strip().lower() == "application/ld+json" else None
        # what is said
        if not self.inside("script", "style", "template"):
            self.said.append((a.get("alt", ""),) if tag == "img" else None)
        if tag == "title" and not self.inside("svg"):
            marks.append(self._mark(self.titles))
        elif _HEADING.fullmatch(tag):
            self._next(self.headings)
            marks.append(self._mark(self.headings, int(tag[1])))
        elif tag == "a" and "href" in a:
            self._next(self.anchors)
            marks.append(self._mark(self.anchors, a["href"], rel, a.get("aria-label", ""), a.get("title", "")))
        elif tag == "noscript":
            marks.append(self._mark(self.notices))
        marker = a.get("id", "").lower()
        marker = f"#{marker}" if marker in MOUNT_IDS else "data-reactroot" if "data-reactroot" in a else "ng-version" if "ng-version" in a else f"<{tag}>" if tag in ("app-root", "ion-app") else None
        if marker:
            marks.append(self._mark(self.mounts, marker))
        if self.open and self.open[-1][0] == "body" and tag not in ("script", "noscript", "style", "link", "template"):
            marks.append(self._mark(self.body_children))
        if tag in _VOID:
            self._ended(marks)
        else:
            self.open.append((tag, marks))
            self.count[tag] += 1

    def _placed(self, tag: str, a: dict[str, str], rel: list[str], opaque: bool) -> None:
        """Canonicals with their place, directives for crawlers, and what ends the head early."""
        if opaque:
            return
        in_head = self.inside("head")
        if tag == "body":
            self.body_started = True
        elif tag in BODY_ONLY:
            if in_head and not self.body_started:
                self.anomalies[f"<{tag}>"] = True
            self.body_started = True
        elif tag == "link" and "canonical" in rel:
            source = "body" if self.inside("body") or self.body_started and not in_head else "head-implicitly-closed" if self.body_started else "head"
            self.canonicals.append({"href": a["href"].strip() if "href" in a else None, "source": source})
        elif tag == "meta" and a.get("name", "").strip().lower() in ROBOTS_META:
            self.robots_meta.append({"name": a["name"].strip().lower(), "content": clean(a.get("content", ""))})

    def _ended(self, marks: list) -> None:
        for mark in marks:
            if mark[1] is None:
                mark[1] = len(self.said)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        if self.open[-1][0] == "title" != tag and not self.closing:
            self.handle_data(f"</{tag}>")
            return
        while True:
            name, marks = self.open.pop()
            self.count[name] -= 1
            self._ended(marks)
            if name == tag:
                break
        if tag == "script" and self.script is not None:
            self.blocks.append(read_json_ld("".join(self.script)))
            self.script = None

    def handle_data(self, data):
        if self.script is not None and self.count["script"]:
            self.script.append(data)
        if self.inside("script", "style", "template"):
            return
        in_title = bool(self.open) and self.open[-1][0] == "title"
        if in_title and self.said and isinstance(self.said[-1], list):
            self.said[-1].append(data)  # what looks like markup in a title is part of its text
        elif in_title:
            self.said.append([data])
        elif not self.inside("svg"):
            self.said.append(data)
        if not self.inside("head", "noscript", "svg", "title"):
            self.text_length += len(clean(data))

    def finished(self) -> None:
        """Index of what was said: where texts are, how many say something, and how many speak of JavaScript."""
        self.said = ["".join(x) if isinstance(x, list) else x for x in self.said]
        self.at = [i for i, x in enumerate(self.said) if isinstance(x, str)]
        texts = [self.said[i] for i in self.at]
        self.saying = list(accumulate((not x.isspace() and x != "" for x in texts), initial=0))
        self.of_scripts = list(accumulate(("javascript" in x.lower() for x in texts), initial=0))

    def _texts(self, mark: list) -> tuple[int, int]:
        return bisect_left(self.at, mark[0]), bisect_left(self.at, mark[1])

    def text(self, mark: list) -> str:
        start, end = self._texts(mark)
        return clean(" ".join(self.said[i] for i in self.at[start:end]))

    def says(self, mark: list, counts: list[int]) -> bool:
        start, end = self._texts(mark)
        return counts[end] > counts[start]

    def name(self, mark: list) -> str:
        """A link's accessible name: its text, aria-label, title or first image's alt."""
        _, _, _, _, label, title = mark
        alts = (clean(x[0]) for x in self.said[mark[0] : mark[1]] if isinstance(x, tuple))
        return self.text(mark) or clean(label) or clean(title) or next((x for x in alts if x), "")

    def signals(self) -> list[str]:
        """What speaks for a document that scripts fill in the browser."""
        found = [f"little-visible-text:{self.text_length}"] if self.text_length < LITTLE_TEXT else []
        if self.external_script and self.scripts >= self.content:
            found.append(f"script-driven:{self.scripts}-scripts")
        if self.content <= 3:
            found.append(f"few-content-elements:{self.content}")
        empty = next((m[2] for m in self.mounts if not self.says(m, self.saying)), None)
        if empty:
            found.append(f"empty-mount-element:{empty}")
        if 0 < len(self.body_children) <= 3 and not any(self.says(m, self.saying) for m in self.body_children):
            found.append(f"empty-body-containers:{len(self.body_children)}")
        if any(self.says(m, self.of_scripts) for m in self.notices):
            found.append("noscript-javascript-notice")
        return found


def is_likely_shell(signals: list[str]) -> bool:
    """Little text, driven by scripts, and one structural sign of it."""
    kinds = {s.split(":")[0] for s in signals}
    return {"little-visible-text", "script-driven"} <= kinds and bool(kinds & {"empty-mount-element", "empty-body-containers", "noscript-javascript-notice"})


def text_charset(name: str | None) -> str | None:
    """The declared charset if there is a text codec of that name."""
    try:
        return codecs.lookup(name).name if name and getattr(codecs.lookup(name), "_is_text_encoding", True) else None
    except (LookupError, ValueError):
        return None


_META_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decoded(body: bytes, charset: str | None = None) -> str:
    """The body as text: byte order mark, then the declared charset, then the page's own, then UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    own = _META_CHARSET.search(body[:2048])
    return body.decode(text_charset(charset) or text_charset(own and own.group(1).decode("ascii")) or "utf-8", "replace")


def title_source(page: str) -> str:
    """What stands between the first <title> and the next </title>, as it is written."""
    start = page.find("<title>") + len("<title>")
    end = page.find("</title>", start)
    return page[start:end] if start >= len("<title>") and end >= 0 else ""


def page_facts(page: str | bytes | None, url: str = "", charset: str | None = None) -> dict:
    """All facts of a page at url; of a null or broken one, those that were found."""
    r, missing, page = _Reader(), page is None, decoded(page, charset) if isinstance(page, bytes) else page or ""
    r.feed(page)
    r.close()
    r.closing = True
    while r.open:
        r.handle_endtag(r.open[-1][0])
    r.finished()
    base = normalize_url(r.base, url) if r.base else None
    base, host = base or url, host_of_url(url)
    links = []
    for mark in r.anchors:
        target = None if is_skipped_scheme(mark[2]) else normalize_url(mark[2], base)
        if target is not None:
            name = r.name(mark)
            links.append({"url": target, "raw_href": mark[2], "text": name, "folded": name.casefold(), "rel": mark[3], "internal": host_of_url(target) == host})
    for image in r.images:
        src = image["src"]
        image["src"] = (normalize_url(src, base) if src else None) or src
    signals, titles, source = r.signals(), [r.text(m) for m in r.titles], title_source(page)
    return {
        "titles": titles, "descriptions": r.descriptions, "canonicals": r.canonicals, "robots_meta": r.robots_meta, "head_anomalies": list(r.anomalies),
        "headings": [{"level": m[2], "text": r.text(m)} for m in r.headings], "links": links, "images": r.images, "json_ld": r.blocks,
        "subresources": list(dict.fromkeys(u for u in (normalize_url(x, base) for x in r.resources) if u)),
        "has_microdata": r.microdata, "has_rdfa": r.rdfa, "lang": r.lang, "base": base, "text_length": r.text_length, "render_signals": signals, "is_shell": is_likely_shell(signals),
        "title_folded": titles[0].casefold() if titles else None, "description_folded": r.descriptions[0].casefold() if r.descriptions else None, "title_source": None if missing else source,
    }


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"struct<{','.join(f'{f.name}:{_ddl(f.type)}' for f in kind)}>"
    return {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int"}[kind]


FACTS_DDL = _ddl(_ARROW)


def pieces(column: pa.Array, most: int):
    """(first row, rows) of pieces of a column of texts or bodies of about `most` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and (total + size > most or i - at >= PIECE_ROWS):
            yield at, i - at
            at, total = i, 0
        total += size
    if len(sizes) > at:
        yield at, len(sizes) - at


def _facts(batches):
    """(key, url, body or html, charset) -> (key, facts)."""
    for batch in batches:
        for at, n in pieces(batch.column(2), PIECE_BYTES):  # facts take many times the room of their page
            piece = batch.slice(at, n)
            rows = zip(*(piece.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            facts = pa.array([page_facts(body, url or "", charset) for url, body, charset in rows], _ARROW)
            yield pa.record_batch([piece.column(0), facts], names=["key", "facts"])


@F.pandas_udf(T.StringType())
def lowered(text: pd.Series) -> pd.Series:
    """Each character in lower case by itself, whatever stands beside it."""
    return text.map(lambda t: "".join(c.lower()[0] for c in t), na_action="ignore")


def with_facts(rows: DataFrame, key: str, url: str, body: str, charset: str | None = None) -> DataFrame:
    """(key, facts) for each row: one Arrow pass, so that a page is parsed once however many checks read it."""
    given = rows.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(body).alias("body"), (F.col(charset) if charset else F.lit(None).cast("string")).alias("charset"))
    return given.mapInArrow(_facts, f"key {dict(rows.dtypes)[key]}, facts {FACTS_DDL}").withColumnRenamed("key", key)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url and the facts of each row of pages (page_id, url, html)."""
    rows = pages.select(F.struct("page_id", "url").alias("key"), "url", "html")
    return with_facts(rows, "key", "url", "html").select("key.*", "facts.*")
