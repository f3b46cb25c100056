"""Sitemap documents: XML lists, indexes and plain lists of addresses."""

from __future__ import annotations

import zlib
from xml.parsers import expat

from .urls import host_of_url, normalize_url

# Limits of a sitemap.
MAX_BYTES, MAX_DEPTH = 50 * 1024 * 1024, 32


class SitemapError(ValueError):
    def __init__(self, message: str, html: bool = False):
        super().__init__(message)
        self.html = html


class _Entries:
    """Collects the first loc directly inside each entry of the root; nothing else is kept."""

    def __init__(self):
        self.path: list[str] = []
        self.kind = self.loc = None
        self.locs: list[str] = []
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.text
        self.parser.StartDoctypeDeclHandler = self.parser.EntityDeclHandler = self.parser.ExternalEntityRefHandler = self.unsafe

    def unsafe(self, *_):
        raise SitemapError("declares a document type or entities")

    def start(self, name, _):
        name = name.rpartition("}")[2]
        self.path.append(name)
        if len(self.path) > MAX_DEPTH:
            raise SitemapError(f"nested deeper than {MAX_DEPTH} levels")
        if len(self.path) == 1:
            if name not in ("urlset", "sitemapindex"):
                raise SitemapError(f"root element is {name[:40]}", name == "html")
            self.kind = name
        elif len(self.path) == 2:
            self.loc, self.done = None, False
        elif self.at_loc() and self.loc is None:
            self.loc = ""

    def at_loc(self) -> bool:
        return len(self.path) == 3 and self.path[1] == ("url" if self.kind == "urlset" else "sitemap") and self.path[2] == "loc"

    def text(self, data):
        if self.at_loc() and not self.done:
            self.loc += data

    def end(self, _):
        if self.at_loc():
            self.done = True
        elif len(self.path) == 2 and self.loc is not None:
            self.locs.append(self.loc.strip())
        self.path.pop()


def parse_sitemap(body: bytes, content_type: str | None = None, most: int = MAX_BYTES) -> tuple[str, list[str]]:
    """(kind, addresses as written) of a sitemap; kind is urlset, sitemapindex or text."""
    if body.startswith(b"\x1f\x8b"):
        reader = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            body = reader.decompress(body, most)
        except zlib.error as e:
            raise SitemapError("broken gzip data") from e
        if reader.unconsumed_tail:
            raise SitemapError(f"larger than {most} bytes")
    body = body.lstrip(b"\xef\xbb\xbf \t\r\n")
    start = body[:64].lower()
    if not body:
        raise SitemapError("empty")
    if content_type == "text/html" or start.startswith((b"<!doctype html", b"<html")):
        raise SitemapError("an HTML page", True)
    if not body.startswith(b"<"):
        if content_type != "text/plain" and not start.startswith(b"http"):
            raise SitemapError("neither XML nor a list of addresses")
        return "text", [x.strip() for x in body.decode("utf-8", "replace").splitlines() if x.strip()]
    entries = _Entries()
    try:
        entries.parser.Parse(body, True)
    except expat.ExpatError as e:
        raise SitemapError(f"invalid XML: {e}") from e
    return entries.kind, entries.locs


def read_sitemap(body: bytes, url: str, content_type: str | None = None) -> dict:
    """A sitemap file's addresses: valid ones once, invalid, repeated, and those on another host."""
    out = {"kind": None, "locs": [], "invalid": [], "duplicates": [], "cross_host": [], "parse_error": None, "html": False}
    try:
        kind, locs = parse_sitemap(body, content_type)
    except SitemapError as e:
        return out | {"parse_error": str(e), "html": e.html}
    seen: dict[str, bool] = {}
    for loc in locs:
        url_ = None if not loc or any(c.isspace() for c in loc) else normalize_url(loc)
        if url_ is None:
            out["invalid"].append(loc)
        elif url_ in seen:
            seen[url_] = True
        else:
            seen[url_] = False
    host = host_of_url(url)
    cross = [] if kind == "sitemapindex" else [u for u in seen if host_of_url(u) != host]
    return out | {"kind": kind, "locs": list(seen), "duplicates": [u for u, twice in seen.items() if twice], "cross_host": cross}
