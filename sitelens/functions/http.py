"""What a captured answer says: headers, codings, statuses, addresses."""

from __future__ import annotations

import ipaddress
import re
import zlib
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Answers that say nothing of a page's content, failures that are an answer of their
# own, failures that may pass, hosts that are down, statuses that redirect.
UNRETRIEVED = [401, 403, 407, 429]
DEFINITIVE_ERRORS = ["redirect-loop", "too-many-redirects", "invalid-redirect"]
TRANSIENT_ERRORS = ["timeout", "dns", "connection"]
HOST_DOWN = ["connection", "dns", "ssl", "timeout"]
REDIRECTS = [301, 302, 303, 307, 308]
#: Directives of X-Robots-Tag whose colon names no crawler.
COLON_DIRECTIVES = {"unavailable_after", "max-snippet", "max-image-preview", "max-video-preview"}
INDEXERS = ["googlebot", "bingbot"]


def collect_headers(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Headers under lower-case names: cookies hidden, X-Robots-Tag one a line, others joined by commas."""
    out: dict[str, list[str]] = {}
    for name, value in pairs:
        out.setdefault(name.strip().lower(), []).append(value.strip())
    joined = {name: ("\n" if name == "x-robots-tag" else ", ").join(values) for name, values in out.items()}
    return joined | ({"set-cookie": "[redacted]"} if "set-cookie" in joined else {})


def content_type(header: Column) -> Column:
    """The media type of a Content-Type header, null where there is none."""
    kind = F.lower(F.trim(F.split(header, ";")[0]))
    return F.when(kind != "", kind)


def declared_charset(header: Column) -> Column:
    found = F.lower(F.regexp_extract(header, r"(?i);\s*charset\s*=\s*[\"']?([^\"';\s]+)", 1))
    return F.when(found != "", found)


class BodyError(ValueError):
    """A body that cannot be read; kind is unsupported-encoding, encoding or too-large."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def inflated(body: bytes, coding: str | None, limit: int) -> tuple[bytes, bool]:
    """The body without its content coding, at most `limit` bytes of it, and whether that is all; memory stays within the limit."""
    names = [c for c in re.split(r"[,\s]+", (coding or "").lower()) if c and c != "identity"]
    if not names:
        return body[:limit], len(body) <= limit
    if len(names) > 1 or names[0] not in ("gzip", "x-gzip", "deflate"):
        raise BodyError("unsupported-encoding")
    # deflate comes with a zlib header or raw
    ways = [16 + zlib.MAX_WBITS] if names[0] != "deflate" else [zlib.MAX_WBITS, -zlib.MAX_WBITS]
    for way in ways:
        reader = zlib.decompressobj(way)
        try:
            out = reader.decompress(body, limit + 1)
        except zlib.error:
            continue
        return out[:limit], len(out) <= limit and not reader.unconsumed_tail
    raise BodyError("encoding")


def retry_after(value: str | None, status: int | None, now: datetime) -> float | None:
    """Seconds that an answer 429 or 503 asks to wait."""
    if not value or status not in (429, 503):
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        when = parsedate_to_datetime(value.strip())
    except (TypeError, ValueError):
        return None
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return max((when - now).total_seconds(), 0.0)


def non_public_reason(address: str) -> str | None:
    """Why an IP address is no public one; an IPv6 address that carries an IPv4 address is judged by that too."""
    ip = ipaddress.ip_address(address)
    carried: list[ipaddress.IPv4Address] = []
    through_nat = False
    if ip.version == 6:
        through_nat = ip in ipaddress.ip_network("64:ff9b::/96")
        carried = [x for x in (ip.ipv4_mapped, ip.sixtofour, *(ip.teredo or ())) if x is not None]
        if through_nat or ip in ipaddress.ip_network("64:ff9b:1::/48"):
            carried.append(ipaddress.IPv4Address(int(ip) % 2**32))
    for inner in carried:
        reason = non_public_reason(str(inner))
        if reason:
            return reason
    if through_nat:
        return None
    for name in ("loopback", "private", "link_local", "multicast", "reserved", "unspecified", "site_local"):
        if getattr(ip, f"is_{name}", False):
            return name.replace("_", "-")
    return None if ip.is_global else "not-global"


def is_local_host(host: str) -> bool:
    """Names of this machine or of private networks, and addresses that are not public; nothing is looked up."""
    host = host.lower().strip("[]").rstrip(".")
    if re.search(r"(^|\.)localhost$|\.(local|internal|test)$", host):
        return True
    try:
        return non_public_reason(host) is not None
    except ValueError:
        return False


@F.udf(T.BooleanType(), useArrow=True)
def local_host(host: str) -> bool:
    return host is not None and is_local_host(host)


def definitive(status: Column, error_kind: Column) -> Column:
    """Whether an answer proves something of the address itself."""
    return F.coalesce(error_kind.isin(DEFINITIVE_ERRORS), F.lit(False)) | (status.isNotNull() & ~F.coalesce(status.isin(UNRETRIEVED), F.lit(False)))


def unretrieved(status: Column, error: Column, error_kind: Column) -> Column:
    """Whether a page could not be observed."""
    return ~F.coalesce(error_kind.isin(DEFINITIVE_ERRORS), F.lit(False)) & (error.isNotNull() | F.coalesce(status.isin(UNRETRIEVED), F.lit(False)))


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def split_directives(value: str) -> set[str]:
    found = {d.strip().lower() for d in value.split(",")} - {""}
    return found | {"noindex", "nofollow"} if "none" in found else found


def x_robots(header: str | None) -> dict[str, set[str]]:
    """Directives by crawler, "" for all: a name with a colon holds for the rest of its line."""
    out: dict[str, set[str]] = {}
    for line in (header or "").splitlines():
        agent = ""
        for part in line.split(","):
            name, colon, rest = part.strip().partition(":")
            name = name.strip().lower()
            if colon and " " not in name and name not in COLON_DIRECTIVES:
                agent, part = name, rest
            if part.strip():
                out.setdefault(agent, set()).update(split_directives(part))
    return out


@F.udf(T.ArrayType(T.StructType([T.StructField("agent", T.StringType()), T.StructField("directives", T.ArrayType(T.StringType()))])), useArrow=True)
def directives(robots_meta, x_robots_tag):
    """Directives for all crawlers (agent "all") and for each indexing one, of meta tags and header together."""
    found = {agent: set(values) for agent, values in x_robots(x_robots_tag).items()}
    for m in robots_meta or []:
        found.setdefault("" if m["name"] == "robots" else m["name"], set()).update(split_directives(m["content"] or ""))
    every = found.get("", set())
    return [("all", sorted(every)), *((agent, sorted(every | found.get(agent, set()))) for agent in INDEXERS)]


def link_canonicals(header: str | None) -> list[str]:
    """Targets of a Link header's rel=canonical entries."""
    found = []
    for target, parameters in re.findall(r"<([^<>]*)>((?:[^,<>\"]|\"[^\"]*\")*)", header or ""):
        rel = re.search(r";\s*rel\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^;,\s]*))", parameters, re.I)
        if rel and target.strip() and "canonical" in "".join(x or "" for x in rel.groups()).lower().split():
            found.append(target.strip())
    return found


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def header_canonicals(header):
    return link_canonicals(header)
