"""The checks: each analyzer is a function of the views that returns issues.

Checks that one page decides are evaluated together, in one pass over the audited pages; the others
are joins and aggregates keyed by audit_id. ANALYZERS is the registry: all_issues() is the union of
what its functions return, and more functions of the same form may be given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import http
from sitelens.functions.robots import SEARCH, verdicts
from sitelens.functions.urls import host_of

from .catalogue import ISSUE, in_order, issue_columns, issues, listed, plural, rank
from .views import Views, blocked

# Link texts that say nothing, and how short and how long a title is.
GENERIC_ANCHORS = ["click here", "here", "read more", "more", "learn more", "this link", "link", "this", "go", "click", "details", "more info"]
SHORT_TITLE, LONG_TITLE = 10, 70
# Findings that rendering could explain, those of them that concern the site, and the cap of their confidence.
RENDER_DEPENDENT = ["missing-title", "empty-title", "short-title", "missing-meta-description", "missing-canonical", "missing-h1", "no-internal-outlinks", "duplicate-title", "duplicate-meta-description", "no-structured-data", "potential-orphan-page"]
SITE_WIDE_RENDER = ["no-structured-data", "potential-orphan-page"]
RENDER_CONFIDENCE = 0.35


def _texts(array: str, test: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(array, test), value)


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def heading_skips(headings: str = "content.headings") -> Column:
    """The headings more than one level below the one before, as "h2 -> h4"."""
    levels = F.transform(headings, lambda h: h["level"])
    n = F.greatest(F.size(levels) - 1, F.lit(0))
    steps = F.zip_with(F.slice(levels, F.lit(1), n), F.slice(levels, F.lit(2), n), lambda a, b: F.when(b > a + 1, F.format_string("h%d -> h%d", a, b)))
    return F.filter(steps, lambda s: s.isNotNull())


def page_checks(only: Sequence[str] | None = None) -> list[tuple[Column, list[Column]]]:
    """(fires, issue columns) of the checks that an audited page decides by itself."""
    url = F.array("final_url")
    title, description = F.get("content.titles", F.lit(0)), F.get("content.descriptions", F.lit(0))
    n = F.size
    h1 = n(F.filter("content.headings", lambda h: h["level"] == 1))
    insecure = F.filter("content.subresources", lambda s: s.startswith("http://"))
    placed = lambda source: _texts("content.canonicals", lambda c: c["source"] == source, lambda c: F.coalesce(c["href"], F.lit("no href")))
    body, late = placed("body"), placed("head-implicitly-closed")
    resolved_head = F.array_distinct(F.filter("resolved_head", lambda u: u.isNotNull()))
    other = F.col("canonical").isNotNull() & (F.col("canonical") != F.col("final_url"))
    same_host = host_of(F.col("canonical")) == host_of(F.col("final_url"))
    inside = F.filter("content.links", lambda x: x["internal"])
    outlinks = F.filter(inside, lambda x: x["url"] != F.col("final_url"))
    http_links = _texts("content.links", lambda x: x["internal"] & x["url"].startswith("http://"), lambda x: x["url"])
    nameless = _texts("content.links", lambda x: x["text"] == "", lambda x: x["raw_href"])
    generic = _texts("content.links", lambda x: x["folded"].isin(GENERIC_ANCHORS), lambda x: x["text"])
    unfollowed = _texts("content.links", lambda x: x["internal"] & F.array_contains(x["rel"], "nofollow"), lambda x: x["url"])
    src = lambda i: F.coalesce(i["src"], F.lit("no src"))
    no_alt = _texts("content.images", lambda i: i["alt"].isNull(), src)
    empty_alt = _texts("content.images", lambda i: i["alt"].isNotNull() & _blank(i["alt"]), src)
    no_size = _texts("content.images", lambda i: (F.coalesce(i["width"], F.lit("")) == "") | (F.coalesce(i["height"], F.lit("")) == ""), src)
    errors = _texts("content.json_ld", lambda b: b["error"].isNotNull(), lambda b: b["error"])
    valid = lambda flag: n(F.filter("content.json_ld", lambda b: b["error"].isNull() & b[flag]))
    counted = lambda count, what: F.concat(count.cast("string"), F.lit(f" {what}"))
    table: list[tuple] = [
        ("mixed-content", F.col("final_url").startswith("https://") & (n(insecure) > 0), 0.95, listed(insecure)),
        ("noindex-page", F.col("noindex_any") & ~F.col("is_start"), 0.95, F.concat(F.lit("noindex for "), F.array_join("noindex_for", ", "))),
        ("nofollow-page", F.col("nofollow"), 0.95, "nofollow for all crawlers"),
        ("missing-title", n("content.titles") == 0, 0.98, "no title element"),
        ("empty-title", title == "", 0.98, "the title element is empty"),
        ("multiple-titles", n("content.titles") > 1, 0.95, listed(F.col("content.titles"))),
        ("short-title", F.length(title).between(1, SHORT_TITLE - 1), 0.6, title),
        ("long-title", F.length(title) > LONG_TITLE, 0.6, title),
        ("missing-meta-description", n("content.descriptions") == 0, 0.95, "no meta description"),
        ("empty-meta-description", description == "", 0.95, "the meta description is empty"),
        ("multiple-meta-descriptions", n("content.descriptions") > 1, 0.95, listed(F.col("content.descriptions"))),
        ("canonical-outside-head", n(body) > 0, 0.9, F.concat(F.lit("in the body: "), listed(body))),
        ("canonical-outside-head", n(late) > 0, 0.5, F.concat(F.lit("after "), F.array_join("content.head_anomalies", ", "), F.lit(": "), listed(late))),
        ("missing-canonical", ~F.col("named") & (n(body) + n(late) == 0) & ~F.col("noindex_any"), 0.98, "no canonical in head or header"),
        ("multiple-canonicals", n("head_hrefs") > 1, 0.95, listed(F.transform("head_hrefs", lambda h: F.coalesce(h, F.lit("no href")))), {"severity": F.when(n(resolved_head) > 1, "medium").otherwise("low")}),
        ("canonical-header-conflict", (n("head_hrefs") > 0) & (n("header_hrefs") > 0) & ~F.get("resolved_head", F.lit(0)).eqNullSafe(F.get("resolved_header", F.lit(0))), 0.9, F.concat_ws("; ", F.get("head_hrefs", F.lit(0)), F.get("header_hrefs", F.lit(0)))),
        ("malformed-canonical", F.col("named") & F.col("canonical").isNull(), 0.95, F.coalesce("canonical_raw", F.lit("no href"))),
        ("canonical-cross-host", other & ~same_host, 0.95, F.col("canonical")),
        ("canonicalized-to-other-url", other & same_host, 0.95, F.col("canonical")),
        ("canonical-noindex-conflict", other & F.col("noindex_any"), 0.9, F.col("canonical")),
        ("missing-h1", h1 == 0, 0.95, "no h1"),
        ("multiple-h1", h1 > 1, 0.95, counted(h1, "h1 elements")),
        ("heading-level-skip", n(heading_skips()) > 0, 0.9, listed(heading_skips())),
        ("empty-heading", F.exists("content.headings", lambda h: h["text"] == ""), 0.9, listed(_texts("content.headings", lambda h: h["text"] == "", lambda h: F.format_string("h%d", h["level"])))),
        ("no-internal-outlinks", n(outlinks) == 0, 0.9, counted(n("content.links"), "links, none to another page of the site")),
        ("insecure-internal-link", F.col("site_url").startswith("https://") & (n(http_links) > 0), 0.95, listed(http_links)),
        ("empty-anchor-text", n(nameless) > 0, 0.85, listed(nameless)),
        ("generic-anchor-text", n(generic) > 0, 0.9, listed(generic)),
        ("internal-nofollow", n(unfollowed) > 0, 0.95, listed(unfollowed)),
        ("image-missing-alt", n(no_alt) > 0, 0.97, listed(no_alt)),
        ("image-empty-alt", n(empty_alt) > 0, 0.9, listed(empty_alt)),
        ("image-missing-dimensions", n(no_size) > 0, 0.6, listed(no_size)),
        ("invalid-json-ld", n(errors) > 0, 0.97, listed(errors)),
        ("json-ld-missing-context", valid("missing_context") > 0, 0.9, counted(valid("missing_context"), "blocks without @context")),
        ("json-ld-missing-type", valid("missing_type") > 0, 0.9, counted(valid("missing_type"), "blocks without @type")),
    ]
    out = []
    for rule_id, fires, confidence, evidence, *more in table:
        if only is None or rule_id in only:
            out.append((fires, issue_columns(rule_id, confidence, evidence, url, **(more[0] if more else {}))))
    return out


def single_page(v: Views, only: Sequence[str] | None = None) -> DataFrame:
    """Issues that audited pages decide by themselves, all in one pass; `only` leaves out other rules before they are evaluated."""
    from sitelens.operators.crawl import resolved_each

    rows = v.audited.withColumn("resolved_head", resolved_each(F.col("head_hrefs"), F.col("final_url"))).withColumn("resolved_header", resolved_each(F.col("header_hrefs"), F.col("final_url")))
    fired = [F.when(fires, F.struct(*columns)) for fires, columns in page_checks(only)]
    found = rows.select("audit_id", "seq", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("x"))
    return found.select("audit_id", "seq", "x.*")


def technical(v: Views) -> DataFrame:
    """Start page, fetches, errors, shells, and what the crawl left out."""
    start = v.audits.select("audit_id", "start_url", "site_url", "robots_state").join(v.page_index.select("audit_id", F.col("url").alias("start_url"), "page"), ["audit_id", "start_url"], "left")
    skipped = start.where("page is null").join(v.skipped.select("audit_id", F.col("url").alias("start_url"), "reason"), ["audit_id", "start_url"])
    passing = (F.col("reason") == "robots-unavailable") & (F.col("robots_state") == "unavailable")
    out = [issues(skipped, "start-url-unavailable", F.when(passing, 0.6).otherwise(0.95), F.concat(F.lit("not fetched: "), "reason"), F.array("start_url"), prevalence=F.lit(1.0), details=F.struct("reason"))]
    failed = start.where("page is not null and not page.has_content").select("audit_id", "start_url", "site_url", "page.*")
    passing = F.coalesce(F.col("error_kind").isin(http.TRANSIENT_ERRORS), F.lit(False)) | F.coalesce(F.col("status_code").isin(429, 503), F.lit(False))
    why = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "error_kind", "error")).when(~http.is_success(F.col("status_code")), F.concat(F.lit("HTTP "), "status_code")).otherwise(F.concat(F.lit("no HTML page of the site at "), "final_url"))
    out.append(issues(failed, "start-url-unavailable", F.when(passing, 0.6).otherwise(0.95), why, F.array("start_url"), prevalence=F.lit(1.0), details=F.struct("status_code", "error_kind", "final_url")))
    home = start.where("page.has_content").select("audit_id", "page.*")
    plain = home.where(F.col("final_url").startswith("http://"))
    out.append(issues(plain, "https-not-used", 0.95, F.col("final_url"), F.array("final_url"), severity=F.when(http.local_host(host_of(F.col("final_url"))), "info"), prevalence=F.lit(1.0)))
    out.append(issues(home.where("noindex_any"), "noindex-start-page", 0.95, F.concat(F.lit("noindex for "), F.array_join("noindex_for", ", ")), F.array("final_url"), details=F.struct("noindex_for")))
    p = v.pages
    hops = F.array_join(F.transform("redirect_chain", lambda h: F.format_string("%s (%d)", h["url"], h["status_code"])), " -> ")
    out.append(issues(p.where(F.size("redirect_chain") >= 2), "redirect-chain", 0.97, F.concat_ws(" -> ", hops, "final_url"), F.array("requested_url")))
    out.append(issues(p.where("error_kind = 'too-large'"), "page-too-large", 1.0, F.col("error"), F.array("final_url")))
    broken = p.where("error is not null and error_kind <> 'too-large' and not is_start")
    out.append(issues(broken, "page-fetch-error", F.when(F.col("error_kind").isin(http.TRANSIENT_ERRORS), 0.6).otherwise(0.9), F.concat_ws(": ", "error_kind", "error"), F.array("requested_url"), details=F.struct("error_kind")))
    answered = p.where("error is null").withColumn("fails", (F.col("via") == "link") & (F.col("status_code") >= 400) & ~F.col("status_code").isin(401, 403, 429))
    sums = answered.groupBy("audit_id").agg(F.count("*").alias("crawled"), F.count_if("fails").alias("n"), F.array_sort(F.collect_list(F.when(F.col("fails"), F.struct("seq", "requested_url", "status_code")))).alias("f")).where("n > 0")
    share = F.col("n") / F.col("crawled")
    gone = F.forall("f", lambda x: x["status_code"].isin(404, 410))
    out.append(issues(sums, "crawled-page-error", F.when(gone, 0.95).otherwise(0.75), listed(F.transform("f", lambda x: F.format_string("%s (HTTP %d)", x["requested_url"], x["status_code"]))), F.transform("f", lambda x: x["requested_url"]), severity=F.when((share >= 0.5) & (F.col("n") >= 3), "critical"), prevalence=share))
    shells = v.audited.where("content.is_shell").groupBy("audit_id").agg(in_order("seq", "final_url", "content.render_signals").alias("s"))
    out.append(issues(shells, "client-rendered-shell", 0.9, F.concat_ws(": ", F.col("s")[0]["final_url"], F.array_join(F.col("s")[0]["render_signals"], ", ")), F.transform("s", lambda x: x["final_url"])))
    denied = p.where(F.col("status_code").isin(http.UNRETRIEVED)).groupBy("audit_id").agg(in_order("seq", "requested_url", "status_code").alias("d"))
    out.append(issues(denied, "pages-access-denied", 1.0, listed(F.transform("d", lambda x: F.format_string("%s (HTTP %d)", x["requested_url"], x["status_code"])))))
    left = v.pending.groupBy("audit_id").agg(in_order("pos", "url").alias("left"))
    runs = v.audits.select("audit_id", "stop_reason").join(left, "audit_id", "left")
    urls = F.transform("left", lambda x: x["url"])
    out.append(issues(runs.where("stop_reason is null and left is not null"), "crawl-limit-reached", 1.0, listed(urls), details=F.struct(F.size("left").alias("pending"))))
    out.append(issues(runs.where("stop_reason is not null"), "crawl-stopped-early", 1.0, F.concat_ws("; ", "stop_reason", plural(F.coalesce(F.size("left"), F.lit(0)), "address left")), details=F.struct("stop_reason")))
    return _union(out)


def robots_rules(v: Views) -> DataFrame:
    """What robots.txt is, whom it keeps out, and from what."""
    a = v.audits.select("audit_id", "start_url", "site_url", "robots_url", "robots_state", "robots_text", "robots_status", "robots_error", "robots_type")
    state = F.col("robots_state")
    evidence = F.concat_ws(": ", "robots_url", F.coalesce("robots_error", F.concat(F.lit("HTTP "), F.col("robots_status").cast("string"))))
    details = F.struct("robots_state", "robots_status")
    out = [
        issues(a.where(state.isin("server-error", "unavailable")), "robots-txt-unreachable", F.when(state == "unavailable", 0.6).otherwise(0.85), evidence, details=details),
        issues(a.where(state == "rate-limited"), "robots-txt-rate-limited", 0.7, evidence, details=details),
        issues(a.where(state == "inaccessible"), "robots-txt-access-denied", 0.9, evidence, details=details),
        issues(a.where(state == "missing"), "robots-txt-missing", 0.95, evidence, details=details),
    ]
    a = a.where("robots_text is not null")
    html = (F.col("robots_type") == "text/html") | F.lower(F.substring(F.ltrim("robots_text"), 1, 20)).rlike("^(<!doctype html|<html)")
    out.append(issues(a.where(html), "robots-txt-not-plain-text", 0.85, F.concat_ws(": ", F.coalesce("robots_type", F.lit("no type")), F.substring("robots_text", 1, 60))))
    root = a.withColumn("v", verdicts(F.col("robots_text"), F.concat(F.regexp_extract("site_url", "^https?://[^/?]*", 0), F.lit("/"))))
    shut = root.withColumn("shut", F.filter("v", lambda x: x["everything"]))
    of = lambda search: F.filter("shut", lambda x: x["agent"].isin(SEARCH) if search else ~x["agent"].isin(SEARCH))
    said = lambda x: F.concat_ws(": ", x["agent"], x["rule"])
    shut = shut.withColumn("search", of(True)).withColumn("ai", of(False))
    everyone = F.size("search") == len(SEARCH)
    out.append(issues(shut.where(everyone), "robots-disallow-all", 0.9, F.array_join(F.transform("search", said), "; ")))
    out.append(issues(shut.where(~everyone).select("audit_id", F.explode("search").alias("x")), "robots-search-crawler-blocked", 0.9, said(F.col("x")), details=F.struct(F.col("x.agent").alias("crawler"))))
    out.append(issues(shut.where(F.size("ai") > 0), "robots-ai-crawler-blocked", 0.9, F.array_join(F.transform("ai", said), "; ")))
    here = shut.withColumn("w", verdicts(F.col("robots_text"), F.col("site_url")))
    here = here.withColumn("w", F.filter("w", lambda x: x["agent"].isin(SEARCH) & ~x["allowed"] & ~F.array_contains(F.transform("search", lambda s: s["agent"]), x["agent"])))
    out.append(issues(here.where(F.size("w") > 0), "start-url-disallowed", 0.85, F.array_join(F.transform("w", said), "; "), F.array("site_url")))
    pages = blocked(v.audited.where("not is_start").select("audit_id", "seq", "final_url"), v, F.col("final_url")).where(F.size("agents") > 0)
    pages = pages.groupBy("audit_id").agg(in_order("seq", "final_url", "agents").alias("p"))
    out.append(issues(pages, "crawled-page-disallowed", 0.85, F.array_join(F.slice(F.transform("p", lambda x: F.concat(x["final_url"], F.lit(" ("), F.array_join(x["agents"], ", "), F.lit(")"))), 1, 5), "; "), F.transform("p", lambda x: x["final_url"])))
    own = v.audits.select("audit_id", "start_url", "site_url")
    linked = v.skipped.where("reason = 'robots-disallowed'").join(own, "audit_id").where("url <> start_url and url <> site_url").groupBy("audit_id").agg(in_order("pos", "url").alias("u"))
    out.append(issues(linked, "linked-url-disallowed", 0.85, listed(F.transform("u", lambda x: x["url"]))))
    listed_urls = blocked(v.sitemap_urls, v, F.col("url")).groupBy("audit_id").agg(F.count("*").alias("all"), F.array_sort(F.collect_list(F.when(F.size("agents") > 0, F.struct("pos", "url")))).alias("u")).where(F.size("u") > 0)
    out.append(issues(listed_urls, "sitemap-url-disallowed", 0.85, listed(F.transform("u", lambda x: x["url"])), prevalence=F.size("u") / F.col("all")))
    return _union(out)


def sitemap_rules(v: Views) -> DataFrame:
    """Sitemap files, and what they list against what was crawled."""
    checked = v.audits.where("checked").select("audit_id", "url_limit", "file_limit", "robots_state", "robots_url")
    f = v.sitemap_files.join(checked.select("audit_id"), "audit_id", "left_semi")
    # a guessed /sitemap.xml counts only if it is clearly meant as one
    f = f.withColumn("counts", ~F.col("guessed") | F.col("valid") | (F.col("fetched") & F.col("parse_error").isNotNull() & ~F.coalesce("html", F.lit(False))))
    empty = F.col("valid") & (F.col("url_count") == 0) & (F.size("invalid") == 0)
    told = F.struct(F.col("url").alias("sitemap"), "source")
    rest = f.where(F.col("counts") & ~empty)
    entries = F.greatest(F.col("url_count") + F.size("invalid"), F.lit(1))
    out = [
        issues(rest.where("not fetched"), "sitemap-inaccessible", 0.9, F.concat_ws(": ", "url", F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")))), details=told),
        issues(rest.where("fetched and parse_error is not null"), "sitemap-invalid", F.when(F.col("guessed"), 0.8).otherwise(0.95), F.concat_ws(": ", "url", "parse_error"), details=told),
    ]
    for rule_id, column, confidence in (("sitemap-duplicate-urls", "duplicates", 0.97), ("sitemap-invalid-urls", "invalid", 0.95), ("sitemap-cross-host-urls", "cross_host", 0.8)):
        out.append(issues(rest.where(F.col("valid") & (F.size(column) > 0)), rule_id, confidence, F.concat_ws(": ", "url", listed(F.col(column))), details=told, prevalence=F.size(column) / entries))
    sums = f.groupBy("audit_id").agg(
        F.count("*").alias("files"), F.array_sort(F.collect_list(F.when(F.col("counts") & empty, F.struct("pos", "url")))).alias("empty"), F.bool_or("valid").alias("found"),
        F.bool_or(F.col("source") == "robots").alias("declared"), F.count_if(~F.col("guessed") & ~F.col("valid")).alias("failed"), in_order("pos", "url").alias("tried"),
    )
    sums = checked.join(sums, "audit_id", "left").fillna(False, ["found", "declared"]).fillna(0, ["files", "failed"])
    urls = lambda c: F.transform(c, lambda x: x["url"])
    incomplete = F.col("url_limit") | F.col("file_limit") | (F.col("failed") > 0)
    out.append(issues(sums.where(F.size("empty") > 0), "sitemap-empty", 0.95, listed(urls("empty")), prevalence=F.size("empty") / F.col("files")))
    out.append(issues(sums.where("not found"), "sitemap-missing", 0.8, listed(urls("tried"))))
    out.append(issues(sums.where("found and robots_state = 'parsed' and not declared"), "sitemap-not-in-robots", 0.95, F.col("robots_url")))
    why = F.concat_ws("; ", F.when(F.col("file_limit"), "limit of files"), F.when(F.col("url_limit"), "limit of addresses"), F.when(F.col("failed") > 0, F.format_string("%d declared files failed", "failed")))
    out.append(issues(sums.where(F.col("found") & incomplete), "sitemap-incomplete", 1.0, why))

    known = v.sitemap_urls.join(v.page_index, ["audit_id", "url"]).select("audit_id", "pos", "url", "page.*")
    bad = F.col("error").isNotNull() | ~http.is_success(F.col("status_code"))
    moved = ~bad & (F.size("redirect_chain") > 0) & (F.col("requested_url") == F.col("url"))
    for rule_id, fires, more in (
        ("sitemap-url-error", bad, F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))),
        ("sitemap-url-redirects", moved, F.concat(F.lit("to "), "final_url")),
        ("sitemap-url-noindex", F.col("has_content") & F.col("noindex_any"), F.array_join("noindex_for", ", ")),
        ("sitemap-url-non-canonical", F.col("has_content") & (F.col("canonical") != F.col("final_url")), F.col("canonical")),
    ):
        found = known.where(fires).groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", F.concat(F.col("url"), F.lit(" ("), more, F.lit(")")).alias("said")))).alias("u"))
        out.append(issues(found, rule_id, 0.9, listed(F.transform("u", lambda x: x["said"])), urls("u")))
    whole = sums.where(~incomplete).join(v.sitemap_urls.select("audit_id").distinct(), "audit_id", "left_semi").select("audit_id")
    own = F.when(F.col("canonical_raw").isNull() | (F.col("canonical_raw") == ""), True).otherwise(F.coalesce(F.col("canonical") == F.col("final_url"), F.lit(False)))
    free = blocked(v.audited.where(~F.col("noindex_any") & own).select("audit_id", "seq", "requested_url", "final_url").join(whole, "audit_id", "left_semi"), v, F.col("final_url")).where(F.size("agents") == 0)
    on = v.sitemap_urls.select("audit_id", "url")
    absent = free.join(on.withColumnRenamed("url", "final_url"), ["audit_id", "final_url"], "left_anti").join(on.withColumnRenamed("url", "requested_url"), ["audit_id", "requested_url"], "left_anti")
    absent = absent.groupBy("audit_id").agg(in_order("seq", "final_url").alias("u"))
    out.append(issues(absent, "page-not-in-sitemap", 0.9, listed(F.transform("u", lambda x: x["final_url"])), F.transform("u", lambda x: x["final_url"])))
    return _union(out)


def duplicates(v: Views, column: str, folded: str, value: Column | None = None) -> DataFrame:
    """(audit_id, value, pages): values that several indexable pages share, unless all resolve to one canonical."""
    value = F.trim(f"content.{folded}") if value is None else value
    rows = v.audited.where("not noindex_any").withColumn("value", value).where("value <> ''")
    target = F.when(F.col("canonical_raw").isNull() | (F.col("canonical_raw") == ""), F.col("final_url")).otherwise(F.coalesce("canonical", F.lit("no address")))
    rows = rows.select("audit_id", "value", "seq", "final_url", target.alias("target"), F.get(f"content.{column}", F.lit(0)).alias("shown"))
    rows = rows.groupBy("audit_id", "value").agg(in_order("seq", "final_url", "shown").alias("pages"), F.count_distinct("target").alias("targets"))
    return rows.where("size(pages) > 1 and targets > 1")


def metadata(v: Views) -> DataFrame:
    """Shared titles and descriptions, and what canonical addresses answer."""
    out = []
    for rule_id, column, folded in (("duplicate-title", "titles", "title_folded"), ("duplicate-meta-description", "descriptions", "description_folded")):
        urls = F.transform("pages", lambda x: x["final_url"])
        out.append(issues(duplicates(v, column, folded), rule_id, 0.97, F.concat(F.col("pages")[0]["shown"], F.lit(": "), listed(urls)), urls, details=F.struct(F.col("pages")[0]["shown"].alias("value"), F.size("pages").alias("count"))))
    rows = v.audited.where("canonical <> final_url").select("audit_id", "final_url", F.col("canonical").alias("url"))
    status = v.target_status.select("audit_id", "url", "status_code", F.col("final_url").alias("leads_to"), "redirected", "error", "error_kind")
    rows = rows.join(status, ["audit_id", "url"])
    failed = F.col("error").isNotNull() & ~F.coalesce(F.col("error_kind") == "blocked", F.lit(False))
    bad = ~failed & (F.col("status_code") >= 400)
    url = F.array("final_url")
    out.append(issues(rows.where(failed | bad), "canonical-target-error", F.when(failed, 0.6).otherwise(0.9), F.concat_ws(": ", "url", F.when(failed, F.col("error")).otherwise(F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))), url))
    out.append(issues(rows.where(~failed & F.coalesce(F.col("status_code") < 400, F.lit(True)) & F.col("redirected")), "canonical-target-redirects", 0.9, F.concat_ws(" -> ", "url", "leads_to"), url))
    return _union(out)


def link_verdict(status: Column, error: Column, error_kind: Column | None = None) -> Column:
    """What an answer makes of a link: struct(broken, severity, confidence, reason); null for a link that works.

    An answer with a status is judged by it, even if its body was then refused.
    """
    kind = error if error_kind is None else error_kind
    out = lambda broken, severity, confidence, reason: F.struct(F.lit(broken).alias("broken"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), reason.alias("reason"))
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    return (
        F.when(status.isNull() & kind.isin(http.DEFINITIVE_ERRORS), out(True, "medium", 0.85, error))
        .when(status.isNull() & error.isNotNull(), out(False, "info", 0.5, error))
        .when(status.isin(404, 410), out(True, "high", 0.95, code))
        .when(status.isin(401, 403, 429), out(False, "info", 0.5, code))
        .when(status >= 500, out(True, "medium", 0.6, code))
        .when(status >= 400, out(True, "medium", 0.8, code))
    )


def targets(v: Views) -> DataFrame:
    """(audit_id, url, on_site, status_code, leads_to, redirected, verdict, sources, anchors): each answered link target once, with the pages that link to it in order."""
    source = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "source"))), lambda x: x["source"]))
    anchors = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("seq", "pos", "text")))), lambda x: x["text"]))
    linked = v.links.groupBy("audit_id", "url").agg(F.first("on_site").alias("on_site"), source.alias("sources"), F.slice(anchors, 1, 10).alias("anchors"))
    status = v.target_status.withColumn("verdict", link_verdict(F.col("status_code"), F.col("error"), F.col("error_kind"))).withColumnRenamed("final_url", "leads_to")
    return linked.join(status, ["audit_id", "url"])


def links(v: Views) -> DataFrame:
    """Broken, redirecting and unverified link targets, orphans, and links left unchecked."""
    t = targets(v).join(v.link_coverage, "audit_id", "left")
    inside = F.col("on_site")
    share = 1 / F.greatest(F.when(inside, F.col("internal_checked")).otherwise(F.col("external_checked")), F.lit(1))
    details = F.struct(F.col("url").alias("target"), "status_code", F.col("sources").alias("linked_from"), F.col("anchors").alias("anchor_texts"))
    evidence = F.concat(F.concat_ws(": ", "url", "verdict.reason"), F.lit("; linked from "), listed(F.col("sources")))
    broken = t.where("verdict.broken")
    out = [
        issues(broken.where(inside), "broken-internal-link", F.col("verdict.confidence"), evidence, F.col("sources"), severity=F.col("verdict.severity"), details=details, prevalence=share),
        issues(broken.where(~inside), "broken-external-link", F.col("verdict.confidence"), evidence, F.col("sources"), details=details, prevalence=share),
        issues(t.where("not verdict.broken"), "unverified-link", F.col("verdict.confidence"), evidence, F.col("sources"), details=details),
        issues(t.where(F.col("verdict").isNull() & inside & F.col("redirected")), "internal-link-redirect", 0.9, F.concat(F.concat_ws(" -> ", "url", "leads_to"), F.lit("; linked from "), listed(F.col("sources"))), F.col("sources"), details=details, prevalence=share),
    ]
    left = v.pending.groupBy("audit_id").agg(F.lit(True).alias("partial")).join(v.audits.where("stop_reason is null").select("audit_id"), "audit_id", "left_semi")
    orphans = v.audited.where("via = 'sitemap'").select("audit_id", "seq", "final_url").join(v.inbound, ["audit_id", "seq"], "left_anti").join(left, "audit_id", "left")
    out.append(issues(orphans, "potential-orphan-page", F.when(F.col("partial"), 0.5).otherwise(0.7), "listed in the sitemap, linked from no crawled page", F.array("final_url")))
    unchecked = v.unchecked.groupBy("audit_id").agg(in_order("pos", "url").alias("u"))
    out.append(issues(unchecked, "links-not-checked", 1.0, listed(F.transform("u", lambda x: x["url"])), details=F.struct(F.size("u").alias("count"))))
    return _union(out)


def structured_data(v: Views) -> DataFrame:
    """Formats of structured data over a site's pages."""
    other = F.col("content.has_microdata") | F.col("content.has_rdfa")
    sums = v.audited.groupBy("audit_id").agg(F.count("*").alias("pages"), F.bool_or(F.size("content.json_ld") > 0).alias("json_ld"), F.array_sort(F.collect_list(F.when(other, F.struct("seq", "final_url")))).alias("u"))
    urls = F.transform("u", lambda x: x["final_url"])
    partial = v.pending.select("audit_id").distinct().withColumn("partial", F.lit(True)).join(v.audits.where("stop_reason is null").select("audit_id"), "audit_id", "left_semi")
    none = sums.where("not json_ld and size(u) = 0").join(partial, "audit_id", "left")
    return _union([
        issues(sums.where("size(u) > 0"), "non-json-ld-structured-data", 0.9, listed(urls), urls),
        issues(none, "no-structured-data", F.when(F.col("partial"), 0.7).otherwise(0.9), F.concat(F.lit("none on "), plural(F.col("pages"), "page"))),
    ])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The registry of analyzers.
ANALYZERS: list[Callable[[Views], DataFrame]] = [technical, robots_rules, sitemap_rules, single_page, metadata, links, structured_data]


def hedged(found: DataFrame, v: Views) -> DataFrame:
    """Issues with the confidence of what rendering could explain capped, where the pages in question are shells."""
    shells = v.audited.where("content.is_shell").groupBy("audit_id").agg(F.collect_set("final_url").alias("shells"))
    rows = found.join(shells, "audit_id", "left")
    everywhere = F.col("rule_id").isin(SITE_WIDE_RENDER) | (F.size("affected_urls") == 0) | F.forall("affected_urls", lambda u: F.array_contains("shells", u))
    applies = F.coalesce(F.col("rule_id").isin(RENDER_DEPENDENT) & F.col("shells").isNotNull() & everywhere, F.lit(False))
    rows = rows.withColumn("confidence", F.when(applies, F.least("confidence", F.lit(RENDER_CONFIDENCE))).otherwise(F.col("confidence")))
    marked = F.regexp_replace(F.concat(F.expr("substring(details, 1, length(details) - 1)"), F.lit(',"render_dependent":true}')), r"^\{,", "{")
    return rows.withColumn("details", F.when(applies, marked).otherwise(F.col("details"))).select(*ISSUE)


def all_issues(v: Views, analyzers: Sequence[Callable[[Views], DataFrame]] = ()) -> DataFrame:
    """Issues of all analyzers, hedged; `analyzers` are run beside the registered ones."""
    return hedged(_union([f(v).select(*ISSUE) for f in [*ANALYZERS, *analyzers]]), v)


def sorted_issues(found: DataFrame) -> DataFrame:
    """From the worst severity on, then by the number of pages, then by rule."""
    return found.orderBy("audit_id", rank(F.col("severity")), F.desc(F.size("affected_urls")), "rule_id", F.array_join("affected_urls", " "), "evidence")


def type_inventory(v: Views) -> DataFrame:
    """(audit_id, type, pages): on how many pages each JSON-LD type stands."""
    kinds = F.array_distinct(F.flatten(F.transform("content.json_ld", lambda b: b["types"])))
    return v.audited.select("audit_id", "seq", F.explode(kinds).alias("type")).groupBy("audit_id", "type").agg(F.count("*").alias("pages"))


def crawler_access(v: Views) -> DataFrame:
    """(audit_id, crawler, root_allowed, start_allowed, rule_group, rule, explicit_group) for each crawler of the table; without rules a state that restricts shuts everyone out."""
    a = v.audits.select("audit_id", "site_url", "robots_state", "robots_text")
    rows = a.select("*", F.explode(F.arrays_zip(verdicts(F.col("robots_text"), F.concat(F.regexp_extract("site_url", "^https?://[^/?]*", 0), F.lit("/"))).alias("root"), verdicts(F.col("robots_text"), F.col("site_url")).alias("start"))).alias("x"))
    free = ~F.col("robots_state").isin("rate-limited", "server-error", "unavailable")
    ruled = F.col("robots_text").isNotNull()
    return rows.select("audit_id", F.col("x.start.agent").alias("crawler"), F.when(ruled, F.col("x.root.allowed")).otherwise(free).alias("root_allowed"), F.when(ruled, F.col("x.start.allowed")).otherwise(free).alias("start_allowed"), F.when(ruled, F.col("x.start.group")).alias("rule_group"), F.when(ruled, F.col("x.start.rule")).alias("rule"), (ruled & F.col("x.start.named")).alias("explicit_group"))
