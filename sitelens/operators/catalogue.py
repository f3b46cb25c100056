"""The catalogue of checks: 83 rules with category, usual severity, title and advice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from the worst on, and categories.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CATEGORIES = ["technical", "metadata", "structure", "links", "images", "structured_data"]


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    title: str
    advice: str


# Ids, categories and severities. Titles and advice are wording of our own.
RULES = [
    Rule("start-url-unavailable", "technical", "critical", "The start page cannot be audited", "Serve an HTML page with a 2xx status at the start address."),
    Rule("https-not-used", "technical", "high", "The site is served without TLS", "Serve the site over https and redirect http to it."),
    Rule("mixed-content", "technical", "medium", "Secure page loads insecure resources", "Load all resources over https."),
    Rule("redirect-chain", "technical", "low", "Several redirects in a row", "Redirect straight to the final address."),
    Rule("page-fetch-error", "technical", "medium", "A page could not be fetched", "Find out why the request failed."),
    Rule("crawled-page-error", "technical", "high", "Linked pages answer with errors", "Restore the pages or change the links to them."),
    Rule("client-rendered-shell", "technical", "medium", "Pages are empty without JavaScript", "Render the main content on the server."),
    Rule("noindex-start-page", "technical", "high", "The start page asks not to be indexed", "Remove noindex if the page should be found."),
    Rule("noindex-page", "technical", "info", "A page asks not to be indexed", "Check that this is meant."),
    Rule("nofollow-page", "technical", "info", "A page asks that its links not be followed", "Check that this is meant."),
    Rule("page-too-large", "technical", "low", "A page is too large to be read", "Make the page smaller."),
    Rule("crawl-limit-reached", "technical", "info", "Not all pages were crawled", "Raise the limit of pages."),
    Rule("crawl-stopped-early", "technical", "info", "The crawl ended before its limit", "Run it again more slowly, or raise the limit of its delay."),
    Rule("pages-access-denied", "technical", "info", "Pages refused access", "Let the auditor through, or audit them otherwise."),
    Rule("robots-txt-missing", "technical", "low", "There is no robots.txt", "Serve a robots.txt, if only to name the sitemap."),
    Rule("robots-txt-access-denied", "technical", "medium", "robots.txt refuses access", "Let everyone read robots.txt."),
    Rule("robots-txt-rate-limited", "technical", "medium", "robots.txt is rate-limited", "Exempt robots.txt from rate limits."),
    Rule("robots-txt-unreachable", "technical", "high", "robots.txt cannot be reached", "Make robots.txt answer: crawlers keep away while it does not."),
    Rule("robots-txt-not-plain-text", "technical", "medium", "robots.txt is an HTML page", "Serve robots.txt as plain text."),
    Rule("robots-disallow-all", "technical", "critical", "No search crawler may read the site", "Remove the rule that blocks everything."),
    Rule("robots-search-crawler-blocked", "technical", "high", "A search crawler may not read the site", "Remove the rule that blocks it, unless meant."),
    Rule("robots-ai-crawler-blocked", "technical", "info", "AI crawlers may not read the site", "Check that this is meant."),
    Rule("start-url-disallowed", "technical", "high", "The start page is blocked for search crawlers", "Allow it in robots.txt."),
    Rule("crawled-page-disallowed", "technical", "medium", "Pages are blocked for search crawlers", "Allow them in robots.txt, if they should be found."),
    Rule("linked-url-disallowed", "technical", "info", "Linked addresses are blocked for the auditor", "Check that this is meant."),
    Rule("sitemap-url-disallowed", "technical", "medium", "The sitemap lists blocked addresses", "Allow them or take them off the sitemap."),
    Rule("sitemap-missing", "technical", "low", "There is no sitemap", "Publish a sitemap and name it in robots.txt."),
    Rule("sitemap-inaccessible", "technical", "medium", "A sitemap cannot be fetched", "Serve it, or remove the reference to it."),
    Rule("sitemap-invalid", "technical", "medium", "A sitemap is not valid", "Publish valid XML or a plain list of addresses."),
    Rule("sitemap-empty", "technical", "low", "A sitemap is empty", "List the site's pages, or remove it."),
    Rule("sitemap-duplicate-urls", "technical", "low", "A sitemap repeats addresses", "List each address once."),
    Rule("sitemap-invalid-urls", "technical", "low", "A sitemap lists values that are no addresses", "Write absolute http(s) addresses."),
    Rule("sitemap-cross-host-urls", "technical", "low", "A sitemap lists addresses of another host", "List the addresses of the sitemap's own host."),
    Rule("sitemap-incomplete", "technical", "info", "The sitemap was not read completely", "Mend the files that failed, or raise the limits."),
    Rule("sitemap-url-error", "technical", "medium", "The sitemap lists pages that fail", "Take them off the sitemap or restore them."),
    Rule("sitemap-url-redirects", "technical", "low", "The sitemap lists addresses that redirect", "List the final addresses."),
    Rule("sitemap-url-noindex", "technical", "medium", "The sitemap lists pages that ask not to be indexed", "Take them off the sitemap, or drop noindex."),
    Rule("sitemap-url-non-canonical", "technical", "low", "The sitemap lists pages with another canonical", "List canonical addresses."),
    Rule("page-not-in-sitemap", "technical", "info", "Pages are missing from the sitemap", "Add them, if they should be found."),
    Rule("sitemap-not-in-robots", "technical", "info", "robots.txt does not name the sitemap", "Add a Sitemap line."),
    Rule("missing-title", "metadata", "high", "No title", "Give the page a title."),
    Rule("empty-title", "metadata", "high", "Empty title", "Give the page a title."),
    Rule("multiple-titles", "metadata", "low", "Several titles", "Keep one title."),
    Rule("short-title", "metadata", "low", "Very short title", "Say what the page is about."),
    Rule("long-title", "metadata", "low", "Very long title", "Shorten the title."),
    Rule("duplicate-title", "metadata", "medium", "Pages share a title", "Give each page a title of its own."),
    Rule("missing-meta-description", "metadata", "low", "No meta description", "Describe the page."),
    Rule("empty-meta-description", "metadata", "low", "Empty meta description", "Describe the page."),
    Rule("multiple-meta-descriptions", "metadata", "low", "Several meta descriptions", "Keep one description."),
    Rule("duplicate-meta-description", "metadata", "low", "Pages share a meta description", "Describe each page on its own."),
    Rule("missing-canonical", "metadata", "low", "No canonical address", "Name the page's canonical address."),
    Rule("multiple-canonicals", "metadata", "medium", "Several canonical addresses", "Keep one canonical link."),
    Rule("malformed-canonical", "metadata", "medium", "The canonical is no address", "Name an http(s) address."),
    Rule("canonical-target-error", "metadata", "medium", "The canonical address fails", "Name an address that answers."),
    Rule("canonical-target-redirects", "metadata", "low", "The canonical address redirects", "Name the final address."),
    Rule("canonical-cross-host", "metadata", "info", "The canonical is on another host", "Check that this is meant."),
    Rule("canonicalized-to-other-url", "metadata", "info", "The canonical is another page", "Check that this is meant."),
    Rule("canonical-noindex-conflict", "metadata", "low", "noindex together with another canonical", "Choose one of the two."),
    Rule("canonical-outside-head", "metadata", "medium", "The canonical link is not in the head", "Move it into the head, before anything visible."),
    Rule("canonical-header-conflict", "metadata", "medium", "Page and header name different canonicals", "Let both name the same address."),
    Rule("missing-h1", "structure", "medium", "No main heading", "Give the page an h1."),
    Rule("multiple-h1", "structure", "low", "Several main headings", "Keep one h1."),
    Rule("heading-level-skip", "structure", "low", "Headings skip a level", "Go down one level at a time."),
    Rule("empty-heading", "structure", "low", "Empty heading", "Fill the heading or remove it."),
    Rule("broken-internal-link", "links", "high", "A link of the site is broken", "Change the link or restore its target."),
    Rule("unverified-link", "links", "info", "A link could not be verified", "Look at it by hand."),
    Rule("internal-link-redirect", "links", "low", "A link of the site redirects", "Link to the final address."),
    Rule("insecure-internal-link", "links", "low", "Links of the site use http", "Link over https."),
    Rule("broken-external-link", "links", "low", "A link to another site is broken", "Change or remove the link."),
    Rule("empty-anchor-text", "links", "low", "Links without a name", "Give links a text."),
    Rule("generic-anchor-text", "links", "info", "Link texts that say nothing", "Say where the link leads."),
    Rule("potential-orphan-page", "links", "low", "No page seems to link here", "Link to the page."),
    Rule("no-internal-outlinks", "links", "low", "The page links to no other of the site", "Link to related pages."),
    Rule("internal-nofollow", "links", "info", "Links of the site are marked nofollow", "Check that this is meant."),
    Rule("links-not-checked", "links", "info", "Not all links were checked", "Raise the limit of link checks."),
    Rule("image-missing-alt", "images", "medium", "Images without an alt text", "Describe the image, or write an empty alt for decoration."),
    Rule("image-empty-alt", "images", "info", "Images with an empty alt text", "Check that they are decoration."),
    Rule("image-missing-dimensions", "images", "low", "Images without dimensions", "State width and height."),
    Rule("invalid-json-ld", "structured_data", "medium", "JSON-LD that cannot be read", "Mend its syntax."),
    Rule("json-ld-missing-context", "structured_data", "low", "JSON-LD without @context", "State the @context."),
    Rule("json-ld-missing-type", "structured_data", "low", "JSON-LD without @type", "State the @type."),
    Rule("no-structured-data", "structured_data", "low", "No structured data", "Add JSON-LD."),
    Rule("non-json-ld-structured-data", "structured_data", "info", "Structured data as microdata or RDFa", "JSON-LD is easier to keep."),
]
BY_ID = {rule.id: rule for rule in RULES}
ISSUE = ["audit_id", "rule_id", "category", "severity", "confidence", "prevalence", "affected_urls", "evidence", "details"]


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity)


def issue_columns(rule_id: str, confidence, evidence, affected=None, details=None, severity=None, prevalence=None) -> list[Column]:
    """The columns of an issue of that rule: confidence to three places, prevalence to four and at most 1, details as JSON."""
    rule = BY_ID[rule_id]
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    kept = F.coalesce(severity, F.lit(rule.severity)) if severity is not None else F.lit(rule.severity)
    return [
        F.lit(rule.id).alias("rule_id"), F.lit(rule.category).alias("category"), kept.alias("severity"),
        F.bround(column(confidence).cast("double"), 3).alias("confidence"),
        (F.bround(F.least(prevalence.cast("double"), F.lit(1.0)), 4) if prevalence is not None else F.lit(None).cast("double")).alias("prevalence"),
        (affected if affected is not None else F.array().cast("array<string>")).alias("affected_urls"),
        column(evidence).cast("string").alias("evidence"),
        (F.to_json(details) if details is not None else F.lit("{}")).alias("details"),
    ]


def issues(rows: DataFrame, rule_id: str, confidence, evidence, affected=None, **more) -> DataFrame:
    """One issue of the rule for each row of rows (audit_id, ...)."""
    return rows.select("audit_id", *issue_columns(rule_id, confidence, evidence, affected, **more))


def listed(values: Column, limit: int = 5) -> Column:
    """The first distinct values, and how many more there are."""
    once = F.array_distinct(values)
    more = F.size(once) - limit
    return F.concat(F.array_join(F.slice(once, 1, limit), ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""))


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))


def in_order(*columns: str) -> Column:
    """Rows of a group as structs in the order of their first column."""
    return F.array_sort(F.collect_list(F.struct(*columns)))
