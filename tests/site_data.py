"""A small captured site, and helpers to capture others."""

from __future__ import annotations

from sitelens.sources.captured import RESPONSES

BASE = "http://127.0.0.1:8000"


def page(title="", head="", body=""):
    title = f"<title>{title}</title>" if title else ""
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">{title}{head}</head><body>{body}</body></html>'


def described(text):
    return f'<meta name="description" content="{text}">'


def canonical(path):
    return f'<link rel="canonical" href="{BASE}{path}">'


ABOUT, HOME, WORK = "The people of Sample Ltd", "Sample Ltd - moving and finding work abroad", "What we do for people who move."
PAGES = {
    "/": page(HOME, described("Sample Ltd helps people move.") + canonical("/") + '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Organization"}</script>', """
      <h1>Moving, done well</h1><a href="/">Start</a> <a href="/about.html">About</a> <a href="services.html">Work</a> <a href="/duplicate.html#x">Team</a> <a href="/print.html">Print</a>
      <a href="/contact.html">Contact</a> <a href="/old-page">Overview</a> <a href="/private/x.html">Members</a> <a href="/noindex.html">Thanks</a> <a href="/about.html?utm_source=m">Click here</a>
      <a href="https://other.example/">Others</a> <img src="/a.jpg" alt="People" width="8" height="6"> <img src="/b.jpg">"""),
    "/about.html": page(ABOUT, canonical("/about.html"), '<h1>About</h1><h1>Why</h1><img src="/c.png" alt="" width="6" height="4"><img src="/d.jpg" alt="House"><a href="/">Back</a> <a href="/services.html">Work</a>'),
    "/services.html": page("", described(WORK) + '<script type="application/ld+json">{ "@context": "https://schema.org", "@type": "Service", }</script>', '<h1>Work</h1><h2>Moving</h2><h4>Papers</h4><h3></h3><a href="/"><img src="/e.svg" alt=""></a> <a href="/about.html">About</a>'),
    "/duplicate.html": page(ABOUT, described(WORK) + canonical("/duplicate.html"), '<h1>Team</h1><a href="/">Start</a>'),
    "/print.html": page(HOME, described("Sample Ltd helps people move.") + canonical("/"), '<h1>Moving, done well</h1><a href="/">Full page</a>'),
    "/noindex.html": page("Thanks - Sample Ltd", '<meta name="robots" content="noindex, follow">' + described("Thanks."), '<h1>Thanks</h1><a href="/">Start</a>'),
    "/orphan.html": page("A guide to papers - Sample Ltd", described("Which papers one needs.") + canonical("/orphan.html"), '<h1>Papers</h1><a href="/">Start</a>'),
}
LISTED = ["/", "/about.html", "/about.html", "/services.html", "/orphan.html", "/noindex.html", "/old-page", "/gone.html", "/private/x.html"]
SITEMAP = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{BASE}{x}</loc></url>" for x in LISTED) + "<url><loc>no url at all</loc></url></urlset>"

#: The findings of the site: rule and pages.
EXPECTED = {
    ("broken-internal-link", ("/",)), ("crawled-page-error", ("/contact.html",)), ("missing-title", ("/services.html",)), ("duplicate-title", ("/about.html", "/duplicate.html")),
    ("image-missing-alt", ("/",)), ("invalid-json-ld", ("/services.html",)), ("sitemap-url-error", ("/gone.html",)), ("sitemap-url-noindex", ("/noindex.html",)), ("sitemap-url-disallowed", ()),
    ("duplicate-meta-description", ("/duplicate.html", "/services.html")), ("empty-anchor-text", ("/services.html",)), ("empty-heading", ("/services.html",)), ("heading-level-skip", ("/services.html",)),
    ("image-missing-dimensions", ("/",)), ("image-missing-dimensions", ("/about.html",)), ("image-missing-dimensions", ("/services.html",)), ("internal-link-redirect", ("/",)), ("missing-canonical", ("/services.html",)),
    ("missing-meta-description", ("/about.html",)), ("multiple-h1", ("/about.html",)), ("potential-orphan-page", ("/orphan.html",)), ("sitemap-url-redirects", ("/old-page",)), ("sitemap-duplicate-urls", ()),
    ("sitemap-invalid-urls", ()), ("canonicalized-to-other-url", ("/print.html",)), ("generic-anchor-text", ("/",)), ("https-not-used", ("/",)), ("image-empty-alt", ("/about.html",)), ("image-empty-alt", ("/services.html",)),
    ("noindex-page", ("/noindex.html",)), ("page-not-in-sitemap", ("/duplicate.html",)), ("linked-url-disallowed", ()),
}


def answer(audit_id, url, status=200, body="", kind="text/html; charset=utf-8", error=None, error_kind=None, **headers):
    headers = {k.replace("_", "-"): v for k, v in headers.items()} | ({"content-type": kind} if kind else {})
    return (audit_id, url, status, headers, body if isinstance(body, (bytes, bytearray)) else body.encode(), error, error_kind)


def sample_site(audit_id="sample"):
    rows = [answer(audit_id, BASE + path, body=html) for path, html in PAGES.items()]
    rows += [answer(audit_id, f"{BASE}/contact.html", 404), answer(audit_id, f"{BASE}/gone.html", 404), answer(audit_id, f"{BASE}/old-page", 301, location="/about.html")]
    rows.append(answer(audit_id, f"{BASE}/robots.txt", body=f"User-agent: *\nDisallow: /private/\n\nSitemap: {BASE}/sitemap.xml\n", kind="text/plain"))
    rows.append(answer(audit_id, f"{BASE}/sitemap.xml", body=SITEMAP, kind="application/xml"))
    return rows


def captured(spark, rows):
    return spark.createDataFrame(rows, RESPONSES)
