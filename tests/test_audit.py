from __future__ import annotations

import gzip
import json
import time
import zlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from site_data import BASE, EXPECTED, answer, captured, described, page, sample_site

from sitelens import cli
from sitelens.audit import run_audits
from sitelens.functions import facts, http
from sitelens.functions.facts import decoded, page_facts, parsed, read_json_ld
from sitelens.functions.robots import disallows_everything, parse_robots, ruling, verdict, wildcard_match
from sitelens.functions.sitemaps import SitemapError, parse_sitemap, read_sitemap
from sitelens.functions.urls import has_non_html_extension, normalize_url, path_of_url, same_site
from sitelens.operators import checks, scoring
from sitelens.operators.catalogue import BY_ID, RULES
from sitelens.operators.views import plain_views
from sitelens.sinks import reports
from sitelens.sources.captured import audits_of, followed


@pytest.mark.parametrize(
    ("raw", "base", "expected"),
    [
        ("HTTP://Example.COM:80/a/../b/./c#x", None, "http://example.com/b/c"),
        ("https://example.com", None, "https://example.com/"),
        ("https://example.com/?utm_source=x&a=1&&GCLID=2", None, "https://example.com/?a=1"),
        ("https://example.com/?a&b=&=c&utm_x", None, "https://example.com/?a&b=&=c"),
        ("../up?q=%7eé", "https://example.com/a/b/c", "https://example.com/a/up?q=~%C3%A9"),
        ("//cdn.example.com:8443/x/", "https://example.com/", "https://cdn.example.com:8443/x/"),
        ("https://bücher.example/", None, "https://xn--bcher-kva.example/"),
        ("mailto:a@example.com", None, None),
        ("https://user:pw@example.com/", None, None),
        ("http://[bad", None, None),
        ("https://example.com:99999/", None, None),
        ("ftp://example.com/", None, None),
        (None, None, None),
    ],
)
def test_normalize_url(raw, base, expected):
    assert normalize_url(raw, base) == expected


def test_url_columns(spark):
    rows = spark.createDataFrame([("https://www.a.example/x/file.PDF?q=1", "http://a.example/"), ("https://b.example/page.html", "https://a.example/")], "u string, v string")
    got = rows.select(has_non_html_extension(F.col("u")), same_site(F.col("u"), F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]
    assert path_of_url("https://a.example") == "/" and path_of_url("https://a.example/x?y") == "/x?y"


def test_robots():
    robots = parse_robots("User-agent: *\nDisallow: /a*b$\nAllow: /a/ok\nCrawl-delay: x\nnonsense\n\nUser-agent: GPTBot/1.0\nUser-agent: CCBot\nDisallow: /\nCrawl-delay: 2\nCrawl-delay: 5\nSitemap: https://e.example/s.xml\nHost: e.example\n")
    assert robots.sitemaps == ["https://e.example/s.xml"] and robots.ignored == 1 and [g.crawl_delay for g in robots.groups] == [None, 5.0]
    assert not verdict(robots, "GPTBot", "/a/ok") and verdict(robots, "GPTBot", "/robots.txt") and not verdict(robots, "ccbot", "/x")
    assert not verdict(robots, "Bingbot", "/a/x/b") and verdict(robots, "Bingbot", "/a/x/bc") and verdict(robots, "Bingbot", "/a/ok")
    assert ruling(robots, "Bingbot", "/a/b")[1:3] == ("*", "Disallow: /a*b$")
    assert disallows_everything(robots, "GPTBot") and not disallows_everything(robots, "Bingbot")
    assert not disallows_everything(parse_robots("User-agent: *\nDisallow: /\nAllow: /x"), "Bingbot") and not disallows_everything(parse_robots("User-agent: *\nDisallow: /$"), "Bingbot")
    assert verdict(parse_robots("User-agent: *\nDisallow: /p\nAllow: /p"), "x", "/p")
    for pattern, path, matches in (("/x*y*z$", "/x1y2z", True), ("/x*y*z$", "/x1z2y", False), ("/a*", "/a", True), ("/*.pdf$", "/x.pdfa", False), ("/a*a$", "/a", False), ("*", "/z", True)):
        assert wildcard_match(pattern, path) == matches
    began = time.time()
    wildcard_match("/" + "*a" * 40 + "b", "/" + "a" * 6000)
    assert time.time() - began < 2


def test_facts():
    html = (
        '<html lang="en"><head><base href="/d/"><title> A &amp; b </title><meta name=Description content=" x  y "><link rel=canonical href="/c"></head><body>'
        '<svg><title>no</title></svg><h1>One <b>two</b></h1><h3></h3><a href="p"><img src=i alt="pic"></a><a href="/q" rel="NoFollow">go</a><link rel=canonical href="/late"><a href="mailto:x@y">m</a>'
        '<script type="application/ld+json">{"@context":"x","@graph":[{"@type":["A","B"]},{}]}</script><script>var t="<h1>"</script>'
    )
    got = page_facts(html, "https://e.example/x")
    assert got["titles"] == ["A & b"] and got["descriptions"] == ["x y"] and got["lang"] == "en" and got["base"] == "https://e.example/d/"
    assert [h["text"] for h in got["headings"]] == ["One two", ""]
    assert [(x["url"], x["text"], x["rel"], x["internal"]) for x in got["links"]] == [("https://e.example/d/p", "pic", [], True), ("https://e.example/q", "go", ["nofollow"], True)]
    assert [c["source"] for c in got["canonicals"]] == ["head", "body"] and got["images"][0]["in_link"]
    assert got["json_ld"] == [{"types": ["A", "B"], "error": None, "missing_context": False, "missing_type": True}]
    assert page_facts(None)["titles"] == [] and page_facts("<title>a<b>c</title>")["titles"] == ["a<b>c"]
    assert read_json_ld('{"a": 1,}')["error"] and read_json_ld("[1]")["error"] == "no objects"
    late = page_facts("<head><div></div><link rel=canonical href=x></head><body>")
    assert late["canonicals"][0]["source"] == "head-implicitly-closed" and late["head_anomalies"] == ["<div>"]
    assert decoded("é".encode("latin-1"), "latin-1") == "é" and decoded('<meta charset="latin-1">é'.encode("latin-1"), "no-codec").endswith("é") and decoded(b"\xef\xbb\xbfx") == "x"


def test_texts_are_whole():
    long = " ".join(f"w{i}" for i in range(2000))
    got = page_facts(f"<title>{long}</title><h1>{'<b>x</b>' * 200}</h1><a href='/p'>{long}<br></a><img src='http://[{'s' * 200}'>", "https://e.example/")
    assert got["titles"] == [long] == [got["title_source"]] and got["headings"][0]["text"] == " ".join("x" * 200)
    assert got["links"][0]["text"] == long and got["images"][0]["src"] == f"http://[{'s' * 200}"
    # whole texts still take linear time: a link or heading ends at the next, a title holds its markup as text
    for part in ("<a href=x>x", "<h2><div>x", "<title><b>x", "<noscript>x", "<div id=root>x"):
        began = time.time()
        page_facts(part * 20_000, "https://e.example/")
        assert time.time() - began < 5, part
    assert [x["text"] for x in page_facts("<a href=x>one<a href=y>two</a>", "https://e.example/")["links"]] == ["one", "two"]


def test_shells():
    shell = '<html><body><div id="root"></div><script src="/app.js"></script><noscript>You need JavaScript.</noscript></body></html>'
    assert page_facts(shell)["is_shell"] and {s.split(":")[0] for s in page_facts(shell)["render_signals"]} >= {"empty-mount-element", "empty-body-containers", "noscript-javascript-notice"}
    assert not page_facts('<html><body><p>A small static page.</p><script src="/count.js"></script></body></html>')["is_shell"]


@pytest.mark.parametrize("tag", ["a href=x", "h2", "div", "b"])
def test_nested_markup_takes_linear_time(tag):
    began = time.time()
    page_facts(f"<{tag}>" * 20_000 + "x", "https://e.example/")
    assert time.time() - began < 5


def test_answers():
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert http.retry_after("7", 429, now) == 7 and http.retry_after("Thu, 01 Jan 2026 00:01:00 GMT", 503, now) == 60 and http.retry_after("7", 200, now) is None
    assert http.collect_headers([("Set-Cookie", "a"), ("X-Robots-Tag", "none"), ("x-robots-tag", "nofollow"), ("Vary", "a"), ("vary", "b")]) == {"set-cookie": "[redacted]", "x-robots-tag": "none\nnofollow", "vary": "a, b"}
    body = b"x" * 100_000
    for coding, packed in (("gzip", gzip.compress(body)), ("deflate", zlib.compress(body)), ("deflate", zlib.compress(body)[2:-4]), (None, body)):
        assert http.inflated(packed, coding, 10**6) == (body, True) and http.inflated(packed, coding, 1000) == (body[:1000], False)
    with pytest.raises(http.BodyError):
        http.inflated(body, "gzip, br", 10)
    assert http.is_local_host("a.localhost") and http.is_local_host("[::1]") and not http.is_local_host("example.com") and http.non_public_reason("64:ff9b::808:808") is None and http.non_public_reason("::ffff:10.0.0.1")
    assert http.x_robots("googlebot: noindex, nofollow\nunavailable_after: 1 Jan, none") == {"googlebot": {"noindex", "nofollow"}, "": {"unavailable_after: 1 jan", "none", "noindex", "nofollow"}}
    assert http.link_canonicals('<https://e.x/a,b>; rel="canonical", </c>; rel=next, <>; rel=canonical') == ["https://e.x/a,b"]


def test_sitemaps():
    head = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    got = read_sitemap(head + b"<url><loc> https://e.x/a </loc><loc>https://e.x/no</loc></url><url><loc>https://e.x/a</loc></url><url><loc>b c</loc></url><url><i><loc>https://e.x/i</loc></i></url><url><loc>https://o.x/</loc></url></urlset>", "https://e.x/s")
    assert (got["locs"], got["invalid"], got["duplicates"], got["cross_host"]) == (["https://e.x/a", "https://o.x/"], ["b c"], ["https://e.x/a"], ["https://o.x/"])
    assert parse_sitemap(gzip.compress(b"https://e.x/a\n"), None) == ("text", ["https://e.x/a"]) and parse_sitemap(b"<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>")[0] == "sitemapindex"
    for bad in (b"", b"<!DOCTYPE html>", b"<!DOCTYPE x [<!ENTITY a 'b'>]><urlset/>", b"<rss/>", b"junk", b"<urlset>", b"<urlset>" + b"<a>" * 40, gzip.compress(b"x")[:9]):
        with pytest.raises(SitemapError):
            parse_sitemap(bad)
    with pytest.raises(SitemapError):
        parse_sitemap(gzip.compress(b"https://e.x/" * 1000), None, 1000)


def test_redirects(spark):
    go = lambda url, to, status=301: answer("x", url, status, location=to)
    rows = [go(f"https://e.x/{i}", f"/{i + 1}") for i in range(7)] + [answer("x", "https://e.x/7"), go("https://e.x/l", "/m"), go("https://e.x/m", "/l"), go("https://e.x/bad", "mailto:x"), go("https://e.x/out", "https://o.x/")]
    got = {r.requested_url.rpartition("/")[2]: r for r in followed(captured(spark, rows)).collect()}
    assert got["2"].status_code == 200 and len(got["2"].redirect_chain) == 5 and got["2"].final_url == "https://e.x/7"
    assert (got["1"].error_kind, got["l"].error_kind, got["bad"].error_kind, got["out"].error_kind) == ("too-many-redirects", "redirect-loop", "invalid-redirect", "connection")
    assert got["l"].status_code is None and len(got) == len(rows)


def test_catalogue():
    assert len(RULES) == len(BY_ID) == 83 and sum(r.severity == "info" for r in RULES) == 18


@pytest.fixture(scope="module")
def sample(spark):
    return run_audits(audits_of(spark, [("sample", f"{BASE}/")]), captured(spark, sample_site()))


def test_sample_site(spark, sample):
    found = sample.issues.collect()
    assert {(i.rule_id, tuple(sorted(u.removeprefix(BASE) for u in i.affected_urls))) for i in found} == EXPECTED and len(found) == 32
    assert {r.category: r.points for r in sample.scores.collect()} == {"technical": 18.3, "metadata": 14.0, "structure": 14.1, "links": 17.2, "images": 9.1, "structured_data": 9.4}
    assert [tuple(r)[1:] for r in sample.overall.collect()] == [(82, "complete", 100)] and [tuple(r) for r in sample.states.collect()] == [("sample", "complete", [])]
    links = sample.coverage.where("category = 'links'").first()
    assert (links.applicable, links.checked, links.failed) == (8, 8, 2)
    assert {r.name: r.issues for r in sample.summary.collect() if r.kind == "severity"} == {"critical": 0, "high": 3, "medium": 6, "low": 15, "info": 8}
    assert [(r.type, r.pages) for r in sample.types.collect()] == [("Organization", 1)]


def test_reports(spark, sample):
    report = reports.reports(sample, ["sample"], "2026-01-01T00:00:00+00:00")[0]
    assert len(report) == 14 and report["score"]["overall"] == 82 and report["crawl"]["pages_audited"] == 7 and len(report["pages"]) == 10 and report["sitemap"]["url_count"] == 8
    assert json.loads(reports.to_json(report))["summary"]["issues_total"] == 32 and report["issues"][0]["severity"] == "high"
    assert reports.to_markdown(report).count("\n## ") == 8 and "82 (complete)" in reports.to_text(report)
    assert reports.plain("a\x00b‮c\n d", 6) == "abc  d" and reports.markdown("<a>|*b*") == "&lt;a&gt;\\|\\*b\\*" and reports.code("a`b") == "`a'b`"


def other_sites():
    """Sites that fail in their own ways: audit_id is the way."""
    def at(name, path=""):
        return f"https://{name}.example/{path}"

    ok = page("A title that is long enough", described("x"), "<h1>x</h1><a href='/b'>to the other page</a>")
    rows = []
    for name, status in (("denied", 401), ("limited", 429), ("down", 503), ("absent", 404)):
        rows += [answer(name, at(name), body=ok), answer(name, at(name, "robots.txt"), status), answer(name, at(name, "b"), body=ok.replace("/b", "/"))]
    rows += [answer("html", at("html"), body=ok), answer("html", at("html", "robots.txt"), body="<!doctype html>")]
    rows += [answer("shut", at("shut"), body=ok), answer("shut", at("shut", "robots.txt"), body="User-agent: *\nDisallow: /", kind="text/plain")]
    rows += [answer("bing", at("bing"), body=ok), answer("bing", at("bing", "b"), 200, body=page("B", "<meta name=bingbot content=none>"), x_robots_tag="googlebot: noindex", link='<https://o.example/>; rel="canonical"'), answer("bing", at("bing", "robots.txt"), body="User-agent: Bingbot\nDisallow: /\n\nUser-agent: Googlebot\nDisallow: /b\n\nUser-agent: *\nCrawl-delay: 1", kind="text/plain")]
    rows += [answer("slow", at("slow"), body=ok), answer("slow", at("slow", "robots.txt"), body="User-agent: *\nCrawl-delay: 99", kind="text/plain")]
    shell = '<html><body><div id="root"></div><script src="http://cdn.example/app.js"></script></body></html>'
    rows += [answer("shell", at("shell"), body=shell), answer("shell", at("shell", "robots.txt"), 404)]
    rows += [answer("maps", at("maps"), body=ok), answer("maps", at("maps", "robots.txt"), body=f"Sitemap: {at('maps', 'i.xml')}\nSitemap: {at('maps', 'gone.xml')}\nSitemap: {at('maps', 'bad.xml')}\nSitemap: {at('maps', 'none.xml')}", kind="text/plain")]
    rows += [answer("maps", at("maps", "i.xml"), body=f"<sitemapindex><sitemap><loc>{at('maps', 'c.xml')}</loc></sitemap></sitemapindex>", kind="text/xml"), answer("maps", at("maps", "c.xml"), body="<urlset><url><loc>https://o.example/</loc></url></urlset>", kind="text/xml")]
    rows += [answer("maps", at("maps", "bad.xml"), body="<urlset>", kind="text/xml"), answer("maps", at("maps", "none.xml"), body="<urlset></urlset>", kind="text/xml")]
    rows += [answer("dead", at("dead"), None, error="refused", error_kind="connection"), answer("dead", at("dead", "robots.txt"), None, error="refused", error_kind="connection")]
    rows += [answer("off", at("off"), 301, location="https://elsewhere.example/"), answer("off", "https://elsewhere.example/", body=ok)]
    rows += [answer("moved", at("moved"), 301, location="https://www.moved.example/"), answer("moved", "https://www.moved.example/", body=ok), answer("moved", "https://www.moved.example/b", body="x" * 6_000_000), answer("moved", at("moved", "robots.txt"), 404), answer("moved", "https://www.moved.example/robots.txt", 404)]
    return rows


def test_other_sites(spark):
    rows = other_sites()
    names = sorted({r[0] for r in rows})
    r = run_audits(audits_of(spark, [(n, f"https://{n}.example/") for n in names], max_pages=5, max_link_checks=0), captured(spark, rows))
    found: dict[str, set] = {n: set() for n in names}
    for i in r.issues.collect():
        found[i.audit_id].add(i.rule_id)
        assert 0 <= i.confidence <= 1 and i.evidence.strip() and json.loads(i.details) is not None and (i.prevalence is None or 0 <= i.prevalence <= 1)
    expected = {
        "denied": {"robots-txt-access-denied"}, "limited": {"robots-txt-rate-limited", "start-url-unavailable"}, "down": {"robots-txt-unreachable", "start-url-unavailable"}, "absent": {"robots-txt-missing", "sitemap-missing"},
        "html": {"robots-txt-not-plain-text", "page-fetch-error"}, "shut": {"robots-disallow-all", "robots-ai-crawler-blocked", "start-url-unavailable"},
        "bing": {"robots-search-crawler-blocked", "crawled-page-disallowed", "noindex-page", "canonical-cross-host", "canonical-noindex-conflict"}, "slow": {"crawl-stopped-early", "no-structured-data", "links-not-checked"},
        "shell": {"client-rendered-shell", "mixed-content", "no-structured-data", "missing-title"}, "maps": {"sitemap-inaccessible", "sitemap-invalid", "sitemap-empty", "sitemap-incomplete", "sitemap-cross-host-urls"},
        "dead": {"start-url-unavailable", "robots-txt-unreachable"}, "off": {"start-url-unavailable"}, "moved": {"page-too-large"},
    }
    assert {n: expected[n] - found[n] for n in names} == {n: set() for n in names}
    assert "robots-disallow-all" not in found["bing"] and "sitemap-missing" not in found["dead"] and "page-not-in-sitemap" not in found["maps"]
    capped = {i.rule_id: i.confidence for i in r.issues.where("audit_id = 'shell'").collect()}
    assert capped["missing-title"] == 0.35 and capped["no-structured-data"] == 0.35 and capped["client-rendered-shell"] == 0.9
    states = {x.audit_id: x for x in r.states.collect()}
    assert states["dead"].state == states["off"].state == "failed" and states["slow"].state == "partial" and "crawl stopped: crawl-delay-too-large" in states["slow"].reasons
    scores = {x.audit_id: x for x in r.overall.collect()}
    assert scores["dead"].status == "not-scored" and scores["dead"].score is None and scores["shell"].status == "insufficient-coverage" and scores["absent"].score is not None
    assert {x.audit_id: x.site_url for x in r.views.audits.collect()}["moved"] == "https://www.moved.example/"


def test_more_analyzers_can_be_given(spark):
    from sitelens.audit import build_report
    from sitelens.operators.catalogue import issues

    rows = spark.createDataFrame([(1, "https://e.example/a", "<title>x</title>")], "page_id long, url string, html string")
    v = plain_views(parsed(rows))
    own = lambda views: issues(views.audited, "nofollow-page", 0.5, "said so", F.array("final_url"))
    found = checks.hedged(checks.single_page(v).select(*checks.ISSUE).unionByName(own(v)), v).collect()
    assert "nofollow-page" in {i.rule_id for i in found} and build_report


def test_page_checks_fire(spark):
    rows = [(1, "https://e.example/a", "<title>short</title><h1>x</h1><h3>y</h3><img src=a>"), (2, "https://e.example/b", None), (3, "not a url", "<h1>z</h1>")]
    found = {(r.seq, r.rule_id) for r in checks.single_page(plain_views(parsed(spark.createDataFrame(rows, "page_id long, url string, html string")))).collect()}
    assert {(1, "short-title"), (1, "heading-level-skip"), (1, "image-missing-alt"), (2, "missing-title"), (2, "missing-h1")} <= found and not any(i == 3 for i, _ in found)


def test_duplicates_resolve_canonicals(spark):
    head = "<title>Straße</title>"
    rows = [(1, "https://e.example/a", head), (2, "https://e.example/b", head.replace("Straße", "STRASSE") + "<link rel=canonical href=/a>"), (3, "https://f.example/a", head), (4, "https://f.example/b", head)]
    got = checks.duplicates(plain_views(parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))), "titles", "title_folded").collect()
    assert [(r.audit_id, r.value, len(r.pages)) for r in got] == [("f.example", "strasse", 2)]


def test_scores_come_from_all_pages(spark):
    head = "<title>A title long enough</title><meta name=description content=x><link rel=canonical href='{}'>"
    rows = [(i, f"https://a.example/{i}", (head.format(f"/{i}") if i else "<title>A title long enough</title>") + "<h1>x</h1>") for i in range(4)]
    rows.append((9, "https://clean.example/", head.format("/") + "<h1>x</h1>"))
    v = plain_views(parsed(spark.createDataFrame(rows, "page_id long, url string, html string")))
    found = scoring.with_prevalence(checks.single_page(v, ["missing-meta-description", "missing-canonical"]), v.audited.groupBy("audit_id").agg(F.count("*").alias("pages")))
    assert {(r.audit_id, r.rule_id, r.prevalence) for r in found.collect()} == {("a.example", "missing-meta-description", 0.25), ("a.example", "missing-canonical", 0.25)}
    points = {(r.audit_id, r.category): r.points for r in scoring.category_scores(found, v.audits.select("audit_id")).collect()}
    assert len(points) == 12 and points["clean.example", "metadata"] == 20.0 and points["a.example", "metadata"] == 18.6


def test_cli(spark, tmp_path, capsys):
    captured(spark, sample_site()).write.parquet(str(tmp_path / "captured"))
    args = [f"{BASE}/", "--responses", str(tmp_path / "captured"), "--output", str(tmp_path / "out")]
    assert cli.main(args, spark) == 0 and "82 (complete)" in capsys.readouterr().out
    folder = tmp_path / "out" / "127.0.0.1_8000"
    assert json.loads((folder / "audit.json").read_text())["score"]["overall"] == 82 and (folder / "audit.md").exists()
    assert cli.main(["not a url", "--responses", "x"], spark) == 2 and cli.main(["https://e.example/"], spark) == 2 and cli.main([f"{BASE}/", "--responses", str(tmp_path / "none")], spark) == 3


def test_titles_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from sitelens.plans.audit_queries import ORACLES, QUERIES

    titles = [f"<title>{t}</title>" for t in ("Stra\u00dfe", "strasse", "Strasse", "STRA\u00dfE", " a\n b&amp", "a b&amp", 'q &quot;x&quot; &lt;&amp;', "x" * 301, "x" * 302, "x" * 301, "&#65; &gt;", "")]
    pages = [(i, f"https://e.example/{i}", f"<html><head>{t}</head><body></body></html>") for i, t in enumerate([*titles, "", "<title>open"])] + [(99, "https://e.example/99", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_titles", "duplicate_titles"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall())), name


def test_facts_come_in_pieces():
    # facts of many links take far more room than their pages: a batch is never held as a whole
    import pyarrow as pa

    html = "<a href='/x'>x</a>" * 10_000
    batch = pa.record_batch([pa.array(range(20)), pa.array(["https://e.example/"] * 20), pa.array([html] * 18 + [None, ""]), pa.nulls(20, pa.string())], names=["key", "url", "body", "charset"])
    got = list(facts._facts(iter([batch])))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(20))
    assert max(b.num_rows for b in got) < 10 and sum(len(x["links"]) for b in got for x in b.column(1).to_pylist()) == 180_000


def test_crawl_reads_pages_once_and_without_limits(spark, tmp_path):
    from sitelens.plans import audit_queries
    from sitelens.sources.pages import captured_pages

    pages = [(i, f"http://e.example/{i}", f"<html><head><title>{i}</title></head><body><article></article></body></html>") for i in range(30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    answers = captured_pages(spark, str(tmp_path))
    assert answers.count() > 30 and not any("pages.parquet" in f for f in answers.inputFiles())
    limits = audit_queries._crawl(spark, str(tmp_path)).audits.first()
    assert min(limits.max_pages, limits.max_link_checks, limits.max_sitemap_urls) > 10**9
