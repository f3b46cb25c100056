"""Reports of one audit as JSON, Markdown and plain text, and of many as JSON lines.

A report is small (a run has at most a thousand pages), so those of a few audits are put together
on the driver; json_lines() writes the reports of any number of audits from the executors.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import __version__
from sitelens.audit import Report
from sitelens.functions import http
from sitelens.functions.urls import host_of
from sitelens.operators.catalogue import BY_ID, SEVERITIES, in_order
from sitelens.operators.scoring import LEAST_WEIGHT, SEVERITY_WEIGHTS, deductions, with_prevalence

# How many entries of long lists a report shows.
UNRETRIEVED, PENDING, SITEMAP_URLS, TOP, SHOWN = 50, 20, 1000, 5, 25
LIMITS = [
    "Only technical checks are made; content is not judged.",
    "Pages are read as the server sends them; JavaScript is not run, and findings that it could explain have less confidence.",
    "robots.txt is evaluated for a fixed list of crawlers.",
    "JSON-LD is checked for syntax, @context and @type only.",
    "Findings describe the crawled pages only, and predict no ranking.",
]
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f​-‏‪-‮⁦-⁩]")


def plain(value, limit: int | None = None) -> str:
    """Text without line ends, control characters and marks that turn its direction."""
    text = _CONTROL.sub("", re.sub(r"[\r\n\t]+", " ", str(value)))
    return text if limit is None or len(text) <= limit else text[: max(limit - 3, 0)] + "..."


def markdown(value, limit: int | None = None) -> str:
    """Text that Markdown shows as it is, in tables too."""
    text = plain(value, limit).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"[\\`*_\[\]|~]", lambda m: "\\" + m.group(), text)


def code(value, limit: int | None = None) -> str:
    return "`" + plain(value, limit).replace("`", "'") + "`"


def plain_column(text: Column) -> Column:
    """plain() as a column."""
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), _CONTROL.pattern, "")


def page_rows(r: Report) -> DataFrame:
    """One row a crawled page: its answer, what it holds and which rules it meets."""
    found = r.issues.select("audit_id", "rule_id", F.explode("affected_urls").alias("url")).groupBy("audit_id", "url").agg(F.array_sort(F.collect_set("rule_id")).alias("ids"))
    p = r.views.pages.join(r.views.inbound, ["audit_id", "seq"], "left")
    p = p.join(found.select("audit_id", F.col("url").alias("final_url"), F.col("ids").alias("by_final")), ["audit_id", "final_url"], "left")
    p = p.join(found.select("audit_id", F.col("url").alias("requested_url"), F.col("ids").alias("by_requested")), ["audit_id", "requested_url"], "left")
    audited = r.views.audited.select("audit_id", "seq", F.lit(True).alias("audited"))
    p = p.join(audited, ["audit_id", "seq"], "left")
    links, images = F.col("content.links"), F.col("content.images")
    n = lambda array, test: F.size(F.filter(array, test))
    targets = lambda inside: F.array_distinct(F.transform(F.filter(links, lambda x: x["internal"] == F.lit(inside)), lambda x: x["url"]))
    return p.select(
        "audit_id", "seq", F.col("final_url").alias("url"), "requested_url", "status_code", "content_type", F.col("via").alias("discovered_via"), "depth", F.coalesce("audited", F.lit(False)).alias("audited"),
        "redirect_chain", "error", "error_kind", F.coalesce("by_final", "by_requested", F.array().cast("array<string>")).alias("issue_ids"),
        F.get("content.titles", F.lit(0)).alias("title"), F.get("content.descriptions", F.lit(0)).alias("meta_description"), F.col("canonical_raw").alias("canonical"), F.col("content.canonicals").alias("canonicals"), F.col("content.robots_meta").alias("robots_meta"),
        F.col("headers")["x-robots-tag"].alias("x_robots_tag"), "noindex", F.col("directives").alias("robots_directives"), F.col("content.lang").alias("lang"),
        F.when(F.col("has_content"), F.struct(F.col("content.is_shell").alias("likely_client_rendered"), F.col("content.text_length").alias("visible_text_length"), F.col("content.render_signals").alias("signals"))).alias("rendering"),
        F.col("content.head_anomalies").alias("head_anomalies"), F.transform(F.filter("content.headings", lambda h: h["level"] == 1), lambda h: h["text"]).alias("h1s"), F.col("content.headings").alias("headings"),
        F.when(F.col("has_content"), F.struct(n(links, lambda x: x["internal"]).alias("internal"), F.size(targets(True)).alias("internal_unique"), n(links, lambda x: ~x["internal"]).alias("external"), n(links, lambda x: F.array_contains(x["rel"], "nofollow")).alias("nofollow"), targets(True).alias("internal_targets"), targets(False).alias("external_targets"))).alias("links"),
        F.when(F.col("has_content"), F.coalesce("inbound", F.lit(0))).alias("inbound_internal_links"),
        F.when(F.col("has_content"), F.struct(F.size(images).alias("total"), n(images, lambda i: i["alt"].isNull()).alias("missing_alt"), n(images, lambda i: i["alt"].isNotNull() & (F.trim(i["alt"]) == "")).alias("empty_alt"), n(images, lambda i: (F.coalesce(i["width"], F.lit("")) == "") | (F.coalesce(i["height"], F.lit("")) == "")).alias("missing_dimensions"))).alias("images"),
        F.transform("content.json_ld", lambda b: F.struct(b["types"].alias("types"), b["error"].isNull().alias("valid"), b["error"].alias("error"))).alias("structured_data"), F.col("content.has_microdata").alias("has_microdata"), F.col("content.has_rdfa").alias("has_rdfa"),
    )


def report_rows(r: Report, generated_at: str | None = None) -> DataFrame:
    """One row an audit with the sections of its report as columns."""
    v = r.views
    now = generated_at or datetime.now(timezone.utc).isoformat(timespec="seconds")
    listed = lambda rows, name, *columns: rows.groupBy("audit_id").agg(in_order(*columns).alias(name))
    ranked = r.issues.withColumn("o", F.struct(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity")).alias("a"), (-F.size("affected_urls")).alias("b"), F.col("rule_id").alias("c")))
    parts = [
        r.states, r.overall.withColumnRenamed("status", "score_status"),
        listed(ranked, "issues", "o", "rule_id", "category", "severity", "confidence", "prevalence", "affected_urls", "evidence", "details"),
        listed(page_rows(r), "pages", "seq", *(c for c in page_rows(r).columns if c not in ("audit_id", "seq"))),
        listed(r.coverage.join(r.scores, ["audit_id", "category"]), "categories", "category", "points", "max_points", "status", "unit", "applicable", "checked", "failed", "reason"),
        listed(deductions(with_prevalence(r.issues, v.audited.groupBy("audit_id").agg(F.count("*").alias("pages")))).withColumn("o", -F.col("points")), "deductions", "o", "category", "rule_id", "severity", "issues", "penalty", "points"),
        listed(r.summary, "summary", "kind", "name", "issues"), listed(r.access, "crawlers", "crawler", "root_allowed", "start_allowed", "rule_group", "rule", "explicit_group"),
        listed(r.types.withColumn("o", -F.col("pages")), "types", "o", "type", "pages"), listed(v.sitemap_files, "sitemap_files", "pos", "url", "source", "status", "valid", "kind", "url_count", "error", "parse_error", "invalid", "duplicates", "cross_host", "children"),
        listed(v.sitemap_urls, "sitemap_urls", "pos", "url"), listed(v.pending, "pending", "pos", "url"), listed(v.skipped, "skipped", "pos", "url", "reason"), listed(v.unchecked, "unchecked", "pos", "url"),
        v.link_checks.groupBy("audit_id").agg(F.count("*").alias("links_checked")),
    ]
    lost = v.pages.where(http.unretrieved(F.col("status_code"), F.col("error"), F.col("error_kind")))
    parts.append(listed(lost.withColumn("why", F.coalesce("error_kind", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))), "unretrieved", "seq", "requested_url", "why", "status_code"))
    out = v.audits.withColumn("generated_at", F.lit(now))
    for part in parts:
        out = out.join(part, "audit_id", "left")
    return out


def _items(rows, *drop) -> list[dict]:
    return [{k: x for k, x in row.asDict(recursive=True).items() if k not in ("o", "seq", "pos", *drop)} for row in rows or []]


def assembled(row) -> dict:
    """The report of a row of report_rows()."""
    a = row.asDict()
    issues = [{**i, "id": i["rule_id"], "title": BY_ID[i["rule_id"]].title, "recommendation": BY_ID[i["rule_id"]].advice, "affected_url": (i["affected_urls"] or [None])[0], "details": json.loads(i["details"])} for i in _items(a["issues"])]
    deducted: dict[str, list] = {}
    for d in _items(a["deductions"]):
        deducted.setdefault(d.pop("category"), []).append(d)
    urls = [x["url"] for x in a["sitemap_urls"] or []]
    pages = _items(a["pages"])
    start = next((p for p in pages if a["start_url"] in (p["requested_url"], p["url"])), None)
    files = _items(a["sitemap_files"])
    return {
        "schema_version": "1.0", "project": "sitelens", "version": __version__, "generated_at": a["generated_at"],
        "target": {"url": a["start_url"], "normalized_url": a["start_url"], "final_url": start and start["url"]},
        "crawl": {
            "state": a["state"], "state_reasons": a["reasons"], "start_url": a["start_url"], "site_url": a["site_url"], "pages_crawled": len(pages), "pages_audited": sum(p["audited"] for p in pages),
            "pages_unretrieved": len(a["unretrieved"] or []), "unretrieved": [{"url": u["requested_url"], "reason": u["why"], "status_code": u["status_code"]} for u in (a["unretrieved"] or [])[:UNRETRIEVED]],
            "pages_client_rendered": sum(bool(p["rendering"] and p["rendering"]["likely_client_rendered"]) for p in pages if p["audited"]), "max_pages": a["max_pages"], "limit_reached": bool(a["pending"]) and a["stop_reason"] is None,
            "stop_reason": a["stop_reason"], "crawl_delay_seconds": a["crawl_delay"], "pending_urls": len(a["pending"] or []), "pending_sample": [x["url"] for x in (a["pending"] or [])[:PENDING]], "skipped": _items(a["skipped"]),
            "links_checked": a["links_checked"] or 0, "links_unchecked": len(a["unchecked"] or []), "settings": {k: a[k] for k in ("respect_robots", "check_external", "max_link_checks", "max_external_checks", "max_crawl_delay", "max_bytes", "max_redirects")},
        },
        "score": {
            "status": a["score_status"], "overall": a["score"], "max": 100, "scored_weight": a["scored_weight"], "min_scored_weight": LEAST_WEIGHT, "model": {"severity_weights": SEVERITY_WEIGHTS},
            "categories": {c["category"]: {"score": c["points"], "max": c["max_points"], "coverage": {k: c[k] for k in ("status", "unit", "applicable", "checked", "failed", "reason")}, "deductions": deducted.get(c["category"], [])} for c in _items(a["categories"])},
        },
        "summary": {"issues_total": len(issues), **{f"by_{kind}": {s["name"]: s["issues"] for s in a["summary"] or [] if s["kind"] == kind} for kind in ("severity", "category")}},
        "issues": issues, "pages": pages,
        "robots": {"url": a["robots_url"], "state": a["robots_state"], "exists": a["robots_state"] == "parsed", "status_code": a["robots_status"], "content_type": a["robots_type"], "error": a["robots_error"], "crawlers": _items(a["crawlers"]), "content": (a["robots_text"] or "")[:20_000] if a["robots_text"] is not None else None},
        "sitemap": {"checked": a["checked"], "found": any(f["valid"] for f in files), "files": files, "url_count": len(urls), "urls": urls[:SITEMAP_URLS], "urls_truncated": len(urls) > SITEMAP_URLS, "url_limit_reached": a["url_limit"], "file_limit_reached": a["file_limit"]},
        "structured_data": {"types": {t["type"]: t["pages"] for t in a["types"] or []}}, "limitations": LIMITS,
    }


def reports(r: Report, audit_ids: list[str], generated_at: str | None = None) -> list[dict]:
    """The reports of these audits, on the driver."""
    rows = report_rows(r, generated_at).where(F.col("audit_id").isin(audit_ids)).collect()
    return [assembled(row) for row in sorted(rows, key=lambda x: x["audit_id"])]


def json_lines(r: Report, path: str, generated_at: str | None = None) -> None:
    """One JSON line an audit, for any number of audits, with the sections as report_rows() has them."""
    report_rows(r, generated_at).write.mode("errorifexists").json(path)


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n"


def to_markdown(report: dict) -> str:
    """The report in nine sections."""
    crawl, score, issues = report["crawl"], report["score"], report["issues"]
    counts = ", ".join(f"{n} {s}" for s, n in report["summary"]["by_severity"].items() if n) or "none"
    grade = f"**{score['overall']}/100** ({score['status']})" if score["overall"] is not None else f"not computed ({score['status']})"
    weighty = [i for i in issues if i["severity"] != "info"]
    table = lambda head, rows: "\n".join([" | ".join(["", *head, ""]).strip(), "|" + "---|" * len(head), *("| " + " | ".join(map(str, x)) + " |" for x in rows)])
    sections = [
        f"# Site audit\n\n- Target: {code(report['target']['url'])}\n- Generated: {markdown(report['generated_at'])}",
        "\n".join([f"## Summary\n\nScore: {grade}. State: **{crawl['state']}**" + (f" ({markdown('; '.join(crawl['state_reasons']))})" if crawl["state_reasons"] else "") + f".\n\nFindings: {len(issues)} ({counts}).", "", *(f"{n}. **{markdown(i['title'])}** ({i['severity']}): {markdown(i['evidence'], 200)}" for n, i in enumerate(weighty[:TOP], 1))]),
        "## Score\n\n" + table(["Category", "Points", "Of", "Coverage"], [(k, "-" if c["score"] is None else c["score"], c["max"], markdown(f"{c['coverage']['checked']}/{c['coverage']['applicable']} {c['coverage']['unit']}, {c['coverage']['status']}")) for k, c in score["categories"].items()]),
        f"## Crawl\n\n{crawl['pages_crawled']} pages crawled, {crawl['pages_audited']} audited, {crawl['pages_unretrieved']} not retrieved, {crawl['pending_urls']} left.",
        "## Issues\n\n" + "\n".join(f"- **{markdown(i['title'])}** ({i['severity']}, confidence {i['confidence']}): {markdown(i['evidence'], 300)}" for i in issues),
        "## Recommendations\n\n" + "\n".join(f"- {markdown(x)}" for x in dict.fromkeys(i["recommendation"] for i in weighty)),
        "## robots.txt and sitemap\n\n" + table(["Crawler", "Root", "Start page", "Rule"], [(c["crawler"], c["root_allowed"], c["start_allowed"], code(c["rule"]) if c["rule"] else "-") for c in report["robots"]["crawlers"]]) + f"\n\n{report['sitemap']['url_count']} addresses in {len(report['sitemap']['files'])} sitemap files.",
        "## Pages\n\n" + table(["Page", "Status", "Title", "Findings"], [(code(p["url"], 100), p["status_code"], markdown(p["title"] or "", 60), len(p["issue_ids"])) for p in report["pages"]]),
        "## Limits\n\n" + "\n".join(f"- {x}" for x in report["limitations"]),
    ]
    return "\n\n".join(s.rstrip() for s in sections) + "\n"


def to_text(report: dict, show_info: bool = False) -> str:
    """The report for a terminal: at most 25 issues, notes only if wanted."""
    crawl, score = report["crawl"], report["score"]
    lines = [f"Site audit of {plain(report['target']['url'], 120)}", f"  pages  {crawl['pages_crawled']} crawled, {crawl['pages_audited']} audited", f"  state  {crawl['state']}" + (f": {plain('; '.join(crawl['state_reasons']), 160)}" if crawl["state_reasons"] else ""), f"  score  {score['overall'] if score['overall'] is not None else 'none'} ({score['status']})"]
    for name, c in score["categories"].items():
        lines.append(f"    {name:<16} {'-' if c['score'] is None else c['score']:>5} of {c['max']:<3} {c['coverage']['checked']}/{c['coverage']['applicable']} {c['coverage']['unit']}")
    shown = [i for i in report["issues"] if show_info or i["severity"] != "info"]
    lines += [f"  {i['severity'].upper():<8} {plain(i['title'], 60)}: {plain(i['evidence'], 120)}" for i in shown[:SHOWN]]
    if len(shown) > SHOWN:
        lines.append(f"  ... and {len(shown) - SHOWN} more")
    return "\n".join(lines) + "\n"


def folder_name(url: str) -> str:
    return re.sub(r"[^A-Za-z0-9.-]", "_", re.sub(r"^https?://", "", url).split("/")[0]) or "site"


__all__ = ["assembled", "code", "folder_name", "host_of", "json_lines", "markdown", "page_rows", "plain", "plain_column", "report_rows", "reports", "to_json", "to_markdown", "to_text"]
