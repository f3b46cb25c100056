"""Page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.tables import settled

_HEAD = """concat(
  if(page_id % 3 = 0, concat('<meta name="description" content="About ', page_id % 5, '">'), ''),
  case page_id % 4 when 0 then concat('<link rel="canonical" href="/c/', page_id, '">') when 1 then '<link rel="canonical" href="https://other.example/x">' else '' end,
  if(page_id % 7 = 0, '<meta name="robots" content="noindex, follow">', ''),
  case page_id % 5 when 0 then '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article"}</script>' when 1 then '<script type="application/ld+json">{"@type": bad}</script>' else '' end)"""
_BODY = """concat('<article>',
  if(page_id % 6 = 0, '<h2>A</h2><h4>B</h4>', ''),
  if(page_id % 2 = 0, '<img src="/a.png" width="10" height="10">', '<img src="/b.png" alt="">'),
  if(page_id % 9 = 0, '<a href="/more">click here</a>', ''))"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def decorated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with descriptions, canonicals, images and the like, by page_id, for checks that plain pages never meet."""
    html = F.replace(F.replace("html", F.lit("</head>"), F.concat(F.expr(_HEAD), F.lit("</head>"))), F.lit("<article>"), F.expr(_BODY))
    return pages(spark, sf_dir).withColumn("html", html)


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decorated pages as captured answers of one audit a host, all over https: pages by page_id % 13 fail or redirect, a home page links to
    four of five, robots.txt keeps GPTBot out and everyone off /blocked/, and a sitemap lists two of three and all that are not linked."""
    from sitelens.functions.urls import host_of, normalized

    rows = decorated_pages(spark, sf_dir).withColumn("url", F.regexp_replace(normalized("url"), "^http:", "https:")).where("url is not null")
    rows = rows.withColumn("audit_id", host_of(F.col("url"))).withColumn("home", F.concat(F.lit("https://"), "audit_id", F.lit("/"))).where("url <> home")
    rows = rows.groupBy("audit_id", "home", "url").agg(F.min(F.struct("page_id", "html")).alias("first")).select("audit_id", "home", "url", "first.*").withColumn("p", F.col("page_id") % 13)
    rows = settled(rows, "captured")  # eight parts read it, and many tables those
    path = lambda name: F.concat(F.lit(f"/{name}-"), F.col("page_id").cast("string"))
    at = lambda name: F.concat(F.expr("substring(home, 1, length(home) - 1)"), path(name))
    own = F.expr("case when p = 1 then 404 when p in (2, 5, 6) then 301 when p = 3 then 500 when p = 4 then 403 else 200 end")
    leads = F.when(F.col("p") == 2, path("moved")).when(F.col("p") == 5, path("hop")).when(F.col("p") == 6, path("loop"))

    def answer(df, url, status, html, location=None, kind="text/html"):
        location = F.lit(None).cast("string") if location is None else location
        headers = F.map_filter(F.create_map(F.lit("content-type"), F.lit(kind), F.lit("location"), location), lambda _, v: v.isNotNull())
        return df.select("audit_id", url.alias("url"), F.lit(status).cast("int").alias("status_code") if isinstance(status, int) else status.cast("int").alias("status_code"), headers.alias("headers"), F.encode(html, "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_kind"))

    none = F.lit("")
    parts = [
        answer(rows, F.col("url"), own, F.when(own == 200, F.col("html")).otherwise(none), leads), answer(rows.where("p = 2"), at("moved"), 200, F.col("html")),
        answer(rows.where("p = 5"), at("hop"), 302, none, path("end")), answer(rows.where("p = 5"), at("end"), 200, F.col("html")), answer(rows.where("p = 6"), at("loop"), 301, none, path("loop")),
    ]
    in_order = lambda cond, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("page_id", "url")))), text), "")
    link = lambda x: F.concat(F.lit('<a href="'), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit('">page '), x["page_id"].cast("string"), F.lit("</a> "))
    loc = lambda x: F.concat(F.lit("<url><loc>"), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    hosts = rows.groupBy("audit_id", "home").agg(in_order(F.col("page_id") % 5 != 4, link).alias("links"), in_order((F.col("page_id") % 3 != 0) | (F.col("page_id") % 5 == 4), loc).alias("locs"))
    hosts = settled(hosts, "hosts")
    page = F.concat(F.lit("<html><head><title>All pages of the site</title></head><body><h1>All</h1><p><a href='/blocked/x'>blocked</a> "), "links", F.lit("</p></body></html>"))
    rules = F.concat(F.lit("User-agent: *\nDisallow: /blocked/\n\nUser-agent: GPTBot\nDisallow: /\n\nSitemap: "), "home", F.lit("sitemap.xml\n"))
    parts += [
        answer(hosts, F.col("home"), 200, page), answer(hosts, F.concat("home", F.lit("robots.txt")), 200, rules, kind="text/plain"),
        answer(hosts, F.concat("home", F.lit("sitemap.xml")), 200, F.concat(F.lit("<urlset>"), "locs", F.lit("</urlset>")), kind="application/xml"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
