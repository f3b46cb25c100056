"""The tables that checks read, derived from a replayed crawl."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import http
from sitelens.functions.robots import blocked_for_search
from sitelens.functions.urls import host_of, resolved

from sitelens.sources.tables import settled

from .crawl import replayed

_FLAGS = "struct<checked:boolean,url_limit:boolean,file_limit:boolean,crawl_delay:double,site_url:string,robots_url:string,robots_state:string,robots_text:string,stop_reason:string,robots_status:int,robots_error:string,robots_type:string>"
_FILE = "struct<status:int,error:string,error_kind:string,kind:string,invalid:array<string>,duplicates:array<string>,cross_host:array<string>,parse_error:string,html:boolean,url_count:int,children:array<string>>"


@dataclass
class Views:
    """audits: a row a run with its limits, site, robots.txt and sitemap flags. pages: all crawled
    ones in order (seq). The other tables are keyed by audit_id and derived on first use."""

    audits: DataFrame
    pages: DataFrame
    sitemap_files: DataFrame
    sitemap_urls: DataFrame
    link_checks: DataFrame
    skipped: DataFrame
    pending: DataFrame
    unchecked: DataFrame
    kept: dict = field(default_factory=dict)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = settled(make(), name)
        return self.kept[name]

    @property
    def audited(self) -> DataFrame:
        """Pages with content, the first of each final address."""
        first = Window.partitionBy("audit_id", "final_url").orderBy("seq")
        return self._once("audited", lambda: self.pages.where("content is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"))

    @property
    def page_index(self) -> DataFrame:
        """(audit_id, url, page): each crawled page under its requested and its final address; the first page wins."""

        def make():
            page = F.struct("seq", "requested_url", "final_url", "status_code", "error", "error_kind", "redirect_chain", "has_content", "noindex_any", "noindex_for", "canonical", "canonical_raw")
            both = self.pages.select("audit_id", page.alias("page"), F.explode(F.array(F.struct(F.col("requested_url").alias("url"), F.lit(0).alias("last")), F.struct(F.col("final_url").alias("url"), F.lit(1).alias("last")))).alias("k"))
            return both.groupBy("audit_id", F.col("k.url").alias("url")).agg(F.min_by("page", F.struct(F.col("page.seq"), F.col("k.last"))).alias("page"))

        return self._once("page_index", make)

    @property
    def target_status(self) -> DataFrame:
        """(audit_id, url, status_code, final_url, redirected, error, error_kind) of each crawled or checked address; a crawled page goes first."""

        def make():
            crawled = self.page_index.select("audit_id", "url", F.lit(0).alias("from"), "page.status_code", "page.final_url", ((F.size("page.redirect_chain") > 0) & (F.col("page.requested_url") == F.col("url"))).alias("redirected"), "page.error", "page.error_kind")
            checked = self.link_checks.select("audit_id", "url", F.lit(1).alias("from"), "status_code", "final_url", (F.size("redirect_chain") > 0).alias("redirected"), "error", "error_kind")
            rest = checked.join(crawled.select("audit_id", "url"), ["audit_id", "url"], "left_anti")
            return crawled.unionByName(rest).drop("from")

        return self._once("target_status", make)

    @property
    def links(self) -> DataFrame:
        """(audit_id, seq, pos, source, requested_url, url, raw_href, text, folded, rel, internal, on_site): the links of audited pages in order."""

        def make():
            rows = self.audited.select("audit_id", "seq", F.col("final_url").alias("source"), "requested_url", "site_host", F.posexplode("content.links").alias("pos", "x"))
            return rows.select("audit_id", "seq", "pos", "source", "requested_url", "x.*", (host_of(F.col("x.url")) == F.col("site_host")).alias("on_site"))

        return self._once("links", make)

    @property
    def inlinks(self) -> DataFrame:
        """(audit_id, url, source): which audited pages link to an address of their host; no page to itself."""
        rows = self.links.where("internal and url <> source and url <> requested_url")
        return self._once("inlinks", lambda: rows.select("audit_id", "url", "source").distinct())

    @property
    def inbound(self) -> DataFrame:
        """(audit_id, seq, inbound): how many pages link to each audited page, by its requested or final address."""

        def make():
            keys = self.audited.select("audit_id", "seq", "final_url", F.explode(F.array_distinct(F.array("requested_url", "final_url"))).alias("url"))
            found = keys.join(self.inlinks, ["audit_id", "url"]).where("source <> final_url")
            return found.groupBy("audit_id", "seq").agg(F.count_distinct("source").alias("inbound"))

        return self._once("inbound", make)

    @property
    def link_targets(self) -> DataFrame:
        """(audit_id, url, on_site, ruled_out, answered, definitive): the distinct targets of audited pages but for links to themselves."""

        def make():
            targets = self.links.where("url <> source and url <> requested_url").groupBy("audit_id", "url").agg(F.first("on_site").alias("on_site"))
            ruled = self.skipped.where("reason like 'robots%'").select("audit_id", "url", F.lit(True).alias("ruled_out"))
            status = self.target_status.select("audit_id", "url", F.lit(True).alias("answered"), http.definitive(F.col("status_code"), F.col("error_kind")).alias("definitive"))
            out = targets.join(ruled, ["audit_id", "url"], "left").join(status, ["audit_id", "url"], "left")
            return out.fillna(False, ["ruled_out", "answered", "definitive"])

        return self._once("link_targets", make)

    @property
    def link_coverage(self) -> DataFrame:
        """A row an audit with the seven counts of its link targets."""

        def make():
            n = lambda cond, name: F.count_if(cond).alias(name)
            ruled, inside, known, sure = F.col("ruled_out"), F.col("on_site"), F.col("answered"), F.col("definitive")
            return self.link_targets.groupBy("audit_id").agg(
                n(~ruled & inside, "internal"), n(~ruled & inside & known & sure, "internal_checked"), n(~ruled & inside & known & ~sure, "internal_unverifiable"),
                n(~ruled & ~inside, "external"), n(~ruled & ~inside & known & sure, "external_checked"), n(~ruled & ~inside & known & ~sure, "external_unverifiable"), n(ruled, "not_applicable"),
            )

        return self._once("link_coverage", make)


def with_directives(pages: DataFrame) -> DataFrame:
    """pages with what follows from their content and headers: directives, noindex, canonicals."""
    tag = F.col("headers")["x-robots-tag"]
    meta = F.coalesce(F.col("content.robots_meta"), F.array().cast("array<struct<name:string,content:string>>"))
    pages = pages.withColumn("directives", http.directives(meta, tag))
    of = lambda agent: F.filter("directives", lambda d: d["agent"] == agent)[0]["directives"]
    pages = pages.withColumn("noindex", F.array_contains(of("all"), "noindex")).withColumn("nofollow", F.array_contains(of("all"), "nofollow"))
    agents = F.filter(F.array(*(F.lit(a) for a in http.INDEXERS)), lambda a: F.exists("directives", lambda d: (d["agent"] == a) & F.array_contains(d["directives"], "noindex")))
    pages = pages.withColumn("noindex_for", F.when(F.col("noindex"), F.array(F.lit("all crawlers"))).otherwise(agents)).withColumn("noindex_any", F.size("noindex_for") > 0)
    hrefs = F.coalesce(F.col("header_canonicals"), F.array().cast("array<string>"))
    head = F.transform(F.filter("content.canonicals", lambda c: c["source"] == "head"), lambda c: c["href"])
    pages = pages.withColumn("header_hrefs", hrefs).withColumn("head_hrefs", F.coalesce(head, F.array().cast("array<string>")))
    pages = pages.withColumn("named", F.size("head_hrefs") + F.size("header_hrefs") > 0).withColumn("canonical_raw", F.get(F.when(F.size("head_hrefs") > 0, F.col("head_hrefs")).otherwise(F.col("header_hrefs")), F.lit(0)))
    return pages.withColumn("canonical", F.when(F.col("canonical_raw") != "", resolved(F.col("canonical_raw"), F.col("final_url")))).withColumn("has_content", F.col("content").isNotNull())


def views(audits: DataFrame, responses: DataFrame, max_bytes: int = 5_000_000) -> Views:
    """The views of a crawl replayed over captured responses. audits: with limits, see sources.captured."""
    rows, answers = replayed(audits, responses, max_bytes)
    rows = settled(rows, "replay")
    run = rows.where("kind = 'audit'").select("audit_id", F.from_json("extra", _FLAGS).alias("f")).select("audit_id", "f.*")
    audits = settled(audits.join(run, "audit_id").withColumn("site_host", host_of(F.col("site_url"))), "audits")
    of = lambda kind: rows.where(F.col("kind") == kind)
    plain = lambda kind: of(kind).select("audit_id", "pos", "url")
    known = answers.withColumnRenamed("requested_url", "url")
    pages = of("page").select("audit_id", F.col("pos").alias("seq"), "url", "via", "depth").join(known, ["audit_id", "url"], "left").withColumnRenamed("url", "requested_url")
    absent = F.col("final_url").isNull()
    pages = pages.withColumn("error", F.when(absent, "not captured").otherwise(F.col("error"))).withColumn("error_kind", F.when(absent, "connection").otherwise(F.col("error_kind"))).withColumn("final_url", F.coalesce("final_url", "requested_url"))
    pages = pages.join(audits.select("audit_id", "start_url", "site_url", "site_host"), "audit_id")
    own = (F.regexp_extract("final_url", "^https?://[^/?]*", 0) == F.regexp_extract("site_url", "^https?://[^/?]*", 0)) & F.col("html") & ~F.col("too_large")
    pages = pages.withColumn("content", F.when(own, F.col("facts"))).withColumn("redirect_chain", F.coalesce("redirect_chain", F.array().cast("array<struct<url:string,status_code:int>>")))
    pages = pages.withColumn("is_start", (F.col("requested_url") == F.col("start_url")) | F.col("final_url").isin(F.col("start_url"), F.col("site_url")))
    files = of("sitemap").select("audit_id", "pos", "url", F.col("via").alias("source"), F.from_json("extra", _FILE).alias("f")).select("audit_id", "pos", "url", "source", "f.*")
    fetched = F.col("error").isNull() & http.is_success(F.col("status"))
    files = files.withColumn("fetched", fetched).withColumn("valid", fetched & F.col("parse_error").isNull()).withColumn("guessed", F.col("source") == "default")
    checks = of("check").select("audit_id", "url").join(known, ["audit_id", "url"], "left")
    checks = checks.select("audit_id", "url", "status_code", F.coalesce("final_url", "url").alias("final_url"), F.coalesce("redirect_chain", F.array().cast("array<struct<url:string,status_code:int>>")).alias("redirect_chain"), F.when(F.col("final_url").isNull(), "not captured").otherwise(F.col("error")).alias("error"), F.when(F.col("final_url").isNull(), "connection").otherwise(F.col("error_kind")).alias("error_kind"))
    pages, files, checks = settled(with_directives(pages), "pages"), settled(files, "files"), settled(checks, "checks")
    return Views(audits, pages, files, plain("sitemap_url"), checks, of("skipped").select("audit_id", "pos", "url", "reason"), plain("pending"), plain("unchecked"))


def plain_views(pages: DataFrame) -> Views:
    """Views of parsed pages alone (page_id, url, facts): each an answer 200 found by a link; audits are hosts, their start page is the home page."""
    from sitelens.functions.urls import normalized

    spark = pages.sparkSession
    rows = pages.withColumn("final_url", normalized("url")).where("final_url is not null").withColumn("audit_id", host_of(F.col("final_url")))
    facts = [c for c in pages.columns if c not in ("page_id", "url")]
    rows = rows.select("audit_id", F.col("page_id").alias("seq"), F.col("final_url").alias("requested_url"), "final_url", F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit("link").alias("via"), F.lit(1).alias("depth"), F.struct(*facts).alias("content"), F.create_map().cast("map<string,string>").alias("headers"), F.array().cast("array<string>").alias("header_canonicals"), F.array().cast("array<struct<url:string,status_code:int>>").alias("redirect_chain"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_kind"), F.col("audit_id").alias("site_host"))
    audits = rows.select("audit_id").distinct().select("audit_id", F.concat(F.lit("https://"), "audit_id", F.lit("/")).alias("start_url"), F.concat(F.lit("https://"), "audit_id", F.lit("/")).alias("site_url"), F.lit(None).cast("string").alias("stop_reason"))
    rows = rows.join(audits.select("audit_id", "start_url", "site_url"), "audit_id").withColumn("is_start", F.col("final_url") == F.col("start_url"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    listed = "audit_id string, pos int, url string"
    checks = none("audit_id string, url string, status_code int, final_url string, redirect_chain array<struct<url:string,status_code:int>>, error string, error_kind string")
    return Views(settled(audits, "audits"), settled(with_directives(rows), "pages"), none(f"{listed}, source string"), none(listed), checks, none(f"{listed}, reason string"), none(listed), none(listed))


def blocked(rows: DataFrame, v: Views, url: Column) -> DataFrame:
    """rows (audit_id, ...) with `agents`: the search crawlers that robots.txt keeps from url; none without rules."""
    rules = v.audits.select("audit_id", "robots_text")
    return rows.join(rules, "audit_id").withColumn("agents", F.when(F.col("robots_text").isNotNull(), blocked_for_search(F.col("robots_text"), url)).otherwise(F.array().cast("array<string>")))
