"""Captured answers: the exchanges of many crawls as tables.

responses(audit_id, url, status_code, headers, body, error, error_kind): one raw answer an address,
redirects not followed. audits(audit_id, start_url, ...): one row a run, with its limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import http
from sitelens.functions.urls import resolved
from sitelens.sources.tables import settled

RESPONSES = "audit_id string, url string, status_code int, headers map<string,string>, body binary, error string, error_kind string"
# The default limits of a run.
LIMITS = {"max_pages": 20, "max_link_checks": 50, "check_external": False, "max_external_checks": 25, "respect_robots": True, "max_sitemaps": 10, "max_sitemap_urls": 50_000, "max_crawl_delay": 30.0, "max_bytes": 5_000_000, "max_redirects": 5}


def audits_of(spark, starts: list[tuple[str, str]], **limits) -> DataFrame:
    """audits for (audit_id, start_url) pairs; limits as in LIMITS."""
    rows = spark.createDataFrame(starts, "audit_id string, start_url string")
    return with_limits(rows, **limits)


def with_limits(audits: DataFrame, **limits) -> DataFrame:
    unknown = set(limits) - set(LIMITS)
    if unknown or limits.get("max_pages", 1) < 1 or any(isinstance(v, (int, float)) and v < 0 for v in limits.values()):
        raise ValueError(f"limits out of range: {sorted(unknown) or limits}")
    return audits.select("*", *(F.lit(v).alias(k) for k, v in (LIMITS | limits).items() if k not in audits.columns))


def followed(responses: DataFrame, max_redirects: int = 5) -> DataFrame:
    """(audit_id, requested_url, final_url, status_code, redirect_chain, error, error_kind) of each address, redirects followed.

    Each round joins what still redirects with the answer it leads to, so there are max_redirects
    + 1 joins of shrinking tables at most, and bodies stay out of them. Answers and each round are
    written, so that no round is done again for the next. An address that comes again
    is a redirect-loop, one too many too-many-redirects, a Location that means no http(s) address
    invalid-redirect; a target that was not captured counts as a connection failure. These have no
    status and end where they failed.
    """
    location = F.col("headers")["location"]
    answers = responses.select("audit_id", "url", "status_code", "error", "error_kind", F.when(F.col("status_code").isin(http.REDIRECTS), location).alias("location"))
    answers = answers.withColumn("next", F.when(F.col("location").isNotNull(), resolved(F.col("location"), F.col("url"))))
    answers = settled(answers, "answered")
    hop = F.struct(F.col("url"), F.col("status_code"))
    state = answers.select("audit_id", F.col("url").alias("requested_url"), "url", "status_code", "error", "error_kind", "location", "next", F.array().cast("array<struct<url:string,status_code:int>>").alias("chain"))
    done = []
    light = ["audit_id", "requested_url", F.col("url").alias("final_url"), "status_code", F.col("chain").alias("redirect_chain"), "error", "error_kind"]
    for _ in range(max_redirects + 1):
        done.append(state.where("location is null").select(*light))
        moving = state.where("location is not null").withColumn("chain", F.array_append("chain", hop))
        kind = (
            F.when(F.col("next").isNull(), "invalid-redirect")
            .when(F.exists("chain", lambda h: h["url"] == F.col("next")), "redirect-loop")
            .when(F.size("chain") > max_redirects, "too-many-redirects")
        )
        moving = moving.withColumn("failed", kind)
        lost = moving.where("failed is not null").withColumn("error_kind", F.col("failed")).withColumn("error", F.replace("failed", F.lit("-"), F.lit(" "))).withColumn("status_code", F.lit(None).cast("int"))
        done.append(lost.select(*light))
        to = answers.select(F.col("audit_id").alias("a"), F.col("url").alias("u"), *(F.col(c).alias(f"{c}_") for c in ("status_code", "error", "error_kind", "location", "next")))
        moving = moving.where("failed is null")
        if moving.isEmpty():
            break
        state = moving.join(to, (F.col("audit_id") == F.col("a")) & (F.col("next") == F.col("u")), "left")
        absent = F.col("u").isNull()
        state = state.select(
            "audit_id", "requested_url", F.col("next").alias("url"), F.col("status_code_").alias("status_code"),
            F.when(absent, "not captured").otherwise(F.col("error_")).alias("error"), F.when(absent, "connection").otherwise(F.col("error_kind_")).alias("error_kind"),
            F.col("location_").alias("location"), F.col("next_").alias("next"), "chain",
        )
        state = settled(state, "hops")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
