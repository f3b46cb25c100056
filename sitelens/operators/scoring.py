"""Coverage and scores: what each category could see, what its findings cost, the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import http

from .catalogue import CATEGORIES, SEVERITIES, rank
from .views import Views

# Weights of the categories and of the severities, and the least weight of scored
# categories for an overall score.
CATEGORY_WEIGHTS = {"technical": 25, "metadata": 20, "structure": 15, "links": 20, "images": 10, "structured_data": 10}
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.75, "medium": 0.4, "low": 0.15, "info": 0.0}
LEAST_WEIGHT = 50


def looked_up(key: Column, table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def with_prevalence(found: DataFrame, audited: DataFrame) -> DataFrame:
    """Issues with their prevalence: as stated, else 1 for the site as a whole, else the share of audited pages affected. audited: (audit_id, pages)."""
    share = F.least(F.lit(1.0), F.size("affected_urls") / F.greatest(F.coalesce("pages", F.lit(0)), F.lit(1)))
    rows = found.join(audited.select("audit_id", "pages"), "audit_id", "left")
    return rows.withColumn("prevalence", F.coalesce("prevalence", F.when(F.size("affected_urls") == 0, 1.0).otherwise(share))).drop("pages")


def deductions(found: DataFrame) -> DataFrame:
    """(audit_id, category, rule_id, severity, issues, penalty, points) of issues (audit_id, category, rule_id, severity, confidence, prevalence): what each rule costs, 1 at most; rules that cost nothing drop out.

    The penalty is rounded to four places, the points come from what it was before.
    """
    part = looked_up(F.col("severity"), SEVERITY_WEIGHTS) * F.col("confidence") * F.col("prevalence")
    sums = found.groupBy("audit_id", "category", "rule_id").agg(F.least(F.lit(1.0), F.sum(part)).alias("raw"), F.min_by("severity", rank(F.col("severity"))).alias("severity"), F.count("*").alias("issues")).where("raw > 0")
    return sums.select("audit_id", "category", "rule_id", "severity", "issues", F.bround("raw", 4).alias("penalty"), F.bround(looked_up(F.col("category"), CATEGORY_WEIGHTS) * F.col("raw"), 2).alias("points"), "raw")


def rule_penalties(found: DataFrame) -> DataFrame:
    """(audit_id, category, rule_id, penalty), not rounded."""
    return deductions(found).select("audit_id", "category", "rule_id", F.col("raw").alias("penalty"))


def failed_items(found: DataFrame) -> DataFrame:
    """(audit_id, category, failed): distinct pages that findings of weight concern; link targets for links; the site as one."""
    target = F.get_json_object("details", "$.target")
    items = F.when(F.col("category") == "links", F.when(target.isNotNull(), F.array(target)).otherwise(F.array().cast("array<string>"))).when(F.size("affected_urls") == 0, F.array(F.lit("(site)"))).otherwise(F.col("affected_urls"))
    return found.where("severity <> 'info'").select("audit_id", "category", F.explode(items).alias("item")).groupBy("audit_id", "category").agg(F.count_distinct("item").alias("failed"))


def measured(v: Views) -> DataFrame:
    """A row an audit with what was crawled, audited, left out and linked."""
    lost = http.unretrieved(F.col("status_code"), F.col("error"), F.col("error_kind"))
    crawled = v.pages.groupBy("audit_id").agg(F.count("*").alias("crawled"), F.count_if(lost).alias("unretrieved"))
    audited = v.audited.groupBy("audit_id").agg(F.count("*").alias("pages"), F.count_if("content.is_shell").alias("shells"), F.sum(F.size("content.images")).alias("images"))
    pending = v.pending.groupBy("audit_id").agg(F.count("*").alias("pending"))
    out = v.audits.select("audit_id", "stop_reason", *(["check_external"] if "check_external" in v.audits.columns else [F.lit(False).alias("check_external")]))
    for part in (crawled, audited, pending, v.link_coverage):
        out = out.join(part, "audit_id", "left")
    return out.fillna(0)


def coverage(v: Views, found: DataFrame) -> DataFrame:
    """(audit_id, category, status, unit, applicable, checked, failed, reason) for each audit and category.

    not-scored: nothing was checked, or less than could not be measured; partial: something was
    left out; not-applicable: there is nothing of the kind.
    """
    m = measured(v)
    c = F.col
    zero = F.lit(0)
    gap = F.when(c("unretrieved") > 0, F.format_string("%d pages could not be retrieved", "unretrieved"))
    left = F.when(c("stop_reason").isNotNull(), F.concat(F.lit("crawl stopped: "), "stop_reason")).when(c("pending") > 0, F.format_string("%d addresses not crawled", "pending"))
    waiting = F.when(c("pending") > 0, left)
    shells = F.when(c("shells") > 0, F.format_string("%d of %d pages need JavaScript", "shells", "pages"))
    outside = F.col("check_external")
    plus = lambda name: c(f"internal{name}") + F.when(outside, c(f"external{name}")).otherwise(0)
    targets, checked, unsure = plus(""), plus("_checked"), plus("_unverifiable")
    doubts = F.concat_ws("; ", F.when(unsure > 0, F.format_string("%d link targets could not be verified", unsure)), F.when(checked + unsure < targets, F.format_string("%d link targets not checked", targets - checked - unsure)))

    def row(category, unit, applicable, checked, unmeasured, reason, nothing=None):
        return F.struct(F.lit(category).alias("category"), F.lit(unit).alias("unit"), applicable.cast("long").alias("applicable"), checked.cast("long").alias("checked"), unmeasured.cast("long").alias("unmeasured"), F.nullif(reason, F.lit("")).alias("reason"), (nothing if nothing is not None else F.lit(False)).alias("nothing"))

    by_page = [row(k, "pages", c("pages") + c("unretrieved") + c("pending"), c("pages") - c("shells"), c("shells") + c("unretrieved"), F.concat_ws("; ", shells, gap, waiting)) for k in ("metadata", "structure", "structured_data")]
    rows = F.array(
        row("technical", "URLs", c("crawled") + c("pending"), c("crawled") - c("unretrieved"), c("unretrieved"), F.concat_ws("; ", gap, left)),
        *by_page,
        row("links", "link targets", targets, checked, unsure, doubts, targets == 0),
        row("images", "images", c("images"), c("images"), zero, F.concat_ws("; ", gap, waiting), c("images") == 0),
    )
    rows = m.select("audit_id", "pages", F.explode(rows).alias("x")).select("audit_id", "pages", "x.*").join(failed_items(found), ["audit_id", "category"], "left")
    none = c("pages") == 0
    status = F.when(none, "not-scored").when(c("nothing"), "not-applicable").when((c("checked") <= 0) | (c("checked") < c("unmeasured")), "not-scored").when(c("reason").isNotNull(), "partial").otherwise("scored")
    empty = none | (status == "not-applicable")
    shown = lambda name: F.when(empty, 0).otherwise(F.coalesce(c(name), F.lit(0)))
    why = F.when(none, "no page could be audited").when(status == "not-applicable", F.concat(F.lit("no "), "unit")).when(c("checked") <= 0, F.coalesce("reason", F.lit("nothing was checked"))).otherwise(c("reason"))
    return rows.select("audit_id", "category", status.alias("status"), "unit", shown("applicable").alias("applicable"), F.greatest(shown("checked"), zero).alias("checked"), F.when(c("checked") <= 0, 0).otherwise(shown("failed")).alias("failed"), why.alias("reason"), "pages")


def category_scores(found: DataFrame, audits: DataFrame) -> DataFrame:
    """(audit_id, category, max_points, points) for each audit and category, those without findings too; where audits has (category, status), only scored and partial ones have points."""
    weights = found.sparkSession.createDataFrame(list(CATEGORY_WEIGHTS.items()), "category string, max_points int")
    lost = deductions(found).groupBy("audit_id", "category").agg(F.sum("penalty").alias("lost"))
    known = "status" in audits.columns
    rows = audits.select("audit_id", "category", "status").join(F.broadcast(weights), "category") if known else audits.select("audit_id").distinct().crossJoin(F.broadcast(weights)).withColumn("status", F.lit("scored"))
    left = 1 - F.least(F.lit(1.0), F.coalesce("lost", F.lit(0.0)))
    points = F.when(F.col("status").isin("scored", "partial"), F.bround(F.col("max_points") * left, 1))
    return rows.join(lost, ["audit_id", "category"], "left").select("audit_id", "category", "max_points", points.alias("points"))


def overall(scores: DataFrame) -> DataFrame:
    """(audit_id, score): points of the scored categories over their weight, of 100; null if they weigh too little."""
    sums = scores.groupBy("audit_id").agg(F.sum("points").alias("p"), F.sum(F.when(F.col("points").isNotNull(), F.col("max_points"))).alias("w"))
    return sums.select("audit_id", F.when(F.col("w") >= LEAST_WEIGHT, F.bround(100 * F.col("p") / F.col("w"))).cast("int").alias("score"))


def overall_status(scores: DataFrame, covered: DataFrame) -> DataFrame:
    """(audit_id, score, status, scored_weight): complete, partial, insufficient-coverage, or not-scored where no page was audited."""
    sums = scores.groupBy("audit_id").agg(F.coalesce(F.sum(F.when(F.col("points").isNotNull(), F.col("max_points"))), F.lit(0)).alias("scored_weight"))
    states = covered.groupBy("audit_id").agg(F.max("pages").alias("pages"), F.bool_or(F.col("status").isin("partial", "not-scored")).alias("incomplete"))
    status = F.when(F.col("pages") == 0, "not-scored").when(F.col("scored_weight") < LEAST_WEIGHT, "insufficient-coverage").when(F.col("incomplete"), "partial").otherwise("complete")
    return overall(scores).join(sums, "audit_id").join(states, "audit_id").select("audit_id", F.when(F.col("pages") > 0, F.col("score")).alias("score"), status.alias("status"), F.when(F.col("pages") == 0, 0).otherwise(F.col("scored_weight")).cast("int").alias("scored_weight"))


def crawl_states(v: Views) -> DataFrame:
    """(audit_id, state, reasons): failed without an audited page, partial with any reason, else complete."""
    m = measured(v)
    lost = http.unretrieved(F.col("status_code"), F.col("error"), F.col("error_kind"))
    kinds = v.pages.where(lost).groupBy("audit_id", F.coalesce("error_kind", F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).alias("kind")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    kinds = kinds.groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "kind", "n"))).alias("k"))
    unchecked = v.unchecked.groupBy("audit_id").agg(F.count("*").alias("unchecked"))
    unsure = v.link_checks.where(~http.definitive(F.col("status_code"), F.col("error_kind"))).groupBy("audit_id").agg(F.count("*").alias("unsure"))
    files = v.sitemap_files.where("not guessed and not valid").select("audit_id").distinct().withColumn("file_failed", F.lit(True))
    start = v.audits.select("audit_id", F.col("start_url").alias("url"), "checked", "url_limit", "file_limit").join(v.page_index, ["audit_id", "url"], "left").join(v.skipped.select("audit_id", "url", "reason"), ["audit_id", "url"], "left")
    rows = m.join(start.drop("url"), "audit_id").join(kinds, "audit_id", "left").join(unchecked, "audit_id", "left").join(unsure, "audit_id", "left").join(files, "audit_id", "left")
    c = F.col
    why = F.when(c("page.error").isNotNull(), F.concat(F.lit("start page failed: "), c("page.error_kind"))).when(c("page").isNotNull(), F.concat(F.lit("start page answered HTTP "), c("page.status_code"))).when(c("reason").isNotNull(), F.concat(F.lit("start page skipped: "), "reason")).otherwise("no page could be fetched")
    limits = c("checked") & (c("url_limit") | c("file_limit") | F.coalesce("file_failed", F.lit(False)))
    reasons = F.array_compact(F.array(
        F.when(c("pages") == 0, why), F.when(c("stop_reason").isNotNull(), F.concat(F.lit("crawl stopped: "), "stop_reason")), F.when(c("pending") > 0, F.format_string("%d addresses not crawled", "pending")),
        F.when(c("unchecked") > 0, F.format_string("%d link targets not checked", "unchecked")), F.when(c("unsure") > 0, F.format_string("%d link targets could not be verified", "unsure")),
        F.when((c("unretrieved") > 0) & (c("pages") > 0), F.concat(F.format_string("%d of %d pages could not be retrieved (", "unretrieved", "crawled"), F.array_join(F.transform("k", lambda x: F.format_string("%s: %d", x["kind"], x["n"])), ", "), F.lit(")"))),
        F.when(limits, "sitemap read in part"), F.when(c("shells") > 0, "some pages need JavaScript"),
    ))
    state = F.when(c("pages") == 0, "failed").when(F.size(reasons) > 0, "partial").otherwise("complete")
    return rows.select("audit_id", state.alias("state"), reasons.alias("reasons"))


def summary(found: DataFrame, audits: DataFrame) -> DataFrame:
    """(audit_id, kind, name, issues): findings by severity and by category of each audit, those without findings too."""
    names = [("severity", s) for s in SEVERITIES] + [("category", k) for k in CATEGORIES]
    table = F.broadcast(found.sparkSession.createDataFrame(names, "kind string, name string"))
    counts = found.select("audit_id", F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")))).alias("x")).select("audit_id", "x.*").groupBy("audit_id", "kind", "name").agg(F.count("*").alias("issues"))
    return audits.select("audit_id").distinct().crossJoin(table).join(counts, ["audit_id", "kind", "name"], "left").fillna(0, ["issues"])
