"""The audit: from captured answers to issues, coverage and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import checks, scoring
from sitelens.operators.views import Views, views
from sitelens.sources.captured import with_limits
from sitelens.sources.tables import settled


@dataclass
class Report:
    """All results of a set of audits, as lazy tables keyed by audit_id."""

    views: Views
    issues: DataFrame
    coverage: DataFrame
    scores: DataFrame
    overall: DataFrame
    states: DataFrame
    types: DataFrame
    access: DataFrame
    summary: DataFrame


def build_report(v: Views, analyzers=()) -> Report:
    found = settled(checks.all_issues(v, analyzers), "issues")
    pages = v.audited.groupBy("audit_id").agg(F.count("*").alias("pages"))
    weighed = scoring.with_prevalence(found, pages)
    covered = settled(scoring.coverage(v, found), "coverage")
    scores = settled(scoring.category_scores(weighed, covered), "scores")
    return Report(v, found, covered, scores, scoring.overall_status(scores, covered), scoring.crawl_states(v), checks.type_inventory(v), checks.crawler_access(v), scoring.summary(found, v.audits))


def run_audits(audits: DataFrame, responses: DataFrame, **limits) -> Report:
    """Audits (audit_id, start_url normalized) replayed over captured responses, many sites at once."""
    return build_report(views(with_limits(audits, **limits), responses))
