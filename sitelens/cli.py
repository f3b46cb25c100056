"""Command line: audit a site from captured answers.

    python -m sitelens.cli https://example.com --responses captured.parquet --output reports

Exit codes: 0 audited, 1 nothing could be audited, 2 wrong use, 3 unexpected failure, 130 interrupted.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

OK, FAILED, USAGE, CRASHED, INTERRUPTED = 0, 1, 2, 3, 130


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitelens", description="Audit a site from captured answers.")
    p.add_argument("url", help="absolute http(s) address of the start page")
    p.add_argument("--responses", required=True, help="Parquet table of captured answers (see sitelens.sources.captured)")
    p.add_argument("--max-pages", "-n", type=int, default=20)
    p.add_argument("--output", "-o", type=Path, help="folder for audit.json and audit.md")
    p.add_argument("--format", "-f", choices=["terminal", "json", "markdown"], default="terminal")
    p.add_argument("--quiet", "-q", action="store_true")
    p.add_argument("--max-link-checks", type=int, default=50)
    p.add_argument("--max-external-checks", type=int, default=25)
    p.add_argument("--max-page-bytes", type=int, default=5_000_000)
    p.add_argument("--max-crawl-delay", type=float, default=30.0)
    p.add_argument("--check-external", action="store_true")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--show-info", action="store_true")
    p.add_argument("--verbose", "-v", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    from sitelens.functions.urls import normalize_url

    start = normalize_url(args.url)
    if start is None or not 1 <= args.max_pages <= 1000 or args.max_link_checks < 0:
        print(f"not an absolute http(s) address, or a limit out of range: {args.url}", file=sys.stderr)
        return USAGE
    try:
        return _audit(args, start, spark)
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception as e:  # the command line reports any failure by its exit code
        logging.getLogger(__name__).exception("audit failed")
        print(f"audit failed: {e}", file=sys.stderr)
        return CRASHED


def _audit(args, start: str, spark) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sitelens.audit import run_audits
    from sitelens.sinks import reports
    from sitelens.sources.captured import audits_of

    folder = args.output / reports.folder_name(start) if args.output else None
    for name in ("audit.json", "audit.md") if folder else ():
        (folder / name).unlink(missing_ok=True)
    spark = spark or SparkSession.builder.appName("sitelens").getOrCreate()
    captured = spark.read.parquet(args.responses).withColumn("audit_id", F.lit("cli"))
    limits = {"max_pages": args.max_pages, "max_link_checks": args.max_link_checks, "max_external_checks": args.max_external_checks, "max_bytes": args.max_page_bytes, "max_crawl_delay": args.max_crawl_delay, "check_external": args.check_external, "respect_robots": not args.ignore_robots}
    report = reports.reports(run_audits(audits_of(spark, [("cli", start)], **limits), captured), ["cli"])[0]
    shown = {"json": reports.to_json, "markdown": reports.to_markdown, "terminal": lambda x: reports.to_text(x, args.show_info)}[args.format](report)
    if not args.quiet:
        print(shown, end="")
    if folder:
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "audit.json").write_text(reports.to_json(report), encoding="utf-8")
        (folder / "audit.md").write_text(reports.to_markdown(report), encoding="utf-8")
    return FAILED if report["crawl"]["state"] == "failed" else OK


if __name__ == "__main__":
    sys.exit(main())
