"""Findings: every rule gives severity, location and issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import workbook

MUST, SHOULD = "must_fix", "should_fix"
RISKY = r"(?i)\b(never|always|not any|guaranteed?|no risk|cannot fail)\b"


def _found(df: DataFrame, rule: str, severity: str, location: Column, issue: Column | str, source: Column | None = None, subject: Column | None = None) -> DataFrame:
    """Findings of one rule; ``subject`` tells apart what shares a place, such as claims."""
    text = F.lit(issue) if isinstance(issue, str) else issue
    source, subject = (F.lit(None) if c is None else c for c in (source, subject))
    out = df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), location.alias("location"), text.alias("issue"), source.cast("string").alias("source_id"), subject.cast("string").alias("subject"))
    return out.distinct().select(X.content_id("finding", *[F.col(c) for c in ("rule_id", "location", "issue", "source_id", "subject")]).alias("finding_id"), "*")


def source_findings(sources: DataFrame) -> DataFrame:
    at, sid = F.concat(F.lit("source:"), F.col("name")), F.col("source_id")
    return union(
        _found(sources.where("number_bearing and source_date is null"), "undated_numbers", MUST, at, "Number-bearing source has no source date.", sid),
        _found(sources.where("status = 'unclear'"), "unclear_status", SHOULD, at, "Source status is unclear.", sid),
        _found(sources.where("not consistent and role = 'data_export'"), "ragged_rows", SHOULD, at, "Rows of the data file differ in length.", sid),
        _found(sources.where("ext = 'pdf' and inspection = 'no text'"), "scanned_pdf", MUST, at, "PDF has no extractable text: it needs OCR or replacement.", sid),
        _found(sources.where("inspection like 'unreadable%'"), "unreadable", MUST, at, "Source could not be read.", sid),
    )


def workbook_findings(facts: DataFrame) -> DataFrame:
    at = F.concat(F.lit("workbook:"), F.col("name"))
    sheet, sid = F.concat(at, F.lit(":"), F.col("sheet")), F.col("source_id")
    return union(
        _found(workbook.hardcodes(facts), "hardcodes", MUST, at, "Hardcoded numbers appear in calculation-like zones.", sid),
        _found(workbook.hidden_sheets(facts), "hidden_sheet", SHOULD, sheet, "Workbook contains a hidden sheet.", sid),
        _found(workbook.without_checks(facts), "no_checks", SHOULD, at, "No checks sheet detected.", sid),
        _found(workbook.repeated_formulas(facts).join(facts.select("source_id", "name").distinct(), "source_id"), "repeated_formula", SHOULD, sheet, "A static formula is repeated.", sid),
    )


def conflict_findings(conflicts: DataFrame) -> DataFrame:
    names = F.array_join("sources", ", ")
    issue = F.when(F.col("kind") == "version", F.concat(F.lit("Potential version/status conflict across: "), names)).otherwise(F.concat(F.lit("Metric "), F.col("metric"), F.lit(" differs across: "), names))
    return _found(conflicts, "conflict", MUST, F.lit("source-conflict"), issue, subject=F.col("conflict_id"))


def claim_findings(claims: DataFrame, support: DataFrame, empty_drafts: DataFrame) -> DataFrame:
    bare = claims.join(support, "claim_id", "left_anti")
    at, claim = F.lit("section-map"), F.col("claim_id")
    return union(
        _found(bare, "no_attribution", MUST, at, "Claim has no source attribution.", subject=claim),
        _found(claims.where(F.col("text").rlike(RISKY)), "risky_claim", SHOULD, at, "Claim states an absolute.", subject=claim),
        _found(bare.where(F.size("numbers") > 0), "unsourced_number", SHOULD, at, "Claim has a number without a source.", subject=claim),
        _found(empty_drafts, "empty_draft", MUST, F.concat(F.lit("source:"), F.col("name")), "Declared draft yields no extractable claims.", F.col("source_id")),
    )


def number_findings(contradicted: DataFrame) -> DataFrame:
    """A finding for each amount of a claim that evidence gives otherwise."""
    issue = F.concat(F.lit("Claim says "), F.col("amount"), F.lit(", evidence "), F.col("evidence_id"), F.when(F.col("relation") == "outdated", " later says ").otherwise(" says "), F.col("other"), F.lit("."))
    return _found(contradicted, "risky_number", SHOULD, F.lit("section-map"), issue, subject=F.col("claim_id"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def clean_sources(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Sources without a finding."""
    return sources.join(findings, "source_id", "left_anti")
