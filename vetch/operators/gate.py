"""Counts, readiness, the review queue, blockers of generation, artifact checks and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .findings import MUST, SHOULD

# What an artifact of each kind must have.
CHECKS = {
    "document": [("sections", "Every section states its sources."), ("dates", "Every number has a dated source."), ("claims", "Every claim has source attribution.")],
    "report": [("sections", "Every section states its sources."), ("dates", "Every number has a dated source."), ("claims", "Every claim has source attribution."), ("conflicts", "No source conflict is open.")],
    "deck": [("slides", "Every slide's claims have source attribution."), ("charts", "Every chart names its data."), ("notes", "Notes don't contradict slides.")],
    "workbook": [("formulas", "Calculations are formulas."), ("hidden", "No sheet is hidden."), ("checks", "There is a checks sheet.")],
    "mixed": [("claims", "Every claim has source attribution."), ("formulas", "Calculations are formulas."), ("conflicts", "No source conflict is open.")],
}


def counts(findings: DataFrame) -> DataFrame:
    """One row, also where there are no findings: blocking, needs_review."""
    return findings.agg(F.count_if(F.col("severity") == MUST).alias("blocking"), F.count_if(F.col("severity") == SHOULD).alias("needs_review"))


def readiness(findings: DataFrame) -> DataFrame:
    state = F.when(F.col("blocking") > 0, "blocked").when(F.col("needs_review") > 0, "review-required").otherwise("ready")
    return counts(findings).select(state.alias("state"), "blocking", "needs_review")


def review_queue(findings: DataFrame) -> DataFrame:
    """The findings in the order of the work: severity, place, id."""
    return findings.orderBy(F.when(F.col("severity") == MUST, 0).otherwise(1), "location", "finding_id")


def artifact_spec(spark: SparkSession, kind: str) -> DataFrame:
    if kind not in CHECKS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(CHECKS)}")
    return spark.createDataFrame([(kind, c, e) for c, e in CHECKS[kind]], "kind string, check_id string, expectation string")


def blockers(conflicts: DataFrame, sources: DataFrame, generated: DataFrame, unsupported: DataFrame) -> DataFrame:
    """What keeps a receipt from being written: conflicts of selected sources, unsupported claims, numbers of undated sources, no claims at all."""
    chosen = sources.where("selected").select(F.col("name").alias("source"))
    hit = conflicts.select("conflict_id", F.explode("sources").alias("source")).join(chosen, "source", "left_semi").select("conflict_id").distinct()
    a = hit.select(F.lit("selected source conflict").alias("blocker"), F.col("conflict_id").alias("subject"))
    b = unsupported.select(F.lit("unsupported claim").alias("blocker"), F.col("claim_id").alias("subject"))
    c = generated.where("source_date is null and size(numbers) > 0").select(F.lit("undated numeric claim").alias("blocker"), F.col("generated_id").alias("subject"))
    d = generated.where("not selected").select(F.lit("claim rests on an excluded source").alias("blocker"), F.col("generated_id").alias("subject"))
    e = generated.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no generated claim").alias("blocker"), F.lit("receipt").alias("subject"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).distinct()


def receipt(generated: DataFrame, shown: int = 3) -> DataFrame:
    """A line for each claim: dense lists of evidence become a count and the first pointers; the full lists stay in JSON."""
    g = generated.groupBy("claim_id", "text").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence"), F.array_sort(F.collect_set("source_name")).alias("sources"), F.array_sort(F.collect_set(F.struct("evidence_id", "source_id", "source_name", "source_date"))).alias("cited"))
    return g.select("claim_id", "text", F.size("evidence").alias("n_evidence"), F.slice("evidence", 1, shown).alias("pointers"), "evidence", "sources", "cited")


def receipt_sources(sources: DataFrame, generated: DataFrame) -> DataFrame:
    """Every source of the packet with its id and date, how many claims of the receipt rest on it, and why it was excluded if it was."""
    rests = generated.groupBy("source_id").agg(F.count_distinct("claim_id").alias("claims"))
    s = sources.select("source_id", "name", "source_date", "selected", "excluded_reason")
    return s.join(rests, "source_id", "left").withColumn("claims", F.coalesce("claims", F.lit(0).cast("long")))


def next_action(findings: DataFrame) -> DataFrame:
    """The first of the queue, or that nothing is left."""
    first = review_queue(findings).limit(1).select(F.concat_ws(": ", "severity", "location", "issue").alias("next_action"))
    return first
