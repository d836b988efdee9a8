"""Claims: seeding, review actions, support and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .inspection import CLAIM_KINDS, STATUS_LINE

LEAST_TERMS = 4


def seed(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Unsupported candidates from blocks of text: of the declared drafts where there are any, else of every source.

    Delimited files and workbooks seed none; nor do headings, status lines and blocks of fewer than four terms.
    """
    declared = sources.where("is_draft").select("source_id")
    any_draft = declared.limit(1).select(F.lit(True).alias("declared"))
    s = sources.select("source_id", "name", "is_draft").join(F.broadcast(any_draft), F.lit(True), "left")
    s = s.where("is_draft or declared is null").select("source_id", "name")
    blocks = facts.where(F.col("kind").isin(*CLAIM_KINDS) & ~F.col("text").rlike(STATUS_LINE)).drop("name")
    c = blocks.join(s, "source_id").withColumn("terms", X.terms(F.col("text"))).where(F.size("terms") >= LEAST_TERMS)
    anchor = F.struct("kind", "page", "ordinal", "sheet")
    return c.select(X.content_id("claim", F.col("source_id"), F.col("kind"), F.col("page"), F.col("ordinal"), F.col("cell"), F.col("text")).alias("claim_id"), "source_id", "name", anchor.alias("anchor"), "text", F.lit("seeded").alias("origin"), "terms", X.numbers(F.col("text")).alias("numbers"))


def empty_drafts(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Declared drafts that yield no claim."""
    return sources.where("is_draft").join(claims, "source_id", "left_anti")


def unsupported(claims: DataFrame, support: DataFrame) -> DataFrame:
    return claims.join(support, "claim_id", "left_anti")


def claim_map(claims: DataFrame, support: DataFrame) -> DataFrame:
    """Each claim with its sources and evidence in order; claims without support have empty lists."""
    s = support.groupBy("claim_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"), F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
    none = F.array().cast("array<string>")
    return claims.join(s, "claim_id", "left").select("claim_id", "text", F.coalesce("sources", none).alias("sources"), F.coalesce("evidence", none).alias("evidence"))


def generated(claims: DataFrame, support: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """One generated claim for each accepted support link: the claim's words as they are, with source, date and evidence pointers."""
    e = evidence.select("evidence_id", F.col("source_id").alias("e_source"), "anchor")
    s = sources.select(F.col("source_id").alias("e_source"), F.col("name").alias("source_name"), "source_date", "selected")
    links = support.select("claim_id", "evidence_id", "quote").join(e, "evidence_id").join(s, "e_source")
    out = claims.select("claim_id", "text", "numbers").join(links, "claim_id")
    return out.select(X.content_id("generated", F.col("claim_id"), F.col("evidence_id")).alias("generated_id"), "claim_id", "text", "numbers", "evidence_id", F.col("e_source").alias("source_id"), "source_name", "source_date", "selected", "anchor", "quote")
