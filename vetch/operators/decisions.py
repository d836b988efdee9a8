"""The log of audited review decisions, and what it makes of claims, support, conflicts and findings.

A decision is a row (decision_id, target_kind, target_id, action, actor, rationale, at, payload, content_hash); rows are only added. Of
several decisions on one target the latest counts; of a claim, its whole history (see replayed). An approval holds for the content that it names by hash: on changed
evidence it is void.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.shared import cut

SCHEMA = "decision_id string, target_kind string, target_id string, action string, actor string, rationale string, at timestamp, payload map<string,string>, content_hash string"
# What can be decided on what.
ACTIONS = {"claim": ("create", "edit", "delete", "merge"), "support": ("attach", "detach"), "calculation": ("resolve",), "conflict": ("resolve",), "finding": ("accept",), "artifact": ("copy",)}


def latest(decisions: DataFrame, kind: str) -> DataFrame:
    w = Window.partitionBy("target_id").orderBy(F.desc("at"), F.desc("decision_id"))
    return decisions.where(F.col("target_kind") == kind).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replayed(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """(claim_id, live, origin, text, into): what each claim's history in the log, in order, makes of it.

    A claim lives from its seeding, or from a decision that creates it with a text, until it is deleted or merged; created again
    it lives again. An edit gives a living claim its text and has no effect on others; nor has the creation of a living claim. A
    deletion also ends a merge: what the claim had handed on goes with it. A claim that is merged anew goes to the later one.
    """
    order = F.struct("at", "decision_id", "action", F.col("payload")["text"].alias("text"), F.col("payload")["into"].alias("into"))
    history = decisions.where("target_kind = 'claim'").groupBy(F.col("target_id").alias("claim_id")).agg(F.sort_array(F.collect_list(order)).alias("history"))
    all_ = claims.select("claim_id", F.lit(True).alias("seeded"), "text", F.col("origin").alias("was")).join(history, "claim_id", "full")
    none = F.lit(None).cast("string")
    start = F.struct(F.coalesce("seeded", F.lit(False)).alias("live"), F.col("was").alias("origin"), F.col("text").alias("text"), none.alias("into"))

    def step(s, d):
        made = (d["action"] == "create") & ~s["live"] & d["text"].isNotNull()
        edited = (d["action"] == "edit") & s["live"] & d["text"].isNotNull()
        gone, merged = d["action"] == "delete", (d["action"] == "merge") & d["into"].isNotNull() & (s["live"] | s["into"].isNotNull())
        return F.struct(
            F.when(made, F.lit(True)).when(gone | merged, F.lit(False)).otherwise(s["live"]).alias("live"),
            F.when(made, F.lit("created")).when(edited & (s["origin"] != "created"), F.lit("edited")).otherwise(s["origin"]).alias("origin"),
            F.when(made | edited, d["text"]).otherwise(s["text"]).alias("text"),
            F.when(made | gone, none).when(merged, d["into"]).otherwise(s["into"]).alias("into"),
        )

    state = F.aggregate(F.coalesce("history", F.array().cast(history.schema["history"].dataType)), start, step)
    return all_.select("claim_id", state.alias("s")).select("claim_id", "s.*")


def apply_to_claims(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims after creations, edits, deletions and merges: a merged claim goes, and what supported it supports the other."""
    now = replayed(claims, decisions).where("live").drop("live", "into")
    was = claims.select("claim_id", "source_id", "name", "anchor")
    review = lambda c: F.coalesce(c, F.lit("review"))
    out = now.join(was, "claim_id", "left").select("claim_id", review("source_id").alias("source_id"), review("name").alias("name"), "anchor", "text", "origin")
    return out.withColumn("terms", X.terms(F.col("text"))).withColumn("numbers", X.numbers(F.col("text"))).select(*[c for c in claims.columns if c in ("claim_id", "source_id", "name", "anchor", "text", "origin", "terms", "numbers")])


def merges(claims: DataFrame | None, decisions: DataFrame) -> DataFrame:
    """(claim_id, into): each merged claim with the one at the end of its chain of merges. A circle raises an error.

    Each round goes twice as far as the one before and is written to the shared folder, so n merges take at most log2(n) + 1 rounds,
    whatever their chains; what is left then goes round in a circle. ``claims`` are those that the log doesn't have to create; without
    them every claim of the log counts as one.
    """
    if claims is None:
        claims = decisions.where("target_kind = 'claim'").select(F.col("target_id").alias("claim_id"), F.lit("").alias("text"), F.lit("seeded").alias("origin")).distinct()
    step = cut(replayed(claims, decisions).where("into is not null").select("claim_id", "into"))
    ahead = lambda: step.select(F.col("claim_id").alias("into"), F.col("into").alias("then"))
    for _ in range(step.count().bit_length() + 1):
        if step.join(ahead(), "into", "left_semi").isEmpty():
            return step
        step = cut(step.join(ahead(), "into", "left").select("claim_id", F.coalesce("then", "into").alias("into")))
    raise ValueError("merges of claims form a circle")


def support(decisions: DataFrame, evidence: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Attached support whose evidence is still what was decided on, following merges of claims (see merges).

    ``quote_begin`` and ``quote_end`` are where the quote stands in the evidence's text, null where it doesn't.
    """
    d = latest(decisions, "support").where("action = 'attach'")
    p = F.col("payload")
    s = d.select(p["claim_id"].alias("claim_id"), p["evidence_id"].alias("evidence_id"), p["quote"].alias("quote"), "rationale", "decision_id", "content_hash")
    e = evidence.select("evidence_id", "source_id", "anchor", "text", F.sha2("text", 256).alias("_hash"))
    begin = F.when(F.col("quote") != "", F.expr("nullif(instr(text, quote), 0) - 1"))
    s = s.join(e, "evidence_id").where("content_hash is null or content_hash = _hash").withColumn("quote_begin", begin).withColumn("quote_end", F.col("quote_begin") + F.length("quote")).drop("_hash", "content_hash", "text")
    return s.join(merges(claims, decisions), "claim_id", "left").withColumn("claim_id", F.coalesce("into", "claim_id")).drop("into")


def open_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    done = latest(decisions, "conflict").where("action = 'resolve'").select(F.col("target_id").alias("conflict_id"))
    return conflicts.join(done, "conflict_id", "left_anti")


def open_findings(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings that no acceptance, and for calculations no resolution, covers. A finding's id is its content's, so changed evidence opens it again."""
    done = latest(decisions, "finding").where("action = 'accept'").select(F.col("target_id").alias("finding_id"))
    solved = latest(decisions, "calculation").where("action = 'resolve'").select(F.col("target_id").alias("finding_id"))
    return findings.join(done.unionByName(solved).distinct(), "finding_id", "left_anti")
