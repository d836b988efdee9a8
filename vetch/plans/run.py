"""A run: inspect, verify, gate, and write what the gate allows; a refresh is a new run that keeps the prior trail by receipt."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import amounts as A
from ..operators import claims as C
from ..operators import conflicts as K
from ..operators import decisions as D
from ..operators import findings as N
from ..operators import gate as G
from ..operators import inspection as I
from ..operators import legal as L
from ..operators import matching as M
from ..operators import versions as V
from ..operators import workbook as W
from ..sources import packet as P
from . import render
from .store import Store

PROFILES = ("general", "legal")
RUN = "slug string, name string, kind string, profile string, input_dir string, generate boolean, drafts array<string>, prior_run_id string, created_at timestamp"


def slug_of(name: str, run_id: str) -> str:
    """The name as a folder name, with a part of the run's id so that repeats don't overwrite each other."""
    return f"{re.sub(r'[^a-z0-9]+', '-', name.lower()).strip('-') or 'run'}-{run_id[:8]}"


def source_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change): what became of each file between two packets, by content."""
    a, b = (x.select("name", F.col("sha256").alias(s)) for x, s in ((old, "old"), (new, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "name", "full").select("name", change.alias("change"), "old", "new")


@dataclass
class Review:
    """The tables of one review; each is worked out when asked for."""

    spark: SparkSession
    input_dir: str
    drafts: list[str] = field(default_factory=list)
    decisions: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.decisions is None:
            self.decisions = self.spark.createDataFrame([], D.SCHEMA)
        self.held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> DataFrame:
        """Keeps what several artifacts read, until release()."""
        self.held.append(df.persist())
        return self.held[-1]

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()

    @cached_property
    def facts(self) -> DataFrame:
        return self.hold(cut(P.inspect(P.scan(self.spark, self.input_dir), self.input_dir)))  # all that follows plans from here

    @cached_property
    def sources(self) -> DataFrame:
        return self.hold(P.drafts(I.inventory(self.facts), self.drafts))

    @cached_property
    def evidence(self) -> DataFrame:
        return self.hold(I.evidence(self.facts, self.sources))

    @cached_property
    def pdf_candidates(self) -> DataFrame:
        """What may be a section, a citation or a row of a table in a PDF's text: (name, page, ordinal, kind, text)."""
        names = self.sources.select("source_id", "name")
        parts = [
            I.pdf_sections(self.facts).select("source_id", "page", "ordinal", F.lit("section").alias("kind"), "text"),
            I.pdf_citations(self.facts).select("source_id", "page", "ordinal", F.lit("citation").alias("kind"), F.col("citation").alias("text")),
            I.pdf_table_rows(self.facts).select("source_id", "page", "ordinal", F.lit("table row").alias("kind"), F.array_join("cells", " | ").alias("text")),
        ]
        return names.join(N.union(*parts), "source_id").select("name", "page", "ordinal", "kind", "text")

    @cached_property
    def seeded(self) -> DataFrame:
        return self.hold(C.seed(self.facts, self.sources))

    @cached_property
    def claims(self) -> DataFrame:
        return self.hold(D.apply_to_claims(self.seeded, self.decisions))

    @cached_property
    def support(self) -> DataFrame:
        return self.hold(D.support(self.decisions, self.evidence, self.seeded))

    @cached_property
    def suggestions(self) -> DataFrame:
        return self.hold(M.suggest(self.claims, self.evidence))

    @cached_property
    def conflicts(self) -> DataFrame:
        return self.hold(K.conflicts(self.facts, self.sources))

    @cached_property
    def open_conflicts(self) -> DataFrame:
        return D.open_conflicts(self.conflicts, self.decisions)

    @cached_property
    def all_findings(self) -> DataFrame:
        return N.union(N.source_findings(self.sources), N.workbook_findings(self.facts), N.conflict_findings(self.open_conflicts), N.claim_findings(self.claims, self.support, C.empty_drafts(self.sources, self.seeded)), N.number_findings(A.contradicted(self.claims, self.evidence, self.suggestions)))

    @cached_property
    def findings(self) -> DataFrame:
        return self.hold(D.open_findings(self.all_findings, self.decisions))

    @cached_property
    def readiness(self) -> DataFrame:
        return G.readiness(self.findings)

    @cached_property
    def selection(self) -> DataFrame:
        return self.hold(I.selection(self.sources, self.findings))

    @cached_property
    def generated(self) -> DataFrame:
        return self.hold(C.generated(self.claims, self.support, self.evidence, self.selection))

    @cached_property
    def blockers(self) -> DataFrame:
        return G.blockers(self.open_conflicts, self.selection, self.generated, C.unsupported(self.claims, self.support))


class LegalReview(Review):
    """The legal profile's tables beside the general ones; its findings are the legal trust checks.

    ``earlier`` gives what runs reviewed before within a boundary, or None.
    """

    earlier: Callable[[str], DataFrame | None] = staticmethod(lambda key: None)

    @cached_property
    def marks(self) -> DataFrame:
        return self.hold(L.marks(self.facts))

    @cached_property
    def passages(self) -> DataFrame:
        return L.passages(self.facts)

    @cached_property
    def propositions(self) -> DataFrame:
        return L.propositions(self.facts)

    @cached_property
    def boundary_key(self) -> str | None:
        return L.boundary(self.sources, self.marks).agg(F.min("boundary_key")).first()[0]

    @cached_property
    def reviewed(self) -> DataFrame:
        """This run's accepted propositions, for its library and those of later runs."""
        accepted = D.latest(self.decisions, "proposition").where("action = 'accept'")
        return self.hold(L.reviewed(L.legal_map(self.propositions, self.passages), accepted, self.boundary_key))

    @cached_property
    def library(self) -> DataFrame:
        earlier = self.earlier(self.boundary_key) if self.boundary_key else None
        return L.reusable(self.reviewed, self.reviewed.limit(0) if earlier is None else earlier, self.passages)

    @cached_property
    def all_findings(self) -> DataFrame:
        return N.union(L.trust_findings(self.propositions, self.passages, self.sources), N.source_findings(self.sources.where("inspection like 'unreadable%' or inspection = 'no text'")))


def _manifest(out: render.Artifacts, artifact: str, scope: str) -> dict:
    """Says which artifact is ready and how far that goes: never to the input files."""
    out.text("export", "ready-manifest.json", json.dumps({"artifact": artifact, "scope": scope}, indent=1))
    out.text("export", "README.md", f"# Ready\n\nArtifact: {artifact}\n\nScope: {scope}, not the input files.")
    return {"outcome": "ready", "artifact": artifact, "blockers": []}


def _export_general(r: Review, out: render.Artifacts, name: str, generate: bool, state: dict) -> dict:
    blockers = out.rows("export", "blockers.json", r.blockers.orderBy("blocker", "subject")) if generate else []
    ready = state["state"] == "ready"
    if generate and ready and not blockers:
        out.rows("verify", "generated-claims.json", r.generated.orderBy("generated_id"))
        lines = out.rows("export", "receipt.json", G.receipt(r.generated).orderBy("claim_id"))
        out.rows("export", "receipt-sources.json", G.receipt_sources(r.selection, r.generated).orderBy("name"))
        body = render.receipt(name, lines)
        for file, text in (("final-output.md", body), ("formatted-output.md", render.formatted(body)), ("edited-output.md", render.edited(body))):
            out.text("export", file, text)
        return _manifest(out, "final-output.md", "the generated receipt and review packet")
    if not generate and ready:
        return _manifest(out, "review packet", "the review packet")
    said = [f"{b['blocker']}: {b['subject']}" for b in blockers] + ([] if ready else [f"readiness is {state['state']}"])
    out.text("export", "general-export-refusal.md", "# Refused\n\n" + "\n".join(f"- {x}" for x in said))
    return {"outcome": "refused", "artifact": None, "blockers": said}


def _export_legal(r: LegalReview, out: render.Artifacts, state: dict) -> dict:
    out.rows("source", "legal-source-packet.json", L.classify(r.sources, r.marks).orderBy("name"))
    out.rows("source", "legal-passages.json", r.passages.orderBy("passage_id"))
    out.rows("source", "legal-source-history.json", L.history(r.sources).orderBy("name"))
    out.rows("spec", "legal-output-spec.json", L.output_spec(r.sources, r.marks))
    limits = L.boundary(r.sources, r.marks)
    out.rows("spec", "legal-boundary.json", limits)
    mapped = L.legal_map(r.propositions, r.passages)
    out.rows("verify", "legal-support-map.json", mapped.orderBy("proposition_id"))
    out.rows("verify", "legal-reuse-library.json", r.library.orderBy("proposition_id", "quote_hash"))
    ready = state["state"] == "ready"
    said = [] if ready else [f"{x['location']}: {x['issue']}" for x in out.rows("verify", "legal-trust-checks.json", G.review_queue(r.findings))]
    out.text("export", "README.md", "# Legal export receipt\n\nScope: the review packet. This is no legal advice." if ready else "# Legal export refused\n\n" + "\n".join(f"- {x}" for x in said))
    return {"outcome": "ready" if ready else "refused", "artifact": "README.md" if ready else None, "blockers": said}


def write(r: Review, out: render.Artifacts, name: str, kind: str, profile: str, generate: bool) -> dict:
    """Writes the artifacts of a review and returns its state, findings and export."""
    sources = out.rows("source", "sources.json", r.selection.orderBy("name"))
    out.lines("source", "file-inspections.json", r.facts.where("kind is not null").sortWithinPartitions("name", "page", "sheet", "ordinal", "cell"))
    conflicts = out.rows("source", "conflict-log.json", r.conflicts.orderBy("conflict_id"))
    evidence = out.rows("source", "source-evidence.json", r.evidence.orderBy("evidence_id"))
    shown = {"name": "File", "inspection": "Inspected", "role": "Role", "status": "Status", "source_date": "Date", "selected": "Selected", "excluded_reason": "Excluded because"}
    out.text("source", "source-packet.md", f"# Source packet: {name}\n\n{len(sources)} files, {len(evidence)} evidence snippets, {len(conflicts)} conflicts\n\n" + render.table(sources, shown))
    checks = out.rows("spec", "artifact-spec.json", G.artifact_spec(r.spark, kind))
    out.text("spec", "artifact-spec.md", f"# Artifact specification: {kind}\n\n" + "\n".join(f"- {c['expectation']}" for c in checks))
    findings = out.rows("verify", "findings.json", G.review_queue(r.findings))
    state = r.readiness.first().asDict()
    out.text("verify", "trust-report.json", json.dumps({**state, "findings": findings}, indent=1))
    out.text("verify", "verification-report.md", render.report(state, findings))
    out.text("verify", "review-queue.md", "# Review queue\n\n" + "\n".join(f"{n}. [{f['severity']}] {f['location']}: {f['issue']}" for n, f in enumerate(findings, 1)))
    links = out.rows("verify", "evidence-link-suggestions.json", r.suggestions.orderBy("claim_id", "rank"))
    out.text("verify", "evidence-link-suggestions.md", "# Link suggestions\n\nAdvice only: a reviewer's decision makes support.\n\n" + render.table(links, {"claim_id": "Claim", "evidence_id": "Evidence", "confidence": "Confidence", "basis": "Basis"}))
    repairs = out.rows("verify", "calculation-repair-packet.json", W.repair_packet(r.facts).orderBy("name", "sheet", "cell"))
    out.text("verify", "calculation-repair-packet.md", "# Calculation repairs\n\n" + "\n".join(f"- {x['name']} {x['sheet']}!{x['cell']} ({x['value']}): {' '.join(x['checklist'])} Suggested: {x.get('suggested_input')}" for x in repairs))
    out.rows("source", "pdf-candidates.json", r.pdf_candidates.orderBy("name", "page", "ordinal", "kind", "text"))
    out.rows("source", "workbook-headers.json", W.headers(r.facts).orderBy("source_id", "sheet", "cell"))
    clean = out.rows("verify", "clean-sources.json", N.clean_sources(r.sources, r.findings).select("source_id", "name").orderBy("name"))
    out.text("verify", "clean-sources.md", "# Sources without findings\n\n" + "\n".join(f"- {c['name']}" for c in clean))
    out.rows("verify", "claims.json", r.claims.orderBy("claim_id"))
    out.rows("verify", "claim-map.json", C.claim_map(r.claims, r.support).orderBy("claim_id"))
    export = _export_legal(r, out, state) if isinstance(r, LegalReview) else _export_general(r, out, name, generate, state)
    return {**state, "findings": findings, "export": export, "path": out.root}


def start(spark: SparkSession, store: Store, deliverables: str, name: str, input_dir: str, kind: str = "document", profile: str = "general", drafts: list[str] | None = None, generate: bool = False, prior: str | None = None) -> dict:
    """A new run; its state, findings, export and run_id."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    run_id = uuid.uuid4().hex
    row = (slug_of(name, run_id), name, kind, profile, input_dir, generate, drafts or [], prior)
    runs = spark.createDataFrame([row], RUN.rsplit(", ", 1)[0]).withColumn("created_at", F.current_timestamp())
    out = render.Artifacts(deliverables, row[0])
    result = step(spark, store, run_id, row, out, spark.createDataFrame([], D.SCHEMA), {"runs": runs})
    return {"run_id": run_id, **result}


def _reviewed_before(store: Store, run_id: str, key: str) -> DataFrame | None:
    """What other runs reviewed within the boundary; only its folders are read."""
    rows = store.get("reuse")
    return rows if rows is None else rows.where((F.col("boundary") == L.boundary_folder(F.lit(key))) & (F.col("boundary_key") == key) & (F.col("run_id") != run_id))


def step(spark: SparkSession, store: Store, run_id: str, run: tuple, out: render.Artifacts, decisions: DataFrame, more: dict[str, DataFrame] | None = None) -> dict:
    """Works a run out again with its decisions, writes its artifacts and publishes its tables, and ``more``, together."""
    _, name, kind, profile, input_dir, generate, drafts, _ = run[:8]
    r = (LegalReview if profile == "legal" else Review)(spark, input_dir, list(drafts), decisions)
    if isinstance(r, LegalReview):
        r.earlier = lambda key: _reviewed_before(store, run_id, key)
    try:
        result = write(r, out, name, kind, profile, generate)
        evidence = r.evidence.select("evidence_id", "source_id", "name", "anchor", F.sha2("text", 256).alias("hash"))
        tables = {"sources": r.selection, "evidence": evidence, "claims": r.claims, "support": r.support, "findings": r.findings, "conflicts": r.conflicts, "suggestions": r.suggestions, "readiness": r.readiness}
        if isinstance(r, LegalReview):
            tables["reuse"] = r.reviewed.withColumn("boundary", L.boundary_folder(F.col("boundary_key")))
        store.publish(run_id, {**tables, **(more or {})})
    finally:
        r.release()
    return result


def _voided(store: Store, old_run: str, new_run: str, out: render.Artifacts) -> list[dict]:
    """What became of the passages between two runs, and of the support attached in the first."""
    files = [store.get("sources", x).select("name", "sha256") for x in (old_run, new_run)]
    old, new = (V.places(store.get("evidence", x)) for x in (old_run, new_run))
    changes = V.aligned(V.paired(*files, old, new), old, new)
    out.lines("refresh", "passage-changes.json", changes.sortWithinPartitions("old_name", "new_name", "old_place", "new_place"))
    support = store.get("support", old_run).select("claim_id", "evidence_id").distinct()
    return out.rows("refresh", "voided-approvals.json", V.approvals(changes, old, support).orderBy("claim_id", "evidence_id"))


def refresh(spark: SparkSession, store: Store, deliverables: str, from_run: str, name: str, input_dir: str, kind: str = "document", generate: bool = False) -> dict:
    """A new run from a prior one, with those of its declared drafts that are still in the packet. Approvals of the prior run aren't
    replayed: its trail is copied, with hashes, and what changed is listed."""
    runs = store.get("runs", from_run)
    prior = runs.first() if runs is not None else None
    if prior is None:
        raise ValueError(f"no run {from_run}")
    here = {r["name"] for r in P.scan(spark, input_dir).where(F.col("name").isin(list(prior["drafts"]))).select("name").collect()}  # as many as were declared
    result = start(spark, store, deliverables, name, input_dir, kind, prior["profile"], [d for d in prior["drafts"] if d in here], generate, from_run)
    out = render.Artifacts(deliverables, os.path.basename(result["path"]))
    trail = os.path.join(deliverables, prior["slug"], render.FOLDERS["verify"])
    kept = []
    for file in sorted(os.listdir(trail)) if os.path.isdir(trail) else []:
        to = out.path("refresh", f"prior-{file}")
        shutil.copyfile(os.path.join(trail, file), to)
        kept.append(to)
    snapshot = spark.read.format("binaryFile").load(kept).select(F.regexp_replace("path", "^.*/", "").alias("path"), F.sha2("content", 256).alias("sha256")).orderBy("path") if kept else None
    if snapshot is not None:
        out.rows("refresh", "snapshots.json", snapshot)
    changes = out.rows("refresh", "refresh-receipt.json", source_diff(store.get("sources", from_run), store.get("sources", result["run_id"])).orderBy("name"))
    voided = _voided(store, from_run, result["run_id"], out)
    out.text("refresh", "refresh-receipt.md", f"# Refresh of {from_run}\n\nNo approval is carried over.\n\n" + render.table(changes, {"name": "File", "change": "Change"}) + "\n\nApproved evidence and what became of it:\n\n" + render.table(voided, {"claim_id": "Claim", "evidence_id": "Evidence", "change": "Change", "void": "Void"}))
    return {**result, "prior_run_id": from_run, "changes": changes, "approvals": voided}
