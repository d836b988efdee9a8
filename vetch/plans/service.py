"""The tools of a review, as functions and over stdio: run, refresh, inspect, read and decide.

serve() speaks JSON-RPC 2.0, one message a line, with the methods initialize, tools/list and tools/call that MCP clients use.
"""

from __future__ import annotations

import inspect
import json
import os
import shutil
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import gate as G
from . import render, run


class Service:
    """Every tool reads and writes through the store."""

    def __init__(self, spark: SparkSession, store, deliverables: str):
        self.spark, self.store, self.deliverables = spark, store, deliverables

    def _run(self, run_id: str):
        rows = self.store.get("runs", run_id)
        row = rows.first() if rows is not None else None
        if row is None:
            raise ValueError(f"no run {run_id}")
        return row

    def _log(self, run_id: str) -> DataFrame:
        rows = self.store.get("decisions", run_id)
        return self.spark.createDataFrame([], D.SCHEMA) if rows is None else rows.drop("run_id")

    def _rows(self, table: str, run_id: str) -> DataFrame:
        rows = self.store.get(table, run_id)
        if rows is None:
            raise ValueError(f"no {table} for run {run_id}")
        return rows

    def inspect_source_packet(self, input_dir: str) -> list[dict]:
        r = run.Review(self.spark, input_dir)
        return [json.loads(x) for x in r.sources.orderBy("name").toJSON().collect()]

    def run_workflow(self, name: str, input_dir: str, kind: str = "document", profile: str = "general", drafts: list | None = None, generate: bool = False) -> dict:
        return run.start(self.spark, self.store, self.deliverables, name, input_dir, kind, profile, drafts, generate)

    def refresh_workflow(self, from_run: str, name: str, input_dir: str, kind: str = "document", generate: bool = False) -> dict:
        return run.refresh(self.spark, self.store, self.deliverables, from_run, name, input_dir, kind, generate)

    def status(self, run_id: str) -> dict:
        self._run(run_id)
        return self._rows("readiness", run_id).first().asDict()

    def next_action(self, run_id: str) -> dict:
        first = G.next_action(self._rows("findings", run_id)).first()
        return {"next_action": first["next_action"] if first else "nothing is left to do"}

    def get_verification_report(self, run_id: str) -> str:
        findings = [r.asDict() for r in G.review_queue(self._rows("findings", run_id)).collect()]
        return render.report(self.status(run_id), findings)

    def get_evidence_link_suggestions(self, run_id: str) -> list[dict]:
        return [json.loads(x) for x in self._rows("suggestions", run_id).orderBy("claim_id", "rank").toJSON().collect()]

    def decide(self, run_id: str, target_kind: str, target_id: str, action: str, actor: str, rationale: str, payload: dict | None = None, content_hash: str | None = None) -> dict:
        """Adds a decision to the log and works the run out again."""
        if action not in (*D.ACTIONS.get(target_kind, ()), *(("accept",) if target_kind == "proposition" else ())):
            raise ValueError(f"{action!r} can't be decided on {target_kind!r}")
        if not actor or not rationale:
            raise ValueError("a decision needs an actor and a rationale")
        self._run(run_id)
        row = (uuid.uuid4().hex, target_kind, target_id, action, actor, rationale, {k: str(v) for k, v in (payload or {}).items()}, content_hash)
        names = [x for x in D.SCHEMA.split(", ") if not x.startswith("at ")]
        log = self.spark.createDataFrame([row], ", ".join(names)).withColumn("at", F.current_timestamp()).select(*[x.split()[0] for x in D.SCHEMA.split(", ")])
        self.store.add("decisions", run_id, log)
        return {"decision_id": row[0], **self.rerun(run_id)}

    def rerun(self, run_id: str) -> dict:
        r = self._run(run_id)
        values = tuple(r[k] for k in ("slug", "name", "kind", "profile", "input_dir", "generate", "drafts", "prior_run_id"))
        result = run.step(self.spark, self.store, run_id, values, render.Artifacts(self.deliverables, r["slug"]), self._log(run_id))
        return {"run_id": run_id, **result}

    def _known(self, run_id: str, table: str, column: str, value: str) -> None:
        """Refuses to decide on what the run doesn't have. A claim that a decision has taken away is still known by the log."""
        logged = self._log(run_id).where((F.col("target_kind") == "claim") & (F.col("target_id") == value)) if table == "claims" else None
        if self._rows(table, run_id).where(F.col(column) == value).isEmpty() and (logged is None or logged.isEmpty()):
            raise ValueError(f"no {column} {value} in run {run_id}")

    def create_claim(self, run_id: str, text: str, actor: str, rationale: str) -> dict:
        return self.decide(run_id, "claim", f"claim_{uuid.uuid4().hex[:16]}", "create", actor, rationale, {"text": text})

    def edit_claim(self, run_id: str, claim_id: str, text: str, actor: str, rationale: str) -> dict:
        self._known(run_id, "claims", "claim_id", claim_id)
        return self.decide(run_id, "claim", claim_id, "edit", actor, rationale, {"text": text})

    def delete_claim(self, run_id: str, claim_id: str, actor: str, rationale: str) -> dict:
        self._known(run_id, "claims", "claim_id", claim_id)
        return self.decide(run_id, "claim", claim_id, "delete", actor, rationale)

    def merge_claims(self, run_id: str, claim_id: str, into: str, actor: str, rationale: str) -> dict:
        """Merges a claim into another one; a merge that would lead back to the claim is refused."""
        for claim in (claim_id, into):
            self._known(run_id, "claims", "claim_id", claim)
        ends = D.merges(None, self._log(run_id)).where(F.col("claim_id") == into).first()
        if claim_id in (into, ends["into"] if ends else into):
            raise ValueError("the merge would form a circle")
        return self.decide(run_id, "claim", claim_id, "merge", actor, rationale, {"into": into})

    def attach_support(self, run_id: str, claim_id: str, evidence_id: str, quote: str, actor: str, rationale: str, content_hash: str | None = None) -> dict:
        self._known(run_id, "claims", "claim_id", claim_id)
        self._known(run_id, "evidence", "evidence_id", evidence_id)
        return self.decide(run_id, "support", f"{claim_id}/{evidence_id}", "attach", actor, rationale, {"claim_id": claim_id, "evidence_id": evidence_id, "quote": quote}, content_hash)

    def resolve_calculation(self, run_id: str, finding_id: str, actor: str, rationale: str) -> dict:
        return self.decide(run_id, "calculation", finding_id, "resolve", actor, rationale)

    def resolve_conflict(self, run_id: str, conflict_id: str, actor: str, rationale: str) -> dict:
        return self.decide(run_id, "conflict", conflict_id, "resolve", actor, rationale)

    def accept_finding(self, run_id: str, finding_id: str, actor: str, rationale: str) -> dict:
        return self.decide(run_id, "finding", finding_id, "accept", actor, rationale)

    def copy_final_artifact(self, run_id: str, path: str, actor: str, rationale: str) -> dict:
        """Copies a file that the user supplies into the export folder of a run that is ready, and says so in the log."""
        if self.status(run_id)["state"] != "ready":
            raise ValueError("the run is not ready")
        to = render.Artifacts(self.deliverables, self._run(run_id)["slug"]).path("export", os.path.basename(path))
        shutil.copyfile(path, to)
        return {**self.decide(run_id, "artifact", os.path.basename(path), "copy", actor, rationale), "copied_to": to}

    def tools(self) -> list[str]:
        return sorted(n for n, f in inspect.getmembers(type(self), inspect.isfunction) if not n.startswith("_") and n != "tools")


def _schema(f) -> dict:
    kinds = {"str": "string", "bool": "boolean", "list | None": "array", "dict | None": "object"}
    args = [p for n, p in inspect.signature(f).parameters.items() if n != "self"]
    return {"type": "object", "properties": {p.name: {"type": kinds.get(str(p.annotation), "string")} for p in args}, "required": [p.name for p in args if p.default is p.empty]}


def answer(service: Service, message: dict) -> dict | None:
    """The reply to one JSON-RPC message; notifications have none."""
    method, params, to = message.get("method"), message.get("params") or {}, message.get("id")
    if to is None:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": to}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "vetch", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": f"vetch_{n}", "description": (getattr(Service, n).__doc__ or n.replace("_", " ")).strip(), "inputSchema": _schema(getattr(Service, n))} for n in service.tools()]}}
    if method == "tools/call":
        name = str(params.get("name", "")).removeprefix("vetch_")
        if name not in service.tools():
            return reply | {"error": {"code": -32602, "message": f"unknown tool {name!r}"}}
        try:
            out = getattr(service, name)(**(params.get("arguments") or {}))
        except (ValueError, TypeError, OSError) as e:
            return reply | {"result": {"isError": True, "content": [{"type": "text", "text": str(e)}]}}
        return reply | {"result": {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, default=str)}]}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}


def serve(service: Service, source=sys.stdin, to=sys.stdout) -> None:
    for line in source:
        if line.strip():
            reply = answer(service, json.loads(line))
            if reply is not None:
                to.write(json.dumps(reply) + "\n")
                to.flush()
