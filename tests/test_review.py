import io
import json
import os

import pytest
from pyspark.sql import functions as F

from vetch.__main__ import main
from vetch.operators import conflicts as K
from vetch.operators import decisions as D
from vetch.operators import findings as N
from vetch.plans import render, run, sample
from vetch.plans.service import Service, answer, serve
from vetch.plans.store import MemoryStore, ParquetStore


def put(folder, contents):
    os.makedirs(folder, exist_ok=True)
    for name, body in contents.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(body)
    return str(folder)


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    at = tmp_path_factory.mktemp("review")
    return {"packet": put(at / "packet", sample.packet()), "legal": put(at / "legal", sample.legal_packet()), "out": str(at / "deliverables")}


@pytest.fixture(scope="module")
def service(spark, place):
    return Service(spark, ParquetStore(spark, f"{place['out']}/store"), place["out"])


@pytest.fixture(scope="module")
def first(service, place):
    return service.run_workflow("Quarter review", place["packet"], drafts=["summary-draft.docx"])


def test_planted_defects_are_found(first):
    found = {(f["severity"], f["location"], f["issue"]) for f in first["findings"]}
    assert {
        ("must_fix", "workbook:quarter-model.xlsx", "Hardcoded numbers appear in calculation-like zones."),
        ("must_fix", "source:quarter-model.xlsx", "Number-bearing source has no source date."),
        ("should_fix", "workbook:quarter-model.xlsx:Old inputs", "Workbook contains a hidden sheet."),
        ("should_fix", "workbook:quarter-model.xlsx", "No checks sheet detected."),
        ("must_fix", "source-conflict", "Potential version/status conflict across: figures-final.csv, figures-old.csv"),
        ("must_fix", "source-conflict", "Metric revenue differs across: figures-final.csv, figures-old.csv"),
        ("must_fix", "section-map", "Claim has no source attribution."),
        ("should_fix", "source:field-notes.md", "Source status is unclear."),
        ("must_fix", "source:scanned.pdf", "PDF has no extractable text: it needs OCR or replacement."),
    } <= found
    assert not any("2025-04-02-answers-raw.csv" in f["location"] for f in first["findings"])
    assert first["state"] == "blocked" and first["blocking"] == sum(f["severity"] == N.MUST for f in first["findings"])
    assert first["findings"] == sorted(first["findings"], key=lambda f: (f["severity"], f["location"], f["finding_id"]))


def test_artifacts(first):
    at = first["path"]
    for name in ("01_source-packet/source-packet.md", "01_source-packet/conflict-log.json", "02_artifact-spec/artifact-spec.md", "03_verification/trust-report.json", "03_verification/review-queue.md", "03_verification/verification-report.md", "03_verification/evidence-link-suggestions.md", "03_verification/calculation-repair-packet.json", "04_export/general-export-refusal.md"):
        assert os.path.getsize(os.path.join(at, name)), name
    claims = json.load(open(f"{at}/03_verification/claims.json"))
    assert {c["name"] for c in claims} == {"summary-draft.docx"}
    links = json.load(open(f"{at}/03_verification/evidence-link-suggestions.json"))
    assert links and all(x["confidence"] > 0 and x["rank"] <= 3 for x in links)
    assert not os.path.exists(f"{at}/04_export/final-output.md")


def test_decisions_and_refresh(service, place, first):
    run_id = first["run_id"]
    assert service.status(run_id)["state"] == "blocked" and "must_fix" in service.next_action(run_id)["next_action"]
    assert service.get_verification_report(run_id).startswith("# Verification report")
    claim = json.load(open(f"{first['path']}/03_verification/claims.json"))[0]
    link = service.get_evidence_link_suggestions(run_id)[0]
    out = service.attach_support(run_id, claim["claim_id"], link["evidence_id"], "audited ledger", "reviewer", "same subject")
    subject = [f for f in out["findings"] if f.get("subject") == claim["claim_id"] and f["rule_id"] == "no_attribution"]
    assert not subject and out["blocking"] == first["blocking"] - 1
    conflict = json.load(open(f"{first['path']}/01_source-packet/conflict-log.json"))[0]
    assert service.resolve_conflict(run_id, conflict["conflict_id"], "reviewer", "the final file counts")["blocking"] == out["blocking"] - 1
    with pytest.raises(ValueError, match="rationale"):
        service.accept_finding(run_id, "x", "reviewer", "")
    with pytest.raises(ValueError, match="not ready"):
        service.copy_final_artifact(run_id, __file__, "reviewer", "approved")
    again = service.refresh_workflow(run_id, "Quarter refresh", place["packet"])
    assert {(a["change"], a["void"]) for a in again["approvals"]} == {("kept", False)}
    assert {c["change"] for c in again["changes"]} == {"unchanged"} and again["blocking"] >= first["blocking"]  # nothing is replayed
    assert os.path.exists(f"{again['path']}/00_refresh/refresh-receipt.md") and os.path.exists(f"{again['path']}/00_refresh/prior-trust-report.json")


def test_generation_when_clean(spark, service, tmp_path):
    files = {
        "report-draft.md": b"Status: draft. Data as of 2025-05-01.\n\nNorthern branch revenue reached 120 million dollars during spring.\n",
        "2025-04-30-ledger-final.md": b"Status: final.\n\nAudited northern branch revenue reached 120 million dollars during spring.\n",
    }
    folder = put(tmp_path / "clean", files)
    out = service.run_workflow("Clean", folder, kind="report", drafts=["report-draft.md"], generate=True)
    assert out["export"]["outcome"] == "refused" and {"no generated claim: receipt", "readiness is blocked"} <= set(out["export"]["blockers"])
    assert any(b.startswith("unsupported claim: ") for b in out["export"]["blockers"])
    claim = json.load(open(f"{out['path']}/03_verification/claims.json"))[0]
    evidence = json.load(open(f"{out['path']}/01_source-packet/source-evidence.json"))[0]
    done = service.attach_support(out["run_id"], claim["claim_id"], evidence["evidence_id"], "reached 120 million dollars", "reviewer", "the ledger says so")
    assert done["export"]["outcome"] == "ready" and done["state"] == "ready"
    final = open(f"{out['path']}/04_export/final-output.md").read()
    assert claim["text"] in final and evidence["evidence_id"] in final and "2025-04-30-ledger-final.md" in final
    copied = service.copy_final_artifact(out["run_id"], os.path.join(folder, "report-draft.md"), "reviewer", "approved")
    assert os.path.exists(copied["copied_to"])
    deleted = service.delete_claim(out["run_id"], claim["claim_id"], "reviewer", "withdrawn")
    assert deleted["export"]["outcome"] == "refused"


def test_one_bare_claim_refuses(service, tmp_path):
    files = {
        "report-draft.md": b"Status: draft. Data as of 2025-05-01.\n\nNorthern branch revenue reached 120 million dollars during spring.\n\nSouthern branch revenue stayed level throughout summer.\n",
        "2025-04-30-ledger-final.md": b"Status: final.\n\nAudited northern branch revenue reached 120 million dollars during spring.\n",
    }
    out = service.run_workflow("Bare", put(tmp_path / "bare", files), kind="report", drafts=["report-draft.md"], generate=True)
    claims = {c["text"].split()[0]: c["claim_id"] for c in json.load(open(f"{out['path']}/03_verification/claims.json"))}
    evidence = json.load(open(f"{out['path']}/01_source-packet/source-evidence.json"))[0]
    done = service.attach_support(out["run_id"], claims["Northern"], evidence["evidence_id"], "reached 120 million dollars", "reviewer", "the ledger says so")
    assert done["export"]["outcome"] == "refused" and f"unsupported claim: {claims['Southern']}" in done["export"]["blockers"]
    assert not os.path.exists(f"{out['path']}/04_export/final-output.md")
    with pytest.raises(ValueError, match="circle"):
        service.merge_claims(out["run_id"], claims["Southern"], claims["Southern"], "reviewer", "same")
    merged = service.merge_claims(out["run_id"], claims["Southern"], claims["Northern"], "reviewer", "one statement")
    assert merged["export"]["outcome"] == "ready"
    again = service.refresh_workflow(out["run_id"], "Bare again", str(tmp_path / "bare"))
    assert {c["name"] for c in json.load(open(f"{again['path']}/03_verification/claims.json"))} == {"report-draft.md"}  # the draft is still declared


def test_generation_obeys_readiness(spark, tmp_path):
    class Stub:
        blockers = spark.createDataFrame([], "blocker string, subject string")

    out = run._export_general(Stub(), render.Artifacts(str(tmp_path), "r"), "n", True, {"state": "blocked"})
    assert out["outcome"] == "refused" and out["blockers"] == ["readiness is blocked"] and not os.path.exists(tmp_path / "r/04_export/final-output.md")


def test_merges_go_to_the_end(spark):
    rows = [(f"d{k:05}", "claim", f"c{k}", "merge", "u", "r", None, {"into": f"c{k + 1}"}, None) for k in range(5000)]
    log = spark.createDataFrame(rows, D.SCHEMA)
    assert {r["into"] for r in D.merges(None, log).collect()} == {"c5000"}
    circle = spark.createDataFrame([("x", "claim", "c5000", "merge", "u", "r", None, {"into": "c0"}, None)], D.SCHEMA)
    with pytest.raises(ValueError, match="circle"):
        D.merges(None, log.unionByName(circle))


def test_a_history_is_replayed_in_order(spark):
    seeded = spark.createDataFrame([("s", "src", "n", None, "seed", "seeded", [], [])], "claim_id string, source_id string, name string, anchor struct<kind:string>, text string, origin string, terms array<string>, numbers array<string>")

    def after(*steps):
        log = [(f"d{k}", "claim", target, action, "u", "r", None, {x: payload for x in ("text", "into") if payload}, None) for k, (target, action, payload) in enumerate(steps)]
        log = spark.createDataFrame(log, D.SCHEMA)
        return {r["claim_id"]: (r["origin"], r["text"]) for r in D.apply_to_claims(seeded, log).collect()}, {r["claim_id"]: r["into"] for r in D.merges(seeded, log).collect()}

    assert after(("n", "create", "one"), ("n", "edit", "two")) == ({"s": ("seeded", "seed"), "n": ("created", "two")}, {})
    assert after(("s", "delete", None), ("s", "edit", "late")) == ({}, {})
    assert after(("s", "edit", "x"), ("s", "merge", "n"), ("s", "delete", None)) == ({}, {})
    assert after(("s", "merge", "n"), ("s", "merge", "m"), ("s", "edit", "x")) == ({}, {"s": "m"})
    assert after(("s", "merge", "n"), ("s", "create", "again")) == ({"s": ("created", "again")}, {})
    assert after(("n", "create", None), ("s", "create", "no"), ("s", "edit", None)) == ({"s": ("seeded", "seed")}, {})


def test_exports(spark):
    def found(*files):
        """files: name, rows with their header."""
        facts = [(n, "cell", "csv", r, f"{chr(65 + c)}{r}", v) for n, rows in files for r, row in enumerate(rows, 1) for c, v in enumerate(row)]
        facts = spark.createDataFrame(facts, "source_id string, kind string, ext string, ordinal int, cell string, text string")
        sources = spark.createDataFrame([(n, n, "notes" not in n and "data_export" or "narrative", None) for n, _ in files], "source_id string, name string, role string, source_date date")
        return {r["metric"]: r["sources"] for r in K.metric_conflicts(K.metrics(facts, sources)).collect()}

    series = [("Date", "Sales", "Costs"), ("2024-01-31", "1,200", "-5"), ("2024-02-29", "1300", "7")]
    assert found(("a", series), ("b", series)) == {}
    again = [("as_of", "revenue", "cost"), ("2024-01-31", "$1200.0", "(5)"), ("2024-02-29", "1.3 thousand", "7.00"), ("2024-03-31", "9", "9")]
    assert found(("a", series), ("b", again)) == {}
    assert found(("a", series), ("b", [*again[:2], ("2024-02-29", "1301", "7")])) == {"revenue": ["a", "b"]}
    assert found(("a", series), ("c", [("metric", "value", "as_of"), ("Sales", "99", "2024-05-31"), ("Expense", "7.0", "2024-05-31")])) == {"revenue": ["a", "c"]}
    assert found(("a", series), ("notes", [("as_of", "revenue"), ("2024-01-31", "5")])) == {}
    answers = [("respondent_id", "score", "as_of"), ("1", "3", "2024-01-31"), ("2", "4", "2024-01-31")]
    assert found(("a", answers), ("b", [("score", "as_of"), ("5", "2024-01-31")])) == {}


def test_legal_profile(service, place):
    out = service.run_workflow("Found ring", place["legal"], profile="legal")
    assert [f["rule_id"] for f in out["findings"]] == ["draft_discipline"] and out["export"]["outcome"] == "refused"
    read = lambda name: json.load(open(f"{out['path']}/{name}"))
    mapped = read("03_verification/legal-support-map.json")
    assert [(m["passage"], m["pin"], m["authority"], m["verbatim"]) for m in mapped] == [("passage_finder-v-owner_p0004", "para. 4", "binding", True)]
    assert {s["name"]: s["classification"] for s in read("01_source-packet/legal-source-packet.json")} == {"task.md": "assignment", "finder-v-owner.md": "case", "memo-draft.md": "draft"}
    assert read("02_artifact-spec/legal-boundary.json")[0]["boundary_key"] == "property"
    assert read("02_artifact-spec/legal-output-spec.json")[0]["source_scope"] == "supplied packet only"
    done = service.decide(out["run_id"], "proposition", mapped[0]["proposition_id"], "accept", "reviewer", "checked")
    assert [x["boundary_key"] for x in json.load(open(f"{done['path']}/03_verification/legal-reuse-library.json"))] == ["property"]


def test_stdio(service, first):
    assert "run_workflow" in service.tools() and answer(service, {"method": "notifications/initialized"}) is None
    asked = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "vetch_status", "arguments": {"run_id": first["run_id"]}}}, {"id": 4, "method": "tools/call", "params": {"name": "vetch_status", "arguments": {"run_id": "none"}}}, {"id": 5, "method": "no"}]
    to = io.StringIO()
    serve(service, io.StringIO("\n".join(map(json.dumps, asked))), to)
    replies = [json.loads(x) for x in to.getvalue().splitlines()]
    assert len(replies) == 5 and "blocked" in replies[2]["result"]["content"][0]["text"] and replies[3]["result"]["isError"] and "error" in replies[4]
    assert any(t["name"] == "vetch_attach_support" and "claim_id" in t["inputSchema"]["required"] for t in replies[1]["result"]["tools"])


def test_command_line_and_memory_store(spark, place, tmp_path, capsys):
    assert main(["--deliverables", str(tmp_path), "run", "--name", "Ring", "--input", place["legal"], "--profile", "legal"]) == 0
    assert "blocked" in capsys.readouterr().out
    assert main(["--deliverables", str(tmp_path), "run", "--name", "Ring", "--input", place["legal"], "--draft", "none.md"]) == 2
    store = MemoryStore()
    store.add("t", "a", spark.range(2))
    store.add("t", "a", spark.range(1))
    assert store.get("t", "a").count() == 3 and store.get("u") is None


def test_a_stopped_publication_leaves_the_former_state(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "store"))
    store.publish("1", {"a": spark.range(2), "b": spark.range(3)})
    store.publish("2", {"a": spark.range(5)})
    broken = spark.range(4).select(F.expr("raise_error('lost')").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.publish("1", {"a": spark.range(10), "b": broken})
    assert [store.get(t, "1").count() for t in "ab"] == [2, 3] and store.get("a").count() == 7
    store.publish("1", {"a": spark.range(10)})
    assert [store.get(t, "1").count() for t in "ab"] == [10, 3] and store.get("b", "2") is None
    assert {r["run_id"] for r in store.get("a").collect()} == {"1", "2"}
    assert len(store.vacuum("1")) >= 2 and [store.get(t, "1").count() for t in "ab"] == [10, 3] and store.vacuum("1") == []


def test_reuse_across_runs(spark, service, place, tmp_path):
    first = service.run_workflow("First ring", place["legal"], profile="legal")
    [mine] = json.load(open(f"{first['path']}/03_verification/legal-support-map.json"))
    service.decide(first["run_id"], "proposition", mine["proposition_id"], "accept", "reviewer", "checked")
    files = sample.legal_packet()

    def library(name, change):
        out = service.run_workflow(name, put(tmp_path / name, {**files, **change}), profile="legal")
        return {x["state"] for x in json.load(open(f"{out['path']}/03_verification/legal-reuse-library.json")) if x["proposition_id"] == mine["proposition_id"]}

    assert library("again", {}) == {"reusable"}
    passage = mine["passage_text"].encode()
    assert library("changed", {"finder-v-owner.md": files["finder-v-owner.md"].replace(passage, b"The rule is another one now.")}) == {"void"}
    assert library("elsewhere", {"task.md": files["task.md"].replace(b"Property", b"Torts").replace(b"property", b"torts")}) == set()


def test_refresh_lists_void_approvals(spark, tmp_path):
    store, notes = ParquetStore(spark, str(tmp_path / "store")), [f"Statement {w} about the branch." for w in ("one", "two", "three", "four")]
    for run_id, name, said in (("1", "notes.md", notes), ("2", "renamed.md", [notes[3], notes[0], "Statement two about another matter.", notes[2]])):
        r = run.Review(spark, put(tmp_path / run_id, {name: "\n\n".join(said).encode(), "rates.csv": b"a,b\n1,2\n"}))
        evidence = r.evidence.select("evidence_id", "source_id", "name", "anchor", F.sha2("text", 256).alias("hash"))
        store.publish(run_id, {"sources": r.sources, "evidence": evidence, "support": r.evidence.select(F.lit("c").alias("claim_id"), "evidence_id", "text").drop("text")})
        if run_id == "1":
            texts = {x["evidence_id"]: x["text"] for x in r.evidence.collect()}
    got = {texts[x["evidence_id"]]: (x["change"], x["void"]) for x in run._voided(store, "1", "2", render.Artifacts(str(tmp_path), "r"))}
    assert got == {notes[0]: ("kept", False), notes[1]: ("changed", True), notes[2]: ("kept", False), notes[3]: ("moved", False), "a,b": ("kept", False), "1,2": ("kept", False)}


def test_rendering():
    text = "# A\nx  y\n\n\n\n## B\nz"
    assert render.formatted(text) == "# A\n\nx  y\n\n## B\n\nz" and render.edited("  a   b") == "  a b"
    assert run.slug_of("My Report!", "0123456789abcdef") == "my-report-01234567"
