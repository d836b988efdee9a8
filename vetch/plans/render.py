"""Artifacts of a run: JSON by Spark's writer, Markdown of what a reviewer reads."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame

FOLDERS = {"refresh": "00_refresh", "source": "01_source-packet", "spec": "02_artifact-spec", "verify": "03_verification", "export": "04_export"}


class Artifacts:
    """The folder of one run. Rows that a reviewer reads go to JSON files named like the artifact; the facts of all files, by Spark's writer."""

    def __init__(self, root: str, slug: str):
        self.root = os.path.join(root, slug)

    def path(self, folder: str, name: str) -> str:
        at = os.path.join(self.root, FOLDERS[folder])
        os.makedirs(at, exist_ok=True)
        return os.path.join(at, name)

    def text(self, folder: str, name: str, body: str) -> str:
        at = self.path(folder, name)
        with open(at, "w", encoding="utf-8") as f:
            f.write(body if body.endswith("\n") else body + "\n")
        return at

    def lines(self, folder: str, name: str, df: DataFrame) -> str:
        """Has Spark write the rows as JSON lines into a folder of that name: for what grows with the files' contents."""
        at = self.path(folder, name)
        df.write.mode("overwrite").json(os.path.abspath(at))
        return at

    def rows(self, folder: str, name: str, df: DataFrame) -> list[dict]:
        """Writes the rows in order as a JSON list and returns them."""
        rows = [json.loads(x) for x in df.toJSON().collect()]
        self.text(folder, name, json.dumps(rows, indent=1, ensure_ascii=False, sort_keys=True))
        return rows


def table(rows: list[dict], columns: dict[str, str]) -> str:
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def report(state: dict, findings: list[dict]) -> str:
    head = f"**Readiness: {state['state']}** - Blocking issues: {state['blocking']}, Needs review: {state['needs_review']}"
    return f"# Verification report\n\n{head}\n\n" + table(findings, {"severity": "Severity", "location": "Location", "issue": "Issue"})


def receipt(name: str, claims: list[dict]) -> str:
    out = [f"# Claim receipt: {name}", "", "Ready covers this receipt and its review packet, not the input files.", ""]
    for c in claims:
        out += [f"- {c['text']}", f"  Evidence: {c['n_evidence']} ({', '.join(c['pointers'])}); sources: {', '.join(c['sources'])}"]
    return "\n".join(out)


def formatted(body: str) -> str:
    """One blank line around headings and lists, no trailing space: no new words."""
    body = re.sub(r"[ \t]+\n", "\n", body)
    body = re.sub(r"\n*(\n#{1,6} [^\n]+)\n*", r"\n\1\n\n", "\n" + body).strip()
    return re.sub(r"\n{3,}", "\n\n", body)


def edited(body: str) -> str:
    """Runs of spaces collapsed outside of line starts: no new words."""
    return "\n".join(re.match(r"\s*", line)[0] + re.sub(r"\s+", " ", line.strip()) for line in body.split("\n"))
