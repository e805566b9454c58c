"""What a host may read without running anything (resources), and templates it may fill (prompts).

Both give what the engine itself uses: the card that the model is given, the schema of the records that audits return, the
prompts that answers and statements are asked for with. Nothing here starts a Spark job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from wayfind.engine import answer_prompt, audit_schema
from wayfind.operators.sql_lane import nl2sql_prompt
from wayfind.sources.profile import Profile

#: What the fields of an audit record mean.
AUDIT_FIELDS = {
    "rule_fingerprint": "covers what rules alone decide: equal questions have equal values, whatever the model",
    "pipeline_fingerprint": "covers the fused items and the kept ones too: a model that wavers changes it",
    "verdicts": "what took place, and nothing else",
    "fusion": "the first ten fused items, previews of 120 characters",
    "n_kept": "items in the context, each of them whole",
    "errors": "lanes that failed, as lane: reason; the others went on",
}
#: What the verdicts of an audit record mean, by their beginnings.
AUDIT_VERDICTS = {
    "route:": "the route that the rules chose",
    "sql:read_only_ok": "a statement passed the guard and ran",
    "sql:refused_or_failed": "a statement was refused, or failed also after its repair",
    "lanes_failed:": "some lanes failed; the rest answered",
    "fusion:rrf": "lanes were fused by reciprocal rank",
    "curation:rows_whole": "items were cut to the budget, never inside an item",
}


@dataclass(frozen=True)
class Resource:
    uri: str
    title: str
    mime_type: str
    read: Callable[[], str]


@dataclass(frozen=True)
class Prompt:
    name: str
    title: str
    arguments: tuple[str, ...]  # all are required
    fill: Callable[..., str]

    def __call__(self, **given: str) -> str:
        missing = [a for a in self.arguments if a not in given]
        if missing or set(given) - set(self.arguments):
            raise ValueError(f"{self.name} takes {', '.join(self.arguments)}; missing: {', '.join(missing) or 'none'}")
        return self.fill(**given)


def file_text(path: Path, otherwise: str) -> str:
    """The file's text, or the sentence that stands for it: a resource that isn't there says so."""
    try:
        return path.read_text(encoding="utf-8")
    except OSError:
        return otherwise


def results_index(folder: Path) -> str:
    """A Markdown line for each JSON file of a folder, by name: its first six fields, or those of its summary."""
    if not folder.is_dir():
        return f"{folder.name}: no such folder"
    lines = ["# Results", ""]
    for path in sorted(folder.glob("*.json")):
        try:
            found = json.loads(path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            lines.append(f"- **{path.name}**: cannot be read as JSON")
            continue
        if isinstance(found, dict):
            found = found.get("summary", found)
        fields = list(found.items())[:6] if isinstance(found, dict) else [("items", len(found) if isinstance(found, list) else 1)]
        lines.append(f"- **{path.name}**: " + ", ".join(f"{k}={json.dumps(v, ensure_ascii=False)}" for k, v in fields)[:300])
    return "\n".join(lines)


def section(text: str, heading: str) -> str | None:
    """The second-level section of a Markdown text whose heading, without a number, begins with these words in any case; None without one."""
    taken: list[str] = []
    for line in text.split("\n"):
        if line.startswith("## "):
            if taken:
                break
            if line[3:].strip().lstrip("0123456789. ").lower().startswith(heading.lower()):
                taken = [line]
        elif taken:
            taken.append(line)
    return "\n".join(taken).rstrip() or None


def resources(spark: SparkSession, profile: Profile, home: str) -> dict[str, Resource]:
    """The six resources by URI. home: the folder with datasets/MANIFEST.md, eval/results and docs/report.md, where there are any."""
    at = Path(home)

    def evidence() -> str:
        found = section(file_text(at / "docs/report.md", ""), "Evidence manifest")
        return found or "docs/report.md has no section named Evidence manifest"

    def active() -> str:
        told = {"profile": profile.name, "tables": list(profile.tables), "replica": profile.replica, "embed_dim": profile.vector_dim}
        return json.dumps(told, indent=2)

    def audit() -> str:
        told = {"record": audit_schema(spark).jsonValue(), "fields": AUDIT_FIELDS, "verdicts": AUDIT_VERDICTS}
        return json.dumps(told, indent=2)

    found = (
        Resource("schema://dataset/tables", "Tables of the active profile", "text/plain", lambda: f"# profile: {profile.name}\n\n{profile.schema_card}"),
        Resource("dataset://company/manifest", "Where the data set comes from", "text/markdown", lambda: file_text(at / "datasets/MANIFEST.md", "datasets/MANIFEST.md is not there")),
        Resource("eval://results/index", "Results of evaluations", "text/markdown", lambda: results_index(at / "eval/results")),
        Resource("profile://dataset/active", "The active profile", "application/json", active),
        Resource("audit://schema/v1", "Schema of audit records", "application/json", audit),
        Resource("docs://report/evidence", "Figures and the commands that give them", "text/markdown", evidence),
    )
    return {r.uri: r for r in found}


def explain_routing(question: str, routing: str) -> str:
    return f"Rules, not a model, took the decision below. Explain it for a reader from what is given alone; add no reason of your own.\n\nDecision:\n{routing}\n\nQuestion: {question}"


def prompts(profile: Profile) -> dict[str, Prompt]:
    """The four prompts by name. Hidden tables of the profile are in no card, so in no prompt."""

    def review(question: str, sql: str) -> str:
        return f"Does the statement answer the question? Hold it against the tables: columns that do not exist, joins that are missing, filters that take too much away, values that a column never has.\n\nTables:\n{profile.schema_card}\n\nQuestion: {question}\nStatement: {sql}"

    found = (
        Prompt("grounded-answer", "An answer from the context alone, as ask wants it", ("question", "context"), lambda question, context: answer_prompt(question, context)),
        Prompt("nl2sql-with-schema-card", "A statement from the question and the tables", ("question",), lambda question: nl2sql_prompt(question, profile.schema_card)),
        Prompt("explain-routing", "Why the router chose its lanes", ("question", "routing"), explain_routing),
        Prompt("review-generated-sql", "A look at a statement before it runs", ("question", "sql"), review),
    )
    return {p.name: p for p in found}
